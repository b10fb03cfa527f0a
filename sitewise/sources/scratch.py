"""Places for files that several machines must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the application ends unless ``keep``; under a temporary folder where that
    is unset and Spark runs in one process. RuntimeError where it is unset on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sitewise-')}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/sitewise-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(conf)
    system.mkdirs(path)
    if not keep:
        system.deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and reread: worked out once, whatever number of branches read it."""
    path = f"{scratch_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which :func:`beside` broadcasts.
BESIDE = 200_000


def beside(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` settled, for a join with a table whose keys may be few and hot (a site's few alleles hold all samples): broadcast
    up to ``rows`` rows (BESIDE), so that the other side is not shuffled by those keys; beyond that joined as Spark likes."""
    df = settled(df, name)
    return F.broadcast(df) if df.count() <= (BESIDE if rows is None else rows) else df
