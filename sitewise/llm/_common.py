"""Shared helpers: scratch tables in the shared folder, salted lookups, Arrow output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in
    one process. Elsewhere that would give tables that other machines cannot see: RuntimeError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sitewise-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which the driver deletes when it ends."""
    folder = f"{scratch_root(spark)}/sitewise/{spark.sparkContext.applicationId}"
    path, system = _path(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to a Parquet table in the shared folder and rereads it.

    It survives lost executors: Spark's writer commits the files and they live
    outside any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table made by :func:`table` that no pending plan reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path, system = _path(df.sparkSession, folder)
        system.delete(path, True)


def key_extreme(rows: DataFrame, key: list[str], value: str, salt: Column, extreme=F.max, salts: int = 64) -> DataFrame:
    """Per (key, _salt): the key's largest (or smallest) ``value`` and its row count ``_n``.

    Aggregates per (key, salt), then per key, and returns each result to the
    salts that exist, so that a key with a third of all rows is joined back on
    ``salts`` join keys of about equal size. Join it to :func:`salted` rows.
    """
    part = salted(rows, salt, salts).groupBy(*key, "_salt").agg(extreme(value).alias("_m"), F.count(F.lit(1)).alias("_c"))
    whole = part.groupBy(*key).agg(extreme("_m").alias("_extreme"), F.sum("_c").alias("_n"), F.collect_set("_salt").alias("_salts"))
    return whole.select(*key, F.explode("_salts").alias("_salt"), "_extreme", "_n")


def salted(rows: DataFrame, salt: Column, salts: int = 64) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))


def emit(rows: Iterable[tuple], schema: pa.Schema, size=None, limit_rows: int = 4096, limit_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded count and bytes; ``size`` gives a row's bytes."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row) if size else 0
        if len(held) >= limit_rows or total >= limit_bytes:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
