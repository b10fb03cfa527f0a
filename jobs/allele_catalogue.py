"""Keeps the alleles and feature columns of growing alignments up to date.

    python -m jobs.allele_catalogue --source FOLDER --out FOLDER --checkpoint FOLDER [--config jobs/allele_catalogue.json]

A file stream takes the Parquet files that came since the last run (its checkpoint knows which) and ends when all are
read. Each micro-batch is counted per (gene, pos, allele) and written to ``counts/batch=B/gene=G``; a batch that is
replayed overwrites its own partitions, so nothing counts twice. Then the genes that have new batches, or whose columns
were made with other settings, get new feature columns from the sums of their batches: ``features/gene=G``, by dynamic
partition overwrite; other genes are not touched. ``marks`` says up to which batch, and with which settings, a gene's columns go; they are
appended last, so that a run that broke off is made good by the next one. :func:`features` reads what the marks vouch for.

``out`` and ``checkpoint`` belong together. Only counts shuffle, in blocks of positions, so a gene with most of the rows is
many tasks and files. Edge cases: null and empty sequences have no sites; gaps are no alleles; a row is a sequence, repeated
rows count again; null or empty genes are one gene of the name ``no_gene``; a gene without columns has a mark and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import sites as A

from .common import aligned, command_line

LOG = logging.getLogger("jobs.allele_catalogue")
COUNTS = "pos int, ch string, n long, batch long, gene string"
FEATURES = "pos int, allele string, n long, total long, major string, through long, settings string, gene string"
MARKS = "gene string, through long, settings string, characters long, sites long, n_columns long, run long"


@dataclass
class Config:
    gene: str = "lang"
    sample: str = "doc_id"
    seq: str = "text"
    no_gene: str = "(none)"
    min_minor: int = 2
    drop_major: bool = False
    files_per_batch: int = 1000
    block: int = 65_536  # positions of a gene that go to one file

    @property
    def settings(self) -> str:
        return json.dumps({"min_minor": self.min_minor, "drop_major": self.drop_major})


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet; partition columns keep the types of ``schema``."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _latest(spark: SparkSession, out: str) -> DataFrame:
    """The last mark of each gene."""
    marks = _table(spark, f"{out}/marks", MARKS)
    return marks.groupBy("gene").agg(F.max_by(F.struct("through", "settings", "characters", "sites", "n_columns"), "run").alias("m")).select("gene", "m.*")


def _counted(batch: DataFrame, number: int, out: str, config: Config) -> None:
    """A micro-batch's allele counts, in partitions of its own."""
    counts = A.counted(aligned(batch, config.gene, config.sample, config.seq, config.no_gene).select("gene", "seq"))
    counts = counts.withColumn("batch", F.lit(number).cast("long")).repartition("gene", F.floor(F.col("pos") / config.block))
    counts.sortWithinPartitions("gene", "pos", "ch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gene").parquet(f"{out}/counts")
    wrote = _table(batch.sparkSession, f"{out}/counts", COUNTS).where(F.col("batch") == number).agg(F.count(F.lit(1)), F.count_distinct("gene"), F.coalesce(F.sum("n"), F.lit(0))).first()
    LOG.info("batch %d: read %d rows; wrote %d counts of %d genes, %d characters", number, batch.count(), *wrote)


def _refreshed(spark: SparkSession, out: str, config: Config) -> int:
    """New columns of the genes that their marks do not cover; how many those are."""
    counts = _table(spark, f"{out}/counts", COUNTS)
    newest = counts.groupBy("gene").agg(F.max("batch").alias("through"))  # partition columns only
    current = _latest(spark, out).where(F.col("settings") == config.settings).select("gene", "through")
    stale = newest.join(current, ["gene", "through"], "left_anti").cache()
    try:
        n = stale.count()
        if not n:
            return 0
        sums = counts.join(stale, "gene").groupBy("gene", "pos", "ch").agg(F.sum("n").alias("n"))
        found = A.features(sums, config.min_minor, config.drop_major).join(stale, "gene").withColumn("settings", F.lit(config.settings))
        found = found.select("pos", "allele", "n", "total", "major", "through", "settings", "gene").repartition("gene", F.floor(F.col("pos") / config.block)).sortWithinPartitions("gene", "pos", "allele")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gene").parquet(f"{out}/features")
        written = _table(spark, f"{out}/features", FEATURES).join(stale, ["gene", "through"]).where(F.col("settings") == config.settings).groupBy("gene").agg(F.count(F.lit(1)).alias("n_columns"))
        size = sums.groupBy("gene").agg(F.sum("n").alias("characters"), F.count_distinct("pos").alias("sites"))
        run = (_table(spark, f"{out}/marks", MARKS).agg(F.max("run")).first()[0] or 0) + 1
        marks = stale.join(size, "gene").join(written, "gene", "left")
        marks = marks.select("gene", "through", F.lit(config.settings).alias("settings"), "characters", "sites", F.coalesce("n_columns", F.lit(0)).cast("long").alias("n_columns"), F.lit(run).cast("long").alias("run"))
        marks.coalesce(1).write.mode("append").partitionBy("run").parquet(f"{out}/marks")  # a row per gene
        return n
    finally:
        stale.unpersist()


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: Config | None = None) -> dict[str, int]:
    """Takes what is new in ``source``, waits until it is counted, and renews the columns of its genes."""
    config = config or Config()
    columns = [config.gene, config.sample, config.seq]
    table = spark.read.parquet(source)
    schema = table.select(*[f"`{c}`" for c in columns]).schema
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [source.rstrip("/").rsplit("/", 1)[-1]]:
        source = f"{source[:-1]}[{source[-1]}]"  # a single file: streams take folders, or patterns, of which this matches just the file
    batches: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        _counted(batch, number, out, config)
        batches.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    renewed = _refreshed(spark, out, config)
    total = _latest(spark, out).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_columns"), F.lit(0)), F.coalesce(F.sum("characters"), F.lit(0))).first()
    LOG.info("%d new batches from %s; renewed the columns of %d genes; %s has %d genes, %d columns, %d characters", len(batches), source, renewed, out, *total)
    return {"batches": len(batches), "renewed": renewed, "genes": total[0], "columns": total[1], "characters": total[2]}


def features(spark: SparkSession, out: str) -> DataFrame:
    """The columns (gene, pos, allele, n, total, major) of all genes, each as its last mark has it."""
    found = _table(spark, f"{out}/features", FEATURES)
    return found.join(_latest(spark, out).select("gene", "through", "settings"), ["gene", "through", "settings"], "left_semi").select("gene", "pos", "allele", "n", "total", "major")


if __name__ == "__main__":
    command_line(__doc__, Config, run, ("source", "out", "checkpoint"))
