"""Stateful ingest: genes whose sequences arrive in several files, in any order.

A gene is a file's stem, in whatever folder. Two streams run one after the other, each with its checkpoint: files to a
table of sequences (file sink), and that table's keys, without sequences, to a verdict per gene. Of a sample that comes
again, the last by (modification time, path, place in the file) counts, whenever it arrives; a verdict covers what
counts, so it does not depend on the order of arrival. A file with a fault keeps its gene out.

State is an entry per sample (no sequence): a streaming aggregate keeps what counts of each, in the state store of its task, so that a
gene with most of the samples is dealt over all tasks and no row passes through Python. A micro-batch writes the samples it
touches; a gene's verdict is worked out from the last entry of each of its samples.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DOMAINS, valid_residues
from ..sources import fasta
from .ingest import stream_fasta

SLOTS = 16
FILES_DDL = fasta.DDL
SEQUENCES_DDL = FILES_DDL + ", n int, ok boolean"
VERDICT_DDL = "gene string, sample string, n int, ok boolean, error string"  # sample is null for a gene's faults
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _found(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    """A table, or None before its first batch."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def measured(records: DataFrame, datatype: str = "universal") -> DataFrame:
    """Records with their length and whether all residues are of ``datatype``; typed ones are upper-cased first."""
    if datatype in DOMAINS:
        records = records.withColumn("seq", F.upper("seq"))
    return records.withColumns({"n": F.length("seq"), "ok": valid_residues(F.col("seq"), datatype)})


def judge(spark: SparkSession, sequences: str, verdicts: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes what is new in the table ``sequences`` (SEQUENCES_DDL) and writes what counts of the samples it touches, a partition per
    micro-batch, which a batch that is replayed overwrites."""
    arrived = spark.readStream.schema(SEQUENCES_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(sequences)
    last = F.max(F.struct("modified", "path", "seq_ord", "n", "ok")).alias("last")
    states = arrived.groupBy("gene", "sample").agg(last, F.min("error").alias("error")).select("gene", "sample", "last.n", "last.ok", "error")

    def batch(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # states beyond the heap; a query keeps the settings it starts with
    try:
        query = states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, held) if held is not None else spark.conf.unset(PROVIDER)
    query.awaitTermination()


def gather(spark: SparkSession, folder: str, out: str, checkpoint: str, datatype: str = "universal", slots: int = SLOTS, files_per_batch: int = 1000) -> DataFrame:
    """Takes the files of ``folder`` (a pattern for several) that are new, and returns the genes; ``slots`` is not used any more, as state is dealt by sample."""
    files = stream_fasta(spark, folder, files_per_batch=files_per_batch).select("path", F.unix_micros("modificationTime").alias("modified"), "content")
    records = measured(files.mapInArrow(fasta.records, FILES_DDL), datatype)
    sink = records.writeStream.format("parquet").option("path", f"{out}/sequences").option("checkpointLocation", f"{checkpoint}/files")
    sink.trigger(availableNow=True).start().awaitTermination()
    if _found(spark, f"{out}/sequences", SEQUENCES_DDL) is not None:
        judge(spark, f"{out}/sequences", f"{out}/verdicts", f"{checkpoint}/genes", files_per_batch)
    return genes(spark, out, datatype)


def _verdicts(spark: SparkSession, out: str) -> DataFrame | None:
    return _found(spark, f"{out}/verdicts", VERDICT_DDL + ", batch int")


def genes(spark: SparkSession, out: str, datatype: str = "universal") -> DataFrame:
    """(gene, num_sequences, alignment_length, error): error is null for genes that the catalogue has; length is null with an error."""
    found = _verdicts(spark, out)
    if found is None:
        return spark.createDataFrame([], "gene string, num_sequences long, alignment_length int, error string")
    last = found.groupBy("gene", "sample").agg(F.max(F.struct("batch", "n", "ok")).alias("_last"), F.min("error").alias("_fault")).select("gene", "sample", "_last.n", "_last.ok", "_fault")
    whole = last.groupBy("gene").agg(
        F.count("sample").alias("num_sequences"), F.min("n").alias("_short"), F.max("n").alias("_long"), F.count_if(~F.col("ok")).alias("_foreign"), F.min("_fault").alias("_error"))
    error = (F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_short") != F.col("_long"), "sequences differ in length")
             .when(F.col("_foreign") > 0, f"residues outside {datatype}"))
    return whole.select("gene", "num_sequences", F.when(error.isNull(), F.col("_long")).alias("alignment_length"), error.alias("error"))


def _sound(spark: SparkSession, out: str) -> DataFrame:
    return genes(spark, out).where("error IS NULL").select("gene")


def alignments(spark: SparkSession, out: str, of: DataFrame | None = None) -> DataFrame:
    """What counts of each sample, of sound genes (those of ``of``, a table of genes, if given): gene, sample, path, seq_ord, seq."""
    rows = spark.read.schema(SEQUENCES_DDL).parquet(f"{out}/sequences").where("sample IS NOT NULL")
    if of is not None:
        rows = rows.join(of, "gene", "left_semi")
    rows = rows.join(_sound(spark, out), "gene", "left_semi")
    key = ["modified", "path", "seq_ord"]
    last = rows.groupBy("gene", "sample").agg(F.max(F.struct(*key)).alias("_k")).select("gene", "sample", "_k.*")  # reads no sequence
    return rows.join(last, ["gene", "sample", *key], "left_semi").select("gene", "sample", "path", "seq_ord", "seq")


def compact(spark: SparkSession, out: str) -> None:
    """Renews the partitions of genes whose verdicts changed since the last compaction, with what counts alone.

    The mark is appended after the table is written: a run that breaks off between is done again, with the same result.
    """
    found, marks = _verdicts(spark, out), _found(spark, f"{out}/marks", "batch int")
    if found is None:
        return
    done = marks.agg(F.max("batch").alias("m")).first().m if marks is not None else -1
    upto = found.agg(F.max("batch").alias("m")).first().m
    if upto is None or upto == done:
        return
    touched = found.where((F.col("batch") > done) & (F.col("batch") <= upto)).select("gene").distinct()
    rows = alignments(spark, out, touched)
    rows.repartition("gene", F.pmod(F.xxhash64("sample"), F.lit(SLOTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gene").parquet(f"{out}/compacted")
    spark.range(1).select(F.lit(upto).cast("int").alias("batch")).coalesce(1).write.mode("append").parquet(f"{out}/marks")


def compacted(spark: SparkSession, out: str) -> DataFrame:
    """The table of the last compaction, of genes that are sound now."""
    table = spark.read.schema("sample string, path string, seq_ord int, seq string, gene string").parquet(f"{out}/compacted")
    return table.join(_sound(spark, out), "gene", "left_semi").select("gene", "sample", "path", "seq_ord", "seq")
