"""The driver tables seen as alignments, hypotheses, numeric tables and weights; whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows grow in the next step (texts to characters). A small one, in
    few files, is dealt to all cores first; one with many splits is read as it lies."""
    table = read(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if len(table.inputFiles()) < cores else table


def documents_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene: language, sample: doc_id, seq: the text; y from quality, tox from toxic."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("y"))
    return read_spread(spark, sf_dir, "documents", "doc_id", "lang", "text").join(labels, "doc_id").select(F.col("lang").alias("gene"), F.col("doc_id").alias("sample"), "y", F.col("text").alias("seq"))


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, ord, y): -1, 0 (quality and toxic), 1."""
    y = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 0.0).when(F.col("quality") == 1, 1.0).otherwise(-1.0)
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample"), F.col("doc_id").alias("ord"), y.alias("y"))


def turns_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene: turn, sample: conversation, seq: what is said."""
    return read(spark, sf_dir, "conversations").select(F.col("turn").cast("string").alias("gene"), F.col("conv_id").alias("sample"), F.col("text").alias("seq"))


def roles_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene: role, sample: conversation, several sequences each, in order of turns."""
    return read(spark, sf_dir, "conversations").select(F.col("role").alias("gene"), F.col("conv_id").alias("sample"), F.col("turn").alias("seq_ord"), F.col("text").alias("seq"))


def line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of two genes: return flag and line status of an order's lines; sample: order."""
    lines = read(spark, sf_dir, "lineitem")
    part = lambda gene, col: lines.select(F.lit(gene).alias("gene"), F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("pos"), F.col(col).alias("ch"))
    return part("flag", "l_returnflag").unionByName(part("status", "l_linestatus"))


def order_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, ord, y): 1 for urgent and high orders, 0 for medium ones, else -1."""
    first = F.substring("o_orderpriority", 1, 1)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderkey").alias("ord"), F.when(first.isin("1", "2"), 1.0).when(first == "3", 0.0).otherwise(-1.0).alias("y"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col_id, gene, sample, value): features of the vectors, eight to a gene."""
    some = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("col_id", "value"))
    return some.select(F.col("col_id").cast("long").alias("col_id"), F.format_string("g%02d", F.floor(F.col("col_id") / 8)).alias("gene"), "sample", F.col("value").cast("double").alias("value"))


def embedding_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("vec_id").alias("ord"), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y"))


def made_weights(indexed: DataFrame) -> DataFrame:
    """Weights for oracles: a fixed function of col_id, with zeros."""
    k = F.col("col_id")
    return indexed.withColumn("w", F.when(k % 5 == 0, 0.0).otherwise(((k * 37) % 101 - 50) / 100.0))


def run_weights(indexed: DataFrame, runs: int = 5) -> DataFrame:
    """Weights of several runs: a fixed function of run and col_id, with zeros."""
    k, r = F.col("col_id"), F.col("run")
    every = indexed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return every.withColumn("w", F.when((k + r) % 4 == 0, 0.0).otherwise(((k * 37 + r * 17) % 101 - 50) / 100.0))
