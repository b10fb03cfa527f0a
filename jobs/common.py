"""What both jobs share: configuration through Spark's readers, the alignment view of a table, the command line."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_config(kind, spark: SparkSession, path: str | None):
    """The dataclass ``kind`` with the settings of a small JSON file, wherever Spark can read it; ValueError for unknown ones."""
    if not path:
        return kind()
    given = spark.read.json(path, multiLine=True).first()
    given = {} if given is None else {k: v for k, v in given.asDict().items() if not k.startswith("_") and v is not None}
    if unknown := set(given) - {f.name for f in dataclasses.fields(kind)}:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**given)


def aligned(table: DataFrame, gene: str, sample: str, seq: str, no_gene: str) -> DataFrame:
    """(gene, sample, seq) of a table; a null or empty gene is called ``no_gene``, as neither can name a partition."""
    named = F.coalesce(F.nullif(F.col(f"`{gene}`"), F.lit("")), F.lit(no_gene))
    return table.select(named.alias("gene"), F.col(f"`{sample}`").alias("sample"), F.col(f"`{seq}`").alias("seq"))


def command_line(doc: str, kind, run, names: tuple[str, ...]) -> None:
    """Parses plain paths and the configuration file, makes a session, runs, and ends it."""
    parser = argparse.ArgumentParser(description=doc.split("\n")[0])
    for name in names:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON file of settings")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *[getattr(given, n) for n in names], load_config(kind, spark, given.config))
    finally:
        spark.stop()
