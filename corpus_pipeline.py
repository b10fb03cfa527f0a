"""A training-data pipeline: five stages over ``documents``, each one operator.

Each stage's result is written as Parquet in the shared folder and reread as the
next one's input; it works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import bpe, linededup, minhash, mixing, toxicity
from sitewise.llm._common import read_table, table

#: (name, function of (spark, docs, sf_dir)): toxic documents go; repeated lines go; one document of
#: each near-duplicate group stays; sources are mixed to their weights; the mix is encoded.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("minhash_near_dedup", minhash.stage),
    ("source_mix", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: Classification, MinHash and pseudorandom draws have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
