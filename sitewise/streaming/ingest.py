"""Streaming ingest of alignment files into the Parquet catalogue.

Stateless: each micro-batch parses its new files, sets faulty genes apart and
appends the others. The checkpoint gives each file exactly once to a batch; a
batch that is replayed skips what the catalogue has by path and modification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import fasta


def stream_fasta(spark: SparkSession, folder: str, pattern: str = "*.{fas,fasta,fa,faa}", files_per_batch: int = 1000) -> DataFrame:
    """A streaming table of (path, content) of new alignment files."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "modificationTime", "content"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, datatype: str = "universal", strict: bool = True, once: bool = True) -> StreamingQuery:
    """Ingests what is in ``folder`` (``once``), or goes on with what arrives."""
    def batch(files: DataFrame, _: int) -> None:
        fasta.store(files, out, datatype, strict)

    writer = stream_fasta(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
