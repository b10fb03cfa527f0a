"""FASTA alignments to DataFrames, checks, and the Parquet catalogue."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import DOMAINS, stem, valid_residues
from .scratch import beside, settled

SCHEMA = pa.schema([("gene", pa.string()), ("path", pa.string()), ("modified", pa.int64()), ("sample", pa.string()), ("seq_ord", pa.int32()), ("seq", pa.string()), ("error", pa.string())])
DDL = "gene string, path string, modified long, sample string, seq_ord int, seq string, error string"


#: What lines end in besides the line feed.
BLANK = " \t\r\v\f"
#: Files beyond this are read in splits.
WHOLE = 64 << 20


def parse(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """(identifier, sequence) of each record, and the first fault: data before a header, or no sequence."""
    found: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        line = line.rstrip(BLANK)
        if not line:
            continue
        if line.startswith(">"):
            found.append((line[1:].lstrip(), []))
        elif not found:
            return [], "sequence data before the first header"
        else:
            found[-1][1].append(line)
    return [(name, "".join(parts)) for name, parts in found], None if found else "no sequences"


#: Rows and characters of sequences in a batch that leaves Python.
BATCH_ROWS, BATCH_SIZE = 4096, 4 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(gene, path, modified, sample, seq_ord, seq, error) of files (path, modified, content), one file in memory at a time."""
    for batch in batches:
        for path, modified, content in zip(*batch.columns, strict=True):
            path, modified = path.as_py(), modified.as_py()
            name = path.rsplit("/", 1)[-1]
            gene = name.rpartition(".")[0] or name
            records, error = parse(content.as_py().decode("utf-8", "replace"))
            if not records:
                yield gene, path, modified, None, None, None, error
            for i, (sample, seq) in enumerate(records):
                yield gene, path, modified, sample, i, seq, None


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same as batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[5] or "")
        if size >= BATCH_SIZE or len(held) >= BATCH_ROWS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def read_fasta(spark: SparkSession, paths: str | list[str], whole: int = WHOLE) -> DataFrame:
    """gene (file stem), path, sample (the whole header), seq_ord, seq, error; faulty files give one row with error.

    Files of up to ``whole`` bytes are a row each on their way; larger ones are read in splits, with the same result.
    """
    files = spark.read.format("binaryFile").load(paths)
    large = [r.path for r in files.where(F.col("length") > whole).select("path").collect()]  # the listing; no contents
    small = parsed(files.where(F.col("length") <= whole) if large else files)
    return small.unionByName(_split(spark, large)) if large else small


FRAGMENTS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("sample", pa.string()), ("seq", pa.string())])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits (path, block, value), in order, to their records: k is 1, 2, ... in a split, 0 for what stands before its first
    header; a split without lines of a record has a row with k 0 too."""
    held: list[tuple] = []
    size = 0
    at, k, sample, parts = None, 0, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), FRAGMENTS, strict=True)], schema=FRAGMENTS)
        held.clear()
        return batch

    for batch in batches:
        for path, block, line in zip(*batch.columns, strict=True):
            path, block, line = path.as_py(), block.as_py(), line.as_py()
            path = "file:" + unquote(path).removeprefix("file://") if path.startswith("file:///") else unquote(path)  # as the listing has it
            if (path, block) != at:
                if at is not None:
                    held.append((*at, k, sample, "".join(parts)))
                at, k, sample, parts = (path, block), 0, None, []
            line = line.rstrip(BLANK)
            if line.startswith(">"):
                held.append((*at, k, sample, "".join(parts)))
                size += len(held[-1][-1])
                k, sample, parts = k + 1, line[1:].lstrip(), []
                if size > 4 << 20 or len(held) > 4096:
                    yield flush()
                    size = 0
            elif line:
                parts.append(line)
    if at is not None:
        held.append((*at, k, sample, "".join(parts)))
    if held:
        yield flush()


def _split(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of large files: a record that goes on in the next splits is put together there."""
    lines = spark.read.text(paths, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", "value")
    parts = settled(lines.mapInArrow(_fragments, "path string, block long, k long, sample string, seq string"), "fragments")
    blocks = parts.groupBy("path", "block").agg(F.max("k").alias("_n"))  # a row per split
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(blocks.select("path", "block", before.alias("_before")), ["path", "block"]).select("path", "block", "sample", "seq", (F.col("_before") + F.col("k")).alias("_ord"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq")))  # as many as splits that a record spans
    whole = placed.groupBy("path", "_ord").agg(F.max("sample").alias("sample"), F.array_join(pieces["seq"], "").alias("seq"))
    state = whole.groupBy("path").agg(F.max("_ord").alias("_last"), F.bool_or((F.col("_ord") == 0) & (F.col("seq") != "")).alias("_early"))
    error = F.when(F.col("_early"), F.lit("sequence data before the first header")).when(F.col("_last") == 0, F.lit("no sequences"))
    met = whole.join(state.select("path", error.alias("error")), "path")
    good = met.where("error IS NULL AND _ord > 0").select("path", "sample", (F.col("_ord") - 1).cast("int").alias("seq_ord"), "seq", "error")
    bad = state.select("path", error.alias("error")).where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("sample"), F.lit(None).cast("int").alias("seq_ord"), F.lit(None).cast("string").alias("seq"), "error")
    return good.unionByName(bad).select(stem(F.col("path")).alias("gene"), "path", "sample", "seq_ord", "seq", "error")


def parsed(files: DataFrame) -> DataFrame:
    """The records of files (path, content)."""
    return files.select("path", F.lit(None).cast("long").alias("modified"), "content").mapInArrow(records, DDL).drop("modified")


def checked(records: DataFrame, datatype: str = "universal", strict: bool = True, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(alignments, errors): genes with ragged lengths or foreign residues go to errors as a whole.

    Typed alignments are upper-cased first; universal ones keep their case. Without
    ``strict``, foreign residues become gaps instead. ``domains``: the characters of each datatype.
    """
    if datatype in (domains or DOMAINS):
        records = records.withColumn("seq", F.upper("seq"))
    ok = valid_residues(F.col("seq"), datatype, domains)
    if not strict and datatype == "nucleotide":
        records, ok = records.withColumn("seq", F.regexp_replace("seq", "[^ACGT?-]", "-")), F.lit(True)
    n = F.length("seq")
    state = records.groupBy("gene").agg(
        F.first("error", ignorenulls=True).alias("_error"), F.min(n).alias("_short"), F.max(n).alias("_long"), F.bool_and(F.coalesce(ok, F.lit(True))).alias("_ok"))
    fault = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_short") != F.col("_long"), "sequences differ in length").when(~F.col("_ok"), f"residues outside {datatype}")
    errors = beside(state.select("gene", fault.alias("error")).where("error IS NOT NULL"), "faults")
    return records.drop("error").join(errors.select("gene"), "gene", "left_anti"), errors


def ingest(spark: SparkSession, paths, out: str, datatype: str = "universal", strict: bool = True, force: bool = False) -> DataFrame:
    """Converts alignments to Parquet under ``out`` and returns the catalogue.

    Files whose path, datatype and time of modification are known are skipped, faulty ones too; others, and all
    with ``force``, take the place of what the catalogue has of their path.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "content")
    store(files, out, datatype, strict, force)
    return catalogue(spark, out)


def store(files: DataFrame, out: str, datatype: str = "universal", strict: bool = True, force: bool = False) -> None:
    """Appends new or changed ``files`` (path, modificationTime, content) as a batch; readers take each path's latest.

    What is new is found by path and time alone, without contents; files are parsed once, into a table of the shared folder.
    """
    spark = files.sparkSession
    files = files.select("path", F.unix_micros("modificationTime").alias("modified"), "content")
    known = None if force else _latest(spark, out)
    if known is not None:
        fresh = beside(files.select("path", "modified").join(known.where(F.col("datatype") == datatype).select("path", "modified"), ["path", "modified"], "left_anti").distinct(), "new-files")
        if fresh.isEmpty():
            return
        files = files.join(fresh, ["path", "modified"], "left_semi")
    found = settled(files.mapInArrow(records, DDL), "records")
    good, errors = checked(found, datatype, strict)
    of_batch = [F.lit(time.time_ns()).alias("batch"), F.lit(datatype).alias("datatype")]
    good.select("path", "gene", "sample", "seq_ord", "seq", "modified", *of_batch).write.mode("append").partitionBy("datatype").parquet(f"{out}/alignments")
    faulty = errors.join(found.select("gene", "path", "modified").distinct(), "gene").select("path", "gene", "error", "modified", *of_batch)
    faulty.write.mode("append").partitionBy("datatype").parquet(f"{out}/errors")


def _stored(spark: SparkSession, out: str, part: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{out}/{part}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _latest(spark: SparkSession, out: str) -> DataFrame | None:
    """(path, datatype, modified, batch) of each file's latest batch, good or faulty."""
    parts = [p.select("path", "datatype", "modified", "batch") for p in (_stored(spark, out, "alignments"), _stored(spark, out, "errors")) if p is not None]
    if not parts:
        return None
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("path", "datatype").agg(F.max_by("modified", "batch").alias("modified"), F.max("batch").alias("batch"))


def alignments(spark: SparkSession, out: str, part: str = "alignments") -> DataFrame:
    """What the catalogue has: of each file its latest batch (``part``: alignments or errors)."""
    return spark.read.parquet(f"{out}/{part}").join(_latest(spark, out).select("path", "datatype", "batch"), ["path", "datatype", "batch"], "left_semi")


def catalogue(spark: SparkSession, out: str) -> DataFrame:
    """One row per gene: sequences, length, datatype, source."""
    rows = spark.read.parquet(f"{out}/alignments").select("gene", "path", "datatype", "batch", "seq_ord", "sample", F.length("seq").alias("_n"))  # no sequence is shuffled
    return rows.join(_latest(spark, out).select("path", "datatype", "batch"), ["path", "datatype", "batch"], "left_semi").groupBy("gene", "path", "datatype").agg(
        F.count(F.lit(1)).alias("num_sequences"), F.max("_n").alias("alignment_length"), F.sort_array(F.collect_list(F.struct("seq_ord", "sample")))["sample"].alias("samples"))


def sequence(alignments: DataFrame, gene: str, index: int) -> DataFrame:
    return alignments.where((F.col("gene") == gene) & (F.col("seq_ord") == index)).select("sample", "seq")


def position(alignments: DataFrame, gene: str, pos: int) -> DataFrame:
    """The 0-based column of an alignment."""
    return alignments.where(F.col("gene") == gene).select("sample", "seq_ord", F.expr(f"substring(seq, {int(pos) + 1}, 1)").alias("ch"))


def write_fasta(alignments: DataFrame, path: str) -> None:
    """One folder per gene, records in order of seq_ord within a file."""
    text = F.concat(F.lit(">"), "sample", F.lit("\n"), "seq")
    alignments.repartition("gene").sortWithinPartitions("gene", "seq_ord").select("gene", text.alias("value")).write.partitionBy("gene").text(path)


__all__ = ["alignments", "catalogue", "checked", "ingest", "parse", "position", "read_fasta", "sequence", "stem", "store", "write_fasta"]
