"""Line dedup with two Bloom filters and exact confirmation.

1. Each batch of documents sends the 64-bit hashes of its long lines, each once
   (with a mark if two of its documents hold it), to the slice of the hash
   space that owns them. A slice streams through a *once-seen* Bloom filter; a
   hash found there goes to the slice's *twice-seen* filter. A slice's filters have a bounded size
   (``SLICE_BITS``): more text makes more slices, not larger ones.
2. Lines that the twice-seen filters suspect, and only those, go on. Up to ``few`` twice-seen hashes,
   the filters are folded to ``twice_bits`` in all (a fixed 16 MB) and broadcast, and a line's text goes
   on at once. Beyond, the filters stay where they are: lines go to their slice as hashes (a slice's filter is there
   ``SALTS`` times, for the lines that a third of all documents hold), and the documents that hold
   suspects meet them by (doc_id, text hash).
3. Exact counts and the keeper (the largest doc_id) are taken per
   line text, pre-aggregated before the shuffle, so a line that a third of all
   documents hold costs one row per task.
4. The positions that a document loses return to it by (doc_id, text hash).

A filter too small for the data only makes more suspects; results stay exact.

Edge cases: a null or empty text is one empty line, and the kept text of a null
is empty. Each row is a document, repeated rows too; all rows with the largest
doc_id that holds a line keep it; a null doc_id is smaller than any other.
Extra columns pass through; one named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, emit, table

SLICE_BITS = 1 << 22
PROBES = 4
SALTS = 32


@dataclass(frozen=True)
class Layout:
    """2 ** ``power`` slices, and the bits of a slice's filters."""

    power: int
    once: int
    twice: int

    @classmethod
    def of(cls, lines: int) -> Layout:
        """For at most ``lines`` lines: 16 bits a line in the once-seen filters, 4 in the twice-seen ones."""
        power = max(10, (16 * lines // SLICE_BITS).bit_length())
        once = 1 << max(10, (16 * lines >> power).bit_length())
        return cls(power, once, max(1024, once // 4))

    def slices(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.power)).astype(np.int64)


def long_lines(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines with keys of ``min_chars`` code points or more."""
    for i, line in enumerate((text or b"").lower().split(b"\n")):  # bytes.lower() changes A-Z only
        key = line.strip(SPACES)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield i, key


def _hashes(min_chars: int, layout: Layout):
    schema = pa.schema([("slice", pa.int64()), ("hash", pa.int64()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0):
                if buffer := text.as_buffer():
                    found += {xxhash.xxh3_64_intdigest(k) for _, k in long_lines(buffer.to_pybytes(), min_chars)}
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(layout.slices(h)), pa.array(h.view(np.int64)), pa.array(n > 1)], schema=schema)

    return run


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions for each hash in a filter of ``bits`` (a power of two). Those of a smaller filter are the
    remainders of those of a larger one, so filters fold."""
    low, high = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8)).view(bool)


def _filters(layout: Layout):
    """Per slice (input sorted by slice) that saw a hash twice: how many it saw, and its twice-seen filter."""
    schema = pa.schema([("slice", pa.int64()), ("seen", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, once, twice = None, 0, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([count], pa.int64()), pa.array([_packed(twice)], pa.binary())], schema=schema)

        for batch in batches:
            slices, h, marked = (np.asarray(c) for c in batch.columns)
            h = h.view(np.uint64)
            cuts = np.flatnonzero(np.diff(slices)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(slices)], strict=True):
                if a == b:
                    continue
                if slices[a] != at:
                    if count:
                        yield done()
                    at, count, once, twice = int(slices[a]), 0, np.zeros(layout.once, bool), np.zeros(layout.twice, bool)
                new, where, n = np.unique(h[a:b], return_inverse=True, return_counts=True)
                mark = np.zeros(len(new), bool)
                np.logical_or.at(mark, where, marked[a:b])
                p = probes(new, layout.once)
                q = probes(new, layout.twice)
                seen = (mark | (n > 1) | once[p].all(axis=1)) & ~twice[q].all(axis=1)
                twice[q[seen]] = True
                count += int(seen.sum())
                once[p] = True
        if count:
            yield done()

    return run


def twice_seen(docs: DataFrame, min_chars: int = 40) -> tuple[Layout, DataFrame]:
    """The layout, and a table (slice, seen, bits) of the twice-seen filters."""
    text = docs.select(F.col("text").cast("binary"))
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout.of(total // (min_chars + 1) + 1)
    rows = text.mapInArrow(_hashes(min_chars, layout), "slice long, hash long, twice boolean").repartition("slice").sortWithinPartitions("slice")
    return layout, table(rows.mapInArrow(_filters(layout), "slice long, seen long, bits binary"), "twice-seen")


def folded(filters: DataFrame, layout: Layout, twice_bits: int) -> np.ndarray:
    """All filters folded to ``twice_bits`` together, as a packed array."""
    part = twice_bits >> layout.power

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_packed(b if part > len(b) else b.reshape(-1, part).any(axis=0)) for b in (_unpacked(v.as_py()) for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["slice", "bits"])

    out = np.zeros(twice_bits // 8, np.uint8)
    for row in filters.select("slice", "bits").mapInArrow(fold, "slice long, bits binary").toLocalIterator():
        own = zlib.decompress(row["bits"])
        out[row["slice"] * part // 8 : row["slice"] * part // 8 + len(own)] = np.frombuffer(own, np.uint8)
    return out


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int):
    """(doc_id, text_hash, rest of the row, positions by key, hashes) of each text with long lines."""
    for batch in batches:
        for doc, code, text, *rest in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
            where: dict[bytes, list[int]] = {}
            buffer = text.as_buffer()
            for i, key in long_lines(buffer.to_pybytes() if buffer else b"", min_chars):
                where.setdefault(key, []).append(i)
            if where:
                yield doc, code, rest, where, np.array([xxhash.xxh3_64_intdigest(k) for k in where], np.uint64)


SUSPECT = "doc_id long, text_hash long, key string, positions array<int>"
SUSPECT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.string()), ("positions", pa.list_(pa.int32()))])


def _suspects_here(shared, min_chars: int, layout: Layout, twice_bits: int):
    """Suspected lines, by the broadcast filter."""
    space = twice_bits >> layout.power
    part = min(space, layout.twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value

        def rows():
            for doc, code, _, where, h in _keys(batches, min_chars):
                p = probes(h, part) + layout.slices(h)[:, None] * space
                hit = ((packed[p >> 3] >> (7 - (p & 7))) & 1).all(axis=1)
                yield from ((doc, code, key.decode("utf-8", "replace"), where[key]) for key, yes in zip(where, hit, strict=True) if yes)

        yield from emit(rows(), SUSPECT_SCHEMA, lambda r: len(r[2]))

    return run


def _references(min_chars: int, layout: Layout):
    """(slice, salt, hash, doc_id, text_hash) of each text's long lines."""
    names = ["slice", "salt", "hash", "doc_id", "text_hash"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, code, _, _, h in _keys(batches, min_chars):
            n = len(h)
            salt = np.full(n, code % SALTS)
            columns = [pa.array(layout.slices(h)), pa.array(salt), pa.array(h.view(np.int64)), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, code))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _probed(layout: Layout):
    """References that their slice's filter suspects (input sorted by slice and salt, the filter first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, twice = None, None
        for batch in batches:
            slices = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(slices)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(slices)], strict=True):
                if a == b:
                    continue
                if slices[a] != at:
                    at, twice = slices[a], None
                own = batch.slice(a, b - a)
                bits = own.column(5).drop_null()
                if len(bits):
                    twice = _unpacked(bits[0].as_py())
                if twice is not None:
                    own = own.filter(own.column(2).is_valid())
                    hit = twice[probes(np.asarray(own.column(2)).view(np.uint64), layout.twice)].all(axis=1)
                    yield own.select(["hash", "doc_id", "text_hash"]).filter(pa.array(hit))

    return run


def _chosen(min_chars: int):
    """The lines of texts whose hashes are in the row's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, code, (wanted,), where, h in _keys(batches, min_chars):
                hit = np.isin(h.view(np.int64), np.array(wanted, np.int64))
                yield from ((doc, code, key.decode("utf-8", "replace"), where[key]) for key, yes in zip(where, hit, strict=True) if yes)

        yield from emit(rows(), SUSPECT_SCHEMA, lambda r: len(r[2]))

    return run


def suspected(docs: DataFrame, min_chars: int = 40, twice_bits: int = 1 << 27, few: int = 1 << 24) -> DataFrame:
    """(doc_id, text_hash, key, positions): the lines that the twice-seen filters suspect."""
    spark = docs.sparkSession
    layout, filters = twice_seen(docs, min_chars)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    if (filters.agg(F.sum("seen")).first()[0] or 0) <= few and twice_bits >> layout.power >= 8:
        shared = spark.sparkContext.broadcast(folded(filters, layout, twice_bits))
        return rows.mapInArrow(_suspects_here(shared, min_chars, layout, twice_bits), SUSPECT)
    lines = rows.mapInArrow(_references(min_chars, layout), "slice long, salt long, hash long, doc_id long, text_hash long").withColumn("bits", F.lit(None).cast("binary"))
    everywhere = filters.select("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), *[F.lit(None).cast("long").alias(c) for c in ("hash", "doc_id", "text_hash")], "bits")
    met = everywhere.unionByName(lines).repartition("slice", "salt").sortWithinPartitions("slice", "salt", F.col("bits").isNull())
    hits = met.mapInArrow(_probed(layout), "hash long, doc_id long, text_hash long")
    held = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("hash").alias("hashes"))  # as many as a text has lines
    own = rows.join(held, rows["doc_id"].eqNullSafe(F.col("_doc")) & rows["text_hash"].eqNullSafe(F.col("_hash"))).select("doc_id", "text_hash", "text", "hashes")
    return own.mapInArrow(_chosen(min_chars), SUSPECT)


def lines_to_drop(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, **filters: int) -> DataFrame:
    """(doc_id, text_hash, dropped array<int>): positions of the lines each document loses."""
    suspects = table(suspected(docs, min_chars, **filters), "suspects")
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    repeated = table(repeated.drop("_n"), "repeated")
    lost = suspects.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: bool = True, **filters: int) -> DataFrame:
    """``docs`` with the kept text in ``text``, and with ``counts`` n_lines (before) and n_dropped; filters: twice_bits, few."""
    drops = lines_to_drop(docs, min_chars, min_docs, **filters).toDF("_sw_doc", "_sw_hash", "_sw_dropped")
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    joined = docs.join(drops, F.xxhash64(docs["text"]).eqNullSafe(drops["_sw_hash"]) & docs["doc_id"].eqNullSafe(drops["_sw_doc"]), "left")
    text = F.coalesce("text", F.lit(""))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_sw_dropped", i)), "\n")
    made = {"text": F.when(F.col("_sw_dropped").isNull(), text).otherwise(kept)}
    if counts:
        made["n_lines"] = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
        made["n_dropped"] = F.coalesce(F.size("_sw_dropped"), F.lit(0)).cast("long")
    return joined.withColumns(made).drop("_sw_doc", "_sw_hash", "_sw_dropped")


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.keeper AS lost FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
