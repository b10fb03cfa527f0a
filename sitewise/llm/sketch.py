"""Bottom-k sketches of shingle hashes.

A sketch holds the k smallest 40-bit hashes of a text's distinct shingles and
is read off as base64. Sketches merge (the k smallest of both), so parts of a
corpus can be sketched apart. From two sketches come estimates of resemblance
and containment, from one the number of distinct shingles.

The edited text of a document takes the start of the next document in
descending doc_id order. Documents are dealt to ranges of doc_id whose upper
edges are quantiles that exist in the data; each range's first document also
goes, as a halo row, to the range before it. So each text shuffles once, every
range is a sorted stream that holds one document at a time, and no task sees
the whole order.

Edge cases: a null or empty text, or one of white space, has an empty sketch
(empty string); two empty sketches are alike (1), an empty and another are not
(0). Ties of doc_id are ordered by text. A document without doc_id has no place
in the order and is its own next, as is a single document. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import emit
from ._shingle import shingle_hashes

K = 128
BITS = 40


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted k smallest of the distinct hashes, cut to their high BITS bits."""
    return np.unique(shingles[:k] >> np.uint64(64 - BITS))  # input is sorted


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def pack(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (3, 0))).reshape(-1).view(">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A & B| / |A | B|: the share, among the k smallest of the union, that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = np.concatenate([[True], ~twice])
    last = np.flatnonzero(union)[k] if union.sum() > k else len(both)
    return float(twice[: last - 1].sum() / min(k, union.sum()))


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact while the sketch is not full."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[k - 1]) / float(1 << BITS))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A & B| / |A|."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct(merge(a, b, k), k)
    return min(1.0, r * union / distinct(a, k))


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many first ones of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _halos(edges: np.ndarray):
    """(bucket, halo, doc_id, text): each row in its range, first rows of a range also in the range before."""
    n = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            at = np.minimum(np.searchsorted(edges, ids), n - 1)
            bucket = np.where(none, np.arange(len(ids)) % n, n - 1 - at)  # 0 holds the largest ids
            halo = np.flatnonzero(~none & (edges[at] == ids))
            before = (bucket[halo] - 1) % n  # after the last comes the first
            rows = pa.array(np.concatenate([np.arange(len(ids)), halo]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([bucket, before]).astype(np.int32)), pa.array(np.arange(len(rows)) >= len(ids)),
                batch.column(0).take(rows), batch.column(1).take(rows)], names=["bucket", "halo", "doc_id", "text"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) of each row that is no halo, from rows sorted by bucket, halo, doc_id descending, text."""
    held = None  # (bucket, doc_id, text) of a row whose next is yet to come
    for batch in batches:
        for bucket, halo, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if doc is None:
                yield None, text, text
                continue
            if held is not None and held[0] == bucket:
                yield held[1], held[2], text
            held = None if halo else (bucket, doc, text)


def _fingerprints(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]):
        stream = _pairs(batches)
        while part := list(islice(stream, 128)):
            made = [edited(text, following).encode() for _, text, following in part]
            texts = [text.encode() for _, text, _ in part] + made
            after = []
            for i, (_, _, following) in enumerate(part):
                if i + 1 < len(part) and part[i + 1][1] is following:
                    after.append(i + 1)
                else:
                    after.append(len(texts))
                    texts.append(following.encode())
            found = [sketch(s, k) for s in shingle_hashes(texts)]
            for i, (doc, text, _) in enumerate(part):
                own, new = found[i], found[len(part) + i]
                yield doc, len(text), hashlib.sha256(made[i]).hexdigest(), pack(own), pack(new), resemblance(own, new, k), resemblance(own, found[after[i]], k)

    return lambda batches: emit(rows(batches), schema, lambda r: 2048)


def _edges(known: DataFrame, ranges: int) -> np.ndarray:
    """Ascending doc_ids that exist, each the largest of a range of about equal count; at most ``ranges``."""
    share = [i / ranges for i in range(1, ranges + 1)]
    points = np.unique(known.agg(F.percentile_approx("doc_id", share, min(10 * ranges, 1_000_000))).first()[0])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(points, np.asarray(batch.column(0))).astype(np.int32)), batch.column(0)], names=["range", "doc_id"])

    tops = known.select("doc_id").mapInArrow(ranged, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("top"))
    return np.sort(np.array([r["top"] for r in tops.collect()], np.int64))


def fingerprints(docs: DataFrame, k: int = K, rows_per_range: int = 20_000) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    known = docs.where("doc_id IS NOT NULL")
    count = known.count()
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows_per_range))
    edges = _edges(known, ranges) if count else np.zeros(1, np.int64)
    rows = docs.select("doc_id", "text").mapInArrow(_halos(edges), "bucket int, halo boolean, doc_id long, text string")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_fingerprints(k), ddl)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
