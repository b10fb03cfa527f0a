"""Ranked lexical search over document-sharded postings with integer impacts.

Terms are maximal runs of digits, ASCII letters and characters from U+0080, A-Z lower-cased, hashed to 64 bits.

Index. Each task packs its documents into shards of bounded bytes (a longer text is a shard of its own, whole): the sorted
hashes of the shard's terms, CSR offsets, and per posting the document's place in the shard and its impact
(1000000000 * tf) div (1000 * tf + 12 * m). Impacts need only N and L, two sums taken first; the index is written once as a
table, a row per shard. It holds every document, and no term's postings ever meet: a word of all documents is one run per shard.

Search. Query items come in blocks of bounded count and bytes. A pass over the terms of the shards gives the df of the block's
terms (a row per term and task before the shuffle), hence their weights; a second one scores: item by item and term by term,
weight times impact is added to a dense accumulator of the shard's documents; argpartition finds the k-th best score, all documents
from that score on are ordered by score and doc_id, and k stay. A task keeps the best k of each item over its shards; Spark
cuts the tasks' lists to the best k of all.

Edge cases: a null or empty text has no terms and is never found, a null or empty item finds nothing. Each row is a document or
an item, repeated rows too: copies of a document are ranked one after the other, rows of the same item_id have a list each. A null doc_id
comes after the others of its score. Fewer than k documents with a score above 0: all of them. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import emit, table
from ._tokens import IN_TERM, slices, token_hashes

#: The same class as an expression over characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, SHARD_DOCS = 8 << 20, 16_384
BLOCK_ITEMS, BLOCK_BYTES = 2048, 4 << 20
NULL_ID = np.iinfo(np.int64).max  # ordered last; told from a doc_id of that value by a flag
INDEX = "terms binary, starts binary, places binary, impacts binary, ids array<long>"


@dataclass
class Index:
    """The table of shards, the number of documents with a term (N) and of all terms with repeats (L)."""

    shards: DataFrame
    documents: int
    length: int


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _shard(ids: list, texts: list[bytes], documents: int, length: int) -> tuple | None:
    tokens, counts = token_hashes(texts, IN_TERM)
    if not len(tokens):
        return None
    terms, of = np.unique(tokens, return_inverse=True)
    pair, tf = np.unique(of * np.int64(len(ids)) + np.repeat(np.arange(len(ids)), counts), return_counts=True)
    place = pair % len(ids)
    m = 75 + (25 * counts * documents) // max(1, length)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
    starts = np.searchsorted(pair, np.arange(len(terms) + 1) * np.int64(len(ids)))
    return terms.tobytes(), starts.astype(np.uint32).tobytes(), place.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes(), impact.astype(np.uint32).tobytes(), ids


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all rows of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    documents, length = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = pa.schema([("terms", pa.binary()), ("starts", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((i, _encoded(t.as_py())) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        some = (rows[at : at + shard_docs] for rows in slices(every, 1, shard_bytes) for at in range(0, len(rows), shard_docs))
        found = (_shard([r[0] for r in rows], [r[1] for r in rows], documents, length) for rows in some)
        yield from emit((s for s in found if s), schema, lambda s: sum(map(len, s[:4])))

    return Index(table(docs.mapInArrow(run, INDEX), "postings"), documents, length)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Query items (item_id, text), as they come from Spark partition by partition."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, _encoded(r.text)))
        size += len(held[-1][1])
        if len(held) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores above 0, best first, ties to smaller ids, nulls last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], nulls[some], -scores[some]))][:k]


def document_frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the distinct, sorted ``terms`` of a block occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1), strict=True):
                own, starts = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(starts.as_py(), np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                sums += np.where(own[at] == terms, starts[at + 1] - starts[at], 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.shards.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
        out[r.term] = r.df
    return out


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark = items.sparkSession
    results = spark.createDataFrame([], "item_id long, item int, doc_id long, score long")
    first = 0
    for block in _blocks(items):
        results = results.unionByName(_search(index, block, first, k))
        first += len(block)
    # of each item k rows a task, cut again before they are shuffled
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search(index: Index, block: list[tuple], first: int, k: int) -> DataFrame:
    hashes, counts = token_hashes([t for _, t in block], IN_TERM)
    terms, of = np.unique(hashes, return_inverse=True)
    df = document_frequencies(index, terms)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    ends = np.cumsum(counts)
    wanted = []  # per item: places in terms, weight times repeats
    for a, b in zip(ends - counts, ends, strict=True):
        own, times = np.unique(of[a:b], return_counts=True)
        some = (df[own] > 0) & (weight[own] > 0)
        wanted.append((own[some], weight[own][some] * times[some]))
    names = [i for i, _ in block]
    schema = pa.schema([("item_id", pa.int64()), ("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple | None] = [None] * len(wanted)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                own, starts = np.frombuffer(row[0].as_py(), np.uint64), np.frombuffer(row[1].as_py(), np.uint32)
                ids = row[4].values
                nulls = np.asarray(ids.is_null())
                ids = np.asarray(ids.fill_null(NULL_ID))
                places = np.frombuffer(row[2].as_py(), np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                impacts = np.frombuffer(row[3].as_py(), np.uint32)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                at = np.where(own[at] == terms, at, -1)
                sums = np.zeros(len(ids), np.int64)
                for i, (of_item, by) in enumerate(wanted):
                    here = at[of_item]
                    if not (here >= 0).any():
                        continue
                    sums[:] = 0
                    for t, w in zip(here[here >= 0].tolist(), by[here >= 0].tolist(), strict=True):
                        some = slice(starts[t], starts[t + 1])  # a document once per term
                        sums[places[some]] += w * impacts[some].astype(np.int64)
                    top = best(sums, ids, nulls, k)
                    found = sums[top], ids[top], nulls[top]
                    if kept[i] is not None:
                        found = tuple(np.concatenate(p) for p in zip(kept[i], found, strict=True))
                        found = tuple(p[best(*found, k)] for p in found) if len(found[0]) > k else found
                    kept[i] = found
        rows = ((names[i], first + i, None if null else doc, score) for i, f in enumerate(kept) if f for score, doc, null in zip(*(p.tolist() for p in f), strict=True))
        yield from emit(rows, schema)

    return index.shards.mapInArrow(run, "item_id long, item int, doc_id long, score long")


def op12(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build(docs), items)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms FROM documents),
n AS (SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
qt AS (SELECT i, item_id, term, count(*) AS times FROM q GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM n) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // len))))::BIGINT AS score
      FROM qt JOIN p USING (term) JOIN w USING (term), s GROUP BY i, item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
