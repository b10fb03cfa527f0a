"""Nearest neighbours by inner product with additive quantisation.

A vector is approximated by the sum of one entry from each of ``books``
full-dimensional codebooks. Codebooks start as k-means of the residuals and are
then refitted jointly by least squares. They are trained on the driver with at
most ``sample`` vectors (documented bound, chosen by hash of vec_id); every
vector is encoded, by beam search, and its code goes to a table in the shared
folder together with the stored norm of its reconstruction, in index blocks.

Queries are taken in blocks of ``query_block``: a block of fixed size is
broadcast, each index block scores it by lookup tables (entry . query, summed
over the code; for the l2 metric less half the stored norm) and reranks the
best ``rerank`` per query exactly, in double precision, on the original vectors. A task keeps each query's
``k`` best over all its index blocks and sends those once; a query's best of all tasks are merged by key.

Edge cases: vectors that are null, zero, or hold null or non-finite components,
and rows with a null vec_id, take no part. An inner product needs equal lengths: vectors of each length are
an index of their own, and a query meets those of its length. Rows that share a vec_id are candidates
each; a query row meets every row but those of its own vec_id, and answers once
per vec_id (the row whose vector is smallest, componentwise). Equal scores go to
the smaller vec_id; equal vectors have equal codes, so ties are kept apart by
vec_id in the shortlist too. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

ENTRIES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def train(x: np.ndarray, books: int, beam: int, refits: int = 1, seed: int = 7) -> np.ndarray:
    """Codebooks (books, ENTRIES, d) of the rows of x."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    residual, made = x.copy(), []
    for _ in range(books):
        centres = _kmeans(residual, ENTRIES, 8, rng)
        residual = residual - centres[((centres**2).sum(1) - 2 * (residual @ centres.T)).argmin(1)]
        made.append(centres)
    codebooks = np.stack(made)
    for _ in range(refits):
        codes = encode(x, codebooks, beam)
        at = codes + np.arange(books) * ENTRIES
        n = books * ENTRIES
        gram = np.zeros((n, n), np.float32)
        right = np.zeros((n, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(right, at[:, i], x)
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1)
        gram[np.diag_indices(n)] += 0.1
        codebooks = np.linalg.solve(gram, right + 0.1 * codebooks.reshape(n, -1)).reshape(books, ENTRIES, -1).astype(np.float32)
    return codebooks


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, books) by beam search: each step keeps the ``beam`` sums with the smallest squared error."""
    books, entries, _ = codebooks.shape
    out = np.empty((len(x), books), np.uint8)
    norms = (codebooks**2).sum(2)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024].astype(np.float32)
        n = len(part)
        residual = part[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        error = (part**2).sum(1)[:, None]
        for m in range(books):
            cost = error[:, :, None] + norms[m] - 2 * (residual @ codebooks[m].T)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            error = np.take_along_axis(flat, best, 1)
            old, entry = best // entries, best % entries
            residual = np.take_along_axis(residual, old[:, :, None], 1) - codebooks[m][entry]
            codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
        out[at : at + n] = codes[np.arange(n), error.argmin(1)]
    return out


def build(vectors: DataFrame, books: int = 8, beam: int = 4, sample: int = 16_384, block: int = 8_192) -> tuple[DataFrame, np.ndarray | None]:
    """Index blocks (block, ids, vectors, codes, norms as packed arrays) of ``usable`` rows, and the codebooks."""
    spark = vectors.sparkSession
    some = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("v").toArrow().column(0).combine_chunks()
    if not len(some):
        return vectors.select(F.lit(b"").alias("ids"), F.lit(b"").alias("vectors"), F.lit(b"").alias("codes"), F.lit(b"").alias("norms")).limit(0), None
    codebooks = train(np.asarray(some.flatten()).reshape(len(some), -1), books, beam)
    shared = spark.sparkContext.broadcast(codebooks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, count = [], [], 0

        def done():
            own, x = np.concatenate(ids), np.concatenate(held)
            codes = encode(x, shared.value, beam)
            approx = sum(shared.value[m][codes[:, m]] for m in range(codes.shape[1]))
            norms = (approx.astype(np.float32) ** 2).sum(1)
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (own, x, codes, norms)], names=["ids", "vectors", "codes", "norms"])

        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for at in range(0, batch.num_rows, block):
                ids.append(np.asarray(batch.column(0))[at : at + block])
                held.append(x[at : at + block])
                count += len(ids[-1])
                if count >= block:
                    yield done()
                    ids, held, count = [], [], 0
        if count:
            yield done()

    return table(vectors.select("vec_id", "v").mapInArrow(pack, "ids binary, vectors binary, codes binary, norms binary"), "index"), codebooks


def _score(queries, codebooks, k: int, rerank: int, metric: str):
    """The k best exact scores of each query over all index blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = queries.value
        tables = np.einsum("qd,med->qme", q.astype(np.float32), codebooks.value, optimize=True)
        best_ids, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
        some = False
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, scores = _best(block, q_ids, q, tables, k, rerank, metric)
                ids, scores = np.concatenate([best_ids, ids], 1), np.concatenate([best, scores], 1)
                order = np.lexsort((ids, -scores))[:, :k]
                best_ids, best, some = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1), True
        if some:
            own, place = np.nonzero(best > -np.inf)
            for at in range(0, len(own), 65_536):
                i, j = own[at : at + 65_536], place[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best_ids[i, j]), pa.array(best[i, j])], names=["query_id", "vec_id", "score"])

    return run


def _best(block: tuple, q_ids: np.ndarray, q: np.ndarray, tables: np.ndarray, k: int, rerank: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores (queries, k) of the best of one index block; -infinity where it has no more."""
    ids_, x_, codes_, norms_ = block
    ids = np.frombuffer(ids_, np.int64)
    order = np.argsort(ids, kind="stable")
    x = np.frombuffer(x_, np.float64).reshape(len(ids), -1)[order]
    codes = np.frombuffer(codes_, np.uint8).reshape(len(ids), -1)[order]
    ids = ids[order]
    half = np.frombuffer(norms_, np.float32)[order] / 2 if metric == "l2" else None
    out_ids, out = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
    for i in range(len(q)):
        approx = tables[i][0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            approx = approx + tables[i][m][codes[:, m]]
        if half is not None:
            approx = approx - half
        approx[ids == q_ids[i]] = -np.inf
        n = min(rerank, len(ids))
        if n < len(ids):
            bound = np.partition(approx, len(ids) - n)[len(ids) - n]
            over = np.flatnonzero(approx > bound)
            short = np.concatenate([over, np.flatnonzero(approx == bound)[: n - len(over)]])  # ids ascend: ties to the smaller
        else:
            short = np.arange(len(ids))
        short = short[ids[short] != q_ids[i]]
        exact = inner(x[short], q[i]) if half is None else -((x[short] - q[i]) ** 2).sum(1)
        first = np.lexsort((ids[short], -exact))[:k]
        out_ids[i, : len(first)], out[i, : len(first)] = ids[short][first], exact[first]
    return out_ids, out


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 400, query_block: int = 8_192, metric: str = "inner", **index) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` (vec_id, v) among ``vectors``.

    ``metric``: inner (inner product) or l2 (minus the squared distance).
    """
    spark = vectors.sparkSession
    blocks, codebooks = build(vectors, **index)
    ddl = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], ddl)
    if codebooks is not None:
        shared = spark.sparkContext.broadcast(codebooks)
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
        parts = -(-queries.count() // query_block)
        for part in range(parts):
            own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
            if own.num_rows:
                q = np.asarray(own.column(1).combine_chunks().flatten()).reshape(own.num_rows, -1)
                given = spark.sparkContext.broadcast((np.asarray(own.column(0)), q))
                some = blocks.mapInArrow(_score(given, shared, k, rerank, metric), ddl)
                found = found.unionByName(table(some, "found") if parts > 1 else some)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    v = table(usable(embeddings), "vectors")
    lengths = [r[0] for r in v.select(F.size("v")).distinct().collect()]  # usually one
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in sorted(lengths):
        own = v.where(F.size("v") == n)
        found = found.unionByName(search(own, own.where("vec_id % 20 = 0")))
    return found
