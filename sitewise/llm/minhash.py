"""MinHash near-dedup: exact links at a Jaccard threshold, found by banded minima.

1. One pass over the texts gives each document its shingle set's size, a digest
   of the set, ``bands`` band keys of ``rows`` universal-hash minima each, and a
   signature (the low byte of every minimum).
2. Documents with equal sets fold into the one with the smallest doc_id.
3. Per band key, members get an edge to the smallest, first within each batch,
   so that a key held by a third of all documents sends one row per batch. These
   edges, a number linear in the documents, are confirmed on full sets; the confirmed ones'
   components (large-star/small-star) settle most keys.
4. A key is open if it has three members or more and they lie in several components: only there
   can be links that no edge has tested. Open keys with the same members count once. Their documents
   are searched exactly, by key or, where that is less work, by components of open keys: in blocks of ``block``
   documents, pairs of blocks meet in one streaming task each. Signatures rule
   out pairs far under the threshold, as do components already joined; the others are confirmed on their full
   sets, all pairs of a block at once. Only a spanning forest of the confirmed
   links leaves a task, so a large group of near copies gives few rows.
5. The components of all confirmed links are the result.

With 40 bands of 8, a pair at exactly 0.85 is missed with probability 3e-6;
signatures are used with a margin of over six standard deviations.

Edge cases: a null or empty text, or one of white space, has an empty set and
no links. Rows that share a doc_id get the component of their own set each; sets
with the same smallest doc_id are one node. A null doc_id takes no part:
component_id null, kept. ``dedup`` takes every row as a document, whatever its
doc_id. Extra columns pass through in ``dedup``; n_shingles, component_id and kept replace columns of those names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_table, emit, key_extreme, salted, table
from ._shingle import mix, shingle_hashes
from .components import connected_components

BANDS, ROWS = 40, 8
BLOCK = 512


def universal(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (odd multiplier, addend) of x -> a*x + b modulo 2**32."""
    both = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(32)
    return (both[:n] | np.uint64(1)).astype(np.uint32), both[n:].astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        h = np.multiply.outer(a, x[at : at + 512])
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _profiles(bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_digest", pa.binary()), ("signature", pa.binary()), ("keys", pa.list_(pa.int64()))])
    a, b = universal(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        names = mix(np.arange(1, bands + 1, dtype=np.uint64))

        def made():
            for batch in batches:
                ids, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                texts = (t.as_py() or b"" for t in batch.column(2))
                for doc, code, s in zip(ids, codes, shingle_hashes(texts), strict=True):
                    if not len(s):
                        yield doc, code, 0, b"", None, None
                        continue
                    low = minima(s, a, b)
                    keys = mix((low.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + names)
                    yield doc, code, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (low & 0xFF).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()

        yield from emit(made(), schema, lambda r: 700)

    return run


def profiles(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    cols = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(_profiles(bands, rows), "doc_id long, text_hash long, n long, set_digest binary, signature binary, keys array<long>")


def _forest(groups: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each run of equal (task, i, j), as a spanning forest."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def rows():
        key, held = None, []
        for batch in groups:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for n, (*own, side, doc) in enumerate(zip(*cols, strict=True)):
                if own != key:
                    yield from _links(held, percent)
                    key, held = own, []
                held.append((side, doc, batch.column(6)[n].as_py(), batch.column(7)[n].as_py(), batch.column(5)[n].as_py()))
        yield from _links(held, percent)

    yield from emit(rows(), schema)


def _links(members: list[tuple[int, int, bytes, bytes, int]], percent: int) -> Iterator[tuple[int, int]]:
    """members: (side, doc, signature, set, part). Pairs lie within side 0, or across 0 and 1 if both are there;
    those of one part (a component already joined) are passed over."""
    if len(members) < 2:
        return
    members.sort(key=lambda m: m[:2])
    docs = [m[1] for m in members]
    first = sum(m[0] == 0 for m in members)
    n = len(members)
    signatures = np.frombuffer(b"".join(m[2] for m in members), np.uint8).reshape(n, -1)
    sets = [np.frombuffer(m[3], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(n), np.arange(n)) if first == n else (np.arange(first), np.arange(first, n))
    near = np.zeros((len(left), len(right)), bool)
    width = signatures.shape[1]
    floor = percent / 100 - 6.5 * np.sqrt(percent / 100 * (1 - percent / 100) / width)
    for k, i in enumerate(left):
        near[k] = (signatures[right] == signatures[i]).sum(axis=1) >= floor * width
    part = np.array([m[4] for m in members])
    near &= part[left][:, None] != part[right][None, :]
    near &= 100 * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= percent * np.maximum(sizes[left][:, None], sizes[right][None, :])
    if first == n:
        near = np.triu(near, 1)
    if not near.any():
        return
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    common = _intersections([sets[left[r]] for r in rows], [sets[right[c]] for c in cols])
    union = sizes[left[rows]][:, None] + sizes[right[cols]][None, :] - common
    linked = near[np.ix_(rows, cols)] & (100 * common >= percent * union)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, c in np.argwhere(linked):
        i, j = int(left[rows[r]]), int(right[cols[c]])
        x, y = root(i), root(j)
        if x != y:
            parent[x] = y
            yield docs[i], docs[j]


def _intersections(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all sets of ``a`` with all of ``b``, by products of incidence blocks."""
    va, vb = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    words = np.intersect1d(va, vb, assume_unique=True)

    def places(sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        at = np.searchsorted(words, every)
        at[at == len(words)] = 0
        ok = words[at] == every if len(words) else np.zeros(len(every), bool)
        at, owner = at[ok], owner[ok]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    out = np.zeros((len(a), len(b)), np.int64)
    (xa, oa), (xb, ob) = places(a), places(b)
    for lo in range(0, len(words), step):
        hi = min(lo + step, len(words))
        blocks = []
        for x, o, k in ((xa, oa, len(a)), (xb, ob, len(b))):
            s, e = np.searchsorted(x, [lo, hi])
            block = np.zeros((k, hi - lo), np.float32)
            block[o[s:e], x[s:e] - lo] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, to): a batch's smallest document of each band key, and its edges to the others (``to``)."""
    for batch in batches:
        keys = np.asarray(batch.column(1).flatten())
        docs = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(batch.column(1).offsets)))
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        leader = docs[first][np.cumsum(first) - 1]
        edge = ~first & (docs != leader)
        spread = mix(docs[edge].astype(np.uint64)).view(np.int64)  # any task may pass an edge on
        n, m = int(first.sum()), int(edge.sum())
        for at in range(0, n + m, 65536):
            cut = slice(at, at + 65536)
            key = np.concatenate([keys[first], spread])[cut]
            doc = np.concatenate([docs[first], docs[edge]])[cut]
            to = np.concatenate([np.zeros(n, np.int64), leader[edge]])[cut]
            none = (np.arange(n + m) < n)[cut]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(to, mask=none)], names=["key", "doc", "to"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the batches' smallest documents of a key (input sorted by key, doc) to the smallest of all."""
    key, leader = None, None
    for batch in batches:
        keys, docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        none = np.asarray(batch.column(2).is_null())
        to = np.asarray(batch.column(2).fill_null(0))
        k, d = keys[none], docs[none]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        if len(k) and key is not None and k[0] == key:
            d_first = d.copy()
            d_first[0] = leader  # the run goes on from the batch before
        else:
            d_first = d
        lead = d_first[first][np.cumsum(first) - 1] if len(k) else d
        if len(k):
            key, leader = k[-1], lead[-1]
        u, v = np.concatenate([lead, to[~none]]), np.concatenate([d, docs[~none]])
        own = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[own]), pa.array(v[own])], names=["u", "v"])


def star_edges(heads: DataFrame) -> DataFrame:
    """(u, v): the documents that share a band key with a smaller one, each with one such, a number linear in the keys."""
    local = heads.select("doc_id", "keys").mapInArrow(_local_stars, "key long, doc long, to long")
    return local.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_stars, "u long, v long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_py() or b"" for t in batch.column(0))
        sets = [s.tobytes() for s in shingle_hashes(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], names=["shingles", *batch.schema.names[1:]])


def confirmed_links(docs: DataFrame, heads: DataFrame, members: DataFrame, percent: int = 85) -> DataFrame:
    """(u, v): a spanning forest of the links within each task.

    ``members``: (task, i, j, side, doc_id, part); a task (task, i, j) compares the documents of side 0 among
    themselves or, if there are some of side 1, with those. A text is read and its set made once, whatever number of tasks it is sent to.
    """
    place = F.struct("task", "i", "j", "side", "part")
    sent = members.groupBy("doc_id").agg(F.collect_list(place).alias("at"))  # at most a few per band, and one per block of its tasks
    wanted = heads.select("doc_id", "text_hash", "signature").join(sent, "doc_id")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    met = wanted.join(texts, ["doc_id", "text_hash"]).select("text", "doc_id", "signature", "at")
    sets = met.mapInArrow(_sets, "shingles binary, doc_id long, signature binary, at array<struct<task:bigint,i:int,j:int,side:int,part:bigint>>")
    spread = sets.select(F.explode("at").alias("p"), "doc_id", "signature", "shingles").select("p.task", "p.i", "p.j", "p.side", "doc_id", "p.part", "signature", "shingles")
    return spread.repartition("task", "i", "j").sortWithinPartitions("task", "i", "j").mapInArrow(lambda it: _forest(it, percent), "u long, v long")


def star_tasks(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tasks that compare each u with blocks of its v."""
    blocks = edges.groupBy(F.col("u").alias("task")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = edges.withColumnRenamed("u", "task").join(blocks, "task").withColumn("i", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    heads = blocks.select("task", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    one = heads.select("task", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("task").alias("doc_id"), F.col("task").alias("part"))
    return one.unionByName(own.select("task", "i", F.col("i").alias("j"), F.lit(1).alias("side"), F.col("v").alias("doc_id"), F.col("v").alias("part")))


def block_tasks(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tasks that compare all documents of each group (task, doc_id, part), a pair of blocks each."""
    blocks = groups.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(blocks, "task").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("task", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "part")


def open_groups(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task, doc_id, part): the documents of open keys, by key or by component of open keys.

    ``nodes``: (node, part) of the documents that share a key with another.
    """
    own = heads.select("doc_id", "keys").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "part", F.explode("keys").alias("key"))
    keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"),
                                  F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("n > 2 AND low <> high")
    keys = table(keys.groupBy("who", "n").agg(F.min("key").alias("key")).select("key", "n"), "open-keys")  # the same members count once
    if keys.isEmpty():
        return own.select(F.col("key").alias("task"), "doc_id", "part").limit(0)
    own = table(own.join(keys.select("key"), "key"), "open-members")
    least = key_extreme(own, ["key"], "doc_id", F.col("doc_id"), F.min)
    stars = salted(own, F.col("doc_id")).join(least, ["key", "_salt"]).where("_extreme <> doc_id").select(F.col("_extreme").alias("u"), F.col("doc_id").alias("v"))
    joined = table(connected_components(stars).select(F.col("node").alias("doc_id"), "component"), "open-components")
    size = joined.groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("size"))
    work = keys.join(own.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "key").join(joined, "doc_id").groupBy("component").agg(F.sum(F.col("n") * F.col("n").cast("double")).alias("by_key"))
    by_key = table(size.join(work, "component").select("component", (F.col("by_key") < F.col("size") * F.col("size")).alias("by_key")), "plans")
    placed = own.join(joined, "doc_id").join(by_key, "component")
    return placed.select(F.when(F.col("by_key"), F.col("key")).otherwise(F.col("component")).alias("task"), "doc_id", "part").distinct()


def near_components(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), a row for each row of ``docs``.

    Links documents with 100 * |A & B| >= percent * |A | B| on their shingle sets.
    """
    made = table(profiles(docs, bands, rows), "profiles")
    usable = made.where("n > 0 AND doc_id IS NOT NULL")
    folded = table(usable.groupBy("set_digest").agg(F.min("doc_id").alias("head")), "sets")  # copies fold into one
    heads = table(usable.join(folded.select("set_digest", F.col("head").alias("doc_id")), ["set_digest", "doc_id"], "left_semi")
                  .dropDuplicates(["set_digest", "doc_id"]).select("doc_id", "text_hash", "signature", "keys"), "heads")
    if not made.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        docs = docs.select("doc_id", "text").dropDuplicates(["doc_id", "text"])  # repeated rows go to their task once
    edges = table(star_edges(heads), "stars")
    first = table(confirmed_links(docs, heads, star_tasks(edges, block), percent), "star-links")
    parts = table(connected_components(first), "star-parts")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    groups = table(open_groups(heads, nodes), "open")
    done = [made, heads, edges, first, groups]
    if not groups.isEmpty():
        more = table(confirmed_links(docs, heads, block_tasks(groups, block), percent), "open-links")
        parts = connected_components(first.unionByName(more))
        done.append(more)
    made = table(made.select("doc_id", "text_hash", "n", "set_digest"), "sets-of-rows")
    for used in done:  # signatures and keys take a good part of the texts' disk, which later stages need
        drop_table(used)
    of_set = folded.join(parts, F.col("head") == F.col("node"), "left").select("set_digest", F.coalesce("component", "head").alias("_component"))
    out = made.join(of_set, "set_digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """The rows of ``docs`` that are kept: one row of each component.

    Where doc_ids repeat or are null, each row is a document of its own: rows get
    numbers in the order of doc_id, nulls last, and the smallest number stays.
    With 48 bands of 6, a pair at exactly 0.8 is missed with probability 5e-7.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        lost = near_components(docs, percent, bands, rows).where("NOT kept").select(F.col("doc_id").alias("_sw_doc"))
        return docs.join(lost, F.col("doc_id") == F.col("_sw_doc"), "left_anti")
    numbered = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn("_sw_row", F.monotonically_increasing_id())
    numbered = table(numbered, "numbered")
    lost = near_components(numbered.select(F.col("_sw_row").alias("doc_id"), "text"), percent, bands, rows).where("NOT kept").select(F.col("doc_id").alias("_sw_row"))
    return numbered.join(lost, "_sw_row", "left_anti").drop("_sw_row")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_components(docs.select("doc_id", "text")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)
