"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Tokens of a text are its words (A-Z lower-cased) and one end; ``order`` - 1 start marks stand before it as context. A word is
its 64-bit hash, an n-gram the hash of its words' hashes.

Counting. A task takes the n-grams of ``order`` of a slice of texts, counts them, and sends one packed row per
(slice, shard): the shard is the n-gram's leading hash bits, so shards are even whatever words are common, and a frequent
n-gram is one entry per slice. A shard's task merges its rows, writes their hashes and numbers and passes on what the
level below needs: of each n-gram, one more left neighbour of its last words, and a count class for the context of its first words,
packed per shard of that level. Packed rows hold each word's hash once, with numbers of words that are small for common ones. Levels below go the same way. So no level meets in one task and nothing but sums comes to the driver.

Model. c is the count at the top, the number of distinct left neighbours below (the count for n-grams that begin with a start
mark). p(w | context) = max(c - D(c), 0) / C + (D1 N1 + D2 N2 + D3 N3) / C * p(w | shorter context); C, N1, N2 and N3 are of the
context: sum of c, and words with c of 1, 2 and 3 or more. The D come from each level's numbers of n-grams with c of 1 to 4
(where those give none in 0 <= D_i <= i: 0.5, 1 and 1.5). Single words are interpolated with 1 / (V + 1), the one being any
unseen word. Counts are stored, probabilities are worked out in double precision.

Scoring. Workers map the arrays of the shared folder (of a store that cannot be mapped, they read a shard at a time) and
look up a slice's sorted distinct keys shard by shard, so pages are met in order, once per slice. Writing is safe to repeat:
a file is written under a name of its own, then renamed; a repeated task writes the same bytes.

Edge cases: a null or empty text has one token, its end. A null doc_id is not held out. Each row is a text, repeated rows too.
Without training texts N and V are 0 and every token has probability 1. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import emit, scratch_path, table
from ._shingle import _STEP, mix
from ._tokens import slices, token_hashes

#: Hashes of the marks: no word has them, but for an accident of 1 in 2^64.
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
SLICE_BYTES, SCORE_BYTES = 16 << 20, 4 << 20  # of text, counted or scored at a time
SHARD_BYTES = 32 << 20
STATS = ("left", "raw", "total", "n1", "n2", "n3")


def gram_hash(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given a column of word hashes per place."""
    columns = iter(columns)
    out = mix(next(columns))
    for c in columns:
        out = mix(out * _STEP + c)
    return out


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def sequence(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with start marks and ends; the places of predicted tokens; each text's number of them."""
    words, counts = token_hashes(texts)
    tokens = counts + 1
    ends = np.cumsum(tokens + order - 1) - 1
    out = np.full(int(ends[-1]) + 1, START, np.uint64)
    first = ends - counts
    at = np.arange(len(words)) + np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    out[at] = words
    out[ends] = END
    predicted = np.arange(int(tokens.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(tokens)[:-1]]), tokens)
    return out, predicted, tokens


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0):
    for batch in batches:
        for row in zip(*[c.to_pylist() for i, c in enumerate(batch.columns) if i != column], (t.as_py() for t in batch.column(column)), strict=True):
            yield (*row[:-1], (row[-1] or "").encode("utf-8", "surrogatepass"))


def _planes(x: np.ndarray) -> bytes:
    """Integers from 0 on, in as few bytes each as the largest needs, by byte planes, compressed; the first byte is their size."""
    x = x.astype(_least(x))
    return bytes([x.itemsize]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _integers(raw: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1).T.tobytes(), f"u{raw[0]}")


def _least(x: np.ndarray) -> np.dtype:
    return np.min_scalar_type(int(x.max()) if x.size else 0)


def joined(columns: np.ndarray) -> np.ndarray:
    """A number per place that is equal, and in the same order, as the places' tuples are; whatever their width."""
    code, width = np.zeros(columns.shape[1], np.uint64), 0
    for c in columns:
        wide = int(c.max()).bit_length() if len(c) else 0
        if width + wide > 64:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            width = int(code.max()).bit_length()
        code = code << np.uint64(wide) | c.astype(np.uint64)
        width += wide
    return code


def grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of ``code``, and where in that order each distinct one begins."""
    order = np.argsort(code)
    some = code[order]
    return order, np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.empty(0, np.int64)


def vocabulary(said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, commonest first, so that most numbers are small; each place's number."""
    words, ids, n = np.unique(said, return_inverse=True, return_counts=True)
    by = np.argsort(-n, kind="stable")
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    return words[by], rank[ids.reshape(-1)].reshape(said.shape)


PACKED = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("stats", pa.binary()), ("sums", pa.list_(pa.int64()))])
PACKED_SQL = "level int, shard int, words binary, ids binary, stats binary, sums array<long>"


def _size(row: tuple) -> int:
    return sum(len(x) for x in row[2:5] if x)


def _packed(words: np.ndarray, ids: np.ndarray, stats: np.ndarray, bits: int) -> Iterator[tuple]:
    """Distinct n-grams in order (a line of word numbers per place) and their numbers (a line per kind): a row per shard."""
    shard = shard_of(gram_hash(words[i] for i in ids), bits)
    by = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
    edges = np.searchsorted(shard[by], np.arange((1 << bits) + 1))
    for shard in np.flatnonzero(np.diff(edges)):
        some = by[edges[shard] : edges[shard + 1]]
        own = ids[:, some]
        if own.size * 8 > len(words):
            mark = np.zeros(len(words), bool)
            mark[own] = True
            used, own = np.flatnonzero(mark), (np.cumsum(mark, dtype=np.int32) - 1)[own]
        else:
            used, own = np.unique(own, return_inverse=True)
        yield len(ids), int(shard), _planes(words[used]), _planes(own.reshape(-1)), _planes(stats[:, some].reshape(-1)), None


def _count(order: int, bits: int, slice_bytes: int):
    """Texts to packed n-grams: a row per slice and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for held in slices(_texts(batches), 0, slice_bytes):
                said, at, _ = sequence([r[0] for r in held], order)
                words, ids = vocabulary(said)
                ids = np.stack([ids[at - order + 1 + k] for k in range(order)])
                del said, at
                by, first = grouped(joined(ids))
                ids, n = ids[:, by[first]], np.diff(np.append(first, len(by)))[None]
                del by, first
                yield from _packed(words, ids, n, bits)

        yield from emit(rows(), PACKED, _size)

    return run


def _unpacked(rows: list[tuple], level: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of all rows one after the other the word numbers (a line per place) and the numbers (a line per kind)."""
    words = [_integers(r[2].as_py()).astype(np.uint64) for r in rows]
    every = np.unique(np.concatenate(words))
    ids = [np.searchsorted(every, w).astype(np.int32)[_integers(r[3].as_py())].reshape(level, -1) for w, r in zip(words, rows, strict=True)]
    return every, np.concatenate(ids, axis=1), np.concatenate([_integers(r[4].as_py()).astype(np.int64).reshape(kinds, -1) for r in rows], axis=1)


def _write(root: str, level: int, shard: int, bits: int, keys: np.ndarray, numbers: dict[str, np.ndarray]) -> None:
    """A shard's arrays as one file in the shared folder, of a row of lists. Sorted keys stand under their first bits after the shard's (about
    eight under each, found by ``starts``), with what is left of them in ``high`` and ``low``; their numbers are one of a dictionary of tuples."""
    by = np.argsort(keys)
    keys, values = keys[by], np.stack(list(numbers.values()))[:, by]
    fan = max(0, (len(keys) // 8).bit_length() - 1)
    head, tail = _split(keys, bits, fan)
    order, first = grouped(joined(values))
    code = np.empty(len(order), np.int64)
    code[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    high = tail >> np.uint64(32)
    lists = {"starts": np.searchsorted(head, np.arange((1 << fan) + 1)).astype(np.int64), "low": tail.astype(np.uint32), "high": high.astype(_least(high)), "code": code.astype(_least(code))}
    lists["starts"] = lists["starts"].astype(_least(lists["starts"]))
    lists |= dict(zip(numbers, values[:, order[first]], strict=True))
    arrays = [pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), pa.array(v)) for v in lists.values()]
    batch = pa.RecordBatch.from_arrays(arrays, names=list(lists))
    store, folder = fs.FileSystem.from_uri(root)
    name = f"{folder}/{level}-{shard}"
    with store.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as out, pa.ipc.new_file(out, batch.schema) as sink:
        sink.write_batch(batch)
    store.move(own, name)


def _split(keys: np.ndarray, bits: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys of a shard: the ``fan`` bits after those of the shard, and the bits after these."""
    left = np.uint64(64 - bits - fan)
    rest = keys & np.uint64((1 << (64 - bits)) - 1)
    return (rest >> left).astype(np.int64) if fan else np.zeros(len(keys), np.int64), rest & np.uint64((1 << int(left)) - 1)


def _below(words: np.ndarray, ids: np.ndarray, c: np.ndarray, raw: np.ndarray, bits: int) -> Iterator[tuple]:
    """What distinct n-grams (their words, c, counts) add to the n-grams one word shorter: those of their last and of their first words."""
    n = ids.shape[1]
    order, begin = grouped(joined(np.concatenate([ids[1:], ids[:-1]], axis=1)))
    kind = np.int32 if raw.sum() < 1 << 31 else np.int64
    stats = np.zeros((len(STATS), len(begin)), kind)
    for k, (of_last, of_first) in enumerate([(1, 0), (raw, 0), (0, c), (0, c == 1), (0, c == 2), (0, c > 2)]):
        every = np.zeros(2 * n, kind)
        every[:n], every[n:] = of_last, of_first
        if n:
            np.add.reduceat(every[order], begin, out=stats[k])
    one = order[begin]
    shorter = np.where(one < n, ids[1:, one % max(1, n)], ids[:-1, one % max(1, n)])
    yield from _packed(words, shorter, stats, bits)


def _merge(level: int, order: int, bits: int, root: str):
    """A shard's packed rows, sorted by shard, to its arrays, to what the level below needs, and to sums (shard -1)."""
    top = level == order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            every = (row for b in batches for row in zip(*b.columns, strict=True))
            for shard, own in groupby(every, lambda row: row[1].as_py()):
                if shard < 0:  # sums of the level above
                    yield from (tuple(x.as_py() for x in row) for row in own)
                    continue
                words, ids, stats = _unpacked(list(own), level, 1 if top else len(STATS))
                by, first = grouped(joined(ids))
                ids, sums = ids[:, by[first]], [np.add.reduceat(s[by], first) for s in stats]
                del by, first, stats
                keys = gram_hash(words[i] for i in ids)
                if top:
                    c = raw = sums[0]
                    _write(root, level, shard, bits, keys, {"c": c})
                else:
                    left, raw, *rest = sums
                    c = np.where(words[ids[0]] == START, raw, left) if level > 1 else left
                    _write(root, level, shard, bits, keys, {"c": c, **({} if level > 1 else {"raw": raw}), **dict(zip(STATS[2:], rest, strict=True))})
                    seen = raw > 0
                    ids, c, raw = ids[:, seen], c[seen], raw[seen]
                yield level, -1, None, None, None, [*(int((c == k).sum()) for k in (1, 2, 3, 4)), len(c), int(raw.sum()), int(c.sum())]
                if level > 1:
                    del keys, sums
                    yield from _below(words, ids, c, raw, bits)

        yield from emit(rows(), PACKED, _size)

    return run


@dataclass
class Model:
    """Where the arrays are, and the sums that all tokens share."""

    root: str
    order: int
    bits: int
    discounts: dict[int, tuple[float, float, float]]
    tokens: int  # N
    types: int  # V
    pairs: int  # sum of c over single words
    rest: float  # share of single words' probability that unseen words and all others divide


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if min(n1, n2, n3):
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, order: int = 2, bits: int | None = None, slice_bytes: int = SLICE_BYTES) -> Model:
    """Counts the n-grams of the column ``text`` and writes the model's arrays to a folder of their own."""
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    docs = docs.select("text")
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(0, int(-(-size // SHARD_BYTES)) - 1).bit_length()
    root = scratch_path(spark, "lm")
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder)
    found = docs.mapInArrow(_count(order, bits, slice_bytes), PACKED_SQL)
    for level in range(order, 0, -1):
        found = found.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(_merge(level, order, bits, root), PACKED_SQL)
        if 1 < level < order:
            found = table(found, "levels")
    totals = found.where("shard < 0").groupBy("level").agg(*[F.sum(F.get("sums", F.lit(k))) for k in range(7)])
    sums = {r.level: tuple(r[1:]) for r in totals.collect()}  # a row per level
    steps = {k: discounts(*sums.get(k, (0,) * 7)[:4]) for k in range(1, order + 1)}
    n1, n2, _, _, types, tokens, pairs = sums.get(1, (0,) * 7)
    d = steps[1]
    rest = (d[0] * n1 + d[1] * n2 + d[2] * (types - n1 - n2)) / pairs if pairs else 1.0
    return Model(root, order, bits, steps, tokens, types, pairs, rest)


class Arrays:
    """A model's arrays as a worker sees them: mapped, or read, when first met."""

    OPEN = 256

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, OrderedDict()
        self.store, self.folder = fs.FileSystem.from_uri(model.root)
        self.mapped = urlparse(model.root).scheme in ("", "file")

    def shard(self, level: int, shard: int) -> dict[str, np.ndarray] | None:
        at = (level, shard)
        if at not in self.open:
            name = f"{self.folder}/{level}-{shard}"
            if self.store.get_file_info(name).type == fs.FileType.NotFound:
                self.open[at] = None
            else:
                source = pa.memory_map(name) if self.mapped else self.store.open_input_file(name)
                batch = pa.ipc.open_file(source).get_batch(0)
                self.open[at] = {n: c.values.to_numpy(zero_copy_only=True) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            if len(self.open) > self.OPEN:
                self.open.popitem(last=False)
        return self.open[at]

    def find(self, level: int, keys: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """The named numbers of each key, 0 where it is unknown."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(distinct), np.int64) for _ in names]
        edges = np.searchsorted(shard_of(distinct, self.model.bits), np.arange((1 << self.model.bits) + 1))
        for shard in np.flatnonzero(np.diff(edges)):
            own = self.shard(level, int(shard))
            if own is None:
                continue
            some = slice(edges[shard], edges[shard + 1])
            code, hit = self._codes(own, distinct[some])
            for o, name in zip(out, names, strict=True):
                o[some] = np.where(hit, own[name][code], 0)
        return [o[back] for o in out]

    def _codes(self, own: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key's numbers in the shard's dictionary, and whether the shard has the key: a binary search under the first bits of each."""
        starts, low, high = own["starts"], own["low"], own["high"]
        head, tail = _split(keys, self.model.bits, (len(starts) - 1).bit_length() - 1)
        lo, end = starts[head].astype(np.int64), starts[head + 1].astype(np.int64)
        hi, most = end, len(low) - 1
        rest = lambda at: high[at].astype(np.uint64) << np.uint64(32) | low[at]
        for _ in range(int((hi - lo).max()).bit_length()):
            mid = lo + hi >> 1
            less = (lo < hi) & (rest(np.minimum(mid, most)) < tail)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        at = np.minimum(lo, most)
        return own["code"][at], (lo < end) & (rest(at) == tail)


def score(arrays: Arrays, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, known tokens, log10 probability of single words with one added to each count, log10 probability."""
    model, order = arrays.model, arrays.model.order
    said, at, tokens = sequence(texts, order)
    discount = lambda level, c: np.select([c == 0, c == 1, c == 2], [0.0, *model.discounts[level][:2]], model.discounts[level][2])
    base, p, context = None, None, None
    for level in range(1, order + 1):
        reach = np.arange(level - 1, len(said))  # n-grams end here
        keys = gram_hash([said[reach - level + 1 + k] for k in range(level)])
        place = at - level + 1
        if level < order:
            c, *stats = arrays.find(level, keys, ["c", *STATS[1 if level == 1 else 2 :]])
        else:
            (c,), stats = arrays.find(level, keys[place], ["c"]), None
            place = slice(None)
        c = c[place]
        if level == 1:
            count = stats.pop(0)[place]
            base = np.log10((count + 1) / (model.tokens + model.types + 1))
            p = np.maximum(c - discount(1, c), 0) / max(1, model.pairs) + model.rest / (model.types + 1)
            known = count > 0
        else:
            total, n1, n2, n3 = context
            d = model.discounts[level]
            safe = np.maximum(total, 1)
            p = np.where(total > 0, (np.maximum(c - discount(level, c), 0) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / safe, p)
        if level < order:  # the next level's context ends one place before
            context = [s[at - level] for s in stats]
    starts = np.concatenate([[0], np.cumsum(tokens)[:-1]])
    return tokens, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, held_out, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)

        def rows():
            for held in slices(_texts(batches, 2), 2, SCORE_BYTES):
                for (doc, out, _), n, k, b, s in zip(held, *(x.tolist() for x in score(arrays, [r[2] for r in held])), strict=True):
                    yield doc, out, n, k, model.tokens, b, s

        yield from emit(rows(), schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11(spark: SparkSession, docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from the rows that are not held out, scores all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    return scored(docs, train(docs.where(~F.col("held_out")), order))
