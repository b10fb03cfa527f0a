"""Toxicity by compression distance with two zstandard dictionaries.

Training (driver): byte sequences that one class
repeats and the other hardly has become the content of that class's dictionary,
commonest last. A text is cut into overlapping windows; each is compressed with
both dictionaries, and its gain is the difference of the two lengths: positive where the toxic
dictionary saves bytes, negative where the ordinary one does. Windows
start with a constant primer that both dictionaries end with, so that zstandard
always finds the window compressible and a single match shows in its length;
they are short enough that literals stay raw. A text's gains (the sums of the positive
and of the negative ones against the number of windows, the largest, the shares of clear ones of either sign)
go through a logistic calibration fitted on the same training texts.

Bound of the fit (parameters of :func:`train`): per class the first ``per_class`` different labelled
texts by hash of doc_id, as far as ``class_bytes`` allow; larger ones are passed over, none is cut.

Scoring is one map over whole texts. Neither labels nor lang, source or doc_id
enter a score.

Edge cases: a null or empty text is one empty window and gets the score of no
gain. doc_ids with several labels are toxic if any label is; labels other than 0
and 1 are ignored; rows with equal doc_id and text are one training text. Without training texts of both classes every score is 0 (or 1
if there are only toxic ones). A null doc_id is not held out. Extra columns are
not read by ``op4`` and pass through ``stage``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table
from ._shingle import mix

GRAM = 5
WINDOW, OVERLAP = 62, 14
PRIMER = b"~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ~"
PER_CLASS = 3000
CLASS_BYTES = 64 << 20
PART_BYTES = 4 << 20  # of training texts, whose grams are counted at a time
CLEAR = 3  # bytes that a match of at least six saves


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    constant: float | None = None


def _grams(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | raw[k : k + n]
    return out


def _no_copies(texts: list[bytes]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one (6 of 8 gram minima equal)."""
    grams = (np.unique(_grams(t)) for t in texts)
    minima = np.array([[mix(g + np.uint64(k << 56)).min() if len(g) else k for k in range(8)] for g in grams], np.uint64)
    return [i for i in range(len(texts)) if not ((minima[:i] == minima[i]).sum(axis=1) >= 6).any()]


def _counts(texts: list[bytes], part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a part, by the first ``bits`` bits of their hash, and the number of texts that hold each."""
    some = []
    for text in texts:
        own = _grams(text)
        if bits:
            own = own[(own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) == part]
        some.append(np.unique(own))
    return np.unique(np.concatenate(some), return_counts=True)


def repeated(one: list[bytes], two: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two classes: the grams of three of its texts or more, in order, with the number of its and of the other's texts that hold
    them. Grams are counted part by part, so that memory does not hold those of all texts."""
    bits = (sum(map(len, one + two)) // PART_BYTES).bit_length()
    found: list[list] = [[], []]
    for part in range(1 << bits):
        counts = [_counts(texts, part, bits) for texts in (one, two)]
        for out, (grams, n), (others, m) in zip(found, counts, counts[::-1], strict=True):
            grams, n = grams[n >= 3], n[n >= 3]
            where = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
            out.append((grams, n, np.where(others[where] == grams, m[where], 0) if len(others) else np.zeros(len(grams), np.int64)))
    whole = [[np.concatenate(c) for c in zip(*parts, strict=True)] for parts in found]
    return [tuple(c[order] for c in columns) for columns in whole for order in [np.argsort(columns[0])]]


def _evidence(count: np.ndarray, seen: np.ndarray, own: int, other: int) -> np.ndarray:
    """The log-likelihood ratio of grams found in ``count`` of ``own`` and ``seen`` of ``other`` texts against one rate for both."""
    both = (count + seen) / (own + other)
    part = lambda k, n: k * np.log(np.maximum(k, 1e-9) / n / both)
    return 2 * (part(count, own) + part(seen, other))


def content(grams: np.ndarray, count: np.ndarray, seen: np.ndarray, texts: list[bytes], others: int, share: float = 0.1, ratio: float = 6, evidence: float = 20, size: int = 112_640) -> bytes:
    """Dictionary content: sequences made of grams (in ``count`` of ``texts``, ``seen`` in so many of ``others``) that are ``ratio`` times as
    frequent among the texts as among the others, with ``evidence`` of that whatever the commonest such gram (or, among few texts,
    with 0.6 times it in ``share`` of its texts); commonest last. ``size`` is zstandard's own for dictionaries."""
    rare = (count + 0.5) / (len(texts) + 1) >= ratio * (seen + 0.5) / (others + 1)
    grams, count, seen = grams[rare], count[rare], seen[rare]
    if not len(grams):
        return b""
    ratio_of = _evidence(count, seen, len(texts), others)
    often = (ratio_of >= evidence) | (count >= share * count.max()) & (ratio_of >= 0.6 * evidence)
    grams, count = grams[often], count[often]
    if not len(grams):
        return b""
    found: Counter[bytes] = Counter()
    for text in texts:
        found.update(set(_pieces(text, grams, count)))
    kept: list[bytes] = []
    for piece, n in found.most_common():
        if n < 3 or sum(map(len, kept)) > size:
            break
        if len(piece) >= 5 and not any(k.strip() in piece or piece.strip() in k for k in kept):
            kept.append(piece)
    return b"\n".join(reversed(kept))


def _pieces(text: bytes, grams: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
    """Runs of the grams, from a word's start (if the run has one) for as long as half the texts go on alike."""
    own = _grams(text)
    place = np.searchsorted(grams, own)
    place[place == len(grams)] = 0
    at = np.flatnonzero(grams[place] == own)
    if not len(at):
        return
    cut = np.flatnonzero(np.diff(at) > 4)
    for s, e in zip([0, *(cut + 1)], [*cut, len(at) - 1], strict=True):
        run = at[s : e + 1].tolist()
        starts = [p for p in run if text[p] == 32 and 32 not in text[p + 1 : p + GRAM - 1]]
        if not starts and 32 not in text[run[0] : run[-1] + GRAM]:
            starts = run[:1]
        for p, to in zip(starts, [*starts[1:], len(text)]):  # noqa: B905
            least, end = count[place[p]] / 2, p
            for q in run:
                if p < q < to and q - end <= 4 and count[place[q]] >= least:
                    end = q
            yield text[p : end + GRAM]


@lru_cache(8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    bits = max(12, (len(dictionary) + 1024).bit_length())  # all of the dictionary within reach and in the tables
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, target_length=16, min_match=5, window_log=bits + 1, hash_log=bits, chain_log=bits, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(b"\n" + dictionary + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def windows(text: bytes) -> list[bytes]:
    return [PRIMER + text[i : i + WINDOW] for i in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP)]


def gains(cut: list[bytes], model: Model) -> np.ndarray:
    """For each window, the bytes that the toxic dictionary saves over the ordinary one."""
    toxic, ordinary = _compressor(model.toxic), _compressor(model.ordinary)
    out = np.empty(len(cut), np.int64)
    for at in range(0, len(cut), 2048):
        part = cut[at : at + 2048]
        a, b = toxic.multi_compress_to_buffer(part), ordinary.multi_compress_to_buffer(part)
        out[at : at + len(part)] = [len(b[i]) - len(a[i]) for i in range(len(part))]
    return out


def features(texts: Iterator[bytes | None], model: Model) -> Iterator[np.ndarray]:
    """The features of each text, windows of many texts compressed at once."""
    held: list[bytes] = []
    ends: list[int] = []
    for text in texts:
        held += windows((text or b"").lower())
        ends.append(len(held))
        if len(held) >= 16_384:
            yield from _features(gains(held, model), ends)
            held, ends = [], []
    if ends:
        yield from _features(gains(held, model), ends)


def _features(g: np.ndarray, ends: list[int]) -> Iterator[np.ndarray]:
    at = 0
    for end in ends:
        own, n = g[at:end], end - at
        toxic, ordinary = np.maximum(own, 0), np.maximum(-own, 0)
        yield np.array([1.0, toxic.sum() / np.sqrt(n), toxic.max(), (toxic >= CLEAR).sum() / np.sqrt(n), ordinary.sum() / np.sqrt(n), (ordinary >= CLEAR).sum() / np.sqrt(n), np.log(n)])
        at = end


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    toxic, ordinary = [t.lower() for t in toxic], [t.lower() for t in ordinary]
    if not toxic or not ordinary:
        return Model(b"", b"", (), float(bool(toxic)))
    own, other = ([texts[i] for i in _no_copies(texts)] for texts in (toxic, ordinary))  # a passage that copies repeat says little about its class
    ours, theirs = repeated(own, other)
    return calibrated(toxic, ordinary, content(*ours, own, len(other)), content(*theirs, other, len(own)))


def calibrated(toxic: list[bytes], ordinary: list[bytes], toxic_content: bytes, ordinary_content: bytes) -> Model:
    """The model of two dictionaries, its weights fitted on lower-case texts of both classes."""
    model = Model(toxic_content, ordinary_content, ())
    x = np.stack(list(features(iter(toxic + ordinary), model)))
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return Model(model.toxic, model.ordinary, tuple(float(v) for v in w))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """Fits on labelled rows that are not held out."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for kind in (1, 0)]
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")  # at most 2 * per_class ids
    rows = rows.select("toxic", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    slim = rows.groupBy("toxic", "doc_id", "text_hash").agg(F.max(F.octet_length("text")).alias("bytes"))
    chosen = []
    for kind in (1, 0):
        left = class_bytes
        for r in slim.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(per_class).collect():
            if r.bytes <= left:
                left -= r.bytes
                chosen.append((kind, r.doc_id, r.text_hash))
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, "toxic int, doc_id long, text_hash long")
    found = rows.withColumn("toxic", F.col("toxic").cast("int")).join(F.broadcast(wanted), ["toxic", "doc_id", "text_hash"])  # at most 2 * per_class rows
    texts = found.groupBy("toxic", "doc_id", "text_hash").agg(F.min(F.col("text").cast("binary")).alias("text")).orderBy("doc_id", "text").select("toxic", "text").toArrow()
    kinds, column = texts.column(0).to_pylist(), texts.column(1)
    classes = [[v.as_py() for k, v in zip(kinds, column, strict=True) if k == kind] for kind in (1, 0)]
    del texts, column
    return fit(*classes)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each text."""
    at = docs.columns.index("text")
    names = [*docs.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.constant is not None:
                s = np.full(batch.num_rows, model.constant)
            else:
                texts = (t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(at))
                x = np.stack(list(features(texts, model))) if batch.num_rows else np.zeros((0, len(model.weights)))
                s = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=names)

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def op4(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, "_sw_toxicity").where("_sw_toxicity < 0.7").drop("_sw_toxicity")
