"""The language model against dictionaries."""

import binascii
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import lm
from sitewise.llm._common import read_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


class Brute:
    """Counts as dictionaries of tuples; None is the end, 0 the start mark."""

    def __init__(self, texts, order):
        self.order, top = order, Counter()
        for t in texts:
            said = [0] * (order - 1) + words(t) + [None]
            top.update(tuple(said[i - order + 1 : i + 1]) for i in range(order - 1, len(said)))
        self.c, raw = {order: top}, top
        for k in range(order - 1, 0, -1):
            left, below = Counter(g[1:] for g in self.c[k + 1] if raw[g]), Counter()
            for g, n in raw.items():
                below[g[1:]] += n
            self.c[k] = {g: (below[g] if k > 1 and g[0] == 0 else left[g]) for g in below}
            raw = below
        self.raw, self.d, self.context = raw, {}, {}
        for k, counts in self.c.items():
            n = Counter(counts.values())
            self.d[k] = lm.discounts(n[1], n[2], n[3], n[4])
            by = self.context[k] = defaultdict(lambda: [0, 0.0])  # sum, what discounts take
            for g, c in counts.items():
                by[g[:-1]][0] += c
                by[g[:-1]][1] += (0, *self.d[k])[min(c, 3)]

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        total, taken = self.context[k].get(gram[:-1], (0, 0))
        if not total:
            return lower
        c = self.c[k].get(gram, 0)
        return (c - (0, *self.d[k])[min(c, 3)] + taken * lower) / total

    def score(self, text):
        said = [0] * (self.order - 1) + words(text) + [None]
        tokens = [said[i - self.order + 1 : i + 1] for i in range(self.order - 1, len(said))]
        total, types = sum(self.raw.values()), len(self.raw)
        base = [math.log10((self.raw.get((t[-1],), 0) + 1) / (total + types + 1)) for t in tokens]
        return len(tokens), sum(self.raw.get((t[-1],), 0) > 0 for t in tokens), total, sum(base), sum(math.log10(self.p(tuple(t))) for t in tokens)


def same(rows, brute):
    for r in rows:
        n, known, total, base, score = brute.score(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize(("order", "bits"), [(2, None), (2, 3), (3, 2), (4, 1)])
def test_equals_brute_force(spark, small, order, bits):
    docs = read_table(spark, small, "documents").select("doc_id", "text", F.lit(False).alias("held_out"))
    model = lm.train(docs.where("doc_id % 3 > 0"), order, bits, 20_000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    brute = Brute([t for d, t in texts.items() if d % 3], order)
    assert {k: pytest.approx(v) for k, v in brute.d.items()} == model.discounts
    rows = lm.scored(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == len(texts)
    same(rows, brute)


def test_probabilities_sum_to_one(spark, documents):
    texts = ["a b a c a b", "b a a b c c", "c a b", "a b"] * 3 + ["d e f a"]
    model = lm.train(documents(texts), 3)
    arrays = lm.Arrays(model)
    for context in ("", "a", "a b", "zz", "b zz", "d e"):
        before = lm.score(arrays, [context.encode()])[3][0] - last(arrays, context)
        total = 10 ** last(arrays, context)
        for w in "a b c d e f unseen".split():
            whole = f"{context} {w}".strip()
            total += 10 ** (lm.score(arrays, [whole.encode()])[3][0] - last(arrays, whole) - before)
        assert total == pytest.approx(1)


def last(arrays, text):
    """log10 of the end's probability."""
    said, at, tokens = lm.sequence([text.encode()], arrays.model.order)
    cut = Stopped(arrays)
    return lm.score(arrays, [text.encode()])[3][0] - cut.words(text)


class Stopped:
    def __init__(self, arrays):
        self.arrays = arrays

    def words(self, text):
        """log10 probability of the words without the end, from the model's parts."""
        m, order = self.arrays.model, self.arrays.model.order
        said, at, tokens = lm.sequence([text.encode()], order)
        out = 0.0
        for i in at[:-1]:
            p = None
            for k in range(1, order + 1):
                key = lm.gram_hash([said[i - k + 1 + j : i - k + 2 + j] for j in range(k)])
                c = int(self.arrays.find(k, key, ["c"])[0][0])
                d = (0.0, *m.discounts[k])[min(c, 3)]
                if k == 1:
                    p = max(c - d, 0) / max(1, m.pairs) + m.rest / (m.types + 1)
                    continue
                context = lm.gram_hash([said[i - k + 1 + j : i - k + 2 + j] for j in range(k - 1)])
                total, n1, n2, n3 = (int(x[0]) for x in self.arrays.find(k - 1, context, ["total", "n1", "n2", "n3"]))
                if total:
                    e = m.discounts[k]
                    p = (max(c - d, 0) + (e[0] * n1 + e[1] * n2 + e[2] * n3) * p) / total
            out += math.log10(p)
        return out


def test_query(spark, small):
    docs = read_table(spark, small, "documents")
    rows = lm.op11(spark, docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    held = lambda d: binascii.crc32(str(d).encode()) % 7 == 2
    assert all(r.held_out == held(r.doc_id) for r in rows) and len(rows) == docs.count()
    same(rows, Brute([r.text for r in rows if not r.held_out], 2))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_cases(spark, documents):
    texts = [None, "", "  \n ", "A a A", "é É x\x00y", "w " * 60_000, "A a A", "</s> <s>"]
    docs = documents(texts, ids=[1, 2, None, 4, 5, 6, 4, 8]).withColumn("held_out", F.lit("x")).withColumn("shard", F.lit(3)).withColumn("score", F.lit(1))
    rows = lm.op11(spark, docs).collect()
    assert len(rows) == len(texts)
    held = lambda d: d is not None and binascii.crc32(str(d).encode()) % 7 == 2
    ids = [1, 2, None, 4, 5, 6, 4, 8]
    brute = Brute([t for d, t in zip(ids, texts, strict=True) if not held(d)], 2)
    want = sorted((str(d), held(d), *brute.score(t)[:3]) for d, t in zip(ids, texts, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    assert sum(r.score for r in rows) == pytest.approx(sum(brute.score(t)[4] for t in texts), rel=1e-9)


def test_empty_tables(spark, documents):
    docs = documents(["a"]).limit(0)
    assert lm.op11(spark, docs).count() == 0
    only = next(d for d in range(100) if binascii.crc32(str(d).encode()) % 7 == 2)
    (row,) = lm.op11(spark, documents(["a b"], ids=[only])).collect()  # nothing to learn from
    assert row.held_out and (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_files_are_written_again_with_the_same_bytes(spark, small):
    docs = read_table(spark, small, "documents")
    a, b = lm.train(docs, 2, 2), lm.train(docs.repartition(5), 2, 2)
    names = lambda m: sorted(os.listdir(m.root.removeprefix("file://")))
    assert names(a) == names(b) and len(names(a)) == 8
    for n in names(a):
        x, y = (open(f"{m.root.removeprefix('file://')}/{n}", "rb").read() for m in (a, b))
        assert x == y
    mapped, read = lm.Arrays(a), lm.Arrays(a)
    read.mapped = False  # as on a store that cannot be mapped
    texts = [b"the cat", b""]
    assert all(np.array_equal(p, q) for p, q in zip(lm.score(mapped, texts), lm.score(read, texts), strict=True))


def test_registered_query_has_trigrams(spark, small):
    from sitewise.llm.queries import QUERIES

    docs = read_table(spark, small, "documents")
    rows = QUERIES["op11_kneser_ney"](spark, small).join(docs.select("doc_id", "text"), "doc_id").collect()
    same(rows, Brute([r.text for r in rows if not r.held_out], 3))


def test_arrays_and_packed_rows_are_small(spark, small):
    """The check of round 3: arrays took 12 bytes a triple and 32 a pair, and rows to the level below 16 bytes of hashes a pair."""
    docs = read_table(spark, small, "documents")
    model = lm.train(docs, 3, 2)
    arrays, folder = lm.Arrays(model), model.root.removeprefix("file://")
    for level, most in ((3, 10), (2, 12)):
        n = sum(len(arrays.shard(level, s)["code"]) for s in range(4))
        assert n > 10_000 and sum(os.path.getsize(f"{folder}/{level}-{s}") for s in range(4)) < most * n
    texts = [(r.text or "").encode() for r in docs.select("text").collect()]
    words, ids = lm.vocabulary(lm.sequence(texts, 3)[0])
    ids = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1)
    rows = list(lm._packed(words, ids, np.ones((6, ids.shape[1]), np.int64), 2))
    assert sum(map(lm._size, rows)) < 12 * ids.shape[1]


def test_tuples_wider_than_a_word(spark):
    rng = np.random.default_rng(1)
    columns = np.concatenate([rng.integers(0, 3, (2, 5000)), rng.integers(0, 1 << 40, (2, 50))[:, rng.integers(0, 50, 5000)], rng.integers(0, 2, (1, 5000))])
    order, first = lm.grouped(lm.joined(columns))
    found = [tuple(x) for x in columns[:, order[first]].T.tolist()]
    assert found == sorted(set(map(tuple, columns.T.tolist())))
