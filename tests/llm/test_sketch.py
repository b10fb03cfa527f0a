import hashlib
import random

import numpy as np

from sitewise.llm import sketch
from sitewise.llm._shingle import mix, shingle_hashes

from .test_minhash import shingles


def words(rng, n):
    return " ".join(rng.choices([f"w{i}" for i in range(400)], k=n))


def test_query(spark, documents):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(120)] + [None, "", "é" * 10, "a b"]
    ids = rng.sample(range(10_000), len(texts))
    rows = sorted(zip(ids, texts, strict=True), reverse=True)
    got = {r.doc_id: r for r in sketch.fingerprints(documents(texts, ids=ids), rows_per_range=7).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = sketch.edited(text, following)
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        true = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - true(shingles(text), shingles(changed))) < 0.2
        assert abs(r.near_next - true(shingles(text), shingles(following))) < 0.2
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if changed == text:
            assert r.edited_fingerprint == r.fingerprint


def test_edge_rows(spark, documents):
    one = sketch.op8(spark, documents(["abc def"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc d" + b"ab").hexdigest() and one.near_next == 1.0
    assert sketch.op8(spark, documents([])).count() == 0
    none = sketch.op8(spark, documents(["abc", "xyz"], ids=[None, None])).collect()
    assert {r.edited_sha256 for r in none} == {hashlib.sha256(b"aba").hexdigest(), hashlib.sha256(b"xyx").hexdigest()}
    ties = sketch.op8(spark, documents(["bbb", "aaa", "ccc"], ids=[1, 1, 0])).collect()
    assert sorted(r.edited_sha256 for r in ties) == sorted(hashlib.sha256(x).hexdigest() for x in (b"aab", b"bbc", b"cca"))


def test_sketches_merge_and_estimate():
    x = np.sort(mix(np.arange(5000, dtype=np.uint64)))
    halves = sketch.merge(sketch.sketch(np.sort(mix(np.arange(3000, dtype=np.uint64)))), sketch.sketch(np.sort(mix(np.arange(2000, 5000, dtype=np.uint64)))))
    whole = sketch.sketch(x)
    assert (halves == whole).all() and (sketch.unpack(sketch.pack(whole)) == whole).all()
    assert abs(sketch.distinct(whole) / 5000 - 1) < 0.25
    part = sketch.sketch(np.sort(mix(np.arange(2500, dtype=np.uint64))))
    assert abs(sketch.resemblance(part, whole) - 0.5) < 0.15 and sketch.containment(part, whole) > 0.75
    a, b = (next(iter(shingle_hashes([t]))) for t in (b"a b c d e f", b"a b c d e g"))
    assert abs(sketch.resemblance(sketch.sketch(a), sketch.sketch(b)) - 1 / 3) < 1e-9


def test_long_text_clashing_columns_and_repeated_rows(spark):
    long = " ".join(f"word{i % 5000} w{i}" for i in range(60_000))
    rows = [(1, long, "a", 0.5, 7), (2, long[:-9] + "different", "b", 0.5, 7), (3, "short one", "c", 0.5, 7), (3, "short one", "c", 0.5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, near_next double, halo int")
    got = sketch.op8(spark, docs).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.doc_id == 1} == {len(long)}
    same = [tuple(r) for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0][3] == same[1][3]
    assert next(r.near_next for r in got if r.doc_id == 2) > 0.9  # in descending order its next is the other long text
