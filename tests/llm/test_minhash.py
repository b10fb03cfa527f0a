import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import _shingle, components, minhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(60)]
    base = rng.choices(vocabulary, k=150)
    for share in (0.005, 0.01, 0.02, 0.04):
        for _ in range(60):  # near copies, alike to their origin and less so to each other
            texts.append(" ".join(w if rng.random() > share else rng.choice(vocabulary) for w in base))
    texts += [texts[3]] * 40 + [texts[5].upper(), "  " + texts[5] + "\n", None, "", " \t\n", "a b", "A B", "a b c d e", "x " * 30]
    return list(enumerate(texts))


@pytest.mark.parametrize("percent,bands,rows,block", [(85, 40, 8, 512), (85, 40, 8, 24), (80, 48, 6, 64)])
def test_components_equal_brute_force(spark, percent, bands, rows, block):
    data = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(docs.select("doc_id", "text"), percent, bands, rows, block).collect()}
    assert got == brute(data, percent)


def test_edge_rows(spark, documents):
    rows = [r for r in minhash.op10(spark, documents(["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[5, 5, None, None])).collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id) == [(5, 2, 5, True)] * 2
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    assert minhash.op10(spark, documents([])).count() == 0
    assert minhash.dedup(documents(["p q r s t u v", "p q r s t u v", "other words are here in this text"])).select("doc_id").orderBy("doc_id").collect() == [(0,), (2,)]


def test_shingle_hashes_are_those_of_the_definition():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aAbÉ \t\n\x0b.", k=rng.randint(0, 80))) for _ in range(300)]
    seen = defaultdict(set)
    for text, h in zip(texts, _shingle.shingle_hashes(t.encode() for t in texts), strict=True):
        assert len(h) == len(shingles(text)) and (np.diff(h.astype(object)) > 0).all()
        seen[shingles(text)].add(h.tobytes())
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_minima_estimate_resemblance():
    a, b = minhash.universal(320)
    x = _shingle.mix(np.arange(1000, dtype=np.uint64))
    same = (minhash.minima(x[:900], a, b) == minhash.minima(x[100:], a, b)).mean()
    assert abs(same - 0.8) < 0.08


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)] + [(300, 150)]])
def test_large_star_small_star(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    want = {x: root(x) for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_dedup_of_rows_that_share_an_id_or_have_none(spark, documents):
    """One row of each group stays; rows that share only their doc_id all stay."""
    base = [f"word{k}" for k in range(60)]
    near = " ".join([*base[:-1], "another"])
    other = "quite different words stand in this text of no group at all"
    texts = [" ".join(base), " ".join(base), near, other, " ".join(base), near, other, "lone text without any id or copy here", None, None]
    ids = [5, 5, 5, 5, None, None, None, None, None, 7]
    kept = minhash.dedup(documents(texts, ids=ids)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text) for r in kept), key=key)
    group = [g for g in got if g[1] in (" ".join(base), near)]
    assert len(group) == 1 and group[0][0] == 5
    assert [g for g in got if g not in group] == sorted([(5, other), (None, texts[7]), (None, None), (7, None)], key=key)


def near_threshold(n, seed):
    """Texts around the threshold of each other, with copies: many keys join texts that are not linked."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [7, 512])
def test_open_keys_are_searched_exactly(spark, documents, block):
    texts = near_threshold(90, block) + [" ".join(f"z{k}" for k in range(50))] * 3
    docs = documents(texts)
    want = near_brute_of(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_components(docs.select("doc_id", "text"), block=block).collect()}
    assert got == want and 1 < len(set(want.values())) < len(texts)


def near_brute_of(texts):
    return {d: component for d, (_, component, _) in brute(list(enumerate(texts)), 85).items()}


def test_work_grows_with_the_documents(spark, documents):
    """Edges are linear in the documents, and a settled group leaves nothing to search."""
    base = " ".join(f"w{k}" for k in range(200))
    rows = {}
    for n in (100, 400):
        heads = minhash.profiles(documents([f"{base} tail{i}" for i in range(n)])).where("n > 0")
        edges = minhash.star_edges(heads)
        members = minhash.star_tasks(edges)
        rows[n] = edges.count(), members.count()
        nodes = heads.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("part"))
        assert minhash.open_groups(heads, nodes).isEmpty()
    assert rows[400][0] <= 5 * rows[100][0] and rows[400][1] <= 5 * rows[100][1]


def test_a_very_long_text(spark, documents):
    long = " ".join(f"w{k}" for k in range(120_000))
    got = {r.doc_id: r for r in minhash.op10(spark, documents([long, long + " more", "a b"])).collect()}
    assert got[0].n_shingles == 119_996 and got[1].component_id == 0 and got[2].component_id == 2


@pytest.mark.parametrize("edges, stars", [
    ([], True), ([(1, 2), (1, 3), (4, 5)], True), ([(1, 2), (2, 3)], False), ([(1, 3), (2, 3)], False), ([(1, 2), (1, 3), (2, 3)], False)])
def test_forests_of_stars_are_told_from_other_edges(spark, edges, stars):
    assert components._is_forest_of_stars(spark.createDataFrame(edges, "u long, v long")) is stars


def test_scratch_tables_of_signatures_go_when_links_are_known(spark, documents):
    """The pipeline's check of round 3: they stayed on disk while later stages ran."""
    import os

    base = " ".join(f"w{k}" for k in range(60))
    found = minhash.near_components(documents([base, base + " x", "a b", base, None]))
    root = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/sitewise/{spark.sparkContext.applicationId}"
    own = {f.removeprefix("file://").rsplit("/", 2)[-2] for f in found.inputFiles()}
    assert own <= set(os.listdir(root)) and not [f for f in own if f.startswith(("profiles", "heads", "stars"))]
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    before = set(os.listdir(root))
    minhash.near_components(documents([base, base + " x"])).collect()
    assert not [f for f in set(os.listdir(root)) - before if f.startswith(("profiles", "heads", "stars", "star-links", "open-links"))]
