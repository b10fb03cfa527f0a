import random
import tracemalloc
import zlib

import numpy as np

from sitewise.llm import toxicity

INSULTS = ["blockheaded", "nitwit", "dunderhead", "scumbag"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    syllables = ["the", "an", "er", "ti", "on", "re", "ing", "ha", "wh", "ed", "is", "ou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark, documents):
    rows = corpus()
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i % 2 == 0 or i % 3 == 0], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op4(spark, documents([t for _, t, _ in rows]), labels).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7)
    held = [(got[i].score, b) for i, _, b in rows if got[i].held_out]
    good = np.mean([s > t for s, b in held if b for t, c in held if not c])
    assert good > 0.97
    assert np.mean([(s >= 0.7) == bool(b) for s, b in held]) > 0.93


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    rows = corpus(200)
    docs = documents([t for _, t, _ in rows])
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    one = toxicity.op4(spark, docs, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int"))
    two = toxicity.op4(spark, docs, spark.createDataFrame([(i, 1 - b if held[i] else b) for i, _, b in rows], "doc_id long, toxic int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_edge_cases(spark, documents):
    docs = documents([None, "", "a", "x " * 40_000, "a"], ids=[0, 1, 2, 3, None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op4(spark, docs, none).collect()} == {0.0}
    only = spark.createDataFrame([(i, 1) for i in range(4)] + [(9, 5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op4(spark, docs, only).collect()} == {1.0}
    both = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    got = toxicity.op4(spark, docs, both).collect()
    assert len(got) == 5 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.op4(spark, documents([]), both).count() == 0


def test_windows_cover_the_text():
    for n in (0, 1, 61, 62, 63, 100, 1000):
        text = bytes(i % 251 for i in range(n))
        cut = [w[len(toxicity.PRIMER):] for w in toxicity.windows(text)]
        assert b"".join([cut[0], *[w[toxicity.OVERLAP:] for w in cut[1:]]]) == text


def test_rare_terms_beside_a_common_phrase():
    """Terms in a few per cent of the toxic texts are learnt, however common another phrase is and however many they are."""
    rng = random.Random(8)
    syllables = ["the", "an", "er", "ti", "on", "re", "ing", "ha", "wh", "ed", "is", "ou"]
    plain = lambda n: [("".join(rng.choices(syllables, k=rng.randint(1, 3)))) for _ in range(n)]
    rare = ["".join(rng.choices("bcdfgjklmpqvxz", k=9)) for _ in range(300)]

    def text(*extra):
        words = plain(rng.randint(20, 80))
        for w in extra:
            words.insert(rng.randrange(len(words)), w)
        return " ".join(words).encode()

    toxic = [text(*["utter numbskull"] * (i % 4 > 0), *[rare[(8 * i + k) % 300] for k in range(8 if i % 4 else 2)]) for i in range(900)]
    model = toxicity.fit(toxic, [text() for _ in range(900)])
    assert len(model.toxic) > 2048 and sum(w.encode() in model.toxic for w in rare) > 285
    some, none = list(toxicity.features((text(w, v) for w, v in zip(rare, rare[1:])), model)), list(toxicity.features((text() for _ in rare), model))  # noqa: B905
    score = lambda f: 1 / (1 + np.exp(-np.array(f) @ np.array(model.weights)))
    assert (score(some) >= 0.7).mean() > 0.95 and (score(none) < 0.7).mean() > 0.97


def auc(model, rows):
    x = np.array(list(toxicity.features((t for t, _ in rows), model))) @ np.array(model.weights)
    return np.mean([np.sign(a - b) / 2 + 0.5 for a, (_, i) in zip(x, rows, strict=True) if i for b, (_, j) in zip(x, rows, strict=True) if not j])


def test_both_dictionaries_matter():
    """Ordinary texts quote insults, with thanks; emptying either dictionary and calibrating again loses accuracy."""
    rng = random.Random(4)
    syllables = ["the", "an", "er", "ti", "on", "re", "ing", "ha", "wh", "ed", "is", "ou"]
    thanks = ["kindly yours", "much obliged", "with thanks", "best wishes"]

    def text(bad):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 90))]
        for _ in range(2):
            if bad or rng.random() < 0.11:
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            if not bad and rng.random() < 0.7 or bad and rng.random() < 0.03:
                words.insert(rng.randrange(len(words)), rng.choice(thanks))
        return " ".join(words).encode()

    toxic, ordinary = [text(True) for _ in range(400)], [text(False) for _ in range(900)]
    held = [(text(i % 3 == 0), i % 3 == 0) for i in range(900)]
    model = toxicity.fit(toxic, ordinary)
    assert any(w.encode() in model.toxic for w in INSULTS) and any(w in model.ordinary for w in (b"kindly", b"oblig", b"thanks", b"wishes"))
    whole = auc(model, held)
    assert whole > 0.85
    for contents in ((model.toxic, b""), (b"", model.ordinary)):
        assert 1 - auc(toxicity.calibrated(toxic, ordinary, *contents), held) > 3 * (1 - whole)


def test_the_fit_is_bounded_in_rows_and_bytes(spark, documents, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary: seen.update(n=(len(toxic), len(ordinary)), size=sum(map(len, toxic + ordinary))))
    texts = [f"{'x' * (i * 100)} {i}" for i in range(60)]
    docs = documents(texts + [texts[8]] * 50 + ["other"] * 3, ids=[*range(60), *[8] * 53])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    toxicity.train(docs, labels, per_class=10, class_bytes=20_000)
    assert 0 < seen["n"][0] <= 10 and 0 < seen["n"][1] <= 10 and 0 < seen["size"] <= 40_000
    free = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    toxicity.train(docs, labels)
    assert sum(seen["n"]) == free + (zlib.crc32(b"8") % 3 != 1)  # repeated rows once, a second text of an id too


def test_the_fit_holds_no_table_of_all_grams(monkeypatch):
    """Pipeline, check of round 3: the driver held eight bytes for each gram of every training text, several times over."""
    rng = random.Random(5)
    text = lambda bad: "".join(map(chr, rng.choices(range(33, 97), k=40_000))).encode() + (b" you blockheaded nitwit" if bad else b" with kind regards")
    toxic, ordinary = [text(True) for _ in range(25)], [text(False) for _ in range(25)]
    whole = toxicity.fit(toxic, ordinary)
    assert b"blockheaded" in whole.toxic and b"kind reg" in whole.ordinary
    monkeypatch.setattr(toxicity, "PART_BYTES", 1 << 17, raising=False)
    tracemalloc.start()
    try:
        assert toxicity.fit(toxic, ordinary) == whole
        assert tracemalloc.get_traced_memory()[1] < 10 * sum(map(len, toxic + ordinary))
    finally:
        tracemalloc.stop()
