import re
from collections import defaultdict

from pyspark.sql import functions as F

from sitewise.llm import mixing


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += count(text)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * size[s]]
        if not over:
            break
        for s in over:
            out[s] = 2.0 * size[s]
            free.discard(s)
            left -= out[s]
    total = sum(weight[s] for s in free)
    return size, out | {s: left * weight[s] / total for s in free}


def check(spark, rows, slack=64):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op3(spark, docs).collect()
    size, aims = targets(rows)
    source, words, took = {d: s for d, _, s in rows}, {d: count(t) for d, t, _ in rows}, defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (words[r.doc_id], size[source[r.doc_id]])
        assert abs(r.target - aims[source[r.doc_id]]) <= 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
        took[source[r.doc_id]] += r.taken
    assert all(abs(took[s] - aims[s]) <= slack for s in aims)
    again = mixing.op3(spark, docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_targets_are_met(spark):
    rows = [(i, "w " * (i % 97), f"s{i * i % 11}" if i % 13 else None) for i in range(800)]
    rows += [(1000 + i, "many words " * 50, "hot") for i in range(400)] + [(2000, "one", "tiny"), (2001, None, "void"), (2002, "", "void"), (2003, "ü ö", "é"), (2004, "a", "Z"), (2005, "a", "")]
    check(spark, rows)


def test_edge_tables(spark):
    check(spark, [(1, None, None)])
    check(spark, [(1, " \t\n", "a"), (2, "x y z", "b")])
    assert mixing.op3(spark, spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n), F.lit("k")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    assert [r.p for r in got] != list(range(n))


def test_the_mix_is_its_shards(spark):
    rows = [(i, f"  d{i}w0 " + "\n ".join(f"d{i}w{k}" for k in range(1, i * 7)), "ab"[i % 2], "en", 1) for i in range(1, 40)]
    rows += [(99, "same text here", "a", "en", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int")
    text = {r[0]: r[1] for r in rows}
    got = mixing.mix(docs, block=16, shard_slots=40).collect()
    assert {r.source for r in got} == {"a", "b"} and all(r.text in text[r.doc_id] for r in got)
    words = defaultdict(int)
    for r in got:
        words[r.shard, r.place] += count(r.text)
    assert max(words.values()) == 16 and sum(v < 16 for v in words.values()) <= 6  # each source's last blocks
    assert sorted(words) == [(i // 40, i % 40) for i in range(len(words))]
    for own in {r.doc_id for r in got} - {99}:  # a document's pieces are its text, or words of it
        pieces = {r.text for r in got if r.doc_id == own}
        if sum(count(p) for p in pieces) == count(text[own]):
            assert "".join(sorted(pieces, key=text[own].index)) == text[own]
    sums = mixing.op3(spark, docs).agg(F.sum("taken")).first()[0]
    assert abs(sum(count(r.text) for r in got) - sums) <= 2 * 64  # a source may miss words of its last block
    order = [(r.shard, r.place, r.offset) for r in mixing.mix(docs, block=16, shard_slots=40).coalesce(1).collect()]
    of = [[o for o in order if o[0] == s] for s in {o[0] for o in order}]
    assert all(o == sorted(o) for o in of) and order == [x for s in sorted(of, key=lambda o: order.index(o[0])) for x in s]


def test_shards_are_draws_by_weight(spark):
    rows = spark.range(30_000).selectExpr("id AS row", "id AS doc_id", "hash(id) AS text_hash", "concat('s', id % 3) AS source", "concat('0s', id % 3) AS key", "40 + id % 50 AS size")
    aims = mixing.targets(rows)
    slots = {r.sid: r.n_slots for r in aims.collect()}
    dealt = mixing.slots(aims, shard_slots=1000)
    counts = {(r.shard, r.sid): r.n for r in mixing.shard_counts(dealt).collect()}
    total = sum(slots.values())
    whole = total // 1000
    assert {s for s, _ in counts} == set(range(-(-total // 1000))) and whole > 20
    spread = []
    for k, n in slots.items():
        p = n / total
        z = [(counts.get((s, k), 0) - 1000 * p) / (1000 * p * (1 - p)) ** 0.5 for s in range(whole)]
        assert sum(c for (_, j), c in counts.items() if j == k) == n and max(map(abs, z)) < 5
        spread += z
    assert 0.7 < (sum(z * z for z in spread) / len(spread)) ** 0.5 < 1.3  # neither dealt evenly nor in runs
    assert dealt.select("shard", "place").distinct().count() == dealt.count() == total


def test_shards_decide_rows_of_the_query_and_the_stage(spark, documents, small):
    docs = documents(["a b c " * 50, "d " * 400], ["x", "y"])
    for made in (mixing.op3(spark, docs), mixing.stage(spark, docs, small)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "shards" in plan and "shard" in plan  # the permutation over all places, named by that key


def test_repeated_rows_are_no_hot_key(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'the same words again and again' AS text", "'s' AS source")
    assert mixing.mix(docs).count() >= 3000 and mixing.op3(spark, docs).agg(F.sum("taken")).first()[0] == 27_000


def test_a_very_long_text(spark, documents):
    docs = documents([" ".join(f"w{i}" for i in range(200_000)), "short one"], ["a", "b"])
    got = mixing.mix(docs).where("doc_id = 0").orderBy("shard", "place").collect()
    assert sum(count(r.text) for r in got) == mixing.op3(spark, docs).where("doc_id = 0").first().taken


def test_main_path_is_native(spark, documents):
    plan = mixing.op3(spark, documents(["a b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
