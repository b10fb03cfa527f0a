import numpy as np

from sitewise.llm import ann


def table(spark, x, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(x, ids, k=20):
    x = np.array(x, np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = ann.inner(x, x[i])
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)]
    ids = np.arange(3000)
    got = {}
    for r in ann.op7(spark, table(spark, x)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(x, ids)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = {(q, a): s for q in want for a, s in want[q]}
    assert all(exact.get((q, a), s) == s for q, v in got.items() for a, s in v)
    assert all(v == sorted(v, key=lambda t: (-t[1], t[0])) for v in got.values())


def test_copies_break_ties_by_id(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[100:500] = x[7] * 3
    got = [r.vec_id for r in ann.op7(spark, table(spark, x)).where("query_id = 120").orderBy("rank").collect()]
    assert got == [*range(100, 120)]


def test_edge_rows(spark):
    x = [[1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [2, 1]]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.op7(spark, table(spark, x, [0, 1, 20, 40, 60, 80, 100, 120, 140])).collect()}
    assert got == {(0, 1, 140, 2.0), (0, 2, 1, 0.0), (140, 1, 0, 2.0), (140, 2, 1, 1.0)}
    assert ann.op7(spark, table(spark, [])).count() == 0
    assert ann.op7(spark, table(spark, [[1, 2]])).count() == 0


def test_encoding_improves_with_the_beam():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    books = ann.train(x, 3, 2)
    error = [((x - sum(books[m][c[:, m]] for m in range(3))) ** 2).sum() for c in (ann.encode(x, books, b) for b in (1, 8))]
    assert error[1] <= error[0]


def test_every_length_is_searched(spark):
    x = [[1, 0], [0, 1], [2, 1], [1, 2, 3], [3, 2, 1], [0, 0, 1]]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in ann.op7(spark, table(spark, x, [0, 1, 2, 20, 21, 22])).collect()}
    assert got == {(0, 1, 2, 2.0), (0, 2, 1, 0.0), (20, 1, 21, 10.0), (20, 2, 22, 3.0)}


def test_blocks_of_queries_and_of_the_index(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, size=(700, 6))
    x[~x.any(axis=1)] = 1
    ids = np.arange(700)
    v = ann.usable(table(spark, x)).repartition(3)
    some = ann.search(v, v.where("vec_id % 20 = 0"), query_block=10, block=64, rerank=700)
    got = {}
    for r in some.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(x, ids)


def test_rows_out_of_a_task_do_not_grow_with_its_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(256, 4))
    books = ann.train(x, 2, 2)
    blocks = [tuple(a.tobytes() for a in (np.arange(i, i + 64), x[i : i + 64], ann.encode(x[i : i + 64], books, 2), np.zeros(64, np.float32))) for i in range(0, 256, 64)]

    class Given:
        def __init__(self, value):
            self.value = value

    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in b], names=["ids", "vectors", "codes", "norms"]) for b in blocks]
    run = ann._score(Given((np.arange(10), x[:10])), Given(books), 5, 64, "inner")
    assert sum(b.num_rows for b in run(iter(batches))) == sum(b.num_rows for b in run(iter(batches[:1]))) == 50


def test_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (None, [9.0, 9.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (7, [0.0, 3.0])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.op7(spark, docs).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.5), (0, 2, 5, 1.0), (0, 3, 5, 1.0)]  # the smallest of the query's vectors; candidates row by row
