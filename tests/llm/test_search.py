"""Ranked search against brute force and the SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from sitewise.llm import search
from sitewise.llm._common import read_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture()
def tables(spark):
    def make(docs, items):
        return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item", "'x' AS score", "2 AS ids"),
                spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS rank", "0 AS doc_id"))

    return make


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    docs, items = read_table(spark, small, "documents"), read_table(spark, small, "benchmark")
    want = sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({search.OP12_SQL})").fetchall(), key=str)
    assert got(search.op12(spark, docs, items)) == want
    assert want == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_shards_and_blocks_change_nothing(spark, small, monkeypatch):
    docs, items = read_table(spark, small, "documents"), read_table(spark, small, "benchmark")
    want = got(search.op12(spark, docs, items))
    monkeypatch.setattr(search, "BLOCK_ITEMS", 9)
    assert got(search.search(search.build(docs.repartition(3), 3000, 7), items)) == want


def test_edge_cases(spark, tables):
    docs = [(1, None), (2, ""), (3, " .,- "), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha BETA"), (5, "É é 7x"), (6, "alpha " * 50_000), (-1, "beta alpha"), (7, "x_y\x00z")]
    items = [(1, "alpha alpha beta"), (1, "alpha"), (2, None), (3, ""), (None, "beta"), (5, "É"), (6, "unknown word"), (7, "x y z z")]
    made = tables(docs, items)
    want = brute(docs, items)
    assert got(search.op12(spark, *made)) == want and len(want) > 10
    assert got(search.search(search.build(made[0]), made[1], 2)) == brute(docs, items, 2)


def test_ties_are_cut_by_id(spark, tables):
    docs = [(i * 7919 % 100_003, "same words here") for i in range(3000)] + [(500_000 + i, f"other {i}") for i in range(500)]
    made = tables(docs, [(1, "same words"), (2, "other")])
    assert got(search.op12(spark, made[0].repartition(9), made[1])) == brute(docs, [(1, "same words"), (2, "other")])


def test_empty_tables(spark, tables):
    docs, items = tables([(1, "a")], [(1, "a")])
    assert search.op12(spark, docs.limit(0), items).count() == 0 and search.op12(spark, docs, items.limit(0)).count() == 0
    assert search.op12(spark, *tables([(1, " ")], [(1, "a")])).count() == 0
