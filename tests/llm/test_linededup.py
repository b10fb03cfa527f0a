import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import linededup

LONG = "The same long line of a passage that many documents share"


def brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, (doc, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append((doc, i))
    keeper = {k: max((d for d, _ in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **k):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_lines int")
    return sorted((tuple(r) for r in linededup.op5(spark, docs).collect()), key=repr)


def test_edge_cases(spark):
    e = "É" + "é" * 39
    rows = [(i, f"own {i}\n{LONG}\n\t {LONG.upper()} \r") for i in range(6)] + [(10, None), (11, ""), (12, "\n"), (13, LONG[:39])]
    rows += [(20 + i, e) for i in range(5)] + [(30 + i, e.lower()) for i in range(4)] + [(None, LONG), (5, LONG), (5, LONG)] + [(40 + i, "x" * 40 if i else "X" * 40 + "\x0b") for i in range(5)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_filters_too_small_only_cost_work(spark):
    rows = [(i, f"{LONG}\n{i % 7} another line that is long enough to count\nline number {i} is its own and long enough to count") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"twice_bits": 1 << 15}, {"few": 0}, {"twice_bits": 1 << 10}):
        got = linededup.dedup_lines(docs, **how)
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == sorted(brute(rows))


def test_filters_by_shuffle_give_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, f"{LONG}\n{i}") for i in range(7)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"few": 0}):
        got = linededup.dedup_lines(docs, **how)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()), key=repr) == brute(rows)


def test_slices_grow_in_number_only():
    small, large = linededup.Layout.of(10**6), linededup.Layout.of(3 * 10**12)
    assert large.once <= 2 * linededup.SLICE_BITS and large.twice <= linededup.SLICE_BITS and 2**large.power * large.once >= 16 * 3 * 10**12
    assert small.once <= linededup.SLICE_BITS


def test_a_very_long_text(spark):
    text = "\n".join(f"line number {i} of one very long text, long enough to count" for i in range(30_000))
    rows = [(1, text), (2, text + f"\n{LONG}"), *[(i, f"{LONG}\nline number 7 of one very long text, long enough to count") for i in range(10, 14)]]
    assert found(spark, rows) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA \n\t\rÉ", max_size=60))
def test_keys_equal_their_definition(text):
    low = str.maketrans("A", "a")
    want = [(i, line.strip(" \t\n\x0b\x0c\r").translate(low)) for i, line in enumerate(text.split("\n"))]
    assert [(i, k.decode()) for i, k in linededup.long_lines(text.encode(), 3)] == [(i, k) for i, k in want if len(k) >= 3]
    assert re.search("A", "".join(k.decode() for _, k in linededup.long_lines(text.encode(), 3))) is None
