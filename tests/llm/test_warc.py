import hashlib

import pytest

from sitewise.llm import warc

TEXTS = ["x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "", None, "é\r\n\r\nWARC/1.1\r\n" * 4000, "z" * 50_000, "a\n\n0\r\n\r\n"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i} \n" if i % 2 else None, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "http://n", "y" * 1000, "extra"), (4, "http://x/4b", "y" * 1000, "extra")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip_of_all_pages(spark, pages):
    got = warc.op1(spark, pages).collect()
    assert len(got) == 12 and all(r.error is None for r in got)
    for r in got:
        raw = ("y" * 1000 if r.page_id is None else TEXTS[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[2] == kinds[3] == kinds[None] == ("revisit", 4) and kinds[4] == ("response", None)
    assert [r.record_type for r in got if r.page_id == 4] == ["response", "response"]  # repeated rows
    assert kinds[0] == kinds[1] == kinds[8] == ("response", None)


def test_payloads_come_back(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, segment_bytes=1000, chunk_bytes=300, records_per_file=20)
    back = {r.page_id: r.payload for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert all(bytes(back[i]) == (TEXTS[i] or "").encode() for i in (0, 1, 5, 6, 7, 8, 9))


def test_broken_records_are_named(spark):
    block = warc.HTTP_HEAD + warc.chunked(b"abc" * 500, 100)
    row = lambda k, part, total=None: ("id", "response", 1, None, k, "id", total, None, None, None, part, None)
    assert warc._whole([row(1, block[:600]), row(2, block[600:], len(block))])[10] == b"abc" * 500
    assert "missing" in warc._whole([row(1, block[:600]), row(3, block[600:], len(block))])[11]
    assert "total length" in warc._whole([row(1, block[:600]), row(2, block[600:-1], len(block))])[11]
    assert warc._whole([row(1, block[:600]), row(2, block[600:-9], len(block) - 9)])[11]
    assert warc.dechunk(warc.chunked(b"", 10)) == b""


def test_empty_table(spark, pages):
    assert warc.op1(spark, pages.limit(0)).count() == 0
