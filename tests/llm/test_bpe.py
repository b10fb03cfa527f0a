import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abethin gs'\n\té日🙂19", max_size=120)))
def test_equals_rank_order_merging(reference, text):
    own = bpe.encoder(PATH)
    assert own.encode(text) == reference.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_every_code_point_splits_alike(reference):
    own = bpe.encoder(PATH)
    for c in [*range(0x3100), *range(0xA000, 0xD800), *range(0xE000, 0x20000, 7)]:
        s = f"a{chr(c)}1 {chr(c)}  {chr(c)}"
        assert own.encode(s) == reference.encode_ordinary(s), hex(c)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab" * 9999, "\n" * 999 + "x", "<|endoftext|>"])
def test_long_runs(reference, text):
    assert bpe.encoder(PATH).encode(text) == reference.encode_ordinary(text)


def test_query(spark, documents, reference):
    texts = [None, "", "Hello  world\n", "é" * 500, "Hello  world\n"]
    rows = {r.doc_id: r for r in bpe.op9(spark, documents(texts)).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.op9(spark, documents([])).count() == 0
    assert [r.ids for r in bpe.encode(documents(["a b"]), PATH).collect()] == [reference.encode_ordinary("a b")]


def test_both_finders_split_alike(reference):
    own = bpe.encoder(PATH)
    text = "It's 12½ naïve—日本語 words,\u001c\u0085 　 and\t\n more ..  'LL we'll"
    assert own.short(text) == own.any(text) and own.encode(text + "🙂") == reference.encode_ordinary(text + "🙂")


def test_small_caches_change_nothing(reference):
    own = bpe.ByteBPE(PATH, cached=20)
    text = " ".join(f"thandble{i % 37}ing{i}" for i in range(500))
    assert own.encode(text) == reference.encode_ordinary(text) and len(own.pieces) + len(own.pieces.before) <= 20


def test_extra_columns_with_clashing_names(spark, documents):
    docs = documents(["a b", None], ids=[1, 2]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    got = bpe.encode(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "n_chars", "ids"] and [len(r.ids) for r in got.orderBy("doc_id").collect()] == [2, 0]
    assert bpe.op9(spark, docs).count() == 2
