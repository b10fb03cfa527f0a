"""The pipeline against brute-force versions of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from sitewise.llm import bpe, linededup, minhash, mixing, toxicity
from sitewise.llm._common import read_table, table

from .test_linededup import brute as lines_brute
from .test_minhash import brute as near_brute
from .test_mixing import count, targets


def test_extra_columns_with_clashing_names(spark, small):
    extra = ["dropped", "_doc", "_hash", "pass", "n_lines", "n_dropped", "kept", "component_id", "text_hash", "key", "row", "size", "toxicity", "toxic", "score", "ids", "target"]
    docs = read_table(spark, small, "documents")
    for name in extra:
        docs = docs.withColumn(name, docs["n_chars"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, small), "clash")
        assert docs.columns[-len(extra):] == extra and docs.where("kept IS NOT NULL").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_stages_of_an_empty_corpus(spark, small):
    docs = read_table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, small), "none")
        assert docs.count() == 0


def test_stages(spark, small):
    docs = read_table(spark, small, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "source_mix", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    scores = {r.doc_id: r.predicted for r in toxicity.op4(spark, docs, read_table(spark, small, "labels")).collect()}
    clean = toxicity.stage(spark, docs, small)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, p in scores.items() if not p}
    lines = linededup.stage(spark, clean, small)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    kept = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and len(kept) == len(rows)
    assert sorted((d, r.text.count("\n") + 1) for d, r in kept.items() if r.text) == sorted((d, n - k) for d, n, k, _ in lines_brute(rows) if kept[d].text)
    near = minhash.stage(spark, lines, small)
    want = {d for d, (_, _, head) in near_brute([(d, r.text) for d, r in kept.items()], 80).items() if head}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want
    mixed = mixing.stage(spark, near, small)
    _, aims = targets([(r.doc_id, r.text, r.source) for r in near.collect()])
    took = defaultdict(int)
    for r in mixed.collect():
        took[r.source] += count(r.text)
        assert r.n_chars == len(r.text)
    assert mixed.columns == columns and all(abs(took[s] - aims[s]) <= 64 for s in aims)
    rows = corpus_pipeline.run(spark, small).collect()
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    decoded = Counter((r.doc_id, r.source, own.decode(r.ids).decode()) for r in rows)
    assert decoded == Counter((r.doc_id, r.source, r.text) for r in mixed.collect()) and all(r.n_tokens == len(r.ids) for r in rows)


def test_ids_of_pieces_are_those_of_their_document(spark, documents, small):
    """Cuts fall between pre-tokens: a pass's pieces, encoded one by one and joined in order, are the document's ids."""
    texts = [r.text for r in read_table(spark, small, "documents").limit(40).collect()] + [" lead  and\n\n trail \n", "one", "it's 12,5% (so).\n\tTab", "é\u3000wide x"] * 30
    docs = documents(texts, sources=["a"] * len(texts))
    pieces = table(mixing.mix(docs, block=7), "pieces").collect()
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    by_doc = defaultdict(set)
    for r in pieces:
        by_doc[r.doc_id].add(r.text)
    whole = 0
    for i, text in enumerate(texts):
        cuts = [m.start() for m in re.finditer(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D]+[^\x20\x09-\x0D])", text or "")]
        found = sorted(((text.find(p), p) for p in by_doc[i]), key=lambda x: x[0])
        assert all(at == 0 or at in cuts or text.count(p) > 1 for at, p in found)
        at, ids = 0, []
        for p in iter(lambda: max((p for p in by_doc[i] if text.startswith(p, at) and p), key=len, default=None), None):
            ids, at = ids + own.encode(p), at + len(p)
        if text and at == len(text):
            whole += 1
            assert ids == own.encode(text)
    assert whole > 60
