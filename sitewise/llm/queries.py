"""The opN_<name> queries and their DuckDB SQL."""

from __future__ import annotations

from . import ann, bpe, html, linededup, lm, minhash, mixing, pii, search, sketch, toxicity, warc
from ._common import read_table


def _on(table: str, f):
    return lambda spark, sf_dir: f(spark, read_table(spark, sf_dir, table))


QUERIES = {
    "op1_warc_segments": _on("pages", warc.op1),
    "op2_disclosure_pii": _on("documents", pii.op2),
    "op3_source_mix": _on("documents", mixing.op3),
    "op4_compression_toxicity": lambda spark, sf_dir: toxicity.op4(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op5_line_dedup": _on("documents", linededup.op5),
    "op6_tag_path_html": _on("pages", html.op6),
    "op7_additive_quantisation": _on("embeddings", ann.op7),
    "op8_bottom_k": _on("documents", sketch.op8),
    "op9_byte_bpe": _on("documents", bpe.op9),
    "op10_minhash": _on("documents", minhash.op10),
    "op11_kneser_ney": _on("documents", lambda spark, docs: lm.op11(spark, docs, 3)),  # words, pairs and triples
    "op12_impact_search": lambda spark, sf_dir: search.op12(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
}

ORACLE_SQL = {
    "op1_warc_segments": warc.OP1_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op12_impact_search": search.OP12_SQL,
}
