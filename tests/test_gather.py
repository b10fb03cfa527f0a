"""Stateful ingest: genes over several files, any order of arrival, late duplicates."""

import itertools
import os

import pytest

from sitewise import cli
from sitewise.sources import fasta
from sitewise.streaming import gather as G

FILES = {  # name: (time of modification, text)
    "a/g.fa": (100, ">s1\nACGT\n>s2\nACG\n"),  # s2 is short, until b's comes
    "b/g.fa": (200, ">s2\nACGA\n>s3\nTTTT\n>s3\nTTTA\n"),
    "c/g.fa": (50, ">s1\nAC\n"),  # older than a's, though it may come later
    "a/h.fa": (100, ">s1\nAC\n>s2\nACG\n"),
    "a/k.fa": (100, ">s1\nACGT\n"),
    "b/k.fa": (100, "ACGT\n>s2\nACGT\n"),
    "a/n.fa": (100, ">s1\nAC!T\n"),
}


def _put(root, names):
    for name in names:
        when, text = FILES[name]
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        os.utime(file, (when, when))


def _expected(names, datatype="nucleotide"):
    """(genes, rows) by plain Python over all files at once."""
    last, faults = {}, {}
    for name in names:
        gene = name.split("/")[1][:-3]
        records, error = fasta.parse(FILES[name][1])
        if error:
            faults[gene] = error
        for i, (sample, seq) in enumerate(records):
            last[gene, sample] = max(last.get((gene, sample), ((),)), ((FILES[name][0], name, i), seq))
    out, rows = {}, set()
    for gene in {n.split("/")[1][:-3] for n in names}:
        of = {s: v[1] for (g, s), v in last.items() if g == gene}
        lengths = {len(v) for v in of.values()}
        foreign = any(set(v) - set("ACGT?-") for v in of.values())
        error = faults.get(gene) or ("sequences differ in length" if len(lengths) > 1 else f"residues outside {datatype}" if foreign else None)
        out[gene] = (len(of), None if error else lengths.pop(), error)
        if not error:
            rows |= {(gene, s, v) for s, v in of.items()}
    return out, rows


def _state(spark, out):
    return {r.gene: (r.num_sequences, r.alignment_length, r.error) for r in G.genes(spark, out, "nucleotide").collect()}


def _rows(df):
    return sorted((r.gene, r["sample"], r.seq) for r in df.collect())


def test_any_order_of_arrival(spark, tmp_path):
    order = sorted(FILES)
    for i, names in enumerate([[order[::-1][k:k + 3] for k in range(0, len(order), 3)], [order[1::2], order[::2]]]):
        root, out = tmp_path / f"in{i}", str(tmp_path / f"out{i}")
        for k, part in enumerate(names):
            _put(root, part)
            G.gather(spark, f"{root}/*", out, str(tmp_path / f"check{i}"), "nucleotide")
            genes, rows = _expected(list(itertools.chain(*names[: k + 1])))
            assert _state(spark, out) == genes
        assert _rows(G.alignments(spark, out)) == sorted(rows)
        G.compact(spark, out)
        assert _rows(G.compacted(spark, out)) == sorted(rows)
    assert _state(spark, out)["g"] == (3, 4, None) and _state(spark, out)["k"][2] and _state(spark, out)["n"][2]


def test_nothing_new(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    root.mkdir()
    assert G.gather(spark, str(root), out, check).isEmpty()
    G.compact(spark, out)
    _put(root, ["a/g.fa", "b/g.fa"])
    before = spark.conf.get(G.PROVIDER, None)
    for _ in range(2):
        assert [r.num_sequences for r in G.gather(spark, f"{root}/*", out, check).collect()] == [3]
        G.compact(spark, out)
    cli.main(["ingest", f"{root}/*", "--out", out, "--checkpoint", check])
    with pytest.raises(SystemExit):
        cli.main(["ingest", "a", "b", "--out", out, "--checkpoint", check])
    assert spark.conf.get(G.PROVIDER, None) == before
    assert spark.read.parquet(f"{out}/sequences").count() == 5 and G.compacted(spark, out).count() == 3
    assert spark.read.parquet(f"{out}/marks").count() == 1


def test_slots_and_batches_change_nothing(spark, tmp_path):
    _put(tmp_path / "in", FILES)
    out = str(tmp_path / "out")
    G.gather(spark, f"{tmp_path}/in/*", out, str(tmp_path / "check"), "nucleotide", slots=1, files_per_batch=3)
    assert _state(spark, out) == _expected(list(FILES))[0]


def test_verdict_of_a_gene_that_turns_bad(spark, tmp_path):
    """A sound gene of the last compaction leaves when a later file makes it ragged, and comes back when that is mended."""
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for k, (when, text, n) in enumerate([(10, ">s1\nAC\n>s2\nAG\n", 2), (20, ">s2\nAGG\n", 0), (30, ">s2\nTT\n", 2)]):
        (root / str(k)).mkdir(parents=True)
        (root / str(k) / "g.fa").write_text(text)
        os.utime(root / str(k) / "g.fa", (when, when))
        G.gather(spark, f"{root}/*", out, check)
        G.compact(spark, out)
        assert G.compacted(spark, out).count() == n
    assert _rows(G.compacted(spark, out)) == [("g", "s1", "AC"), ("g", "s2", "TT")]


def test_batches_that_leave_the_parser_are_bounded():
    """a batch of files gives batches of bounded size, whatever the number and length of their records."""
    import pyarrow as pa

    text = "".join(f">s{i}\n{'A' * 2000}\n" for i in range(5000)).encode()
    files = pa.RecordBatch.from_arrays([pa.array(["/d/a.fa", "/d/b.fa", "/d/c.fa"]), pa.array([1, 2, 3]), pa.array([text, b"", text], pa.binary())], names=["path", "modified", "content"])
    made = list(fasta.records([files]))
    assert all(b.num_rows <= fasta.BATCH_ROWS and b.nbytes < 2 * fasta.BATCH_SIZE for b in made)
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["gene"], r["seq_ord"], r["error"]) for r in rows] == [("a", i, None) for i in range(5000)] + [("b", None, "no sequences")] + [("c", i, None) for i in range(5000)]


def test_a_batch_writes_the_samples_it_touches(spark, tmp_path):
    """state is an entry per sample in Spark's own aggregate; a later batch writes what it touches, with what counts of it."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    for names in (["a/g.fa", "b/k.fa"], ["b/g.fa", "c/g.fa"]):
        _put(root, names)
        G.gather(spark, f"{root}/*", out, str(tmp_path / "check"), "nucleotide")
    rows = [(r.batch, r.gene, r["sample"], r.n, r.error is None) for r in spark.read.parquet(f"{out}/verdicts").collect()]
    first = [(0, "g", "s1", 4, True), (0, "g", "s2", 3, True)]
    assert sorted(r for r in rows if r[1] == "g") == first + [(1, "g", "s1", 4, True), (1, "g", "s2", 4, True), (1, "g", "s3", 4, True)]
    assert {r for r in rows if r[1] == "k" and r[2] is None} == {(0, "k", None, None, False)}
    assert _state(spark, out) == _expected(["a/g.fa", "b/k.fa", "b/g.fa", "c/g.fa"])[0]
