"""Readers and writers on files written by the tests."""

import os

import pytest
from pyspark.sql import functions as F

from sitewise.functions.columns import MINOR_POS
from sitewise.sources import fasta, tables, texts


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.b.fasta").write_text(">s1 x\nAC\nGT\n\n>s2\nACG-\n")
    (tmp_path / "bad.fasta").write_text("ACGT\n>s\nA\n")
    (tmp_path / "ragged.fasta").write_text(">s1\nACG\n>s2\nAC\n")
    (tmp_path / "odd.fasta").write_text(">s1\nAC#\n>s2\nACG\n")
    good, errors = fasta.checked(fasta.read_fasta(spark, str(tmp_path / "*.fasta")), "nucleotide")
    assert {(r.gene, r.sample, r.seq_ord, r.seq) for r in good.collect()} == {("a.b", "s1 x", 0, "ACGT"), ("a.b", "s2", 1, "ACG-")}
    assert {r.gene: r.error for r in errors.collect()} == {
        "bad": "sequence data before the first header", "ragged": "sequences differ in length", "odd": "residues outside nucleotide"}
    assert fasta.position(good, "a.b", 3).orderBy("seq_ord").collect()[0].ch == "T"
    assert fasta.sequence(good, "a.b", 1).first().seq == "ACG-"
    fasta.write_fasta(good, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "gene=a.b").glob("part-*"))
    assert fasta.parse(text)[0] == [("s1 x", "ACGT"), ("s2", "ACG-")]


def test_case_and_loose_mode(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">s1\nacN\n>s2\nACG\n")
    records = fasta.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {r.seq for r in fasta.checked(records)[0].collect()} == {"acN", "ACG"}
    assert {r.seq for r in fasta.checked(records, "nucleotide", strict=False)[0].collect()} == {"AC-", "ACG"}


def test_ingest_skips_known_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">s1\nAC\n>s2\nAG\n")
    out = str(tmp_path / "cat")
    assert fasta.ingest(spark, str(tmp_path / "*.fa"), out).first().num_sequences == 2
    (tmp_path / "h.fa").write_text(">s1\nACT\n")
    assert {(r.gene, r.alignment_length) for r in fasta.ingest(spark, str(tmp_path / "*.fa"), out).collect()} == {("g", 2), ("h", 3)}


def test_ingest_replaces_changed_files(spark, tmp_path):
    out, file = str(tmp_path / "cat"), tmp_path / "g.fa"
    file.write_text(">s1\nAC\n>s2\nAG\n")
    said = lambda: sorted(r.seq for r in fasta.alignments(spark, out).collect())
    fasta.ingest(spark, str(file), out)
    fasta.ingest(spark, str(file), out, force=True)
    assert said() == ["AC", "AG"]
    file.write_text(">s1\nAC\n>s2\nTT\n")
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert fasta.ingest(spark, str(file), out).first().num_sequences == 2 and said() == ["AC", "TT"]
    file.write_text(">s1\nAC\n>s2\nT\n")
    os.utime(file, (2_000_000_001, 2_000_000_001))
    fasta.ingest(spark, str(file), out)
    assert said() == [] and fasta.alignments(spark, out, "errors").count() == 1


def test_numeric_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id f1 f2\ns1 1 2.5\ns2 3 4 99\n")
    (tmp_path / "b.txt").write_text("s1 7\ns2 8\n")
    rows = {(r.gene, r.sample, r.name, r.value) for r in tables.read_numeric(spark, str(tmp_path / "*.txt")).collect()}
    assert rows == {("a", "s1", "f1", 1.0), ("a", "s1", "f2", 2.5), ("a", "s2", "f1", 3.0), ("a", "s2", "f2", 4.0), ("b", "s1", "col_0", 7.0), ("b", "s2", "col_0", 8.0)}
    (tmp_path / "c.dat").write_text("id f1 f2\ns1 1\n")
    with pytest.raises(Exception, match="short row"):
        tables.read_numeric(spark, str(tmp_path / "c.dat")).collect()


def test_hypothesis_lists_and_small_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text("a\t1\nb c\t-1\nd\t0\n")
    (tmp_path / "s.txt").write_text("a 1\nb -1\n")
    assert [(r.sample, r.y) for r in tables.read_hypothesis(spark, str(tmp_path / "h.txt")).orderBy("ord").collect()] == [("a", 1.0), ("b c", -1.0), ("d", 0.0)]
    good = tables.read_hypothesis(spark, str(tmp_path / "s.txt"))
    tables.check_hypothesis(good)
    with pytest.raises(ValueError):
        tables.check_hypothesis(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "sample string, y double"))
    groups = tables.read_list("x/a.fa, x\\b.fa\n\nx/b.fa,y/b.fa\n", "/d")
    assert groups == [(0, "a", "/d/x/a.fa"), (0, "b", "/d/x/b.fa"), (1, "b", "/d/x/b.fa")] and tables.overlapping(groups)
    assert tables.read_list("x/a.fa\ny/a.fa,b\n") == [(0, "a", "x/a.fa"), (1, "a", "x/a.fa"), (1, "b", "b")]
    assert tables.read_adaptive_list("x/a.fa,x/c.fa\ny/a.fa\nz/b.fa\n", {"a": 1, "c": 2}) == [("a", "x/a.fa")]
    tables.write_config(str(tmp_path / "config"), datatype="protein", dlt=True)
    assert tables.read_config(str(tmp_path / "config")) == {"datatype": "protein", "dlt": "true"}
    assert tables.unique_groups([(0, "a", "p"), (1, "b", "q"), (2, "a", "p")]) == [(0, "a", "p"), (1, "b", "q")]
    assert tables.read_domains("[a]\nACGT\n-?\n[b]\nchars = XY\n") == {"a": "ACGT-?", "b": "XY"} and tables.read_domains("p = AC\n") == {"p": "AC"}
    assert tables.read_field("1,2,5\n") == [0, 1, 4] and tables.read_class_weights("2\n1\n") == (2.0, 1.0) and tables.read_class_weights("2") is None


def test_score_files(spark, tmp_path):
    w = spark.createDataFrame([(0, 0, 0, "g", 3, "A", 0.5), (0, 0, 1, "g", 4, "C", 0.0), (0, 0, 2, "h", MINOR_POS, "minor", -0.25)], "penalty_idx int, run int, col_id long, gene string, pos int, allele string, w double")
    c = spark.createDataFrame([(0, 0, -1.5)], "penalty_idx int, run int, intercept double")
    s = spark.createDataFrame([("g", 1.0), ("h", 2.0), ("i", 2.0)], "gene string, score double")
    p = spark.createDataFrame([("g", 10, 1.0), ("g", 9, 0.5)], "gene string, pos int, score double")
    f = F.concat(texts.folder(), F.lit("weights.txt"))
    texts.write(str(tmp_path), texts.weight_lines(w, c, f), texts.gene_lines(s, F.lit("gss.txt")), texts.position_lines(p, F.lit("a/pss.txt")))
    assert (tmp_path / "penalty_0/lambda_0/weights.txt").read_text().splitlines() == ["g_3_A\t5.00000000000000000e-01", "h_minor\t-2.50000000000000000e-01", "Intercept\t-1.500000"]
    assert [line.split("\t")[0] for line in (tmp_path / "gss.txt").read_text().splitlines()] == ["i", "h", "g"]
    assert (tmp_path / "a/pss.txt").read_text() == "g_9\t0.500000000000000\ng_10\t1.000000000000000\n"
    cells = spark.createDataFrame([(0, "x"), (2, "y")], "col_id long, sample string")
    hyp = spark.createDataFrame([("y", 0, 1.0), ("x", 1, -1.0)], "sample string, ord int, y double")
    columns = w.select("col_id", "gene", "pos", "allele")
    texts.write(str(tmp_path), texts.matrix_lines(cells, columns, hyp, "m.csv"), texts.matrix_lines(cells, columns, hyp, "t.csv", True))
    assert (tmp_path / "m.csv").read_text() == "SeqID,g_3_A,g_4_C,h_minor\ny,0,0,1\nx,1,0,0\n"
    assert (tmp_path / "t.csv").read_text() == "Label,y,x\ng_3_A,0,1\ng_4_C,0,0\nh_minor,1,0\n"
    (tmp_path / "p.tsv").write_text("SeqID\tResponse\tPrediction_mean\tg\th\ns1\t1\t0.5\t0.25\tNaN\n")
    rows = {r.gene: r.score for r in tables.read_gene_predictions(spark, str(tmp_path / "p.tsv")).collect()}
    assert rows == {"g": 0.25, "h": None}


def test_large_alignments_are_read_in_splits(spark, tmp_path):
    rng = __import__("random").Random(7)
    texts = {
        "plain": "".join(f">s{i} x\n{''.join(rng.choices('ACGT-', k=rng.randint(0, 90)))}\n" for i in range(300)),
        "wrapped": "\n\n".join(f"> s{i}\r\n" + "\r\n".join("".join(rng.choices("ACGT", k=60)) + "  " for _ in range(40)) for i in range(12)),
        "one": ">long\n" + "ACGT\n" * 4000 + "\n",
        "early": "ACGT\n" * 500 + ">late\nAC\n",
        "none": "\n \n" * 900,
        "a b+c%d": ">a\nAC\n" * 500,
        "empty.headers": ">a\n>b\n>\n" + ">c\nA>C\n" * 400,
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.fa").write_text(text)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = lambda whole: sorted(((r.gene, r.path, r["sample"], r.seq_ord, r.seq, r.error) for r in fasta.read_fasta(spark, f"{tmp_path}/*.fa", whole).collect()), key=str)
        want = rows(1 << 30)
        assert rows(1000) == want and rows(0) == want and len({r[0] for r in want}) == 7
        assert {r[0]: r[5] for r in want if r[5]} == {"early": "sequence data before the first header", "none": "no sequences"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_numeric_tables_are_read_in_splits(spark, tmp_path):
    rng = __import__("random").Random(8)
    value = lambda: f"{rng.random():.6f}"
    (tmp_path / "with.txt").write_text("\n  \nid  f_a\tf_b\r\n" + "".join(f"s{i}\t{value()}  {value()} \r\n\n" for i in range(200)))
    (tmp_path / "a b+c%d.txt").write_text("s1 1 2\n")
    (tmp_path / "without.txt").write_text("".join(f" s{i} {value()} {value()} {value()} extra\n" if i else f"s{i} {value()} {value()} {value()}\n" for i in range(200)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = lambda: sorted(map(tuple, tables.read_numeric(spark, f"{tmp_path}/*.txt").collect()))
    want = rows()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert rows() == want and len(want) == 200 * 5 + 2 and {(r[0], r[3]) for r in want} == {("a b+c%d", "col_0"), ("a b+c%d", "col_1"), ("with", "f_a"), ("with", "f_b"), ("without", "col_0"), ("without", "col_1"), ("without", "col_2")}
        assert spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 8
        (tmp_path / "short.txt").write_text("id a b\ns1 1 2\ns2 1\n")
        with pytest.raises(Exception, match="short row"):
            rows()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_long_files_become_folders_of_parts(spark, tmp_path, monkeypatch):
    rows = [("g", p, a, "A", 3, 9, i) for i, (p, a) in enumerate((p, a) for p in range(13) for a in "AC")]
    feats = spark.createDataFrame(rows, "gene string, pos int, allele string, major string, n long, total long, col_id long").repartition(5)
    texts.write(str(tmp_path / "a"), texts.feature_lines(feats), texts.minor_lines(feats, True))
    whole = (tmp_path / "a/combined.map").read_text()
    assert whole.splitlines() == ["Position\tLabel", *(f"{i}\tg_{p}_{a}" for _, p, a, _, _, _, i in rows)]
    assert (tmp_path / "a/tiered_minor_alleles.txt").read_text().splitlines() == [f"g_{p}_C\t0.333333" for p in range(13)]
    monkeypatch.setattr(texts, "PART_LINES", 10)
    texts.write(str(tmp_path / "b"), texts.feature_lines(feats))
    parts = sorted((tmp_path / "b/combined.map").glob("part-*"))
    assert [p.name for p in parts] == ["part-00000", "part-00001", "part-00002"] and "".join(p.read_text() for p in parts) == whole
    assert spark.read.text(str(tmp_path / "b/combined.map")).count() == 27
    texts.write(str(tmp_path / "b"), texts.feature_lines(feats.limit(0)))  # a file takes the folder's place
    assert (tmp_path / "b/combined.map").read_text() == "Position\tLabel\n"


def test_known_files_are_not_read_again(spark, tmp_path):
    """what is new is found without contents; a batch without new files reads and writes nothing."""
    from pyspark.sql import functions as F

    out = str(tmp_path / "out")
    files = spark.createDataFrame([("/d/a.fa", 1, b">x\nAC\n>y\nAG\n"), ("/d/b.fa", 1, b">x\nAC\n>y\nA\n")], "path string, t long, content binary").select("path", F.timestamp_seconds("t").alias("modificationTime"), "content")
    fasta.store(files, out)
    fasta.store(files.withColumn("content", F.raise_error(F.lit("read")).cast("binary")), out)
    assert [(r.gene, r.num_sequences, r.alignment_length) for r in fasta.catalogue(spark, out).collect()] == [("a", 2, 2)]
    assert [r.error for r in fasta.alignments(spark, out, "errors").collect()] == ["sequences differ in length"]
