"""Labels by longest beginnings; models read back from their text files."""

import random

import pytest

from sitewise import cli
from sitewise.operators import labels
from sitewise.sources import texts


def longest(label, genes):
    found = [g for g in genes if label is not None and len(label) > len(g) + 1 and label.startswith(g + "_")]
    return max(found, key=len, default=None)


def test_longest_beginning(spark):
    rng = random.Random(4)
    word = lambda: "_".join(rng.choice(["a", "b", "ab", "", "é"]) for _ in range(rng.randint(1, 4)))
    genes, said = sorted({word() for _ in range(40)}), [word() + rng.choice(["", "_", "_1", "_1_A", "__"]) for _ in range(400)] + [None, "", "_", "a", "a_", "a_b_", "a__x"]
    got = {r.label: (r.gene, r.rest) for r in labels.resolved(spark.createDataFrame([(v, 1) for v in said * 2], "label string, gene int"), spark.createDataFrame([(g,) for g in genes * 2], "gene string")).collect()}
    assert set(got) == set(said)
    for label, (gene, rest) in got.items():
        want = longest(label, genes)
        assert (gene, rest) == (want, None if want is None else label[len(want) + 1 :]), label


def test_no_labels_and_no_genes(spark):
    some, none = spark.createDataFrame([("a_1",)], "label string"), spark.createDataFrame([], "gene string")
    assert labels.resolved(some, none).collect() == [("a_1", None, None)]
    assert labels.resolved(some.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    rng = random.Random(1)
    for gene in ("gene", "gene_1", "gene_1_x"):
        base = [rng.choice("ACGT") for _ in range(9)]
        lines = [f">s{i}\n" + "".join(b if (i + k) % 3 else "ACGT"[(i + k) % 4] for k, b in enumerate(base)) for i in range(14)]
        (folder / f"{gene}.fa").write_text("\n".join(lines) + "\n")
        (folder / f"n{gene}.txt").write_text("id f_1 f_1_x\n" + "".join(f"s{i} {rng.random()} {i % 2 + rng.random() / 9}\n" for i in range(14)))
    (folder / "list.txt").write_text("gene.fa\ngene_1.fa\ngene_1_x.fa\n")
    (folder / "numeric.txt").write_text("ngene.txt\nngene_1.txt\nngene_1_x.txt\n")
    (folder / "hyp.txt").write_text("".join(f"s{i}\t{1 if i % 2 else -1}\n" for i in range(14)))
    return folder


@pytest.mark.parametrize("kind", ["plain", "minor", "tiered", "numeric"])
def test_evaluation_of_text_models(spark, study, kind):
    out, many = str(study / kind), str(study / ("numeric.txt" if kind == "numeric" else "list.txt"))
    flags = {"minor": ["--minor-column"], "tiered": ["--tiered-minor-col"], "numeric": ["--datatype", "numeric"]}.get(kind, [])
    cli.main(["train", many, str(study / "hyp.txt"), "--out", out, "--lambda-grid", "0.05,0.1,0.05", "0.05,0.1,0.05", "--precision", "fp64", *flags])
    given = [many, "--hypothesis", str(study / "hyp.txt"), *(flags if kind == "numeric" else [])]
    cli.main(["evaluate", out, *given, "--out", f"{out}/a", "--no-visualize"])
    cli.main(["evaluate", f"{out}/lambda_*/weights.txt", *given, "--out", f"{out}/b", "--no-visualize", *(["--minor-alleles", f"{out}/minor_alleles.txt"] if kind == "minor" else ["--tiered-minor-alleles", f"{out}/tiered_minor_alleles.txt"] if kind == "tiered" else [])])
    read = lambda name: {(r.run, r["sample"]): r.prediction for r in spark.read.parquet(f"{out}/{name}/predictions").collect()}
    one, two = read("a"), read("b")
    assert len(one) == 4 * 14 and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one)
    scores = lambda name: {(r.run, r["sample"], r.gene): r.score for r in spark.read.parquet(f"{out}/{name}/gene_scores").collect()}
    g, h = scores("a"), scores("b")
    assert g.keys() == h.keys() and all(g[k] == pytest.approx(h[k], abs=1e-9) for k in g)
    if kind in ("minor", "tiered"):  # a single file finds the minor alleles of its run by itself
        cli.main(["evaluate", f"{out}/lambda_0/weights.txt", *given, "--out", f"{out}/c"])
        assert all(v == pytest.approx(one[0, s], abs=1e-6) for (_, s), v in read("c").items())
        assert (study / kind / "c/penalty_0/lambda_0/eval.svg").read_text().startswith("<svg") and (study / kind / "c/penalty_0/lambda_0/eval_gene_predictions.txt").exists()
        assert "accuracy\t" in (study / kind / "c/penalty_0/lambda_0/metrics.txt").read_text()


def test_score_files_are_read_back(spark, study, tmp_path):
    (tmp_path / "gss.txt").write_text("gene_1\t0.5\n\nbad line\ngene\tx\na\tb\t-1e-3\n")
    assert {(r.key, r.score) for r in texts.read_scores(spark, str(tmp_path / "gss.txt")).collect()} == {("gene_1", 0.5), ("a\tb", -0.001)}
    (tmp_path / "lambda_3").mkdir()
    (tmp_path / "lambda_3/weights.txt").write_text("gene_1_0_A\t1.5e-1\ngene_1_0_A\t0.05\nIntercept\t-0.250000\nnothing\n")
    got = {(r.penalty_idx, r.run, r.label): r.w for r in texts.read_weights(spark, str(tmp_path / "lambda_3/weights.txt")).collect()}
    assert got == {(0, 3, "gene_1_0_A"): pytest.approx(0.2), (0, 3, "Intercept"): -0.25}
