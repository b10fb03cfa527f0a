"""Command line, streaming ingest, pictures, and the driver contract."""

import importlib.util
import xml.etree.ElementTree as ET

import pytest

import __spark_entry__
from sitewise import cli
from sitewise.streaming import ingest
from sitewise.viz import svg


@pytest.fixture
def study(tmp_path):
    for gene in ("one", "two"):
        lines = [f">s{i}\n{'AC'[i % 2] if gene == 'two' else 'A'}{'GT'[i % 3 == 0]}{'CA'[i % 4 == 0]}" for i in range(12)]
        (tmp_path / f"{gene}.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "list.txt").write_text("one.fa\ntwo.fa\n")
    (tmp_path / "hyp.txt").write_text("".join(f"s{i}\t{1 if i % 2 else -1}\n" for i in range(12)))
    return tmp_path


def test_command_line(spark, study):
    out = str(study / "out")
    cli.main(["train", str(study / "list.txt"), str(study / "hyp.txt"), "--out", out, "--lambda-grid", "0.1,0.2,0.1", "0.1,0.2,0.1", "--precision", "fp64"])
    best = spark.read.parquet(f"{out}/gene_median").orderBy("median", ascending=False).first()
    assert best.gene == "two"
    cli.main(["evaluate", out, str(study / "list.txt"), "--hypothesis", str(study / "hyp.txt"), "--out", f"{out}/eval"])
    assert spark.read.parquet(f"{out}/eval/metrics").where("accuracy = 1.0").count() == 4
    cli.main(["ingest", str(study / "*.fa"), "--out", f"{out}/cat"])
    assert spark.read.parquet(f"{out}/cat/alignments").count() == 24
    assert {r.value for r in spark.read.parquet(f"{out}/run_log").where("key = 'status'").collect()} == {"OK"}
    (study / "pairs.txt").write_text("s1\ns0\ns3\ns2\n")
    cli.main(["contrasts", str(study), "--species-groups", str(study / "pairs.txt"), "--out", f"{out}/pairs", "--precision", "fp64", "--min-minor", "1", "--method", "sg_lasso"])
    assert spark.read.parquet(f"{out}/pairs/gene_ranks").count() > 0


def test_text_files(spark, study):
    out = study / "texts"
    common = [str(study / "list.txt"), str(study / "hyp.txt"), "--precision", "fp64", "--out", str(out)]
    cli.main(["train", *common, "--lambda-grid", "0.1,0.2,0.1", "0.1,0.2,0.1", "--initial-gp-value", "1", "--final-gp-value", "2", "--group-penalty-type", "linear", "--minor-column",
              "--write-features", "--write-features-transposed", "--param", "maxIter=30", "--param", "disableEC=1", "--class-bal", "weighted"])
    for name in ("weights.txt", "gss.txt", "bss.txt", "pss.txt", "eval_gene_predictions.txt"):
        assert all((out / f"penalty_{p}" / f"lambda_{k}" / name).exists() for p in (0, 1) for k in range(4)), name
    weights = (out / "penalty_1/lambda_0/weights.txt").read_text().splitlines()
    assert weights[-1].startswith("Intercept\t") and all(len(line.split("\t")) == 2 for line in weights)
    head, *rows = (out / "penalty_0/lambda_3/eval_gene_predictions.txt").read_text().splitlines()
    assert head == "SeqID\tResponse\tPrediction\tone\ttwo" and len(rows) == 12
    assert len((out / "features.csv").read_text().splitlines()) == 13 and (out / "lambda_list.txt").read_text().splitlines()[0] == "0.1 0.1"
    assert "one_minor" in (out / "combined.map").read_text() and (out / "minor_alleles.txt").exists() and (out / "penalty_0/gss_median.txt").exists() and (out / "sweights.txt").exists()
    cli.main(["evaluate", str(out), str(study / "list.txt"), "--hypothesis", str(study / "hyp.txt"), "--out", str(out / "eval")])
    assert (out / "eval/penalty_1/lambda_2/eval.txt").read_text().startswith("SeqID\tPrediction\tProbability\tClassPrediction\n")
    cli.main(["train", *common[:-1], str(study / "cv"), "--nfolds", "3"])
    assert len((study / "cv/lambda_0/cv_predictions.txt").read_text().splitlines()) == 12 and (study / "cv/lambda_0/weights_fold_2.txt").exists()
    (study / "tree.nwk").write_text("((s1,s3,s5,s7,s9,s11)Odd,(s0,s2,s4,s6,s8,s10)Even);")
    cli.main(["clades", str(study / "list.txt"), "--tree", str(study / "tree.nwk"), "--clade-list", "Odd", "--out", str(study / "clades"), "--precision", "fp64", "--lambda-grid", "0.1,0.2,0.1", "0.1,0.1,0.1"])
    assert (study / "clades/hss_summary.txt").read_text().startswith("Odd\t") and len((study / "clades/Odd/eval_SPS_SPP.txt").read_text().splitlines()) == 13
    assert all((study / "clades/Odd" / n).exists() for n in ("eval.txt", "eval_gene_predictions.txt", "gss_median.txt", "pss_median.txt", "bss_median.txt", "hypothesis.txt"))
    with pytest.raises(SystemExit):
        cli.main(["train", *common, "--param", "speed=9"])


def test_contrast_files(spark, study):
    (study / "pairs.txt").write_text("s1,s7\ns0\ns3\ns2\n")
    (study / "pheno.csv").write_text("s1,1\ns0,-1\n")
    cli.main(["contrasts", str(study), "--species-groups", str(study / "pairs.txt"), "--out", str(study / "pairs"), "--precision", "fp64", "--min-minor", "1", "--output-base-name", "run",
              "--use-logspace", "--num-log-points", "2", "--show-selected-sites", "--dump-weights", "--species-pheno-path", str(study / "pheno.csv"), "--final-lambda1", "0.2", "--final-lambda2", "0.2"])
    head, *rows = (study / "pairs/run_gene_ranks.csv").read_text().splitlines()
    assert head == "model,gene,best_score,best_rank,num_combos_ranked,num_combos_ranked_top" and rows
    assert (study / "pairs/run_species_predictions.csv").exists() and (study / "pairs/run_selected_sites.csv").exists() and (study / "pairs/combo_1/observed_0/lambda_0/weights.tsv").exists()


def test_streaming_ingest(spark, study):
    out = str(study / "cat")
    new = study / "new"
    new.mkdir()
    for p in study.glob("*.fa"):
        p.rename(new / p.name)
    for _ in range(2):
        ingest.start(spark, str(new), out, str(study / "check")).awaitTermination()
    assert spark.read.parquet(f"{out}/alignments").count() == 24
    (new / "three.fa").write_text(">s0\nAC\n>s1\nA\n")
    ingest.start(spark, str(new), out, str(study / "check")).awaitTermination()
    assert spark.read.parquet(f"{out}/alignments").count() == 24
    assert [r.gene for r in spark.read.parquet(f"{out}/errors").collect()] == ["three"]


def test_pictures(spark):
    predicted = spark.createDataFrame([("a", 1.0, 0.5), ("b", -1.0, -0.5), ("c", -1.0, 0.2)], "sample string, y double, prediction double")
    scores = spark.createDataFrame([("a", "g<1>", 0.5), ("b", "g<1>", -0.5), ("a", "h", None)], "sample string, gene string, score double")
    root = ET.fromstring(svg.heatmap(predicted, scores))
    assert len(root.findall("{*}rect")) == 6
    curve = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.5), (0, 1, 1.0, 0.5, 0.75), (1, 0, 0.0, 1.0, 0.5)], "round int, k int, tpr double, tnr double, accuracy double")
    assert len(ET.fromstring(svg.dropout_curves(curve)).findall("{*}polyline")) == 6
    assert svg.colour(None, 1) == "#bdbdbd" and svg.colour(0.0, 1) == "#ffffff" and svg.colour(-2.0, 1) == "#0000ff"
    assert svg.short_labels(["prefix_long_a", "prefix_long_b"]) == ["…a", "…b"]


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 50
    assert __spark_entry__.entry(spark).count() > 0
    if importlib.util.find_spec("sitewise.llm") is None:
        assert not any(n.startswith("op") or n == "pipeline" for n in queries)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql())))
def test_query_equals_its_sql(spark, name):
    import duckdb

    if name.startswith("op"):
        pytest.skip("tested with its operator")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = __spark_entry__.queries()[name](spark, folder)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(frame.columns)
    assert names == sorted(d[0] for d in cursor.description)
    tidy = lambda rows, cols: sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in (r[cols.index(c)] for c in names)) for r in rows), key=repr)
    assert tidy([tuple(r) for r in frame.collect()], frame.columns) == tidy(cursor.fetchall(), [d[0] for d in cursor.description])


def test_no_private_scratch_on_a_cluster(spark):
    from types import SimpleNamespace

    from sitewise.sources.scratch import scratch_folder

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_folder(far, "x")
