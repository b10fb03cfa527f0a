"""The jobs: growing input, broken-off and repeated runs, odd rows, the command line."""

import json
import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobs import allele_catalogue, common, penalty_bounds
from sitewise.solver.kernel import Columns, Groups, Options, scaled

from .conftest import ROOT

SMALL = "/root/testdata/sf0.001"


def brute(rows, min_minor=2):
    """Columns of (gene, text) rows: {(gene, pos, allele): (n, total, major)}."""
    counts = defaultdict(Counter)
    for gene, text in rows:
        for pos, ch in enumerate(text or ""):
            if ch not in "-?":
                counts[gene or "(none)", pos][ch] += 1
    out = {}
    for (gene, pos), c in counts.items():
        major, most = min(c.items(), key=lambda x: (-x[1], ord(x[0])))
        if len(c) > 1 and c.total() - most >= min_minor:
            out |= {(gene, pos, ch): (n, c.total(), major) for ch, n in c.items() if n >= min_minor}
    return out


def found(spark, out):
    return {(r.gene, r.pos, r.allele): (r.n, r.total, r.major) for r in allele_catalogue.features(spark, out).collect()}


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def growing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "doc_id", spark_left("text"), "source")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)

    def add(name, some):
        spark.createDataFrame(some, docs.schema).coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / name).glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{name}.parquet")

    return tmp_path, rows, add


def spark_left(column, n=300):
    from pyspark.sql import functions as F

    return F.left(column, F.lit(n)).alias(column)  # a small copy of the table, made for the test


def test_two_runs_over_growing_input(spark, growing):
    tmp, rows, add = growing
    paths = [str(tmp / p) for p in ("in", "out", "checkpoint")]
    first, more = rows[:120], [r for r in rows[120:] if r.lang in ("en", "de")]
    add("a", first)
    said = allele_catalogue.run(spark, *paths)
    assert (said["batches"], said["renewed"]) == (1, len({r.lang for r in first})) and found(spark, paths[1]) == brute((r.lang, r.text) for r in first)
    before = stamps(paths[1])
    assert allele_catalogue.run(spark, *paths)["batches"] == 0 and stamps(paths[1]) == before  # nothing new
    add("b", more)
    said = allele_catalogue.run(spark, *paths)
    assert (said["batches"], said["renewed"]) == (1, 2) and found(spark, paths[1]) == brute((r.lang, r.text) for r in first + more)
    after = stamps(paths[1])
    kept = {f for f in before if "/counts/batch=0" in f or "gene=fr" in f or "gene=es" in f}
    assert kept and all(after[f] == before[f] for f in kept)
    new = spark.read.parquet(f"{paths[1]}/counts").where("batch = 1").selectExpr("sum(n)").first()[0]
    assert new == sum(len(r.text) - r.text.count("-") - r.text.count("?") for r in more if r.text)


def test_broken_off_runs_are_made_good(spark, growing):
    tmp, rows, add = growing
    paths = [str(tmp / p) for p in ("in", "out", "checkpoint")]
    add("a", rows[:60])
    allele_catalogue.run(spark, *paths)
    add("b", rows[60:])
    allele_catalogue.run(spark, *paths)
    want = found(spark, paths[1])
    assert want == brute((r.lang, r.text) for r in rows)
    os.remove(tmp / "checkpoint/commits/1")  # as if it had ended before the second batch was committed
    (crc := tmp / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    assert not crc.exists() and allele_catalogue.run(spark, *paths)["batches"] == 1 and found(spark, paths[1]) == want
    shutil.rmtree(tmp / "out/marks")  # or before its marks
    assert found(spark, paths[1]) == {} and allele_catalogue.run(spark, *paths)["batches"] == 0 and found(spark, paths[1]) == want
    changed = allele_catalogue.Config(min_minor=5)
    allele_catalogue.run(spark, *paths, changed)
    assert found(spark, paths[1]) == brute(((r.lang, r.text) for r in rows), 5)


def test_odd_rows(spark, tmp_path):
    rows = [("g", 1, "AC-é"), ("g", 2, "AG?é"), ("g", 3, "TG"), ("g", 3, "TG"), ("g", 4, None), ("g", 5, ""), (None, 6, "AB"), ("", 7, "BA"), ("", 8, "BB"), (None, 9, "AB"), ("1", 1, "x"), ("a/b=c", 1, "x" * 70_000), ("a/b=c", 2, "y" * 70_000)] * 2
    frame = spark.createDataFrame(rows, "lang string, doc_id long, text string").selectExpr("*", "1 AS n", "2 AS pos", "'x' AS gene", "0 AS batch")
    frame.write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("in", "out", "checkpoint")]
    said = allele_catalogue.run(spark, *paths)
    assert found(spark, paths[1]) == brute((g, t) for g, _, t in rows) and said["genes"] == 4
    frame.limit(0).write.parquet(str(tmp_path / "none"))
    none = [str(tmp_path / p) for p in ("none", "out2", "checkpoint2")]
    assert allele_catalogue.run(spark, *none)["genes"] == 0 and found(spark, none[1]) == {}


def test_a_single_file(spark, tmp_path):
    paths = [f"{SMALL}/documents.parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint")]
    assert allele_catalogue.run(spark, *paths)["columns"] == allele_catalogue.features(spark, paths[1]).count() > 0


def test_bounds_are_those_of_the_solver(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(g, s, "".join(rng.choice(list("ACG-"), 12))) for g in ("one", "two") for s in range(40) if s % 9 or g == "one"]
    labels = [(s, int(rng.integers(2)), 7) for s in range(40)] + [(50, 1, 7), (51, None, 7)]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(str(tmp_path / "seq"))
    spark.createDataFrame(labels, "doc_id long, quality int, y int").write.parquet(str(tmp_path / "lab"))
    paths = [str(tmp_path / p) for p in ("seq", "lab", "out")]
    said = penalty_bounds.run(spark, *paths)
    got = sorted(penalty_bounds.bounds(spark, paths[2]).collect(), key=lambda r: (r.gene, r.pos, r.allele))
    y = {s: 1.0 if q == 1 else -1.0 for s, q, _ in labels if q is not None}
    samples, text = sorted(y), {(g, s): t for g, s, t in rows}
    keys = [(r.gene, r.pos, r.allele) for r in got]
    assert set(keys) == set(brute((g, t) for g, _, t in rows)) and said["columns"] == len(got)
    sizes = [sum(k[0] == g for k in keys) for g in ("one", "two")]
    bounds = []
    for fold in (None, 0, 1, 2, 3, 4):
        own = [s for s in samples if fold is None or s % 5 != fold]
        at = [(j, i) for j, (g, p, a) in enumerate(keys) for i, s in enumerate(own) if text.get((g, s), "-" * 12)[p] == a]
        matrix, target = Columns(len(own), len(keys), *map(np.array, zip(*at))), np.array([y[s] for s in own])
        weights = np.full(len(own), 1 / len(own))
        top, _ = scaled(matrix, target, Groups.ranges(sizes, np.sqrt(sizes)), 1.0, 0.0, True, weights, Options())
        per_gene = []
        for g in range(2):  # the bound of one gene: the other's weight is out of reach
            w = np.where(np.arange(2) == g, np.sqrt(sizes), 1e12)
            per_gene.append(scaled(matrix, target, Groups.ranges(sizes, w), 0.1, 1.0, True, weights, Options())[1])
        b = weights * np.where(target > 0, (target < 0).mean(), -(target > 0).mean())
        bounds.append((top, per_gene, np.abs(matrix.tdot(b))))
    grads = np.array([b[2] for b in bounds])
    for j, r in enumerate(got):
        g = 0 if r.gene == "one" else 1
        assert r.lambda1_max == pytest.approx(bounds[0][0]) and r.lambda2_bound == pytest.approx(bounds[0][1][g])
        assert (r.grad, r.grad_min, r.grad_max) == tuple(pytest.approx(v, abs=1e-12) for v in (grads[0, j], grads[1:, j].min(), grads[1:, j].max()))
        assert (r.lambda2_min, r.lambda2_max) == tuple(pytest.approx(f(b[1][g] for b in bounds[1:])) for f in (min, max))
        assert r.kept == sum(grads[t, j] > 0.1 * bounds[t][0] for t in range(1, 6)) and r.n == r.n_pos + r.n_neg and r.n_columns == sizes[g]


def test_bounds_rerun_and_odd_rows(spark, tmp_path):
    rows = [("g", i, t) for i, t in enumerate(["AC", "AC", "GT", "GT", None, "", "A"])] + [(None, 1, "AC"), ("", 2, "GT"), (None, 3, "GC"), ("", 0, "AT"), ("g", 0, "GG"), ("g", None, "AC")]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").selectExpr("*", "1 AS y", "2 AS n", "3 AS fold").write.parquet(str(tmp_path / "seq"))
    labels = [(i, i % 2) for i in range(7)] + [(None, 1), (1, 0), (1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 AS n", "'x' AS text").write.parquet(str(tmp_path / "lab"))
    paths = [str(tmp_path / p) for p in ("seq", "lab", "out")]
    said = penalty_bounds.run(spark, *paths)
    first = sorted(penalty_bounds.bounds(spark, paths[2]).collect())
    assert penalty_bounds.run(spark, *paths) == said and sorted(penalty_bounds.bounds(spark, paths[2]).collect()) == first
    assert {r.gene for r in first} == {"g", "(none)"}
    spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "one"))
    assert {r.grad for r in penalty_bounds.screen(spark, paths[0], str(tmp_path / "one"), penalty_bounds.Config()).collect()} == {0.0}
    spark.read.parquet(paths[1]).limit(0).write.parquet(str(tmp_path / "no"))
    assert penalty_bounds.run(spark, paths[0], str(tmp_path / "no"), paths[2]) == {"genes": 0, "columns": 0, "kept": 0}


def test_configuration(spark, tmp_path):
    for module in (allele_catalogue, penalty_bounds):
        assert common.load_config(module.Config, spark, f"{ROOT}/{module.__name__.replace('.', '/')}.json") == module.Config()
    (tmp_path / "c.json").write_text(json.dumps({"min_minor": 3, "wrong": 1}))
    with pytest.raises(ValueError, match="wrong"):
        common.load_config(allele_catalogue.Config, spark, str(tmp_path / "c.json"))


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("g", i, t) for i, t in enumerate(["AC", "AC", "GT", "GT"])], "lang string, doc_id long, text string").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int").write.parquet(str(tmp_path / "lab"))
    (tmp_path / "c.json").write_text(json.dumps({"min_minor": 1, "folds": 2}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    call = [sys.executable, "-m", "jobs.penalty_bounds", "--sequences", str(tmp_path / "in"), "--labels", str(tmp_path / "lab"), "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(call, cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote 4 columns of 1 genes" in done.stderr and penalty_bounds.bounds(spark, str(tmp_path / "out")).count() == 4


def test_bounds_count_slices(spark, tmp_path, monkeypatch):
    """no row per character."""
    spark.createDataFrame([("g", i, t) for i, t in enumerate(["AC", "AC", "GT", "GT"])], "lang string, doc_id long, text string").write.parquet(str(tmp_path / "seq"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int").write.parquet(str(tmp_path / "lab"))
    monkeypatch.setattr(penalty_bounds.A, "explode_sites", None)
    assert penalty_bounds.screen(spark, str(tmp_path / "seq"), str(tmp_path / "lab"), penalty_bounds.Config()).count() == 4
