"""The row tier against the grid tier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions import grids
from sitewise.plans.train import TrainOptions, train
from sitewise.solver.kernel import METHODS, Columns, Groups, Options, fit
from sitewise.solver.rows import Rows, cohort
from sitewise.solver.sweep import Point


def made(spark, m=90, n=24, seed=3, valued=False):
    rng = np.random.default_rng(seed)
    dense = (rng.random((m, n)) < 0.3) * (rng.normal(size=(m, n)) if valued else 1.0)
    dense[5] = 0  # a sample of no column
    y = np.where(dense[:, 3] + dense[:, 15] - dense[:, 20] + 0.3 * rng.normal(size=m) > 0.3, 1.0, -1.0)
    col, row = np.nonzero(dense.T)
    cells = spark.createDataFrame([(int(c), f"s{r:03d}", float(dense[r, c])) for c, r in zip(col, row, strict=True)], "col_id long, sample string, value double")
    hypothesis = spark.createDataFrame([(f"s{r:03d}", m - r, float(v)) for r, v in enumerate(y)], "sample string, ord int, y double")
    order = np.arange(m)[::-1]  # ord falls with the sample's number
    place = np.empty(m, int)
    place[order] = np.arange(m)
    return cells if valued else cells.drop("value"), hypothesis, Columns(m, n, col, place[row], dense[row, col] if valued else None), y[order]


@pytest.mark.parametrize("valued", [False, True])
@pytest.mark.parametrize("method", sorted(METHODS))
def test_row_tier_equals_the_kernel(spark, method, valued):
    cells, hypothesis, matrix, y = made(spark, valued=valued)
    groups = Groups.ranges([6] * 4, [np.sqrt(6)] * 4) if not method.startswith("ol") else Groups(np.array([*range(12), *range(6, 24)]), np.array([0, 12, 30]), np.sqrt([12.0, 18.0]))
    o = Options(max_iter=12, ridge=0.01, class_weights=(1.0, 2.0) if valued else None)
    rows = Rows(cells, cohort(hypothesis), matrix.n, 3)
    points = [Point(i, fold, 0, *p) for i, p in enumerate([(0.1, 0.1), (0.2, 0.05)]) for fold in (-1, 0, 2)]
    found = {(r.run, r.fold, r.col_id): r.w for r in rows.solve(points, [groups], method, o).collect()}
    rows.release()
    for p in points:
        keep = np.flatnonzero(np.arange(matrix.m) % 3 != p.fold) if p.fold >= 0 else np.arange(matrix.m)
        own = fit(method, matrix.rows(keep), y[keep], groups, p.l1, p.l2, o)
        assert np.allclose([found.get((p.run, p.fold, c), 0.0) for c in range(matrix.n)], own.x, atol=1e-7)
        assert found[p.run, p.fold, -1] == pytest.approx(own.intercept, abs=1e-7)


def test_cohort_is_numbered_in_order(spark):
    some = spark.range(1000).select(F.col("id").alias("sample"), (-F.col("id")).alias("ord"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0).alias("y"))
    rows = cohort(some).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(666)) and [r.sample for r in rows] == [i for i in range(999, -1, -1) if i % 3]
    copied = cohort(some.where("id < 4").withColumn("copies", F.col("sample"))).orderBy("row").collect()
    assert [(r.row, r.sample) for r in copied] == [(0, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize("balance", ["none", "up", "weighted"])
def test_train_keeps_its_results_on_the_row_tier(spark, balance):
    rng = np.random.default_rng(1)
    letters = np.array(list("ACG-"))
    people = [(g, i, "".join(rng.choice(letters, 6, p=[0.5, 0.3, 0.15, 0.05]))) for g in ("a", "b") for i in range(150)]
    y = {i: (1.0 if people[i][2][1] == "A" and rng.random() < 0.9 else -1.0 if i % 11 else 0.0) for i in range(150)}
    alignments = spark.createDataFrame(people, "gene string, sample int, seq string")
    hypothesis = spark.createDataFrame([(i, 200 - i, v) for i, v in y.items()], "sample int, ord int, y double")
    o = dict(folds=3, precision="fp64", class_balance=balance, lambdas=grids.lambda_grid((0.1, 0.2, 0.1), (0.1, 0.2, 0.1)), solver=Options(max_iter=8))
    key = {"weights": ["penalty_idx", "run", "col_id", "w"], "intercepts": ["penalty_idx", "run", "intercept"], "cv_predictions": ["penalty_idx", "run", "sample", "fold", "y", "prediction"], "cv_metrics": ["penalty_idx", "run", "tp", "tn", "fp", "fn", "rmse"]}
    grid, rows = (train(alignments, hypothesis, TrainOptions(**o, max_samples=n)) for n in (10**6, 10))
    for name, columns in key.items():
        a, b = (sorted(tuple(r) for r in getattr(t, name).select(*columns).collect()) for t in (grid, rows))
        assert len(a) == len(b) > 0 and all(x[:-1] == z[:-1] and x[-1] == pytest.approx(z[-1], abs=1e-7) for x, z in zip(a, b, strict=True)), name


def test_large_cohorts_never_come_to_the_driver(spark, monkeypatch):
    from sitewise.plans import train as T

    def refuse(*_):
        raise AssertionError("samples on the driver")

    monkeypatch.setattr(T, "numbered", refuse)
    monkeypatch.setattr(T, "gather", refuse)
    alignments = spark.range(60).select(F.lit("a").alias("gene"), F.col("id").alias("sample"), F.when(F.col("id") % 3 == 0, "AC").otherwise("CA").alias("seq"))
    hypothesis = spark.range(60).select(F.col("id").alias("sample"), F.col("id").alias("ord"), F.when(F.col("id") % 4 == 0, 1.0).otherwise(-1.0).alias("y"))
    assert train(alignments, hypothesis, TrainOptions(folds=2, max_samples=20, solver=Options(max_iter=5))).cv_metrics.count() == 1


@pytest.mark.parametrize("name", ["train_leastr", "train_columns"])
def test_numeric_queries_keep_their_results_on_the_row_tier(spark, monkeypatch, name):
    from sitewise.plans import catalogue_models as M

    key = (lambda r: r.col_id) if name == "train_columns" else (lambda r: (r.run, r.col_id))
    before = {key(r): r.w for r in M.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(TrainOptions, "max_samples", 100)
    monkeypatch.setattr(M, "numbered", None)
    after = {key(r): r.w for r in M.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert before.keys() == after.keys() and all(w == pytest.approx(after[k], abs=1e-7) for k, w in before.items())
