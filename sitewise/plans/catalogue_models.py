"""Queries that fit models or iterate; the fixed steps have SQL twins, the others give rows only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import sites as A
from ..solver.distributed import gather, numbered, solve_columns, solve_grid
from ..solver.kernel import Groups, Options
from ..solver.relational import fixed_steps, steps_sql
from ..solver.rows import Rows, cohort
from ..solver.sweep import Point
from ..sources.scratch import settled
from . import inputs as I  # noqa: E741
from .catalogue import QUERIES, query
from .train import TrainOptions, train
from .workflows import ContrastOptions, contrast_scan


def model(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _many(target) -> bool:
    return target.where("y <> 0").count() > TrainOptions.max_samples


def _on_rows(matrix, target, n, points, groups, method, folds=0):
    rows = Rows(matrix.select("col_id", "sample", "value"), settled(cohort(target), "people"), n, folds)
    try:
        return rows.solve(points, [groups], method, Options())
    finally:
        rows.release()


def _numeric(spark, d, method, folds=0):
    """Weights of the numeric table's features over a grid."""
    matrix, target = I.embedding_matrix(spark, d), I.embedding_target(spark, d)
    n = matrix.agg(F.max("col_id")).first()[0] + 1
    groups = Groups.ranges([8] * (n // 8), grids.group_weights("std", 1, [8] * (n // 8), [8] * (n // 8)))
    if _many(target):
        points = [Point(i, fold, 0, p, q) for i, p, q in grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1)) for fold in (range(folds) if folds else (-1,))]
        return _on_rows(matrix, target, n, points, groups, method, folds)
    samples, y = numbered(target)
    a = gather(matrix.select("col_id", "sample", "value"), samples, n, 200_000_000)
    grid = spark.createDataFrame([(i, 0, p, q) for i, p, q in grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1))], "run int, penalty_idx int, l1 double, l2 double")
    return solve_grid(grid, a, y, {0: groups}, method, Options(), folds)


@model("train_sg_lasso")
def _(spark, d):
    return _numeric(spark, d, "sg_lasso")


@model("train_leastr")
def _(spark, d):
    return _numeric(spark, d, "sg_lasso_leastr")


@model("train_gl")
def _(spark, d):
    return _numeric(spark, d, "gl_logisticr")


_MATRIX = """WITH e AS (SELECT vec_id AS sample, label, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS col_id FROM embeddings),
mat AS (SELECT col_id, printf('g%02d', col_id // 8) AS gene, sample, value FROM e), tgt AS (SELECT DISTINCT sample, CASE WHEN label = 0 THEN 1e0 ELSE -1e0 END AS y FROM e),
"""


def _stepped(name: str, steps: int = 6, **how) -> None:
    """Fixed accelerated steps over the whole numeric table, as joins and aggregates in both languages."""
    sql = _MATRIX + steps_sql(0.1, 0.1, steps, **how) + f"\nSELECT col_id, gene, round(x, 9) AS w, round(c, 9) AS intercept FROM x{steps}, c{steps} WHERE round(x, 9) <> 0"

    @query(name, sql)
    def _(spark, d):
        weights, intercept = fixed_steps(I.embedding_matrix(spark, d), I.embedding_target(spark, d), 0.1, 0.1, steps, **how)
        return weights.select("col_id", "gene", F.round("w", 9).alias("w"), F.round(F.lit(intercept), 9).alias("intercept")).where("w <> 0")


_stepped("steps_sg_lasso")
_stepped("steps_leastr", logistic=False)
_stepped("steps_gl", groups_only=True)


@model("train_columns")
def _(spark, d):
    matrix, target = I.embedding_matrix(spark, d), I.embedding_target(spark, d)
    if _many(target):  # a sum per sample and step would go to the driver; of fewer columns than samples, a sum per column does
        genes = matrix.groupBy("gene").agg(F.array_sort(F.collect_set("col_id")).alias("cols")).orderBy("gene").collect()  # a number per column
        ends = np.cumsum([0, *(len(r.cols) for r in genes)])
        groups = Groups(np.array([c for r in genes for c in r.cols], np.int64), ends, np.sqrt(np.diff(ends)))
        return _on_rows(matrix, target, int(ends[-1]), [Point(0, -1, 0, 0.1, 0.1)], groups, "sg_lasso").where("col_id >= 0").select("col_id", "w")
    samples, y = numbered(target)
    weights = matrix.select("gene", "col_id").distinct().groupBy("gene").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))
    table, _ = solve_columns(matrix.select("col_id", "sample", "value"), matrix.select("col_id", "gene").distinct(), weights, samples, y, 0.1, 0.1)
    return table


def _lines(spark, d, **options):
    """Sites of order lines as an alignment, with the orders' hypothesis."""
    s = I.line_sites(spark, d)
    seq = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit("-"))), "")
    s = s.groupBy("gene", "sample", "pos").agg(F.max("ch").alias("ch"))
    m = s.groupBy("gene", "sample").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ch"))).alias("m"))
    one = m.select("gene", "sample", seq.alias("seq"))
    return settled(one, "lines"), I.order_hypothesis(spark, d), TrainOptions(**options)


@model("train_overlap")
def _(spark, d):
    alignments, hypothesis, o = _lines(spark, d, method="olsg_lasso_leastr", precision="fp64")
    o.groups = spark.createDataFrame([(0, "flag"), (0, "status"), (1, "status")], "group int, gene string")
    return train(alignments, hypothesis, o).weights


@model("train_overlap_logistic")
def _(spark, d):
    alignments, hypothesis, o = _lines(spark, d, method="olsg_lasso_logisticr", precision="fp64")
    o.groups = spark.createDataFrame([(0, "flag"), (0, "status"), (1, "status")], "group int, gene string")
    return train(alignments, hypothesis, o).weights


@model("cv_predict")
def _(spark, d):
    alignments, hypothesis, o = _lines(spark, d, folds=5, precision="fp64")
    return train(alignments, hypothesis, o).cv_metrics


@model("train_median_scores")
def _(spark, d):
    alignments, hypothesis, o = _lines(spark, d, precision="fp64", lambdas=grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1)))
    return train(alignments, hypothesis, o).medians["position"]


@model("contrast_scan")
def _(spark, d):
    """Nations as species, order priorities as genes, months as positions: the commonest order status, all nations paired by name."""
    orders = I.read(spark, d, "orders").join(I.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(I.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    counts = orders.groupBy(F.col("o_orderpriority").alias("gene"), F.col("n_name").alias("sample"), F.month("o_orderdate").alias("pos"), F.substring("o_orderstatus", 1, 1).alias("ch")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("gene", "sample", "pos").agg(A.major_of().alias("ch"))
    months = best.groupBy("gene", "sample").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ch"))).alias("m"))
    seq = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit("-"))), "")
    names = [r[0] for r in I.read(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    o = TrainOptions(group_penalty="median", precision="fp64", min_minor=1, lambdas=grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1)))
    return contrast_scan(months.select("gene", "sample", seq.alias("seq")), [list(zip(names[0::2], names[1::2], strict=False))], o, ContrastOptions(partner_only=True, flipped=True))["gene_ranks"]
