"""Sparse group lasso as joins and aggregates: for problems of which neither the samples nor the columns fit anywhere.

A fixed number of accelerated steps with a fixed step constant that needs no line search: a quarter of the trace of A'A/m and
of the intercept's share (logistic), the trace of A'A (least squares). An iteration is four aggregates, and two tables that are written in the
shared folder: A s per sample, A'b per column, the norm per gene, the intercept's gradient. The kernel with the same
constant (``Options.lipschitz``) gives the same iterates.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import group_shrink, soft_threshold
from ..operators import scores as S
from ..sources.scratch import settled


def momentum(steps: int) -> list[float]:
    """The share of the last move that each step goes on with."""
    out, before, now = [], 0.0, 1.0
    for _ in range(steps):
        out.append((before - 1) / now)
        before, now = now, (1 + sqrt(1 + 4 * now * now)) / 2
    return out


def fixed_steps(matrix: DataFrame, target: DataFrame, l1: float, l2: float, steps: int, logistic: bool = True, groups_only: bool = False) -> tuple[DataFrame, float]:
    """(col_id, gene, w) after ``steps`` steps, and the intercept.

    ``matrix``: (col_id, gene, sample, value), ``target``: (sample, y); penalties are ratios, gene weights roots of their lengths.
    ``groups_only``: the group penalty alone, without weights, by ``l1``.
    """
    rows = settled(target.where("y <> 0").select("sample", F.col("y").cast("double").alias("y")), "rows")
    cells = settled(matrix.join(rows.select("sample"), "sample", "left_semi").select("col_id", "gene", "sample", F.col("value").cast("double").alias("value")), "matrix")
    n_pos, n_neg, share = S.class_counts(rows).first()
    m = n_pos + n_neg
    genes = matrix.select("gene", "col_id").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    genes = settled(genes.select("gene", (F.lit(1.0) if groups_only else F.sqrt("n")).alias("weight")), "genes")
    grads = settled(S.penalty_scale(cells, rows, not logistic), "grads")
    top1 = 0.0 if groups_only else l1 * (grads.agg(F.max("grad")).first()[0] or 0.0)
    norms = grads.join(genes, "gene").groupBy("gene").agg(F.sqrt(F.sum(F.greatest(F.col("grad") - F.lit(top1), F.lit(0.0)) ** 2)).alias("norm"), F.first("weight").alias("weight"))
    top2 = (l1 if groups_only else l2) * (norms.agg(F.max(F.col("norm") / F.col("weight"))).first()[0] or 0.0)
    trace = cells.agg(F.sum(F.col("value") ** 2)).first()[0] or 0.0
    big = (trace / m + 1) / 4 if logistic else trace
    x = settled(matrix.select("col_id", "gene").distinct().select("col_id", "gene", F.lit(0.0).alias("x"), F.lit(0.0).alias("old")), "x0")
    c = old_c = log(share / (1 - share)) if logistic and 0 < share < 1 else 0.0
    for beta in momentum(steps):
        ahead = x.select("col_id", "gene", "x", (F.col("x") + F.lit(beta) * (F.col("x") - F.col("old"))).alias("s"))
        s_c = c + beta * (c - old_c)
        scores = cells.join(ahead.where("s <> 0").select("col_id", "s"), "col_id").groupBy("sample").agg(F.sum(F.col("value") * F.col("s")).alias("a"))
        b = settled(rows.join(scores, "sample", "left").select("sample", _slope(F.coalesce("a", F.lit(0.0)), F.col("y"), s_c, m, logistic).alias("b")), "slopes")
        slope = b.agg(F.sum("b")).first()[0] if logistic else 0.0
        g = cells.join(b, "sample").groupBy("col_id").agg(F.sum(F.col("value") * F.col("b")).alias("g"))
        u = ahead.join(g, "col_id", "left").select("col_id", "gene", "x", soft_threshold(F.col("s") - F.coalesce("g", F.lit(0.0)) / F.lit(big), top1 / big).alias("u"))
        u = settled(u, "u")
        norm = u.groupBy("gene").agg(F.sqrt(F.sum(F.col("u") ** 2)).alias("norm")).join(genes, "gene")
        x = u.join(norm, "gene").select("col_id", "gene", group_shrink(F.col("u"), F.col("norm"), F.col("weight") * F.lit(top2 / big)).alias("x"), F.col("x").alias("old"))
        c, old_c = s_c - slope / big, c
    return x.where("x <> 0").select("col_id", "gene", F.col("x").alias("w")), c


def _slope(a: Column, y: Column, c: float, m: int, logistic: bool) -> Column:
    """The loss's derivative by a sample's score."""
    return -y / F.lit(float(m)) / (1 + F.exp(y * (a + F.lit(c)))) if logistic else a - y


def steps_sql(l1: float, l2: float, steps: int, logistic: bool = True, groups_only: bool = False) -> str:
    """The same as SQL over ``mat`` (col_id, gene, sample, value) and ``tgt`` (sample, y): CTEs up to ``x{steps}`` (col_id, gene, x, old)."""
    weight = "1e0" if groups_only else "sqrt(count(*))"
    cut = f"{0.0 if groups_only else l1} * max(grad)"
    b0 = "CASE WHEN y > 0 THEN 1 - m1 ELSE -m1 END / m" if logistic else "y"
    parts = [f"""r AS MATERIALIZED (SELECT sample, y FROM tgt WHERE y <> 0),
k AS MATERIALIZED (SELECT count(*)::DOUBLE AS m, count(*) FILTER (WHERE y > 0) / count(*)::DOUBLE AS m1 FROM r),
cel AS MATERIALIZED (SELECT mat.* FROM mat JOIN r USING (sample)),
gen AS MATERIALIZED (SELECT gene, {weight} AS weight FROM (SELECT DISTINCT gene, col_id FROM mat) GROUP BY gene),
gr AS MATERIALIZED (SELECT col_id, gene, abs(sum(value * {b0})) AS grad FROM cel JOIN r USING (sample), k GROUP BY col_id, gene),
t1 AS MATERIALIZED (SELECT {cut} AS l1 FROM gr),
t2 AS MATERIALIZED (SELECT {l1 if groups_only else l2} * max(norm / weight) AS l2 FROM (SELECT gene, sqrt(sum(greatest(grad - l1, 0) ** 2)) AS norm FROM gr, t1 GROUP BY gene) JOIN gen USING (gene)),
lip AS MATERIALIZED (SELECT {"(sum(value * value) / max(m) + 1) / 4" if logistic else "sum(value * value)"} AS big FROM cel, k),
x0 AS MATERIALIZED (SELECT DISTINCT col_id, gene, 0e0 AS x, 0e0 AS old FROM mat),
c0 AS MATERIALIZED (SELECT {"ln(m1 / (1 - m1))" if logistic else "0e0"} AS c, {"ln(m1 / (1 - m1))" if logistic else "0e0"} AS old FROM k)"""]
    for i, beta in enumerate(momentum(steps)):
        slope = f"-y / m / (1 + exp(y * (coalesce(a, 0) + c + {beta!r} * (c - old))))" if logistic else "coalesce(a, 0) - y"
        parts.append(f"""s{i} AS MATERIALIZED (SELECT col_id, gene, x, x + {beta!r} * (x - old) AS s FROM x{i}),
a{i} AS MATERIALIZED (SELECT sample, sum(value * s) AS a FROM cel JOIN s{i} USING (col_id) GROUP BY sample),
b{i} AS MATERIALIZED (SELECT sample, {slope} AS b FROM r LEFT JOIN a{i} USING (sample), k, c{i}),
g{i} AS MATERIALIZED (SELECT col_id, sum(value * b) AS g FROM cel JOIN b{i} USING (sample) GROUP BY col_id),
v{i} AS MATERIALIZED (SELECT col_id, s{i}.gene, x, s - coalesce(g, 0) / big AS v FROM s{i} LEFT JOIN g{i} USING (col_id), lip),
u{i} AS MATERIALIZED (SELECT col_id, gene, x, sign(v) * greatest(abs(v) - l1 / big, 0) AS u FROM v{i}, t1, lip),
n{i} AS MATERIALIZED (SELECT gene, sqrt(sum(u * u)) AS norm FROM u{i} GROUP BY gene),
x{i + 1} AS MATERIALIZED (SELECT col_id, gene, CASE WHEN norm > weight * l2 / big THEN u * (norm - weight * l2 / big) / norm ELSE 0 END AS x, x AS old FROM u{i} JOIN n{i} USING (gene) JOIN gen USING (gene), t2, lip),
c{i + 1} AS MATERIALIZED (SELECT c + {beta!r} * (c - old) - {f"(SELECT sum(b) FROM b{i}) / big" if logistic else "0"} AS c, c AS old FROM c{i}, lip)""")
    return ",\n".join(parts)
