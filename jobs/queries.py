"""The jobs as queries: each runs twice on the whole tables into a new folder and returns what is there then; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.sources.scratch import scratch_folder

from . import allele_catalogue, penalty_bounds


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "job1", keep=True)
    for _ in range(2):
        allele_catalogue.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return allele_catalogue.features(spark, f"{folder}/out")


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "job2", keep=True)
    for _ in range(2):
        penalty_bounds.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/out")
    found = penalty_bounds.bounds(spark, f"{folder}/out")
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes])


_GENE = "coalesce(nullif(lang, ''), '(none)')"
_FEATS = """stats AS (SELECT gene, pos, arg_max(ch, (n, -ascii(ch))) AS major, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM counts GROUP BY ALL),
feats AS (SELECT c.gene, c.pos, c.ch, c.n, s.total, s.major FROM counts c JOIN stats s USING (gene, pos) WHERE s.kinds >= 2 AND s.total - s.most >= 2 AND c.n >= 2)"""

JOB1_SQL = f"""
WITH sites AS (SELECT {_GENE} AS gene, unnest(string_split(text, '')) AS ch, CAST(unnest(range(length(text))) AS INTEGER) AS pos FROM documents),
counts AS (SELECT gene, pos, ch, count(*) AS n FROM sites WHERE ch NOT IN ('-', '?', '') GROUP BY ALL),
{_FEATS}
SELECT gene, pos, ch AS allele, n, total, major FROM feats
"""

JOB2_SQL = f"""
WITH cohort AS (SELECT doc_id AS sample, max(CASE WHEN quality = 1 THEN 1e0 ELSE -1e0 END) AS y, ((doc_id % 5) + 5) % 5 AS fold FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
docs AS (SELECT {_GENE} AS gene, doc_id AS sample, text, row_number() OVER (PARTITION BY lang, doc_id ORDER BY text DESC NULLS LAST) AS r FROM documents),
sites AS (SELECT gene, fold, y, unnest(string_split(text, '')) AS ch, CAST(unnest(range(length(text))) AS INTEGER) AS pos FROM docs JOIN cohort USING (sample) WHERE r = 1),
cells AS (SELECT gene, pos, ch, fold, count(*) AS n, count(*) FILTER (WHERE y > 0) AS p, count(*) FILTER (WHERE y < 0) AS q FROM sites WHERE ch NOT IN ('-', '?', '') GROUP BY ALL),
counts AS (SELECT gene, pos, ch, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM cells GROUP BY ALL),
{_FEATS},
sets AS (SELECT t, count(*) FILTER (WHERE y > 0 AND fold <> t)::DOUBLE AS np, count(*) FILTER (WHERE y < 0 AND fold <> t)::DOUBLE AS nn FROM cohort, range(-1, 5) r(t) GROUP BY t),
grads AS (SELECT gene, pos, ch, t, abs(sum(CASE WHEN fold <> t THEN p ELSE 0 END)::DOUBLE * (nn / (np + nn) / (np + nn)) - sum(CASE WHEN fold <> t THEN q ELSE 0 END)::DOUBLE * (np / (np + nn) / (np + nn))) AS g
          FROM feats JOIN cells USING (gene, pos, ch), sets GROUP BY gene, pos, ch, t, np, nn),
tops AS (SELECT t, max(g) AS top FROM grads GROUP BY t),
bounds AS (SELECT gene, t, count(*) AS n_columns, sqrt(sum(greatest(g - 0.1 * top, 0) ** 2)) / sqrt(count(*)) AS b FROM grads JOIN tops USING (t) GROUP BY gene, t),
genes AS (SELECT gene, max(n_columns) AS n_columns, max(b) FILTER (WHERE t < 0) AS lambda2_bound, min(b) FILTER (WHERE t >= 0) AS lambda2_min, max(b) FILTER (WHERE t >= 0) AS lambda2_max FROM bounds GROUP BY gene),
cols AS (SELECT gene, pos, ch, max(g) FILTER (WHERE t < 0) AS grad, min(g) FILTER (WHERE t >= 0) AS grad_min, max(g) FILTER (WHERE t >= 0) AS grad_max,
         CAST(count(*) FILTER (WHERE t >= 0 AND g > 0.1 * top) AS INTEGER) AS kept FROM grads JOIN tops USING (t) GROUP BY gene, pos, ch)
SELECT pos, ch AS allele, n, n_pos, n_neg, round(grad, 9) AS grad, round(grad_min, 9) AS grad_min, round(grad_max, 9) AS grad_max, kept, n_columns, round((SELECT top FROM tops WHERE t < 0), 9) AS lambda1_max,
  round(lambda2_bound, 9) AS lambda2_bound, round(lambda2_min, 9) AS lambda2_min, round(lambda2_max, 9) AS lambda2_max, gene FROM cols JOIN counts USING (gene, pos, ch) JOIN genes USING (gene)
"""

QUERIES = {"job1_allele_catalogue": job1, "job2_penalty_bounds": job2}
ORACLE_SQL = {"job1_allele_catalogue": JOB1_SQL, "job2_penalty_bounds": JOB2_SQL}
