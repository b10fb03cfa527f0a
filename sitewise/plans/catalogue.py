"""The named queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.columns import group_shrink, label, label_parts, logistic_loss, median_nonzero, sigmoid, soft_threshold, stem, valid_residues
from ..operators import scores as S
from ..operators import sites as A
from ..sources.scratch import settled
from . import inputs as I  # noqa: E741

# ---------------------------------------------------------------- shared SQL

SITES = r"""
aln AS (SELECT d.lang AS gene, d.doc_id AS sample, d.text AS seq, CASE WHEN quality = 1 THEN 1e0 ELSE -1e0 END AS y
        FROM documents d JOIN labels l USING (doc_id)),
sites AS (SELECT gene, sample, y, unnest(string_split(seq, '')) AS ch, CAST(unnest(range(length(seq))) AS INTEGER) AS pos FROM aln)
"""
LINES = r"""
sites AS (SELECT 'flag' AS gene, l_orderkey AS sample, l_linenumber AS pos, l_returnflag AS ch FROM lineitem
          UNION ALL SELECT 'status', l_orderkey, l_linenumber, l_linestatus FROM lineitem),
hyp AS (SELECT o_orderkey AS sample, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1e0
               WHEN substr(o_orderpriority, 1, 1) = '3' THEN 0e0 ELSE -1e0 END AS y FROM orders)
"""
COUNTS = """counts AS (SELECT gene, pos, ch, count(*) AS n FROM sites WHERE ch NOT IN ('-', '?') GROUP BY ALL)"""
STATS = """stats AS (SELECT gene, pos, arg_max(ch, (n, -ascii(ch))) AS major, max(n) AS n_major, CAST(sum(n) AS BIGINT) AS total,
           CAST(sum(n) - max(n) AS BIGINT) AS minor, count(*) AS alleles FROM counts GROUP BY ALL)"""
FEATS = """feats AS (SELECT c.gene, c.pos, c.ch AS allele, c.n, s.total, s.major FROM counts c JOIN stats s USING (gene, pos)
           WHERE s.alleles >= 2 AND s.minor >= 2 AND c.n >= 2)"""
INDEX = """idx AS (SELECT *, row_number() OVER (ORDER BY gene, pos, ascii(allele), allele) - 1 AS col_id FROM feats)"""
WEIGHT = """wts AS (SELECT *, CASE WHEN col_id % 5 = 0 THEN 0e0 ELSE CAST((col_id * 37) % 101 - 50 AS DOUBLE) / 100.0 END AS w FROM idx)"""
RUNS = """rw AS (SELECT *, CASE WHEN (col_id + run) % 4 = 0 THEN 0e0 ELSE CAST((col_id * 37 + run * 17) % 101 - 50 AS DOUBLE) / 100.0 END AS w
          FROM idx, range(5) r(run))"""
MED = "coalesce(median({0}) FILTER (WHERE {0} <> 0 AND NOT isnan({0})), 0e0)"
HYP = """hyp AS (SELECT doc_id AS sample, CASE WHEN quality = 1 AND toxic = 1 THEN 0e0 WHEN quality = 1 THEN 1e0 ELSE -1e0 END AS y FROM labels)"""


def _docs(*parts: str) -> str:
    return "WITH " + ",\n".join((SITES, *parts)) + "\n"


def _lines(*parts: str) -> str:
    return "WITH " + ",\n".join((LINES, *parts)) + "\n"


# ---------------------------------------------------------------- inputs of the queries


def _sites(spark, d, skip_x=False):
    return A.ungapped(A.explode_sites(I.documents_alignment(spark, d)), skip_x)


def _counts(spark, d):
    return A.allele_counts(_sites(spark, d))


def _feats(spark, d, **k):
    return A.features(_counts(spark, d), **k)


def _index(spark, d):
    return A.feature_index(settled(_feats(spark, d), "features"))


def _line_index(spark, d):
    return settled(A.feature_index(A.features(A.allele_counts(A.ungapped(I.line_sites(spark, d))))), "index")


def _line_cells(spark, d):
    return A.cells(I.line_sites(spark, d), _line_index(spark, d))


def _line_weights(spark, d):
    return I.made_weights(_line_index(spark, d))


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- sites and alleles


@query("allele_counts", _docs(COUNTS) + "SELECT gene, pos, ch, n FROM counts")
def _(spark, d):
    return _counts(spark, d)


@query("major_allele", _docs(COUNTS, STATS) + "SELECT gene, pos, major FROM stats")
def _(spark, d):
    return _counts(spark, d).groupBy("gene", "pos").agg(A.major_of().alias("major"))


@query("site_stats", _docs(COUNTS, STATS) + "SELECT * FROM stats")
def _(spark, d):
    return A.site_stats(_counts(spark, d))


@query("var_sites", _docs(COUNTS, STATS) + """SELECT gene, count(*) FILTER (WHERE alleles >= 2 AND alleles <> total AND n_major <> total - 1) AS n_variable,
  count(*) FILTER (WHERE alleles >= 2) AS n_polymorphic FROM stats GROUP BY gene""")
def _(spark, d):
    a, t, m = F.col("alleles"), F.col("total"), F.col("n_major")
    return A.site_stats(_counts(spark, d)).groupBy("gene").agg(F.count_if((a >= 2) & (a != t) & (m != t - 1)).alias("n_variable"), F.count_if(a >= 2).alias("n_polymorphic"))


@query("features_min_minor", _docs(COUNTS, STATS, FEATS) + "SELECT * FROM feats")
def _(spark, d):
    return _feats(spark, d)


@query("features_drop_major", _docs(COUNTS, STATS, FEATS) + "SELECT * FROM feats WHERE allele <> major")
def _(spark, d):
    return _feats(spark, d, drop_major=True)


@query("features_dropout", _docs(COUNTS, STATS, FEATS) + """, gone AS (SELECT DISTINCT gene || '_' || pos || '_' || allele AS label FROM feats WHERE (pos + n) % 3 = 0)
SELECT f.* FROM feats f WHERE gene || '_' || pos || '_' || allele NOT IN (SELECT label FROM gone)""")
def _(spark, d):
    gone = _feats(spark, d).where((F.col("pos") + F.col("n")) % 3 == 0).select(label(F.col("gene"), F.col("pos"), F.col("allele")).alias("label"))
    return _feats(spark, d, dropout=gone)


@query("features_skip_x", "WITH " + SITES + """, counts AS (SELECT gene, pos, ch, count(*) AS n FROM sites WHERE ch NOT IN ('-', '?', 'X') GROUP BY ALL),
""" + STATS + ",\n" + FEATS + "\nSELECT * FROM feats")
def _(spark, d):
    return A.features(A.allele_counts(_sites(spark, d, skip_x=True)))


@query("features_paired", "WITH " + SITES + """, counts AS (SELECT gene, pos, ch, count(*) AS n FROM sites WHERE ch <> '-' GROUP BY ALL),
""" + STATS + """
SELECT c.gene, c.pos, c.ch AS allele, c.n, s.total, s.major FROM counts c JOIN stats s USING (gene, pos)
WHERE s.alleles >= 2 AND s.alleles <> s.total AND s.n_major <> s.total - 1 AND s.minor >= 2 AND c.n >= 2""")
def _(spark, d):
    return A.paired_features(A.allele_counts(A.ungapped(A.explode_sites(I.documents_alignment(spark, d)), gaps=("-",))))


@query("gene_sizes", _docs(COUNTS, STATS, FEATS) + "SELECT gene, count(*) AS n_columns FROM feats GROUP BY gene")
def _(spark, d):
    return A.gene_sizes(_feats(spark, d))


@query("feature_index", _docs(COUNTS, STATS, FEATS, INDEX) + "SELECT gene, pos, allele, col_id FROM idx")
def _(spark, d):
    return _index(spark, d).select("gene", "pos", "allele", "col_id")


@query("group_ranges", _docs(COUNTS, STATS, FEATS) + """, g AS (SELECT gene, count(*) AS n_columns FROM feats GROUP BY gene)
SELECT gene, n_columns, CAST(sum(n_columns) OVER (ORDER BY gene) - n_columns + 1 AS BIGINT) AS first_col, CAST(sum(n_columns) OVER (ORDER BY gene) AS BIGINT) AS last_col FROM g""")
def _(spark, d):
    return A.group_ranges(A.gene_sizes(_feats(spark, d)))


@query("one_hot_cells", _lines(COUNTS, STATS, FEATS, INDEX) + "SELECT i.col_id, s.sample FROM sites s JOIN idx i ON s.gene = i.gene AND s.pos = i.pos AND s.ch = i.allele")
def _(spark, d):
    return _line_cells(spark, d)


@query("minor_column", _docs(COUNTS, STATS, FEATS) + """, hit AS (SELECT s.gene, s.sample, max(1) AS hit FROM sites s JOIN feats f ON s.gene = f.gene AND s.pos = f.pos AND s.ch = f.allele AND f.allele <> f.major GROUP BY ALL)
SELECT a.gene, a.sample, coalesce(hit, 0) AS minor FROM (SELECT DISTINCT gene, sample FROM sites WHERE ch NOT IN ('-', '?')) a LEFT JOIN hit USING (gene, sample)
WHERE a.gene IN (SELECT gene FROM feats WHERE allele <> major)""")
def _(spark, d):
    return A.minor_column_of(I.documents_alignment(spark, d), _feats(spark, d))


@query("tiered_minor", _lines(COUNTS, STATS, FEATS) + """, hit AS (SELECT s.gene, s.sample, max(CAST(CAST(f.n AS FLOAT) / CAST(f.total AS FLOAT) AS FLOAT)) AS freq
  FROM sites s JOIN feats f ON s.gene = f.gene AND s.pos = f.pos AND s.ch = f.allele AND f.allele <> f.major GROUP BY ALL)
SELECT gene, tier, sample FROM hit JOIN (VALUES ('0pct', 0.0), ('0.1pct', 0.001), ('1pct', 0.01), ('5pct', 0.05)) t(tier, bound) ON freq > CAST(bound AS FLOAT)""")
def _(spark, d):
    s = I.line_sites(spark, d)
    return A.tiered_minor(s, A.features(A.allele_counts(A.ungapped(s))))


@query("missing_sequences", """SELECT CAST(t.turn AS VARCHAR) AS gene, s.conv_id AS sample FROM (SELECT DISTINCT turn FROM conversations) t, (SELECT DISTINCT conv_id FROM conversations) s
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.turn = t.turn AND c.conv_id = s.conv_id)""")
def _(spark, d):
    a = I.turns_alignment(spark, d)
    return A.missing_sequences(a, a.select("sample", F.lit(1.0).alias("y")).distinct())


@query("last_of_each", """SELECT role AS gene, conv_id AS sample, turn AS seq_ord, text AS seq FROM conversations
QUALIFY row_number() OVER (PARTITION BY role, conv_id ORDER BY turn DESC) = 1""")
def _(spark, d):
    return A.last_of_each(I.roles_alignment(spark, d))


@query("hypothesis_filter", "WITH " + SITES + ", " + HYP + " SELECT a.gene, a.sample, h.y, length(a.seq) AS length FROM aln a JOIN hyp h USING (sample) WHERE h.y <> 0")
def _(spark, d):
    return A.with_hypothesis(I.documents_alignment(spark, d).drop("y"), I.hypothesis(spark, d)).select("gene", "sample", "y", F.length("seq").cast("long").alias("length"))


@query("sequence_access", "SELECT lang AS gene, doc_id AS sample, length(text) AS length, substr(text, 1, 1) AS first_site, substr(text, length(text), 1) AS last_site FROM documents")
def _(spark, d):
    t = I.read(spark, d, "documents")
    return t.select(F.col("lang").alias("gene"), F.col("doc_id").alias("sample"), F.length("text").cast("long").alias("length"), F.substring("text", 1, 1).alias("first_site"), F.expr("substring(text, length(text), 1)").alias("last_site"))


@query("length_check", "SELECT lang AS gene, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, count(DISTINCT length(text)) = 1 AS aligned FROM documents GROUP BY lang")
def _(spark, d):
    n = F.length("text").cast("long")
    return I.read(spark, d, "documents").groupBy(F.col("lang").alias("gene")).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), (F.count_distinct(n) == 1).alias("aligned"))


@query("residue_check", """SELECT doc_id AS sample, length(translate(upper(text), 'ACGTacgt?-', '')) = 0 AS nucleotide,
  length(translate(upper(text), 'ACDEFGHIKLMNPQRSTVWYBZXJUOacdefghiklmnpqrstvwybzxjuo?-*', '')) = 0 AS protein FROM documents""")
def _(spark, d):
    up = F.upper("text")
    return I.read(spark, d, "documents").select(F.col("doc_id").alias("sample"), valid_residues(up, "nucleotide").alias("nucleotide"), valid_residues(up, "protein").alias("protein"))


_GAP_SQL = """s2 AS (SELECT s.gene, s.sample, s.pos, CASE WHEN s.ch = 'N' AND s.sample % 7 = 0 THEN '-' ELSE s.ch END AS ch, s.sample // 1000 AS pair, s.sample % 2 = 0 AS control FROM sites s),
pp AS (SELECT gene, pos, pair, count(*) FILTER (WHERE ch IN ('-', '?')) AS gaps, count(*) FILTER (WHERE ch NOT IN ('-', '?')) AS chars FROM s2 GROUP BY ALL),
st AS (SELECT gene, pos, count(*) FILTER (WHERE gaps = 0 AND chars >= 2) AS whole, count(*) FILTER (WHERE gaps > 0) AS broken FROM pp GROUP BY ALL),
kd AS (SELECT gene, pos, count(DISTINCT ch) AS kinds FROM s2 WHERE ch NOT IN ('-', '?') GROUP BY ALL),
og AS (SELECT c.gene, c.pos, bool_or(c.ch <> o.ch) AS differs FROM s2 c JOIN s2 o ON c.gene = o.gene AND c.pos = o.pos AND o.sample = 1 WHERE c.control GROUP BY ALL)"""


def _gaps(spark, d, **k):
    s = I.line_sites(spark, d).withColumn("ch", F.when((F.col("ch") == "N") & (F.col("sample") % 7 == 0), "-").otherwise(F.col("ch")))
    pairs = s.select("sample", F.floor(F.col("sample") / 1000).alias("pair"), (F.col("sample") % 2 == 0).alias("control")).distinct()
    return A.gap_cancelled(s, pairs, **k)


_LOST = "SELECT s2.gene, s2.pos, s2.sample, CASE WHEN {0} THEN '-' ELSE s2.ch END AS ch FROM s2 JOIN pp USING (gene, pos, pair) JOIN st USING (gene, pos) LEFT JOIN kd USING (gene, pos) LEFT JOIN og USING (gene, pos)"


@query("gap_cancel", _lines(_GAP_SQL) + _LOST.format("st.broken > 0"))
def _(spark, d):
    return _gaps(spark, d)


@query("gap_cancel_partner", _lines(_GAP_SQL) + _LOST.format("pp.gaps > 0 OR st.whole < 2"))
def _(spark, d):
    return _gaps(spark, d, partner_only=True)


@query("tri_allelic", _lines(_GAP_SQL) + _LOST.format("pp.gaps > 0 OR st.whole < 2 OR coalesce(kd.kinds > 2, false)"))
def _(spark, d):
    return _gaps(spark, d, partner_only=True, tri_allelic=True)


@query("outgroup_cancel", _lines(_GAP_SQL) + _LOST.format("pp.gaps > 0 OR st.whole < 2 OR coalesce(og.differs, false)"))
def _(spark, d):
    return _gaps(spark, d, partner_only=True, outgroup=1)


@query("full_deletions", """SELECT CAST(turn AS VARCHAR) AS gene, conv_id AS sample, text AS seq FROM conversations
WHERE turn IN (SELECT turn FROM conversations GROUP BY turn HAVING count(DISTINCT conv_id) = (SELECT count(DISTINCT conv_id) FROM conversations))""")
def _(spark, d):
    a = I.turns_alignment(spark, d)
    return A.with_all(a, a)


# ---------------------------------------------------------------- hypothesis, classes, folds


@query("class_counts", "WITH " + HYP + " SELECT count(*) FILTER (WHERE y > 0) AS n_pos, count(*) FILTER (WHERE y < 0) AS n_neg, round(count(*) FILTER (WHERE y > 0) / count(*), 9) AS m1 FROM hyp WHERE y <> 0")
def _(spark, d):
    return S.class_counts(I.hypothesis(spark, d)).withColumn("m1", F.round("m1", 9))


@query("cv_folds", "SELECT doc_id AS sample, CAST(doc_id % 5 AS INTEGER) AS fold FROM labels")
def _(spark, d):
    return S.folds(I.hypothesis(spark, d), 5).select("sample", "fold")


@query("downsample", "WITH " + HYP + """, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(sample AS VARCHAR)), sample) AS place FROM hyp WHERE y <> 0)
SELECT sample, y FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM hyp WHERE y <> 0 GROUP BY y))""")
def _(spark, d):
    return S.downsample(I.hypothesis(spark, d), F.md5(F.col("sample").cast("string").cast("binary"))).select("sample", "y")


@query("upsample", "WITH " + HYP + """, c AS (SELECT y, count(*) AS n FROM hyp WHERE y <> 0 GROUP BY y),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(sample AS VARCHAR)), sample) AS place FROM hyp WHERE y <> 0)
SELECT sample, r.y, CAST((SELECT max(n) FROM c) // c.n + CASE WHEN place <= (SELECT max(n) FROM c) % c.n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r JOIN c ON r.y = c.y""")
def _(spark, d):
    return S.upsample(I.hypothesis(spark, d), F.md5(F.col("sample").cast("string").cast("binary"))).select("sample", "y", "copies")


# ---------------------------------------------------------------- grids and group terms


@query("lambda_grid", """SELECT CAST(i * 3 + j AS INTEGER) AS idx, round(1e-1 + 1e-1 * i, 6) AS l1, round(1e-1 + 1e-1 * j, 6) AS l2 FROM range(3) a(i), range(3) b(j)""")
def _(spark, d):
    return spark.createDataFrame(grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1)), "idx int, l1 double, l2 double")


@query("penalty_terms", _docs(COUNTS, STATS) + """, v AS (SELECT gene, count(*) FILTER (WHERE alleles >= 2 AND alleles <> total AND n_major <> total - 1) AS n FROM stats GROUP BY gene)
SELECT floor(median(n) FILTER (WHERE n > 0)) AS term FROM v""")
def _(spark, d):
    v = A.variable_sites(A.site_stats(_counts(spark, d))).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return v.where("n > 0").agg(F.floor(F.percentile("n", F.lit(0.5))).cast("double").alias("term"))


@query("group_weights", _docs(COUNTS, STATS, FEATS) + """, v AS (SELECT gene, count(*) FILTER (WHERE alleles >= 2 AND alleles <> total AND n_major <> total - 1) AS n_var FROM stats GROUP BY gene),
g AS (SELECT gene, count(*) AS n_columns FROM feats GROUP BY gene)
SELECT gene, round(sqrt(n_columns), 9) AS std, round(sqrt(n_var), 9) AS root, CAST(n_var + 1 AS DOUBLE) AS linear FROM g JOIN v USING (gene)""")
def _(spark, d):
    counts = _counts(spark, d)
    v = A.variable_sites(A.site_stats(counts)).groupBy("gene").agg(F.count(F.lit(1)).alias("n_var"))
    g = A.gene_sizes(A.features(counts)).join(v, "gene", "left").fillna(0)
    return g.select("gene", F.round(F.sqrt("n_columns"), 9).alias("std"), F.round(F.sqrt("n_var"), 9).alias("root"), (F.col("n_var") + 1.0).alias("linear"))


_GRAD = """m AS (SELECT vec_id AS sample, CAST(unnest(range(len(embedding))) AS BIGINT) AS col_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
t AS (SELECT vec_id AS sample, CASE WHEN label = 0 THEN 1e0 ELSE -1e0 END AS y FROM embeddings),
k AS (SELECT count(*) FILTER (WHERE y > 0) / count(*) AS m1, count(*) AS n FROM t),
b AS (SELECT sample, CASE WHEN y > 0 THEN (1 - m1) / n ELSE -m1 / n END AS b FROM t, k),
g AS (SELECT col_id, printf('g%02d', col_id // 8) AS gene, abs(sum(value * b)) AS grad FROM m JOIN b USING (sample) GROUP BY ALL)"""


def _grads(spark, d):
    return S.penalty_scale(I.embedding_matrix(spark, d), I.embedding_target(spark, d))


@query("lambda1_max", "WITH " + _GRAD + " SELECT round(max(grad), 6) AS lambda1_max FROM g")
def _(spark, d):
    return S.lambda1_max(_grads(spark, d)).select(F.round("lambda1_max", 6).alias("lambda1_max"))


@query("lambda2_max", "WITH " + _GRAD + """, top AS (SELECT max(grad) AS x FROM g)
SELECT gene, round(sqrt(sum(greatest(grad - 0.1 * x, 0) ** 2)) / sqrt(count(*)), 6) AS lambda2_bound FROM g, top GROUP BY gene""")
def _(spark, d):
    return S.lambda2_max(_grads(spark, d), 0.1).select("gene", F.round("lambda2_bound", 6).alias("lambda2_bound"))


@query("soft_threshold", "SELECT l_orderkey, l_linenumber, round(sign(l_tax - 0.04) * greatest(abs(l_tax - 0.04) - 0.015, 0), 6) AS v FROM lineitem")
def _(spark, d):
    return I.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(soft_threshold(F.col("l_tax") - 0.04, 0.015), 6).alias("v"))


@query("group_shrink", """WITH n AS (SELECT l_orderkey, sqrt(sum(l_tax * l_tax)) AS norm FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, round(CASE WHEN norm > 0.05 THEN l_tax * (norm - 0.05) / norm ELSE 0 END, 6) AS v FROM lineitem JOIN n USING (l_orderkey)""")
def _(spark, d):
    t = I.read(spark, d, "lineitem")
    n = t.groupBy("l_orderkey").agg(F.sqrt(F.sum(F.col("l_tax") ** 2)).alias("norm"))
    return t.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(group_shrink(F.col("l_tax"), F.col("norm"), 0.05), 6).alias("v"))


@query("logistic_terms", "SELECT event_id, round(ln(1 + exp(-abs(value))) + greatest(value, 0), 6) AS loss, round(1 / (1 + exp(-value)), 6) AS probability FROM events WHERE value IS NOT NULL")
def _(spark, d):
    v = F.col("value")
    return I.read(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round(logistic_loss(v), 6).alias("loss"), F.round(sigmoid(v), 6).alias("probability"))


@query("labels_round_trip", _lines(COUNTS, STATS, FEATS) + "SELECT gene || '_' || pos || '_' || allele AS label, gene, CAST(pos AS INTEGER) AS pos, allele FROM feats")
def _(spark, d):
    made = A.features(A.allele_counts(A.ungapped(I.line_sites(spark, d)))).select(label(F.col("gene"), F.col("pos"), F.col("allele")).alias("label"))
    return made.withColumn("p", label_parts(F.col("label"))).select("label", "p.gene", "p.pos", "p.allele")


@query("stems", r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '') AS stem FROM pages")
def _(spark, d):
    return I.read(spark, d, "pages").select("page_id", stem(F.col("url")).alias("stem"))


# ---------------------------------------------------------------- scores


@query("significance", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """SELECT CASE WHEN grouping(gene) = 1 THEN 'all' WHEN grouping(pos) = 1 THEN 'gene' ELSE 'position' END AS level, gene, pos, round(sum(abs(w)), 6) AS score
FROM wts WHERE w <> 0 GROUP BY GROUPING SETS ((gene, pos), (gene), ())""")
def _(spark, d):
    return S.significance(_line_weights(spark, d)).withColumn("score", F.round("score", 6))


@query("gss", _docs(COUNTS, STATS, FEATS, INDEX, WEIGHT) + "SELECT gene, round(sum(abs(w)), 6) AS score FROM wts WHERE w <> 0 GROUP BY gene")
def _(spark, d):
    return S.gene_scores(I.made_weights(_index(spark, d))).withColumn("score", F.round("score", 6))


@query("pss", _docs(COUNTS, STATS, FEATS, INDEX, WEIGHT) + "SELECT gene, pos, round(sum(abs(w)), 6) AS score FROM wts WHERE w <> 0 GROUP BY gene, pos")
def _(spark, d):
    return S.position_scores(I.made_weights(_index(spark, d))).withColumn("score", F.round("score", 6))


@query("hss", _docs(COUNTS, STATS, FEATS, INDEX, WEIGHT) + "SELECT round(sum(abs(w)), 6) AS score FROM wts")
def _(spark, d):
    return S.total_score(I.made_weights(_index(spark, d))).withColumn("score", F.round("score", 6))


def _line_runs(spark, d):
    return I.run_weights(_line_index(spark, d))


@query("score_levels", _lines(COUNTS, STATS, FEATS, INDEX, RUNS) + """SELECT CAST(run AS INTEGER) AS run, CASE WHEN grouping(gene) = 1 THEN 'all' WHEN grouping(pos) = 1 THEN 'gene' ELSE 'position' END AS level,
  gene, pos, round(sum(abs(w)), 6) AS score FROM rw WHERE w <> 0 GROUP BY GROUPING SETS ((run, gene, pos), (run, gene), (run))""")
def _(spark, d):
    return S.score_levels(_line_runs(spark, d), "run").withColumn("score", F.round("score", 6))


@query("nonzero_genes", _lines(COUNTS, STATS, FEATS, INDEX, RUNS) + "SELECT CAST(run AS INTEGER) AS run, count(DISTINCT gene) FILTER (WHERE w <> 0) AS n_genes FROM rw GROUP BY run")
def _(spark, d):
    return S.nonzero_genes(_line_runs(spark, d), "run")


@query("gss_median", _lines(COUNTS, STATS, FEATS, INDEX, RUNS) + ", g AS (SELECT run, gene, sum(abs(w)) AS s FROM rw WHERE w <> 0 GROUP BY ALL) SELECT gene, round(" + MED.format("s") + ", 6) AS median FROM g GROUP BY gene HAVING " + MED.format("s") + " <> 0")
def _(spark, d):
    return S.grid_median(S.gene_scores(_line_runs(spark, d), "run"), "score", "gene").withColumn("median", F.round("median", 6))


@query("pss_median", _lines(COUNTS, STATS, FEATS, INDEX, RUNS) + ", g AS (SELECT run, gene, pos, sum(abs(w)) AS s FROM rw WHERE w <> 0 GROUP BY ALL) SELECT gene, pos, round(" + MED.format("s") + ", 6) AS median FROM g GROUP BY gene, pos HAVING " + MED.format("s") + " <> 0")
def _(spark, d):
    return S.grid_median(S.position_scores(_line_runs(spark, d), "run"), "score", "gene", "pos").withColumn("median", F.round("median", 6))


@query("bss_median", _lines(COUNTS, STATS, FEATS, INDEX, RUNS) + ", g AS (SELECT * FROM rw WHERE w <> 0) SELECT col_id, round(" + MED.format("w") + ", 6) AS median, CAST(min(run) AS INTEGER) AS first_run FROM g GROUP BY col_id HAVING " + MED.format("w") + " <> 0")
def _(spark, d):
    return S.base_medians(_line_runs(spark, d)).withColumn("median", F.round("median", 6))


@query("median_over_runs", "SELECT event_type, round(" + MED.format("value") + ", 6) AS median FROM events GROUP BY event_type")
def _(spark, d):
    return I.read(spark, d, "events").groupBy("event_type").agg(F.round(median_nonzero(F.col("value")), 6).alias("median"))


_CELLS = "cells AS (SELECT i.col_id, i.gene, s.sample, i.w FROM sites s JOIN wts i ON s.gene = i.gene AND s.pos = i.pos AND s.ch = i.allele)"
_PRED = """pred AS (SELECT c.sample, round(0.25 + sum(c.w), 6) AS prediction, h.y FROM cells c JOIN hyp h USING (sample) GROUP BY c.sample, h.y)"""


def _predicted(spark, d):
    one = spark.createDataFrame([(0, 0.25)], "run int, intercept double")
    w = _line_weights(spark, d).withColumn("run", F.lit(0))
    return S.predictions(_line_cells(spark, d), w, one, "run").withColumn("prediction", F.round("prediction", 6)).join(I.order_hypothesis(spark, d).select("sample", "y"), "sample")


@query("predictions", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT, _CELLS, _PRED) + """SELECT sample, prediction, round(1 / (1 + exp(-prediction)), 5) AS probability, CASE WHEN prediction > 0 THEN 1 ELSE -1 END AS class FROM pred""")
def _(spark, d):
    p = _predicted(spark, d)
    return p.select("sample", "prediction", F.round(sigmoid(F.col("prediction")), 5).alias("probability"), F.when(F.col("prediction") > 0, 1).otherwise(-1).alias("class"))


@query("gene_contributions", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT, _CELLS) + "SELECT sample, gene, round(sum(w), 6) AS score FROM cells WHERE w <> 0 GROUP BY ALL")
def _(spark, d):
    return S.gene_contributions(_line_cells(spark, d), _line_weights(spark, d)).withColumn("score", F.round("score", 6))


@query("confusion", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT, _CELLS, _PRED) + """, c AS (SELECT count(*) FILTER (WHERE prediction > 0 AND y > 0) AS tp, count(*) FILTER (WHERE prediction <= 0 AND y <= 0) AS tn,
 count(*) FILTER (WHERE prediction > 0 AND y <= 0) AS fp, count(*) FILTER (WHERE prediction <= 0 AND y > 0) AS fn, sqrt(avg((prediction - y) ** 2)) AS rmse FROM pred WHERE y <> 0)
SELECT tp, tn, fp, fn, round(rmse, 6) AS rmse, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS tpr, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS tnr,
 round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c""")
def _(spark, d):
    c = S.confusion(_predicted(spark, d).where("y <> 0"))
    return c.select("tp", "tn", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("rmse", "tpr", "tnr", "fpr", "fnr", "accuracy")])


@query("ssq_topk", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT, _CELLS) + """, g AS (SELECT sample, gene, sum(w) AS s FROM cells WHERE w <> 0 GROUP BY ALL)
SELECT gene, round(sum(s * s), 4) AS ssq, round(max(abs(s)), 6) AS max_abs FROM g GROUP BY gene ORDER BY 2 DESC, 1 LIMIT 100""")
def _(spark, d):
    return S.top_by_square(S.gene_contributions(_line_cells(spark, d), _line_weights(spark, d))).select("gene", F.round("ssq", 4).alias("ssq"), F.round("max_abs", 6).alias("max_abs"))


@query("heatmap_order", """SELECT vec_id AS sample, label AS run, round(CAST(embedding[1] AS DOUBLE), 6) AS prediction, CASE WHEN embedding[2] < 0 THEN -1e0 ELSE 1e0 END AS y,
CAST(row_number() OVER (PARTITION BY label ORDER BY CASE WHEN embedding[2] < 0 THEN 0 ELSE 1 END, CASE WHEN embedding[2] < 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) ELSE -round(CAST(embedding[1] AS DOUBLE), 6) END, vec_id) AS INTEGER) AS row FROM embeddings""")
def _(spark, d):
    e = I.read(spark, d, "embeddings")
    return S.heatmap_order(e.select(F.col("vec_id").alias("sample"), F.col("label").alias("run"), F.round(F.col("embedding")[0].cast("double"), 6).alias("prediction"), F.when(F.col("embedding")[1] < 0, -1.0).otherwise(1.0).alias("y")))


@query("gene_ranks", """WITH s AS (SELECT l_suppkey AS run, 'p' || (l_partkey % 50) AS gene, round(sum(l_extendedprice), 2) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, gene) AS rank FROM s)
SELECT gene, max(score) AS best_score, min(rank) AS best_rank, count(*) AS n_ranked FROM r GROUP BY gene""")
def _(spark, d):
    s = I.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("gene")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return S.gene_ranks(s, "run")


@query("clade_negatives", """SELECT doc_id AS sample FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1""")
def _(spark, d):
    return I.read(spark, d, "documents").select(F.col("doc_id").alias("sample")).subtract(I.read(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("spanning_positions", _docs(COUNTS, STATS, FEATS) + "SELECT gene, count(DISTINCT pos) AS n_positions, count(DISTINCT pos) >= 2 AS enough FROM feats GROUP BY gene")
def _(spark, d):
    return _feats(spark, d).groupBy("gene").agg(F.count_distinct("pos").alias("n_positions")).withColumn("enough", F.col("n_positions") >= 2)
