"""Queries that run the readers, writers and driver-side steps of workflows on the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids
from ..functions.columns import MINOR_POS, valid_residues
from ..operators import labels
from ..operators import scores as S
from ..operators import sites as A
from ..sources import fasta, newick, tables, texts
from ..sources.scratch import scratch_folder, settled
from ..streaming import gather
from . import inputs as I  # noqa: E741
from . import workflows as W
from .catalogue import COUNTS, FEATS, HYP, INDEX, STATS, WEIGHT, _line_cells, _line_index, _line_weights, _lines, query
from .train import evaluate

# ---------------------------------------------------------------- readers


def _fasta_files(spark, d):
    """A file per document: its letters, and the same backwards."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\n]", "")
    content = F.concat(F.lit(">first "), F.col("doc_id").cast("string"), F.lit("\n"), letters, F.lit("\n\n> second\n"), F.reverse(F.replace(letters, F.lit("\n"), F.lit(""))), F.lit("\n"))
    path = F.concat(F.lit("/d/"), "lang", F.lit("."), F.col("doc_id").cast("string"), F.lit(".fa"))
    return I.read(spark, d, "documents").select(path.alias("path"), F.timestamp_seconds("doc_id").alias("modificationTime"), content.cast("binary").alias("content"))


_LETTERS = "d AS (SELECT lang || '.' || doc_id AS gene, doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents)"


@query("fasta_parse", "WITH " + _LETTERS + """ SELECT gene, 'first ' || doc_id AS sample, 0 AS seq_ord, md5(seq) AS seq_md5 FROM d
UNION ALL SELECT gene, 'second', 1, md5(reverse(seq)) FROM d""")
def _(spark, d):
    return fasta.parsed(_fasta_files(spark, d)).select("gene", "sample", "seq_ord", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("ingest_catalogue", "WITH " + _LETTERS + " SELECT gene, CAST(2 AS BIGINT) AS num_sequences, CAST(length(seq) AS INTEGER) AS alignment_length, 'universal' AS datatype FROM d")
def _(spark, d):
    """The files are stored twice: the second time they are known."""
    out = scratch_folder(spark, "catalogue")
    for _ in range(2):
        fasta.store(_fasta_files(spark, d), out)
    return fasta.catalogue(spark, out).select("gene", "num_sequences", "alignment_length", "datatype")


def _order_sequences(spark, d):
    """Orders as sequences: the customer's in the gene of the month, of which the last counts; dear ones are long, cheap ones foreign,
    and the dearest stand for files with a fault."""
    fault, price, day = F.col("o_totalprice") >= 499800, F.col("o_totalprice"), F.to_date("o_orderdate")
    seq = F.concat(F.when(price < 1300, F.lit("1")).otherwise(F.col("o_orderstatus")), F.when(price > 499400, F.lit("A")).otherwise(F.lit("")))
    return I.read(spark, d, "orders").select(
        F.date_format(day, "yyyyMM").alias("gene"), F.concat(F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), F.unix_date(day).cast("long").alias("modified"),
        F.when(~fault, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("sample"), F.when(~fault, F.lit(0)).alias("seq_ord"), F.when(~fault, seq).alias("seq"),
        F.when(fault, F.lit("no sequences")).alias("error"))


@query("gathered_genes", """WITH o AS (SELECT strftime(o_orderdate, '%Y%m') AS gene, '/' || o_orderkey AS path, CAST(o_orderdate AS DATE) AS modified, o_totalprice >= 499800 AS fault, 'c' || o_custkey AS sample,
  CASE WHEN o_totalprice < 1300 THEN '1' ELSE o_orderstatus END || CASE WHEN o_totalprice > 499400 THEN 'A' ELSE '' END AS seq FROM orders),
last AS (SELECT * FROM o WHERE NOT fault QUALIFY row_number() OVER (PARTITION BY gene, sample ORDER BY modified DESC, path DESC) = 1),
g AS (SELECT gene, count(*) AS n, min(length(seq)) AS short, max(length(seq)) AS long, bool_or(starts_with(seq, '1')) AS foreign_ FROM last GROUP BY gene),
e AS (SELECT gene, CASE WHEN bool_or(fault) THEN 'no sequences' END AS fault FROM o GROUP BY gene),
v AS (SELECT gene, coalesce(n, 0) AS n, long, coalesce(fault, CASE WHEN short <> long THEN 'sequences differ in length' WHEN foreign_ THEN 'residues outside protein' END) AS error FROM e LEFT JOIN g USING (gene))
SELECT gene, CAST(n AS BIGINT) AS num_sequences, CAST(CASE WHEN error IS NULL THEN long END AS INTEGER) AS alignment_length, error FROM v""")
def _(spark, d):
    """Verdicts over a stream that takes the sequences two files at a time."""
    out = scratch_folder(spark, "gathered")
    gather.measured(_order_sequences(spark, d), "protein").repartition(4).write.parquet(f"{out}/sequences")
    gather.judge(spark, f"{out}/sequences", f"{out}/verdicts", f"{out}/check", files_per_batch=2)
    return gather.genes(spark, out, "protein")


@query("one_sequence", "SELECT conv_id AS sample, text AS seq FROM conversations WHERE role = 'user' AND turn = 2")
def _(spark, d):
    return fasta.sequence(I.roles_alignment(spark, d), "user", 2)


@query("one_position", "SELECT conv_id AS sample, turn AS seq_ord, substr(text, 5, 1) AS ch FROM conversations WHERE role = 'user'")
def _(spark, d):
    return fasta.position(I.roles_alignment(spark, d), "user", 4)


_NAMES = """stems AS (SELECT DISTINCT unnest([r_name, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '_' || n_name END]) AS gene FROM region JOIN nation ON n_regionkey = r_regionkey),
labels AS (SELECT r_name || '_' || n_name || '_' || c_custkey AS label, c_acctbal AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 11 > 0
           UNION ALL SELECT n_name || '_' || c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 11 = 0)"""


def _labelled(spark, d):
    """Weights of labels that begin with a region, or a region and a nation of even number, or with neither; and these names."""
    places = I.read(spark, d, "nation").join(I.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = F.concat_ws("_", "r_name", "n_name")
    genes = places.select("r_name").unionByName(places.where("n_nationkey % 2 = 0").select(both.alias("r_name"))).select(F.col("r_name").alias("gene"))
    key, odd = F.col("c_custkey").cast("string"), F.col("c_custkey") % 11 > 0
    met = I.read(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select(F.concat_ws("_", F.when(odd, F.col("r_name")), "n_name", key).alias("label"), F.col("c_acctbal").alias("w")), genes


@query("label_genes", "WITH " + _NAMES + """ SELECT label, arg_max(gene, length(gene)) AS gene, substr(label, max(length(gene)) + 2) AS rest
FROM labels LEFT JOIN stems ON starts_with(label, gene || '_') AND length(label) > length(gene) + 1 GROUP BY label""")
def _(spark, d):
    weights, genes = _labelled(spark, d)
    return labels.resolved(weights, genes)


@query("weights_reread", "WITH " + _NAMES + """, m AS (SELECT label, w, arg_max(gene, length(gene)) AS gene FROM labels LEFT JOIN stems ON starts_with(label, gene || '_') GROUP BY label, w)
SELECT gene, round(sum(abs(w)), 4) AS score, count(*) AS n FROM m WHERE gene IS NOT NULL GROUP BY gene""")
def _(spark, d):
    """Written as a weights file, read back, and scored by gene."""
    weights, genes = _labelled(spark, d)
    out = scratch_folder(spark, "weights")
    weights.select(F.concat_ws("\t", "label", F.format_string("%.17e", "w")).alias("value")).write.mode("overwrite").text(f"{out}/lambda_0")
    found = texts.read_weights(spark, f"{out}/lambda_0/part-*")
    met = found.join(labels.resolved(found, genes), "label").where("gene IS NOT NULL")
    return met.groupBy("gene").agg(F.round(F.sum(F.abs("w")), 4).alias("score"), F.count(F.lit(1)).alias("n"))


@query("numeric_long", "SELECT CAST(vec_id AS VARCHAR) AS sample, CAST(unnest(range(len(embedding))) AS INTEGER) AS feature, CAST(unnest(embedding) AS FLOAT) AS value FROM embeddings")
def _(spark, d):
    """Written as a whitespace table and read back."""
    out = scratch_folder(spark, "numeric")
    row = F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("string")), "  "))
    I.read(spark, d, "embeddings").select(row.alias("value")).write.mode("overwrite").text(out)
    return tables.read_numeric(spark, f"{out}/part-*").select("sample", "feature", "value")


@query("hypothesis_read", "WITH " + HYP + " SELECT CAST(sample AS VARCHAR) AS sample, y FROM hyp")
def _(spark, d):
    out = scratch_folder(spark, "hypothesis")
    row = F.concat_ws("\t", F.col("sample").cast("string"), F.col("y").cast("int").cast("string"))
    I.hypothesis(spark, d).select(row.alias("value")).write.mode("overwrite").text(out)
    return tables.read_hypothesis(spark, f"{out}/part-*").select("sample", "y")


@query("residue_domains", "SELECT doc_id AS sample, length(translate(upper(text), 'ACGTacgt?-', '')) = 0 AS nucleotide FROM documents")
def _(spark, d):
    domains = tables.read_domains("[nucleotide]\nACGTacgt\n?-\n[other]\nXY\n")
    return I.read(spark, d, "documents").select(F.col("doc_id").alias("sample"), valid_residues(F.upper("text"), "nucleotide", domains).alias("nucleotide"))


@query("gene_predictions_read", """SELECT CAST(vec_id AS VARCHAR) AS sample, CAST(label AS DOUBLE) AS y, 'g' || j AS gene,
  CASE WHEN (vec_id + j) % 7 = 0 THEN NULL ELSE round(CAST(embedding[j + 1] AS DOUBLE), 6) END AS score FROM embeddings, range(4) t(j)""")
def _(spark, d):
    """Written as the text file of an evaluation and read back."""
    out = scratch_folder(spark, "predictions")
    e = I.read(spark, d, "embeddings").select(F.lit(0).alias("run"), F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y"), F.lit(0.0).alias("prediction"), "embedding")
    long = e.select("run", "sample", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "embedding").where((F.col("sample") + F.col("j")) % 7 != 0)
    long = long.select("run", "sample", F.concat(F.lit("g"), F.col("j").cast("string")).alias("gene"), F.element_at("embedding", F.col("j") + 1).cast("double").alias("score"))
    texts.write(out, texts.prediction_lines(e.drop("embedding"), long, F.lit("eval.txt"), ["run"]))
    return tables.read_gene_predictions(spark, f"{out}/eval.txt").select("sample", "y", "gene", "score")


def _nations(spark, d):
    """(region, nation, its key), by region and name: 25 rows."""
    n = I.read(spark, d, "nation").join(I.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return [tuple(r) for r in n.orderBy("r_name", "n_name").select("r_name", "n_name", "n_nationkey", "r_regionkey").collect()]


_NATIONS = "n AS (SELECT dense_rank() OVER (ORDER BY r_name) - 1 AS g, n_name, n_nationkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("list_groups", "WITH " + _NATIONS + """, f AS (SELECT n_name, g FROM n ORDER BY g, n_name LIMIT 1)
SELECT CAST(g AS INTEGER) AS "group", n_name AS gene, '/d/x/' || n_name || '.fa' AS path FROM n
UNION ALL SELECT CAST(r.g AS INTEGER), f.n_name, '/d/x/' || f.n_name || '.fa' FROM f, (SELECT DISTINCT g FROM n) r WHERE r.g <> f.g""")
def _(spark, d):
    rows = _nations(spark, d)
    regions = dict.fromkeys(r[0] for r in rows)
    again = f"y/{rows[0][1]}.fa"  # a second file of the first gene: the first one counts
    text = "\n\n".join(",".join([f" x\\{r[1]}.fa" for r in rows if r[0] == region] + [again]) for region in regions)
    twice = tables.read_list(text + "\n" + text, "/d")
    return spark.createDataFrame(tables.unique_groups(twice), "group int, gene string, path string")


def _tree(spark, d):
    rows = _nations(spark, d)
    parts = {}
    for region, nation, key, code in rows:
        parts.setdefault((region, code), []).append(f"'{nation}':{key}")
    return newick.parse("(" + ",".join(f"({','.join(p)})'{region}':{code / 2}" for (region, code), p in parts.items()) + ");")


@query("leaf_distances", "WITH " + _NATIONS + " SELECT n_name AS leaf, n_nationkey + r_regionkey / 2.0e0 AS distance FROM n")
def _(spark, d):
    return spark.createDataFrame(newick.leaf_distances(_tree(spark, d)), "leaf string, distance double")


@query("clade_hypotheses", "WITH " + _NATIONS + """, c AS (SELECT DISTINCT r_name AS clade FROM n)
SELECT clade, n_name AS sample, CASE WHEN r_name = clade THEN 1e0 ELSE -1e0 END AS y FROM c, n""")
def _(spark, d):
    return W.clade_hypotheses(spark, _tree(spark, d), balance="none").select("clade", "sample", "y")


# ---------------------------------------------------------------- grids and selection


@query("lambda_file", "SELECT CAST(n_nationkey AS INTEGER) AS idx, (n_nationkey + 1) / 100.0e0 AS l1, (n_nationkey + 2) / 100.0e0 AS l2 FROM nation")
def _(spark, d):
    keys = sorted(r[2] for r in _nations(spark, d))
    text = "# penalties\n\n" + "\n".join(f"{(k + 1) / 100}\t{(k + 2) / 100}  # {k}" for k in keys)
    return spark.createDataFrame(grids.parse_lambda_file(text), "idx int, l1 double, l2 double")


@query("log_grids", """SELECT 'range' AS kind, CAST(i AS INTEGER) AS i, round(pow(10, log10(0.01) + (log10(0.99) - log10(0.01)) * i / 19), 9) AS v FROM range(20) t(i)
UNION ALL SELECT 'sweep', CAST(i AS INTEGER), round(0.1 * pow(0.9 / 0.1, i / 8.0), 9) FROM range(9) t(i)""")
def _(spark, d):
    rows = [("range", i, round(v, 9)) for i, v in enumerate(grids.log_grid(0.01, 0.99, 20))]
    rows += [("sweep", i, round(v, 9)) for i, v in enumerate(grids.sweep(0.1, 0.9, 0.1, logspace=True))]
    return spark.createDataFrame(rows, "kind string, i int, v double")


def _sizes(spark, d):
    """Lines per supplier group, by name: a handful."""
    gene = F.format_string("s%02d", F.col("l_suppkey") % 40)
    return [(r.gene, r.n) for r in I.read(spark, d, "lineitem").groupBy(gene.alias("gene")).agg(F.count(F.lit(1)).alias("n")).orderBy("gene").collect()]


_SIZES = """s AS (SELECT printf('s%02d', l_suppkey % 40) AS gene, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY gene) AS i FROM s),
t AS (SELECT sum(n) AS total, floor(sum(n) / 3) AS budget FROM s), p AS (SELECT total / ceil(total / greatest(1, floor(budget / 2))) AS target, budget FROM t)"""


@query("adaptive_chunks", "WITH RECURSIVE " + _SIZES + """, w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk, CAST(0 AS DOUBLE) AS used, '' AS gene
 UNION ALL SELECT o.i, CASE WHEN w.used > 0 AND w.used + o.n > p.target THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used > 0 AND w.used + o.n > p.target THEN o.n ELSE w.used + o.n END, o.gene
 FROM w JOIN o ON o.i = w.i + 1, p)
SELECT gene, CAST(chunk AS INTEGER) AS chunk FROM w WHERE i > 0""")
def _(spark, d):
    sizes = _sizes(spark, d)
    parts = W.chunks(sizes, sum(n for _, n in sizes) // 3)
    return spark.createDataFrame([(g, i) for i, part in enumerate(parts) for g in part], "gene string, chunk int")


@query("adaptive_pairs", "WITH c AS (SELECT DISTINCT n_regionkey AS chunk FROM nation) SELECT a.chunk AS first, b.chunk AS second FROM c a JOIN c b ON a.chunk < b.chunk")
def _(spark, d):
    n = len({r[3] for r in _nations(spark, d)})
    return spark.createDataFrame(W.chunk_pairs(n), "first int, second int")


@query("greedy_fit", "WITH RECURSIVE " + _SIZES + """, r AS (SELECT gene, n, row_number() OVER (ORDER BY n % 7 DESC, gene) AS i FROM s),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS used, false AS fits, '' AS gene UNION ALL
 SELECT r.i, CASE WHEN w.used + r.n <= p.budget THEN w.used + r.n ELSE w.used END, w.used + r.n <= p.budget, r.gene FROM w JOIN r ON r.i = w.i + 1, p)
SELECT gene FROM w WHERE fits""")
def _(spark, d):
    sizes = _sizes(spark, d)
    chosen = W.best_fitting([(g, float(n % 7), n) for g, n in sizes], sum(n for _, n in sizes) // 3)
    return spark.createDataFrame([(g,) for g in chosen], "gene string")


@query("summed_scores", """SELECT gene, round(sum(score), 2) AS score FROM (SELECT 's' || (l_suppkey % 40) AS gene, l_extendedprice AS score FROM lineitem) GROUP BY gene""")
def _(spark, d):
    lines = I.read(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("gene"), F.col("l_extendedprice").alias("score"))
    return S.summed_scores(lines).withColumn("score", F.round("score", 2))


# ---------------------------------------------------------------- encoding, evaluation and files of models

_MINOR = f"""mf AS (SELECT gene, pos, allele FROM feats UNION ALL SELECT DISTINCT gene, {MINOR_POS}, 'minor' FROM feats WHERE allele <> major),
mx AS (SELECT *, row_number() OVER (ORDER BY gene, pos, ascii(allele), allele) - 1 AS col_id FROM mf)"""


def _minor_index(spark, d):
    feats = settled(A.features(A.allele_counts(A.ungapped(I.line_sites(spark, d)))), "features")
    return settled(A.feature_index(feats.unionByName(A.minor_features(feats), allowMissingColumns=True)), "index")


@query("minor_index", _lines(COUNTS, STATS, FEATS, _MINOR) + "SELECT gene, CAST(pos AS INTEGER) AS pos, allele, col_id FROM mx")
def _(spark, d):
    return _minor_index(spark, d).select("gene", F.col("pos").cast("int").alias("pos"), "allele", "col_id")


@query("minor_cells", _lines(COUNTS, STATS, FEATS, _MINOR) + f"""SELECT DISTINCT m.col_id, s.sample FROM sites s JOIN feats f ON s.gene = f.gene AND s.pos = f.pos AND s.ch = f.allele AND f.allele <> f.major
JOIN mx m ON m.gene = s.gene AND m.pos = {MINOR_POS}""")
def _(spark, d):
    return A.minor_cells(A.ungapped(I.line_sites(spark, d)), _minor_index(spark, d))


@query("repeated_ids", """WITH last AS (SELECT role AS gene, conv_id AS sample, text AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY role, conv_id ORDER BY turn DESC) = 1),
s AS (SELECT gene, unnest(string_split(seq, '')) AS ch, CAST(unnest(range(length(seq))) AS INTEGER) AS pos FROM last)
SELECT gene, pos, ch, count(*) AS n FROM s WHERE ch NOT IN ('-', '?') GROUP BY ALL""")
def _(spark, d):
    met = A.one_of_each(I.roles_alignment(spark, d)).select("gene", "sample", "seq")
    return A.allele_counts(A.ungapped(A.explode_sites(met)))


@query("evaluate_penalties", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """SELECT CAST(p AS INTEGER) AS penalty_idx, 0 AS run, s.sample, round(0.25 + p + (p + 1) * coalesce(sum(i.w), 0), 6) AS prediction
FROM range(3) t(p), (SELECT gene, sample, pos, max(ch) AS ch FROM sites GROUP BY ALL) s LEFT JOIN wts i ON s.gene = i.gene AND s.pos = i.pos AND s.ch = i.allele GROUP BY p, s.sample""")
def _(spark, d):
    """A model with three penalty terms, each with weights of its own, on orders as alignments."""
    term = F.explode(F.sequence(F.lit(0), F.lit(2)))
    weights = _line_weights(spark, d).select(term.alias("penalty_idx"), F.lit(0).alias("run"), "col_id", "w").withColumn("w", F.col("w") * (F.col("penalty_idx") + 1))
    intercepts = spark.createDataFrame([(p, 0, 0.25 + p) for p in range(3)], "penalty_idx int, run int, intercept double")
    features = _line_index(spark, d).withColumn("pos", F.col("pos") - 1)  # lines count from 1, sites from 0
    from .catalogue_models import _lines as orders

    found = evaluate(orders(spark, d)[0], features, weights, intercepts)["predictions"]
    return found.select("penalty_idx", "run", "sample", F.round("prediction", 6).alias("prediction"))


@query("cv_upsampled", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """, cells AS (SELECT i.col_id, i.w, s.sample FROM sites s JOIN idx x ON s.gene = x.gene AND s.pos = x.pos AND s.ch = x.allele JOIN wts i USING (col_id)),
f AS (SELECT sample, CAST(sample % 3 AS INTEGER) AS fold, y FROM hyp UNION ALL SELECT sample, CAST((sample + 1) % 3 AS INTEGER), y FROM hyp WHERE sample % 5 = 0)
SELECT f.sample, f.fold, f.y, round(f.fold + (f.fold + 1) * coalesce(sum(c.w), 0), 6) AS prediction FROM f LEFT JOIN cells c USING (sample) GROUP BY f.sample, f.fold, f.y""")
def _(spark, d):
    """Samples that lie in two folds get the prediction of each fold's model."""
    h = I.order_hypothesis(spark, d)
    fold = lambda k: (F.col("sample") + k) % 3
    folds = h.select("sample", fold(0).cast("int").alias("fold"), "y").unionByName(h.where("sample % 5 = 0").select("sample", fold(1).cast("int").alias("fold"), "y"))
    weights = _line_weights(spark, d).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold"), "col_id", "w").withColumn("w", F.col("w") * (F.col("fold") + 1))
    intercepts = spark.createDataFrame([(k, float(k)) for k in range(3)], "fold int, intercept double")
    return S.fold_predictions(_line_cells(spark, d), folds, weights, intercepts).withColumn("prediction", F.round("prediction", 6))


@query("weights_file", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """SELECT 'penalty_0/lambda_0/weights.txt' AS file, row_number() OVER (ORDER BY col_id) AS n, gene || '_' || pos || '_' || allele AS label, round(w, 9) AS w FROM wts WHERE w <> 0
UNION ALL SELECT 'penalty_0/lambda_0/weights.txt', (SELECT count(*) + 1 FROM wts WHERE w <> 0), 'Intercept', 0.25e0""")
def _(spark, d):
    w = _line_weights(spark, d).withColumns({"penalty_idx": F.lit(0), "run": F.lit(0)})
    one = spark.createDataFrame([(0, 0, 0.25)], "penalty_idx int, run int, intercept double")
    part = F.split("value", "\t")
    return texts.weight_lines(w, one, F.concat(texts.folder(), F.lit("weights.txt"))).select("file", "n", part[0].alias("label"), F.round(part[1].cast("double"), 9).alias("w"))


@query("gss_file", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """, g AS (SELECT gene, round(sum(abs(w)), 4) AS score FROM wts WHERE w <> 0 GROUP BY gene)
SELECT 'gss_median.txt' AS file, row_number() OVER (ORDER BY score DESC, gene DESC) AS n, gene || chr(9) || printf('%.6f', score) AS value FROM g""")
def _(spark, d):
    g = S.gene_scores(_line_weights(spark, d)).withColumn("score", F.round("score", 4))
    return texts.gene_lines(g, F.lit("gss_median.txt"), form="%.6f")


@query("pss_file", _lines(COUNTS, STATS, FEATS, INDEX, WEIGHT) + """, g AS (SELECT gene, pos, round(sum(abs(w)), 4) AS score FROM wts WHERE w <> 0 GROUP BY gene, pos)
SELECT 'pss_median.txt' AS file, row_number() OVER (ORDER BY gene, pos) AS n, gene || '_' || pos || chr(9) || printf('%.6f', score) AS value FROM g""")
def _(spark, d):
    p = S.position_scores(_line_weights(spark, d)).withColumn("score", F.round("score", 4))
    return texts.position_lines(p, F.lit("pss_median.txt"), form="%.6f")
