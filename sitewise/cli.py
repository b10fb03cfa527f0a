"""Command line: python -m sitewise.cli COMMAND ...

train, evaluate, clades, dropout, contrasts, ingest, info, visualize; each reads
text inputs, runs its workflow and writes Parquet, text files and SVG under --out.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grids
from .operators import labels, scores, sites
from .plans import workflows as W
from .plans.runlog import RunLog
from .plans.train import TrainOptions, encode, encode_numeric, evaluate, evaluate_numeric, train
from .solver.kernel import METHODS, Options
from .sources import fasta, newick, tables, texts
from .streaming import gather
from .viz import svg


#: Solver parameters by their names on the command line (fixed values) and how they are read.
PARAMS = {
    "maxIter": ("max_iter", int), "tol": ("tol", float), "tFlag": ("stop", int), "rFlag": ("ratios", lambda v: v != "0"), "intercept": ("intercept", lambda v: v.lower() not in ("false", "0")),
    "disableEC": ("slack", lambda v: v == "0"), "mu": ("ridge", float), "q": ("q", float), "maxIter2": ("inner_iter", int), "tol2": ("inner_tol", float),
    "init": ("start_at_gradient", lambda v: v != "2"), "field": (None, str), "sWeight": (None, str),
}


def _params(given: list[str]) -> tuple[dict, dict[str, str]]:
    """Solver options and files (field, sWeight) of key=value pairs."""
    options, files = {}, {}
    for pair in given:
        key, equals, value = pair.partition("=")
        if not equals or key not in PARAMS:
            raise SystemExit(f"unknown solver parameter {pair}; known: {', '.join(PARAMS)}")
        name, read = PARAMS[key]
        (files if name is None else options)[name or key] = read(value)
    return options, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitewise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, training: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--out", required=True)
        if not training:
            return c
        c.add_argument("--datatype", default="universal", choices=["universal", "protein", "nucleotide", "numeric"])
        c.add_argument("--method", default="sg_lasso", choices=[*METHODS, "none"])
        c.add_argument("--lambda", dest="one", nargs=2, type=float, default=(0.1, 0.1))
        c.add_argument("--lambda-grid", nargs=2)
        c.add_argument("--lambda-file")
        c.add_argument("--use-logspace", action="store_true")
        c.add_argument("--min-minor", type=int, default=2)
        c.add_argument("--auto-bit-ct", type=float)
        c.add_argument("--drop-major-allele", action="store_true")
        c.add_argument("--skip-x", action="store_true")
        minor = c.add_mutually_exclusive_group()
        minor.add_argument("--minor-column", dest="minor", action="store_const", const="minor", default="none")
        minor.add_argument("--tiered-minor-col", dest="minor", action="store_const", const="tiered")
        c.add_argument("--class-bal", default="none")
        c.add_argument("--nfolds", type=int, default=0)
        c.add_argument("--precision", default="fp32", choices=["fp32", "fp64"])
        c.add_argument("--group-penalty-type", default="std")
        for name, value in (("--initial-gp-value", 1.0), ("--final-gp-value", 1.0), ("--gp-step", 1.0)):
            c.add_argument(name, type=float, default=value)
        c.add_argument("--min-groups", type=int, default=0)
        c.add_argument("--max-iter", "--maxiter", type=int, default=100)
        c.add_argument("--param", action="append", default=[], metavar="KEY=VALUE", help=", ".join(PARAMS))
        c.add_argument("--dropout")
        c.add_argument("--data-defs", help="ini file with the characters of each datatype")
        c.add_argument("--write-features", action="store_true")
        c.add_argument("--write-features-transposed", action="store_true")
        c.add_argument("--no-text", action="store_true", help="Parquet only")
        return c

    for name in ("train", "dropout"):
        c = command(name)
        c.add_argument("list")
        c.add_argument("hypothesis")
        if name == "dropout":
            c.add_argument("--acc-cutoff", type=float, default=0.9)
            c.add_argument("--rounds", type=int, default=10)
            c.add_argument("--max-ft", type=int, default=1000)
            c.add_argument("--window", type=int, default=100)
        else:
            c.add_argument("--adaptive-columns", type=int)
            c.add_argument("--max-mem", type=float, help="bytes; adaptive selection within this limit")
    c = command("clades")
    c.add_argument("list")
    c.add_argument("--tree", required=True)
    c.add_argument("--clade-list", nargs="*")
    c.add_argument("--gen-clade-list", nargs=2, type=int)
    c.add_argument("--grid-rmse-cutoff", type=float, default=100.0)
    c.add_argument("--grid-acc-cutoff", type=float, default=0.0)
    c = command("contrasts")
    c.add_argument("alignments")
    c.add_argument("--species-groups")
    c.add_argument("--response-file")
    c.add_argument("--response-dir")
    c.add_argument("--limited-genes-list")
    c.add_argument("--prediction-alignments-dir")
    for flag in ("--use-uncanceled-alignments", "--cancel-only-partner", "--cancel-tri-allelic", "--nix-full-deletions", "--make-null-models", "--make-pair-randomized-null-models",
                 "--no-pred-output", "--no-genes-output", "--show-selected-sites", "--dump-weights", "--use-default-gp"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--alignments-list")
    c.add_argument("--species-pheno-path")
    c.add_argument("--output-base-name", default="contrasts")
    c.add_argument("--outgroup-species")
    c.add_argument("--min-pairs", type=int, default=2)
    c.add_argument("--num-randomized-alignments", type=int, default=10)
    c.add_argument("--top-rank-frac", type=float, default=0.01)
    for name, value in (("--initial-lambda1", 0.01), ("--final-lambda1", 0.99), ("--initial-lambda2", 0.01), ("--final-lambda2", 0.99), ("--lambda-step", 0.05)):
        c.add_argument(name, type=float, default=value)
    c.add_argument("--num-log-points", type=int, default=20)
    c.set_defaults(one=None, group_penalty_type="median")
    c = command("evaluate", False)
    c.add_argument("model", help="the folder of a training run, or a weights file (a pattern takes several)")
    c.add_argument("list")
    c.add_argument("--hypothesis")
    c.add_argument("--datatype", default="universal")
    c.add_argument("--data-defs")
    c.add_argument("--minor-alleles", help="by default, the file beside the weights or up to two folders above")
    c.add_argument("--tiered-minor-alleles")
    c.add_argument("--no-visualize", action="store_true")
    c.add_argument("--gene-limit", type=int, default=100)
    c.add_argument("--species-limit", type=int, default=100)
    c = command("ingest", False)
    c.add_argument("paths", nargs="+")
    c.add_argument("--datatype", default="universal")
    c.add_argument("--checkpoint", help="takes the new files of a folder as a stream; a gene may lie in several")
    command("info", False)
    c = command("visualize", False)
    c.add_argument("table")
    c.add_argument("--gene-limit", type=int, default=100)
    c.add_argument("--species-limit", type=int, default=100)
    c.add_argument("--ssq-threshold", type=float, default=0.0)
    c.add_argument("--m-grid", action="store_true")
    return p


def _domains(path: str | None) -> dict[str, str] | None:
    if not path:
        return None
    with open(path) as f:
        return tables.read_domains(f.read())


def _alignments(spark: SparkSession, path: str, datatype: str, data_defs: str | None = None) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """(alignments or numeric table, groups) of a list file."""
    with open(path) as f:
        groups = tables.read_list(f.read(), os.path.dirname(os.path.abspath(path)))
    files = sorted({p for _, _, p in groups})
    if datatype == "numeric":
        return tables.read_numeric(spark, files), groups
    good, errors = fasta.checked(fasta.read_fasta(spark, files), datatype, domains=_domains(data_defs))
    for r in errors.collect():
        print(f"left out: {r.gene}: {r.error}")
    return good, groups


def _groups(spark: SparkSession, groups: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame([(g, gene) for g, gene, _ in groups], "group int, gene string")


def _lambdas(a: argparse.Namespace) -> list[tuple[int, float, float]]:
    if a.lambda_file:
        with open(a.lambda_file) as f:
            return grids.parse_lambda_file(f.read())
    if a.lambda_grid:
        first, second = (tuple(float(v) for v in s.split(",")) for s in a.lambda_grid)
        return grids.lambda_grid(first, second, a.use_logspace)
    if a.one is None:  # the ranges of paired contrasts
        ranges = ((a.initial_lambda1, a.final_lambda1), (a.initial_lambda2, a.final_lambda2))
        axes = [grids.log_grid(*r, a.num_log_points) if a.use_logspace else grids.linear_space(*r, a.lambda_step) for r in ranges]
        return [(i, p, q) for i, (p, q) in enumerate((p, q) for p in axes[0] for q in axes[1])]
    return [(0, *a.one)]


def _options(spark: SparkSession, a: argparse.Namespace, groups: list[tuple[int, str, str]] | None = None) -> TrainOptions:
    overlap = a.method.startswith("olsg_")
    settings, files = _params(a.param)
    field = weights = None
    if "field" in files:
        with open(files["field"]) as f:
            field = tables.read_field(f.read())
    if "sWeight" in files:
        with open(files["sWeight"]) as f:
            weights = tables.read_class_weights(f.read())
    solver = Options(**{"max_iter": a.max_iter, "tol": 1e-3 if a.method == "gl_logisticr" else 1e-4, "class_weights": weights} | settings)
    return TrainOptions(
        method=a.method, lambdas=_lambdas(a), min_minor=a.min_minor, drop_major=a.drop_major_allele, skip_x=a.skip_x, group_penalty="std" if getattr(a, "use_default_gp", False) else a.group_penalty_type,
        penalty_range=(a.initial_gp_value, a.final_gp_value, a.gp_step), folds=a.nfolds, precision=a.precision, min_groups=a.min_groups, class_balance=a.class_bal,
        auto_bit_ct=a.auto_bit_ct, groups=_groups(spark, groups) if overlap and groups else None, group_columns=field, minor=a.minor, solver=solver)


def _save(out: str, **frames: DataFrame | None) -> None:
    for name, frame in frames.items():
        if frame is not None:
            frame.write.mode("overwrite").parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sitewise").getOrCreate()
    log = RunLog()
    try:
        with log.section(a.command, **{k: v for k, v in vars(a).items() if k != "command" and v is not None}):
            _run(spark, a)
    finally:
        log.table(spark).coalesce(1).write.mode("append").parquet(f"{a.out}/run_log")


def _folder(spark: SparkSession, folder: str, datatype: str) -> DataFrame:
    """The alignments of a folder, each file a gene."""
    return fasta.checked(fasta.read_fasta(spark, f"{folder}/*.{{fas,fasta,fa,faa}}"), datatype)[0]


def _combos(a: argparse.Namespace) -> list[list[tuple[str, str]]]:
    """From exactly one of species groups, a response file, or a folder of such files."""
    if sum(map(bool, (a.species_groups, a.response_file, a.response_dir))) != 1:
        raise SystemExit("give one of --species-groups, --response-file, --response-dir")
    read = lambda p: open(p).read()  # noqa: E731, SIM115
    if a.species_groups:
        return W.contrasts(read(a.species_groups))
    files = [a.response_file] if a.response_file else [f"{a.response_dir}/{n}" for n in sorted(os.listdir(a.response_dir))]
    return [W.response_pairs(read(f)) for f in files]


def _train_texts(spark: SparkSession, a: argparse.Namespace, alignments: DataFrame, hypothesis: DataFrame, found, o: TrainOptions) -> None:
    """The text files of a training run."""
    e, numeric = found.encoded, a.datatype == "numeric"
    bare = texts.unplaced if numeric else lambda t: t
    feats, weights = bare(e.features), bare(found.weights)
    nested = found.weights.select("penalty_idx").distinct().count() > 1
    at = texts.folder(nested=nested)
    file = lambda name, place=at: F.concat(place, F.lit(name))
    penalty = F.concat(F.lit("penalty_"), F.col("penalty_idx").cast("string"), F.lit("/")) if nested else F.lit("")
    base = weights.where("w <> 0")
    name = texts.label(F.col("gene"), F.col("pos"), F.col("allele"))
    parts = [
        texts.feature_lines(feats), texts.weight_lines(weights, found.intercepts, file("weights.txt")), texts.gene_lines(found.gene_scores, file("gss.txt")),
        texts.lines(base, file("bss.txt"), F.concat_ws(texts.TAB, name, F.format_string("%.17e", "w")), F.col("col_id")),
        texts.lines(spark.createDataFrame(o.lambdas, "run int, l1 double, l2 double"), F.lit("lambda_list.txt"), F.format_string("%s %s", "l1", "l2"), F.col("run")),
    ]
    score = evaluate_numeric if numeric else evaluate
    scored = score(alignments, e.features, found.weights.select("penalty_idx", "run", "col_id", "w"), found.intercepts, hypothesis)
    parts.append(texts.prediction_lines(scored["predictions"], scored["gene_scores"], file("eval_gene_predictions.txt"), ["penalty_idx", "run"]))
    if not numeric:
        keys = alignments.select("gene", "sample").distinct()
        parts += [
            texts.position_lines(found.position_scores, file("pss.txt")),
            texts.lines(keys, F.lit("alignment_table.txt"), F.concat_ws(texts.TAB, "gene", "sample"), F.col("gene"), F.col("sample")),
            texts.lines(sites.missing_sequences(alignments, hypothesis), F.lit("missing_sequences.txt"), F.concat_ws(texts.TAB, "gene", "sample"), F.col("gene"), F.col("sample")),
        ]
        if o.minor != "none":
            parts.append(texts.minor_lines(e.features, o.minor == "tiered"))
    if found.medians:
        six = {"value": "median", "form": "%.6f"}
        parts.append(texts.gene_lines(found.medians["gene"], file("gss_median.txt", penalty), **six))
        first = found.medians["base"].join(feats.select("col_id", "gene", "pos", "allele"), "col_id")
        parts.append(texts.lines(first, file("bss_median.txt", penalty), F.concat_ws(texts.TAB, name, F.format_string("%.6f", "median")), F.col("first_run"), F.col("col_id")))
        if not numeric:
            parts.append(texts.position_lines(found.medians["position"], file("pss_median.txt", penalty), **six))
    if found.cv_predictions is not None:
        fold = bare(found.fold_weights)
        row = F.concat_ws(texts.TAB, F.col("sample").cast("string"), F.format_string("%.6f", "prediction"), F.format_string("%.6f", "y"))
        parts.append(texts.lines(found.cv_predictions, file("cv_predictions.txt"), row, F.col("sample"), F.col("fold")))
        of_fold = F.concat(at, F.lit("weights_fold_"), F.col("fold").cast("string"), F.lit(".txt"))
        parts.append(texts.weight_lines(fold.where("col_id >= 0"), fold.where("col_id = -1").withColumnRenamed("w", "intercept"), of_fold))
    if a.class_bal == "weighted":
        n_pos, n_neg, _ = scores.class_counts(hypothesis).first()
        parts.append(spark.createDataFrame([("sweights.txt", 0, "1"), ("sweights.txt", 1, f"{n_pos / max(1, n_neg):.6g}")], "file string, n long, value string"))
    if a.write_features:
        parts.append(texts.matrix_lines(e.cells, feats, hypothesis, "features.csv"))
    if a.write_features_transposed:
        parts.append(texts.matrix_lines(e.cells, feats, hypothesis, "features_transposed.csv", transposed=True))
    texts.write(a.out, *parts)


def _there(spark: SparkSession, path: str) -> bool:
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(of))


def _model(spark: SparkSession, a: argparse.Namespace, genes: DataFrame) -> dict[str, DataFrame]:
    """features, weights and intercepts of a run's tables, or of weights files and the minor alleles that go with them."""
    if _there(spark, f"{a.model}/weights"):
        read = lambda n: spark.read.parquet(f"{a.model}/{n}")
        return {"features": read("features"), "weights": read("weights").select("penalty_idx", "run", "col_id", "w"), "intercepts": read("intercepts")}
    folder = os.path.dirname(a.model) or "."
    given = a.tiered_minor_alleles or a.minor_alleles
    beside = [f"{folder}{up}/{name}" for up in ("", "/..", "/../..") for name in ("minor_alleles.txt", "tiered_minor_alleles.txt")]
    file = given or next((f for f in beside if not any(c in f for c in "*?[{") and _there(spark, f)), None)
    read = texts.read_weights(spark, a.model)
    found = labels.text_model(read, genes, texts.read_minor(spark, file) if file else None)
    if a.datatype == "numeric":
        named = labels.resolved(read.where("label <> 'Intercept'"), genes)
        found |= {"features": named.where("gene IS NOT NULL"), "unknown": named.where("gene IS NULL").select("label")}
    for r in found["unknown"].limit(20).collect():  # a message
        print(f"no gene of the list has the label {r.label}")
    return found


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Predictions with metrics, the table of gene scores, and a picture per run."""
    alignments, groups = _alignments(spark, a.list, a.datatype, a.data_defs)
    hypothesis = tables.read_hypothesis(spark, a.hypothesis) if a.hypothesis else None
    genes = spark.createDataFrame([(g,) for g in sorted({gene for _, gene, _ in groups})], "gene string")
    model = _model(spark, a, genes)
    if a.datatype == "numeric" and "unknown" in model:  # labels are names of features
        names = alignments.select("gene", "feature", F.col("name").alias("rest")).distinct()
        model["features"] = model["features"].join(names, ["gene", "rest"]).select(F.col("label").alias("col_id"), "gene", F.col("feature").alias("pos"), F.col("rest").alias("allele"))
    judge = evaluate_numeric if a.datatype == "numeric" else evaluate
    found = judge(alignments, model["features"], model["weights"], model["intercepts"], hypothesis)
    _save(a.out, **found)
    at = F.concat(F.lit("penalty_"), F.col("penalty_idx").cast("string"), F.lit("/lambda_"), F.col("run").cast("string"), F.lit("/"))
    file = F.concat(at, F.lit("eval.txt"))
    predicted = found["predictions"]
    row = F.concat_ws(texts.TAB, F.col("sample").cast("string"), F.format_string("%.6f", "prediction"), F.format_string("%.6f", "probability"), F.col("class").cast("string"))
    head = predicted.select("penalty_idx", "run").distinct().select(file.alias("file"), F.lit(0).cast("long").alias("n"), F.lit("SeqID\tPrediction\tProbability\tClassPrediction").alias("value"))
    full = predicted if "y" in predicted.columns else predicted.withColumn("y", F.lit(None).cast("double"))
    parts = [head, texts.lines(predicted, file, row, F.col("sample")), texts.prediction_lines(full, found["gene_scores"], F.concat(at, F.lit("eval_gene_predictions.txt")), ["penalty_idx", "run"])]
    if "metrics" in found:
        names = [c for c in found["metrics"].columns if c not in ("penalty_idx", "run")]
        said = found["metrics"].select("penalty_idx", "run", F.posexplode(F.array(*[F.concat_ws(texts.TAB, F.lit(c), F.col(c).cast("string")) for c in names])).alias("k", "line"))
        parts.append(texts.lines(said, F.concat(at, F.lit("metrics.txt")), F.col("line"), F.col("k")))
    if not a.no_visualize:
        pictures = []
        for r in predicted.select("penalty_idx", "run").distinct().orderBy("penalty_idx", "run").collect():  # a row per grid point
            of = lambda t, r=r: t.where((F.col("penalty_idx") == r.penalty_idx) & (F.col("run") == r.run))
            drawn = svg.heatmap(of(full).select("sample", "y", "prediction"), of(found["gene_scores"]).select("sample", "gene", "score"), a.gene_limit, a.species_limit)
            pictures.append((f"penalty_{r.penalty_idx}/lambda_{r.run}/eval.svg", 0, drawn))
        parts.append(spark.createDataFrame(pictures, "file string, n long, value string"))
    texts.write(a.out, *parts)


def _clade_texts(out: str, found: dict[str, DataFrame]) -> None:
    """Per clade the files of an analysis, and the totals."""
    nested = found["metrics"].select("penalty_idx").distinct().count() > 1
    at = F.concat(F.col("clade"), F.lit("/"))
    if nested:
        at = F.concat(at, F.lit("penalty_"), F.col("penalty_idx").cast("string"), F.lit("/"))
    file = lambda name: F.concat(at, F.lit(name))
    predicted = found["predictions"]
    said = F.col("sample").cast("string")
    number = lambda c: F.format_string("%.6f", c)
    head = predicted.select("clade", "penalty_idx").distinct()
    parts = [
        texts.lines(found["totals"], F.lit("hss_summary.txt"), F.concat_ws(texts.TAB, "clade", number("hss")), F.col("clade"), F.col("penalty_idx")),
        texts.lines(found["hypotheses"].where("y <> 0"), F.concat(F.col("clade"), F.lit("/hypothesis.txt")), F.concat_ws(texts.TAB, "sample", F.col("y").cast("int").cast("string")), F.col("ord")),
        texts.lines(predicted, file("eval.txt"), F.concat_ws(texts.TAB, said, number("sps"), number("y")), F.col("sample")),
        head.select(file("eval.txt").alias("file"), F.lit(0).cast("long").alias("n"), F.lit("SequenceID\tPredictedValue\tTrueValue").alias("value")),
        texts.lines(predicted, file("eval_SPS_SPP.txt"), F.concat_ws(texts.TAB, said, number("y"), number("sps"), number("spp")), F.col("sample")),
        head.select(file("eval_SPS_SPP.txt").alias("file"), F.lit(0).cast("long").alias("n"), F.lit("SeqID\tResponse\tSPS\tSPP").alias("value")),
        texts.prediction_lines(predicted, found["gene_predictions"], file("eval_gene_predictions.txt"), ["clade", "penalty_idx"], "sps", "Prediction_mean"),
        texts.gene_lines(found["gene_scores"], file("gss_median.txt"), form="%.6f"),
    ]
    if "position_medians" in found:
        name = texts.label(F.col("gene"), F.col("pos"), F.col("allele"))
        parts.append(texts.position_lines(found["position_medians"], file("pss_median.txt"), "median", "%.6f"))
        parts.append(texts.lines(found["base_medians"], file("bss_median.txt"), F.concat_ws(texts.TAB, name, number("median")), F.col("first_run"), F.col("col_id")))
    texts.write(out, *parts)


def _contrast_texts(spark: SparkSession, a: argparse.Namespace, found: dict[str, DataFrame], o: TrainOptions, groups) -> None:
    """The CSV files of a contrast scan."""
    base, parts = a.output_base_name, []

    def csv(name: str, rows: DataFrame, columns: list[str], *order: str) -> None:
        head = spark.createDataFrame([(f"{base}_{name}.csv", 0, ",".join(columns))], "file string, n long, value string")
        parts.extend([head, texts.lines(rows, F.lit(f"{base}_{name}.csv"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), *[F.col(c) for c in order])])

    if not a.no_genes_output:
        csv("gene_ranks", found["gene_ranks"], ["model", "gene", "best_score", "best_rank", "num_combos_ranked", "num_combos_ranked_top"], "model", "best_rank", "gene")
    if not a.no_pred_output and found["species_predictions"] is not None:
        predicted, columns = found["species_predictions"], ["model", "replicate", "combo", "sample", "sps"]
        if a.species_pheno_path:
            with open(a.species_pheno_path) as f:
                known = [(r[0].strip(), float(r[1])) for r in (line.replace("\t", ",").split(",") for line in f if line.strip())]
            predicted = predicted.join(F.broadcast(spark.createDataFrame(known, "sample string, pheno double")), "sample", "left")  # a row per species
            columns = [*columns, "pheno"]
            judged = scores.confusion(predicted.where("pheno <> 0").select("model", "replicate", "combo", F.col("sps").alias("prediction"), F.col("pheno").alias("y")), "model", "replicate", "combo")
            _save(a.out, species_metrics=judged)
        csv("species_predictions", predicted, columns, "model", "replicate", "combo", "sample")
    if a.show_selected_sites:
        csv("selected_sites", found["selected_sites"], ["model", "replicate", "combo", "gene", "pos", "score"], "model", "replicate", "combo", "gene", "pos")
    if groups:
        parts.append(texts.lines(_groups(spark, groups), F.lit(f"{base}_field.csv"), F.concat_ws(",", F.col("group").cast("string"), "gene"), F.col("group"), F.col("gene")))
    if a.dump_weights and found["weights"] is not None:
        several = found["weights"].select("combo").distinct().count() > 1
        at = F.concat(F.concat(F.lit("combo_"), F.col("combo").cast("string"), F.lit("/")) if several else F.lit(""), F.concat(F.col("model"), F.lit("_"), F.col("replicate").cast("string"), F.lit("/")),
                      F.concat(F.lit("lambda_"), F.col("run").cast("string"), F.lit("/weights.tsv")))
        name = texts.label(F.col("gene"), F.col("pos"), F.col("allele"))
        parts.append(texts.lines(found["weights"], at, F.concat_ws(texts.TAB, name, F.format_string("%.17e", "w")), F.col("col_id")))
    if parts:
        texts.write(a.out, *parts)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command in ("train", "dropout"):
        alignments, groups = _alignments(spark, a.list, a.datatype, a.data_defs)
        hypothesis = tables.read_hypothesis(spark, a.hypothesis)
        tables.check_hypothesis(hypothesis)
        o = _options(spark, a, groups)
        dropped = spark.read.text(a.dropout).select(F.trim("value").alias("label")) if a.dropout else None
        if a.command == "dropout":
            gone, curve = W.dropout_rounds(alignments, hypothesis, o, W.DropoutOptions(a.acc_cutoff, a.rounds, a.max_ft, a.window))
            _save(a.out, dropped=gone, curve=curve)
            with open(f"{a.out}/accuracy.svg", "w") as f:
                f.write(svg.dropout_curves(curve))
            return
        os.makedirs(a.out, exist_ok=True)
        tables.write_config(f"{a.out}/preprocess_config", list_path=os.path.abspath(a.list), datatype=a.datatype, min_minor=a.min_minor, minor=a.minor)
        if a.method == "none":
            encoded = encode_numeric(alignments, hypothesis) if a.datatype == "numeric" else encode(alignments, hypothesis, o.min_minor, o.drop_major, o.skip_x, dropped, o.minor)
            _save(a.out, features=encoded.features, cells=encoded.cells)
            texts.write(a.out, texts.feature_lines(encoded.features))
            return
        budget = a.adaptive_columns or (W.columns_that_fit(a.max_mem, hypothesis.where("y <> 0").count(), 4 if a.precision == "fp32" else 8) if a.max_mem else None)
        if budget:
            chosen, found = W.adaptive_train(alignments, hypothesis, o, budget)
            paths = {gene: path for _, gene, path in reversed(groups)}
            texts.write(a.out, spark.createDataFrame([("adaptive/final_sublist.txt", i, paths[g]) for i, g in enumerate(chosen)], "file string, n long, value string"))
            alignments = alignments.where(F.col("gene").isin(chosen))
        else:
            found = train(alignments, hypothesis, o, dropped, a.datatype == "numeric")
        _save(a.out, features=found.encoded.features, weights=found.weights, intercepts=found.intercepts, gss=found.gene_scores, pss=found.position_scores, hss=found.totals,
              cv_predictions=found.cv_predictions, cv_metrics=found.cv_metrics, fold_weights=found.fold_weights, **{f"{k}_median": v for k, v in found.medians.items()})
        if not a.no_text:
            _train_texts(spark, a, alignments, hypothesis, found, o)
    elif a.command == "clades":
        alignments, groups = _alignments(spark, a.list, a.datatype, a.data_defs)
        with open(a.tree) as f:
            tree = newick.parse(f.read())
        found = W.clade_analysis(alignments, tree, _options(spark, a, groups), a.grid_rmse_cutoff, a.grid_acc_cutoff, clades=a.clade_list, sizes=tuple(a.gen_clade_list) if a.gen_clade_list else None,
                                 balance=a.class_bal if a.class_bal != "none" else "phylo")
        _save(a.out, **found)
        if not a.no_text:
            _clade_texts(a.out, found)
    elif a.command == "contrasts":
        genes, groups = None, None
        if a.limited_genes_list:
            with open(a.limited_genes_list) as f:
                genes = [line.strip() for line in f if line.strip()]
        if a.alignments_list:
            with open(a.alignments_list) as f:
                groups = tables.unique_groups(tables.read_list(f.read(), a.alignments))
            if not a.method.startswith("olsg_") and len(groups) > len({g for g, _, _ in groups}):
                raise SystemExit("groups of several alignments need an overlapping method")
            alignments = fasta.checked(fasta.read_fasta(spark, sorted({p for _, _, p in groups})), a.datatype)[0]
        else:
            alignments = _folder(spark, a.alignments, a.datatype)
        predict = _folder(spark, a.prediction_alignments_dir, a.datatype) if a.prediction_alignments_dir else None
        c = W.ContrastOptions(not a.use_uncanceled_alignments, a.cancel_only_partner, a.cancel_tri_allelic, a.nix_full_deletions, a.outgroup_species, a.min_pairs, a.top_rank_frac,
                              a.make_null_models, a.num_randomized_alignments if a.make_pair_randomized_null_models else 0)
        o = _options(spark, a, groups)
        found = W.contrast_scan(alignments, _combos(a), o, c, predict, genes)
        _save(a.out, **found)
        _contrast_texts(spark, a, found, o, groups)
    elif a.command == "evaluate":
        _evaluate(spark, a)
    elif a.command == "ingest" and a.checkpoint:
        if len(a.paths) > 1:
            raise SystemExit("--checkpoint takes one folder or pattern")
        gather.gather(spark, a.paths[0], a.out, a.checkpoint, a.datatype).show(50, False)
        gather.compact(spark, a.out)
    elif a.command == "ingest":
        fasta.ingest(spark, a.paths, a.out, a.datatype).drop("samples").show(50, False)
    elif a.command == "info":
        fasta.catalogue(spark, a.out).drop("samples").show(50, False)
    elif a.command == "visualize":
        long = tables.read_gene_predictions(spark, a.table)
        os.makedirs(a.out, exist_ok=True)
        with open(f"{a.out}/eval.svg", "w") as f:
            f.write(svg.heatmap(long.select("sample", "y", "prediction").distinct(), long.select("sample", "gene", "score"), a.gene_limit, a.species_limit, a.ssq_threshold, a.m_grid))


if __name__ == "__main__":
    main()
