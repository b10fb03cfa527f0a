"""Workflows over training: clades of a tree, feature dropout, adaptive selection, paired contrasts."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.columns import label, median_nonzero
from ..operators import scores as S
from ..operators import sites as A
from ..solver.kernel import Columns, fit
from ..sources import newick
from ..sources.scratch import settled
from .train import Encoded, TrainOptions, encode, evaluate, groups_of, listed, members_of, solver_of, train

# ---------------------------------------------------------------- clades


def clade_hypotheses(spark: SparkSession, tree: newick.Node, clades: list[str] | None = None, sizes: tuple[int, int] | None = None, balance: str = "phylo") -> DataFrame:
    """(clade, sample, ord, y) for the named clades, and for unnamed ones with a number of leaves in ``sizes``."""
    names = list(clades or [])
    if sizes:
        names += newick.name_clades(tree, *sizes)
    if not names:
        names = [n.name for n in newick.named_internal(tree)]
    rows = [(name, leaf, i, float(y)) for name in names for i, (leaf, y) in enumerate(newick.clade_hypothesis(tree, name, balance))]
    return spark.createDataFrame(rows, "clade string, sample string, ord int, y double")


def clade_analysis(alignments: DataFrame, tree: newick.Node, options: TrainOptions, rmse_cutoff: float = 100.0, acc_cutoff: float = 0.0, **which) -> dict[str, DataFrame]:
    """Per clade: train on its hypothesis, keep the runs within the cutoffs, and take medians of their gene scores."""
    spark = alignments.sparkSession
    every = clade_hypotheses(spark, tree, **which).persist()
    out: dict[str, list[DataFrame]] = {"gene_scores": [], "predictions": [], "metrics": [], "gene_predictions": []}
    for (clade,) in every.select("clade").distinct().orderBy("clade").collect():
        hypothesis = every.where(F.col("clade") == clade).drop("clade")
        found = train(alignments, hypothesis, options)
        runs = aggregate_runs(found, alignments, hypothesis, rmse_cutoff, acc_cutoff)
        if found.medians:
            columns = found.encoded.features.select("col_id", "gene", "pos", "allele")
            runs |= {"position_medians": found.medians["position"], "base_medians": found.medians["base"].join(columns, "col_id")}
        for name, table in runs.items():
            out.setdefault(name, []).append(table.withColumn("clade", F.lit(clade)))
    joined = {}
    for name, tables in out.items():
        joined[name] = tables[0] if tables else None
        for t in tables[1:]:
            joined[name] = joined[name].unionByName(t)
    joined["totals"] = joined["gene_scores"].groupBy("clade", "penalty_idx").agg(F.sum("score").alias("hss"))
    joined["hypotheses"] = every
    return joined


def aggregate_runs(found, alignments: DataFrame, hypothesis: DataFrame, rmse_cutoff: float, acc_cutoff: float) -> dict[str, DataFrame]:
    """Medians over the runs whose metrics lie within the cutoffs."""
    own = alignments.join(hypothesis.select("sample"), "sample", "left_semi")
    scored = evaluate(own, found.encoded.features, found.weights.select("penalty_idx", "run", "col_id", "w"), found.intercepts, hypothesis)
    return medians_of_runs(scored, found.gene_scores, rmse_cutoff, acc_cutoff)


def medians_of_runs(scored: dict[str, DataFrame], gene_scores: DataFrame, rmse_cutoff: float, acc_cutoff: float) -> dict[str, DataFrame]:
    """Of evaluated runs within the cutoffs: medians per penalty term."""
    by = ["penalty_idx", "run"]
    good = scored["metrics"].where((F.col("rmse") <= rmse_cutoff) & (F.col("accuracy") >= acc_cutoff)).select(*by)
    gss = gene_scores.join(good, by, "left_semi")
    predicted = scored["predictions"].join(good, by, "left_semi")
    per_gene = scored["gene_scores"].join(good, by, "left_semi")
    return {
        "gene_scores": gss.groupBy("penalty_idx", "gene").agg(median_nonzero(F.col("score")).alias("score")).where("score <> 0"),
        "predictions": predicted.groupBy("penalty_idx", "sample", "y").agg(F.percentile("prediction", F.lit(0.5)).alias("sps"), F.percentile("probability", F.lit(0.5)).alias("spp")),
        "gene_predictions": per_gene.groupBy("penalty_idx", "sample", "gene").agg(F.percentile("score", F.lit(0.5)).alias("score")),
        "metrics": scored["metrics"],
    }


# ---------------------------------------------------------------- iterative feature dropout


@dataclass
class DropoutOptions:
    accuracy: float = 0.9
    max_iter: int = 10
    max_features: int = 1000
    window: int = 100


def dropout_rounds(alignments: DataFrame, hypothesis: DataFrame, options: TrainOptions, rounds: DropoutOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Trains again and again without the features that mattered so far.

    Each round takes the ``window`` largest weights (by size; ties by column) of
    the run with the best accuracy, and adds them one by one: the curve (round, k,
    tpr, tnr, accuracy) tells how few reach the cutoff. Those few (all, if none do) join
    the dropped features; rounds end when the full model misses the cutoff, at
    ``max_iter``, or at ``max_features``. Returns (dropped features, curve).
    """
    r = rounds or DropoutOptions()
    spark = alignments.sparkSession
    dropped = spark.createDataFrame([], "round int, rank int, label string, w double")
    curve: list[tuple] = []
    for i in range(r.max_iter):
        found = train(alignments, hypothesis, options, dropped.select("label") if i else None)
        scored = evaluate(alignments, found.encoded.features, found.weights.select("penalty_idx", "run", "col_id", "w"), found.intercepts, hypothesis)
        best = scored["metrics"].orderBy(F.desc("accuracy"), "penalty_idx", "run").limit(1).collect()
        if not best:
            break
        this = (F.col("run") == best[0].run) & (F.col("penalty_idx") == best[0].penalty_idx)
        own = found.weights.where(this)
        top = own.orderBy(F.desc(F.abs("w")), "col_id").limit(r.window).select("col_id", label(F.col("gene"), F.col("pos"), F.col("allele")).alias("label"), "w").collect()  # the window
        if not top:
            break
        c = found.intercepts.where(this).first().intercept
        place = spark.createDataFrame([(t.col_id, k + 1, t.w) for k, t in enumerate(top)], "col_id long, k int, w double")
        steps = spark.createDataFrame([(k,) for k in range(len(top) + 1)], "k int")
        hits = found.encoded.cells.join(F.broadcast(place), "col_id").groupBy("sample", "k").agg(F.sum("w").alias("w"))  # at most ``window`` rows
        grid = hypothesis.where("y <> 0").select("sample", "y").crossJoin(F.broadcast(steps)).join(hits, ["sample", "k"], "left")
        partial = grid.withColumn("prediction", F.lit(c) + F.sum(F.coalesce("w", F.lit(0.0))).over(Window.partitionBy("sample").orderBy("k")))
        reached = None
        for p in S.confusion(partial, "k").orderBy("k").collect():
            curve.append((i, p.k, p.tpr, p.tnr, p.accuracy))
            if reached is None and p.k > 0 and p.accuracy >= r.accuracy:
                reached = p.k
        held = dropped.count()
        take = min(reached or len(top), r.max_features - held)
        more = spark.createDataFrame([(i, k + 1, t.label, t.w) for k, t in enumerate(top[:take])], "round int, rank int, label string, w double")
        dropped = spark.createDataFrame(dropped.unionByName(more).collect(), more.schema)  # at most ``max_features`` rows
        found.release()
        if best[0].accuracy < r.accuracy or held + take >= r.max_features:
            break
    return dropped, spark.createDataFrame(curve, "round int, k int, tpr double, tnr double, accuracy double")


# ---------------------------------------------------------------- adaptive selection


def chunks(sizes: list[tuple[str, int]], budget: float, count: int | None = None) -> list[list[str]]:
    """Contiguous chunks of about equal cost, half the budget or less each (a larger gene is a chunk of its own): as many as
    it takes, one or more over the quotient where genes do not fit evenly."""
    total = sum(n for _, n in sizes)
    parts = count or -(-total // max(1, int(budget / 2)))
    target, out, used = total / max(1, parts), [[]], 0.0
    for gene, n in sizes:
        if out[-1] and used + n > target:
            out.append([])
            used = 0.0
        out[-1].append(gene)
        used += n
    return out


def columns_that_fit(max_bytes: float, samples: int, itemsize: int = 4, threads: int = 1) -> int:
    """Columns of a dense solve within a memory limit: a column of samples, eight work vectors a thread and
    its label, beside ten sample vectors a thread and 30 MiB."""
    fixed = threads * 10 * samples * itemsize + 30 * 2**20
    return max(0, int((max_bytes - fixed) / (samples * itemsize + threads * 8 * itemsize + 160)))


def best_fitting(ranked: list[tuple[str, float, int]], budget: float) -> list[str]:
    """Genes by falling score (ties by name) that still fit; larger ones are passed over."""
    out, used = [], 0.0
    for gene, _, n in sorted(ranked, key=lambda r: (-r[1], r[0])):
        if used + n <= budget:
            out.append(gene)
            used += n
    return out


def chunk_pairs(n: int) -> list[tuple[int, int]]:
    """All pairs of different chunks, the first before the second."""
    return list(itertools.combinations(range(n), 2))


def adaptive_train(alignments: DataFrame, hypothesis: DataFrame, options: TrainOptions, budget_columns: int) -> tuple[list[str], object]:
    """Trains on pairs of chunks of genes, sums their gene scores, and trains on the best genes that fit the budget."""
    encoded = encode(alignments, hypothesis, options.min_minor, options.drop_major, options.skip_x)
    sizes = [(g, n) for g, n, _ in encoded.genes]
    parts = chunks(sizes, budget_columns)
    if len(parts) < 2:
        raise ValueError("everything fits the budget; train directly")
    encoded.features.unpersist()
    scores: list[tuple[str, float]] = []
    sweep = replace(options, lambdas=grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.3, 0.1)), folds=0)
    for a, b in chunk_pairs(len(parts)):
        found = train(alignments.where(F.col("gene").isin(parts[a] + parts[b])), hypothesis, sweep)
        scores += [(r.gene, r.median) for r in found.medians["gene"].collect()]  # a row per gene
        found.release()
    sums = S.summed_scores(alignments.sparkSession.createDataFrame(scores, "gene string, score double"))
    length = dict(sizes)
    chosen = best_fitting([(r.gene, r.score, length[r.gene]) for r in sums.collect()], budget_columns)
    return chosen, train(alignments.where(F.col("gene").isin(chosen)), hypothesis, options)


# ---------------------------------------------------------------- paired contrasts


def contrasts(text: str) -> list[list[tuple[str, str]]]:
    """All combinations of a file of alternating convergent and control lines; commas separate alternates."""
    lines = [[v.strip() for v in line.split(",") if v.strip()] for line in text.splitlines() if line.strip()]
    if len(lines) % 2:
        raise ValueError("an even number of lines is needed")
    return [list(zip(c[0::2], c[1::2], strict=True)) for c in itertools.product(*lines)]


def response_pairs(text: str) -> list[tuple[str, str]]:
    """A combination from a response matrix (species,value a line): positives and negatives paired in order."""
    rows = [[v.strip() for v in line.split(",")] for line in text.splitlines() if line.strip()]
    values = [(r[0], float(r[1])) for r in rows]
    return list(zip([s for s, v in values if v > 0], [s for s, v in values if v < 0], strict=False))


@dataclass
class ContrastOptions:
    cancel: bool = True
    partner_only: bool = False
    tri_allelic: bool = False
    whole_genes: bool = False
    outgroup: str | None = None
    min_pairs: int = 2
    top_share: float = 0.01
    flipped: bool = False
    randomised: int = 0
    task_cells: int = 5_000_000  # a contrast with more of them is solved by itself


def contrast_scan(alignments: DataFrame, combos: list[list[tuple[str, str]]], options: TrainOptions, contrast: ContrastOptions | None = None, predict: DataFrame | None = None,
                  genes: list[str] | None = None) -> dict[str, DataFrame]:
    """Gene ranks over combinations of species pairs, with selected sites and predictions.

    Predictions are made for every species of ``predict`` (default: the alignments), the
    mean over the runs of a combination. ``genes`` limits the scan.

    A combination's convergent species are 1, its controls -1. Null models: ``flipped``
    swaps the sides of every second pair; ``randomised`` repeats the scan that often with the two
    members of each pair swapped at sites chosen by hash.
    """
    c = contrast or ContrastOptions()
    spark = alignments.sparkSession
    if genes is not None:
        alignments = alignments.where(F.col("gene").isin(genes))
    predict = alignments if predict is None else predict
    jobs = [(i, combo, "observed", 0) for i, combo in enumerate(combos)]
    jobs += [(i, [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(combo)], "flipped", 0) for i, combo in enumerate(combos) if c.flipped]
    jobs += [(i, combo, "randomised", r + 1) for i, combo in enumerate(combos) for r in range(c.randomised)]
    named = spark.createDataFrame([(j, i, kind, seed) for j, (i, _, kind, seed) in enumerate(jobs)], "job int, combo int, model string, replicate int")
    tag = lambda t: t.join(F.broadcast(named), "job").drop("job")  # noqa: E731  a row per contrast
    solved = _contrasts_solved(alignments, jobs, options, c)
    width = len(options.lambdas)
    solved = solved.withColumn("run", (F.col("penalty_idx") * width + F.col("run")).cast("int"))
    weights = solved.where("gene IS NOT NULL AND w <> 0")
    ranked = tag(S.gene_scores(weights, "job", "run").groupBy("job", "gene").agg(F.max("score").alias("score")))
    sites_out = tag(S.position_scores(weights, "job", "run").groupBy("job", "gene", "pos").agg(F.max("score").alias("score")))
    predicted = tag(_contrast_predictions(predict, weights, solved.where("gene IS NULL").select("job", "run", F.col("w").alias("intercept"))))
    dumped = tag(weights.withColumn("col_id", F.struct("gene", "pos", "allele")))
    place = F.row_number().over(Window.partitionBy("model", "replicate", "combo").orderBy(F.desc("score"), "gene"))
    size = F.count(F.lit(1)).over(Window.partitionBy("model", "replicate", "combo"))
    placed = ranked.withColumns({"rank": place, "_n": size}).withColumn("top", F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * c.top_share)))
    ranks = placed.groupBy("model", "gene").agg(
        F.max("score").alias("best_score"), F.min("rank").alias("best_rank"), F.count_distinct("replicate", "combo").alias("num_combos_ranked"), F.count_if("top").alias("num_combos_ranked_top"))
    best_sites = sites_out.groupBy("model", "gene", "pos").agg(F.max("score").alias("best_score"))
    return {"gene_ranks": ranks, "combo_scores": placed.drop("_n"), "selected_sites": sites_out, "best_sites": best_sites, "species_predictions": predicted, "weights": dumped}


SOLVED = "job int, penalty_idx int, run int, gene string, pos int, allele string, w double"


def _contrasts_solved(alignments: DataFrame, jobs: list[tuple], options: TrainOptions, c: ContrastOptions) -> DataFrame:
    """Non-zero weights of every contrast, its grid and penalty terms; the intercept has no gene.

    All contrasts go through one plan, their number a key of every aggregate: sites are exploded once, met with the contrasts that have the
    sample, cancelled, counted and encoded side by side; each contrast's matrix, two rows per pair, is then solved in a task of its
    own. Those with over ``task_cells`` cells are solved one by one, by the grid or the column tier.
    """
    spark = alignments.sparkSession
    rows = [(j, s, k, t == 1, 2 * k + t, pair[1 - t], seed) for j, (_, combo, _, seed) in enumerate(jobs) for k, pair in enumerate(combo) for t, s in enumerate(pair)]
    pairs = spark.createDataFrame(rows, "job int, sample string, pair int, control boolean, row int, partner string, seed int")
    needed = sorted({r[1] for r in rows} | ({c.outgroup} if c.outgroup is not None else set()))
    known = spark.createDataFrame([(s,) for s in needed], "sample string")
    sites = A.explode_sites(alignments.join(F.broadcast(known), "sample", "left_semi").select("gene", "sample", "seq"))  # species of the contrasts
    own = F.broadcast(pairs.select("job", "sample", "pair", "control"))  # rows of the contrasts
    met = A.gap_cancelled(sites, own, c.partner_only, c.tri_allelic, c.min_pairs, c.outgroup, ("job",)) if c.cancel else sites.join(own, "sample").select("job", "gene", "pos", "sample", "pair", "ch")
    if c.whole_genes:
        present = alignments.select("gene", "sample").distinct().join(F.broadcast(pairs.select("job", "sample").distinct()), "sample").groupBy("job", "gene").agg(F.count_distinct("sample").alias("_k"))
        total = pairs.groupBy("job").agg(F.count_distinct("sample").alias("_n"))
        met = met.join(present.join(F.broadcast(total), "job").where("_k = _n").select("job", "gene"), ["job", "gene"], "left_semi")
    met = met.join(F.broadcast(pairs.select("job", "sample", "pair", "row", "partner", "seed")), ["job", "sample", "pair"])
    swap = (F.col("seed") > 0) & (F.xxhash64("seed", "gene", "pos", "pair").bitwiseAND(1) == 1)
    met = met.select("job", "gene", "pos", "ch", F.when(swap, F.col("row").bitwiseXOR(F.lit(1))).otherwise(F.col("row")).alias("row"))
    met = settled(A.ungapped(met, gaps=("-",)), "contrasts")
    counts = met.groupBy("job", "gene", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    variable = A.variable_sites(A.site_stats(counts, "job")).groupBy("job", "gene").agg(F.count(F.lit(1)).cast("int").alias("v"))
    feats = A.paired_features(counts, options.min_minor, "job").select("job", "gene", "pos", F.col("allele").alias("ch"))
    cells = settled(met.join(feats, ["job", "gene", "pos", "ch"]).join(variable, ["job", "gene"]), "contrast_cells")
    bound = 0 if options.group_columns is not None else c.task_cells
    large = [r.job for r in cells.groupBy("job").count().where(F.col("count") > bound).collect()]  # a row per contrast
    sizes = {j: 2 * len(combo) for j, (_, combo, _, _) in enumerate(jobs)}
    plain, groups = replace(options, groups=None), listed(options)

    def solve(table: pa.Table) -> pa.Table:
        job = table.column("job")[0].as_py()
        gene, allele = (table.column(n).to_pylist() for n in ("gene", "ch"))
        keys = list(zip(gene, table.column("pos").to_pylist(), allele, strict=True))
        labels = sorted(set(keys), key=lambda k: (k[0], k[1], ord(k[2][0]), k[2]))
        col = {k: i for i, k in enumerate(labels)}
        v = dict(zip(gene, table.column("v").to_pylist(), strict=True))
        lengths = [(g, len(list(some)), v[g]) for g, some in itertools.groupby(labels, lambda k: k[0])]
        encoded = Encoded(None, None, None, lengths, len(labels))
        m = sizes[job]
        matrix = Columns(m, len(labels), np.array([col[k] for k in keys]), np.asarray(table.column("row")), None, np.float32 if plain.precision == "fp32" else np.float64)
        y = np.where(np.arange(m) % 2 == 0, 1.0, -1.0)
        out = []
        for p, (_, g) in enumerate(groups_of(encoded, plain, members_of(lengths, groups))):
            for run, l1, l2 in plain.lambdas:
                found = fit(plain.method, matrix, y, g, l1, l2, plain.solver)
                out += [(job, p, run, *labels[i], float(found.x[i])) for i in np.flatnonzero(found.x)]
                out.append((job, p, run, None, None, None, float(found.intercept)))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64()]
        names = ["job", "penalty_idx", "run", "gene", "pos", "allele", "w"]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    small = cells.where(~F.col("job").isin(large)) if large else cells
    solved = small.groupBy("job").applyInArrow(solve, SOLVED)
    for job in large:
        solved = solved.unionByName(_contrast_solved(cells.where(F.col("job") == job), job, sizes[job], options))
    return settled(solved, "contrast_weights")


def _contrast_solved(cells: DataFrame, job: int, m: int, options: TrainOptions) -> DataFrame:
    """One large contrast."""
    spark = cells.sparkSession
    features = A.feature_index(settled(cells.select("gene", "pos", F.col("ch").alias("allele")).distinct(), "features"))
    genes = [(r.gene, r.n, r.v) for r in features.join(cells.select("gene", "v").distinct(), "gene").groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).orderBy("gene").collect()]  # a row per gene
    own = settled(A.cells(cells.withColumnRenamed("row", "sample"), features), "cells")
    encoded = Encoded(cells, features, own, genes, sum(g[1] for g in genes))
    y = np.where(np.arange(m) % 2 == 0, 1.0, -1.0)
    solve = solver_of(encoded, list(range(m)), y, None, options, options.solver)
    terms = len(grids.penalty_terms(options.group_penalty, *options.penalty_range, var_counts=[g[2] for g in genes]))
    solved = solve([(p, *point) for p in range(terms) for point in options.lambdas], 0)
    out = solved.join(features.select("col_id", "gene", "pos", "allele"), "col_id", "left")
    return out.select(F.lit(job).alias("job"), "penalty_idx", "run", "gene", "pos", "allele", "w")


def _contrast_predictions(predict: DataFrame, weights: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(job, sample, sps): every species' prediction, the mean over the runs of a contrast."""
    predict = A.one_of_each(predict)
    sites = A.ungapped(A.explode_sites(predict.select("gene", "sample", "seq")))
    wanted = weights.select("job", "run", "gene", "pos", F.col("allele").alias("ch"), "w")
    part = sites.join(wanted, ["gene", "pos", "ch"]).groupBy("job", "run", "sample").agg(F.sum("w").alias("_s"))
    every = predict.select("sample").distinct().crossJoin(F.broadcast(intercepts))  # species x contrasts x runs: the predictions
    total = F.col("intercept") + F.coalesce("_s", F.lit(0.0))
    return every.join(part, ["job", "run", "sample"], "left").groupBy("job", "sample").agg(F.avg(total).alias("sps"))
