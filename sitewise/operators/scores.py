"""Scores from sparse weights, predictions, confusion metrics, ranks, class balance.

weights: (run, gene, pos, col_id, w). A column belongs to one gene and position,
so no label is ever parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MINOR_POS, median_nonzero, ratio, sigmoid
from ..sources.scratch import beside


def _size() -> Column:
    return F.sum(F.abs("w"))


def significance(weights: DataFrame) -> DataFrame:
    """Gene, position and total scores, each the sum of absolute weights, in one pass: (level, gene, pos, score)."""
    some = weights.where("w <> 0")
    sums = some.groupingSets([("gene", "pos"), ("gene",), ()], "gene", "pos").agg(_size().alias("score"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "position").when(F.col("_g") == 1, "gene").otherwise("all")
    return sums.select(level.alias("level"), "gene", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_levels(weights: DataFrame, *by: str) -> DataFrame:
    """(by, level, gene, pos, score) of every gene, position and key of ``by``, from one shuffle of the weights.

    Levels are those of ``gene_scores``, ``position_scores`` and ``total_score``; stored, the table serves all three (``of_level``).
    """
    sums = weights.groupingSets([(*by, "gene", "pos"), (*by, "gene"), by], *by, "gene", "pos").agg(_size().alias("score"), F.grouping("gene").alias("_g"), F.grouping("pos").alias("_p"))
    level = F.when(F.col("_g") == 1, "all").when(F.col("_p") == 1, "gene").otherwise("position")
    kept = (F.col("level") == "all") | ((F.col("score") > 0) & ((F.col("level") == "gene") | (F.col("pos") != MINOR_POS)))
    return sums.withColumns({"level": level, "score": F.coalesce("score", F.lit(0.0))}).where(kept).select(*by, "level", "gene", "pos", "score")


def of_level(levels: DataFrame, level: str, *by: str) -> DataFrame:
    keys = {"all": (), "gene": ("gene",), "position": ("gene", "pos")}[level]
    return levels.where(F.col("level") == level).select(*by, *keys, "score")


def gene_scores(weights: DataFrame, *by: str) -> DataFrame:
    return weights.where("w <> 0").groupBy(*by, "gene").agg(_size().alias("score"))


def position_scores(weights: DataFrame, *by: str) -> DataFrame:
    """Columns of minor alleles have no position and are left out."""
    return weights.where((F.col("w") != 0) & (F.col("pos") != MINOR_POS)).groupBy(*by, "gene", "pos").agg(_size().alias("score"))


def total_score(weights: DataFrame, *by: str) -> DataFrame:
    return weights.groupBy(*by).agg(F.coalesce(F.sum(F.abs("w")), F.lit(0.0)).alias("score"))


def summed_scores(scores: DataFrame) -> DataFrame:
    """Sum of a gene's scores, best first (ties by name)."""
    return scores.groupBy("gene").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "gene")


def nonzero_genes(weights: DataFrame, *by: str) -> DataFrame:
    return weights.groupBy(*by).agg(F.count_distinct(F.when(F.col("w") != 0, F.col("gene"))).alias("n_genes"))


def grid_median(scores: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per key the median over runs of the non-zero values; keys whose median is 0 are left out."""
    return scores.groupBy(*keys).agg(median_nonzero(F.col(value)).alias("median")).where("median <> 0")


def base_medians(weights: DataFrame, *by: str) -> DataFrame:
    """Signed median weight per column, with the place of its first appearance (run, col_id)."""
    out = weights.where("w <> 0").groupBy(*by, "col_id").agg(median_nonzero(F.col("w")).alias("median"), F.min(F.struct("run", "col_id")).alias("first"))
    return out.where("median <> 0").select(*by, "col_id", "median", F.col("first.run").alias("first_run"))


def fold_predictions(cells: DataFrame, folds: DataFrame, weights: DataFrame, intercepts: DataFrame, *by: str) -> DataFrame:
    """(by, sample, fold, y, prediction) of each sample's model without its fold.

    ``cells`` (col_id, sample, optionally value), ``folds`` (sample, fold, y; a sample that is repeated may be in
    several), ``weights`` (by, fold, col_id, w), ``intercepts`` (by, fold, intercept).
    """
    value = F.col("value") if "value" in cells.columns else F.lit(1.0)
    met = cells.join(folds.select("sample", "fold").distinct(), "sample").join(beside(weights.select(*by, "fold", "col_id", "w"), "weights"), ["col_id", "fold"])
    sums = met.groupBy(*by, "sample", "fold").agg(F.sum(F.col("w") * value).alias("_s"))
    every = folds.distinct().join(intercepts.select(*by, "fold", "intercept"), "fold")
    return every.join(sums, [*by, "sample", "fold"], "left").select(*by, "sample", "fold", "y", (F.col("intercept") + F.coalesce("_s", F.lit(0.0))).alias("prediction"))


def predictions(cells: DataFrame, weights: DataFrame, intercept: DataFrame, *by: str) -> DataFrame:
    """(by, sample, prediction, probability, class): intercept plus the weights of the sample's columns.

    ``weights`` are sparse and join on col_id; every sample of ``cells`` appears for every run of ``intercept``.
    """
    part = cells.join(beside(weights.where("w <> 0").select(*by, "col_id", "w"), "weights"), "col_id").groupBy(*by, "sample").agg(F.sum("w").alias("_s"))
    every = cells.select("sample").distinct().crossJoin(F.broadcast(intercept.select(*by, "intercept")))  # runs x samples: the result's shape; a row per run
    total = F.col("intercept") + F.coalesce("_s", F.lit(0.0))
    out = every.join(part, [*by, "sample"], "left").select(*by, "sample", total.alias("prediction"))
    return out.withColumns({"probability": sigmoid(F.col("prediction")), "class": F.when(F.col("prediction") > 0, 1).otherwise(-1)})


def gene_contributions(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample, gene, score): sum of the weights of a sample's columns of each gene."""
    return cells.join(beside(weights.where("w <> 0").select("col_id", "gene", "w"), "weights"), "col_id").groupBy("sample", "gene").agg(F.sum("w").alias("score"))


def confusion(predicted: DataFrame, *by: str) -> DataFrame:
    """tp, tn, fp, fn of prediction > 0 against y > 0, and rates that are 0 on empty denominators; rmse, accuracy."""
    p, y = F.col("prediction") > 0, F.col("y") > 0
    out = predicted.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"),
        F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("rmse"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return out.withColumns({"tpr": ratio(tp, tp + fn), "tnr": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})


def class_counts(hypothesis: DataFrame) -> DataFrame:
    """n_pos, n_neg and the positives' share m1."""
    out = hypothesis.where("y <> 0").agg(F.count_if(F.col("y") > 0).alias("n_pos"), F.count_if(F.col("y") < 0).alias("n_neg"))
    return out.withColumn("m1", ratio(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")))


def folds(hypothesis: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """Fold of each sample: its place modulo k."""
    return hypothesis.withColumn("fold", F.pmod(F.col(order), F.lit(k)).cast("int"))


def gene_ranks(scores: DataFrame, by: str) -> DataFrame:
    """Rank of each gene per combination, best score first (ties by name), and best over all combinations."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "gene")))
    return ranked.groupBy("gene").agg(
        F.max("score").alias("best_score"), F.min("rank").cast("long").alias("best_rank"), F.count(F.lit(1)).alias("n_ranked"))


def top_by_square(scores: DataFrame, threshold: float = 0.0, k: int = 100) -> DataFrame:
    """Genes by the sum of squared scores, at least ``threshold``; the k largest (a report)."""
    out = scores.groupBy("gene").agg(F.sum(F.col("score") ** 2).alias("ssq"), F.max(F.abs("score")).alias("max_abs"))
    return out.where(F.col("ssq") >= threshold).orderBy(F.desc("ssq"), "gene").limit(k)


def heatmap_order(predicted: DataFrame) -> DataFrame:
    """Rows of a heatmap: negatives by rising prediction, then positives by falling one; ties by sample."""
    negative = F.col("y") < 0
    key = (F.when(negative, 0).otherwise(1), F.when(negative, F.col("prediction")).otherwise(-F.col("prediction")), F.col("sample"))
    return predicted.withColumn("row", F.row_number().over(Window.partitionBy("run").orderBy(*key)))


def _by_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "sample")


def downsample(hypothesis: DataFrame, order: Column | None = None, seed: int = 1) -> DataFrame:
    """As many samples of the larger class as the smaller one has, first by hash (or ``order``)."""
    least = hypothesis.where("y <> 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_least"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(order if order is not None else _by_hash(seed), "sample"))
    return hypothesis.where("y <> 0").withColumn("_place", place).join(F.broadcast(least)).where("_place <= _least").drop("_place", "_least")  # one row


def upsample(hypothesis: DataFrame, order: Column | None = None, seed: int = 1) -> DataFrame:
    """Samples of the smaller class repeated until both are equal: (sample, y, copies)."""
    counts = hypothesis.where("y <> 0").groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(order if order is not None else _by_hash(seed), "sample"))
    out = hypothesis.where("y <> 0").withColumn("_place", place).join(F.broadcast(counts), "y").join(F.broadcast(most))  # two rows and one
    copies = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_place") <= F.col("_most") % F.col("_n"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("_place", "_n", "_most")


def penalty_scale(matrix: DataFrame, target: DataFrame, least_squares: bool = False) -> DataFrame:
    """|A'b| of each column, b the centred response: (col_id, gene, grad).

    ``matrix``: (col_id, gene, sample, value); ``target``: (sample, y). Logistic: b is
    m2/m for positives and -m1/m for negatives; least squares: b is y.
    """
    counts = class_counts(target)
    m = F.col("n_pos") + F.col("n_neg")
    b = F.col("y") if least_squares else F.when(F.col("y") > 0, (1 - F.col("m1")) / m).otherwise(-F.col("m1") / m)
    rows = target.where("y <> 0").join(F.broadcast(counts)).select("sample", b.alias("b"))  # one row
    return matrix.join(rows, "sample").groupBy("col_id", "gene").agg(F.abs(F.sum(F.col("value") * F.col("b"))).alias("grad"))


def lambda1_max(grads: DataFrame) -> DataFrame:
    return grads.agg(F.max("grad").alias("lambda1_max"))


def lambda2_max(grads: DataFrame, l1: float) -> DataFrame:
    """Largest group norm of the gradient after the first penalty, over the root of the group's length; per gene and overall by max."""
    top = lambda1_max(grads)
    cut = F.greatest(F.col("grad") - F.lit(l1) * F.col("lambda1_max"), F.lit(0.0))
    out = grads.join(F.broadcast(top)).groupBy("gene").agg(F.sqrt(F.sum(cut**2)).alias("norm"), F.count(F.lit(1)).alias("n_columns"))  # one row
    return out.withColumn("lambda2_bound", F.col("norm") / F.sqrt("n_columns"))
