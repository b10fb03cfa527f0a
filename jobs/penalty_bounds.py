"""Screens the feature columns of labelled sequences before training: gradients and penalty bounds, for the whole and without each fold.

    python -m jobs.penalty_bounds --sequences FOLDER --labels FOLDER --out FOLDER [--config jobs/penalty_bounds.json]

Training scales its penalties by the largest gradient at zero weights (lambda1_max) and by the largest norm that a gene's
gradients keep beyond a share ``ratio`` of it (lambda2), and does so again for every fold of a cross-validation. This job gives those
bounds for all of them from one pass: slices of sequences are counted per (gene, pos, allele) with the class counts
of every fold, no row per character; what is left of a count without a fold is a difference. Users see, before any solver runs, which columns can
enter at that ratio, in how many folds, and which penalties leave a gene out.

Output, partitioned by gene: pos, allele, n, n_pos, n_neg, grad (whole cohort), grad_min and grad_max over the folds, kept
(folds in which grad exceeds ratio * lambda1_max of the fold), n_columns of the gene, lambda1_max, lambda2_bound (whole), lambda2_min and
lambda2_max over the folds. The output is overwritten as a whole, so a rerun gives the same rows and none of an earlier input.

Scale: one shuffle of pre-aggregated counts; a gene with most rows is spread by position, also in files. To the driver come
class counts and lambda1_max, a number per fold. Edge cases: null labels and sequences without a label take no part; of a
sample's labels the largest counts, of its sequences in a gene the last; null and empty sequences have no sites; null or
empty genes are one gene of the name ``no_gene``; a cohort of one class has gradients 0; other columns are not read.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import scores as S
from sitewise.operators import sites as A
from sitewise.sources.scratch import settled

from .common import aligned, command_line

LOG = logging.getLogger("jobs.penalty_bounds")
OUTPUT = ("pos int, allele string, n long, n_pos long, n_neg long, grad double, grad_min double, grad_max double, kept int, n_columns long, lambda1_max double, "
          "lambda2_bound double, lambda2_min double, lambda2_max double, gene string")


@dataclass
class Config:
    gene: str = "lang"
    sample: str = "doc_id"
    seq: str = "text"
    response: str = "quality"  # of the labels: 1 is the positive class
    no_gene: str = "(none)"
    folds: int = 5  # a sample's fold is its number modulo this
    ratio: float = 0.1
    min_minor: int = 2
    drop_major: bool = False
    block: int = 65_536  # positions of a gene that go to one file


def _gradient(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """|A'b| of a column of the matrix that has ``pos`` positives and ``neg`` negatives, b the centred response."""
    m = n_pos + n_neg
    return F.abs(pos * F.lit(n_neg / m / m) - neg * F.lit(n_pos / m / m)) if m else F.lit(0.0)


def screen(spark: SparkSession, sequences: str, labels: str, config: Config) -> DataFrame:
    """The output's rows."""
    k = config.folds
    y = F.when(F.col(f"`{config.response}`") == 1, 1.0).otherwise(-1.0)
    cohort = spark.read.parquet(labels).where(F.col(f"`{config.response}`").isNotNull()).groupBy(F.col(f"`{config.sample}`").alias("sample")).agg(F.max(y).alias("y"))
    cohort = S.folds(cohort, k, "sample")
    sizes = {r.fold: (r.pos, r.neg) for r in cohort.groupBy("fold").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") < 0).alias("neg")).collect()}  # a row per fold
    whole = tuple(map(sum, zip((0, 0), *sizes.values(), strict=True)))
    sets = [whole] + [tuple(w - s for w, s in zip(whole, sizes.get(f, (0, 0)), strict=True)) for f in range(k)]
    rows = A.one_of_each(aligned(spark.read.parquet(sequences), config.gene, config.sample, config.seq, config.no_gene))
    met = rows.join(cohort.select("sample", (2 * F.col("fold") + (F.col("y") < 0).cast("int")).cast("long").alias("class")), "sample")
    classes = [f"n{c}" for c in range(2 * k)]  # of fold f, n{2f} are its positives and n{2f + 1} its negatives
    counts = settled(A.class_counts(met, 2 * k).select("gene", "pos", "ch", sum(map(F.col, classes)).alias("n"), F.array(*classes[::2]).alias("pos_of"), F.array(*classes[1::2]).alias("neg_of")), "class_counts")
    found = A.features(counts.select("gene", "pos", "ch", "n"), config.min_minor, config.drop_major).select("gene", "pos", F.col("allele").alias("ch"))
    found = counts.join(found, ["gene", "pos", "ch"])
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    found = found.withColumns({"n_pos": add("pos_of"), "n_neg": add("neg_of")})
    without = lambda c, of, t: F.col(c) if not t else F.col(c) - F.get(of, F.lit(t - 1))
    found = settled(found.select("gene", "pos", F.col("ch").alias("allele"), "n", "n_pos", "n_neg", *[_gradient(without("n_pos", "pos_of", t), without("n_neg", "neg_of", t), *sets[t]).alias(f"g{t}") for t in range(k + 1)]), "gradients")
    most = [v or 0.0 for v in found.agg(*[F.max(f"g{t}") for t in range(k + 1)]).first()]  # a number per fold
    beyond = lambda t: F.greatest(F.col(f"g{t}") - F.lit(config.ratio * most[t]), F.lit(0.0))
    genes = found.groupBy("gene").agg(F.count(F.lit(1)).alias("n_columns"), *[F.sqrt(F.sum(beyond(t) ** 2)).alias(f"norm{t}") for t in range(k + 1)])
    bound = [F.col(f"norm{t}") / F.sqrt("n_columns") for t in range(k + 1)]
    folds = range(1, k + 1)
    extreme = lambda f, cs: f(*cs) if len(cs) > 1 else cs[0] if cs else F.lit(None).cast("double")
    genes = genes.select("gene", "n_columns", bound[0].alias("lambda2_bound"), extreme(F.least, [bound[t] for t in folds]).alias("lambda2_min"), extreme(F.greatest, [bound[t] for t in folds]).alias("lambda2_max"))
    grads = [F.col(f"g{t}") for t in folds]
    kept = sum(((F.col(f"g{t}") > F.lit(config.ratio * most[t])).cast("int") for t in folds), F.lit(0))
    out = found.select("gene", "pos", "allele", "n", "n_pos", "n_neg", F.col("g0").alias("grad"), extreme(F.least, grads).alias("grad_min"), extreme(F.greatest, grads).alias("grad_max"), kept.alias("kept"), F.lit(most[0]).alias("lambda1_max"))
    return out.join(genes, "gene").select(*[part.strip().split()[0] for part in OUTPUT.split(",")])


def run(spark: SparkSession, sequences: str, labels: str, out: str, config: Config | None = None) -> dict[str, int]:
    """Writes the screen of ``sequences`` and ``labels`` to ``out``."""
    config = config or Config()
    rows = screen(spark, sequences, labels, config).repartition("gene", F.floor(F.col("pos") / config.block)).sortWithinPartitions("gene", "pos", "allele")
    rows.write.mode("overwrite").partitionBy("gene").parquet(out)
    genes, columns, kept = bounds(spark, out).agg(F.count_distinct("gene"), F.count(F.lit(1)), F.count_if(F.col("kept") == config.folds)).first()
    LOG.info("read %d sequences from %s and %d labels from %s; wrote %d columns of %d genes to %s, %d of them within reach in every fold",
             spark.read.parquet(sequences).count(), sequences, spark.read.parquet(labels).count(), labels, columns, genes, out, kept)
    return {"genes": genes, "columns": columns, "kept": kept}


def bounds(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(out)


if __name__ == "__main__":
    command_line(__doc__, Config, run, ("sequences", "labels", "out"))
