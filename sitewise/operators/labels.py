"""Labels of text models: which gene a label belongs to, and models put together from the files that hold them.

A label of a numeric table is a gene's name, ``_``, and a feature's. Both may have ``_`` themselves, so a label belongs to the longest
name that it begins with. A label has few ``_``, hence few beginnings: each is looked up by equality, and the longest that is a
name is kept. That is a hash join however many names there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MINOR_POS, label_parts


def resolved(labels: DataFrame, genes: DataFrame) -> DataFrame:
    """(label, gene, rest) of each distinct label; gene and rest are null for a label that begins with no gene of ``genes``.

    What follows the name and its ``_`` is not empty. Null labels belong to no gene.
    """
    every = labels.select("label").distinct()
    parts = F.split("label", "_", -1)
    cut = every.where(F.contains("label", F.lit("_"))).select("label", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("_k"), parts.alias("_p"))
    cut = cut.select("label", F.array_join(F.slice("_p", F.lit(1), F.col("_k")), "_").alias("gene")).where(F.length("label") > F.length("gene") + 1)
    found = cut.join(genes.select("gene").distinct(), "gene").groupBy("label").agg(F.max_by("gene", F.length("gene")).alias("gene"))
    out = every.join(found, "label", "left")
    return out.select("label", "gene", F.substring(F.col("label"), F.length("gene") + 2, F.length("label")).alias("rest"))


def text_model(lines: DataFrame, genes: DataFrame, minor: DataFrame | None = None) -> dict[str, DataFrame]:
    """features, weights and intercepts of weights files of alignments, as :func:`evaluate` takes them; a label is its own col_id.

    These labels end in a position and a character, or in the name of a column of minor alleles, and are read from the right.

    ``lines``: (penalty_idx, run, label, w); ``genes``: (gene), the names that labels may begin with; ``minor``: (label, freq), the
    labels of minor alleles behind columns of minor alleles, freq null where the file has none. ``unknown`` has the labels of no gene.
    """
    base = lines.where("label <> 'Intercept'")
    every = (base.select("label") if minor is None else base.select("label").unionByName(minor.select("label"))).distinct()
    parts, own = label_parts(F.col("label")), lambda k: F.regexp_extract("label", r"(?s)^(.*)_(minor|tminor_[^_]+)$", k)
    of_gene = own(2) != ""  # a column of minor alleles
    named = every.select("label", F.when(of_gene, own(1)).otherwise(parts["gene"]).alias("gene"), F.when(of_gene, F.lit(MINOR_POS)).otherwise(parts["pos"]).alias("pos"), F.when(of_gene, own(2)).otherwise(parts["allele"]).alias("allele"))
    known = named.join(genes.select("gene").distinct(), "gene", "left_semi")
    features = known.join(base.select("label").distinct(), "label", "left_semi").select(F.col("label").alias("col_id"), "gene", "pos", "allele", F.lit(None).cast("string").alias("major"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("total"))
    if minor is not None:  # any allele of the file counts as minor
        parts = known.where(F.col("pos") != MINOR_POS).join(minor.groupBy("label").agg(F.max("freq").alias("freq")), "label")
        # a million samples stand for a share that was written with six digits
        behind = parts.select(F.concat(F.lit("\0"), "label").alias("col_id"), "gene", "pos", "allele", F.lit("").alias("major"), F.round(F.col("freq") * 1_000_000).cast("long").alias("n"), F.lit(1_000_000).cast("long").alias("total"))
        features = features.unionByName(behind)
    keys = ("penalty_idx", "run")
    return {
        "features": features,
        "weights": base.select(*keys, F.col("label").alias("col_id"), "w"),
        "intercepts": lines.where("label = 'Intercept'").select(*keys, F.col("w").alias("intercept")).unionByName(
            lines.select(*keys).distinct().join(lines.where("label = 'Intercept'").select(*keys), list(keys), "left_anti").withColumn("intercept", F.lit(0.0))),
        "unknown": named.join(genes, "gene", "left_anti").select("label"),
    }
