"""Column expressions: labels, shrinkage, stable logistic terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character domains of typed alignments (fixed values).
DOMAINS = {
    "protein": "ACDEFGHIKLMNPQRSTVWYBZXJUOacdefghiklmnpqrstvwybzxjuo?-*",
    "nucleotide": "ACGTacgt?-",
}
#: Characters that are no allele when alleles are counted; X too where skip_x holds.
GAPS = ("-", "?")


#: Position of a gene's columns of minor alleles: after all sites.
MINOR_POS = 2**31 - 1


def label(gene: Column, pos: Column, allele: Column) -> Column:
    """``{gene}_{pos}_{allele}``; ``{gene}_{allele}`` for a column of minor alleles."""
    return F.concat_ws("_", gene, F.when(pos != MINOR_POS, pos.cast("string")), allele)


def label_parts(text: Column) -> Column:
    """Struct (gene, pos, allele) of a label, read from the right."""
    part = lambda k: F.regexp_extract(text, r"(?s)^(.*)_(\d+)_(.)$", k)
    return F.struct(part(1).alias("gene"), part(2).cast("int").alias("pos"), part(3).alias("allele"))


def stem(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def valid_residues(seq: Column, datatype: str, domains: dict[str, str] | None = None) -> Column:
    """Whether all characters belong to the datatype's domain (of ``domains``, if given); universal and numeric take any."""
    domains = DOMAINS if domains is None else domains
    if datatype not in domains:
        return F.lit(True)
    return F.length(F.translate(seq, domains[datatype], "")) == 0


def soft_threshold(v: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.signum(v) * F.greatest(F.abs(v) - by, F.lit(0.0))


def group_shrink(v: Column, norm: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.when(norm > by, v * (norm - by) / norm).otherwise(F.lit(0.0))


def logistic_loss(a: Column) -> Column:
    """log(1 + exp(a)) without overflow."""
    b = F.greatest(a, F.lit(0.0))
    return F.log(F.exp(-b) + F.exp(a - b)) + b


def sigmoid(a: Column) -> Column:
    return F.when(a >= 0, 1 / (1 + F.exp(-a))).otherwise(F.exp(a) / (1 + F.exp(a)))


def median_nonzero(v: Column) -> Column:
    """Aggregate: median of the values that are neither 0 nor NaN nor null; 0 if there are none."""
    kept = F.when((v != 0) & ~F.isnan(v), v)
    return F.coalesce(F.percentile(kept, F.lit(0.5)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
