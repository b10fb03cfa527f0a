"""Small text inputs and sinks: lists, hypotheses, numeric tables, score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stem


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rpartition(".")[0] or name


def read_list(text: str, folder: str = "") -> list[tuple[int, str, str]]:
    """(group, gene, path) of a list file: a line is a group of comma-separated files. A gene is a file's stem; of
    files with the same stem, in any line, the first one counts, and a group has it once."""
    out: list[tuple[int, str, str]] = []
    first: dict[str, str] = {}
    group = 0
    for line in text.splitlines():
        seen: set[str] = set()
        for part in line.split(","):
            path = part.strip().replace("\\", "/")
            if path and (gene := _stem(path)) not in seen:
                seen.add(gene)
                out.append((group, gene, first.setdefault(gene, path if path.startswith("/") or not folder else f"{folder.rstrip('/')}/{path}")))
        group += bool(seen)
    return out


def read_adaptive_list(text: str, sizes: dict[str, int]) -> list[tuple[str, str]]:
    """(gene, path) of the first file of each line, each gene once, of those in ``sizes``."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        path = line.split(",")[0].strip().replace("\\", "/")
        if path and _stem(path) in sizes:
            out.setdefault(_stem(path), path)
    return list(out.items())


def unique_groups(groups: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Without the later ones of groups with the same members, renumbered."""
    by: dict[int, list[tuple[str, str]]] = {}
    for g, gene, path in groups:
        by.setdefault(g, []).append((gene, path))
    kept: dict[frozenset, list[tuple[str, str]]] = {}
    for members in by.values():
        kept.setdefault(frozenset(g for g, _ in members), members)
    return [(i, gene, path) for i, members in enumerate(kept.values()) for gene, path in members]


def overlapping(groups: list[tuple[int, str, str]]) -> bool:
    seen: dict[str, int] = {}
    return any(seen.setdefault(gene, g) != g for g, gene, _ in groups)


def write_config(path: str, **settings) -> None:
    """Settings of a step as key=value lines."""
    with open(path, "w") as f:
        f.writelines(f"{k}={str(v).lower() if isinstance(v, bool) else v}\n" for k, v in settings.items())


def read_config(path: str) -> dict[str, str]:
    with open(path) as f:
        return dict(line.rstrip("\n").split("=", 1) for line in f if "=" in line)


def read_hypothesis(spark: SparkSession, path: str) -> DataFrame:
    """(sample, ord, y): name and value a line, separated by tab or else by spaces, in file order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).where(F.trim("line") != "")
    cut = F.when(F.contains("line", F.lit("\t")), F.split(F.trim("line"), r"\t+")).otherwise(F.split(F.trim("line"), r"\s+"))
    return rows.select(F.trim(F.element_at(cut, 1)).alias("sample"), "ord", F.element_at(cut, 2).cast("double").alias("y"))


def check_hypothesis(hypothesis: DataFrame) -> None:
    """Responses are -1, 0 or 1 and at least two are not 0."""
    bad, some = hypothesis.agg(F.count_if(~F.coalesce(F.col("y").isin(-1.0, 0.0, 1.0), F.lit(False))), F.count_if(F.col("y") != 0)).first()
    if bad:
        raise ValueError(f"{bad} responses are not -1, 0 or 1")
    if some < 2:
        raise ValueError("fewer than two samples have a response")


def read_numeric(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene, sample, feature, name, value) of whitespace tables.

    A first row whose second token is no number is a header; otherwise features are
    named col_0, col_1, ... Short rows are an error, extra tokens are ignored. Lines are read in splits: a table of any length is
    many tasks, and only each file's first line goes to the others.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"), "value").where(~F.col("value").rlike(r"^\s*$"))
    cut = lines.select(stem(F.col("path")).alias("gene"), "path", "at", F.split(F.regexp_replace(F.rtrim("value", F.lit(" \t\r\x0b\x0c")), r"^\s+", ""), r"\s+").alias("t"))
    # files of the same name are one gene; a file's first line is found in its first split that has one
    first = cut.groupBy("gene", "path").agg(F.min_by("t", "at").alias("head"), F.min("at").alias("first"))
    number = F.try_element_at("head", F.lit(2)).try_cast("double").isNotNull()
    first = first.select("gene", "path", "first", F.when(~number, F.slice("head", 2, 1_000_000_000)).alias("names"), (F.size("head") - 1).alias("width"))
    rows = cut.join(first, ["gene", "path"]).where(F.col("names").isNull() | (F.col("at") > F.col("first")))
    enough = F.when(F.size("t") - 1 < F.col("width"), F.raise_error(F.concat(F.lit("short row in "), "gene"))).otherwise(F.slice("t", F.lit(2), F.col("width")))
    long = rows.select("gene", F.element_at("t", 1).alias("sample"), "names", F.posexplode(enough).alias("feature", "text"))
    name = F.coalesce(F.try_element_at("names", F.col("feature") + 1), F.concat(F.lit("col_"), F.col("feature").cast("string")))
    return long.select("gene", "sample", "feature", name.alias("name"), F.col("text").cast("float").alias("value"))


def read_domains(text: str) -> dict[str, str]:
    """Character domains of an ini file: sections (datatypes), each with the characters on its lines."""
    out: dict[str, str] = {}
    section = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
            out[section] = ""
        elif line and not line.startswith(("#", ";")):
            name, equals, value = line.partition("=")
            if section is None and equals:
                out[name.strip()] = value.strip()
            elif section is not None:
                out[section] += (value if equals else line).strip()
    return out


def read_field(text: str) -> list[int]:
    """1-based column numbers of overlapping groups, from one CSV row, as 0-based ones."""
    return [int(float(v)) - 1 for v in text.replace("\n", ",").split(",") if v.strip()]


def read_class_weights(text: str) -> tuple[float, float] | None:
    """Weights of positives and negatives, on two lines; anything else is ignored."""
    rows = [float(v) for v in text.split() if v]
    return (rows[0], rows[1]) if len(rows) == 2 else None


def read_gene_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(sample, y, prediction, gene, score) of a tab-separated table with a column per gene; NaN: the gene is absent."""
    wide = spark.read.csv(path, sep="\t", header=True, nanValue="NaN")
    base, genes = wide.columns[:3], wide.columns[3:]
    if not genes:
        return spark.createDataFrame([], "sample string, y double, prediction double, gene string, score double")
    long = wide.select(F.col(f"`{base[0]}`").alias("sample"), F.col(f"`{base[1]}`").cast("double").alias("y"), F.col(f"`{base[2]}`").cast("double").alias("prediction"),
                       F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").cast("double").alias("score")) for g in genes])).alias("s"))
    return long.select("sample", "y", "prediction", "s.gene", F.nullif(F.col("s.score"), F.lit(float("nan"))).alias("score"))
