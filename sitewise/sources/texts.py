"""Text files of results, in the layout that other tools of this kind read.

Every line is a row (file, n, value): its file under the output folder, its place in
it, its text. All files are written by one job, dealt by file and by PART_LINES places; the driver then only
renames them. A file of more places than that becomes a folder of parts, in order of their names, which Spark's reader takes like a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import MINOR_POS, label

TAB = "\t"
PART_LINES = 5_000_000


def lines(rows: DataFrame, file: Column, value: Column, *order: Column) -> DataFrame:
    """(file, n, value), numbered per file in the order given."""
    made = rows.withColumn("file", file).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long"))
    return made.select("file", "n", value.alias("value"))


def placed_lines(rows: DataFrame, file: Column, value: Column, n: Column) -> DataFrame:
    """(file, n, value) of rows that know their places: no task sees a whole file."""
    return rows.select(file.alias("file"), n.cast("long").alias("n"), value.alias("value"))


def folder(*by: str, nested: bool = True) -> Column:
    """lambda_N/, under penalty_N/ with several penalty terms."""
    run = F.concat(F.lit("lambda_"), F.col("run").cast("string"), F.lit("/"))
    return F.concat(F.lit("penalty_"), F.col("penalty_idx").cast("string"), F.lit("/"), run) if nested else run


def unplaced(rows: DataFrame) -> DataFrame:
    """Rows of numeric columns, whose labels are the gene's and the feature's name."""
    return rows.withColumn("pos", F.lit(MINOR_POS))


def _names() -> Column:
    return label(F.col("gene"), F.col("pos"), F.col("allele"))


def weight_lines(weights: DataFrame, intercepts: DataFrame, file: Column) -> DataFrame:
    """Label and weight in full precision, non-zero ones in order of columns, the intercept last with six decimals."""
    by = [c for c in ("penalty_idx", "run", "fold") if c in weights.columns and c in intercepts.columns]
    own = weights.where("w <> 0").select(*by, "col_id", F.concat_ws(TAB, _names(), F.format_string("%.17e", "w")).alias("_line"))
    last = intercepts.select(*by, F.lit(1 << 62).cast("long").alias("col_id"), F.format_string("Intercept\t%.6f", "intercept").alias("_line"))
    return lines(own.unionByName(last), file, F.col("_line"), F.col("col_id"))


def gene_lines(scores: DataFrame, file: Column, value: str = "score", form: str = "%.15g") -> DataFrame:
    """Scores of genes, falling by score and name."""
    return lines(scores, file, F.concat_ws(TAB, "gene", F.format_string(form, value)), F.desc(value), F.desc("gene"))


def position_lines(scores: DataFrame, file: Column, value: str = "score", form: str = "%.15f") -> DataFrame:
    """Scores of positions by gene and position."""
    name = F.concat_ws("_", "gene", F.col("pos").cast("string"))
    return lines(scores, file, F.concat_ws(TAB, name, F.format_string(form, value)), F.col("gene"), F.col("pos"))


def feature_lines(features: DataFrame) -> DataFrame:
    """combined.map: number and label of every column."""
    head = features.sparkSession.createDataFrame([("combined.map", 0, "Position\tLabel")], "file string, n long, value string")
    return placed_lines(features, F.lit("combined.map"), F.concat_ws(TAB, F.col("col_id").cast("string"), _names()), F.col("col_id") + 1).unionByName(head)


def minor_lines(features: DataFrame, tiered: bool) -> DataFrame:
    """Labels of the minor alleles behind the columns of minor alleles; with ``tiered``, their frequencies too."""
    minor = features.where((F.col("pos") != MINOR_POS) & (F.col("allele") != F.col("major")))
    freq = F.format_string("%.6f", (F.col("n").cast("float") / F.col("total").cast("float")).cast("double"))
    return placed_lines(minor, F.lit("tiered_minor_alleles.txt" if tiered else "minor_alleles.txt"), F.concat_ws(TAB, _names(), freq) if tiered else _names(), F.col("col_id"))


def matrix_lines(cells: DataFrame, indexed: DataFrame, samples: DataFrame, file: str, transposed: bool = False, sep: str = ",") -> DataFrame:
    """The matrix as text, samples by columns or, ``transposed``, columns by samples; a row's zeros are written out, so
    a line is as long as the matrix is wide (the cells themselves are the form for large ones)."""
    order = samples.where("y <> 0").select("sample", (F.row_number().over(Window.orderBy("ord")) - 1).alias("row"))  # the cohort
    own = cells.join(F.broadcast(order), "sample").select("row", "col_id", *(["value"] if "value" in cells.columns else [F.lit(1).alias("value")]))
    names = F.array_sort(F.collect_list(F.struct("at", "name")))["name"]
    columns, rows = indexed.select(F.col("col_id").alias("at"), _names().alias("name")), order.select(F.col("row").cast("long").alias("at"), F.col("sample").cast("string").alias("name"))
    across, down = (rows, columns) if transposed else (columns, rows)
    place, key = ("row", "col_id") if transposed else ("col_id", "row")
    head = across.agg(names.alias("names"), F.count(F.lit(1)).alias("width"))
    held = own.groupBy(F.col(key).cast("long").alias("at")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(place).cast("long"), "value"))).alias("m"))
    full = down.join(held, "at", "left").crossJoin(F.broadcast(head.select("width")))  # one row
    cell = lambda i: F.coalesce(F.try_element_at("m", i).cast("string"), F.lit("0"))
    body = full.select(F.lit(file).alias("file"), (F.col("at") + 1).alias("n"), F.concat_ws(sep, "name", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), cell), sep)).alias("value"))
    return head.select(F.lit(file).alias("file"), F.lit(0).cast("long").alias("n"), F.concat_ws(sep, F.lit("Label" if transposed else "SeqID"), F.array_join("names", sep)).alias("value")).unionByName(body)


def prediction_lines(predicted: DataFrame, gene_scores: DataFrame, file: Column, key: list[str], prediction: str = "prediction", header: str = "Prediction") -> DataFrame:
    """Per sample its response, prediction and the score of every gene (NaN: the sample lacks it), genes by name."""
    genes = gene_scores.groupBy(*key).agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    own = gene_scores.groupBy(*key, "sample").agg(F.map_from_entries(F.collect_list(F.struct("gene", "score"))).alias("m"))
    met = predicted.join(own, [*key, "sample"], "left").join(genes, key)
    number = lambda c: F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), F.format_string("%.6f", c))
    scores = F.array_join(F.transform("genes", lambda g: F.coalesce(number(F.try_element_at("m", g)), F.lit("NaN"))), TAB)
    body = lines(met, file, F.concat_ws(TAB, F.col("sample").cast("string"), F.coalesce(number("y"), F.lit("NaN")), number(prediction), scores), F.col("sample"))
    head = genes.select(file.alias("file"), F.lit(0).cast("long").alias("n"), F.concat_ws(TAB, F.lit(f"SeqID\tResponse\t{header}"), F.array_join("genes", TAB)).alias("value"))
    return body.unionByName(head)


def read_weights(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(penalty_idx, run, label, w) of weights files; the numbers are those of folders penalty_P and lambda_N above a file, else 0.
    Lines without a tab or a number are left out; of a label that a file repeats, weights add up."""
    rows = spark.read.text(paths).select(F.input_file_name().alias("path"), F.substring_index("value", TAB, -1).try_cast("double").alias("w"), F.regexp_extract("value", r"(?s)^(.*)\t", 1).alias("label"), F.contains("value", F.lit(TAB)).alias("ok"))
    number = lambda name: F.coalesce(F.regexp_extract("path", rf"/{name}_(\d+)/", 1).try_cast("int"), F.lit(0))
    return rows.where("ok AND w IS NOT NULL").groupBy(number("penalty").alias("penalty_idx"), number("lambda").alias("run"), "label").agg(F.sum("w").alias("w"))


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, key, score) of files of scores by gene, position or label."""
    rows = spark.read.text(paths).where(F.contains("value", F.lit(TAB)))
    return rows.select(F.input_file_name().alias("file"), F.regexp_extract("value", r"(?s)^(.*)\t", 1).alias("key"), F.substring_index("value", TAB, -1).try_cast("double").alias("score")).where("score IS NOT NULL")


def read_minor(spark: SparkSession, path: str) -> DataFrame:
    """(label, freq) of a file of minor alleles, with or without frequencies."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", TAB).alias("p"))
    return rows.select(F.element_at("p", 1).alias("label"), F.try_element_at("p", F.lit(2)).try_cast("double").alias("freq"))


def write(out: str, *parts: DataFrame) -> None:
    """Writes the files of all ``parts`` under ``out``."""
    every = reduce(DataFrame.unionByName, parts)
    spark = every.sparkSession
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    system = path_of(out).getFileSystem(context._jsc.hadoopConfiguration())
    raw = f"{out}/.lines"
    part = F.floor(F.col("n") / PART_LINES)
    dealt = every.withColumns({"file": F.regexp_replace("file", "/", "@@"), "part": part}).repartition("file", "part").sortWithinPartitions("file", "part", "n")
    dealt.select("file", "part", "value").write.mode("overwrite").partitionBy("file", "part").text(raw)
    for status in system.listStatus(path_of(raw)):
        name = status.getPath().getName()
        if not name.startswith("file="):
            continue
        target = path_of(f"{out}/{name[5:].replace('@@', '/')}")
        parts = sorted(system.listStatus(status.getPath()), key=lambda p: int(p.getPath().getName().partition("=")[2]))
        system.delete(target, True)
        system.mkdirs(target.getParent() if len(parts) == 1 else target)
        for i, own in enumerate(parts):
            for file in system.listStatus(own.getPath()):  # one, as a part is dealt to one task
                system.rename(file.getPath(), target if len(parts) == 1 else path_of(f"{target.toString()}/part-{i:05d}"))
    system.delete(path_of(raw), True)
