"""Training: encode, solve a grid, score, cross-validate; evaluation on new alignments."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grids
from ..functions.columns import MINOR_POS, sigmoid
from ..operators import scores as S
from ..operators import sites as A
from ..solver.distributed import gather, numbered, solve_grid
from ..solver.kernel import Groups, Options
from ..solver.rows import Rows, cohort
from ..solver.sweep import Point, solve_sweep
from ..sources.scratch import beside, settled


@dataclass
class TrainOptions:
    method: str = "sg_lasso"
    lambdas: list[tuple[int, float, float]] = field(default_factory=lambda: [(0, 0.1, 0.1)])
    min_minor: int = 2
    drop_major: bool = False
    skip_x: bool = False
    group_penalty: str = "std"
    penalty_range: tuple[float, float, float] = (1, 1, 1)
    folds: int = 0
    precision: str = "fp32"
    min_groups: int = 0
    class_balance: str = "none"
    auto_bit_ct: float | None = None
    groups: DataFrame | None = None  # (group, gene), for overlapping groups
    group_columns: list[int] | None = None  # columns of the groups one after the other, in place of their genes' columns
    minor: str = "none"  # or minor, tiered: columns of minor alleles
    solver: Options = field(default_factory=Options)
    max_entries: int = 200_000_000
    max_samples: int = 20_000  # beyond, samples stay spread over the cluster if there are no more columns than samples


@dataclass
class Encoded:
    sites: DataFrame
    features: DataFrame
    cells: DataFrame
    genes: list[tuple[str, int, int]]  # name, columns, variable sites
    n: int


@dataclass
class TrainResult:
    encoded: Encoded
    weights: DataFrame  # run, fold, penalty_idx, col_id, gene, pos, allele, w
    intercepts: DataFrame
    gene_scores: DataFrame
    position_scores: DataFrame
    totals: DataFrame
    medians: dict[str, DataFrame]
    cv_predictions: DataFrame | None = None
    cv_metrics: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)  # what stays in memory until release()
    fold_weights: DataFrame | None = None  # run, fold, penalty_idx, col_id, gene, pos, allele, w; the intercept has col_id -1
    pruned: list[tuple[int, int]] = field(default_factory=list)

    def release(self) -> None:
        """Frees what training keeps in memory; results that are read later are computed again."""
        for frame in self.held:
            frame.unpersist()


def encode(alignments: DataFrame, hypothesis: DataFrame, min_minor: int = 2, drop_major: bool = False, skip_x: bool = False, dropout: DataFrame | None = None, minor: str = "none") -> Encoded:
    """Features and non-zero cells over the samples with a response; of a repeated sample in a gene the last sequence.

    ``minor``: none, or a gene's columns of minor alleles too (minor: one for any, tiered: one per frequency tier).
    """
    met = A.with_hypothesis(A.one_of_each(alignments).select("gene", "sample", "seq"), hypothesis)
    sites = A.ungapped(A.explode_sites(met.select("gene", "sample", "seq")), skip_x)
    counts = A.allele_counts(sites)
    found = A.features(counts, min_minor, drop_major, dropout)
    if minor != "none":
        found = found.unionByName(A.minor_features(found, minor == "tiered"), allowMissingColumns=True)
    features = A.feature_index(settled(found, "features")).persist()
    variable = A.variable_sites(A.site_stats(counts)).groupBy("gene").agg(F.count(F.lit(1)).alias("v"))
    genes = [(r.gene, r.n_columns, r.v or 0) for r in A.gene_sizes(features).join(variable, "gene", "left").orderBy("gene").collect()]  # a row per gene
    cells = A.cells(sites, features)
    if minor != "none":
        cells = cells.unionByName(A.minor_cells(sites, features))
    return Encoded(sites, features, cells, genes, sum(g[1] for g in genes))


def encode_numeric(numeric: DataFrame, hypothesis: DataFrame) -> Encoded:
    """Numeric tables (gene, sample, feature, name, value): a column per gene and feature, its value in the cells."""
    some = numeric.join(hypothesis.where("y <> 0").select("sample"), "sample")
    columns = some.select("gene", F.col("feature").alias("pos"), F.col("name").alias("allele")).distinct()
    features = A.feature_index(columns).persist()
    cells = some.where("value <> 0").select("gene", F.col("feature").alias("pos"), "sample", F.col("value").cast("double").alias("value"))
    cells = cells.join(features.select("gene", "pos", "col_id"), ["gene", "pos"]).select("col_id", "sample", "value")
    genes = [(r.gene, r.n_columns, r.n_columns) for r in A.gene_sizes(features).orderBy("gene").collect()]  # a row per gene
    return Encoded(some, features, cells, genes, sum(g[1] for g in genes))


def listed(o: TrainOptions) -> list[tuple[int, str]] | None:
    """(group, gene) of the list file, if groups are given."""
    return None if o.groups is None else [(r.group, r.gene) for r in o.groups.select("group", "gene").orderBy("group", "gene").collect()]


def _members(encoded: Encoded, o: TrainOptions) -> list[list[int]]:
    """The genes of each group, by their place."""
    return members_of(encoded.genes, listed(o))


def members_of(genes: list[tuple[str, int, int]], groups: list[tuple[int, str]] | None) -> list[list[int]]:
    if groups is None:
        return [[i] for i in range(len(genes))]
    place = {g: i for i, (g, _, _) in enumerate(genes)}
    by: dict[int, list[int]] = {}
    for group, gene in groups:
        by.setdefault(group, []).extend([place[gene]] if gene in place else [])
    return list(by.values())


def _terms(encoded: Encoded, o: TrainOptions, members: list[list[int]]) -> tuple[list[int], list[tuple[float, np.ndarray]]]:
    """Columns of each group, and the groups' weights by penalty term."""
    sizes = [sum(encoded.genes[i][1] for i in own) for own in members]
    sites = [sum(encoded.genes[i][2] for i in own) for own in members]
    terms = grids.penalty_terms(o.group_penalty, *o.penalty_range, var_counts=sites)
    return sizes, [(t, np.array(grids.group_weights(o.group_penalty, t, sizes, sites), np.float64)) for t in terms]


def _field(encoded: Encoded, o: TrainOptions, sizes: list[int]) -> np.ndarray | None:
    """The columns of the groups one after the other, if they are named."""
    if o.group_columns is None:
        return None
    if len(o.group_columns) != sum(sizes) or o.group_columns and not 0 <= min(o.group_columns) <= max(o.group_columns) < encoded.n:
        raise ValueError(f"the field has {len(o.group_columns)} columns, the groups have {sum(sizes)} of 1 to {encoded.n}")
    return np.array(o.group_columns, np.int64)


def _groups(encoded: Encoded, o: TrainOptions) -> list[tuple[float, Groups]]:
    """Groups of columns with their weights, per penalty term; overlapping ones if ``o.groups`` is given."""
    return groups_of(encoded, o, _members(encoded, o))


def groups_of(encoded: Encoded, o: TrainOptions, members: list[list[int]]) -> list[tuple[float, Groups]]:
    start = np.cumsum([0, *(n for _, n, _ in encoded.genes)])
    sizes, terms = _terms(encoded, o, members)
    at = _field(encoded, o, sizes)
    if at is None:
        at = np.concatenate([np.arange(start[i], start[i + 1]) for own in members for i in own] or [np.empty(0, np.int64)]).astype(np.int64)
    return [(t, Groups(at, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), w)) for t, w in terms]


def _atoms(encoded: Encoded, o: TrainOptions) -> tuple[DataFrame, int, list[Groups]]:
    """(col_id, atom) of all columns, the number of atoms, and groups of atoms per penalty term: atoms are genes, or
    classes of columns that a field names in the same groups (-1: in none)."""
    spark = encoded.features.sparkSession
    members = _members(encoded, o)
    sizes, terms = _terms(encoded, o, members)
    at = _field(encoded, o, sizes)
    if at is None:
        place = spark.createDataFrame([(g, i) for i, (g, _, _) in enumerate(encoded.genes)], "gene string, atom int")
        atoms = encoded.features.select("col_id", F.col("gene").cast("string").alias("gene")).join(F.broadcast(place), "gene").select("col_id", "atom")  # a row per gene
        own = [np.array(m, np.int64) for m in members]
        n = len(encoded.genes)
    else:
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((group, at))
        cols, first = np.unique(at[order], return_index=True)
        kinds: dict[tuple, int] = {}
        of = [kinds.setdefault(tuple(np.unique(g).tolist()), len(kinds)) for g in np.split(group[order], first[1:])] if len(cols) else []
        named = spark.createDataFrame([(int(c), a) for c, a in zip(cols, of, strict=True)], "col_id long, atom int")  # the field
        atoms = encoded.features.select("col_id").join(named, "col_id", "left").select("col_id", F.coalesce("atom", F.lit(-1)).alias("atom"))
        own = [np.array([a for k, a in kinds.items() if g in k], np.int64) for g in range(len(sizes))]
        n = len(kinds)
    ends = np.concatenate([[0], np.cumsum([len(m) for m in own])]).astype(np.int64)
    flat = np.concatenate(own or [np.empty(0, np.int64)]).astype(np.int64)
    return atoms, n, [Groups(flat, ends, w) for _, w in terms]


def skipped(lambdas: list[tuple[int, float, float]], gene_counts: dict[int, int], min_groups: int) -> list[int]:
    """Grid points that a sequential sweep would have passed over.

    Once a point has at most ``min_groups`` genes, points with a larger second penalty
    are passed over; if its second penalty is the smallest, all that follow are. Only
    for grids with the first penalty outermost, both rising.
    """
    pairs = [p[1:] for p in lambdas]
    if min_groups <= 0 or any(not (b[0] > a[0] or b[0] == a[0] and b[1] > a[1]) for a, b in zip(pairs, pairs[1:], strict=False)):
        return []
    least, bound, ended, out = min(p[1] for p in pairs), float("inf"), False, []
    for idx, _, l2 in lambdas:
        if ended or l2 > bound:
            out.append(idx)
        elif gene_counts.get(idx, 0) <= min_groups:
            if l2 == least:
                ended = True
            bound = min(bound, l2)
    return out


def train(alignments: DataFrame, hypothesis: DataFrame, options: TrainOptions | None = None, dropout: DataFrame | None = None, numeric: bool = False) -> TrainResult:
    """alignments (gene, sample, seq), or with ``numeric`` a table of values; hypothesis (sample, ord, y)."""
    o = options or TrainOptions()
    spark: SparkSession = alignments.sparkSession
    for _, a, b in o.lambdas:
        grids.check_ratio(a), grids.check_ratio(b)
    solver = o.solver
    if o.class_balance == "down":
        hypothesis = S.downsample(hypothesis)
    elif o.class_balance == "up":
        hypothesis = S.upsample(hypothesis)
    elif o.class_balance == "weighted":
        n_pos, n_neg, _ = S.class_counts(hypothesis).first()
        solver = Options(**{**solver.__dict__, "class_weights": (1.0, n_pos / n_neg) if n_neg else None})
    min_minor = o.min_minor
    if o.auto_bit_ct is not None:
        n_pos, n_neg, _ = S.class_counts(hypothesis).first()
        min_minor = max(1, int(min(n_pos, n_neg) * o.auto_bit_ct / 100))
    encoded = encode_numeric(alignments, hypothesis) if numeric else encode(alignments, hypothesis, min_minor, o.drop_major, o.skip_x, dropout, o.minor)
    encoded.cells = settled(encoded.cells, "cells")
    terms = len(_terms(encoded, o, _members(encoded, o))[1])
    m = hypothesis.where("y <> 0").count()
    if m > o.max_samples and encoded.n <= m:
        return _trained_on_rows(encoded, hypothesis, terms, o, solver)
    samples, y = numbered(hypothesis)
    if "copies" in hypothesis.columns:
        copies = {r.sample: r.copies for r in hypothesis.select("sample", "copies").collect()}  # the cohort
        keep = np.repeat(np.arange(len(samples)), [copies[s] for s in samples])
    else:
        keep = None
    solve = solver_of(encoded, samples, y, keep, o, solver)
    if keep is not None:
        y, samples = y[keep], [samples[i] for i in keep]
    solved, pruned = _swept(encoded, o, terms, solve)
    cv = None
    if o.folds:
        cv = solve([(p, *point) for p in range(terms) for point in o.lambdas if (p, point[0]) not in pruned], o.folds).persist()
    fold_of = None
    if o.folds:
        fields = T.StructType([hypothesis.schema["sample"], T.StructField("fold", T.IntegerType()), T.StructField("y", T.DoubleType())])
        fold_of = spark.createDataFrame([(s, i % o.folds, float(y[i])) for i, s in enumerate(samples)], fields)
    return _result(encoded, solved, cv, fold_of, o, sorted(pruned))


def _trained_on_rows(encoded: Encoded, hypothesis: DataFrame, terms: int, o: TrainOptions, solver: Options) -> TrainResult:
    """The row tier: samples and their folds are tables throughout."""
    people = settled(cohort(hypothesis), "people")
    rows = Rows(encoded.cells, people, encoded.n, o.folds)
    groups = [g for _, g in _groups(encoded, o)]

    def solve(points: list[tuple], folds: int) -> DataFrame:
        some = [Point(run, fold, p, a, b) for p, run, a, b in points for fold in (range(folds) if folds else (-1,))]
        return rows.solve(some, groups, o.method, solver)

    try:
        solved, pruned = _swept(encoded, o, terms, solve)
        cv = solve([(p, *point) for p in range(terms) for point in o.lambdas if (p, point[0]) not in pruned], o.folds) if o.folds else None
    finally:
        rows.release()
    fold_of = people.select("sample", F.pmod("row", F.lit(o.folds)).cast("int").alias("fold"), "y") if o.folds else None
    return _result(encoded, solved, cv, fold_of, o, sorted(pruned))


def _swept(encoded: Encoded, o: TrainOptions, terms: int, solve) -> tuple[DataFrame, set[tuple[int, int]]]:
    """Weights of the grid, and the (term, run) that are passed over.

    With ``min_groups``, points go in rounds of rising second penalty: what a sequential sweep passes over at a point depends only on
    points with a smaller one, so those of a round are solved together and the others never.
    """
    every = [(p, *point) for p in range(terms) for point in o.lambdas]
    pairs = [p[1:] for p in o.lambdas]
    if o.min_groups <= 0 or any(not (b[0] > a[0] or b[0] == a[0] and b[1] > a[1]) for a, b in zip(pairs, pairs[1:], strict=False)):
        return solve(every, 0).persist(), set()
    found, counts, genes = [], {p: {} for p in range(terms)}, encoded.features.select("col_id", "gene")
    for l2 in sorted({b for _, _, b in o.lambdas}):
        so_far = [point for point in o.lambdas if point[2] <= l2]
        gone = {(p, i) for p in range(terms) for i in skipped(so_far, counts[p], o.min_groups)} if found else set()
        now = [x for x in every if x[3] == l2 and (x[0], x[1]) not in gone]
        if not now:
            continue
        found.append(solve(now, 0).persist())
        for r in S.nonzero_genes(found[-1].join(genes, "col_id"), "penalty_idx", "run").collect():  # a row per term and run
            counts[r.penalty_idx][r.run] = r.n_genes
    return reduce(DataFrame.unionByName, found), {(p, i) for p in range(terms) for i in skipped(o.lambdas, counts[p], o.min_groups)}


def solver_of(encoded: Encoded, samples: list, y: np.ndarray, keep: np.ndarray | None, o: TrainOptions, solver: Options):
    """The tier that the number of cells asks for."""
    return (_on_columns if encoded.cells.count() > o.max_entries else _on_grid)(encoded, samples, y, keep, o, solver)


def _on_grid(encoded: Encoded, samples: list, y: np.ndarray, keep: np.ndarray | None, o: TrainOptions, solver: Options):
    """A function of points (term, run, l1, l2) and folds, on a matrix that fits a task."""
    matrix = gather(encoded.cells, samples, encoded.n, o.max_entries, np.float32 if o.precision == "fp32" else np.float64)
    if keep is not None:
        matrix, y = _repeated(matrix, keep), y[keep]
    by_term = {i: g for i, (_, g) in enumerate(_groups(encoded, o))}

    def solve(points: list[tuple], folds: int) -> DataFrame:
        grid = encoded.features.sparkSession.createDataFrame([(run, p, a, b) for p, run, a, b in points], "run int, penalty_idx int, l1 double, l2 double")
        return solve_grid(grid, matrix, y, by_term, o.method, solver, folds)

    return solve


def _on_columns(encoded: Encoded, samples: list, y: np.ndarray, keep: np.ndarray | None, o: TrainOptions, solver: Options):
    """The same with the columns spread over the cluster: all points and folds in one sweep."""
    atoms, n_atoms, groups = _atoms(encoded, o)
    if keep is not None:
        y, samples = y[keep], [samples[i] for i in keep]
    single = o.method == "gl_logisticr"  # the group penalty alone, without weights, by the first ratio
    if single:
        if solver.q not in (1.0, 2.0):
            raise ValueError(f"over {o.max_entries} cells, groups have norms 1 or 2")
        groups = [Groups(g.members, g.start, np.ones_like(g.weight)) for g in groups]
        solver = replace(solver, absolute=True)

    def solve(points: list[tuple], folds: int) -> DataFrame:
        ratios = lambda a, b: ((a, 0.0) if solver.q == 1.0 else (0.0, a)) if single else (a, b)
        some = [Point(run, fold, p, *ratios(a, b)) for p, run, a, b in points for fold in (range(folds) if folds else (-1,))]
        return solve_sweep(encoded.cells, atoms, encoded.n, samples, y, some, groups, n_atoms, folds, not o.method.endswith("leastr"), solver)

    return solve


def _result(encoded: Encoded, solved: DataFrame, cv: DataFrame | None, fold_of: DataFrame | None, o: TrainOptions, pruned: list[tuple[int, int]]) -> TrainResult:
    """Scores, medians and cross-validation of solved weights, per penalty term and run."""
    spark = solved.sparkSession
    by = ("penalty_idx", "run")
    columns = encoded.features.select("col_id", "gene", "pos", "allele")
    weights = solved.where("col_id >= 0").join(columns, "col_id")
    intercepts = solved.where("col_id = -1").select("run", "penalty_idx", F.col("w").alias("intercept"))
    if pruned:
        gone = F.broadcast(spark.createDataFrame(pruned, "penalty_idx int, run int"))  # a row per grid point
        weights, intercepts = weights.join(gone, list(by), "left_anti"), intercepts.join(gone, list(by), "left_anti")
    levels = settled(S.score_levels(weights, *by), "scores")
    gss, pss, hss = (S.of_level(levels, level, *by) for level in ("gene", "position", "all"))
    medians = {}
    if len(o.lambdas) > 1 and not o.folds:
        medians = {"gene": S.grid_median(gss, "score", "penalty_idx", "gene"), "position": S.grid_median(pss, "score", "penalty_idx", "gene", "pos"), "base": S.base_medians(weights, "penalty_idx")}
    out = TrainResult(encoded, weights, intercepts, gss, pss, hss, medians, pruned=pruned, held=[encoded.features, solved])
    if cv is not None:
        of_folds = cv.where("col_id = -1").select(*by, "fold", F.col("w").alias("intercept"))
        out.cv_predictions = S.fold_predictions(encoded.cells, fold_of, cv.where("col_id >= 0"), of_folds, *by)
        out.cv_metrics = S.confusion(out.cv_predictions, *by)
        out.held.append(cv)
        out.fold_weights = cv.join(columns, "col_id", "left")
    return out


def _repeated(matrix, keep: np.ndarray):
    """Rows of the matrix in the order of ``keep``, repeats included."""
    from ..solver.kernel import Columns

    order = np.argsort(matrix.row, kind="stable")
    start = np.searchsorted(matrix.row[order], np.arange(matrix.m + 1))
    at = [order[start[i] : start[i + 1]] for i in keep]
    cells = np.concatenate(at) if at else np.empty(0, np.int64)
    return Columns(len(keep), matrix.n, matrix.col[cells], np.repeat(np.arange(len(keep)), [len(a) for a in at]), None if matrix.value is None else matrix.value[cells], matrix.dtype)


def evaluate_numeric(numeric: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame, hypothesis: DataFrame | None = None) -> dict[str, DataFrame]:
    """Predictions of a model of numeric columns, as :func:`evaluate`."""
    cells = numeric.select("gene", F.col("feature").alias("pos"), "sample", "value").join(features.select("gene", "pos", "col_id"), ["gene", "pos"])
    return _scored(cells.select("col_id", "gene", "sample", "value"), numeric.select("sample", "gene").distinct(), weights, intercepts, hypothesis)


def evaluate(alignments: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame, hypothesis: DataFrame | None = None) -> dict[str, DataFrame]:
    """Predictions of a model on alignments, per gene and in sum, with metrics if responses are known.

    ``weights`` (run, col_id, w) and ``intercepts`` (run, intercept), of several penalty terms with penalty_idx; the
    results have the same keys. A gene that a sample lacks has a null score; of a repeated sample in a gene the last sequence counts.
    """
    alignments = A.one_of_each(alignments)
    sites = A.ungapped(A.explode_sites(alignments.select("gene", "sample", "seq")))
    used = weights.where("w <> 0").select("col_id").distinct()
    known = features.join(used, "col_id", "left_semi")
    wanted = known.where(F.col("pos") != MINOR_POS).select("gene", "pos", F.col("allele").alias("ch"), "col_id")
    cells = sites.join(beside(wanted, "columns"), ["gene", "pos", "ch"]).select("col_id", "gene", "sample", F.lit(1.0).alias("value"))
    if "major" in features.columns and not known.where(F.col("pos") == MINOR_POS).isEmpty():
        minor = A.minor_cells(sites, features).join(known.select("col_id", "gene"), "col_id")
        cells = cells.unionByName(minor.select("col_id", "gene", "sample", F.lit(1.0).alias("value")))
    return _scored(cells, alignments.select("sample", "gene").distinct(), weights, intercepts, hypothesis)


def _scored(cells: DataFrame, present: DataFrame, weights: DataFrame, intercepts: DataFrame, hypothesis: DataFrame | None) -> dict[str, DataFrame]:
    """From cells (col_id, gene, sample, value); present: (sample, gene) pairs."""
    by = [c for c in ("penalty_idx", "run") if c in weights.columns]
    part = cells.join(beside(weights.where("w <> 0").select(*by, "col_id", "w"), "weights"), "col_id").groupBy(*by, "sample", "gene").agg(F.sum(F.col("w") * F.col("value")).alias("_s"))
    every = present.crossJoin(F.broadcast(intercepts.select(*by)))  # runs x samples x genes: the result's shape
    gene_level = every.join(part, [*by, "sample", "gene"], "left").select(*by, "sample", "gene", F.coalesce("_s", F.lit(0.0)).alias("score"))
    sums = part.groupBy(*by, "sample").agg(F.sum("_s").alias("_s"))
    total = F.col("intercept") + F.coalesce("_s", F.lit(0.0))
    rows = present.select("sample").distinct().crossJoin(F.broadcast(intercepts.select(*by, "intercept")))  # runs x samples; a row per run
    predicted = rows.join(sums, [*by, "sample"], "left").select(*by, "sample", total.alias("prediction"))
    predicted = predicted.withColumns({"probability": sigmoid(F.col("prediction")), "class": F.when(F.col("prediction") > 0, 1).otherwise(-1)})
    out = {"predictions": predicted, "gene_scores": gene_level}
    if hypothesis is not None:
        met = predicted.join(hypothesis.where("y <> 0").select("sample", "y"), "sample")
        out |= {"predictions": met, "metrics": S.confusion(met, *by)}
    return out
