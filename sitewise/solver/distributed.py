"""Solving over Spark.

Grid tier: the sparse matrix is gathered once, checked against ``max_entries``,
broadcast, and every (run, penalties, fold) row of a grid is solved in its own
task. Column tier, beyond that bound: see :mod:`.sweep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Columns, Groups, Options, fit
from .sweep import SOLVED, Point, placed, solve_sweep


def numbered(samples: DataFrame) -> tuple[list, np.ndarray]:
    """Samples in order of ``ord`` with their responses (samples: a cohort, 10^2 to 10^4 rows)."""
    rows = samples.where("y <> 0").orderBy("ord").select("sample", "y").toPandas()
    return rows["sample"].tolist(), rows["y"].to_numpy(np.float64)


def gather(cells: DataFrame, samples: list, n: int, max_entries: int, dtype=np.float64) -> Columns:
    """The sparse matrix on the driver; ValueError beyond ``max_entries`` cells."""
    count = cells.count()
    if count > max_entries:
        raise ValueError(f"{count} cells exceed {max_entries}; use the column tier")
    table = placed(cells, samples).toArrow()
    col, row = (np.asarray(table.column(c), dtype=np.int64) for c in ("col_id", "row"))
    value = np.asarray(table.column("value"), dtype=np.float64) if "value" in table.column_names else None
    return Columns(len(samples), n, col, row, value, dtype)


def solve_grid(grid: DataFrame, matrix: Columns, y: np.ndarray, groups: dict[int, Groups], method: str, options: Options, folds: int = 0) -> DataFrame:
    """Sparse weights of every row of ``grid`` (run, penalty_idx, l1, l2); the intercept has col_id -1.

    ``groups`` by penalty_idx. With ``folds``, each row is also solved without each
    fold (sample i belongs to fold i mod folds); fold -1 is the whole.
    """
    spark = grid.sparkSession
    given = spark.sparkContext.broadcast((matrix, y, groups))
    settings = asdict(options)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, responses, by_term = given.value
        own = Options(**settings)
        for part in parts:
            for row in part.itertuples():
                m, z = (a, responses) if row.fold < 0 else (None, None)
                if m is None:
                    keep = np.flatnonzero(np.arange(len(responses)) % folds != row.fold)
                    m, z = a.rows(keep), responses[keep]
                found = fit(method, m, z, by_term[row.penalty_idx], row.l1, row.l2, own)
                at = np.flatnonzero(found.x)
                yield pd.DataFrame({"run": row.run, "fold": row.fold, "penalty_idx": row.penalty_idx, "col_id": np.append(at, -1), "w": np.append(found.x[at].astype(np.float64), found.intercept)})

    every = grid.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in (range(folds) if folds else (-1,))])))
    n = max(1, min(every.count(), 4 * spark.sparkContext.defaultParallelism))
    return every.repartition(n).mapInPandas(solve, SOLVED)


def solve_columns(cells: DataFrame, indexed: DataFrame, weights: DataFrame, samples: list, y: np.ndarray, l1: float, l2: float, logistic: bool = True,
                  options: Options | None = None, blocks: int | None = None, every: int = 10) -> tuple[DataFrame, float]:
    """One problem of disjoint groups on the column tier: (col_id, w), and the intercept.

    ``indexed``: (col_id, gene); ``weights``: (gene, weight), a row per gene.
    """
    genes = weights.orderBy("gene").collect()
    number = cells.sparkSession.createDataFrame([(r.gene, i) for i, r in enumerate(genes)], "gene string, atom int")
    atoms = indexed.join(F.broadcast(number), "gene").select("col_id", "atom")  # a row per gene
    n = (indexed.agg(F.max("col_id")).first()[0] or 0) + 1
    groups = Groups.ranges(np.ones(len(genes), int), np.array([r.weight for r in genes]))
    found = solve_sweep(cells, atoms, n, samples, y, [Point(0, -1, 0, l1, l2)], [groups], len(genes), 0, logistic, options, blocks, every)
    return found.where("col_id >= 0").select("col_id", "w"), found.where("col_id = -1").first().w
