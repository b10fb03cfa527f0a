"""The row tier: cohorts of many samples and fewer columns than samples.

Samples are dealt to blocks; nothing that has a number per sample comes to the driver. Samples of one response, fold and set of
columns are one row with a count. The iterates (a number per column and right-hand side) stay on the driver, which runs the kernel's schedule
for all right-hand sides side by side: each asks for losses and a gradient, one pass over the blocks answers all of them, and a
task sends one sum per column and right-hand side. A pass tries the new iterate and works out the gradient at the point that
follows if it holds, so a step takes a pass, and one more per failed trial. Sums are in double precision and in order of partitions.

Results agree with the kernel's to rounding.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .kernel import SLACK, VANISHED, Columns, Dense, Fit, Groups, Options, _stops, group_scaled, proximal, scaled_at, shrink_q, stored
from .sweep import SOLVED, Point

DENSE_BYTES = 64 << 20


def cohort(hypothesis: DataFrame) -> DataFrame:
    """(sample, row, y): samples with a response, numbered in order of ``ord`` (ties by sample); with ``copies``, so many rows each."""
    some = hypothesis.where("y <> 0").repartitionByRange("ord", "sample").sortWithinPartitions("ord", "sample")
    if "copies" in hypothesis.columns:
        some = some.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    held = settled(some.select("sample", F.col("y").cast("double").alias("y"), F.monotonically_increasing_id().alias("_at")), "cohort")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())  # a row per partition
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    first = held.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "_part long, _first long")
    return held.join(F.broadcast(first), "_part").select("sample", (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("row"), "y")


def _packed(cells: DataFrame, people: DataFrame, folds: int) -> DataFrame:
    """(y, fold, times, cols, and values if there are some) of the samples, equal ones together."""
    valued = "value" in cells.columns
    per_sample = [F.collect_list(F.struct("col_id", F.col("value").cast("double").alias("value"))).alias("_own")] if valued else [F.array_sort(F.collect_list("col_id")).alias("cols")]
    own = cells.groupBy("sample").agg(*per_sample)  # a sample's columns, fewer than samples
    met = people.select("sample", "y", F.pmod("row", F.lit(max(1, folds))).cast("int").alias("fold")).join(own, "sample", "left")
    if valued:
        return met.select("y", "fold", F.lit(1.0).alias("times"), F.col("_own.col_id").alias("cols"), F.col("_own.value").alias("vals"))
    return met.groupBy("y", "fold", "cols").agg(F.count(F.lit(1)).cast("double").alias("times")).select("y", "fold", "times", "cols")


def _build(n: int, dense_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold, times = (np.asarray(batch.column(i)) for i in range(3))
            cols = batch.column(3)
            col = np.asarray(cols.flatten(), dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(cols.value_lengths().fill_null(0)))
            value = np.asarray(batch.column(4).flatten(), dtype=np.float64) if batch.num_columns > 4 else None
            matrix = stored(Columns(batch.num_rows, n, col, row, value), dense_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((matrix, y, fold, times), 5)], pa.binary())], names=["block"])

    return run


def _dot(matrix: Columns | Dense, x: np.ndarray) -> np.ndarray:
    return matrix.a.T @ x if isinstance(matrix, Dense) else np.stack([matrix.dot(c) for c in x.T], 1)


def _tdot(matrix: Columns | Dense, b: np.ndarray) -> np.ndarray:
    return matrix.a @ b if isinstance(matrix, Dense) else np.stack([matrix.tdot(c) for c in b.T], 1)


class Rows:
    """A problem's blocks of samples, and its numbers of samples by fold."""

    def __init__(self, cells: DataFrame, people: DataFrame, n: int, folds: int = 0) -> None:
        self.spark, self.n, self.folds = cells.sparkSession, n, folds
        packed = _packed(cells, people, folds)
        table = settled(packed.repartition(2 * self.spark.sparkContext.defaultParallelism).mapInArrow(_build(n, DENSE_BYTES), "block binary"), "blocks")
        self.blocks = table.rdd.map(lambda r: bytes(r[0])).persist()  # lost ones are read again
        fold = F.pmod("row", F.lit(max(1, folds))).cast("int")
        sums = people.groupBy(fold.alias("fold"), (F.col("y") > 0).alias("positive")).count().collect()  # two rows per fold
        self.sizes = {(r.fold, r.positive): r["count"] for r in sums}

    def release(self) -> None:
        self.blocks.unpersist()

    def _summed(self, one: Callable) -> list[np.ndarray]:
        """Sums over the blocks of the arrays that ``one`` gives for each."""
        def run(blocks: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
            total = None
            for raw in blocks:
                found = one(*pickle.loads(raw))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            if total is not None:
                yield total

        total = None
        for found in self.blocks.mapPartitions(run).collect():  # a row per task, in order of partitions
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        return total

    def _shares(self, points: list[Point], logistic: bool, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per right-hand side: samples, the weights of a negative and of a positive one, and the positives' share."""
        count = lambda p, positive: sum(k for (f, s), k in self.sizes.items() if s == positive and f != p.fold)
        minus, plus = (np.array([count(p, s) for p in points], np.float64) for s in (False, True))
        m = minus + plus
        if not logistic:
            return m, np.ones(len(m)), np.ones(len(m)), plus
        w_plus, w_minus = (1.0, 1.0) if o.class_weights is None else o.class_weights
        whole = minus * w_minus + plus * w_plus
        return m, w_minus / whole, w_plus / whole, plus * w_plus / whole

    def solve(self, points: list[Point], terms: list[Groups], method: str, options: Options | None = None) -> DataFrame:
        """Sparse weights (run, fold, penalty_idx, col_id, w) of every point; the intercept has col_id -1. ``terms``: groups by penalty_idx."""
        o = options or Options(tol=1e-3 if method == "gl_logisticr" else 1e-4)
        at_once = max(1, min(32, 2_000_000 // max(1, self.n)))
        found = []
        for at in range(0, len(points), at_once):
            some = points[at : at + at_once]
            for p, fit in zip(some, self._fits(some, terms, method, o), strict=True):
                key = (p.run, p.fold, p.penalty_idx)
                found += [(*key, int(i), float(fit.x[i])) for i in np.flatnonzero(fit.x)] + [(*key, -1, float(fit.intercept))]
        return self.spark.createDataFrame(found, SOLVED)

    def _fits(self, points: list[Point], terms: list[Groups], method: str, o: Options) -> list[Fit]:
        logistic = not method.endswith("leastr")
        m, minus, plus, share = self._shares(points, logistic, o)
        fold = np.array([p.fold for p in points])

        def weights(y, folds, times, at):
            return times[:, None] * np.where(y[:, None] > 0, plus[at], minus[at]) * (folds[:, None] != fold[at])

        def response(matrix, y, folds, times):
            b = np.where(y[:, None] > 0, 1 - share, -share) if logistic else y[:, None]
            return [_tdot(matrix, weights(y, folds, times, slice(None)) * b)]

        (zero,) = self._summed(response) if self.n and m.any() else (np.zeros((self.n, len(points))),)
        steps = [_steps(zero[:, r], m[r], share[r], terms[p.penalty_idx], p, method, logistic, o) for r, p in enumerate(points)]
        done: dict[int, Fit] = {}
        asked: dict[int, tuple] = {}

        def move(r: int, told: tuple | None) -> None:
            try:
                asked[r] = steps[r].send(told)
            except StopIteration as end:
                done[r] = end.value
                asked.pop(r, None)

        for r in range(len(points)):
            move(r, None)
        while asked:
            own = np.array(sorted(asked))
            x, v, s = (np.stack([asked[r][k] for r in own], 1) for k in range(3))
            c, s_c = (np.array([asked[r][k] for r in own]) for k in (3, 4))

            def answer(matrix, y, folds, times, own=own, x=x, v=v, s=s, c=c, s_c=s_c):
                w, y = weights(y, folds, times, own), y[:, None]
                if not logistic:
                    a_s = _dot(matrix, s)
                    return [(w * (_dot(matrix, x) - y) ** 2).sum(0) / 2, (w * _dot(matrix, v) ** 2).sum(0), _tdot(matrix, w * (a_s - y)), np.zeros(len(own))]
                z_x, z_s = -y * (_dot(matrix, x) + c), -y * (_dot(matrix, s) + s_c)
                b = -w * y / (1 + np.exp(np.clip(-z_s, -700, 700)))
                return [(w * np.logaddexp(0.0, z_x)).sum(0), (w * np.logaddexp(0.0, z_s)).sum(0), _tdot(matrix, b), b.sum(0)]

            told = self._summed(answer)
            for k, r in enumerate(own):
                move(int(r), (float(told[0][k]), float(told[1][k]), told[2][:, k], float(told[3][k])))
        return [done[r] for r in range(len(points))]


def _steps(zero: np.ndarray, m: float, share: float, groups: Groups, p: Point, method: str, logistic: bool, o: Options) -> Generator:
    """The kernel's loop. Asks for (x, v, s, c, s_c); is told the loss at (x, c), the loss at (s, s_c) (least squares: |Av|^2), and the gradient at (s, s_c)."""
    if method == "gl_logisticr":
        o = replace(o, absolute=True)
        by, a, b = group_scaled(zero, groups, p.l1, o), 0.0, 0.0
        prox, penalty, a = (lambda u, big: shrink_q(u, groups, by / big, o.q)), (lambda x: by * float(groups.norms(x, o.q).sum())), by
    else:
        a, b = scaled_at(zero, groups, p.l1, p.l2, o)
        prox, penalty = proximal(groups, a, b, method.startswith("ol"), o)
    x = zero.copy() if method == "olsg_lasso_leastr" and o.start_at_gradient else np.zeros(len(zero))
    c = float(np.log(share / (1 - share))) if logistic and o.intercept and 0 < share < 1 else 0.0
    big = o.lipschitz if o.lipschitz is not None else (1.0 / m + o.ridge if logistic else 1.0 + o.ridge)
    now, s, s_c, values = 1.0, x, c, []
    _, f_s, g, g_c = yield x, np.zeros(len(x)), s, c, s_c
    for step in range(o.max_iter):
        f_s, g, g_c = f_s + o.ridge / 2 * float(s @ s), g + o.ridge * s, g_c if logistic and o.intercept else 0.0
        old_x, old_c, after = x, c, (1 + np.sqrt(1 + 4 * now * now)) / 2
        beta = (now - 1) / after
        while True:
            c, x = s_c - g_c / big, prox(s - g / big, big)
            v = x - s
            next_s, next_c = x + beta * (x - old_x), c + beta * (c - old_c)
            loss, other, next_g, next_g_c = yield x, v, next_s, c, next_c
            f_x = loss + o.ridge / 2 * float(x @ x)
            if logistic:
                r = (float(v @ v) + (c - s_c) ** 2) / 2
                left = f_x - f_s - float(v @ g) - (c - s_c) * g_c
            else:
                r = float(v @ v)
                left = other + o.ridge * r
            if r <= VANISHED or left <= r * big or o.slack and abs(left - r * big) < SLACK:
                break
            big = max(2 * big, left / r)
        values.append(f_x + penalty(x))
        if r <= VANISHED or _stops(o, step, values, x - old_x, old_x):
            break
        now, s, s_c, f_s, g, g_c = after, next_s, next_c, other, next_g, next_g_c
    return Fit(x, c if logistic else 0.0, values, a, b)
