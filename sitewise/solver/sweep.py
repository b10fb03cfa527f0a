"""The column tier: all folds, penalty terms and grid points of a problem in one sweep over columns that are spread over the cluster.

Columns are dealt to blocks of bounded size by their number, so a gene may lie in many blocks. A block holds its part of the
iterates as a matrix, a column per (term, grid point, fold); an iteration of all of them is one pass over the blocks, and
what it sends is m sums and a few numbers per right-hand side. The schedule is the kernel's, kept apart per right-hand side
(step constants, line search, stopping), so results agree to rounding.

Group norms have two levels: partial sums of squares per (gene, block) are shuffled by gene, and the factor by which a gene
shrinks is joined back to its blocks. Only genes in more than one block need that; with blocks of consecutive columns those
are fewer than the blocks. Overlapping groups are unions of genes (or of classes of columns that lie in the same groups: atoms). The
columns of an atom shrink by one factor, as the penalty sees only the atoms' norms, so the proximal step of n columns is the same step on one
number per atom: norms come to the driver, a number per atom and right-hand side, and factors go back.

What the driver holds: m x right-hand sides, and norms of split genes (all atoms for overlapping groups). ``at_once`` bounds the right-hand sides of
a sweep, and so the memory of a block; more of them make further sweeps. State goes to the checkpoint folder every ``every`` iterations.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settled
from .kernel import SLACK, VANISHED, Columns, Dense, Groups, Options, _overlap_max, sample_weights, shrink_overlapping, softened, stored

SOLVED = "run int, fold int, penalty_idx int, col_id long, w double"
BLOCK_CELLS = 8_000_000


@dataclass(frozen=True)
class Point:
    """A right-hand side: its penalties are ratios (or values); fold -1 is the whole cohort."""

    run: int
    fold: int
    penalty_idx: int
    l1: float
    l2: float


def placed(cells: DataFrame, samples: list) -> DataFrame:
    """(col_id, row, and value if there is one) of the cells of ``samples``; a sample that is named more than once has several rows."""
    fields = T.StructType([cells.schema["sample"], T.StructField("row", T.IntegerType())])
    place = cells.sparkSession.createDataFrame(list(zip(samples, range(len(samples)), strict=True)), fields)
    return cells.join(F.broadcast(place), "sample").select("col_id", "row", *(["value"] if "value" in cells.columns else []))  # the cohort


class _Block:
    """Columns sorted by atom, their part of the matrix and of the iterates, and of the iterates' last moves."""

    def __init__(self, cols: np.ndarray, of: np.ndarray, matrix: Columns | Dense) -> None:
        self.cols, self.matrix = cols, matrix
        self.starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        self.atoms = of[self.starts]
        self.of = np.repeat(np.arange(len(self.atoms)), np.diff(np.append(self.starts, len(of))))
        self.x = self.moved = np.zeros((len(cols), 0))

    def at(self, x: np.ndarray, moved: np.ndarray) -> _Block:
        new = object.__new__(_Block)
        new.__dict__ |= self.__dict__ | {"x": x, "moved": moved}
        return new

    def tdot(self, b: np.ndarray) -> np.ndarray:
        return self.matrix.a @ b if isinstance(self.matrix, Dense) else np.stack([self.matrix.tdot(c) for c in b.T], 1)

    def dot(self, x: np.ndarray) -> np.ndarray:
        return self.matrix.a.T @ x if isinstance(self.matrix, Dense) else np.stack([self.matrix.dot(c) for c in x.T], 1)

    def squares(self, u: np.ndarray) -> np.ndarray:
        """Sums of squares per atom."""
        return np.add.reduceat(u * u, self.starts, axis=0)


def blocks_of(cells: DataFrame, atoms: DataFrame, n: int, samples: list, least: int, dense_bytes: int) -> RDD:
    """The blocks; ``atoms``: (col_id, atom), of every column, -1 for one of no group."""
    m = len(samples)
    width = max(1, min(-(-n // least), BLOCK_CELLS // max(1, m)))
    rows = atoms.join(placed(cells, samples), "col_id", "left").withColumn("block", F.floor(F.col("col_id") / width))

    def build(table: pa.Table) -> pa.Table:
        atom, col = (np.asarray(table.column(c)) for c in ("atom", "col_id"))
        order = np.lexsort((col, atom))
        atom, col = atom[order], col[order]
        first = np.concatenate([[True], col[1:] != col[:-1]])
        row = np.asarray(table.column("row").fill_null(-1))[order]
        some = row >= 0
        value = np.asarray(table.column("value").fill_null(0), dtype=np.float64)[order][some] if "value" in table.column_names else None
        matrix = Columns(m, int(first.sum()), (np.cumsum(first) - 1)[some], row[some], value)
        block = _Block(col[first], atom[first], stored(matrix, dense_bytes))
        return pa.table({"block": pa.array([pickle.dumps(block, 5)], pa.binary())})

    # imperative state per block: the one place that needs RDDs
    return rows.groupBy("block").applyInArrow(build, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


class _Shares:
    """The cohort as each right-hand side sees it: sample weights (0 outside of its fold's training set), and starts."""

    def __init__(self, y: np.ndarray, points: list[Point], folds: int, logistic: bool, o: Options) -> None:
        kept = np.stack([np.ones(len(y), bool) if p.fold < 0 else np.arange(len(y)) % folds != p.fold for p in points], 1)
        self.m = kept.sum(0)
        self.weights = kept.astype(np.float64)
        if logistic:
            for r in range(len(points)):
                self.weights[kept[:, r], r] = sample_weights(y[kept[:, r]], o.class_weights)
        share = (self.weights * (y > 0)[:, None]).sum(0)
        self.response = self.weights * (np.where(y[:, None] > 0, 1 - share, -share) if logistic else y[:, None])
        inside = (share > 0) & (share < 1)
        odds = np.where(inside, share / np.where(inside, 1 - share, 1), 1)
        self.intercept = np.log(odds) if logistic and o.intercept else np.zeros(len(points))


class Sweep:
    """One sweep: at most ``at_once`` right-hand sides over the blocks."""

    def __init__(self, state: RDD, y: np.ndarray, points: list[Point], terms: list[Groups], atoms: int, folds: int, logistic: bool, o: Options, every: int) -> None:
        self.state, self.y, self.points, self.o, self.logistic, self.every = state, y, points, o, logistic, every
        self.shares = _Shares(y, points, folds, logistic, o)
        self.groups = [terms[p.penalty_idx] for p in points]
        # the usual case: group i is atom i
        self.simple = all(len(g.members) == atoms and (g.members == np.arange(atoms)).all() and (np.diff(g.start) == 1).all() for g in terms)
        self.weight = np.stack([g.weight for g in self.groups], 1) if self.simple else None
        if self.simple:
            self.shared = np.array(sorted(state.flatMap(lambda k: [(int(a), 1) for a in k.atoms if a >= 0]).reduceByKey(lambda a, b: a + b).filter(lambda x: x[1] > 1).keys().collect()), np.int64)  # fewer than blocks
        else:
            self.shared = np.arange(atoms)
        self.l1, self.l2 = self._scaled()

    def _norms(self, state: RDD, u: Callable[[_Block], np.ndarray]) -> np.ndarray:
        """Norms of u per shared atom and right-hand side, summed over blocks by atom."""
        out = np.zeros((len(self.shared), len(self.points)))
        if len(self.shared):
            shared = self.shared

            def parts(k: _Block) -> Iterator[tuple[int, np.ndarray]]:
                some = np.flatnonzero(np.isin(k.atoms, shared))
                if len(some):
                    squares = k.squares(u(k))
                    yield from ((int(k.atoms[i]), squares[i]) for i in some)

            for atom, squares in state.flatMap(parts).reduceByKey(np.add).collect():
                out[np.searchsorted(shared, atom)] = squares
        return np.sqrt(out)

    def _step(self, norms: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Norms of the shared atoms after the group step; by: l2 over the step constant, per right-hand side."""
        if self.simple:
            return np.maximum(norms - self.weight[self.shared] * by, 0)
        out = np.empty_like(norms)
        for r, g in enumerate(self.groups):
            if len(np.unique(g.members)) == len(g.members):
                size = g.norms(norms[:, r])
                out[:, r] = norms[:, r]
                out[g.members, r] *= g.spread(np.maximum(1 - by[r] * g.weight / np.where(size > 0, size, np.inf), 0) * (size > 0))
            else:
                out[:, r] = shrink_overlapping(norms[:, r], g, by[r] * g.weight, self.o.inner_iter, self.o.inner_tol)
        return np.maximum(out, 0)

    def _scaled(self) -> tuple[np.ndarray, np.ndarray]:
        l1, l2 = (np.array([getattr(p, k) for p in self.points], np.float64) for k in ("l1", "l2"))
        if not self.o.ratios:
            return l1, l2
        if ((l1 < 0) | (l1 > 1) | (l2 < 0) | (l2 > 1)).any():
            raise ValueError("penalty ratios lie in [0, 1]")
        b = self.shares.response
        zero = np.zeros(len(l1))
        l1 = l1 * self.state.map(lambda k: np.abs(k.tdot(b)).max(axis=0, initial=0.0)).fold(zero, np.maximum)
        left = lambda k: softened(k.tdot(b), l1)
        norms = self._norms(self.state, left)
        if self.simple:
            weight, shared = self.weight, self.shared

            def local(k: _Block) -> np.ndarray:
                own = (k.atoms >= 0) & ~np.isin(k.atoms, shared)
                return (np.sqrt(k.squares(left(k)))[own] / weight[k.atoms[own]]).max(axis=0, initial=0.0)

            most = np.maximum(self.state.map(local).fold(zero, np.maximum), (norms / weight[shared]).max(axis=0, initial=0.0))
        else:
            disjoint = [len(np.unique(g.members)) == len(g.members) for g in self.groups]
            most = np.array([float((g.norms(norms[:, r]) / g.weight).max(initial=0.0)) if disjoint[r] else _overlap_max(norms[:, r], g, self.o) for r, g in enumerate(self.groups)])
        return l1, l2 * most

    def _penalty(self, norms: np.ndarray) -> np.ndarray:
        """What the shared atoms' norms add to the objective."""
        if self.simple:
            return self.l2 * (self.weight[self.shared] * norms).sum(0)
        return self.l2 * np.array([float((g.weight * g.norms(norms[:, r])).sum()) for r, g in enumerate(self.groups)])

    def run(self) -> tuple[RDD, np.ndarray]:
        """The last state, blocks first, and the intercepts."""
        o, y, w, logistic, count = self.o, self.y[:, None], self.shares.weights, self.logistic, len(self.points)
        l1, l2, ridge, weight, shared, simple = self.l1, self.l2, o.ridge, self.weight, self.shared, self.simple
        loss = lambda a, c: (w * np.logaddexp(0, -y * (a + c))).sum(0) if logistic else (w * (a - y) ** 2).sum(0) / 2
        started = o.start_at_gradient and not simple and not logistic
        b0 = self.shares.response
        none = np.zeros((len(y), count)), np.zeros((7, count))
        state = self.state.map(lambda k: (k.at(k.tdot(b0) if started else np.zeros((len(k.cols), count)), np.zeros((len(k.cols), count))),)).persist()
        ax = state.map(lambda t: t[0].dot(t[0].x)).treeAggregate(none[0], np.add, np.add) if started else none[0]
        c, big = self.shares.intercept.copy(), (1.0 / self.shares.m if logistic else np.ones(count)) + ridge if o.lipschitz is None else np.full(count, o.lipschitz)
        back_ax, back_c, active = ax.copy(), np.zeros(count), np.ones(count, bool)
        before, now, last = 0.0, 1.0, np.full(count, np.nan)
        for step in range(o.max_iter):
            beta = (before - 1) / now
            a_s, s_c = ax + (ax - back_ax) * beta, c + beta * back_c
            b = -w * y / (1 + np.exp(np.clip(y * (a_s + s_c), -700, 700))) if logistic else w * (a_s - y)
            g_c = b.sum(0) if logistic and o.intercept else np.zeros(count)
            f_s = loss(a_s, s_c)
            while True:
                def moved_to(k: _Block, b=b, beta=beta, big=big.copy()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    s = k.x + beta * k.moved
                    g = k.tdot(b) + ridge * s
                    return s, g, softened(s - g / big, l1 / big)

                norms = self._norms(state.map(_block), lambda k, moved_to=moved_to: moved_to(k)[2])
                left_norms = self._step(norms, l2 / big)
                factors = np.divide(left_norms, norms, out=np.zeros_like(norms), where=norms > 0)

                def trial(held: tuple, moved_to=moved_to, factors=factors, big=big.copy(), active=active.copy()) -> tuple[_Block, np.ndarray, np.ndarray]:
                    k = held[0]
                    s, g, u = moved_to(k)
                    factor = np.ones((len(k.atoms), count))
                    place = np.searchsorted(shared, k.atoms)
                    common = (place < len(shared)) & (k.atoms >= 0)
                    common[common] = shared[place[common]] == k.atoms[common]
                    factor[common] = factors[place[common]]
                    own, group = (k.atoms >= 0) & ~common, np.zeros(count)
                    if own.any():  # only where group i is atom i
                        norm, by = np.sqrt(k.squares(u))[own], weight[k.atoms[own]] * (l2 / big)
                        kept = np.maximum(norm - by, 0)
                        factor[own] = np.divide(kept, norm, out=np.zeros_like(norm), where=norm > 0)
                        group = l2 * (weight[k.atoms[own]] * kept).sum(0)
                    x = np.where(active, u * factor[k.of], k.x)
                    v, step_to = x - s, x - k.x
                    sums = np.stack([(v * v).sum(0), (v * g).sum(0), l1 * np.abs(x).sum(0) + group, (s * s).sum(0), (x * x).sum(0), (step_to * step_to).sum(0), (k.x * k.x).sum(0)])
                    return k.at(x, step_to), k.dot(x), sums

                tried = state.map(trial).persist()
                if (step + 1) % self.every == 0:
                    tried.checkpoint()
                new_ax, sums = tried.map(lambda t: t[1:]).treeAggregate(none, _add, _add)
                vv, vg, penalty, ss, xx, mm, oo = sums
                new_c = np.where(active, s_c - g_c / big, c)
                f_x = loss(new_ax, new_c)
                if logistic:
                    r = (vv + (new_c - s_c) ** 2) / 2
                    left = f_x + ridge / 2 * xx - f_s - ridge / 2 * ss - vg - (new_c - s_c) * g_c
                else:
                    r, left = vv, (w * (new_ax - a_s) ** 2).sum(0) + ridge * vv
                good = ~active | (r <= VANISHED) | (left <= r * big) | (o.slack & (np.abs(left - r * big) < SLACK))
                if good.all():
                    break
                tried.unpersist()
                big = np.where(good, big, np.maximum(2 * big, left / np.where(good, 1, r)))
            state.unpersist()
            state = tried
            back_ax, back_c = ax, np.where(active, new_c - c, 0.0)
            ax, c = new_ax, new_c
            before, now = now, (1 + np.sqrt(1 + 4 * now * now)) / 2
            value = f_x + ridge / 2 * xx + penalty + self._penalty(left_norms)
            active = active & ~((r <= VANISHED) | _ended(o, step, value, last, mm, oo))
            last = value
            if not active.any():
                break
        return state, c


def _block(held: tuple) -> _Block:
    return held[0]


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _ended(o: Options, step: int, value: np.ndarray, last: np.ndarray, moved: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Which right-hand sides stop here, by the kernel's rules."""
    if o.stop in (0, 1) and step >= 1:
        return np.abs(value - last) <= o.tol * (1.0 if o.absolute and o.stop == 0 else last)
    if o.stop == 2:
        return value <= o.tol
    if o.stop == 3:
        return np.sqrt(moved) <= o.tol
    if o.stop == 4:
        return np.sqrt(moved) <= o.tol * np.maximum(np.sqrt(old), 1.0)
    return np.zeros(len(value), bool)


def solve_sweep(cells: DataFrame, atoms: DataFrame, n: int, samples: list, y: np.ndarray, points: list[Point], terms: list[Groups], n_atoms: int, folds: int = 0, logistic: bool = True,
                options: Options | None = None, blocks: int | None = None, every: int = 10, at_once: int = 32) -> DataFrame:
    """Sparse weights (run, fold, penalty_idx, col_id, w) of every point; the intercept has col_id -1.

    ``cells`` (col_id, sample, optionally value); ``atoms`` (col_id, atom) of all n columns; ``terms``: groups of atoms with
    their weights, by penalty_idx.
    """
    spark = cells.sparkSession
    sc, o = spark.sparkContext, options or Options()
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sitewise-"))
    state = blocks_of(cells, atoms, n, samples, blocks or sc.defaultParallelism, o.dense_bytes).persist()
    out = spark.createDataFrame([], SOLVED)
    try:
        for at in range(0, len(points), at_once):
            some = points[at : at + at_once]
            solved, intercepts = Sweep(state, np.asarray(y, np.float64), some, terms, n_atoms, folds, logistic, o, every).run()
            keys = [(p.run, p.fold, p.penalty_idx) for p in some]
            found = solved.map(_block).flatMap(lambda k, keys=keys: ((*keys[r], int(k.cols[i]), float(k.x[i, r])) for i, r in zip(*np.nonzero(k.x), strict=True)))
            weights = settled(spark.createDataFrame(found, SOLVED), "weights")
            solved.unpersist()
            out = out.unionByName(weights).unionByName(spark.createDataFrame([(*k, -1, float(c)) for k, c in zip(keys, intercepts, strict=True)], SOLVED))
    finally:
        state.unpersist()
    return out
