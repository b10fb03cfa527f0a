"""Accelerated proximal gradient for sparse group lasso, on sparse columns.

The schedule is fixed: momentum (1 + sqrt(1 + 4a^2)) / 2, backtracking that lifts
the step constant to max(2L, l/r), and (by default) exactly ``max_iter`` steps
unless a step vanishes. Results are iterates of that schedule, not optima, so
the order of these rules is part of the contract.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

# Fixed values of the schedule: a step shorter than VANISHED ends it, SLACK passes the line search.
VANISHED = 0.1**20
SLACK = 0.1**12


class Columns:
    """A sparse matrix of m rows whose entries are sorted by column."""

    def __init__(self, m: int, n: int, col: np.ndarray, row: np.ndarray, value: np.ndarray | None = None, dtype=np.float64) -> None:
        order = np.lexsort((row, col))
        self.m, self.n, self.dtype = m, n, np.dtype(dtype)
        self.col, self.row = np.asarray(col)[order], np.asarray(row)[order]
        self.value = None if value is None else np.asarray(value, dtype)[order]
        self.start = np.searchsorted(self.col, np.arange(n + 1))

    def dot(self, x: np.ndarray) -> np.ndarray:
        v = x[self.col] if self.value is None else x[self.col] * self.value
        return np.bincount(self.row, weights=v, minlength=self.m).astype(self.dtype)

    def tdot(self, b: np.ndarray) -> np.ndarray:
        v = b[self.row] if self.value is None else b[self.row] * self.value
        sums = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        return (sums[self.start[1:]] - sums[self.start[:-1]]).astype(self.dtype)

    def rows(self, keep: np.ndarray) -> Columns:
        """The matrix of the rows in ``keep``."""
        place = np.full(self.m, -1)
        place[keep] = np.arange(len(keep))
        at = place[self.row] >= 0
        return Columns(len(keep), self.n, self.col[at], place[self.row[at]], None if self.value is None else self.value[at], self.dtype)


class Dense:
    """The same matrix as an array, for BLAS; worth its memory from a few per cent of non-zero cells.

    Single-precision products run over PART columns (or samples) at a time, and the parts' sums are added in double precision,
    so what rounding adds does not grow with the width of the matrix: results agree with :class:`Columns`, which sums in double, to about 1e-6.
    """

    PART = 4096

    def __init__(self, sparse: Columns) -> None:
        self.m, self.n, self.dtype = sparse.m, sparse.n, sparse.dtype
        self.a = np.zeros((self.n, self.m), self.dtype)
        self.a[sparse.col, sparse.row] = 1 if sparse.value is None else sparse.value

    def _parts(self, length: int) -> list[slice]:
        step = self.PART if self.dtype != np.float64 else max(1, length)
        return [slice(at, at + step) for at in range(0, length, step)]

    def dot(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(self.dtype, copy=False)
        out = np.zeros(self.m)
        for some in self._parts(self.n):
            out += x[some] @ self.a[some]
        return out.astype(self.dtype)

    def tdot(self, b: np.ndarray) -> np.ndarray:
        b = b.astype(self.dtype, copy=False)
        parts = self._parts(self.m)
        if len(parts) == 1:
            return self.a @ b
        out = np.zeros(self.n)
        for some in parts:
            out += self.a[:, some] @ b[some]
        return out.astype(self.dtype)


def stored(matrix: Columns, limit: int) -> Columns | Dense:
    """Dense if that takes at most ``limit`` bytes and 5 per cent of the cells are there."""
    if matrix.m * matrix.n * matrix.dtype.itemsize <= limit and len(matrix.col) >= 0.05 * matrix.m * matrix.n:
        return Dense(matrix)
    return matrix


@dataclass(frozen=True)
class Groups:
    """Groups of columns: ``members`` concatenated, group i at start[i]:start[i + 1]; disjoint if each column occurs once, in order."""

    members: np.ndarray
    start: np.ndarray
    weight: np.ndarray

    @classmethod
    def ranges(cls, lengths, weight) -> Groups:
        lengths = np.asarray(lengths, np.int64)
        return cls(np.arange(lengths.sum()), np.concatenate([[0], np.cumsum(lengths)]), np.asarray(weight, np.float64))

    @property
    def disjoint(self) -> bool:
        return len(self.members) == 0 or bool((np.diff(self.members) == 1).all() and self.members[0] == 0)

    def norms(self, x: np.ndarray, q: float = 2.0) -> np.ndarray:
        v = np.abs(x[self.members])
        if not len(v):
            return np.zeros(len(self.weight))
        sizes = np.diff(self.start)
        some = sizes > 0
        out = np.zeros(len(sizes))
        at = self.start[:-1][some]
        if q == 2.0:
            out[some] = np.sqrt(np.add.reduceat(v * v, at))
        elif q == 1.0:
            out[some] = np.add.reduceat(v, at)
        elif q >= 1e6:
            out[some] = np.maximum.reduceat(v, at)
        else:
            out[some] = np.add.reduceat(v**q, at) ** (1 / q)
        return out

    def spread(self, per_group: np.ndarray) -> np.ndarray:
        return np.repeat(per_group, np.diff(self.start))


@dataclass
class Options:
    """Solver settings; ratios: penalties are shares of their largest useful value."""

    max_iter: int = 100
    stop: int = 5
    tol: float = 1e-4
    ratios: bool = True
    intercept: bool = True
    slack: bool = True
    class_weights: tuple[float, float] | None = None
    ridge: float = 0.0
    q: float = 2.0
    inner_iter: int = 100
    inner_tol: float = 1e-4
    start_at_gradient: bool = False
    absolute: bool = False
    dense_bytes: int = 512 << 20
    lipschitz: float | None = None  # the first step constant; one that is large enough is never raised


@dataclass
class Fit:
    x: np.ndarray
    intercept: float
    objective: list[float] = field(default_factory=list)
    l1: float = 0.0
    l2: float = 0.0


def softened(v: np.ndarray, by: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0)


def shrink_groups(v: np.ndarray, groups: Groups, by: np.ndarray) -> np.ndarray:
    """Each group towards 0 by by[i] in its norm (disjoint groups); columns of no group stay."""
    norm = groups.norms(v)
    ratio = groups.spread(np.where(norm > by, (norm - by) / np.where(norm > 0, norm, 1), 0.0))
    if len(ratio) == len(v):
        return v * ratio
    out = v.copy()
    out[groups.members] *= ratio
    return out


def shrink_overlapping(u: np.ndarray, groups: Groups, by: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """argmin 1/2 |x - u|^2 + sum_i by[i] |x_Gi| for overlapping groups, through its dual.

    Dual: one vector y_i per group in the ball of radius by[i]; x = u - sum of the
    y_i. Accelerated projected ascent, step 1 / (largest number of groups that share a column), until
    the duality gap is under ``tol`` of the primal value. Groups that are zero at once (the part of u
    outside of other groups' reach under their radius) fall out by projection.
    """
    if not len(groups.members):
        return u.copy()
    share = np.bincount(groups.members, minlength=len(u))
    step = 1.0 / max(1, share.max())
    y = np.zeros(len(groups.members))
    ahead, t = y.copy(), 1.0

    def primal_of(dual: np.ndarray) -> np.ndarray:
        return u - np.bincount(groups.members, weights=dual, minlength=len(u))

    def project(dual: np.ndarray) -> np.ndarray:
        some = np.diff(groups.start) > 0
        norm = np.zeros(len(by))
        norm[some] = np.sqrt(np.add.reduceat(dual * dual, groups.start[:-1][some]))
        return dual * groups.spread(np.where(norm > by, by / np.where(norm > 0, norm, 1), 1.0))

    for _ in range(rounds):
        new = project(ahead + step * primal_of(ahead)[groups.members])
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - y)
        y, t = new, t_new
        x = primal_of(y)
        gap = float((by * groups.norms(x)).sum() - y @ x[groups.members])
        if gap <= tol * max(1e-12, 0.5 * float(((x - u) ** 2).sum()) + float((by * groups.norms(x)).sum())):
            break
    x = primal_of(y)
    x[np.abs(x) <= 1e-9 * max(1e-30, float(np.abs(u).max()))] = 0  # what the dual leaves of a group at 0
    return x


def shrink_q(v: np.ndarray, groups: Groups, by: float, q: float) -> np.ndarray:
    """Proximal step of by * sum |x_g|_q; q of 1, 2, infinity (1e6 or more), others by bisection."""
    if q == 1.0:
        return softened(v, by)
    if q == 2.0:
        return shrink_groups(v, groups, np.full(len(groups.weight), by))
    out = v.copy()
    for a, b in zip(groups.start[:-1], groups.start[1:], strict=True):
        out[a:b] = v[a:b] - _dual_ball(v[a:b], by, 1.0 if q >= 1e6 else q / (q - 1))
    return out


def _dual_ball(v: np.ndarray, radius: float, p: float) -> np.ndarray:
    """Projection of v on the ball of the p-norm (1 <= p < infinity)."""
    a = np.abs(v)
    if (a**p).sum() ** (1 / p) <= radius:
        return v.copy()
    if p == 1.0:
        s = np.sort(a)[::-1]
        over = np.flatnonzero(s - (np.cumsum(s) - radius) / np.arange(1, len(s) + 1) > 0)[-1]
        return softened(v, (s[: over + 1].sum() - radius) / (over + 1))

    def inner(mu: float) -> np.ndarray:  # solves x + mu * p * x^(p-1) = a
        low, high = np.zeros_like(a), a.copy()
        for _ in range(60):
            mid = (low + high) / 2
            over = mid + mu * p * mid ** (p - 1) > a
            high, low = np.where(over, mid, high), np.where(over, low, mid)
        return (low + high) / 2

    low, high = 0.0, 1.0
    while (inner(high) ** p).sum() > radius**p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (inner(mid) ** p).sum() > radius**p else (low, mid)
    return np.sign(v) * inner(high)


def sample_weights(y: np.ndarray, pair: tuple[float, float] | None) -> np.ndarray:
    """1/m each, or the two class weights scaled to a sum of 1."""
    if pair is None:
        return np.full(len(y), 1.0 / len(y))
    w = np.where(y > 0, pair[0], pair[1]).astype(np.float64)
    return w / w.sum()


def _logistic(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, a)


def accelerate(matrix: Columns | Dense, y: np.ndarray, logistic: bool, prox: Callable, penalty: Callable, o: Options, weights: np.ndarray,
               first: np.ndarray | None = None, lipschitz: float | None = None) -> Fit:
    """The shared loop. prox(v, L) solves the proximal step of the penalty over L; penalty(x) is its value."""
    m, n, kind = matrix.m, matrix.n, matrix.dtype
    x = np.zeros(n, kind) if first is None else first.astype(kind)
    ax = matrix.dot(x)
    share = float(weights[y > 0].sum())
    c = float(np.log(share / (1 - share))) if logistic and o.intercept and 0 < share < 1 else 0.0
    big = lipschitz if lipschitz is not None else (1.0 / m + o.ridge if logistic else 1.0 + o.ridge)
    back_x, back_ax, back_c = np.zeros(n, kind), ax.copy(), 0.0
    before, now = 0.0, 1.0
    target = None if logistic else matrix.tdot(y)
    values: list[float] = []
    for step in range(o.max_iter):
        beta = (before - 1) / now
        s, a_s, s_c = x + beta * back_x, ax + (ax - back_ax) * beta, c + beta * back_c
        if logistic:
            f_s = float(weights @ _logistic(-y * (a_s + s_c))) + o.ridge / 2 * float(s @ s)
            b = -weights * y / (1 + np.exp(np.clip(y * (a_s + s_c), -700, 700)))
            g_c = float(b.sum()) if o.intercept else 0.0
            g = matrix.tdot(b) + o.ridge * s
        else:
            g = matrix.tdot(a_s) - target + o.ridge * s
            f_s, g_c = 0.0, 0.0
        old_x, old_c = x, c
        back_ax = ax
        vanished = False
        while True:
            c = s_c - g_c / big
            x = prox(s - g / big, big).astype(kind)
            v = x - s
            ax = matrix.dot(x)
            if logistic:
                f_x = float(weights @ _logistic(-y * (ax + c))) + o.ridge / 2 * float(x @ x)
                r = (float(v @ v) + (c - s_c) ** 2) / 2
                left = f_x - f_s - float(v @ g) - (c - s_c) * g_c
            else:
                d = ax - a_s
                r, left = float(v @ v), float(d @ d) + o.ridge * float(v @ v)
            if r <= VANISHED:
                vanished = True
                break
            if left <= r * big or o.slack and abs(left - r * big) < SLACK:
                break
            big = max(2 * big, left / r)
        before, now = now, (1 + np.sqrt(1 + 4 * now * now)) / 2
        back_x, back_c = x - old_x, c - old_c
        ends = vanished or step == o.max_iter - 1
        if ends or step == 0 or o.stop <= 2:  # the objective, where someone looks at it
            loss = f_x if logistic else float(((ax - y) ** 2).sum()) / 2 + o.ridge / 2 * float(x @ x)
            values.append(loss + penalty(x))
        if ends or _stops(o, step, values, back_x, old_x):
            break
    return Fit(x, c if logistic else 0.0, values)


def _stops(o: Options, step: int, values: list[float], moved: np.ndarray, old: np.ndarray) -> bool:
    """0, 1: relative change of the objective (0 with ``absolute``: its change); 2: its value; 3: length of the step; 4: relative length; 5: never."""
    if o.stop in (0, 1) and step >= 1:
        change = abs(values[-1] - values[-2])
        return change <= o.tol * (1.0 if o.absolute and o.stop == 0 else values[-2])
    if o.stop == 2:
        return values[-1] <= o.tol
    if o.stop == 3:
        return float(np.linalg.norm(moved)) <= o.tol
    if o.stop == 4:
        return float(np.linalg.norm(moved)) <= o.tol * max(float(np.linalg.norm(old)), 1.0)
    return False


def scaled(matrix: Columns | Dense, y: np.ndarray, groups: Groups, l1: float, l2: float, logistic: bool, weights: np.ndarray, o: Options) -> tuple[float, float]:
    """Penalties from ratios: of the largest gradient at 0, and of the largest group norm left after the first."""
    if not o.ratios:
        return l1, l2
    if not (0 <= l1 <= 1 and 0 <= l2 <= 1):
        raise ValueError("penalty ratios lie in [0, 1]")
    share = float(weights[y > 0].sum())
    b = weights * np.where(y > 0, 1 - share, -share) if logistic else y
    return scaled_at(matrix.tdot(b), groups, l1, l2, o)


def scaled_at(zero: np.ndarray, groups: Groups, l1: float, l2: float, o: Options) -> tuple[float, float]:
    """The same from the gradient at 0."""
    if not o.ratios:
        return l1, l2
    if not (0 <= l1 <= 1 and 0 <= l2 <= 1):
        raise ValueError("penalty ratios lie in [0, 1]")
    grad = np.abs(zero)
    l1 = l1 * float(grad.max(initial=0.0))
    rest = np.maximum(grad - l1, 0)
    if groups.disjoint:
        return l1, l2 * float((groups.norms(rest) / groups.weight).max(initial=0.0))
    return l1, l2 * _overlap_max(softened(zero, l1), groups, o)


def group_scaled(zero: np.ndarray, groups: Groups, l1: float, o: Options) -> float:
    """The penalty of group norms alone from its ratio, by the gradient at 0."""
    dual = 1e6 if o.q == 1 else 1.0 if o.q >= 1e6 else o.q / (o.q - 1)
    return l1 * float(groups.norms(zero, dual).max(initial=0.0)) if o.ratios else l1


def proximal(groups: Groups, a: float, b: float, overlap: bool, o: Options) -> tuple[Callable, Callable]:
    """The proximal step of a |x| + b sum of weighted group norms, and its value."""
    def prox(v: np.ndarray, big: float) -> np.ndarray:
        u = softened(v, a / big)
        if overlap and not groups.disjoint:
            return shrink_overlapping(u, groups, b / big * groups.weight, o.inner_iter, o.inner_tol)
        return shrink_groups(u, groups, b / big * groups.weight)

    return prox, lambda x: a * float(np.abs(x).sum()) + b * float((groups.weight * groups.norms(x)).sum())


def _overlap_max(u: np.ndarray, groups: Groups, o: Options) -> float:
    """Smallest group penalty that makes the overlapping step vanish: doubling, then bisection to 1e-4."""
    zero = lambda l2: not shrink_overlapping(u, groups, l2 * groups.weight, o.inner_iter, o.inner_tol).any()
    low, high = 0.0, 1.0
    while not zero(high):
        low, high = high, 2 * high
    while high - low >= 1e-4:
        mid = (low + high) / 2
        low, high = (low, mid) if zero(mid) else (mid, high)
    return high


def _sparse_group(logistic: bool, overlap: bool):
    def fit(matrix: Columns, y: np.ndarray, groups: Groups, l1: float, l2: float, o: Options) -> Fit:
        y = np.asarray(y, np.float64)
        weights = sample_weights(y, o.class_weights if logistic else None)
        a, b = scaled(matrix, y, groups, l1, l2, logistic, weights, o)

        prox, penalty = proximal(groups, a, b, overlap, o)
        first = matrix.tdot(y) if overlap and not logistic and o.start_at_gradient else None
        found = accelerate(matrix, y, logistic, prox, penalty, o, weights, first, o.lipschitz)
        found.l1, found.l2 = a, b
        return found

    return fit


def _group_logistic(matrix: Columns, y: np.ndarray, groups: Groups, l1: float, l2: float, o: Options) -> Fit:
    """Logistic loss with l1 * sum |x_g|_q; the second penalty and group weights play no part."""
    y = np.asarray(y, np.float64)
    weights = sample_weights(y, o.class_weights)
    o = replace(o, absolute=True)
    share = float(weights[y > 0].sum())
    by = group_scaled(matrix.tdot(weights * np.where(y > 0, 1 - share, -share)), groups, l1, o)
    found = accelerate(matrix, y, True, lambda v, big: shrink_q(v, groups, by / big, o.q), lambda x: by * float(groups.norms(x, o.q).sum()), o, weights, None, o.lipschitz)
    found.l1 = by
    return found


#: Methods by name (fixed values of the command-line interface).
METHODS: dict[str, Callable] = {
    "sg_lasso": _sparse_group(True, False),
    "sg_lasso_leastr": _sparse_group(False, False),
    "olsg_lasso_leastr": _sparse_group(False, True),
    "olsg_lasso_logisticr": _sparse_group(True, True),
    "gl_logisticr": _group_logistic,
}


def fit(method: str, matrix: Columns, y, groups: Groups, l1: float, l2: float, options: Options | None = None) -> Fit:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    options = options or Options(tol=1e-3 if method == "gl_logisticr" else 1e-4)
    return METHODS[method](stored(matrix, options.dense_bytes), np.asarray(y, np.float64), groups, l1, l2, options)
