"""Penalty grids and group terms (driver side: a few hundred numbers)."""

from __future__ import annotations

import math
from statistics import median


def round_to(x: float, digits: int) -> float:
    scale = 10.0**digits
    return math.floor(x * scale + 0.5) / scale if x >= 0 else -math.floor(-x * scale + 0.5) / scale


def linear_space(first: float, last: float, step: float) -> list[float]:
    """first, first + step, ... up to last (tolerance 1e-12), each rounded to 6 places."""
    if step <= 0:
        raise ValueError("the step must be positive")
    out, v = [], first
    while v <= last + 1e-12:
        out.append(round_to(v, 6))
        v += step
    return out


def six_digits(v: float) -> float:
    """Six significant digits: grids are stored as text with that precision and read back."""
    return float(f"{v:.6g}")


def check_ratio(v: float) -> float:
    if not 0 < v < 1:
        raise ValueError(f"penalty ratios lie strictly between 0 and 1, not {v}")
    return v


def sweep(first: float, last: float, step: float, logspace: bool = False) -> list[float]:
    """One axis of a grid, by accumulated steps.

    In log space, the values under ``last`` are replaced by as many points with a
    constant ratio between the smallest and the largest of them.
    """
    if step <= 0:
        raise ValueError("the step must be positive")
    out, v = [], first
    while v <= last + step * 1e-9:
        out.append(check_ratio(v))
        v += step
    if logspace:
        out = [x for x in out if x < last]
        if len(out) >= 2:
            out = [out[0] * (out[-1] / out[0]) ** (i / (len(out) - 1)) for i in range(len(out))]
    return out


def lambda_grid(first: tuple[float, float, float], second: tuple[float, float, float], logspace: bool = False) -> list[tuple[int, float, float]]:
    """(idx, l1, l2), the first axis outermost."""
    pairs = [(six_digits(a), six_digits(b)) for a in sweep(*first, logspace) for b in sweep(*second, logspace)]
    return [(i, a, b) for i, (a, b) in enumerate(pairs)]


def parse_lambda_file(text: str) -> list[tuple[int, float, float]]:
    """Two numbers a line; # starts a comment; an error if none are left."""
    rows = [line.split("#")[0].split() for line in text.splitlines()]
    pairs = [(check_ratio(float(r[0])), check_ratio(float(r[1]))) for r in rows if r]
    if not pairs:
        raise ValueError("the penalty file is empty")
    return [(i, a, b) for i, (a, b) in enumerate(pairs)]


def log_grid(first: float, last: float, points: int) -> list[float]:
    """Points spaced evenly in log10."""
    a, b = math.log10(first), math.log10(last)
    return [10 ** (a + (b - a) * i / (points - 1)) for i in range(points)] if points > 1 else [first]


def penalty_terms(kind: str, first: float = 1, last: float = 1, step: float = 1, var_counts: list[int] = ()) -> list[float]:
    """median: the floor of the median of the positive variable-site counts (1 if none); otherwise a sweep."""
    if kind.lower() == "median":
        positive = [c for c in var_counts if c > 0] or [1]
        return [float(math.floor(median(positive)))]
    return linear_space(first, last, step)


def group_weights(kind: str, term: float, lengths: list[int], var_counts: list[int]) -> list[float]:
    """Penalty weight of each group: std root of its length, sqrt root of its variable sites, linear and median those sites plus the term."""
    kind = kind.lower()
    if kind in ("linear", "median"):
        return [v + term for v in var_counts]
    return [math.sqrt(n) for n in (var_counts if kind == "sqrt" else lengths)]
