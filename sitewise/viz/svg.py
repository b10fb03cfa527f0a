"""Heatmaps of gene scores and dropout curves, as SVG.

Spark aggregates and orders; at most ``species_limit`` x ``gene_limit`` cells
reach the driver.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scores as S


def colour(value: float | None, top: float) -> str:
    """Blue for negative, white for 0, red for positive; grey for an absent gene."""
    if value is None:
        return "#bdbdbd"
    share = max(-1.0, min(1.0, value / top)) if top > 0 else 0.0
    fade = round(255 * (1 - abs(share)))
    return f"#ff{fade:02x}{fade:02x}" if share >= 0 else f"#{fade:02x}{fade:02x}ff"


def short_labels(names: list[str], least: int = 10) -> list[str]:
    """Without the longest part that all names share, if it has ``least`` characters or more."""
    if len(names) < 2:
        return names
    first = min(names, key=len)
    for n in range(len(first), least - 1, -1):
        for at in range(len(first) - n + 1):
            part = first[at : at + n]
            if all(part in name for name in names):
                return [name.replace(part, "…", 1) for name in names]
    return names


def heatmap(predicted: DataFrame, gene_scores: DataFrame, gene_limit: int = 100, species_limit: int = 100, ssq_threshold: float = 0.0, m_grid: bool = False) -> str:
    """predicted (sample, y, prediction), gene_scores (sample, gene, score).

    Genes by their sum of squares, falling; negatives by rising prediction, and
    with ``m_grid`` positives by falling prediction first.
    """
    genes = [r.gene for r in S.top_by_square(gene_scores.where("score IS NOT NULL"), ssq_threshold, gene_limit).collect()]
    side = F.when(F.col("y") > 0, 0 if m_grid else 1).otherwise(1 if m_grid else 0)
    order = (side, F.when(F.col("y") > 0, -F.col("prediction")).otherwise(F.col("prediction")), F.col("sample"))
    rows = predicted.orderBy(*order).limit(species_limit).collect()
    names = [str(r["sample"]) for r in rows]
    cells = gene_scores.where(F.col("gene").isin(genes) & F.col("sample").cast("string").isin(names)).collect() if genes and names else []
    value = {(str(r["sample"]), r.gene): r.score for r in cells}
    top = max((abs(v) for v in value.values() if v is not None), default=0.0)
    size, left, head = 14, 160, 120
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + size * (len(genes) + 2) + 60}" height="{head + size * len(names) + 20}" font-family="sans-serif" font-size="10">']
    for j, name in enumerate(short_labels(genes)):
        x = left + size * (j + 2) + size / 2
        out.append(f'<text x="{x}" y="{head - 6}" transform="rotate(-60 {x} {head - 6})">{escape(name)}</text>')
    for i, (r, name) in enumerate(zip(rows, short_labels(names), strict=True)):
        y = head + size * i
        out.append(f'<text x="{left - 6}" y="{y + size - 3}" text-anchor="end">{escape(name)}</text>')
        out.append(f'<rect x="{left}" y="{y}" width="{size}" height="{size}" fill="{colour(r.prediction, 1.0)}"><title>{r.prediction:.4f}</title></rect>')
        for j, gene in enumerate(genes):
            v = value.get((str(r["sample"]), gene))
            out.append(f'<rect x="{left + size * (j + 2)}" y="{y}" width="{size}" height="{size}" fill="{colour(v, top)}"/>')
    return "\n".join([*out, "</svg>"])


def dropout_curves(curve: DataFrame, width: int = 640, height: int = 240) -> str:
    """True positive and negative rates and accuracy over the number of features, a panel per round."""
    panels: dict[int, list] = {}
    for r in curve.orderBy("round", "k").collect():  # rounds x window
        panels.setdefault(r.round, []).append(r)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height * max(1, len(panels))}" font-family="sans-serif" font-size="10">']
    for i, (number, rows) in enumerate(sorted(panels.items())):
        most = max(1, rows[-1].k)
        at = lambda k, v: f"{50 + (width - 80) * k / most:.1f},{height * (i + 1) - 30 - (height - 60) * v:.1f}"  # noqa: B023, E731
        out.append(f'<text x="50" y="{height * i + 20}">round {number}</text>')
        for name, shade in (("tpr", "#d62728"), ("tnr", "#1f77b4"), ("accuracy", "#2c2c2c")):
            line = " ".join(at(r.k, r[name]) for r in rows)
            out.append(f'<polyline fill="none" stroke="{shade}" points="{line}"><title>{name}</title></polyline>')
    return "\n".join([*out, "</svg>"])
