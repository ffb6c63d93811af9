"""Chart files of the experiments' figures, as SVG text made from bounded numbers of points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts

WIDTH, HEIGHT, EDGE, POINTS = 720, 360, 40, 2000
#: Line colours, in order.
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#8c564b", "#e377c2")


def thinned(df: DataFrame, by: Sequence[str], order: str, most: int = POINTS) -> DataFrame:
    """At most about ``most`` evenly spaced rows of each series: as many as a chart can show."""
    step = F.ceil(F.col("_n") / F.lit(most))
    placed = ts.with_group_facts(df.withColumn("_i", ts.row_index(by, order)), by, _n=F.count(F.lit(1)))
    return placed.where(F.col("_i") % step == 0).drop("_i", "_n")


def _scale(low: float, high: float, start: float, end: float):
    span = (high - low) or 1.0
    return lambda v: start + (v - low) / span * (end - start)


def _svg(title: str, parts: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, '<rect width="100%" height="100%" fill="white"/>', f'<text x="{EDGE}" y="20" font-size="14">{escape(title)}</text>', *parts, "</svg>"])


def lines(title: str, curves: Mapping[str, Sequence[tuple[float, float]]], spans: Sequence[tuple[float, float, int]] = ()) -> str:
    """A line for each named curve, over shaded spans (from, to, class)."""
    points = [p for c in curves.values() for p in c]
    if not points:
        return _svg(title, [])
    x = _scale(min(p[0] for p in points), max(p[0] for p in points), EDGE, WIDTH - EDGE)
    y = _scale(min(p[1] for p in points), max(p[1] for p in points), HEIGHT - EDGE, EDGE)
    parts = [f'<rect x="{x(a):.1f}" y="{EDGE}" width="{max(0.0, x(b) - x(a)):.1f}" height="{HEIGHT - 2 * EDGE}" fill="{COLOURS[k % len(COLOURS)]}" opacity="0.15"/>' for a, b, k in spans]
    for k, (name, curve) in enumerate(curves.items()):
        path = " ".join(f"{x(a):.1f},{y(b):.1f}" for a, b in curve)
        parts.append(f'<polyline points="{path}" fill="none" stroke="{COLOURS[k % len(COLOURS)]}"/>')
        parts.append(f'<text x="{WIDTH - EDGE - 120}" y="{EDGE + 14 * k}" fill="{COLOURS[k % len(COLOURS)]}">{escape(name)}</text>')
    return _svg(title, parts)


def cells(title: str, values: Mapping[tuple[float, float], float]) -> str:
    """A heat map by (row, column), each cell with its number."""
    rows, columns = sorted({r for r, _ in values}), sorted({c for _, c in values})
    if not values:
        return _svg(title, [])
    w, h = (WIDTH - 2 * EDGE) / len(columns), (HEIGHT - 2 * EDGE) / len(rows)
    most = max(abs(v) for v in values.values()) or 1.0
    parts = []
    for (r, c), v in sorted(values.items()):
        left, top = EDGE + columns.index(c) * w, EDGE + rows.index(r) * h
        parts.append(f'<rect x="{left:.1f}" y="{top:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{COLOURS[2] if v >= 0 else COLOURS[1]}" opacity="{abs(v) / most:.2f}"/>')
        parts.append(f'<text x="{left + 6:.1f}" y="{top + h / 2:.1f}">{v:.2f}</text>')
    parts += [f'<text x="2" y="{EDGE + (i + 0.5) * h:.1f}">{r:g}</text>' for i, r in enumerate(rows)]
    parts += [f'<text x="{EDGE + (i + 0.4) * w:.1f}" y="{HEIGHT - EDGE / 2}">{c:g}</text>' for i, c in enumerate(columns)]
    return _svg(title, parts)


def bars(title: str, values: Sequence[float], marked: Sequence[bool]) -> str:
    """A bar for each value; marked ones in the second colour."""
    if not values:
        return _svg(title, [])
    y = _scale(0.0, max(values), HEIGHT - EDGE, EDGE)
    w = (WIDTH - 2 * EDGE) / len(values)
    parts = [f'<rect x="{EDGE + k * w:.1f}" y="{y(v):.1f}" width="{w * 0.8:.1f}" height="{HEIGHT - EDGE - y(v):.1f}" fill="{COLOURS[1 if m else 0]}"/>' for k, (v, m) in enumerate(zip(values, marked, strict=True))]
    return _svg(title, parts)


def write_figures(frames: Mapping[str, DataFrame], prices: DataFrame, folder: str) -> list[str]:
    """The four charts of ``experiments.figure_data`` as files in a folder of the driver; ``prices``: series_id, date, price of the spans' series."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    day = F.unix_date("date").cast("double").alias("x")
    curves: dict[str, list[tuple[float, float]]] = {}
    for r in thinned(frames["equity_curves"], ["strategy", "series_id"], "date").select("strategy", "series_id", day, "equity").orderBy("strategy", "series_id", "x").collect():
        curves.setdefault(f"{r['strategy']} {r['series_id']}", []).append((r["x"], r["equity"]))
    series: dict[str, list[tuple[float, float]]] = {}
    for r in thinned(prices, ["series_id"], "date").select("series_id", day, "price").orderBy("series_id", "x").collect():
        series.setdefault(r["series_id"], []).append((r["x"], r["price"]))
    spans = frames["regime_spans"].orderBy(F.desc("length")).limit(POINTS).select(F.unix_date("first").cast("double").alias("a"), F.unix_date("last").cast("double").alias("b"), "value").collect()
    grid = {(r["threshold"], r["cost"]): r["s"] for r in frames["cost_heatmap"].groupBy("threshold", "cost").agg(F.avg("annualised_sharpe").alias("s")).collect()}
    scree = frames["scree"].orderBy("k").limit(POINTS).collect()
    made = {
        "equity_curves": lines("Equity by strategy", curves), "regime_spans": lines("Price and regimes", series, [(r["a"], r["b"], int(r["value"])) for r in spans]),
        "cost_heatmap": cells("Sharpe ratio by threshold and cost", grid), "scree": bars("Eigenvalues; signal in the second colour", [r["eigenvalue"] for r in scree], [r["signal"] for r in scree]),
    }
    paths = []
    for name, text in made.items():
        path = Path(folder) / f"{name}.svg"
        path.write_text(text, encoding="utf-8")
        paths.append(str(path))
    return paths
