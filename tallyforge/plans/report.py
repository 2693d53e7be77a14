"""Plain HTML and SVG from small result tables; every value is escaped."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..storage import bounded

PALETTE = ("#13322b", "#a57f2c", "#9b2247", "#235b4e", "#611232", "#98989a")


def table_html(df: DataFrame, most: int = 5_000) -> str:
    """A table of at most ``most`` rows; a larger one is an error, not a cut."""
    rows = bounded(df, most, "a table of the report")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(show(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def page(title: str, sections: Sequence[tuple[str, str]]) -> str:
    body = "".join(f"<section><h2>{html.escape(h)}</h2>{content}</section>" for h, content in sections)
    style = "body{font:15px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}"
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def bars_svg(title: str, labels: Sequence[str], counts: Sequence[float], fill: dict[str, str] | str = PALETTE[0], width: int = 640, height: int = 360) -> str:
    """A bar chart; ``fill`` is one colour, or one for each label exactly."""
    if isinstance(fill, dict) and set(fill) != set(labels):
        raise ValueError("fill colours must name exactly the labels")
    top = max([*counts, 1])
    step = (width - 60) / max(len(counts), 1)
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' font-family='sans-serif' font-size='11'><text x='10' y='18' font-size='14'>{html.escape(title)}</text>"]
    for i, (label, n) in enumerate(zip(labels, counts)):
        h = (height - 90) * n / top
        colour = fill[label] if isinstance(fill, dict) else fill
        parts.append(f"<rect x='{50 + i * step:.1f}' y='{height - 50 - h:.1f}' width='{max(step - 1, 0.5):.1f}' height='{h:.1f}' fill='{html.escape(colour)}'><title>{html.escape(str(label))}: {n:g}</title></rect>")
        if len(counts) <= 25:
            parts.append(f"<text x='{50 + (i + 0.5) * step:.1f}' y='{height - 36}' text-anchor='middle'>{html.escape(str(label))[:12]}</text>")
    parts.append(f"<text x='44' y='45' text-anchor='end'>{top:g}</text></svg>")
    return "".join(parts)


def histogram_svg(title: str, bins: Sequence, **options) -> str:
    """From rows (bin, lower, upper, midpoint, count)."""
    rows = sorted(bins, key=lambda r: r["bin"])
    return bars_svg(title, [f"{r['midpoint']:.4g}" for r in rows], [r["count"] for r in rows], **options)


def box_svg(title: str, boxes: Sequence, width: int = 640, height: int = 60) -> str:
    """From rows (name, min, q1, median, q3, max), one box below another, each on its own scale."""
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{30 + height * len(boxes)}' font-family='sans-serif' font-size='11'><text x='10' y='18' font-size='14'>{html.escape(title)}</text>"]
    for i, r in enumerate(boxes):
        if r["min"] is None:
            continue
        span = (r["max"] - r["min"]) or 1.0
        x = lambda v: 120 + (width - 140) * (v - r["min"]) / span  # noqa: B023, E731
        y = 30 + height * i
        parts.append(f"<text x='8' y='{y + 24}'>{html.escape(r['name'])[:18]}</text><line x1='{x(r['min']):.1f}' x2='{x(r['max']):.1f}' y1='{y + 20}' y2='{y + 20}' stroke='#333'/><rect x='{x(r['q1']):.1f}' y='{y + 8}' width='{max(x(r['q3']) - x(r['q1']), 1):.1f}' height='24' fill='#ddd' stroke='#333'/><line x1='{x(r['median']):.1f}' x2='{x(r['median']):.1f}' y1='{y + 8}' y2='{y + 32}' stroke='#000' stroke-width='2'/>")
    return "".join(parts) + "</svg>"


def heatmap_svg(title: str, cells: Sequence, names: Sequence[str], size: int = 46) -> str:
    """From rows (var1, var2, r): blue to white to red."""
    n = len(names)
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{140 + size * n}' height='{60 + size * n}' font-family='sans-serif' font-size='11'><text x='10' y='18' font-size='14'>{html.escape(title)}</text>"]
    for r in cells:
        if r["r"] is None:
            continue
        i, j, v = names.index(r["var1"]), names.index(r["var2"]), max(-1.0, min(1.0, r["r"]))
        c = int(255 * (1 - abs(v)))
        colour = f"rgb(255,{c},{c})" if v > 0 else f"rgb({c},{c},255)"
        parts.append(f"<rect x='{130 + j * size}' y='{40 + i * size}' width='{size}' height='{size}' fill='{colour}'/><text x='{130 + (j + 0.5) * size}' y='{40 + (i + 0.55) * size}' text-anchor='middle'>{v:.2f}</text>")
    parts += [f"<text x='8' y='{40 + (i + 0.55) * size}'>{html.escape(x)[:18]}</text>" for i, x in enumerate(names)]
    return "".join(parts) + "</svg>"


def steps_svg(title: str, curves: dict[str, Sequence[tuple[float, float]]], width: int = 640, height: int = 360) -> str:
    """Step curves of survival by group."""
    top = max([t for c in curves.values() for t, _ in c] or [1.0]) or 1.0
    x, y = (lambda t: 50 + (width - 70) * t / top), (lambda s: height - 40 - (height - 80) * s)
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' font-family='sans-serif' font-size='11'><text x='10' y='18' font-size='14'>{html.escape(title)}</text>"]
    for k, (name, points) in enumerate(curves.items()):
        path, last = f"M{x(0):.1f} {y(1):.1f}", 1.0
        for t, s in sorted(points):
            path += f" L{x(t):.1f} {y(last):.1f} L{x(t):.1f} {y(s):.1f}"
            last = s
        parts.append(f"<path d='{path}' fill='none' stroke='{PALETTE[k % len(PALETTE)]}' stroke-width='2'/><text x='{width - 100}' y='{40 + 14 * k}' fill='{PALETTE[k % len(PALETTE)]}'>{html.escape(name)}</text>")
    return "".join(parts) + "</svg>"


def scatter_svg(title: str, points: Sequence[tuple[float, float]], h_lines: Sequence[float] = (), v_lines: Sequence[float] = (), width: int = 640, height: int = 420) -> str:
    """Points with guide lines, as in a volcano plot or a map of points."""
    xs, ys = [p[0] for p in points] + list(v_lines) or [0.0], [p[1] for p in points] + list(h_lines) or [0.0]
    sx, sy = (max(xs) - min(xs)) or 1.0, (max(ys) - min(ys)) or 1.0
    x, y = (lambda v: 40 + (width - 60) * (v - min(xs)) / sx), (lambda v: height - 40 - (height - 80) * (v - min(ys)) / sy)
    parts = [f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' font-family='sans-serif' font-size='11'><text x='10' y='18' font-size='14'>{html.escape(title)}</text>"]
    parts += [f"<line x1='40' x2='{width - 20}' y1='{y(h):.1f}' y2='{y(h):.1f}' stroke='#999' stroke-dasharray='4'/>" for h in h_lines]
    parts += [f"<line y1='40' y2='{height - 40}' x1='{x(v):.1f}' x2='{x(v):.1f}' stroke='#999' stroke-dasharray='4'/>" for v in v_lines]
    parts += [f"<circle cx='{x(a):.1f}' cy='{y(b):.1f}' r='2' fill='{PALETTE[0]}'/>" for a, b in points]
    return "".join(parts) + "</svg>"


def grid_size(n: int) -> tuple[int, int]:
    """(rows, columns) of the squarest grid for n plots."""
    columns = max(1, int(n**0.5 + 0.999999))
    return max(1, -(-n // columns)), columns


def plots_grid(plots: Sequence[str], columns: int | None = None) -> str:
    """Plots side by side on one HTML page."""
    columns = columns or grid_size(len(plots))[1]
    return f"<div style='display:grid;grid-template-columns:repeat({columns},auto)'>" + "".join(f"<div>{p}</div>" for p in plots) + "</div>"
