"""Charts as SVG text, and the page of a profile: no scripts, nothing loaded from elsewhere."""

from __future__ import annotations

import html
from collections.abc import Sequence

from quern.operators.artifacts import ColumnProfile, DatasetProfile

#: Size of a chart, its margins, and its colours (ink, fill, paler fill).
WIDTH, ROW, MARGIN, INK, FILL, PALE = 420, 20, 130, "#333", "#4878a8", "#c9d9e8"


def _text(x: float, y: float, words: object, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="11" fill="{INK}">{html.escape(str(words))}</text>'


def _rect(x: float, y: float, w: float, h: float, tip: object = "", fill: str = FILL, opacity: float = 1.0) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{max(h, 0):.1f}" fill="{fill}" fill-opacity="{opacity:.3f}"><title>{html.escape(str(tip))}</title></rect>'


def _line(x1: float, y1: float, x2: float, y2: float, width: float = 1) -> str:
    return f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{INK}" stroke-width="{width}"/>'


def _svg(height: float, parts: list[str], label: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" role="img" aria-label="{html.escape(label)}" width="{WIDTH}" height="{height:.0f}">{"".join(parts)}</svg>'


def short(x: float) -> str:
    return f"{x:.4g}"


def bars(rows: Sequence[tuple[object, float]], label: str = "counts") -> str:
    """A bar for each (name, value), from zero; values below zero have none."""
    most = max((v for _, v in rows), default=0) or 1
    parts = []
    for i, (name, v) in enumerate(rows):
        w = max(v, 0) / most * (WIDTH - MARGIN - 60)
        shown = str(name) if len(str(name)) <= 18 else f"{str(name)[:17]}…"
        parts += [_text(MARGIN - 6, i * ROW + 14, shown, "end"), _rect(MARGIN, i * ROW + 3, w, ROW - 6, f"{name}: {short(v)}"), _text(MARGIN + w + 5, i * ROW + 14, short(v))]
    return _svg(max(len(rows), 1) * ROW, parts, label)


def histogram(bins: Sequence[tuple[float, float, int]], label: str = "histogram") -> str:
    """Adjoining columns for (low, high, count)."""
    if not bins:
        return _svg(ROW, [_text(0, 14, "no values")], label)
    most, wide = max(n for _, _, n in bins) or 1, WIDTH / len(bins)
    parts = [_rect(i * wide, 80 - 76 * n / most, wide - 1, 76 * n / most, f"{short(a)} to {short(b)}: {n}") for i, (a, b, n) in enumerate(bins)]
    return _svg(100, [*parts, _line(0, 80, WIDTH, 80), _text(0, 95, short(bins[0][0])), _text(WIDTH, 95, short(bins[-1][1]), "end")], label)


def box(low: float, q1: float, median: float, q3: float, high: float, label: str = "spread") -> str:
    """Whiskers from ``low`` to ``high`` and a box of the middle half."""
    at = lambda v: 8 + (v - low) / ((high - low) or 1) * (WIDTH - 16)
    parts = [_line(at(low), 20, at(high), 20), _rect(at(q1), 8, at(q3) - at(q1), 24, f"{short(q1)} to {short(q3)}", PALE), _line(at(median), 8, at(median), 32, 2)]
    return _svg(50, [*parts, _text(0, 46, short(low)), _text(WIDTH, 46, short(high), "end")], label)


def intervals(rows: Sequence[tuple[str, float, float | None, float | None]], label: str = "scores") -> str:
    """A point for each (name, value, low, high) on a common axis, with its interval where it has one."""
    ends = [x for r in rows for x in r[1:] if x is not None]
    low, high = (min(ends), max(ends)) if ends else (0.0, 1.0)
    at = lambda v: MARGIN + (v - low) / ((high - low) or 1) * (WIDTH - MARGIN - 60)
    parts = []
    for i, (name, v, a, b) in enumerate(rows):
        y = i * ROW + 10
        parts += [_text(MARGIN - 6, y + 4, name, "end"), *([_line(at(a), y, at(b), y)] if a is not None and b is not None else [])]
        parts += [f'<circle cx="{at(v):.1f}" cy="{y}" r="4" fill="{FILL}"/>', _text(WIDTH, y + 4, short(v), "end")]
    return _svg(max(len(rows), 1) * ROW, parts, label)


def cells(counts: dict[tuple[str, str], float], label: str = "confusion") -> str:
    """A square for each (row, column), the darker the larger its share of its row."""
    names = sorted({n for pair in counts for n in pair})
    side = min(48.0, (WIDTH - MARGIN) / max(len(names), 1))
    parts = [_text(MARGIN + (j + 0.5) * side, 12, n, "middle") for j, n in enumerate(names)]
    for i, truth in enumerate(names):
        total = sum(counts.get((truth, n), 0) for n in names) or 1
        parts.append(_text(MARGIN - 6, 20 + (i + 0.6) * side, truth, "end"))
        for j, said in enumerate(names):
            n = counts.get((truth, said), 0)
            parts += [_rect(MARGIN + j * side, 20 + i * side, side - 1, side - 1, f"{truth} as {said}: {n}", opacity=n / total), _text(MARGIN + (j + 0.5) * side, 20 + (i + 0.6) * side, n, "middle")]
    return _svg(24 + side * max(len(names), 1), parts, label)


def curve(points: Sequence[tuple[float, float]], label: str = "curve", diagonal: bool = False) -> str:
    """A line through points of the unit square, as of reliability."""
    at = lambda x, y: f"{20 + 180 * x:.1f},{190 - 180 * y:.1f}"
    parts = [_line(20, 190, 200, 190), _line(20, 10, 20, 190), *([_line(20, 190, 200, 10, 0.5)] if diagonal else [])]
    return _svg(200, [*parts, f'<polyline points="{" ".join(at(x, y) for x, y in points)}" fill="none" stroke="{FILL}" stroke-width="2"/>'], label)


def _column(c: ColumnProfile) -> str:
    facts = {"kind": c.kind, "values": c.count, "missing": f"{c.missing} ({c.missing_pct:.1f} %)", "distinct": c.unique} | {k: short(v) for k, v in c.stats.items()}
    table = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in facts.items())
    drawn = histogram([tuple(b) for b in c.histogram], f"histogram of {c.name}") if c.histogram else bars([tuple(t) for t in c.top_values], f"top values of {c.name}") if c.top_values else ""
    fences = [c.stats.get(k) for k in ("min", "q1", "median", "q3", "max")]
    if c.histogram and None not in fences:
        drawn += "<br>" + box(*fences, f"spread of {c.name}")
    return f"<section><h3>{html.escape(c.name)}</h3><table>{table}</table>{drawn}</section>"


def profile_page(p: DatasetProfile) -> str:
    """The whole profile as one page."""
    found = "".join(
        f"<tr><td>{html.escape(f['severity'])}</td><td>{html.escape(f['kind'])}</td><td>{html.escape(', '.join(f['columns']))}</td><td>{html.escape(f['summary'])}</td></tr>" for f in p.findings
    )
    gaps = [(c.name, c.missing_pct) for c in p.columns if c.missing]
    missing = f"<h2>Missing, percent</h2>{bars(gaps, 'missing values')}" if gaps else ""
    style = "body{font:14px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{padding:2px 8px;text-align:left}section{border-top:1px solid #ccc}"
    return (
        f"<!doctype html><html><head><meta charset=utf-8><title>Profile</title><style>{style}</style></head><body><h1>Profile</h1>"
        f"<p>{p.n_rows} rows, {len(p.columns)} columns, {p.duplicate_rows} duplicate rows</p><h2>Findings</h2><table>{found}</table>{missing}"
        f"<h2>Columns</h2>{''.join(_column(c) for c in p.columns)}</body></html>\n"
    )
