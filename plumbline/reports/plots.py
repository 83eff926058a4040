"""Pictures of profiles, as SVG: histograms of columns, and where cells are missing. Nothing but text is needed to draw them."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from plumbline.operators import rows
from plumbline.plans.column import Column
from plumbline.plans.profile import Profile

WIDTH, HEIGHT, MARGIN = 360, 240, 36
INK, FILL = "#333333", "#4477aa"
COLORS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb")


def _svg(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">' + "".join(parts) + "</svg>"


def _text(x: float, y: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{INK}">{escape(text)}</text>'


def _axes(title: str, low: str, high: str, top: str) -> list[str]:
    base, right = HEIGHT - MARGIN, WIDTH - 12
    line = f'<path d="M{MARGIN} 24V{base}H{right}" fill="none" stroke="{INK}"/>'
    return [line, _text(WIDTH / 2, 16, title), _text(MARGIN, base + 16, low, "start"), _text(right, base + 16, high, "end"), _text(MARGIN - 4, 32, top, "end")]


def column_histogram(column: Column, title: str = "") -> str:
    """A column's bins; raises if it has none."""
    shown = column.report()["statistics"].get("histogram")
    if column.data_type not in ("int", "float") or not shown:
        raise ValueError("there is no histogram of this column")
    counts, edges = shown["bin_counts"], shown["bin_edges"]
    most, wide, base = max(counts), (WIDTH - 12 - MARGIN) / len(counts), HEIGHT - MARGIN
    bars = [f'<rect x="{MARGIN + i * wide:.2f}" y="{base - n / most * (base - 28):.2f}" width="{max(wide - 1, 0.5):.2f}" height="{n / most * (base - 28):.2f}" fill="{FILL}"/>' for i, n in enumerate(counts)]
    return _svg(WIDTH, HEIGHT, [*_axes(title, f"{edges[0]:.4g}", f"{edges[-1]:.4g}", str(most)), *bars])


def histograms(p: Profile, columns: list[str] | None = None) -> str:
    """All numeric columns' histograms, tiled."""
    names = [c for c in columns or p.columns if p.columns[c].data_type in ("int", "float") and p.columns[c].numbers.histogram.total]
    if columns and len(names) < len(columns):
        raise ValueError(f"no histograms of {', '.join(sorted(set(columns) - set(names)))}")
    wide = max(1, min(3, len(names)))
    tiles = [f'<g transform="translate({i % wide * WIDTH},{i // wide * HEIGHT})">{column_histogram(p.columns[c], c)}</g>' for i, c in enumerate(names)]
    return _svg(wide * WIDTH, max(1, -(-len(names) // wide)) * HEIGHT, tiles)


def missing_columns(runs: dict[str, list[tuple[int, int, str]]], n_rows: int, title: str = "missing cells") -> str:
    """A bar for each column, with stretches of rows (start, stop, token) whose cells are missing."""
    base, wide = HEIGHT - MARGIN, (WIDTH - 12 - MARGIN) / max(1, len(runs))
    tokens = list(dict.fromkeys(t for r in runs.values() for _, _, t in r))
    parts = _axes(title, "", "", str(n_rows))
    for i, (c, own) in enumerate(runs.items()):
        parts.append(_text(MARGIN + (i + 0.5) * wide, base + 16, c))
        for a, b, t in own:
            y = 28 + a / max(1, n_rows) * (base - 28)
            high = max(0.5, (b - a + 1) / max(1, n_rows) * (base - 28))
            parts.append(f'<rect x="{MARGIN + i * wide + 2:.2f}" y="{y:.2f}" width="{max(wide - 4, 1):.2f}" height="{high:.2f}" fill="{COLORS[tokens.index(t) % len(COLORS)]}"/>')
    return _svg(WIDTH, HEIGHT, parts)


def missing_matrix(df: DataFrame, columns: list[str], row_id: str, most: int = 5000) -> str:
    """missing_columns() of a table; raises for over `most` stretches of a column, which no picture shows."""
    out: dict[str, list[tuple[int, int, str]]] = {}
    for c in columns:
        found = rows.null_runs(df, c, row_id).orderBy("start").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{c} has over {most} stretches of missing cells")
        out[c] = [(r["start"], r["stop"], "NULL") for r in found]
    return missing_columns(out, df.count())
