"""HTML and SVG reports of small, collected results."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame


def svg_line(values: list[float | None], best: list[float | None], title: str, width: int = 640, height: int = 200) -> str:
    known = [v for v in [*values, *best] if v is not None]
    low, high = (min(known), max(known)) if known else (0.0, 1.0)
    x = lambda i: 40 + i * (width - 60) / max(1, len(values) - 1)
    y = lambda v: height - 25 - (v - low) / ((high - low) or 1) * (height - 55)
    dots = "".join(f'<circle cx="{x(i):.1f}" cy="{y(v):.1f}" r="3"/>' for i, v in enumerate(values) if v is not None)
    line = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(best) if v is not None)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="16">{html.escape(title)}</text>{dots}<polyline fill="none" stroke="currentColor" points="{line}"/><text x="2" y="{y(high):.0f}">{high:.3g}</text><text x="2" y="{y(low):.0f}">{low:.3g}</text></svg>'


#: What the five panels of a report show: title and metric.
PANELS = (("composite score", "composite_score"), ("average precision, validation", "auprc_val"), ("average precision, out of time", "auprc"), ("score stability", "psi"), ("gap of areas", "auroc_train_val_gap"))


def panels(log: DataFrame, kinds: tuple[tuple[str, str], ...] = PANELS) -> list[tuple[str, str]]:
    """(title, picture) of each metric along a log, with its best kept value so far; lower is better for the last two."""
    rows = [r.asDict(recursive=True) for r in log.select("status", "seq", "metrics_summary").orderBy("seq").collect()]
    out = []
    for title, metric in kinds:
        low = metric in ("psi", "auroc_train_val_gap")
        values, best, now = [(r["metrics_summary"] or {}).get(metric) for r in rows], [], None
        for r, v in zip(rows, values, strict=True):
            if r["status"] == "keep" and v is not None:
                now = v if now is None else min(now, v) if low else max(now, v)
            best.append(now)
        out.append((title, svg_line(values, best, title)))
    return out


def html_table(df: DataFrame, most: int = 200) -> str:
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect()) + "</table>"


def write_dashboard(path: str, title: str, sections: list[tuple[str, str]]) -> None:
    body = "".join(f"<h2>{html.escape(n)}</h2>{part}" for n, part in sections)
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}")
