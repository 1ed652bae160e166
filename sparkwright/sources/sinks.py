"""Writers."""

from __future__ import annotations

import html
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; quotes doubled; empty texts quoted, so that they differ from null."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def copy_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> tuple[float, int]:
    """Bulk load into another database; needs its driver on the class path. Returns
    milliseconds and the rows that the table has afterwards."""
    start = time.perf_counter()
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()
    taken = 1000 * (time.perf_counter() - start)
    return taken, df.sparkSession.read.format("jdbc").options(url=url, dbtable=table, **options).load().count()


def dashboard(mart: DataFrame, title: str, segment: Sequence[str], facts: Sequence[tuple[str, object]], state: str, hours: float, measure: tuple[str, str], most: int = 10_000) -> str:
    """A self-contained page of a segment mart: freshness badge, tiles, filters (by
    each segment column, hide sparse, assignable only) that work without a server,
    a bar a segment, a scatter of two measures, and the table with flags."""
    rows = [r.asDict() for r in mart.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a page is for a serving table")
    text = lambda v: html.escape("" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v))
    tiles = "".join(f'<div class="tile"><b>{text(v)}</b><span>{html.escape(k)}</span></div>' for k, v in facts)
    choices = "".join(
        f'<label>{html.escape(c)} <select multiple data-column="{i}">' + "".join(f"<option>{html.escape(v)}</option>" for v in sorted({str(r[c]) for r in rows})) + "</select></label>" for i, c in enumerate(segment)
    )
    largest = max((r["candidates"] for r in rows), default=0) or 1
    x, y = measure
    high = [max((abs(r[c] or 0) for r in rows), default=0) or 1 for c in (x, y)]
    body, dots = [], []
    for r in rows:
        keys = "".join(f' data-k{i}="{html.escape(str(r[c]))}"' for i, c in enumerate(segment))
        mark = f'{keys} data-sparse="{int(bool(r["segment_is_sparse"]))}" data-ok="{int(bool(r["is_assignable"]))}"'
        bar = f'<div class="bar" style="width:{100 * r["candidates"] / largest:.1f}%"></div>'
        cells = "".join(f"<td>{text(v)}</td>" for v in r.values())
        body.append(f'<tr class="row"{mark}><td>{bar}</td>{cells}</tr>')
        if r[x] is not None and r[y] is not None:
            dots.append(f'<circle class="row"{mark} cx="{20 + 360 * r[x] / high[0]:.1f}" cy="{190 - 170 * r[y] / high[1]:.1f}" r="4"><title>{html.escape(" / ".join(str(r[c]) for c in segment))}</title></circle>')
    head = "".join(f"<th>{html.escape(c)}</th>" for c in ["", *(rows[0] if rows else mart.columns)])
    style = "body{font:14px sans-serif;margin:2em}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}.tile{display:inline-block;margin:0 2em 1em 0}.tile b{font-size:1.6em;display:block}.bar{background:#48a;height:.8em;min-width:1px}.badge{padding:.2em .6em;border-radius:.4em;color:#fff}.fresh{background:#2a7}.ageing{background:#c80}.stale{background:#b33}"
    script = (
        "const f=()=>{const on=[...document.querySelectorAll('select')].map(s=>[...s.selectedOptions].map(o=>o.text));const[s,a]=['sparse','ok'].map(i=>document.getElementById(i).checked);"
        "document.querySelectorAll('.row').forEach(r=>{const d=r.dataset;r.style.display=on.every((v,i)=>!v.length||v.includes(d['k'+i]))&&!(s&&d.sparse==='1')&&!(a&&d.ok==='0')?'':'none'})};document.querySelectorAll('select,input').forEach(e=>e.onchange=f)"
    )
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)} <small class="badge {html.escape(state)}">{html.escape(state)}, {hours:.1f} h</small></h1>'
        f'{tiles}<form>{choices}<label><input type="checkbox" id="sparse"> hide sparse</label><label><input type="checkbox" id="ok"> assignable only</label></form>'
        f'<svg width="400" height="200" role="img" aria-label="{html.escape(x)} against {html.escape(y)}">{"".join(dots)}</svg><table><tr>{head}</tr>{"".join(body)}</table><script>{script}</script></body></html>'
    )


def html_report(df: DataFrame, title: str, facts: Sequence[tuple[str, object]] = (), most: int = 10_000) -> str:
    """A self-contained page of a small serving table (at most ``most`` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a report is for a serving table")
    cell = lambda v: html.escape("" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v))
    tiles = "".join(f"<dt>{html.escape(k)}</dt><dd>{cell(v)}</dd>" for k, v in facts)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    style = "body{font:14px sans-serif;margin:2em}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}dt{font-weight:bold}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><dl>{tiles}</dl><table><tr>{head}</tr>{body}</table></body></html>'
