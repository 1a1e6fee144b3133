"""Text and a single offline page. Summaries and top lists are collected; tables with a row for each
clip are read in parts as they are written, so a page of any length takes little memory."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row

from callweave.operators.judge import DIMENSIONS

STYLE = "body{font:14px sans-serif;margin:2em auto;max-width:1200px}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left;vertical-align:top}.bad{background:#fdd}.warn{background:#ffd}.good{background:#dfd}.none{background:#eee}.card{border:1px solid #ccc;margin:1em 0;padding:.6em}.tile{display:inline-block;padding:.3em .6em;margin:.2em;min-width:6em;text-align:center}small{color:#666}"
SORT = "document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=h.cellIndex,b=t.tBodies[0],d=h.dataset.d=h.dataset.d=='1'?'-1':'1';[...b.rows].sort((x,y)=>d*x.cells[i].innerText.localeCompare(y.cells[i].innerText,undefined,{numeric:true})).forEach(r=>b.append(r))})"


def show(value: object, places: int = 3) -> str:
    if value is None or value != value:
        return "—"
    return f"{value:.{places}f}" if isinstance(value, float) else str(value)


def safe(value: object, places: int = 3) -> str:
    return html.escape(show(value, places))


def severity(score: object) -> str:
    """The class of a 1 to 5 score, rounded half to even; ``none`` for what is no number."""
    try:
        n = round(float(score))
    except (TypeError, ValueError):
        return "none"
    return "bad" if n <= 2 else "warn" if n == 3 else "good"


def bars(bins: dict[int, int], count: int = 12, width: int = 150, height: int = 32) -> str:
    """A histogram by bin, numbered from 1."""
    if not bins:
        return "<small>—</small>"
    top, w = max(bins.values()), width / count
    rects = "".join(f'<rect x="{(k - 1) * w:.1f}" y="{height - n * (height - 2) / top:.1f}" width="{w - 1:.1f}" height="{n * (height - 2) / top:.1f}" fill="#58e"><title>{n}</title></rect>' for k, n in sorted(bins.items()))
    return f'<svg width="{width}" height="{height}">{rects}</svg>'


def table(columns: list[str], rows: Iterable[tuple[str, list[str]]], empty: str = "none") -> Iterator[str]:
    """A table from rows of a class and cells that are HTML already."""
    yield "<table><thead><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr></thead><tbody>"
    some = False
    for mark, cells in rows:
        some = True
        yield f'<tr class="{mark}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>\n"
    if not some:
        yield f'<tr><td colspan="{len(columns)}"><small>{html.escape(empty)}</small></td></tr>'
    yield "</tbody></table>"


def player(path: str | None) -> str:
    return f'<audio controls preload="none" src="{html.escape(path, quote=True)}"></audio>' if path else ""


def cards(judged: DataFrame) -> Iterator[str]:
    """A card for each judged clip: its scores with reasons, the overall one first."""
    clip, marks = None, []

    def card() -> str:
        order = {d: k for k, d in enumerate(("overall", *DIMENSIONS))}
        rows = sorted(marks, key=lambda m: (order.get(m.dimension, 99), m.dimension))
        tiles = "".join(f'<span class="tile {severity(m.score)}" title="{html.escape(m.reasoning or "", quote=True)}"><b>{safe(m.score)}</b><br>{safe(m.dimension)}</span>' for m in rows)
        reasons = "".join(f"<li><b>{safe(m.dimension)}</b> {safe(m.score)}/5 {html.escape(m.reasoning or '')}</li>" for m in rows)
        return f'<div class="card"><code>{safe(clip)}</code><div>{tiles}</div><details><summary>reasons</summary><ul>{reasons}</ul></details></div>\n'

    for m in judged.orderBy("clip_id", "dimension").toLocalIterator():
        if m.clip_id != clip and marks:
            yield card()
            marks = []
        clip = m.clip_id
        marks.append(m)
    if marks:
        yield card()
    else:
        yield "<p><small>The judge did not run, or graded no clip.</small></p>"


def sections(run: str, config: dict, about: Row | None, word: Row, **t: DataFrame) -> Iterator[str]:
    counts = t["counts"].collect()
    passed = "good" if word["passed"] else "bad"
    yield f'<h1>Run {safe(run)} <span class="{passed}">{"PASS" if word["passed"] else "FAIL"}</span></h1>'
    if about is not None:
        yield f"<p><small>{safe(about['corpus'])} · {safe(about['started_at'])} to {safe(about['finished_at'])}</small></p>"
    yield f"<p>scorers: {html.escape(', '.join(sorted(r['scorer'] for r in counts)))} · results: {sum(r['results'] for r in counts)} · cached: {sum(r['cached'] for r in counts)} · errors: {sum(r['errors'] for r in counts)} · failures: {word['failures']} · warnings: {word['warnings']}</p>"

    yield "<h2>Findings</h2>"
    yield from table(["what", "clip", "severity"], (("bad", [safe(r.what), safe(r.clip_id), "gate" if r.severity < 0 else f"{r.severity:.0f}/5"]) for r in t["findings"].collect()), "nothing critical")
    yield "<h2>Judge</h2>"
    yield from cards(t["judged"])

    yield "<h2>Summary</h2>"
    bins: dict[str, dict[int, int]] = {}
    for r in t["histogram"].collect():
        bins.setdefault(r.metric, {})[r.bin] = r.n
    layer = {r.metric: r.layer for r in t["layers"].collect()}
    status = {r.metric: r.status for r in t["status"].collect()}

    def summary() -> Iterator[tuple[str, list[str]]]:
        for r in t["summary"].orderBy("metric").collect():
            mark = status.get(r.metric) or (severity(r.mean) if r.metric.startswith("judge_") else "")
            rate = "—" if r.pass_rate is None else f"{100 * r.pass_rate:.0f}%"
            yield mark if mark != "good" else "", [safe(r.metric), safe(layer.get(r.metric)), safe(r["count"]), *(safe(r[k]) for k in ("mean", "median", "p95", "min", "max")), rate, bars(bins.get(r.metric, {}))]

    yield from table(["metric", "layer", "count", "mean", "median", "p95", "min", "max", "pass", "values"], summary())
    yield "<h2>Gates</h2>"
    names = {"fail": "bad", "warn": "warn", "pass": "good"}
    yield from table(["clip", "metric", "value", "threshold", "status"], ((names[r.status], [safe(r.clip_id), safe(r.metric), safe(r.value), safe(r.threshold), safe(r.status)]) for r in t["broken"].orderBy("status", "clip_id", "metric").toLocalIterator()), "no violation")
    yield "<h2>Regressions</h2>"
    yield from table(["group", "metric", "current", "baseline", "drop", "status"], ((names[r.status], [safe(r.clip_id), safe(r.metric), safe(r.current), safe(r.baseline), safe(r["drop"]), safe(r.status)]) for r in t["regressions"].orderBy("status", "clip_id", "metric").collect()), "no baseline, or none of its groups")
    yield "<h2>Worst calls</h2>"
    yield from table(["clip", "weight"], (("", [safe(r.clip_id), safe(r.score, 1)]) for r in t["offenders"].collect()), "no flagged clip")

    yield "<h2>Calls</h2>"

    def calls() -> Iterator[tuple[str, list[str]]]:
        for r in t["clips"].toLocalIterator():
            got = r.asDict()
            m = got.get("metrics") or {}
            chips = " ".join(f"<code>{safe(k)}={safe(v, 2)}</code>" for k, v in sorted(m.items())) or "<small>no metrics</small>"
            errors = "".join(f'<div class="bad">{safe(e)}</div>' for e in got.get("messages") or [])
            name = f"<details><summary><code>{safe(r.clip_id)}</code></summary>{player(got.get('source_path'))}{errors}<small>{safe(os.path.basename(got.get('source_path') or ''))}</small></details>"
            overall = f"{m['judge_overall']:.0f}/5" if "judge_overall" in m else "—"
            yield got["status"], [name, safe(got.get("agent_version")), safe(got.get("duration_s"), 1), overall, chips, f"{got['fails']} / {got['warns']}", str(got["errors"])]

    yield from table(["clip", "version", "seconds", "judge", "metrics", "fail / warn", "errors"], calls(), "no clips")


def write(path: str, run: str, config: dict, about: Row | None, word: Row, **tables: DataFrame) -> None:
    """Write the page to a file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>Run {html.escape(run)}</title><style>{STYLE}</style>")
        for part in sections(run, config, about, word, **tables):
            f.write(part)
        f.write(f"<script>{SORT}</script>")


def console(summary: DataFrame, word: Row, errors: int = 0) -> str:
    lines = [f"{'metric':<32}{'count':>8}{'mean':>12}{'p95':>12}{'pass':>8}"]
    for r in summary.orderBy("metric").collect():
        rate = "—" if r["pass_rate"] is None else f"{100 * r['pass_rate']:.0f}%"
        lines.append(f"{r['metric']:<32}{r['count']:>8}{show(r['mean']):>12}{show(r['p95']):>12}{rate:>8}")
    return "\n".join([*lines, f"{'PASS' if word['passed'] else 'FAIL'}: {word['failures']} fail, {word['warnings']} warn, {errors} errors of scorers"])


def agreement(calibrated: DataFrame) -> str:
    lines = [f"{'dimension':<24}{'n':>6}{'kappa':>8}{'spearman':>10}{'pearson':>9}{'mae':>7}  gate"]
    rows = calibrated.orderBy("dimension").collect()
    for r in rows:
        lines.append(f"{r['dimension']:<24}{r['n']:>6}{show(r['kappa']):>8}{show(r['spearman']):>10}{show(r['pearson']):>9}{show(r['mae']):>7}  {'yes' if r['recommend_gate'] else 'no'}")
    real = [r["kappa"] for r in rows if r["kappa"] is not None and r["kappa"] == r["kappa"]]
    gate = ", ".join(f"judge_{r['dimension']}" for r in rows if r["recommend_gate"]) or "none: take all as advice"
    return "\n".join([*lines, f"mean kappa {show(sum(real) / len(real) if real else None)}; fit to gate: {gate}"])


def comparison(result: dict) -> str:
    """Two versions, scenario by scenario, regressions first."""
    if result["error"]:
        return f"FAIL: {result['error']}"
    lines = [f"{'scenario':<24}{'metric':<28}{'baseline':>10}{'candidate':>11}{'change':>9}  verdict"]
    for r in result["deltas"].collect():
        lines.append(f"{r['scenario']:<24}{r['metric']:<28}{show(r['baseline']):>10}{show(r['candidate']):>11}{show(r['candidate'] - r['baseline']):>9}  {r['verdict']}")
    lines += [f"only the {r['side']} has {r['scenario']}" + (f" / {r['metric']}" if r["metric"] else "") for r in result["warnings"].collect()]
    return "\n".join([*lines, "PASS" if result["passed"] else f"FAIL: {result['regressed']} regressed"])


def save_agreement(folder: str, result: dict) -> None:
    """The calibration as JSON and as text."""
    os.makedirs(folder, exist_ok=True)
    number = lambda v: None if isinstance(v, float) and v != v else v
    body = {k: v for k, v in result.items() if k != "text"} | {"rows": [{k: number(v) for k, v in r.items()} for r in result["rows"]]}
    with open(os.path.join(folder, "calibration_report.json"), "w") as f:
        json.dump(body, f, indent=2)
    with open(os.path.join(folder, "calibration_report.txt"), "w") as f:
        f.write(result["text"])
