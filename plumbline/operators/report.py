"""Totals, bounded retention and order of findings and changes (A and O families)."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.operators.diff import KINDS
from plumbline.operators.findings import FINDING, with_fingerprint
from plumbline.operators.relate import MAX_POLICY

SEVERITIES = ("error", "warning", "note")


def groups(findings: DataFrame) -> DataFrame:
    """(id, rule, severity, count) over all findings, sorted by the first three, severities by weight (A3)."""
    weight = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("id", "rule", "severity").agg(F.count("*").alias("count")).orderBy("id", "rule", weight)


def totals(findings: DataFrame) -> DataFrame:
    """Exact counts by severity and by (id, rule, severity), in one pass: level says which."""
    g = findings.groupingSets([["severity"], ["id", "rule", "severity"]], "id", "rule", "severity")
    counted = g.agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return counted.select("id", "rule", "severity", "n", F.when(F.col("_g") > 0, "severity").otherwise("rule").alias("level"))


def retained(findings: DataFrame, limit: int, emission: list[str]) -> DataFrame:
    """The first `limit` findings in order of emission (0: all). Totals are of all findings, so take them apart.

    The limit is a top-k in each task before one task orders what is left.
    """
    return findings.orderBy(*emission).limit(limit) if limit else findings


def summary(findings: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: errors, warnings, notes, retained, omitted, status."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "note")], F.count("*").alias("total"))
    out = n.crossJoin(kept.agg(F.count("*").alias("retained")))  # of one row each
    return out.select("errors", "warnings", "notes", "retained", (F.col("total") - F.col("retained")).alias("omitted"), F.when(F.col("errors") == 0, "pass").otherwise("fail").alias("status"))


def change_summary(changes: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with the count of each kind."""
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def first_match(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each group's value of the least order: partial minima, no window."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def sort_findings(findings: DataFrame) -> DataFrame:
    """By path (none first), line and column (none as 0), id and message (O1)."""
    return findings.orderBy(F.coalesce("path", F.lit("")), F.coalesce("span.line", F.lit(0)), F.coalesce("span.column", F.lit(0)), "id", "message")


def report(findings: DataFrame, analysis: dict, limit: int = 10_000) -> dict:
    """The schema-3 report as a nested dict (K1): exact counts of all findings, and the first `limit` by emission (0: all), sorted.

    findings: `operators.findings`, with rule_ord; analysis: complete and the counts of the certificate. An incomplete analysis
    is invalid, whatever it found.
    """
    kept = retained(findings, limit, ["rule_ord", "emit"]) if limit else findings
    counted = [r.asDict() for r in groups(findings).collect()]  # a row for each rule of the contract
    of = {s: sum(g["count"] for g in counted if g["severity"] == s) for s in SEVERITIES}
    total = sum(of.values())
    shown = total if not limit else min(limit, total)
    rows = [r.asDict(True) for r in sort_findings(with_fingerprint(kept)).select(*FINDING, "fingerprint").collect()]  # at most `limit`
    status = "invalid" if not analysis.get("complete", False) else "fail" if of["error"] else "pass"
    summary = {"errors": of["error"], "warnings": of["warning"], "notes": of["note"], "retained": shown, "omitted": total - shown}
    return {"schema": 3, "status": status, "analysis": analysis, "summary": summary, "truncated": shown < total, "max_findings": limit or "all", "groups": counted, "findings": [{k: v for k, v in r.items() if v is not None} for r in rows]}


def report_json(found: dict) -> str:
    return json.dumps(found, indent=2, ensure_ascii=False) + "\n"


def report_text(found: dict) -> str:
    """The report for a reader (K2)."""
    out, n, a, s = [], "{:,}".format, found["analysis"], found["summary"]
    for f in found["findings"]:
        out.append(f"{f['severity']}[{f['id']}]: {f['message']}")
        if f.get("path"):
            out.append(f"  --> {f['path']}" + (f":{f['span']['line']}:{f['span']['column']}" if f.get("span") else ""))
        out += [f"   = rule: {f['rule']}", f"   = analysis: {f.get('analysis') or 'exact'}", *[f"   = {k}: {f[k]}" for k in ("reason", "help") if f.get(k)], ""]
    counts = [n(a.get(k, 0)) for k in ("rust_files", "base_source_instances", "derived_source_instances", "projection_work", "unresolved")]
    out.append("Analysis: {}; {} Rust files, {} base contexts, {} derived contexts, {} projection work, {} unresolved.".format("complete" if a.get("complete") else "incomplete", *counts))
    out += [f"Diagnostics: {n(s['errors'] + s['warnings'] + s['notes'])} total; showing {n(s['retained'])}.", "", "By rule:"]
    wide = [max([len(g[k]) for g in found["groups"]] or [0]) for k in ("id", "rule")]
    out += [f"  {g['id']:{wide[0]}}  {g['rule']:{wide[1]}}  {g['severity']:7}  {n(g['count'])}" for g in found["groups"]] or ["  none"]
    out += ["", f"Status: {found['status']} ({n(s['errors'])} errors, {n(s['warnings'])} warnings, {n(s['notes'])} notes)"]
    return "\n".join(out) + "\n"


def changes_text(changes: DataFrame) -> str:
    """Sorted changes for a reader, with their counts (K3)."""
    out, counts = [], {}
    for c in changes.collect():  # a diff is read by people
        counts[c.kind] = counts.get(c.kind, 0) + 1
        out += [f"{c.kind.upper()} {c.rail} {c.subject}", f"  {c.message}", *([f"  before: {c.before}", f"  after:  {c.after}"] if c.before is not None and c.after is not None else []), ""]
    names = {"grant": "grants", "revoke": "revokes"}
    return "\n".join([*out, "Changes: " + ", ".join(f"{counts.get(k, 0)} {names.get(k, k)}" for k in KINDS)]) + "\n"


def changes_json(changes: DataFrame) -> str:
    """The same as JSON, schema 1."""
    rows = [r.asDict() for r in changes.select("kind", "rail", "subject", "message", "before", "after").collect()]
    names = {"grant": "grants", "revoke": "revokes"}
    summary = {names.get(k, k): sum(r["kind"] == k for r in rows) for k in KINDS}
    return json.dumps({"schema": 1, "summary": summary, "changes": rows}, indent=2, ensure_ascii=False) + "\n"


def suggestions(candidates: DataFrame, wanted: DataFrame, top: int = 3) -> DataFrame:
    """(wanted, candidate, score): for each wanted path the nearest candidates.

    score: the lesser of the edit distance of the whole paths and that of the file names plus 2; kept up to a third
    of the wanted path's characters, between 2 and 12. wanted is a query set, sent to the candidates if it is small; candidates
    whose length alone is too far off never reach the distance.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    c, w = F.col("candidate"), F.col("wanted")
    most = F.least(F.greatest(F.floor(F.length(w) / 3), F.lit(2)), F.lit(12)).cast("int")
    score = F.least(F.levenshtein(c, w), F.levenshtein(name(c), name(w)) + 2)
    near = (F.abs(F.length(c) - F.length(w)) <= most) | (F.abs(F.length(name(c)) - F.length(name(w))) + 2 <= most)
    few = F.broadcast(wanted) if wanted.count() <= MAX_POLICY else wanted
    found = candidates.join(few, near).withColumn("score", score).filter(F.col("score") <= most)
    rank = F.row_number().over(W.partitionBy("wanted").orderBy("score", "candidate"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= top).select("wanted", "candidate", "score")
