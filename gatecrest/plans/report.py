"""Reports of an analysis: counts, orders, dashboards, JSON, Markdown and text, and the verdicts drawn from them."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.functions import scores
from gatecrest.functions.rules import RANK
from gatecrest.plans.exposure import Analysis

VERSION = "0.1.0"
DISCLOSURE = {
    "method": "static analysis of source text; nothing is executed",
    "covers": ["Python", "TypeScript", "JavaScript"],
    "limits": ["dynamic dispatch and reflection are followed as far as assignments show them", "calls across languages are not followed", "a gate counts only where the code can refuse", "a reported path is reachable in the source, not proven to run"],
}


def at_level(findings: DataFrame, level: str) -> DataFrame:
    """Findings of that severity or a graver one. Events are never filtered."""
    return findings.where(scores.rank(F.col("severity")) <= RANK[level])


def severity_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by severity and in total; one row for each of keys, or one in all."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in RANK))


def verdicts(findings: DataFrame, status: DataFrame, *keys: str) -> DataFrame:
    """(*keys, files, failed, skipped, total, severities, exit_code, conclusion), from the findings and the files' status (error, skipped): a row for each of keys, or one in all."""
    failed = F.col("error").isNotNull() & ~F.col("skipped")
    files = status.groupBy(*keys).agg(F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.count_if("skipped").alias("skipped"))
    counts = severity_counts(findings, *keys)
    both = files.join(counts, list(keys), "left") if keys else files.crossJoin(counts)  # a row each
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", *RANK)}
    code = scores.exit_code(F.col("failed"), n["critical"], n["warning"])
    conclusion = scores.check_conclusion(F.col("files") - F.col("skipped"), F.col("failed"), F.col("skipped"), n["critical"], n["warning"], n["info"])
    return both.select(*keys, "files", "failed", "skipped", *(v.alias(c) for c, v in n.items()), code.alias("exit_code"), conclusion.alias("conclusion"))


def coverage(status: DataFrame, *keys: str) -> DataFrame:
    """(*keys, partial, languages): whether files failed or were skipped, and the languages of those analysed."""
    return status.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("error").isNotNull() | F.col("skipped")), F.lit(False)).alias("partial"), F.sort_array(F.collect_set(F.when(F.col("error").isNull(), F.col("language")))).alias("languages"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(scores.rank(F.col("severity")), "file", "line", "tool", "operation")


def sorted_events(events: DataFrame) -> DataFrame:
    return events.orderBy("file", "line", "tool", "operation")


def top_findings(findings: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first findings of each severity, as many as its limit."""
    w = Window.partitionBy("severity").orderBy("file", "line", "tool", "operation")
    limit = F.lit(0)
    for s, n in limits.items():
        limit = F.when(F.col("severity") == s, n).otherwise(limit)
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def gate_coverage(events: DataFrame) -> DataFrame:
    present = F.count_if(F.col("gate_status") == "present")
    return events.agg(present.alias("present"), F.count_if(F.col("gate_status") == "absent").alias("absent"), scores.percent(present, F.count("*")).alias("rate"), F.countDistinct(F.when(F.col("gate_status") == "absent", F.col("operation"))).alias("ungated_operations"))


def frameworks(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Each framework that an event or a finding names, once."""
    return findings.select("framework").union(events.select("framework")).where("framework is not null and framework <> ''").distinct()


def by_framework(events: DataFrame, k: int = 8) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("framework"), F.lit("")), F.lit("generic")).alias("framework")
    return events.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "framework").limit(k)


def by_category(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def risk_matrix(events: DataFrame, k: int = 10) -> DataFrame:
    """Ungated events by tool: how many, the gravest severity, the operations."""
    r = F.min(scores.rank(F.col("severity")))
    t = events.where("gate_status = 'absent'").groupBy("tool").agg(F.count("*").alias("n"), r.alias("rank"), F.sort_array(F.collect_set("operation")).alias("operations"))
    return t.orderBy("rank", F.desc("n"), "tool").limit(k).withColumn("severity", scores.severity_name(F.col("rank"))).drop("rank")


def signatures(events: DataFrame) -> DataFrame:
    """Events that are alike but for their place: how many, the gravest severity, a framework, the files."""
    r = F.min(scores.rank(F.col("severity")))
    s = events.groupBy("tool", "operation", "category", "gate_status").agg(F.count("*").alias("n"), r.alias("rank"), F.min_by("framework", F.struct("file", "line")).alias("framework"), F.sort_array(F.collect_set("file")).alias("files"))
    return s.withColumn("severity", scores.severity_name(F.col("rank"))).drop("rank")


def roots_by_framework(roots: DataFrame) -> DataFrame:
    return roots.groupBy("framework").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "framework")


def diagnostics(a: Analysis) -> DataFrame:
    """One row for each project and language that has functions: functions, roots, operations, resolved edges and those across files, calls that lead nowhere, budget of depth, events at that depth, events past such calls."""
    place = lambda df: df.withColumn("language", F.when(scores.language(F.col("file")) == "python", "python").otherwise("script"))
    key = ["project", "language"]
    nodes = place(a.nodes.select("project", "gid", "file"))
    own = nodes.select("gid", "file", "language")
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    out = nodes.groupBy(*key).agg(F.count("*").alias("nodes"), scores.depth_budget(F.count("*")).alias("budget"))
    roots = a.roots.select("project", "gid").join(own, "gid").groupBy(*key).agg(F.count("*").alias("roots"), F.countDistinct("gid").alias("tools"))
    at = own.select("gid", "file")
    both = a.edges.join(at.toDF("src", "from_file"), "src").join(nodes.select(F.col("gid").alias("dst"), F.col("file").alias("to_file"), *key), "dst")
    edges = both.groupBy(*key).agg(F.count("*").alias("edges"), F.count_if(F.col("from_file") != F.col("to_file")).alias("cross_file_edges"))
    lost = a.unresolved.join(nodes, "gid").groupBy(*key).agg(F.sum("calls").alias("unresolved_calls"))
    events = a.events.groupBy(*key).agg(F.count_if("depth_limit_hit").alias("depth_limited_events"), F.count_if(F.size("unresolved_calls") > 0).alias("events_with_unresolved"))
    for part in (roots, count(place(a.operations.select("project", "file")), "operations"), edges, lost, events):
        out = out.join(part, key, "left")
    return out.na.fill(0)


def first_diagnostics(a: Analysis) -> DataFrame:
    """The scripts' diagnostics of the first project that has any, which a report of several carries; no row if none has."""
    return diagnostics(a).where("language = 'script'").orderBy("project").limit(1)


@dataclass
class Report:
    """A report of one project, small enough to be printed; findings and events as lists of dicts, in order. write_json() is for larger ones."""

    files: list[str]
    failed: list[dict]
    skipped: dict[str, int]
    findings: list[dict]
    events: list[dict]
    frameworks: list[str]
    counts: dict[str, int]
    exit_code: int
    conclusion: str
    diagnostics: dict | None = None

    @property
    def partial(self) -> bool:
        return bool(self.failed or self.skipped)


def leveled(a: Analysis, level: str, min_confidence: float | None) -> DataFrame:
    findings = at_level(a.findings, level)
    return findings if min_confidence is None else findings.where(F.col("confidence") >= min_confidence)


def report(a: Analysis, level: str = "info", min_confidence: float | None = None) -> Report:
    findings = leveled(a, level, min_confidence)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    status = rows(a.files.orderBy("project", "file"))
    found, events = rows(sorted_findings(findings)), rows(sorted_events(a.events))
    skipped: dict[str, int] = {}
    for s in status:
        if s["skipped"]:
            kind = s["file"].rpartition(".")[2] if "." in s["file"] else "other"
            skipped[kind] = skipped.get(kind, 0) + 1
    v = verdicts(findings, a.files).first()
    first = first_diagnostics(a).first()
    failed = [{"file": s["file"], "error": s["error"]} for s in status if s["error"] and not s["skipped"]]
    return Report([s["file"] for s in status if not s["error"]], failed, skipped, found, events, sorted(r.framework for r in frameworks(a.events, findings).collect()), {c: v[c] for c in ("total", *RANK)}, v.exit_code, v.conclusion, first.asDict() if first else None)


def metadata(timestamp: str | None, file_limit: int | None) -> dict:
    now = timestamp or datetime.datetime.now(datetime.UTC).isoformat()
    return {"version": VERSION, "timestamp": now, "file_limit": file_limit, "disclosure": DISCLOSURE}


def as_json(r: Report, repository: str = "", timestamp: str | None = None, file_limit: int | None = None) -> str:
    body = {"repository": repository, "files_analyzed": len(r.files), "total_findings": r.counts["total"], "total_events": len(r.events), "by_severity": {s: r.counts[s] for s in RANK}, "frameworks_detected": r.frameworks, "findings": r.findings, "events": r.events, "metadata": metadata(timestamp, file_limit) | {"failed_files": r.failed, "skipped_languages": r.skipped, "partial_coverage": r.partial, "diagnostics": r.diagnostics}}
    return json.dumps(body, indent=2, default=str)


def write_json(a: Analysis, path: str, level: str = "info", min_confidence: float | None = None, timestamp: str | None = None) -> None:
    """A report of any size as folders of JSON lines, written by the executors: findings, events, files, and summary with a row for each project."""
    findings = leveled(a, level, min_confidence)
    out = {"findings": sorted_findings(findings), "events": sorted_events(a.events), "files": a.files, "diagnostics": diagnostics(a)}
    out["summary"] = verdicts(findings, a.files, "project").withColumn("metadata", F.lit(json.dumps(metadata(timestamp, None))))
    for name, df in out.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def more(items: list[str], k: int) -> str:
    return ", ".join(items[:k]) + (f" (+{len(items) - k} more)" if len(items) > k else "")


def summary_line(r: Report) -> str:
    return f"{r.counts['total']} findings ({r.counts['critical']} critical, {r.counts['warning']} warning, {r.counts['info']} info) in {len(r.files)} files"


def as_text(r: Report, summary: bool = False, quiet: bool = False) -> str:
    if summary:
        return summary_line(r)
    out = []
    if not r.findings:
        out.append("No findings: no tool was found to reach a sensitive operation without a gate.")
    for f in r.findings:
        out.append(f"[{f['severity'].upper()}] {f['file']}:{f['line']}  {f['operation']}\n    tool {f['tool']} ({f['framework']}) via {' -> '.join(f['call_path'])}\n    {f['note']}")
        if f["unresolved_calls"]:
            out.append("    unresolved: " + more(f["unresolved_calls"], 5))
    plain = [e for e in r.events if not e["classification"]]
    if plain and not quiet:
        out.append(f"{len(plain)} events were not classified: gated, or registrations without a traced operation.")
    if r.failed:
        out.append("Failed: " + more([f"{x['file']} ({x['error']})" for x in r.failed], 5))
    return "\n".join([*out, summary_line(r)])


def as_markdown(r: Report, limits: dict[str, int] | None = None) -> str:
    limits = limits or {"critical": 5, "warning": 5, "info": 3}
    out = ["## Exposure report", "", summary_line(r) + "."]
    for s, k in limits.items():
        part = [f for f in r.findings if f["severity"] == s]
        if part:
            out += ["", f"### {s.capitalize()} ({len(part)})", ""]
            out += [f"- `{f['file']}:{f['line']}` **{f['operation']}** from tool `{f['tool']}` ({f['framework']})" for f in part[:k]]
            out += [f"- and {len(part) - k} more"] if len(part) > k else []
    if r.partial:
        out += ["", f"Coverage is partial: {len(r.failed)} files failed, {sum(r.skipped.values())} were skipped."]
    return "\n".join(out)


def bar(part: int, whole: int, width: int = 20) -> str:
    full = round(width * part / whole) if whole else 0
    return "#" * full + "." * (width - full)


def dashboard(a: Analysis) -> str:
    """Six panels of aggregates, each computed as a DataFrame; only its few rows come here."""
    c = severity_counts(a.findings).first()
    g = gate_coverage(a.events).first()
    sig = signatures(a.events)
    s = sig.agg(F.sum("n").alias("total"), F.count("*").alias("unique")).first()
    out = [f"Findings: {c.total} ({', '.join(f'{c[k]} {k}' for k in RANK)})", f"Gates: {g.present} present, {g.absent} absent  {bar(g.present, g.present + g.absent)} {g.rate}%; {g.ungated_operations} distinct ungated operations", "Frameworks:"]
    out += [f"  {x.framework:<24}{x.n}" for x in by_framework(a.events).collect()] + ["Categories:"]
    out += [f"  {x.category:<24}{x.n}" for x in by_category(a.events).collect()] + ["Tools at risk:"]
    out += [f"  {x.tool:<24}{x.severity:<10}{x.n:>4}  {more(x.operations, 8)}" for x in risk_matrix(a.events).collect()]
    out += [f"Signatures: {s.unique} of {s.total or 0} events (ratio {round((s.total or 0) / s.unique, 1) if s.unique else 0.0})"]
    return "\n".join(out)
