"""Scalar functions of events: severity ranks, confidence, snippets, depth budgets, exit codes, file routing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecrest.functions.rules import RANK

LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
EXCLUDED = ("node_modules", "dist", "build", ".git", "venv", ".venv", "__pycache__", "tests", "test", "__tests__")


def rank(severity: Column) -> Column:
    out = F.when(severity == "critical", RANK["critical"])
    for name in ("warning", "info", "suppressed"):
        out = out.when(severity == name, RANK[name])
    return out


def severity_name(ranked: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in RANK)), ranked)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.][^./]+$", 0))


def language(path: Column) -> Column:
    """python, typescript, javascript, or null for a file that isn't analysed."""
    e = extension(path)
    out = None
    for name in ("python", "typescript", "javascript"):
        hit = e.isin(*(x for x, y in LANGUAGES.items() if y == name))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def glob_regex(glob: str) -> str:
    """Anchored; ``**`` is anything, ``*`` anything within a directory; ``**/x/**`` also excludes x at the root."""
    out = re.sub(r"([.+(){}^$|\[\]])", r"\\\1", glob).replace("**/", "\0").replace("**", "\1").replace("*", "[^/]*")
    return "^" + out.replace("\0", "(?:.*/)?").replace("\1", ".*") + "$"


def confidence(kind: Column, evidence: Column, unresolved: Column, depth_limited: Column, gated: Column) -> Column:
    """In hundredths: 76, by kind of evidence, for pieces of evidence, against what is unresolved, cut off or gated; 45 to 98."""
    c = F.lit(76) + F.when(kind == "structural", 18).when(kind == "semantic", 12).when(kind == "heuristic", -4).otherwise(0)
    c = c + F.least(F.lit(8), evidence * 2) - F.when(unresolved > 0, 8).otherwise(0) - F.when(depth_limited, 10).otherwise(0) - F.when(gated, 4).otherwise(0)
    return F.greatest(F.lit(45), F.least(F.lit(98), c))


def script_confidence(kind: Column, unresolved: Column, depth_limited: Column, path_length: Column) -> Column:
    c = F.lit(80) + F.when(kind == "semantic", 10).otherwise(0) - F.when(depth_limited, 10).otherwise(0) - F.least(unresolved, F.lit(3)) * 5 + F.when(path_length <= 2, 5).otherwise(0)
    return F.greatest(F.lit(45), F.least(F.lit(98), c))


#: Edges that a path of scripts has at most.
MAX_DEPTH = 20


def depth_budget(nodes: Column) -> Column:
    return F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(10), F.ceil(F.log2(F.greatest(nodes, F.lit(1)).cast("double"))).cast("int") + 8)).cast("int")


def snippet(code: Column, width: int = 60) -> Column:
    """Without a leading assignment, cut to width."""
    s = F.regexp_replace(F.trim(code), r"^[A-Za-z_][A-Za-z0-9_.]* *= *", "")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("..."))).otherwise(s)


def exit_code(failed: Column, critical: Column, warning: Column) -> Column:
    return F.when(failed > 0, 3).when(critical > 0, 2).when(warning > 0, 1).otherwise(0)


def check_conclusion(analysed: Column, failed: Column, skipped: Column, critical: Column, warning: Column, info: Column) -> Column:
    return F.when(analysed - failed <= 0, "failure").when(critical > 0, "failure").when((failed > 0) | (skipped > 0), "neutral").when((warning > 0) | (info > 0), "neutral").otherwise("success")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def one_of(column: Column, values: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))
