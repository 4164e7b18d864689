"""Which registered tools reach a sensitive operation, by which path, and whether a gate stands on it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.functions import frameworks, rules, scores
from gatecrest.operators import by_project, matching, reach
from gatecrest.operators.checkpoints import cut
from gatecrest.operators.resolve import names_of
from gatecrest.sources.python_facts import python_facts

#: Operations of these names can't be undone: critical whatever the rule says.
IRREVERSIBLE = "(rmtree|remove|unlink|rmdir|eval|exec|run|Popen|call|system|popen|create_subprocess_exec|create_subprocess_shell)$"
SCRIPT_IRREVERSIBLE = r"^(child_process[.](exec|spawn)(Sync)?|Bun[.](spawn(Sync)?|shell)|Deno[.](run|Command)|fs[.](unlink|rm|rmdir)(Sync)?|eval|Function)$"
LABELS = {"tool_call": "Tool invocation", "shell_execution": "Shell command execution", "file_operation": "File system operation", "api_call": "External API call", "database_operation": "Database operation", "code_execution": "Dynamic code execution"}
SCRIPT_LABELS = LABELS | {"api_call": "HTTP operation", "code_execution": "Code execution"}
UNGATED = "unauthorized_action"
INSTRUCTION = "(?i)(prompt|instruction|message|context|query|task)"
COLUMNS = ["project", "file", "line", "column", "operation", "code_snippet", "category", "severity", "tool", "framework", "tool_file", "tool_line", "call_path", "gate_status", "classification", "note", "evidence_kind", "supporting_evidence", "resource", "changes_state", "involves_cross_file", "unresolved_calls", "depth_limit_hit", "confidence", "language"]


@dataclass
class Analysis:
    """files: every file with what became of it; events: one for each tool and operation it reaches; findings: those without a gate."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    operations: DataFrame
    events: DataFrame
    findings: DataFrame
    #: (gid, unresolved, calls): of each function with calls that lead to no function of the project, their callees and number.
    unresolved: DataFrame


def exploded(facts: DataFrame, table: str) -> DataFrame:
    return facts.select("project", "file", F.explode(table).alias("x")).select("project", "file", "x.*")


def gid(*parts: str) -> Column:
    """Identity of a node across projects."""
    return F.concat_ws("\x1f", *parts)


def node_of(fn: Column, cls: Column) -> Column:
    return F.when(fn.isNotNull(), F.concat(F.col("file"), F.lit(":"), F.when(cls.isNotNull(), F.concat(cls, F.lit("."))).otherwise(""), fn))


def nodes_of(facts: DataFrame, last: bool = True) -> DataFrame:
    """One row for each function: of several with one name in a file the last counts."""
    f = exploded(facts, "functions").withColumn("node", node_of(F.col("name"), F.col("cls")))
    one = matching.first_by(f, ["project", "node"], F.col("ord").desc() if last else F.col("ord"))
    return one.withColumn("gid", gid("project", "node"))


def dotted(identity: Column) -> Column:
    """A chain that leads out of the project, or to a builtin, as a dotted identity; null for others."""
    bare = F.regexp_replace(identity, r"\(\)|\[\]", "")
    builtin = F.regexp_extract(bare, r"^[^.]+", 0).isin(*frameworks.BUILTINS)
    return F.when(identity.startswith("@"), F.substring(bare, F.lit(2), F.length(bare))).when(identity.startswith("#") | identity.startswith("module:"), None).when(builtin, F.concat(F.lit("builtins."), bare))


def argument(keyword: Column, position: Column) -> Column:
    """The argument of that keyword, else that position among those without a keyword."""
    by_name = F.filter("args", lambda a: a["name"].eqNullSafe(keyword))
    plain = F.filter("args", lambda a: a["name"].isNull())
    return F.coalesce(F.get(by_name, F.lit(0)), F.when(position >= 0, F.get(plain, position)))


def resource(args: str = "args") -> Column:
    """The first string or reference in the arguments."""
    found = F.filter(F.transform(args, lambda a: F.coalesce(F.get(a["literals"], F.lit(0)), F.get(a["refs"], F.lit(0)))), lambda v: v.isNotNull())
    return F.get(found, F.lit(0))


def open_severity(severity: Column, is_open: Column) -> Column:
    mode = argument(F.lit("mode"), F.lit(1))
    value = F.coalesce(F.get(mode["literals"], F.lit(0)), mode["text"], F.lit(""))
    return F.when(is_open, F.when(value.rlike("(?i)[wax+]"), "warning").otherwise("info")).otherwise(severity)


def with_rules(calls: DataFrame, resolved_rules: list, fallback_rules: list) -> DataFrame:
    """Operations: calls that a rule matches, by their identity or else by the text of the callee. Of several identities the one of the first rule counts."""
    by = lambda name, ordinal, table: matching.lookup(ordinal, [getattr(r, name) for r in table])
    c = calls.withColumn("s", matching.first_match("identity", [r.regex for r in resolved_rules]))
    c = matching.first_by(c, ["rid"], F.col("s").asc_nulls_last(), "identity")
    c = c.withColumn("f", F.when(F.col("s").isNull(), matching.first_match("callee", [r.regex for r in fallback_rules]))).where("s is not null or f is not null")
    out = c
    for name in ("category", "severity", "hint", "writes"):
        out = out.withColumn(name, F.coalesce(by(name, F.col("s"), resolved_rules), by(name, F.col("f"), fallback_rules)))
    return out.withColumn("operation", F.when(F.col("s").isNotNull(), F.col("identity")).otherwise(F.col("callee"))).withColumn("kind", F.when(F.col("s").isNotNull(), "semantic").otherwise("heuristic"))


def along_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with gated, files (distinct on the path) and tainted: the parameters of the last node that the root's input reaches."""
    key = ["root", "node"]
    at = paths.select(*key, F.posexplode("path").alias("k", "gid")).join(nodes.select("gid", "gate", "file", "params"), "gid")
    seen = at.groupBy(*key).agg(F.bool_or("gate").alias("gated"), F.countDistinct("file").alias("files"), F.max(F.when(F.col("k") == 0, F.size("params"))).alias("n"))
    hops = paths.where(F.size("path") > 1).select(*key, F.expr("posexplode(transform(sequence(1, size(path) - 1), i -> named_struct('src', element_at(path, i), 'dst', element_at(path, i + 1))))").alias("k", "h"))
    steps = hops.select(*key, "k", "h.src", "h.dst").join(edges.select("src", "dst", "flow"), ["src", "dst"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "flow"))).alias("steps"))
    start = F.when(F.coalesce("n", F.lit(0)) > 0, F.sequence(F.lit(0), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    fold = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<k:int,flow:array<struct<s:int,t:int>>>>")), start, lambda acc, s: F.array_distinct(F.transform(F.filter(s["flow"], lambda x: F.array_contains(acc, x["s"])), lambda x: x["t"])))
    return paths.join(seen, key).join(steps, key, "left").withColumn("tainted", fold).drop("steps", "n")


def edges_of(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, ord, flow) of resolved calls (src, dst, ord, args): the first call counts for an edge's order and the parameters it passes on."""
    one = matching.first_by(targets, ["src", "dst"], "ord").join(nodes.select(F.col("gid").alias("dst"), F.col("params").alias("p"), F.col("cls").alias("dst_cls")), "dst")
    shift = F.when(F.col("dst_cls").isNotNull() & F.get("p", F.lit(0)).isin("self", "cls"), 1).otherwise(0)
    to = lambda a, k: F.when(a["name"].isNotNull(), F.array_position("p", a["name"]).cast("int") - 1).otherwise(k + shift)
    flow = F.flatten(F.transform("args", lambda a, k: F.transform(F.coalesce(a["params"], F.array().cast("array<int>")), lambda s: F.struct(s.alias("s"), to(a, k).cast("int").alias("t")))))
    return one.select("src", "dst", "ord", flow.alias("flow"))


def open_calls(placed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(caller, unresolved, calls) of the calls (rid, caller, ord, callee) that aren't in resolved (rid): the distinct callees in order, and how many calls."""
    rest = placed.join(resolved.select("rid").distinct(), "rid", "left_anti").groupBy("caller", "callee").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    by = rest.groupBy("caller").agg(F.sort_array(F.collect_list(F.struct("ord", "callee"))).alias("x"), F.sum("n").alias("calls"))
    return by.select("caller", F.transform("x", lambda x: x["callee"]).alias("unresolved"), "calls")


def within_budget(paths: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shortest paths no deeper than their project's budget, which grows with the logarithm of its functions; at_limit: those as deep as that, beyond which nothing is followed."""
    budget = nodes.groupBy("project").agg(scores.depth_budget(F.count("*")).alias("budget"))
    limits = roots.select(F.col("gid").alias("root"), "project").join(F.broadcast(budget), "project").select("root", "budget")  # a row a project
    return paths.join(limits, "root").where("depth <= budget").withColumn("at_limit", F.col("depth") >= F.col("budget")).drop("budget", "depth")


def along(paths: DataFrame, unresolved: DataFrame) -> DataFrame:
    """paths with unresolved: the distinct callees, in the path's order, of calls on it that lead to no function of the project."""
    key = ["root", "node"]
    at = paths.select(*key, F.posexplode("path").alias("k", "caller")).join(unresolved.select("caller", "unresolved"), "caller")
    lists = at.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "unresolved"))).alias("x"))  # at most a struct a node of the path
    lists = lists.select(*key, F.array_distinct(F.flatten(F.transform("x", lambda x: x["unresolved"]))).alias("unresolved"))
    return paths.join(lists, key, "left").withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))


def events_of(nodes: DataFrame, edges: DataFrame, roots: DataFrame, operations: DataFrame, unresolved: DataFrame, language: str, max_nodes: int = reach.MAX_NODES) -> DataFrame:
    """Events of tools that reach operations, and one for each tool that reaches none.

    Python tools take the first path in depth-first order, and one event for each tool, line and callee; script tools a
    shortest path to each node, within the project's budget of depth, with what stays unresolved on it.
    """
    script = language == "script"
    start = roots.select("project", F.col("gid").alias("root"))
    walk = edges.select(F.element_at(F.split("src", "\x1f"), 1).alias("project"), "src", "dst", "ord")
    if script:
        paths = within_budget(by_project.paths(start, walk, False, scores.MAX_DEPTH), roots, nodes)
    else:
        paths = by_project.paths(start, walk, True, max_nodes).withColumn("at_limit", F.lit(False))
    paths = paths.select("root", "node", "path", "ords", "at_limit")
    ops = operations.withColumnRenamed("caller", "node")
    useful = along_paths(paths.join(ops.select("node").distinct(), "node", "left_semi"), nodes, edges)
    useful = cut(along(useful, unresolved) if script else useful.withColumn("unresolved", F.array().cast("array<string>")))
    tools = roots.join(nodes.select("gid", F.col("name").alias("tool"), F.col("file").alias("tool_file"), F.col("start").alias("tool_line"), F.col("gate").alias("tool_gate")), "gid").withColumnRenamed("gid", "root")
    hit = useful.join(ops, "node").join(tools.drop("project"), "root")
    if not script:
        hit = matching.first_by(hit, ["project", "tool_file", "tool", "file", "line", "operation"], "tool_file", "tool_line", "ords", "ord")
    flows_in = F.exists("args", lambda a: F.coalesce(F.size(F.array_intersect(a["params"], F.col("tainted"))) > 0, F.lit(False)))
    hit = hit.withColumn("flows", flows_in).withColumn("evidence_kind", F.col("kind") if script else F.when(F.col("kind") == "heuristic", "heuristic").when(F.col("flows"), "structural").otherwise("semantic"))
    labels = SCRIPT_LABELS if script else LABELS
    label = F.get(F.array(*(F.lit(v) for v in labels.values())), F.array_position(F.array(*(F.lit(k) for k in labels)), F.col("category")).cast("int") - 1)
    severity = F.when(F.col("operation").rlike(SCRIPT_IRREVERSIBLE if script else IRREVERSIBLE), "critical").otherwise(F.col("severity"))
    names = F.transform("path", lambda g: F.element_at(F.split(g, "\x1f"), 2))
    cross = F.col("files") > 1
    hops = F.size("path") - 1
    instruct = F.exists("args", lambda a: F.coalesce(F.exists(a["refs"], lambda r: r.rlike(INSTRUCTION)), F.lit(False)))
    note = F.concat_ws(
        " ",
        F.concat(F.lit('Tool "'), F.col("tool"), F.lit('" ('), F.col("framework"), F.lit(") can reach "), F.col("operation"), F.when(hops > 0, F.concat(F.lit(" through "), hops.cast("string"), F.lit(" call(s)"))).otherwise(""), F.lit(".")),
        F.when(cross, "The path crosses files."),
        F.when(F.col("gated"), "A policy gate stands on the path, so this is no finding.").otherwise("No policy gate was found on the path."),
        F.when(F.col("flows"), "Input of the tool flows into the arguments."),
        F.when(instruct, "An argument looks like an instruction or context."),
        F.when(F.col("resource").isNotNull(), F.concat(F.lit("Resource: "), F.col("resource"), F.lit("."))),
    )
    evidence = F.array(F.concat(F.lit("Tool registration: "), F.col("evidence")), F.concat(F.lit("Operation: "), F.col("operation"), F.lit(" by "), F.when(F.col("kind") == "semantic", "identity").otherwise("name")))
    none = F.array().cast("array<string>")
    gated, lost, limit = F.col("gated"), F.size("unresolved"), F.col("at_limit")
    if script:
        confidence = scores.script_confidence(F.col("evidence_kind"), lost, limit, F.size("path"))
    else:
        confidence = scores.confidence(F.col("evidence_kind"), F.lit(2), lost, limit, gated)
    made = hit.select("project", "file", "line", F.col("col").alias("column"), F.concat(label, F.lit(": "), F.col("operation")).alias("operation"), F.col("snippet").alias("code_snippet"), "category", severity.alias("severity"), "tool", "framework", "tool_file", "tool_line", names.alias("call_path"), F.when(gated, "present").otherwise("absent").alias("gate_status"), F.when(~gated, UNGATED).alias("classification"), note.alias("note"), "evidence_kind", evidence.alias("supporting_evidence"), "resource", "changes_state", cross.alias("involves_cross_file"), F.col("unresolved").alias("unresolved_calls"), limit.alias("depth_limit_hit"), (confidence / 100).alias("confidence"), F.lit(language).alias("language"))
    bare = reach.unreached(tools, useful.select("root")).join(unresolved.select(F.col("caller").alias("root"), "unresolved"), "root", "left")
    alone = scores.script_confidence(F.lit("semantic"), F.size(F.coalesce("unresolved", none)), F.lit(False), F.lit(1)) / 100 if script else F.lit(0.88)
    text = F.lit("Registered as a tool; no operation was traced from it.")
    lone = bare.select("project", F.col("tool_file").alias("file"), F.col("tool_line").alias("line"), F.lit(0).alias("column"), F.concat(F.lit("Agent tool registration: "), F.col("tool")).alias("operation"), F.col("tool").alias("code_snippet"), F.lit("tool_call").alias("category"), F.lit("info").alias("severity"), "tool", "framework", "tool_file", "tool_line", F.array(F.element_at(F.split("root", "\x1f"), 2)).alias("call_path"), F.when(F.col("tool_gate"), "present").otherwise("absent").alias("gate_status"), F.lit(None).cast("string").alias("classification"), text.alias("note"), F.lit("semantic").alias("evidence_kind"), F.array(F.concat(F.lit("Tool registration: "), F.col("evidence")), text).alias("supporting_evidence"), F.lit(None).cast("string").alias("resource"), F.lit(False).alias("changes_state"), F.lit(False).alias("involves_cross_file"), F.coalesce("unresolved", none).alias("unresolved_calls"), F.lit(False).alias("depth_limit_hit"), alone.alias("confidence"), F.lit(language).alias("language"))
    return made.unionByName(lone).select(*COLUMNS)


def python_roots(facts: DataFrame, calls: DataFrame, identities: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(project, node, gid, framework, evidence): calls that register tools come first, then decorators, then classes; within these the first in the files' order."""
    table = frameworks.PYTHON_CALLS
    known = identities.where("identity is not null").join(calls, "rid").withColumn("k", matching.first_match("identity", [t[0] for t in table])).where("k is not null")
    pick = lambda n: matching.lookup(F.col("k"), [t[n] for t in table])
    arg = argument(pick(1), pick(2))
    known = cut(known.select("project", "file", "fn", "cls", "line", "ord", "identity", pick(3).alias("framework"), F.explode(arg["refs"]).alias("chain")).withColumn("rid", F.concat_ws("|", F.lit("t"), "project", "file", F.col("ord").cast("string"), "chain")))
    keyed = exploded(facts, "dispatch").join(known.where("framework = 'openai'").select("project", "file").distinct(), ["project", "file"], "left_semi")
    keyed = keyed.select("project", "file", "key", F.concat_ws("|", F.lit("k"), "project", "file", "key", "ref").alias("rid"), F.col("ref").alias("chain")).distinct()
    none = F.lit(None).cast("string")
    refs = known.select("rid", "project", "file", "fn", "cls", "chain").unionByName(keyed.select("rid", "project", "file", none.alias("fn"), none.alias("cls"), "chain")).distinct()
    found = by_project.resolved(refs, names)
    tools = known.drop("identity").join(found, "rid")
    declared = tools.where("identity like '#%'").select("project", "file", "line", "ord", "framework", F.expr("substring(identity, 2)").alias("key"))
    dispatched = declared.join(keyed.join(found.where("node is not null").select("rid", "node"), "rid").select("project", "file", "key", "node"), ["project", "file", "key"])
    by_call = tools.where("node is not null").select("project", "file", "line", "ord", "framework", "node").unionByName(dispatched.select("project", "file", "line", "ord", "framework", "node")).select("project", "node", "framework", F.concat(F.col("framework"), F.lit(" call at line "), F.col("line").cast("string")).alias("evidence"), F.lit(0).alias("phase"), F.col("file").alias("at"), "ord")
    imports = exploded(facts, "names").where("kind = 'import'").select("project", "file", F.col("name").alias("decorator"), F.expr("substring(refs[0], 2)").alias("target"))
    d = nodes.select("project", "file", "node", "ord", F.explode("decorators").alias("decorator")).join(imports, ["project", "file", "decorator"], "left")
    label = matching.lookup(matching.first_match("target", [p for p, _ in frameworks.PYTHON_DECORATORS]), [f for _, f in frameworks.PYTHON_DECORATORS])
    other = F.when(F.col("target").rlike(r"(^|[.])tool$"), F.substring_index("target", ".", 1)).when(F.col("decorator").rlike(r"[.](tool|run_tool)$"), "pydantic-ai")
    by_decorator = d.select("project", "node", F.coalesce(label, other).alias("framework"), F.concat(F.lit("decorator "), F.col("decorator"), F.coalesce(F.concat(F.lit(" imported as "), F.col("target")), F.lit(""))).alias("evidence"), F.lit(1).alias("phase"), F.col("file").alias("at"), "ord").where("framework is not null")
    c = exploded(facts, "classes").withColumn("base", F.get(F.filter("bases", lambda b: F.element_at(F.split(b, "[.]"), -1).isin(*frameworks.TOOL_BASES)), F.lit(0)))
    component = F.exists("decorators", lambda x: (x == "component") | x.endswith(".component"))
    simple = F.substring_index("base", ".", -1)
    named = F.lit("class-based-tool")
    for b, f in frameworks.BASE_FRAMEWORK.items():
        named = F.when(simple == b, f).otherwise(named)
    c = c.where(F.col("base").isNotNull() | component).select("project", "file", F.col("name").alias("cls"), F.when(component, "haystack").otherwise(named).alias("framework"), "base")
    by_class = nodes.where(F.col("name").isin(*frameworks.RUN_METHODS)).join(c, ["project", "file", "cls"]).select("project", "node", "framework", F.concat(F.lit("class "), F.col("cls"), F.lit(" extends "), F.coalesce("base", F.lit("component"))).alias("evidence"), F.lit(2).alias("phase"), F.col("file").alias("at"), "ord")
    every = by_call.unionByName(by_decorator).unionByName(by_class)
    first = matching.first_by(every, ["project", "node"], "phase", "at", "ord", "framework").select("project", "node", "framework", "evidence")
    return first.withColumn("gid", gid("project", "node")).join(nodes.select("gid"), "gid", "left_semi")


def analyse_python(files: DataFrame) -> tuple[DataFrame, ...]:
    """facts, nodes, edges, roots, operations, events and unresolved calls of the Python files."""
    facts = cut(python_facts(files))
    names = cut(names_of(facts))
    calls = cut(exploded(facts, "calls").withColumn("rid", F.concat_ws("|", F.lit("c"), "project", "file", F.col("ord").cast("string"))))
    nodes = nodes_of(facts)
    decorated = nodes.select("project", "file", "gid", F.explode("decorators").alias("chain")).withColumn("rid", F.concat_ws("|", F.lit("d"), "gid", "chain"))
    none = F.lit(None).cast("string")
    refs = calls.select("rid", "project", "file", "fn", "cls", "chain").unionByName(decorated.select("rid", "project", "file", none.alias("fn"), none.alias("cls"), "chain").distinct())
    found = by_project.resolved(refs, names)
    gates = decorated.join(found.where("node is not null").select("rid", F.col("node").alias("decorator")), "rid").join(nodes.where("decorator_gate").select("project", F.col("node").alias("decorator")), ["project", "decorator"]).select("gid", F.lit(True).alias("by_decorator")).distinct()
    nodes = cut(nodes.join(gates, "gid", "left").withColumn("gate", F.col("gate") | F.coalesce("by_decorator", F.lit(False))).drop("by_decorator"))
    identities = cut(found.select("rid", "node", dotted(F.col("identity")).alias("identity")))
    roots = cut(python_roots(facts, calls, identities, nodes, names))
    placed = calls.withColumn("_n", node_of(F.col("fn"), F.col("cls"))).where("_n is not null").withColumn("caller", gid("project", "_n")).drop("_n")
    placed = cut(placed.join(nodes.select(F.col("gid").alias("caller")), "caller", "left_semi"))
    to = placed.join(identities.where("node is not null").select("rid", "node"), "rid").select("rid", F.col("caller").alias("src"), gid("project", "node").alias("dst"), "ord", "args")
    edges = cut(edges_of(to, nodes))
    ops = with_rules(placed.join(identities.select("rid", "identity"), "rid", "left"), rules.PYTHON_RESOLVED, rules.PYTHON_FALLBACK)
    ops = ops.withColumn("severity", open_severity(F.col("severity"), (F.col("callee") == "open") | F.col("identity").eqNullSafe(F.lit("builtins.open"))))
    ops = ops.withColumn("changes_state", F.col("severity").isin("warning", "critical")).withColumn("resource", resource())
    ops = cut(ops.select("project", "file", "caller", "ord", "line", "col", "operation", "snippet", "category", "severity", "kind", "resource", "changes_state", "args"))
    unresolved = cut(open_calls(placed, to))
    return facts, nodes, edges, roots, ops, cut(events_of(nodes, edges, roots, ops, unresolved, "python")), unresolved


def analyse(files: DataFrame, min_confidence: float | None = None) -> Analysis:
    """Analyse a table (project, file, language, source, error) of sources; projects don't see one another.

    Files that can't be read or parsed are in ``files`` with their error. Findings below min_confidence are dropped; events
    are not. A file with a null text counts as unreadable; an empty one has no facts; no rows give no rows.
    """
    from gatecrest.plans.script_exposure import analyse_scripts

    files = cut(files)
    scripts = {r.s for r in files.where("language is not null").select((F.col("language") != "python").alias("s")).distinct().collect()}
    parts = [f for f, s in ((analyse_python, False), (analyse_scripts, True)) if s in scripts] or [analyse_python]
    with ThreadPoolExecutor(2) as pool:  # neither language needs the other, so their jobs overlap
        done = list(pool.map(lambda f: f(files), parts))
    facts, nodes, edges, roots, ops, events, unresolved = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), t) for t in zip(*done))
    failed = facts.where("error is not null").select("project", "file", F.col("error").alias("failure"))
    status = files.select("project", "file", "language", "error").join(failed, ["project", "file"], "left").select("project", "file", "language", F.coalesce("error", "failure").alias("error"), F.col("language").isNull().alias("skipped"))
    findings = events.where(F.col("classification").isNotNull())
    if min_confidence is not None:
        findings = findings.where(F.col("confidence") >= min_confidence)
    return Analysis(cut(status), nodes, edges, roots, ops, events, findings, unresolved.withColumnRenamed("caller", "gid"))
