"""The engine's operators on ordinary tables, each beside the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatecrest.functions import scores
from gatecrest.operators import matching, reach
from gatecrest.operators.checkpoints import cut
from gatecrest.plans import report
from gatecrest.streaming import triggers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Pattern, category, severity, literals of which the text must hold one; in order of precedence.
TEXT_RULES = (
    ("AKIA[0-9A-Z]{16}", "code_execution", "critical", ("AKIA",)),
    ("(password|token) *= *[^ ]{8}", "shell_execution", "critical", ("password", "token")),
    ("[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]{2,}", "api_call", "warning", ("@",)),
    ("(^|[^0-9])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "api_call", "warning", ()),
    ("[Ll]icen[sc]e|[Cc]opyright", "file_operation", "warning", ("icen", "opyright")),
    ("[A-Z]{4,}!!", "tool_call", "info", ("!!",)),
    (" [|] ", "database_operation", "info", (" | ",)),
)
PATTERNS, NEEDS = [r[0] for r in TEXT_RULES], [r[3] for r in TEXT_RULES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case_sql(text: str, values: list | None = None) -> str:
    """First match in SQL: the ordinal, or the value at it."""
    v = values or range(len(PATTERNS))
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {x!r}" for p, x in zip(PATTERNS, v)) + " END"


CATEGORY, SEVERITY = [r[1] for r in TEXT_RULES], [r[2] for r in TEXT_RULES]
#: One event for each document that a rule matches, with the columns that reports read; a document that the labels call good counts as gated.
EVENTS = f"""e AS (SELECT d.source AS file, d.doc_id AS line, d.source AS tool, d.lang AS framework, {case_sql("d.text")} AS rule, {case_sql("d.text", CATEGORY)} AS category,
 {case_sql("d.text", SEVERITY)} AS severity, CASE WHEN l.quality = 1 THEN 'present' ELSE 'absent' END AS gate_status, d.n_chars
 FROM documents d LEFT JOIN labels l USING (doc_id)), ev AS (SELECT *, category || ': rule ' || rule AS operation, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM e WHERE rule IS NOT NULL)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("source").alias("tool"), F.col("lang").alias("framework"), "n_chars", "text")
    docs = matching.matched(docs, "text", PATTERNS, "rule", NEEDS).drop("text")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("line"), "quality")
    out = docs.join(labels, "line", "left").withColumn("category", matching.lookup(F.col("rule"), CATEGORY)).withColumn("severity", matching.lookup(F.col("rule"), SEVERITY))
    out = out.withColumn("operation", F.concat("category", F.lit(": rule "), F.col("rule").cast("string"))).withColumn("gate_status", F.when(F.col("quality") == 1, "present").otherwise("absent"))
    return out.select("file", "line", "tool", "framework", "rule", "operation", "category", "severity", "gate_status", "n_chars")


def ungated(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("gate_status = 'absent'")


def ownership(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions, and the edges region, nation, customer, order."""
    t = lambda n: table(spark, d, n)
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = t("nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").alias("ord"))
    edges = edges.union(t("customer").select(name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey").cast("int")))
    edges = edges.union(t("orders").select(name("c", "o_custkey"), name("o", "o_orderkey"), F.col("o_orderkey").cast("int")))
    return t("region").select(name("r", "r_regionkey").alias("root")), edges


@query("""SELECT 'r' || r_regionkey AS tool, 'o' || o_orderkey AS node, 'r' || r_regionkey || '>n' || n_nationkey || '>c' || c_custkey || '>o' || o_orderkey AS path,
 4::INTEGER AS hops, CASE WHEN n_nationkey % 5 = 0 THEN 'present' ELSE 'absent' END AS gate, n_ops
 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
 JOIN (SELECT l_orderkey, count(*)::BIGINT AS n_ops FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def exposure_reach(spark: SparkSession, d: str) -> DataFrame:
    """Which regions reach an order with returned lines, by which path, and whether a gated nation lies on it."""
    roots, edges = ownership(spark, d)
    ops = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n_ops")).select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node"), "n_ops")
    paths = reach.simple_paths(roots, edges, 4)
    gate = F.exists("path", lambda p: p.rlike("^n[0-9]*[05]$"))
    return paths.join(ops, "node").select(F.col("root").alias("tool"), "node", F.array_join("path", ">").alias("path"), F.size("path").alias("hops"), F.when(gate, "present").otherwise("absent").alias("gate"), "n_ops")


TRANSITIONS = "t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), g AS (SELECT DISTINCT src, dst FROM t WHERE dst IS NOT NULL AND src <> dst)"


def transitions(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").distinct()
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("dst")))


@query(f"""WITH RECURSIVE {TRANSITIONS}, p AS (SELECT src AS root, src AS node, [src] AS path FROM (SELECT DISTINCT src FROM g)
 UNION ALL SELECT p.root, g.dst, list_append(p.path, g.dst) FROM p JOIN g ON p.node = g.src WHERE NOT list_contains(p.path, g.dst))
 SELECT root, node, array_to_string(path, '>') AS path, len(path)::INTEGER AS hops FROM p""")
def reach_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """All simple paths of a cyclic graph."""
    e = transitions(spark, d)
    return reach.simple_paths(e.select(F.col("src").alias("root")), e).select("root", "node", F.array_join("path", ">").alias("path"), F.size("path").alias("hops"))


@query(f"""WITH RECURSIVE {TRANSITIONS}, p AS (SELECT src AS root, src AS node, [src] AS path FROM (SELECT DISTINCT src FROM g)
 UNION ALL SELECT p.root, g.dst, list_append(p.path, g.dst) FROM p JOIN g ON p.node = g.src WHERE NOT list_contains(p.path, g.dst))
 SELECT root, node, min(array_to_string(path, '>')) AS path FROM p GROUP BY root, node""")
def reach_first_path(spark: SparkSession, d: str) -> DataFrame:
    """The first path in depth-first order; edges are ordered by name."""
    e = transitions(spark, d)
    return reach.first_paths(e.select(F.col("src").alias("root")), e).select("root", "node", F.array_join("path", ">").alias("path"))


#: Nations trade where a customer of one has a line from a supplier of the other; the greater the trade, the earlier the edge.
TRADE = """v AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(round(l_extendedprice * 100)::BIGINT) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), g AS (SELECT a AS src, b AS dst FROM v WHERE a <> b)"""


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT n_nationkey AS root, n_nationkey AS node, 0 AS depth FROM nation UNION SELECT p.root, g.dst, p.depth + 1 FROM p JOIN g ON p.node = g.src WHERE p.depth < 24)
 SELECT root, node, min(depth)::INTEGER AS depth FROM p GROUP BY 1, 2""")
def bfs_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first over the trade between nations."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    v = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey")
    v = v.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").groupBy("src", "dst").agg(F.sum("v").alias("v")).where("src <> dst")
    e = cut(v.withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("v"), "dst"))).select("src", "dst", "ord"))
    return reach.shortest_paths(t("nation").select(F.col("n_nationkey").alias("root")), e, 24).select("root", "node", "depth")


#: Each event leads to the user's next one; every seventh ends its chain.
HOPS = """h AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), j AS (SELECT src, dst FROM h WHERE dst IS NOT NULL AND src % 7 <> 0)"""


@query(f"""WITH RECURSIVE {HOPS}, p AS (SELECT event_id AS root, event_id AS node, 0 AS depth FROM events WHERE event_type = 'signup' UNION SELECT p.root, j.dst, p.depth + 1 FROM p JOIN j ON p.node = j.src WHERE p.depth < 12)
 SELECT root, node, depth::INTEGER AS depth FROM p""")
def bfs_deep(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first over long chains, to a bounded depth: what a user's sign-up leads to."""
    e = table(spark, d, "events")
    j = e.select(F.col("event_id").alias("src"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"), F.lit(0).alias("ord")).where("dst is not null and src % 7 <> 0")
    return reach.shortest_paths(e.where("event_type = 'signup'").select(F.col("event_id").alias("root")), cut(j), 12).select("root", "node", "depth")


@query("SELECT 'c' || c_custkey AS root FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unreachable_roots(spark: SparkSession, d: str) -> DataFrame:
    """Customers who reach no urgent order."""
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("root")
    return reach.unreached(table(spark, d, "customer").select(key("c_custkey")), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(key("o_custkey")))


def _ruled(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    r = matching.matched(df.select(*keys, text), text, PATTERNS, "rule", NEEDS)
    return r.select(*keys, "rule", matching.lookup(F.col("rule"), CATEGORY).alias("category"), matching.lookup(F.col("rule"), SEVERITY).alias("severity"))


def _ruled_sql(name: str, key: str, text: str) -> str:
    return f"SELECT * FROM (SELECT {key}, {case_sql(text)}::INTEGER AS rule, {case_sql(text, CATEGORY)} AS category, {case_sql(text, SEVERITY)} AS severity FROM {name}) WHERE rule IS NOT NULL"


@query(_ruled_sql("documents", "doc_id", "text"))
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(table(spark, d, "documents"), ["doc_id"], "text")


@query(_ruled_sql("pages", "page_id", "html"))
def rule_pages(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(table(spark, d, "pages"), ["page_id"], "html")


#: Turns of a conversation, by what they begin with.
TURN_RULES = ("^[A-Z][a-z]+ [a-z]+ing ", "^(What|Why|How|Can|Could) ", "[?]$", "^[A-Z]", "[.]$")


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {k}" for k, p in enumerate(TURN_RULES)) + " END::INTEGER AS rule FROM conversations WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in TURN_RULES))
def rule_conversations(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", TURN_RULES, "rule").drop("text")


COUNTS = "count(*)::BIGINT AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}')::BIGINT AS {s}" for s in scores.RANK)


@query(f"WITH {EVENTS} SELECT {COUNTS} FROM ev")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(events(spark, d))


@query(f"WITH {EVENTS} SELECT line, tool, severity FROM ev WHERE gate_status = 'absent' AND rank <= 1")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    return report.at_level(ungated(spark, d), "warning").select("line", "tool", "severity")


#: Documents as files of a project for each source: some failed, some in a language that isn't analysed.
STATUS = "st AS (SELECT d.source AS tool, l.doc_id IS NULL AND d.doc_id % 50 = 0 AS failed, d.lang = 'es' AND d.doc_id % 40 = 0 AS skipped, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))"


def status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("tool"), F.col("lang").alias("language")).join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("seen")), "doc_id", "left")
    skipped = (F.col("language") == "es") & (F.col("doc_id") % 40 == 0)
    failed = F.col("seen").isNull() & (F.col("doc_id") % 50 == 0)
    return docs.select("tool", "language", F.when(skipped, "Unsupported file type").when(failed, "Syntax error").alias("error"), skipped.alias("skipped"))


@query(f"""WITH {EVENTS}, {STATUS}, f AS (SELECT tool, count(*)::BIGINT AS files, count(*) FILTER (failed AND NOT skipped)::BIGINT AS failed, count(*) FILTER (skipped)::BIGINT AS skipped FROM st GROUP BY 1),
 n AS (SELECT tool, {COUNTS} FROM ev WHERE gate_status = 'absent' GROUP BY tool)
 SELECT tool, files, failed, skipped, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("total", *scores.RANK))}, CASE WHEN failed > 0 THEN 3 WHEN critical > 0 THEN 2 WHEN warning > 0 THEN 1 ELSE 0 END::INTEGER AS exit_code,
 CASE WHEN files - skipped - failed <= 0 OR critical > 0 THEN 'failure' WHEN failed > 0 OR skipped > 0 OR warning > 0 OR info > 0 THEN 'neutral' ELSE 'success' END AS conclusion FROM f LEFT JOIN n USING (tool)""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Exit codes and check conclusions."""
    return report.verdicts(ungated(spark, d), status(spark, d), "tool")


@query(f"WITH {STATUS} SELECT tool, bool_or(failed OR skipped) AS partial, array_to_string(list_sort(list(DISTINCT lang) FILTER (NOT failed AND NOT skipped)), ',') AS languages FROM st GROUP BY 1")
def partial_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage(status(spark, d), "tool").withColumn("languages", F.array_join("languages", ","))


@query(f"""WITH {EVENTS} SELECT tool, n, operations, CASE worst WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM
 (SELECT tool, count(*)::BIGINT AS n, min(rank) AS worst, array_to_string(list_sort(list(DISTINCT operation)), ',') AS operations
 FROM ev WHERE gate_status = 'absent' GROUP BY tool ORDER BY worst, n DESC, tool LIMIT 10)""")
def risk_matrix_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten tools at most risk."""
    return report.risk_matrix(events(spark, d)).withColumn("operations", F.array_join("operations", ","))


@query(f"WITH {EVENTS} SELECT coalesce(nullif(framework, ''), 'generic') AS framework, count(*)::BIGINT AS n FROM ev GROUP BY 1 ORDER BY n DESC, framework LIMIT 8")
def framework_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.by_framework(events(spark, d))


@query(f"WITH {EVENTS} SELECT category, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.by_category(events(spark, d))


@query(f"""WITH {EVENTS} SELECT tool, operation, category, gate_status, count(*)::BIGINT AS n, CASE min(rank) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
 arg_min(framework, line) AS framework, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM ev GROUP BY 1, 2, 3, 4""")
def signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    return report.signatures(events(spark, d)).withColumn("files", F.array_join("files", ","))


@query(f"""WITH {EVENTS} SELECT count(*) FILTER (gate_status = 'present')::BIGINT AS present, count(*) FILTER (gate_status = 'absent')::BIGINT AS absent,
 CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (gate_status = 'present') * 100.0 / count(*) + 0.5)::BIGINT ELSE 0 END AS rate, count(DISTINCT operation) FILTER (gate_status = 'absent')::BIGINT AS ungated_operations FROM ev""")
def gate_coverage(spark: SparkSession, d: str) -> DataFrame:
    """With the number of distinct operations that no gate guards."""
    return report.gate_coverage(events(spark, d))


@query(f"WITH {EVENTS} SELECT tool, category, line, gate_status FROM (SELECT *, row_number() OVER (PARTITION BY tool, category ORDER BY n_chars, line) AS r FROM ev) WHERE r = 1")
def event_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each key, with its own gate."""
    return matching.first_by(events(spark, d), ["tool", "category"], "n_chars", "line").select("tool", "category", "line", "gate_status")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) AS r FROM events) WHERE r = 1")
def root_first_wins(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return matching.first_by(table(spark, d, "events"), ["user_id"], phase, "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def root_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return matching.first_by(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


LINKS = "k AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"
SLUG = "u AS (SELECT page_id AS to_id, lower(regexp_extract(url, '^[a-z]+://[^/]*(/[a-z]+)/', 1)) AS slug, url FROM pages)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("to_id"), F.lower(F.regexp_extract("url", "^[a-z]+://[^/]*(/[a-z]+)/", 1)).alias("slug"))


@query(f"WITH {LINKS} SELECT page_id, target, count(*)::BIGINT AS n FROM k GROUP BY 1, 2")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(f"""WITH {LINKS}, {SLUG}, f AS (SELECT slug, min(to_id) AS to_id FROM u GROUP BY slug), t AS (SELECT DISTINCT page_id, target FROM k)
 SELECT page_id, target, coalesce(a.to_id, b.to_id) AS resolved FROM t LEFT JOIN f a ON a.slug = target LEFT JOIN f b ON b.slug = lower(target) WHERE coalesce(a.to_id, b.to_id) IS NOT NULL""")
def link_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate that exists: the target as it is, then in lower case."""
    known = slugs(spark, d).groupBy("slug").agg(F.min("to_id").alias("resolved"))
    t = links(spark, d).distinct().withColumn("key", F.concat_ws("|", "page_id", "target")).withColumn("candidates", F.array("target", F.lower("target")))
    hit = matching.first_existing(t, "key", "candidates", known, "slug")
    return hit.join(known.withColumnRenamed("slug", "found"), "found").select("page_id", "target", "resolved")


@query(f"WITH {LINKS}, {SLUG} SELECT page_id, count(DISTINCT target)::BIGINT AS unresolved FROM k WHERE lower(target) NOT IN (SELECT slug FROM u) GROUP BY page_id")
def link_unresolved(spark: SparkSession, d: str) -> DataFrame:
    rest = links(spark, d).withColumn("slug", F.lower("target")).join(slugs(spark, d), "slug", "left_anti")
    return rest.groupBy("page_id").agg(F.countDistinct("target").alias("unresolved"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)
 SELECT a.page_id, count(*)::BIGINT AS n FROM s a JOIN (SELECT page_id, regexp_replace(p, '^[^/]*/', '') AS tail FROM s) b ON b.tail <> '' AND ends_with(a.p, '/' || b.tail) AND a.page_id <> b.page_id GROUP BY 1""")
def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    """Paths that end in another's tail: all suffixes of a path, joined on equality."""
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    s = table(spark, d, "pages").select("page_id", F.split(p, "/").alias("parts"))
    suffixes = s.select("page_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("parts"))), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "/"))).alias("tail")).where("tail <> ''")
    tails = s.select(F.col("page_id").alias("other"), F.array_join(F.slice("parts", F.lit(2), F.size("parts")), "/").alias("tail")).where("tail <> ''")
    return suffixes.join(tails, "tail").where("page_id <> other").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT *, CASE event_type WHEN 'signup' THEN 'installation' WHEN 'purchase' THEN 'pull_request' WHEN 'view' THEN 'push' ELSE 'ping' END AS kind,
 CASE WHEN event_type = 'signup' AND user_id % 3 > 0 THEN 'created' WHEN event_id % 4 = 0 THEN 'opened' WHEN event_id % 4 = 1 THEN 'synchronize' ELSE 'closed' END AS action FROM events)
 SELECT 'u' || user_id AS project, 'main' AS branch, 'e' || event_id AS revision, true AS whole, '-' AS paths FROM v WHERE kind = 'push' AND event_id % 2 = 0
 UNION ALL SELECT 'u' || user_id, 'topic', 'e' || event_id, false, 'f' || event_id || '.py' FROM v WHERE kind = 'pull_request' AND action IN ('opened', 'synchronize')
 UNION ALL SELECT 'u' || user_id || '/' || k, 'main', 'HEAD', true, '-' FROM v, (SELECT unnest(['a', 'b']) AS k) WHERE kind = 'installation' AND action = 'created'""")
def scan_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which scans a code host's events ask for: pushes to the default branch, changes that are open, installations with all their projects."""
    e, u = table(spark, d, "events"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "signup", "installation").when(F.col("event_type") == "purchase", "pull_request").when(F.col("event_type") == "view", "push").otherwise("ping")
    action = F.when((F.col("event_type") == "signup") & (F.col("user_id") % 3 > 0), "created").when(F.col("event_id") % 4 == 0, "opened").when(F.col("event_id") % 4 == 1, "synchronize").otherwise("closed")
    branch = F.when(kind == "pull_request", "topic").when(F.col("event_id") % 2 == 0, "refs/heads/main").otherwise("refs/heads/other")
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    rows = e.select(kind.alias("kind"), action.alias("action"), u.alias("project"), branch.alias("branch"), F.lit("main").alias("default_branch"), name.alias("revision"), F.array(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".py"))).alias("paths"), F.array(F.concat(u, F.lit("/a")), F.concat(u, F.lit("/b"))).alias("projects"))
    return triggers.requested(rows).withColumn("paths", F.coalesce(F.array_join("paths", ","), F.lit("-")))


@query("SELECT p_partkey, s_key FROM part JOIN (SELECT p_type AS t, p_size AS z, p_brand AS b, min(p_partkey) AS s_key, count(*) AS c FROM part GROUP BY 1, 2, 3) ON p_type = t AND p_size = z AND p_brand = b WHERE c = 1")
def unique_name_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Only a name that one definition has resolves."""
    key = ["p_type", "p_size", "p_brand"]
    part = table(spark, d, "part")
    return part.join(part.groupBy(*key).agg(F.min("p_partkey").alias("s_key"), F.count("*").alias("c")).where("c = 1"), key).select("p_partkey", "s_key")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS k FROM orders) ON o_orderkey = l_orderkey AND k = l_linenumber")
def arg_param_zip(spark: SparkSession, d: str) -> DataFrame:
    """Arguments (an order's lines) aligned with parameters by position."""
    args = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    params = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), k.alias("l_linenumber"), "o_custkey")
    return args.join(params, ["l_orderkey", "l_linenumber"])


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
 SELECT event_id, (arg_max(CASE WHEN event_type = 'signup' THEN event_id END, CASE WHEN event_type = 'signup' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS scoped FROM e""")
def scoped_lookup_last(spark: SparkSession, d: str) -> DataFrame:
    """The last earlier assignment in the same scope."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("scoped"))


@query("""SELECT c_custkey, coalesce('o' || a.k, 's' || b.k, 'n' || c_nationkey) AS target, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS stage
 FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT s_suppkey AS k FROM supplier) b ON b.k = c_custkey""")
def ordered_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Three lookups in order of priority."""
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("a"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("b"))
    j = table(spark, d, "customer").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return j.select("c_custkey", F.coalesce(named("o", "a"), named("s", "b"), named("n", "c_nationkey")).alias("target"), F.when(F.col("a").isNotNull(), 0).when(F.col("b").isNotNull(), 1).otherwise(2).alias("stage"))


@query(f"WITH {EVENTS} SELECT severity, tool, line FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY file, line, tool, operation) AS r FROM ev WHERE gate_status = 'absent') WHERE r <= CASE severity WHEN 'info' THEN 3 ELSE 5 END")
def finding_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five critical and warning findings, three of info, in report order."""
    return report.sorted_findings(report.top_findings(ungated(spark, d), {"critical": 5, "warning": 5, "info": 3})).select("severity", "tool", "line")


@query("SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    one = lambda n, k, c: table(spark, d, n).select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    return one("documents", "document", "doc_id").unionByName(one("pages", "page", "page_id")).unionByName(one("benchmark", "benchmark", "item_id"))


@query(f"WITH {EVENTS} SELECT framework FROM (SELECT framework FROM ev WHERE gate_status = 'absent' UNION SELECT framework FROM ev) ORDER BY 1")
def frameworks_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return report.frameworks(events(spark, d), ungated(spark, d))


@query(f"""WITH {EVENTS} SELECT line, (greatest(45, least(98, 76 + CASE framework WHEN 'en' THEN 18 WHEN 'de' THEN 12 WHEN 'fr' THEN -4 ELSE 0 END + least(8, 2 * (line % 6)) - CASE WHEN line % 4 > 0 THEN 8 ELSE 0 END
 - CASE WHEN n_chars > 3000 THEN 10 ELSE 0 END - CASE WHEN gate_status = 'present' THEN 4 ELSE 0 END)) / 100.0)::DOUBLE AS confidence,
 (greatest(45, least(98, 80 + CASE framework WHEN 'de' THEN 10 ELSE 0 END - CASE WHEN n_chars > 3000 THEN 10 ELSE 0 END - 5 * least(line % 4, 3) + CASE WHEN line % 5 <= 2 THEN 5 ELSE 0 END)) / 100.0)::DOUBLE AS script_confidence FROM ev""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("framework") == "en", "structural").when(F.col("framework") == "de", "semantic").when(F.col("framework") == "fr", "heuristic").otherwise("none")
    line, long = F.col("line"), F.col("n_chars") > 3000
    a = scores.confidence(kind, line % 6, line % 4, long, F.col("gate_status") == "present")
    b = scores.script_confidence(kind, line % 4, long, line % 5)
    return events(spark, d).select("line", (a / 100).alias("confidence"), (b / 100).alias("script_confidence"))


@query("""SELECT doc_id, CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END AS snippet FROM (SELECT doc_id, regexp_replace(trim(regexp_extract(text, '^[^\\n]*', 0)), '^[A-Za-z_][A-Za-z0-9_.]* *= *', '') AS s FROM documents)""")
def snippet_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scores.snippet(F.regexp_extract("text", "^[^\\n]*", 0)).alias("snippet"))


@query("""SELECT page_id, CASE regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '[.][^./]+$', 0) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' END AS language,
 regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '[.][^./]+$', 0) AS extension FROM pages""")
def ext_route(spark: SparkSession, d: str) -> DataFrame:
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, d, "pages").select("page_id", scores.language(path).alias("language"), scores.extension(path).alias("extension"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^.*/en/[^/]*$') AND NOT regexp_matches(url, '^.*[.]html$')")
def glob_exclude(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "pages").select("page_id", "url")
    for glob in ("**/en/*", "**.html"):
        out = out.where(~F.col("url").rlike(scores.glob_regex(glob)))
    return out


@query("SELECT o_custkey, count(*)::BIGINT AS n, least(20, greatest(10, ceil(log2(count(*)))::INTEGER + 8))::INTEGER AS budget FROM orders GROUP BY 1")
def depth_budget(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", "n", scores.depth_budget(F.col("n")).alias("budget"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 t AS (SELECT user_id, n, event_id FROM e WHERE n = 1 UNION SELECT e.user_id, e.n, e.event_id FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1 WHERE e.value < 80)
 SELECT event_id, user_id FROM t""")
def taint_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """From each user's first event taint goes on to the next while its value is below 80."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "value", "n")
    stop = F.max(F.when((F.col("n") > 1) & ~(F.col("value") < 80), 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("n"))
    return e.withColumn("stop", stop).where("stop = 0").select("event_id", "user_id")


@query("""SELECT count(*)::BIGINT AS nodes, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS registrations, sum(k)::BIGINT AS operations, count(*) FILTER (k IS NULL)::BIGINT AS unresolved, count(DISTINCT o_custkey)::BIGINT AS tools
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def graph_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    o = table(spark, d, "orders").join(k, "o_orderkey", "left")
    return o.agg(F.count("*").alias("nodes"), F.count_if(F.col("o_orderstatus") == "F").alias("registrations"), F.sum("k").alias("operations"), F.count_if(F.col("k").isNull()).alias("unresolved"), F.countDistinct("o_custkey").alias("tools"))


@query()
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object for each tool."""
    e = events(spark, d)
    counts = report.severity_counts(e, "tool")
    lists = e.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("line", "operation", "severity", "gate_status"))).alias("events"))
    return counts.join(lists, "tool").select("tool", F.to_json(F.struct("tool", "total", *scores.RANK, "events")).alias("report"))
