"""The source analysis as queries. The given tables hold no source code, so their rows are written out as programs whose calls, registrations and gates follow from keys; SQL over the same keys says what an analysis must find."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecrest.operators.checkpoints import cut, folder
from gatecrest.operators.resolve import ASSIGNMENT, DEFINITION, resolve
from gatecrest.plans import exposure, report
from gatecrest.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: What the function of a region does, in Python; and what that is to the rules: line, operation, label, category, severity, whether the argument reaches it.
PYTHON_ACTS = (
    "import shutil\ndef act(p):\n    shutil.rmtree(p)\n",
    "import requests\ndef act(p):\n    requests.post(p)\n",
    "import subprocess\ndef act(p):\n    subprocess.run(p)\n",
    "def act(p):\n    with open(p, 'a') as h:\n        h.write('x')\n",
    "def act(p):\n    eval(p)\n",
)
PYTHON_OPERATIONS = (
    (0, 3, "shutil.rmtree", "File system operation", "file_operation", "critical", True),
    (1, 3, "requests.post", "External API call", "api_call", "warning", True),
    (2, 3, "subprocess.run", "Shell command execution", "shell_execution", "critical", True),
    (3, 2, "builtins.open", "File system operation", "file_operation", "warning", True),
    (3, 3, "builtins.open.write", "File system operation", "file_operation", "warning", False),
    (4, 2, "builtins.eval", "Dynamic code execution", "code_execution", "critical", True),
)
#: The function of a nation, by its key modulo 5: refuses by itself, is guarded by a decorator, calls back and forth, or just goes on.
NATION = (
    "from ops.region{r} import act as go\ndef do(p):\n    if not p:\n        raise PermissionError('no')\n    go(p)\n",
    "from auth import guard\nfrom ops.region{r} import act as go\n@guard\ndef do(p):\n    go(p)\n",
    "from ops.region{r} import act as go\ndef do(p):\n    back(p)\n    go(p)\ndef back(p):\n    do(p)\n",
    "import ops.region{r} as where\ndef do(p):\n    where.act(p)\n",
    "from ops import region{r}\nfrom log import note\n@note\ndef do(p):\n    q = p\n    region{r}.act(q)\n",
)
#: The tool of a supplier, by its key modulo 8.
TOOL = (
    "from langchain.tools import tool\nfrom nations.nation{n} import do\n@tool\ndef use{s}(p):\n    do(p)\n",
    "from langchain.tools import tool\nimport nations.nation{n} as nat\n@tool\ndef use{s}(p):\n    nat.do(p)\n",
    "from nations.nation{n} import do\ndef use{s}(p):\n    do(p)\n",
    "from crewai import Agent\nfrom nations.nation{n} import do\ndef use{s}(p):\n    do(p)\nworker = Agent(role='r', tools=[use{s}])\n",
    "from langchain.tools import BaseTool\nfrom nations.nation{n} import do\nclass Own{s}(BaseTool):\n    def _run(self, p):\n        do(p)\n",
    "from langgraph.prebuilt import create_react_agent\nfrom nations.nation{n} import do\ndef use{s}(p):\n    do(p)\ndef bundle():\n    return [use{s}]\ndef build(m):\n    return create_react_agent(m, tools=bundle())\n",
    "from langchain.tools import tool\nfrom nations.nation{n} import do\nMAP = {'k': do}\n@tool\ndef use{s}(k, p):\n    MAP[k](p)\n",
    "from langchain.tools import tool\nfrom nations.nation{n} import do\n@tool\ndef use{s}(p):\n    do('fixed')\n",
)
TOOL_FRAMEWORK = ("langchain", "langchain", None, "crewai", "langchain", "langgraph", "langchain", "langchain")
GUARD = "def guard(fn):\n    def inner(user, *args):\n        if not user.admin:\n            raise PermissionError('no')\n        return fn(user, *args)\n    return inner\n"
NOTE = "def note(fn):\n    def inner(*args):\n        print(args)\n        return fn(*args)\n    return inner\n"

SCRIPT_ACTS = (
    "import * as fs from 'fs';\nexport function act(p: string) { fs.rmSync(p); }\n",
    "import axios from 'axios';\nexport async function act(p: string) { return axios.post(p); }\n",
    "import { exec } from 'child_process';\nexport function act(p: string) { exec(p); }\n",
    "export async function act(p: string) { odd(p); return fetch(p); }\n",
    "export function act(p: string) { one(p); inner(p); }\nfunction inner(p: string) { two(p); eval(p); }\n",
)
#: Region, line, operation, label, category, severity, whether its identity is known, callees that lead nowhere.
SCRIPT_OPERATIONS = (
    (0, 2, "fs.rmSync", "File system operation", "file_operation", "critical", True, ("fs.rmSync",)),
    (1, 2, "axios.post", "HTTP operation", "api_call", "warning", True, ("axios.post",)),
    (2, 2, "child_process.exec", "Shell command execution", "shell_execution", "critical", True, ("exec",)),
    (3, 1, "fetch", "HTTP operation", "api_call", "warning", False, ("odd", "fetch")),
    (4, 2, "eval", "Code execution", "code_execution", "critical", False, ("one", "two", "eval")),
)
#: The tool of a nation in a script, by its key modulo 5; its framework, name, and callees of its own that lead nowhere.
SCRIPT_TOOL = (
    "import {{ McpServer }} from '@modelcontextprotocol/sdk/server/mcp.js';\nimport {{ act }} from './lib/r{r}';\nconst server = new McpServer({{ name: 's' }});\nserver.tool('post{n}', {{ u: 1 }}, async ({{ u }}) => {{ await act(u); }});\n",
    "import {{ Tool }} from '@langchain/core/tools';\nimport {{ act }} from './lib/r{r}';\nexport function go{n}(p) {{ act(p); }}\n",
    "import {{ act }} from './lib/r{r}';\nfunction run{n}(c) {{ act(c); }}\nbot.registerCommand('run', run{n});\n",
    "import {{ Agent }} from '@mastra/core';\nimport {{ act }} from './lib/r{r}';\nexport async function erase{n}(user, p) {{\n  if (!user.admin) {{ throw new ForbiddenError('no'); }}\n  await act(p);\n}}\n",
    "import {{ act }} from './lib/r{r}';\nexport function boot{n}(p) {{ createAgentRuntime({{ plugins: [p] }}); act(p); }}\n",
)
SCRIPT_ROOT = (("mcp", "post"), ("export-entry", "go"), ("registration", "run"), ("export-entry", "erase"), ("runtime-composition", "boot"))
SCRIPT_OWN = ((), (), (), ("ForbiddenError",), ("createAgentRuntime",))


def written(template: str, **keys: Column) -> Column:
    """A template with the given columns in the places of their names."""
    out: Column = F.lit(template.replace("{{", "\1").replace("}}", "\2"))
    for name, value in keys.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.replace(F.replace(out, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}"))


def one_of(templates: tuple[str, ...], k: Column, **keys: Column) -> Column:
    out = written(templates[0], **keys)
    for i, t in enumerate(templates[1:], 1):
        out = F.when(k == i, written(t, **keys)).otherwise(out)
    return out


def programs(spark: SparkSession, d: str) -> DataFrame:
    """(project, file, source): a Python and a script project of the regions, nations and suppliers, and a long chain of scripts."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    text = lambda c: F.col(c).cast("string")
    r, n, s = F.col("n_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    region, nation, supplier = t("region"), t("nation"), t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rk = F.col("r_regionkey")
    last = nation.agg(F.max("n_nationkey")).first()[0]
    chain = F.when(n < last, F.concat(F.lit("import { f"), (n + 1).cast("string"), F.lit(" } from './d"), (n + 1).cast("string"), F.lit("';\n"))).otherwise("")
    deeper = F.when(n < last, F.concat(F.lit(" f"), (n + 1).cast("string"), F.lit("(p);"))).otherwise("")
    agent = F.when(n == 0, "import { Tool } from '@langchain/core/tools';\n").otherwise("")
    parts = [
        region.select(F.lit("py").alias("project"), F.concat(F.lit("ops/region"), text("r_regionkey"), F.lit(".py")).alias("file"), one_of(PYTHON_ACTS, rk).alias("source")),
        nation.select(F.lit("py"), F.concat(F.lit("nations/nation"), text("n_nationkey"), F.lit(".py")), one_of(NATION, n % 5, r=r)),
        supplier.select(F.lit("py"), F.concat(F.lit("tools/s"), text("s_suppkey"), F.lit(".py")), one_of(TOOL, s % 8, s=s, n=n)),
        region.limit(1).select(F.lit("py"), F.lit("auth.py"), F.lit(GUARD)),
        region.limit(1).select(F.lit("py"), F.lit("log.py"), F.lit(NOTE)),
        region.select(F.lit("ts"), F.concat(F.lit("src/lib/r"), text("r_regionkey"), F.lit(".ts")), one_of(SCRIPT_ACTS, rk)),
        nation.select(F.lit("ts"), F.concat(F.lit("src/n"), text("n_nationkey"), F.lit(".ts")), one_of(SCRIPT_TOOL, n % 5, r=r, n=n)),
        nation.select(F.lit("deep"), F.concat(F.lit("src/d"), text("n_nationkey"), F.lit(".ts")), F.concat(agent, F.lit("import { unlinkSync } from 'fs';\n"), chain, F.lit("export function f"), text("n_nationkey"), F.lit("(p) { unlinkSync(p);"), deeper, F.lit(" }\n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_DONE: dict[tuple[str, str], exposure.Analysis] = {}


def analysis(spark: SparkSession, d: str) -> exposure.Analysis:
    """The analysis of programs(), made once a session for the queries that read its tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DONE:
        _DONE[key] = exposure.analyse(files.from_table(programs(spark, d)))
    return _DONE[key]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: tuple, names: str) -> str:
    def one(v: object) -> str:
        if isinstance(v, tuple):
            return "[" + ", ".join(map(one, v)) + "]" + ("" if v else "::VARCHAR[]")
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS {names}"


TOOLS = f"""tool AS (SELECT s_suppkey AS s, s_suppkey % 8 AS v, n_nationkey AS n, n_regionkey AS r, f.framework, 'tools/s' || s_suppkey || '.py' AS tool_file,
 CASE s_suppkey % 8 WHEN 4 THEN '_run' ELSE 'use' || s_suppkey END AS tool, CASE s_suppkey % 8 WHEN 4 THEN 'Own' || s_suppkey || '._run' ELSE 'use' || s_suppkey END AS local,
 n_nationkey % 5 IN (0, 1) AS gated FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN {values(tuple(enumerate(TOOL_FRAMEWORK)), "f(v, framework)")} ON f.v = s_suppkey % 8)"""


@query(f"""WITH {TOOLS}, op AS (SELECT * FROM {values(PYTHON_OPERATIONS, "o(r, line, operation, label, category, severity, reached)")})
 SELECT 'ops/region' || op.r || '.py' AS file, line::INTEGER AS line, label || ': ' || operation AS operation, category, severity, tool, framework, tool_file,
 tool_file || ':' || local || ' > nations/nation' || n || '.py:do > ops/region' || op.r || '.py:act' AS call_path, CASE WHEN gated THEN 'present' ELSE 'absent' END AS gate_status,
 CASE WHEN reached AND v <> 7 THEN 'structural' ELSE 'semantic' END AS evidence_kind, (76 + CASE WHEN reached AND v <> 7 THEN 18 ELSE 12 END + 4 - CASE WHEN gated THEN 4 ELSE 0 END)::DOUBLE / 100 AS confidence
 FROM tool JOIN op ON op.r = tool.r WHERE framework IS NOT NULL""")
def python_events(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's tool reaches its region's operations through its nation, which may refuse."""
    e = analysis(spark, d).events.where("project = 'py'")
    return e.select("file", "line", "operation", "category", "severity", "tool", "framework", "tool_file", F.array_join("call_path", " > ").alias("call_path"), "gate_status", "evidence_kind", "confidence")


@query(f"""WITH {TOOLS}, op AS (SELECT * FROM {values(PYTHON_OPERATIONS, "o(r, line, operation, label, category, severity, reached)")})
 SELECT tool_file, tool, label || ': ' || operation AS operation, severity FROM tool JOIN op ON op.r = tool.r WHERE framework IS NOT NULL AND NOT gated AND severity = 'critical'""")
def python_findings(spark: SparkSession, d: str) -> DataFrame:
    """Critical findings: what no gate guards."""
    f = report.at_level(analysis(spark, d).findings, "critical")
    return f.where("project = 'py'").select("tool_file", "tool", "operation", "severity")


@query(f"""WITH {TOOLS} SELECT tool_file || ':' || local AS src, 'nations/nation' || n || '.py:do' AS dst FROM tool
 UNION ALL SELECT 'nations/nation' || n_nationkey || '.py:do', 'ops/region' || n_regionkey || '.py:act' FROM nation
 UNION ALL SELECT 'nations/nation' || n_nationkey || '.py:do', 'nations/nation' || n_nationkey || '.py:back' FROM nation WHERE n_nationkey % 5 = 2
 UNION ALL SELECT 'nations/nation' || n_nationkey || '.py:back', 'nations/nation' || n_nationkey || '.py:do' FROM nation WHERE n_nationkey % 5 = 2
 UNION ALL SELECT 'tools/s' || s_suppkey || '.py:build', 'tools/s' || s_suppkey || '.py:bundle' FROM supplier WHERE s_suppkey % 8 = 5""")
def python_edges(spark: SparkSession, d: str) -> DataFrame:
    """The resolved calls between functions, through aliases, modules, tables of functions and methods."""
    name = lambda c: F.element_at(F.split(c, "\x1f"), 2).alias(c)
    return analysis(spark, d).edges.where(F.col("src").startswith("py\x1f")).select(name("src"), name("dst"))


@query(f"WITH {TOOLS} SELECT tool_file || ':' || local AS node, framework FROM tool WHERE framework IS NOT NULL")
def python_roots(spark: SparkSession, d: str) -> DataFrame:
    """The functions that are registered as tools: by decorators, lists, returned lists and base classes."""
    return analysis(spark, d).roots.where("project = 'py'").select("node", "framework")


SCRIPTS = f"""op AS (SELECT * FROM {values(SCRIPT_OPERATIONS, "o(r, line, operation, label, category, severity, known, lost)")}), f AS (SELECT * FROM {values(tuple((k, *SCRIPT_ROOT[k], SCRIPT_OWN[k]) for k in range(5)), "f(v, framework, prefix, own)")}),
 x AS (SELECT n_nationkey AS n, f.*, op.*, list_concat(own, lost) AS unresolved FROM nation JOIN f ON f.v = n_nationkey % 5 JOIN op ON op.r = n_regionkey)"""


@query(f"""WITH {SCRIPTS} SELECT 'src/lib/r' || r || '.ts' AS file, line::INTEGER AS line, label || ': ' || operation AS operation, category, severity, prefix || n AS tool, framework,
 'src/n' || n || '.ts:' || prefix || n || ' > src/lib/r' || r || '.ts:act' || CASE r WHEN 4 THEN ' > src/lib/r4.ts:inner' ELSE '' END AS call_path, CASE v WHEN 3 THEN 'present' ELSE 'absent' END AS gate_status, CASE WHEN known THEN 'semantic' ELSE 'heuristic' END AS evidence_kind,
 array_to_string(unresolved, ',') AS unresolved_calls, (80 + CASE WHEN known THEN 10 ELSE 0 END - 5 * least(3, len(unresolved)) + CASE r WHEN 4 THEN 0 ELSE 5 END)::DOUBLE / 100 AS confidence FROM x""")
def script_events(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's tool reaches its region's operation; calls that lead nowhere lower the confidence."""
    e = analysis(spark, d).events.where("project = 'ts'")
    return e.select("file", "line", "operation", "category", "severity", "tool", "framework", F.array_join("call_path", " > ").alias("call_path"), "gate_status", "evidence_kind", F.array_join("unresolved_calls", ",").alias("unresolved_calls"), "confidence")


@query("""WITH b AS (SELECT least(20, greatest(10, ceil(log2(count(*)))::INTEGER + 8)) AS budget FROM nation)
 SELECT 'src/d' || n_nationkey || '.ts' AS file, 'f0' AS tool, (n_nationkey + 1)::INTEGER AS hops, n_nationkey = budget AS depth_limit_hit, (80 + 10 - 5 - CASE WHEN n_nationkey = budget THEN 10 ELSE 0 END + CASE WHEN n_nationkey < 2 THEN 5 ELSE 0 END)::DOUBLE / 100 AS confidence
 FROM nation, b WHERE n_nationkey <= budget""")
def script_depth(spark: SparkSession, d: str) -> DataFrame:
    """A chain of as many functions as there are nations is followed as deep as the budget allows."""
    e = analysis(spark, d).events.where("project = 'deep'")
    return e.select("file", "tool", F.size("call_path").alias("hops"), "depth_limit_hit", "confidence")


@query(f"""WITH {SCRIPTS}, b AS (SELECT count(*) AS c, least(20, greatest(10, ceil(log2(count(*)))::INTEGER + 8)) AS budget FROM nation)
 SELECT 'ts' AS project, (c + 6)::BIGINT AS nodes, least(20, greatest(10, ceil(log2(c + 6))::INTEGER + 8))::INTEGER AS budget, c::BIGINT AS roots, 5::BIGINT AS operations, (c + 1)::BIGINT AS edges, c::BIGINT AS cross_file_edges,
 (SELECT sum(len(lost)) FROM op)::BIGINT + (SELECT sum(len(own)) FROM x)::BIGINT AS unresolved_calls, 0::BIGINT AS depth_limited_events, c::BIGINT AS events_with_unresolved FROM b
 UNION ALL SELECT 'deep', c, budget::INTEGER, 1, c, c - 1, c - 1, c, 1, budget + 1 FROM b""")
def script_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return report.diagnostics(analysis(spark, d)).where("language = 'script'").select("project", "nodes", "budget", "roots", "operations", "edges", "cross_file_edges", "unresolved_calls", "depth_limited_events", "events_with_unresolved")


@query(f"""WITH {TOOLS}, {SCRIPTS} SELECT 'py' AS project, framework, count(*)::BIGINT AS n FROM tool WHERE framework IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'ts', framework, count(*)::BIGINT FROM x GROUP BY 2 UNION ALL SELECT 'deep', 'export-entry', 1""")
def project_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """How many tools each framework registers."""
    return analysis(spark, d).roots.groupBy("project", "framework").agg(F.count("*").alias("n"))


#: A file that is analysed, or not: its path below the folder.
ODD_FILES = ("app/__init__.py", "app/__main__.py", "app/_tools.py", "_private/in.py", ".hidden/also.py", "app/.dotted.ts", "node_modules/x/index.js", "app/tests/t.py", "app/types.d.ts", "lib.min.js", "notes.txt", "app/upper.PY", "app/one.mjs")


@query("SELECT file, 'python' AS language FROM (SELECT unnest(['app/__init__.py', 'app/__main__.py', 'app/_tools.py', '_private/in.py', '.hidden/also.py', 'app/upper.PY']) AS file) UNION ALL SELECT 'app/.dotted.ts', 'typescript' UNION ALL SELECT '_r' || r_regionkey || '/region.py', 'python' FROM region")
def scan_listing(spark: SparkSession, d: str) -> DataFrame:
    """A directory with names of all kinds: those of packages, private and hidden ones, excluded folders and other languages."""
    root = f"{folder(spark)}/scan-{uuid.uuid4().hex}"
    root = root.removeprefix("file://").removeprefix("file:")
    names = [*ODD_FILES, *(f"_r{r.r_regionkey}/region.py" for r in spark.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect())]
    for name in names:  # a handful
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write("x = 1\n")
    return files.from_directory(spark, root).where("source is not null and error is null").select("file", "language")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS k, (c_custkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS nxt, c_custkey % 2 = 0 AS def FROM customer),
 w AS (SELECT k AS start, k AS at, 0 AS hops FROM n UNION SELECT w.start, n.nxt, hops + 1 FROM w JOIN n ON n.k = w.at WHERE NOT n.def AND hops < 40)
 SELECT start AS rid, CASE WHEN n.def THEN 'f:x' || w.at END AS node, CASE WHEN n.k IS NULL THEN 'x' || w.at END AS identity FROM w LEFT JOIN n ON n.k = w.at WHERE n.def OR n.k IS NULL""")
def resolve_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand for other names, in cycles too: customers of odd keys stand for another customer, those of even keys are definitions. A name that nothing defines is an end of its own; one that only leads back to itself comes to nothing."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    m = c.agg(F.max("k")).first()[0] + 1
    none, name = F.lit(None).cast("string"), lambda k: F.concat(F.lit("x"), k.cast("string"))
    known = F.col("k") % 2 == 0
    names = c.select(F.lit("p").alias("project"), F.lit("f").alias("file"), none.alias("fn"), none.alias("cls"), name(F.col("k")).alias("name"), F.when(known, DEFINITION).otherwise(ASSIGNMENT).alias("prio"), F.lit(0).alias("ord"), F.when(~known, "f").alias("to_file"), none.alias("to_fn"), none.alias("to_cls"), F.when(~known, name((F.col("k") * 7 + 3) % m)).alias("to_chain"), F.when(known, F.concat(F.lit("f:"), name(F.col("k")))).alias("node"), none.alias("root"))
    refs = c.select(F.col("k").alias("rid"), F.lit("p").alias("project"), F.lit("f").alias("file"), none.alias("fn"), none.alias("cls"), name(F.col("k")).alias("chain"))
    return resolve(refs, cut(names)).select("rid", "node", "identity")
