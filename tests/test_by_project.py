"""Both ways of following references and edges give the same rows: within a task, and by joins."""

import random

import pytest
from pyspark.sql import functions as F

from gatecrest.operators import by_project, reach, resolve
from gatecrest.operators.checkpoints import cut
from gatecrest.plans import project_queries
from gatecrest.sources import files, script_facts
from gatecrest.sources.python_facts import python_facts

ODD = {
    "loops.py": "def walk(n):\n    n = n.parent\n    a = b.left\n    b = a.right\n    n.stop()\n    a.go()\n    return n\n",
    "many.py": "import m1, m2\ndef pick(k):\n    if k:\n        return m1.x\n    return pick(m2).y\nz = pick(1)\nz.run()\nw = [z, m1]\nw.each()\n",
    "m1.py": "from many import w\nx = w\n",
}


def refs_and_names(spark):
    facts = cut(python_facts(files.from_sources(spark, [("odd", f, t) for f, t in ODD.items()]).unionByName(files.from_table(project_queries.programs(spark, "/root/testdata/sf0.001").where("project = 'py'")))))
    calls = facts.select("project", "file", F.explode("calls").alias("x")).select(F.concat_ws("|", "project", "file", F.col("x.ord").cast("string")).alias("rid"), "project", "file", "x.fn", "x.cls", "x.chain")
    return cut(calls), cut(resolve.names_of(facts))


def test_references(spark):
    refs, names = refs_and_names(spark)
    rows = lambda limit: sorted(by_project.resolved(refs, names, limit=limit).distinct().collect(), key=str)
    here, joined = rows(by_project.NAMES), rows(0)
    assert here == joined and len(here) > 60
    assert len(here) < 3 * refs.count()  # loops end


@pytest.mark.parametrize("first", [True, False])
def test_paths(spark, first):
    rng = random.Random(8)
    edges = [(p, f"{p}{rng.randrange(7)}", f"{p}{rng.randrange(7)}", k) for p in "ab" for k in range(12)]
    edges += [("l", f"l{k}", f"l{k + 1}", k) for k in range(9)] + [("l", "l0", "l7", 99)]
    df = cut(spark.createDataFrame(edges, "project string, src string, dst string, ord int").dropDuplicates(["src", "dst"]).where("src <> dst"))
    roots = spark.createDataFrame([(p, f"{p}{k}") for p in "abl" for k in (0, 1)], "project string, root string")
    bound = 5
    rows = lambda limit: sorted(by_project.paths(roots, df, first, bound, limit).select("root", "node", "path", "ords").collect(), key=str)
    here = rows(by_project.EDGES)
    assert here == rows(0)
    if first:  # against the definition
        w = reach.simple_paths(roots.select("root"), df, bound).groupBy("root", "node").agg(F.min("ords").alias("ords"))
        assert {(r.root, r.node, tuple(r.ords)) for r in w.collect()} == {(r.root, r.node, tuple(r.ords)) for r in here}


def test_long_imports_and_arguments():
    names = ", ".join(f"n{k} as m{k}" for k in range(600))
    tables, _ = script_facts.parse("a.ts", f"import {{ {names}, from as origin }} from './b';\nexport function f(p) {{ m599({{ text: '{'x' * 500}', tools: p }}); origin(p); }}\n")
    bound = {n["name"]: n["refs"] for n in tables["names"] if n["kind"] == "import"}
    assert bound["m599"] == ["@b.n599"] and bound["origin"] == ["@b.from"]
    (call, other) = tables["calls"]
    assert len(call["args"][0]["text"]) > 500 and call["fn"] == other["fn"] == "f"


def test_composed_runtime():
    tables, _ = script_facts.parse("a.ts", "export function boot(p) { createAgentRuntime({ plugins: [p] }); buildIndex({ plugins: p }); }\n")
    assert [(r["name"], r["framework"]) for r in tables["roots"]] == [("boot", "runtime-composition")]
