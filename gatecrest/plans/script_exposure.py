"""Exposure of TypeScript and JavaScript files: roots come with the facts, paths are shortest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecrest.functions import rules
from gatecrest.operators import by_project, matching
from gatecrest.operators.checkpoints import cut
from gatecrest.operators.resolve import names_of
from gatecrest.plans.exposure import edges_of, events_of, exploded, gid, node_of, nodes_of, open_calls, resource, with_rules
from gatecrest.sources.script_facts import script_facts

#: What an instance of these classes is called in the rules.
INSTANCES = {"PrismaClient": "prisma", "Sequelize": "sequelize", "Redis": "redis", "IORedis": "redis", "Pool": "pool", "Client": "client", "OpenAI": "openai", "Anthropic": "anthropic", "S3Client": "s3Client", "LambdaClient": "lambdaClient", "SNSClient": "snsClient", "SQSClient": "sqsClient", "DynamoDBClient": "dynamoDBClient", "MongoClient": "db", "Queue": "queue", "Database": "better-sqlite3.Database", "Knex": "knex"}
#: Folders whose children are packages of a repository.
PACKAGES = "packages|apps|modules|libs|plugins"


def script_identity(identity: Column) -> Column:
    """A chain as the rules name it: the module, or the class of the instance, or else the text."""
    out = F.regexp_replace(F.regexp_replace(identity, r"\(\)|\[\]", ""), "^@|^this[.]", "")
    for cls, name in INSTANCES.items():
        out = F.regexp_replace(out, rf"^(.*[./])?{cls}(?=[.])", name)
    bare = ~identity.startswith("@") & ~out.contains(".")  # a global: its rules go by the callee's text
    return F.when(identity.startswith("#") | identity.startswith("module:") | bare, None).otherwise(out)


def linked_packages(facts: DataFrame, names: DataFrame) -> DataFrame:
    """names in which imports of a package of the same project (@scope/name, or name) lead to its index file."""
    files = facts.select("project", "file")
    m = rf"^(?:.*/)?(?:{PACKAGES})/([^/]+)/(?:src/)?index[.][a-z]+$"
    known = files.where(F.col("file").rlike(m)).select("project", F.regexp_extract("file", m, 1).alias("package"), F.concat(F.lit("@"), F.regexp_replace(F.regexp_replace("file", "/index[.][a-z]+$", ""), "/", ".")).alias("stem"))
    known = matching.first_by(known, ["project", "package"], F.length("stem"), "stem")
    pattern = r"^@(?:@[^/.]+/)?([^/.]+)(.*)$"
    n = names.withColumn("package", F.when(F.col("to_chain").startswith("@"), F.regexp_extract("to_chain", pattern, 1)))
    n = n.join(known, ["project", "package"], "left")
    return n.withColumn("to_chain", F.when(F.col("stem").isNotNull(), F.concat("stem", F.regexp_extract("to_chain", pattern, 2))).otherwise(F.col("to_chain"))).drop("package", "stem")


def exports(facts: DataFrame) -> DataFrame:
    """A default import of a file stands for its first exported function."""
    f = exploded(facts, "functions").where("exported")
    one = matching.first_by(f, ["project", "file"], "ord")
    none = F.lit(None).cast("string")
    return one.select("project", "file", none.alias("fn"), none.alias("cls"), F.lit("default").alias("name"), F.lit(0).alias("prio"), "ord", F.col("file").alias("to_file"), none.alias("to_fn"), none.alias("to_cls"), F.col("name").alias("to_chain"), none.alias("node"), none.alias("root"))


def unique_functions(nodes: DataFrame) -> DataFrame:
    """(project, name, node) of names that one function of the project has, or one exported function."""
    g = nodes.groupBy("project", "name").agg(F.count("*").alias("n"), F.count_if("exported").alias("e"), F.min("node").alias("any"), F.min(F.when(F.col("exported"), F.col("node"))).alias("exported"))
    return g.select("project", "name", F.when(F.col("n") == 1, F.col("any")).when(F.col("e") == 1, F.col("exported")).alias("node")).where("node is not null")


def analyse_scripts(files: DataFrame) -> tuple[DataFrame, ...]:
    """facts, nodes, edges, roots, operations, events and unresolved calls of the script files."""
    facts = cut(script_facts(files))
    names = cut(linked_packages(facts, names_of(facts)).unionByName(exports(facts)))
    nodes = cut(nodes_of(facts))
    calls = cut(exploded(facts, "calls").withColumn("rid", F.concat_ws("|", F.lit("c"), "project", "file", F.col("ord").cast("string"))))
    none = F.lit(None).cast("string")
    declared = exploded(facts, "roots").withColumn("rid", F.concat_ws("|", F.lit("r"), "project", "file", F.col("ord").cast("string")))
    refs = calls.select("rid", "project", "file", "fn", "cls", "chain").unionByName(declared.select("rid", "project", "file", none.alias("fn"), none.alias("cls"), F.col("name").alias("chain")))
    found = by_project.resolved(refs, names)
    # names that hold more than a plain chain, as those of inline callbacks, are their function's own
    own = declared.join(nodes.select("project", "file", F.expr("substring(node, length(file) + 2)").alias("name"), F.col("node").alias("direct")), ["project", "file", "name"], "left")
    own = own.join(found.where("node is not null").select("rid", "node"), "rid", "left").join(unique_functions(nodes).withColumnRenamed("node", "only"), ["project", "name"], "left")
    placed_roots = own.select("project", F.coalesce("direct", "node", "only").alias("node"), "framework", "evidence", "file", "ord").where("node is not null")
    roots = matching.first_by(placed_roots, ["project", "node"], F.col("file").desc(), F.col("ord").desc()).select("project", "node", "framework", "evidence").withColumn("gid", gid("project", "node"))
    roots = cut(roots.join(nodes.select("gid"), "gid", "left_semi"))
    placed = calls.withColumn("_n", node_of(F.col("fn"), F.col("cls"))).where("_n is not null").withColumn("caller", gid("project", "_n")).drop("_n")
    placed = cut(placed.join(nodes.select(F.col("gid").alias("caller")), "caller", "left_semi"))
    to = placed.join(found.where("node is not null").select("rid", "node"), "rid").select("rid", F.col("caller").alias("src"), gid("project", "node").alias("dst"), "ord", "args")
    to = to.join(nodes.select(F.col("gid").alias("dst")), "dst", "left_semi")
    edges = cut(edges_of(to, nodes))
    identities = found.where("node is null").select("rid", script_identity(F.col("identity")).alias("identity"))
    ops = with_rules(placed.join(identities, "rid", "left"), rules.SCRIPT_RESOLVED, rules.SCRIPT_FALLBACK)
    ops = ops.withColumn("resource", F.coalesce("hint", resource())).withColumn("changes_state", F.col("writes")).withColumn("snippet", F.col("callee"))
    ops = cut(ops.select("project", "file", "caller", "ord", "line", "col", "operation", "snippet", "category", "severity", "kind", "resource", "changes_state", "args"))
    unresolved = cut(open_calls(placed, to))
    return facts, nodes, edges, roots, ops, cut(events_of(nodes, edges, roots, ops, unresolved, "script")), unresolved
