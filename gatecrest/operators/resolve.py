"""What a chain of names refers to: a fixpoint of joins that replaces its longest known prefix by what that is bound to.

names has a row for each thing that a name may stand for: (project, file, fn, cls, name, prio, ord, to_file, to_fn,
to_cls, to_chain, node). A row with a node is a definition; others say how the prefix is rewritten, and in which scope
the result is to be read. Rows of modules have the file ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.operators.checkpoints import cut

MAX_ROUNDS = 40
#: Higher wins among names of one scope and length.
BASE, IMPORT, DEFINITION, ASSIGNMENT = 0, 1, 2, 3


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*/)?", 0), "/$", "")


def stem(path: Column) -> Column:
    """The path without extension; that of a package's or folder's index file is the folder."""
    return F.regexp_replace(F.regexp_replace(path, "[.][^./]+$", ""), "/(__init__|index)$", "")


def module_names(files: DataFrame) -> DataFrame:
    """(project, name, to_file, root) of each dotted name under which a file can be imported.

    A file a/b/c.py is a.b.c from the project's root, and c or b.c where a folder that holds files of its own, or one of
    its ancestors that is called src, lib, packages or backend, is the root. Suffixes are exploded, so that imports find
    their file by an equality join.
    """
    f = files.select("project", "file").distinct()
    parts = f.select("project", "file", F.split(stem(F.col("file")), "/").alias("p"))
    cuts = parts.select("project", "file", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("k"))
    named = cuts.select("project", "file", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("root"), F.concat(F.lit("@"), F.array_join(F.expr("slice(p, k + 1, size(p))"), ".")).alias("name"))
    own = f.select("project", folder(F.col("file")).alias("root"))
    known = f.select("project", F.explode(F.expr("transform(filter(sequence(0, size(split(file, '/')) - 1), k -> k = 0 or element_at(split(file, '/'), k) in ('src', 'lib', 'packages', 'backend')), k -> array_join(slice(split(file, '/'), 1, k), '/'))")).alias("root"))
    roots = own.union(known).distinct()
    return named.join(roots, ["project", "root"]).select("project", "name", F.col("file").alias("to_file"), "root")


def names_of(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The names table of parsed facts, which are a cut table. It has no more partitions than they, as every round of resolve() reads all of it."""
    none = F.lit(None).cast("string")
    node = lambda cls, name: F.concat(F.col("file"), F.lit(":"), F.when(cls.isNotNull(), F.concat(cls, F.lit("."))).otherwise(""), name)
    b = facts.select("project", "file", F.explode("names").alias("x")).select("project", "file", "x.*")
    scope = Window.partitionBy("project", "file", "fn", "cls", "name")
    # elements that are added to a container belong to its last assignment
    last = F.max(F.when(F.col("kind") != "element", F.col("ord"))).over(scope)
    b = b.withColumn("ord", F.when(F.col("kind") == "element", F.coalesce(last, F.lit(0))).otherwise(F.col("ord")))
    b = b.withColumn("ord", F.when(F.col("kind") == "return", F.lit(0)).otherwise(F.col("ord")))
    bound = b.select("project", "file", F.when(F.col("kind") != "return", F.col("fn")).alias("fn"), F.when(F.col("kind") != "return", F.col("cls")).alias("cls"), "name", F.when(F.col("kind") == "import", IMPORT).otherwise(ASSIGNMENT).alias("prio"), "ord", F.col("file").alias("to_file"), F.col("fn").alias("to_fn"), F.col("cls").alias("to_cls"), F.explode("refs").alias("to_chain"), none.alias("node"))
    f = facts.select("project", "file", F.explode("functions").alias("x")).select("project", "file", "x.*")
    local = F.concat(F.when(F.col("cls").isNotNull(), F.concat("cls", F.lit("."))).otherwise(""), F.col("name"))
    functions = f.select("project", "file", none.alias("fn"), none.alias("cls"), local.alias("name"), F.lit(DEFINITION).alias("prio"), "ord", none.alias("to_file"), none.alias("to_fn"), none.alias("to_cls"), none.alias("to_chain"), node(F.col("cls"), F.col("name")).alias("node"))
    c = facts.select("project", "file", F.explode("classes").alias("x")).select("project", "file", "x.*")
    to = lambda df, name, prio, chain, cls=none: df.select("project", "file", none.alias("fn"), cls.alias("cls"), name.alias("name"), F.lit(prio).alias("prio"), "ord", F.col("file").alias("to_file"), none.alias("to_fn"), none.alias("to_cls"), chain.alias("to_chain"), none.alias("node"))
    classes = c.select("project", "file", none.alias("fn"), none.alias("cls"), "name", F.lit(DEFINITION).alias("prio"), "ord", none.alias("to_file"), none.alias("to_fn"), none.alias("to_cls"), none.alias("to_chain"), F.concat("file", F.lit(":"), "name").alias("node"))
    instances = to(c, F.concat("name", F.lit("()")), DEFINITION, F.col("name"))
    selves = c.withColumn("self", F.explode(F.array(F.lit("self"), F.lit("cls"), F.lit("this"))))
    own = to(selves, F.col("self"), DEFINITION, F.col("name"), F.col("name"))
    bases = to(c.withColumn("b", F.explode("bases")), F.col("name"), BASE, F.col("b"))
    out = bound.unionByName(functions).unionByName(classes).unionByName(instances).unionByName(own).unionByName(bases)
    out = out.withColumn("root", none)
    modules = module_names(facts).select("project", F.lit("").alias("file"), none.alias("fn"), none.alias("cls"), "name", F.lit(IMPORT).alias("prio"), F.lit(0).alias("ord"), "to_file", none.alias("to_fn"), none.alias("to_cls"), F.lit("").alias("to_chain"), none.alias("node"), "root")
    return out.unionByName(modules).coalesce(max(1, facts.rdd.getNumPartitions()))


def prefixes(chain: Column) -> Column:
    """All prefixes that end before a dot, a call or a subscript."""
    parts = F.regexp_extract_all(chain, F.lit(r"(@?[^.\[(]+|[.][^.\[(]+|\(\)|\[\])"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))


def resolve(refs: DataFrame, names: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(rid, node, identity, crossed) of each thing that a reference (rid, project, file, fn, cls, chain) comes to.

    node is a definition in the project. Otherwise identity is the chain that can't be followed further, absolute (``@``)
    if it leads out of the project. A reference may come to several things, as a list does to its elements. crossed is
    whether another file was entered on the way.

    References that stand in one scope and spell the same chain are followed once. A binding is used once on a way, so
    that ``x = x.next()`` and chains that lead back to themselves end there, and a place (scope and chain) that a
    reference has come to before is not visited again. What is still open after ``rounds`` rounds is given as it then
    reads. A round is one checkpoint.
    """
    none = F.lit(None).cast("string")
    scope = ["project", "file", "fn", "cls", "chain"]
    refs = refs.where("chain is not null and chain <> ''").select("rid", *scope)
    # ids are given as rows are checkpointed, so that they stay the same when a lost part is computed again
    starts = cut(refs.select(*scope).distinct().withColumn("pid", F.monotonically_increasing_id()))
    told = lambda cs: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cs))  # noqa: E731  (nulls alone don't change a hash)
    bound = names.withColumn("bid", told(names.columns))
    bound = bound.select("project", F.col("file").alias("key"), F.col("fn").alias("nfn"), F.col("cls").alias("ncls"), "name", "prio", "ord", "to_file", "to_fn", "to_cls", "to_chain", F.col("node").alias("to_node"), "root", "bid")
    place = ["file", "fn", "cls", "chain"]
    mark = told(["pid", *place]).alias("mark")
    active = starts.select("pid", *scope, F.array().cast("array<bigint>").alias("used"), F.lit(False).alias("crossed"))
    visited: DataFrame | None = None
    done: DataFrame | None = None
    for turn in range(rounds + 1):
        step = cut(_step(active, bound, followed=turn < rounds))
        if step.isEmpty():
            break
        ended = step.where("kind <> 'follow'").select("pid", "node", "identity", "crossed")
        done = ended if done is None else done.unionByName(ended)
        here = step.select(mark).distinct()
        visited = here if visited is None else visited.unionByName(here)
        follow = step.where("kind = 'follow'").select("pid", "project", F.col("to_file").alias("file"), F.col("to_fn").alias("fn"), F.col("to_cls").alias("cls"), F.col("new").alias("chain"), F.concat("used", F.array("bid")).alias("used"), (F.col("crossed") | (F.col("to_file") != F.col("file"))).alias("crossed"))
        follow = follow.groupBy("pid", "project", *place).agg(F.min("used").alias("used"), F.bool_or("crossed").alias("crossed"))
        active = follow.withColumn("mark", mark).join(visited, "mark", "left_anti").drop("mark")
    if done is None:
        return refs.where("false").select("rid", none.alias("node"), none.alias("identity"), F.lit(False).alias("crossed"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in scope]
    found = starts.join(done.distinct(), "pid").select(*scope, "node", "identity", "crossed")
    return cut(refs.alias("r").join(found.alias("s"), same).select("r.rid", "s.node", "s.identity", "s.crossed").distinct())


def _step(active: DataFrame, bound: DataFrame, followed: bool) -> DataFrame:
    """One row for each binding by which a place is left, with kind 'follow', or what a place ends at: 'node', 'module', or 'open' where no binding leads on."""
    none = F.lit(None).cast("string")
    state = ["pid", "project", "file", "fn", "cls", "chain", "used", "crossed"]
    absolute = F.col("chain").startswith("@")
    names = F.when(F.col("chain").startswith("#") | F.lit(not followed), F.array(F.lit(""))).otherwise(prefixes(F.col("chain")))
    tried = active.select(*state, F.explode(names).alias("name")).withColumn("key", F.when(absolute, "").otherwise(F.col("file")))
    hit = tried.join(bound, ["project", "key", "name"], "left").withColumn("rest", F.expr("substring(chain, length(name) + 1)"))
    scoped = (F.col("nfn").isNull() | F.col("nfn").eqNullSafe(F.col("fn"))) & (F.col("ncls").isNull() | F.col("ncls").eqNullSafe(F.col("cls")))
    whole = F.col("to_node").isNull() | F.col("rest").isin("", "[]")
    ok = F.coalesce(F.col("bid").isNotNull() & scoped & whole & ~F.array_contains("used", F.col("bid")), F.lit(False))
    hit = hit.withColumn("ok", ok)
    near = F.when(F.col("root") == folder(F.col("file")), 2).when(F.col("root") == "", 1).otherwise(0)
    order = [F.length("name").desc(), F.col("nfn").isNotNull().desc(), F.col("ncls").isNotNull().desc(), F.col("prio").desc(), near.desc(), F.length("root").asc_nulls_first(), F.col("ord").desc()]
    best = hit.withColumn("_r", F.rank().over(Window.partitionBy("pid", "file", "fn", "cls", "chain").orderBy(F.col("ok").desc(), *order))).where("_r = 1")
    new = F.when(F.col("to_chain") == "", F.regexp_replace("rest", "^[.]", "")).otherwise(F.concat("to_chain", "rest"))
    new = F.when(F.col("ok") & F.col("to_node").isNull(), new)
    kind = F.when(~F.col("ok"), "open").when(F.col("to_node").isNotNull(), "node").when(new == "", "module").otherwise("follow")
    out = best.withColumn("new", new).withColumn("kind", kind)
    identity = F.when(F.col("kind") == "open", F.col("chain")).when(F.col("kind") == "module", F.concat(F.lit("module:"), "to_file"))
    follow = F.col("kind") == "follow"
    kept = {"to_file": follow, "to_fn": follow, "to_cls": follow, "bid": follow}
    return out.select(*state, "kind", F.when(F.col("kind") == "node", F.col("to_node")).otherwise(none).alias("node"), identity.alias("identity"), F.when(follow, F.col("new")).alias("new"), *(F.when(c, F.col(n)).alias(n) for n, c in kept.items())).distinct()
