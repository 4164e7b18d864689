"""Resolution and reachability project by project, for projects that fit a task.

Projects don't see one another, so one of bounded size is followed to its end in one grouped task, where the joins of
operators.resolve and operators.reach would take a job a round. Both ways give the same rows; larger projects go by the
joins. The bounds are on rows of a project, so what a task holds doesn't grow with the number of projects.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecrest.operators import reach, resolve
from gatecrest.operators.checkpoints import cut

#: Rows of names, and edges, of a project that one task takes.
NAMES, EDGES = 200_000, 200_000
PARTS = re.compile(r"@?[^.\[(]+|[.][^.\[(]+|\(\)|\[\]")
FOUND = "rid string, node string, identity string, crossed boolean"
PATHS = "root string, node string, path array<string>, ords array<int>, depth int"


class Names:
    """The names of a project, by the file and the name they are looked up in."""

    def __init__(self, table: pa.Table) -> None:
        self.at: dict[tuple[str, str], list[tuple]] = {}
        columns = (table.column(c).to_pylist() for c in ("file", "name", "fn", "cls", "prio", "ord", "to_file", "to_fn", "to_cls", "to_chain", "node", "root"))
        seen = set()
        for row in zip(*columns):
            if row not in seen:
                seen.add(row)
                self.at.setdefault(row[:2], []).append(row[2:])

    def best(self, file: str, fn: str | None, cls: str | None, chain: str, used: frozenset) -> tuple[str, list[tuple]]:
        """The rest of the chain after its longest known prefix, and the names it stands for there; none where nothing is known."""
        if chain.startswith("#"):
            return chain, []
        key = "" if chain.startswith("@") else file
        parts = PARTS.findall(chain)
        folder = file.rpartition("/")[0]
        for k in range(len(parts), 0, -1):
            name = "".join(parts[:k])
            rows = self.at.get((key, name))
            if not rows:
                continue
            rest = chain[len(name) :]
            top, found = None, []
            for r in rows:
                nfn, ncls, prio, order, node, root = r[0], r[1], r[2], r[3], r[8], r[9]
                if (nfn is None or nfn == fn) and (ncls is None or ncls == cls) and (node is None or rest in ("", "[]")) and (key, name, r) not in used:
                    near = 0 if root is None else 2 if root == folder else 1 if root == "" else 0
                    rank = (nfn is not None, ncls is not None, prio, near, 1 if root is None else -len(root), order)
                    if top is None or rank > top:
                        top, found = rank, [r]
                    elif rank == top:
                        found.append(r)
            if found:
                return rest, [(key, name, r) for r in found]
        return chain, []


def followed(names: Names, start: tuple, rounds: int) -> set[tuple]:
    """(node, identity, crossed) of what a place (file, fn, cls, chain) comes to; see operators.resolve."""
    out: set[tuple] = set()
    visited: set[tuple] = set()
    active: dict[tuple, tuple[frozenset, bool]] = {start: (frozenset(), False)}
    for turn in range(rounds + 1):
        visited |= active.keys()
        new: dict[tuple, tuple[frozenset, bool]] = {}
        for (file, fn, cls, chain), (used, crossed) in active.items():
            rest, found = names.best(file, fn, cls, chain, used) if turn < rounds else (chain, [])
            if not found:
                out.add((None, chain, crossed))
            for key in found:
                to_file, to_fn, to_cls, to_chain, node, _ = key[2][4:]
                if node is not None:
                    out.add((node, None, crossed))
                    continue
                to = (rest[1:] if rest.startswith(".") else rest) if to_chain == "" else to_chain + rest
                if to == "":
                    out.add((None, f"module:{to_file}", crossed))
                    continue
                place = (to_file, to_fn, to_cls, to)
                if place not in visited:
                    had = new.get(place)
                    new[place] = (had[0] if had else used | {key}, crossed or to_file != file or bool(had and had[1]))
        active = new
        if not active:
            break
    return out


def _resolved(refs: pa.Table, names: pa.Table, rounds: int) -> pa.Table:
    known, memo, out = Names(names), {}, []
    for rid, *place in zip(*(refs.column(c).to_pylist() for c in ("rid", "file", "fn", "cls", "chain"))):
        key = tuple(place)
        if key not in memo:
            memo[key] = followed(known, key, rounds)
        out += [(rid, *f) for f in memo[key]]
    schema = pa.schema([("rid", pa.string()), ("node", pa.string()), ("identity", pa.string()), ("crossed", pa.bool_())])
    columns = zip(*out) if out else ((), (), (), ())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def split(keyed: DataFrame, limit: int) -> tuple[bool, list[str]]:
    """Whether projects of up to limit rows are there, and those of more, which are few as each has so many rows."""
    sizes = keyed.groupBy("project").agg((F.count("*") > limit).alias("large"))
    some = sizes.groupBy("large").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("large"), F.col("project"))).alias("projects")).collect()
    return any(not r.large for r in some), [p for r in some if r.large for p in r.projects]


def resolved(refs: DataFrame, names: DataFrame, rounds: int = resolve.MAX_ROUNDS, limit: int = NAMES) -> DataFrame:
    """What resolve.resolve() gives. names is a cut table; a project without names resolves nothing and is taken by a task."""
    refs = refs.where("chain is not null and chain <> ''").select(F.col("rid").cast("string").alias("rid"), "project", "file", "fn", "cls", "chain")
    _, large = split(names, limit)
    out = None
    if large:
        out = resolve.resolve(refs.where(F.col("project").isin(large)), names.where(F.col("project").isin(large)), rounds)
        refs, names = refs.where(~F.col("project").isin(large)), names.where(~F.col("project").isin(large))
    refs, names = refs.toDF(*refs.columns), names.toDF(*names.columns)  # both may come from one table
    here = refs.groupBy("project").cogroup(names.groupBy("project")).applyInArrow(lambda a, b: _resolved(a, b, rounds), FOUND)
    return cut(here if out is None else here.unionByName(out))


def first_found(root: str, out: dict[str, list[tuple[int, str]]], max_nodes: int) -> Iterator[tuple[str, tuple, tuple]]:
    """(node, path, ords) of the first simple path, in depth-first order, to each node.

    A traversal that marks nodes for good gives these paths: what an earlier branch left marked can't lead to an unmarked
    node without passing the present path. Where one is longer than max_nodes, paths are enumerated within that bound.
    """
    found = {root: ((root,), (0,))}
    stack = [(root, iter(out.get(root, ())))]
    path, ords = [root], [0]
    long = False
    while stack:
        for order, dst in stack[-1][1]:
            if dst not in found:
                path.append(dst)
                ords.append(order)
                found[dst] = (tuple(path), tuple(ords))
                long |= len(path) > max_nodes
                stack.append((dst, iter(out.get(dst, ()))))
                break
        else:
            stack.pop()
            path.pop()
            ords.pop()
    if long:
        found = bounded(root, out, max_nodes)
    for node, (p, o) in found.items():
        yield node, p, o


def distances(start: str, out: dict[str, list[tuple[int, str]]], limit: int) -> dict[str, int]:
    d, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if d[x] < limit:
            for _, y in out.get(x, ()):
                if y not in d:
                    d[y] = d[x] + 1
                    queue.append(y)
    return d


def bounded(root: str, out: dict[str, list[tuple[int, str]]], max_nodes: int) -> dict[str, tuple[tuple, tuple]]:
    """First simple paths of at most max_nodes nodes, by depth-first enumeration. Branches from which no node still missing is near enough are left out."""
    missing = set(distances(root, out, max_nodes - 1)) - {root}
    found = {root: ((root,), (0,))}
    near: dict[str, dict[str, int]] = {}
    stack, path, ords, on = [iter(out.get(root, ()))], [root], [0], {root}
    while stack and missing:
        for order, dst in stack[-1]:
            if dst in on or len(path) >= max_nodes:
                continue
            left = max_nodes - len(path) - 1
            if dst not in near:
                near[dst] = distances(dst, out, max_nodes)
            d = near[dst]
            if not any(d.get(m, max_nodes) <= left for m in missing):
                continue
            path.append(dst)
            ords.append(order)
            on.add(dst)
            if dst in missing:
                missing.discard(dst)
                found[dst] = (tuple(path), tuple(ords))
            stack.append(iter(out.get(dst, ())))
            break
        else:
            stack.pop()
            on.discard(path.pop())
            ords.pop()
    return found


def nearest_found(root: str, out: dict[str, list[tuple[int, str]]], max_depth: int) -> Iterator[tuple[str, tuple, tuple]]:
    """(node, path, ords) of a shortest path to each node within max_depth edges; of equally short ones the least ords."""
    level, found = {root: ((root,), (0,))}, {}
    for _ in range(max_depth + 1):
        found |= level
        new: dict[str, tuple[tuple, tuple]] = {}
        for node, (p, o) in level.items():
            for order, dst in out.get(node, ()):
                if dst not in found and (dst not in new or (*o, order) < new[dst][1]):
                    new[dst] = ((*p, dst), (*o, order))
        level = new
        if not level:
            break
    for node, (p, o) in found.items():
        yield node, p, o


def _paths(roots: pa.Table, edges: pa.Table, search: Callable) -> pa.Table:
    out: dict[str, list[tuple[int, str]]] = {}
    for s, d, o in zip(*(edges.column(c).to_pylist() for c in ("src", "dst", "ord"))):
        out.setdefault(s, []).append((o, d))
    for v in out.values():
        v.sort()
    rows = [(r, n, list(p), list(o), len(p) - 1) for r in dict.fromkeys(roots.column("root").to_pylist()) for n, p, o in search(r, out)]
    schema = pa.schema([("root", pa.string()), ("node", pa.string()), ("path", pa.list_(pa.string())), ("ords", pa.list_(pa.int32())), ("depth", pa.int32())])
    columns = zip(*rows) if rows else ((),) * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def paths(roots: DataFrame, edges: DataFrame, first: bool, bound: int, limit: int = EDGES) -> DataFrame:
    """What reach.first_paths() gives within bound nodes, or reach.shortest_paths() within bound edges, of roots (project, root) over edges (project, src, dst, ord), which are a cut table."""
    edges = edges.select("project", "src", "dst", F.col("ord").cast("int").alias("ord"))
    _, large = split(edges, limit)
    out = None
    if large:
        r, e = roots.where(F.col("project").isin(large)).select("root"), edges.where(F.col("project").isin(large)).select("src", "dst", "ord")
        out = reach.first_paths(r, e, bound).withColumn("depth", F.size("path") - 1) if first else reach.shortest_paths(r, e, bound)
        roots, edges = roots.where(~F.col("project").isin(large)), edges.where(~F.col("project").isin(large))
    search = (lambda r, o: first_found(r, o, bound)) if first else (lambda r, o: nearest_found(r, o, bound))
    roots, edges = roots.toDF(*roots.columns), edges.toDF(*edges.columns)
    here = roots.groupBy("project").cogroup(edges.groupBy("project")).applyInArrow(lambda a, b: _paths(a, b, search), PATHS)
    return here if out is None else here.unionByName(out.select(here.columns))
