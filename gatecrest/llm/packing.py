"""Best-fit packing by hierarchical residuals.

Each partition packs its own documents best-fit, longest first, and emits the bins that are nearly full. Underfull bins
go up a tree: as items of their own they meet those of other partitions and are packed again. A bin that even the least
of the others doesn't fit is emitted as it is. That goes on until one node holds what is left, or a round merges nothing.

pack_in_order() packs within consecutive ranges of the rows' order instead, so that a curriculum outlives packing; its
tree is one of neighbouring ranges.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.llm.common import broadcast_if_small, cut
from gatecrest.llm.mixing import tokens

CAPACITY = 2048
#: Share of the capacity from which a bin counts as nearly full; underfull bins that one node takes.
FULL, NODE = 0.98, 20_000
#: Capacities that a range of pack_in_order() holds; nodes of its tree that one above takes.
RANGE, FAN = 256, 4

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int32()), ("offset", pa.int32())])
BIN = "bin_id string, used int, level int, items array<struct<doc_id:bigint,piece:int,start:bigint,tokens:int,offset:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each bin. Items go in the given order to the fullest bin that has room."""
    bins: list[list[int]] = []
    open_: list[tuple[int, int]] = []  # (room, bin), ascending
    for i, size in enumerate(sizes):
        k = bisect_left(open_, (size, -1))
        if k < len(open_):
            room, b = open_.pop(k)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            insort(open_, (room - size, b))
    return bins


def pieces(doc_id: int | None, n: int, capacity: int) -> list[dict]:
    """Whole capacities first, then the rest."""
    return [{"doc_id": doc_id, "piece": k, "start": k * capacity, "tokens": min(capacity, n - k * capacity)} for k in range(-(-n // capacity))]


def offsets(items: list[dict]) -> list[dict]:
    """The items with their places in the bin, one after another."""
    at = 0
    for p in items:
        p["offset"] = at
        at += p["tokens"]
    return items


def _round(df: DataFrame, level: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[dict]] = []
        for b in batches:
            if level:
                groups += b.column("items").to_pylist()
            else:
                for d, n in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist()):
                    groups += [[p] for p in pieces(d, n, capacity)]
        size = [sum(p["tokens"] for p in g) for g in groups]
        order = sorted(range(len(groups)), key=lambda i: (-size[i], (first := groups[i][0])["doc_id"] is None, first["doc_id"] or 0, first["piece"]))
        bins = best_fit([size[i] for i in order], capacity)
        me = TaskContext.get().partitionId()
        for s in range(0, len(bins), 2000):
            part = [offsets([p for i in b for p in groups[order[i]]]) for b in bins[s : s + 2000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{level}-{me}-{s + k}" for k in range(len(part))]), pa.array([sum(p["tokens"] for p in b) for b in part], pa.int32()), pa.array([level] * len(part), pa.int32()), pa.array(part, pa.list_(ITEM))],
                names=["bin_id", "used", "level", "items"],
            )

    return df.mapInArrow(run, BIN)


def pack(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, node: int = NODE) -> DataFrame:
    """(bin_id, bin_tokens, doc_id, piece, start, tokens, bin_offset): what each bin of ``capacity`` tokens holds, from where.

    A document longer than the capacity is cut into pieces of that length and a rest; ``start`` is the piece's first
    token. No token is lost, repeated or moved within its document. Documents without a token (null, empty or blank
    text) take no room and are left out. Null ids and repeated rows are packed as rows of their own. doc_id must be a
    number, or text that spells one. Only doc_id and text are read. No rows give no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens("text").alias("n")).where("n > 0")
    least = int(capacity * full)
    bins = cut(_round(narrow, 0, capacity))
    done = [bins.where(F.col("used") >= least)]
    rest, level = bins.where(F.col("used") < least), 0
    left, smallest = rest.agg(F.count("*"), F.min("used")).first()
    while left:
        # what the smallest of the rest doesn't fit into can't be merged with anything
        done.append(rest.where(F.col("used") + smallest > capacity))
        rest = rest.where(F.col("used") + smallest <= capacity)
        now = rest.count()
        if not now:
            break
        level += 1
        nodes = -(-now // node)
        bins = cut(_round(rest.repartition(nodes), level, capacity))
        if nodes == 1 or bins.count() == now:
            done.append(bins)
            break
        done.append(bins.where(F.col("used") >= least))
        rest = bins.where(F.col("used") < least)
        left, smallest = rest.agg(F.count("*"), F.min("used")).first()
    out = reduce(DataFrame.union, done)
    return out.select("bin_id", F.col("used").alias("bin_tokens"), F.explode("items").alias("x")).select("bin_id", "bin_tokens", "x.doc_id", "x.piece", "x.start", "x.tokens", F.col("x.offset").alias("bin_offset"))


def row_order(docs: DataFrame) -> DataFrame:
    """docs with _file and _row, the place of each row: in the files that docs is read from, or else in its partitions."""
    try:
        return docs.withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)).withColumn("_file", F.when(F.col("_file") != "", F.col("_file").cast("long")).otherwise(0)).withColumn("_row", F.col("_metadata.row_index"))
    except AnalysisException:
        return docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_file", F.shiftright("_row", 33))


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, range_: int = RANGE, tree: bool = False, full: float = FULL) -> DataFrame:
    """pack()'s columns and position, of docs whose row order counts: mixing.mixed() as it is, or written and read again.

    A document's offset is the number of tokens before it. Documents whose offsets lie in one range of ``range_``
    capacities are packed best-fit, longest first. A bin's position is the mean of its documents' offsets, weighted by
    their tokens in it, as a share of all tokens. The rows are range-sorted by position. As with pack(), no token is
    lost, repeated or moved within its document.

    Without ``tree`` bins of different ranges are never merged, so every bin of a range comes before those of the next.
    With it the underfull bins of neighbouring ranges go up a tree to its root and are merged best-fit, and merged ones
    lie at the mean of what they hold; see _merged().
    """
    narrow = cut(row_order(docs).select("_file", "_row", F.col("doc_id").cast("long").alias("doc_id"), tokens("text").alias("n")).where("n > 0"))
    files = narrow.groupBy("_file").agg(F.sum("n").alias("s"))
    before = files.select("_file", F.coalesce(F.sum("s").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a file
    total = narrow.agg(F.sum("n")).first()[0] or 1
    within = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.join(broadcast_if_small(before, files.count(), 40), "_file").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.select(F.floor(F.col("at") / (range_ * capacity)).alias("r"), "at", "doc_id", "n").repartition("r").sortWithinPartitions("r", "at")

    def packed(r: int, rows: list[tuple[int, int, int | None, int]]) -> Iterator[tuple]:
        items = [(at, p) for _, at, d, n in rows for p in pieces(d, n, capacity)]
        items.sort(key=lambda x: (-x[1]["tokens"], x[0], x[1]["piece"]))
        for k, b in enumerate(best_fit([p["tokens"] for _, p in items], capacity)):
            used, offset = sum(items[i][1]["tokens"] for i in b), 0
            position = sum(items[i][0] * items[i][1]["tokens"] for i in b) / used / total
            for i in sorted(b, key=lambda i: (items[i][0], items[i][1]["piece"])):  # in order within the bin, too
                at, p = items[i]
                yield f"{r}-{k}", used, p["doc_id"], p["piece"], p["start"], p["tokens"], offset, position, r, at
                offset += p["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for r, part in groupby(rows, key=lambda x: x[0]):
            out = list(packed(r, list(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
    names = ["bin_id", "bin_tokens", "doc_id", "piece", "start", "tokens", "bin_offset", "position", "r", "at"]
    out = cut(placed.mapInArrow(run, "bin_id string, bin_tokens int, doc_id long, piece int, start long, tokens int, bin_offset int, position double, r long, at long"))
    if tree:
        out = _merged(out, -(-total // (range_ * capacity)), capacity, int(capacity * full))
    return out.select(names[:-2]).repartitionByRange("position", "bin_id").sortWithinPartitions("position", "bin_id", "bin_offset")


def _merged(rows: DataFrame, ranges: int, capacity: int, least: int) -> DataFrame:
    """The rows of the bins of ``ranges`` ranges, where bins of fewer than ``least`` tokens have gone up a tree of them.

    A node takes the underfull bins of FAN neighbours and packs them best-fit, longest first, as items of their own. Of
    the bins that best fit leaves no two fit together, so that a node has at most one of half the capacity or less, and
    only these are ever put into others: FAN a node, each into one bin. So FAN bins of each number of tokens for each
    level are all that a node can have use for; that many go up, and no merge is lost by the others' staying. A merged
    bin has the id of the first that it is made of.
    """
    levels = 0
    while FAN**levels < ranges:
        levels += 1
    useful = FAN * levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for node, part in groupby(bins, key=lambda x: x[0]):
            part, out, sent = sorted(part, key=lambda x: (-x[1], x[2], x[3])), [], Counter()
            for b in best_fit([used for _, used, *_ in part], capacity):
                used = sum(part[i][1] for i in b)
                sent[used] += 1
                made_of = [m for i in sorted(b, key=lambda i: part[i][2:4]) for m in part[i][3]]
                out.append((node, used, sum(part[i][1] * part[i][2] for i in b) / used, made_of, used < least and sent[used] <= useful))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
    names = ["node", "used", "position", "made_of", "up"]
    underfull = rows.where(F.col("bin_tokens") < least)
    done, rest = [], underfull.where("bin_offset = 0").select(F.col("r").alias("node"), F.col("bin_tokens").alias("used"), "position", F.array("bin_id").alias("made_of"))
    for _ in range(levels):
        if rest.where(F.col("used") * 2 <= capacity).isEmpty():  # nothing that could be put into another
            break
        nodes = rest.withColumn("node", F.floor(F.col("node") / FAN)).repartition("node").sortWithinPartitions("node")
        bins = cut(nodes.mapInArrow(run, "node long, used int, position double, made_of array<string>, up boolean"))
        done.append(bins.where("not up").drop("up"))
        rest = bins.where("up").drop("up")
    merged = reduce(DataFrame.union, [*done, rest]).where(F.size("made_of") > 1)
    merged = cut(merged.select(F.col("made_of")[0].alias("_id"), "used", F.col("position").alias("_position"), F.explode("made_of").alias("bin_id")))
    one = underfull.join(broadcast_if_small(merged, merged.count(), 100), "bin_id")
    before = Window.partitionBy("_id").orderBy("at", "piece").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("bin_offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("int")).withColumn("bin_id", F.col("_id")).withColumn("bin_tokens", F.col("used")).withColumn("position", F.col("_position"))
    return cut(rows.join(broadcast_if_small(merged.select("bin_id"), merged.count(), 40), "bin_id", "left_anti").select(rows.columns).union(one.select(rows.columns)))
