"""Near duplicates by a Jaccard join of word n-gram sets over signature trees.

1. One pass over the texts gives each document a sketch: size and hash of its n-gram set, a bitmap of its grams, and
   ``BANDS`` keys of ``ROWS`` min-hashes each. Documents with the same set are a class, of which one goes on.
2. Sets that share a key meet in a block. A block is a job; that of more than ``PART`` sets is cut into parts by size class
   and hash, and every two parts whose size ranges leave the threshold possible make a job of their own, so that no task
   holds more than two parts and no pair is lost.
3. In a job the sets become the leaves of signature trees, whose nodes hold the OR of the bitmaps below, their least bit
   count and the range of sizes. Dual traversal, level by level for all jobs at hand, drops the pairs of nodes whose
   greatest possible overlap is too small, then pairs of sets by the same bounds.
4. Surviving pairs are verified on the exact sets. Sets that have a neighbour in common share a tile of bounded size, and
   a set is sent once for every two tiles that have pairs, not once a pair.
5. The connected components of verified pairs and classes are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecrest.llm.common import binary_rows, broadcast_if_small, cut, give_back, list_array, slices, small_batches, string_buffers
from gatecrest.llm.components import connected_components
from gatecrest.llm.tokens import SLICE, Tokenizer, mix, ngrams

N, THRESHOLD, BANDS, ROWS = 3, 0.5, 24, 2
#: Bits of the bitmap that every set has, and of the wider one of sets of more than WIDE_FROM grams.
BITS, WIDE_BITS, WIDE_FROM = 2048, 16384, 1500
#: Sets in a leaf and children of a node.
LEAF, FAN = 8, 8
#: Sets of a part: a block of more is cut.
PART = 4096
#: Weight of the sets of a tile, where a set weighs as many as its grams and SET_WEIGHT more.
TILE, SET_WEIGHT = 1 << 20, 512
#: Pairs that are looked at in one step; bounds the working memory.
STEP = 1 << 14


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text, in order."""
    tokenizer = Tokenizer()
    for lo, hi in slices(string_buffers(texts)[0], SLICE):
        grams, off = ngrams(tokenizer(texts.slice(lo, hi - lo)), n)
        for k in range(hi - lo):
            yield np.unique(grams[off[k] : off[k + 1]])


def min_hashes(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One minimum for each seed; long sets go through in pieces."""
    low = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (x[None, k : k + 1024] * seeds[:, None]).min(axis=1), out=low)
    return low


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    b = np.zeros(bits, np.uint8)
    b[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(b).view(np.uint64)


def set_hash(grams: np.ndarray) -> int:
    return int((mix(grams).sum(dtype=np.uint64) ^ mix(np.array([len(grams)], np.uint64))[0]).astype(np.int64))


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, set_hash, keys, bits, wide) of each text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(20_15).integers(1, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            ids, out = b.column(0).to_numpy(zero_copy_only=False), []
            for i, g in zip(ids, gram_sets(b.column(1), n)):
                if len(g):
                    low = min_hashes(g, seeds).reshape(bands, rows).astype(np.uint64)
                    key = salt.copy()
                    for r in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
                    out.append((i, len(g), set_hash(g), key, bitmap(g, BITS), bitmap(g, WIDE_BITS).tobytes() if len(g) > WIDE_FROM else None))
            if out:
                i, size, same, key, bits, wide = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(size, pa.int32()), pa.array(same, pa.int64()), list_array(np.concatenate(key).view(np.int64), np.arange(len(out) + 1) * bands, pa.int64()), binary_rows(np.stack(bits)), pa.array(wide, pa.binary())],
                    names=["doc_id", "n", "set_hash", "keys", "bits", "wide"],
                )
        give_back()

    return docs.mapInArrow(run, "doc_id long, n int, set_hash long, keys array<long>, bits binary, wide binary")


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def products(i: np.ndarray, j: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of what is below the nodes i and j of each pair; below a pair of one node with itself each pair once."""
    a, b = end[i] - start[i], end[j] - start[j]
    total = a * b
    at = np.repeat(np.arange(len(i)), total)
    nth = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    x, y = start[i][at] + nth // b[at], start[j][at] + nth % b[at]
    return x, y, (i == j)[at]


@dataclass
class Forest:
    """The signature trees of several jobs, one for each side of a job, and their dual traversal.

    Rows come ordered by job, side and size. A job without rows of side 1 is held against itself, others across sides.
    """

    n: np.ndarray
    bits: np.ndarray
    wide: list
    keys: np.ndarray
    band: np.ndarray
    threshold: float
    #: Node pairs that were looked at and those dropped, pairs of sets that were compared and those dropped.
    seen: dict[str, int] = field(default_factory=lambda: {"nodes": 0, "nodes dropped": 0, "sets": 0, "sets dropped": 0})

    def build(self, job: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Builds all levels, leaves first; the pairs of roots that are to be traversed."""
        m = len(self.n)
        self.pop = bit_count(self.bits)
        first = np.flatnonzero(np.concatenate([[True], (job[1:] != job[:-1]) | (side[1:] != side[:-1])])) if m else np.zeros(0, np.int64)
        run_job, run_side = job[first], side[first]
        sizes = np.diff(np.append(first, m))
        starts = lambda counts, width: np.concatenate([np.arange(f, f + c, width) for f, c in zip(np.cumsum(counts) - counts, counts)]) if len(counts) else np.zeros(0, np.int64)
        low, self.levels = {"or": self.bits, "lost": self.n - self.pop, "min": self.n, "max": self.n}, []
        width = LEAF
        while True:
            at = starts(sizes, width)
            end = np.append(at[1:], len(low["min"]))
            low = {"start": at, "end": end, "or": np.bitwise_or.reduceat(low["or"], at, axis=0), "lost": np.maximum.reduceat(low["lost"], at), "min": np.minimum.reduceat(low["min"], at), "max": np.maximum.reduceat(low["max"], at)} if m else {}
            self.levels.append(low)
            sizes, width = -(-sizes // width), FAN
            if not m or sizes.max() == 1:
                break
        root = np.arange(len(run_job))
        same = np.flatnonzero(run_job[1:] == run_job[:-1])
        alone = np.ones(len(root), bool)
        alone[same] = alone[same + 1] = False
        return np.concatenate([root[alone & (run_side == 0)], same]), np.concatenate([root[alone & (run_side == 0)], same + 1])

    def possible(self, lv: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether some set below i and some below j can reach the threshold: by their size ranges, and by the greatest overlap that the bits leave open.

        A set of n grams and p bits of which at most c are set on the other side has at least p - c grams that the other
        lacks, so at most n - p + c in common with it. lost is the greatest n - p below a node.
        """
        t = self.threshold
        ok = (lv["max"][i] >= t * lv["min"][j]) & (lv["max"][j] >= t * lv["min"][i])
        common = bit_count(lv["or"][i] & lv["or"][j])
        most = np.minimum(np.minimum(lv["max"][i], lv["lost"][i] + common), np.minimum(lv["max"][j], lv["lost"][j] + common))
        return ok & (most * (1 + t) >= t * (lv["min"][i] + lv["min"][j]))

    def pairs(self, job: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows x and y of pairs that can reach the threshold."""
        i, j = self.build(job, side)
        yield from self.walk(len(self.levels) - 1, i, j)

    def walk(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lv = self.levels[level]
        for s in range(0, len(i), STEP):
            a, b = i[s : s + STEP], j[s : s + STEP]
            keep = (a == b) | self.possible(lv, a, b)
            self.seen["nodes"] += len(a)
            self.seen["nodes dropped"] += int((~keep).sum())
            a, b = a[keep], b[keep]
            # below a node at most FAN or LEAF children, so a step grows by their square at most
            x, y, twice = products(a, b, lv["start"], lv["end"])
            if level:
                once = ~twice | (x <= y)
                yield from self.walk(level - 1, x[once], y[once])
            else:
                once = ~twice | (x < y)
                yield from self.compare(x[once], y[once])

    def compare(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of pairs of sets those that their sizes and bits leave open, in the block of the first band they share."""
        for s in range(0, len(x), STEP):
            p, q = x[s : s + STEP], y[s : s + STEP]
            ok = np.minimum(self.n[p], self.n[q]) >= self.threshold * np.maximum(self.n[p], self.n[q])
            self.seen["sets"] += len(p)
            p, q = p[ok], q[ok]
            ok = (self.keys[p] == self.keys[q]).argmax(axis=1) == self.band[p]
            p, q = p[ok], q[ok]
            ok = open_(self.n[p], self.n[q], self.bits[p], self.bits[q], self.threshold)
            p, q = p[ok], q[ok]
            ok = np.array([self.wide[a] is None or self.wide[b] is None or bool(open_(self.n[[a]], self.n[[b]], np.frombuffer(self.wide[a], np.uint64)[None], np.frombuffer(self.wide[b], np.uint64)[None], self.threshold)[0]) for a, b in zip(p.tolist(), q.tolist())], bool)
            self.seen["sets dropped"] += len(x[s : s + STEP]) - int(ok.sum())
            if ok.any():
                yield p[ok], q[ok]


def open_(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Whether pairs of sets can reach the threshold: a gram of one whose bit the other lacks is not shared."""
    most = np.minimum(na - bit_count(a & ~b), nb - bit_count(b & ~a))
    return most * (1 + t) >= t * (na + nb)


def jobs(sets: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """(job, side, band, set_hash) of rows (set_hash, n, keys): the sets that each job compares. See the module's head."""
    keyed = sets.select("set_hash", "n", F.posexplode("keys").alias("band", "key"))
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    known = keyed.join(broadcast_if_small(counts, counts.count(), 40), "key")
    whole = known.where(F.col("c") <= part).select(F.xxhash64("key").alias("job"), F.lit(0).alias("side"), "band", "set_hash")
    if counts.where(F.col("c") > part).isEmpty():
        return whole
    # two sets whose sizes leave the threshold possible are of one size class or of neighbouring ones
    hot = known.where(F.col("c") > part).withColumn("parts", F.ceil(F.col("c") / part).cast("int")).withColumn("cls", F.floor(F.log("n") / F.lit(float(-np.log(threshold)) * (1 + 1e-9))).cast("int"))
    hot = hot.withColumn("p", F.pmod(F.xxhash64("set_hash", F.lit(11)), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    to = lambda c1, c2, a, b, side: F.struct(F.xxhash64("key", c1, c2, a, b).alias("job"), side.cast("int").alias("side"))
    each = F.array(
        to(F.col("cls"), F.col("cls"), low, high, F.col("p") > F.col("q")),
        to(F.col("cls"), F.col("cls") + 1, F.col("p"), F.col("q"), F.lit(0)),
        to(F.col("cls") - 1, F.col("cls"), F.col("q"), F.col("p"), F.lit(1)),
    )
    cut_ = hot.select("band", "set_hash", (F.col("p") == F.col("q")).alias("own"), F.posexplode(each).alias("k", "x"))
    # of a job across parts both sides must have rows, or its only side would be held against itself again
    cut_ = cut_.select("x.job", "x.side", "band", "set_hash", (F.col("own") & (F.col("k") == 0)).alias("own"))
    both = cut_.groupBy("job").agg(F.bool_or("own").alias("own"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("own or lo <> hi").select("job")
    return whole.union(cut_.join(both, "job").select("job", "side", "band", "set_hash"))


def candidates(sets: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """Pairs (a, b) of set hashes, a < b, each once, that signature trees leave open. sets: (set_hash, n, keys, bits, wide), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            job, side, band, ids, n = (t.column(c).to_numpy() for c in ("job", "side", "band", "set_hash", "n"))
            fixed = lambda c, dtype: string_buffers(t.column(c))[1].view(dtype).reshape(len(ids), -1)
            wide = t.column("wide").to_pylist() if t.column("wide").null_count < len(ids) else [None] * len(ids)
            forest = Forest(n.astype(np.int64), fixed("bits", np.uint64), wide, t.column("short").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), band, threshold)
            for x, y in forest.pairs(job, side):
                a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            job = batch.column("job").to_numpy()
            cut_ = int(np.searchsorted(job, job[-1]))  # the last job may go on in the next batch
            if cut_:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut_)]))
                held = []
            held.append(batch.slice(cut_))
        if held:
            yield from done(pa.Table.from_batches(held))
        held.clear()
        give_back()

    narrow = jobs(sets.select("set_hash", "n", "keys"), threshold, part)
    short = F.transform("keys", lambda k: F.pmod(k, F.lit(1 << 31)).cast("int"))  # enough to tell which bands two sets share
    rows = narrow.join(sets.select("set_hash", "n", "bits", "wide", short.alias("short")), "set_hash")
    rows = rows.select("job", "side", "band", "set_hash", "n", "bits", "wide", "short").repartition("job").sortWithinPartitions("job", "side", "n", "set_hash")
    return rows.mapInArrow(run, "a long, b long")


def tiles(pairs: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """(set_hash, tile) of the sets of pairs. A set goes with the least of its neighbours and itself, and what goes with one set is cut by a hash into tiles of about the given weight."""
    ends = pairs.select(F.col("a").alias("set_hash"), F.col("a").alias("o")).union(pairs.select(F.col("b"), F.col("a")))
    hubs = cut(ends.groupBy("set_hash").agg(F.min("o").alias("hub")).join(sizes, "set_hash"))
    cuts = hubs.groupBy("hub").agg(F.ceil(F.sum(F.col("n").cast("long") + SET_WEIGHT) / tile).alias("cuts"))
    large = cuts.where("cuts > 1")
    part = F.pmod(F.xxhash64("set_hash", F.lit(17)), F.coalesce("cuts", F.lit(1)))
    return cut(hubs.join(broadcast_if_small(large, large.count(), 32), "hub", "left").select("set_hash", F.xxhash64("hub", part).alias("tile")))


def verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, sizes: DataFrame, n: int, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, jaccard) of the pairs of set hashes whose exact sets reach the threshold. firsts: a document (set_hash, doc_id) of each set; sizes: (set_hash, n)."""
    at = tiles(pairs, sizes, tile)
    small = at.count()
    end = lambda c: broadcast_if_small(at.select(F.col("set_hash").alias(c), F.col("tile").alias("t" + c)), small, 40)
    work = cut(pairs.join(end("a"), "a").join(end("b"), "b").select(F.xxhash64(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("job"), "a", "b"))
    needed = cut(work.select("job", F.explode(F.array("a", "b")).alias("set_hash")).distinct())
    sent = needed.count()
    ids = cut(at.select("set_hash").join(firsts, "set_hash").select("doc_id").distinct())
    texts = docs.join(broadcast_if_small(ids, ids.count(), 40), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(set_hash(g), g.tobytes()) for g in gram_sets(b.column(0), n) if len(g)]
            for k in range(0, len(found), 500):
                h, g = zip(*found[k : k + 500])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.binary())], names=["set_hash", "grams"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held = None, {}
        for batch in batches:
            out = []
            for j, a, b, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if j != job:
                    job, held = j, {}
                if b is None:
                    held[a] = np.frombuffer(g.as_buffer(), np.uint64).copy()
                    continue
                x, y = held[a], held[b]
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append((a, b, both / (len(x) + len(y) - both)))
            out = [o for o in out if o[2] >= threshold]
            if out:
                a, b, j_ = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j_, pa.float64())], names=["a", "b", "jaccard"])
        held.clear()
        give_back()

    grams = texts.select("text").mapInArrow(sets, "set_hash long, grams binary")
    if texts.select("doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
        grams = grams.groupBy("set_hash").agg(F.first("grams").alias("grams"))  # rows that repeat an id send its set once
    held = grams.join(broadcast_if_small(needed, sent, 40), "set_hash").select("job", F.col("set_hash").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    both = held.union(work.select("job", "a", "b", F.lit(None).cast("binary"))).repartition("job").sortWithinPartitions("job", F.col("b").asc_nulls_first())
    return both.mapInArrow(compare, "a long, b long, jaccard double")


def class_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, part: int = PART, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of documents with the same set, and the pairs of classes.

    (set_hash, first, n_docs) of each class, first being its least document; (set_hash, doc_id) of the members of classes
    of several documents; (a, b, jaccard) of every two set hashes whose sets reach the threshold.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    sketch = cut(sketches(docs, n, bands, rows))
    members = sketch.select("set_hash", "doc_id").distinct()
    classes = cut(members.groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs")))
    several = classes.where("n_docs > 1").select("set_hash", "first")
    copies = cut(members.join(broadcast_if_small(several, several.count(), 40), "set_hash").select("set_hash", "first", "doc_id"))
    gone = copies.where("first <> doc_id").select("set_hash", "doc_id")
    rest = sketch.join(broadcast_if_small(gone, gone.count(), 40), ["set_hash", "doc_id"], "left_anti")
    if sketch.count() > (classes.agg(F.sum("n_docs")).first()[0] or 0):
        rest = rest.dropDuplicates(["set_hash"])  # rows that repeat an id
    pairs = cut(candidates(rest, threshold, part))
    firsts = classes.select("set_hash", F.col("first").alias("doc_id"))
    return classes, copies, cut(verified(docs, firsts, pairs, rest.select("set_hash", "n"), n, threshold, tile))


def groups(classes: DataFrame, copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate."""
    end = lambda c, to: classes.select(F.col("set_hash").alias(c), F.col("first").alias(to))
    edges = pairs.join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v").union(copies.where("first <> doc_id").select(F.col("first").alias("u"), F.col("doc_id").alias("v")))
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, part: int = PART, tile: int = TILE) -> DataFrame:
    """(doc_id, group_id, group_size, class_id, links, match_id, jaccard) of every document that has a near duplicate.

    Two documents are near duplicates if the Jaccard coefficient of their sets of word n-grams is at least
    ``threshold``; groups are closed under that relation, and group_id is a group's least doc_id. class_id is the least
    document of the same set, links the number of other documents that reach the threshold with this set, all of them
    counted, and match_id the nearest (of equal ones the least id). class_pairs() gives the linked pairs of classes.

    Documents whose doc_id or text is null, or whose text has no word, match nothing and are not in the result. A text
    of fewer than n words has one gram. Rows with the same doc_id are one document, similar where any of its texts is;
    it has a row for each of its sets that matches another document. doc_id must be a number, or text that spells one.
    Only doc_id and text are read, so other columns, whatever their names, change nothing. No rows give no rows.
    """
    classes, copies, linked = class_pairs(docs, n, threshold, bands, rows, part, tile)
    group = cut(groups(classes, copies, linked))
    sizes = group.groupBy("group_id").agg(F.count("*").alias("group_size"))
    seconds = copies.where("first <> doc_id").groupBy("set_hash").agg(F.min("doc_id").alias("second"))
    known = linked.select(F.explode(F.array("a", "b")).alias("set_hash")).union(copies.select("set_hash")).distinct()
    sets = cut(classes.join(known, "set_hash").join(seconds, "set_hash", "left"))
    ends = linked.select(F.col("a").alias("set_hash"), F.col("b").alias("o"), "jaccard").union(linked.select(F.col("b").alias("set_hash"), F.col("a").alias("o"), "jaccard"))
    few = sets.count()
    side = lambda *c: broadcast_if_small(sets.select(*c), few, 64)
    ends = ends.join(side("set_hash", "first"), "set_hash").join(side(F.col("set_hash").alias("o"), F.col("first").alias("o1"), F.col("second").alias("o2"), F.col("n_docs").alias("on")), "o")
    other = F.when(F.col("o1") != F.col("first"), F.col("o1")).otherwise(F.col("o2"))  # of a set of one document
    best: Column = F.max(F.when(other.isNotNull(), F.struct("jaccard", (-other).alias("m")))).alias("best")
    lists = ends.groupBy("set_hash").agg(best, F.sum("on").alias("others"))
    sets = sets.join(lists, "set_hash", "left").withColumn("links", F.coalesce("others", F.lit(0)) + F.col("n_docs") - 1)
    match = lambda df, m, j: df.select("doc_id", F.col("first").alias("class_id"), "links", m.alias("match_id"), j.alias("jaccard"))
    mine = match(sets.withColumn("doc_id", F.col("first")), F.coalesce("second", -F.col("best.m")), F.when(F.col("second").isNotNull(), 1.0).otherwise(F.round("best.jaccard", 6)))
    theirs = match(copies.where("first <> doc_id").select("set_hash", "doc_id").join(sets, "set_hash"), F.col("first"), F.lit(1.0))
    out = mine.where("match_id is not null").union(theirs)
    return out.join(group, "doc_id").join(sizes, "group_id").select("doc_id", "group_id", "group_size", "class_id", "links", "match_id", "jaccard")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those whose document is in a group of which it isn't the least doc_id.

    Of rows with the same doc_id all stay or all go, so repeated rows of a kept document stay. Rows with a null doc_id or
    text, or with no word, stay. All columns are kept.
    """
    gone = cut(groups(*class_pairs(docs, n, threshold)).where("doc_id <> group_id").select(F.col("doc_id").alias("_gone")))
    return docs.join(broadcast_if_small(gone, gone.count(), 40), docs["doc_id"] == gone["_gone"], "left_anti")
