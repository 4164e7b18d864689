"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds (RaBitQ; Gao and Long, 2024).

Vectors are normalised, so inner products are cosines. Each is stored in the list of its nearest centroid as the sign
bits of its rotated residual, the residual's norm and the code's own inner product with it. A query visits the lists of
its ``probes`` nearest centroids; there an estimate of each inner product, with a bound on its error, chooses the vectors
whose exact product is computed: those whose upper bound reaches the k-th lower bound. Every row is in the index; queries
are the rows whose id is divisible by ``every``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.llm.common import cut

K = 10
#: Ids of queries are divisible by this.
EVERY = 20
#: Vectors of a list on average, until there are LISTS lists, beyond which lists grow; sampled vectors for each list that place the centroids, so LISTS * TRAIN at most; vectors of a block at most (a larger list is split).
LIST, LISTS, TRAIN, BLOCK = 4096, 1024, 32, 8192
#: Sampled queries that set the number of probes; the recall they are to reach; bits of a query's coordinates.
TUNE, RECALL, QUERY_BITS = 256, 0.97, 6
#: Standard errors of an estimate that its bounds allow.
EPSILON = 2.5
#: Queries that are held against a block at once, and pairs whose exact product is computed at once; they bound the working memory.
QUERIES, RERANKED = 64, 1 << 15


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0].astype(np.float32)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    c = sample[np.random.default_rng(3).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        for i in range(len(c)):
            if (m := near == i).any():
                v = sample[m].mean(axis=0)
                c[i] = v / max(np.linalg.norm(v), 1e-9)
    return c


class Codes:
    """One-bit codes of unit vectors about a centroid."""

    def __init__(self, x: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
        self.dim, self.c, self.p = x.shape[1], c, p
        r = (x - c) @ p
        self.norm = np.linalg.norm(r, axis=1)
        unit = r / np.maximum(self.norm, 1e-12)[:, None]
        pad = -self.dim % 64
        self.bits = np.packbits(np.pad(r > 0, ((0, 0), (0, pad))), axis=1).view(np.uint64)
        self.own = np.abs(unit).sum(axis=1) / np.sqrt(self.dim)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.shift = x @ c
        self.error = EPSILON * np.sqrt(np.maximum(1 - self.own**2, 0) / np.maximum(self.own**2, 1e-12) / max(self.dim - 1, 1))

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and vector an estimate of the inner product and the bound of its error.

        The rotated query is rounded to ``QUERY_BITS`` bits a coordinate; its product with a code is then a sum of
        bit counts, one for each of these bit planes.
        """
        r = (q - self.c) @ self.p
        length = np.linalg.norm(r, axis=1)
        low = r.min(axis=1, keepdims=True)
        step = np.maximum((r.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
        level = np.rint((r - low) / step).astype(np.uint8)
        pad = -self.dim % 64
        total = np.zeros((len(q), len(self.norm)), np.float32)
        for bit in range(QUERY_BITS):
            plane = np.packbits(np.pad((level >> bit) & 1, ((0, 0), (0, pad))), axis=1).view(np.uint64)
            hits = np.bitwise_count(plane[:, None, 0] & self.bits[None, :, 0]).astype(np.uint16)
            for w in range(1, self.bits.shape[1]):
                hits += np.bitwise_count(plane[:, None, w] & self.bits[None, :, w])
            total += np.float32(1 << bit) * hits
        # <x, r> for x = (2 bits - 1) / sqrt(dim), with r = low + step * level
        total *= (2 * step).astype(np.float32)
        total += (2 * low).astype(np.float32) * self.ones.astype(np.float32)
        total -= (low * self.dim + step * level.sum(axis=1, keepdims=True, dtype=np.int64)).astype(np.float32)
        grown = (self.norm / np.maximum(self.own, 1e-12)).astype(np.float32)
        total *= grown / np.float32(np.sqrt(self.dim))
        total += (self.shift + (q @ self.c)[:, None] - self.c @ self.c).astype(np.float32)
        wide = length.astype(np.float32)[:, None] * (self.norm * self.error).astype(np.float32)
        wide += (step * np.sqrt(self.dim) / 4).astype(np.float32) * grown
        return total, wide


def exact_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of q and j of x, RERANKED pairs at once."""
    out = np.empty(len(i))
    for s in range(0, len(i), RERANKED):
        e = s + RERANKED
        out[s:e] = np.einsum("ij,ij->i", q[i[s:e]].astype(np.float64), x[j[s:e]].astype(np.float64))
    return out


def leaders(about: np.ndarray, first: int) -> np.ndarray:
    """Columns of ``first`` great estimates of each row, all of different groups of columns: the greatest of each of the groups that lead."""
    n = about.shape[1]
    width = max(1, n // (4 * first))
    groups = n // width
    top = about[:, : groups * width].reshape(len(about), groups, width).max(axis=2)
    lead = np.argpartition(-top, first - 1, axis=1)[:, :first]
    within = about[np.arange(len(about))[:, None, None], lead[:, :, None] * width + np.arange(width)].argmax(axis=2)
    return lead * width + within


def search(ids: np.ndarray, x: np.ndarray, codes: Codes, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query and vector that its bounds leave the exact inner product, and of these the k greatest; row, id, score, and how many were reranked.

    Vectors of great estimates are reranked first. The k-th greatest of their exact products then bounds what the
    others must be able to reach, which leaves fewer of them than a bound from estimates alone. Those left are reranked
    in single precision, and in double where rounding could decide. ids must ascend.
    """
    rows, found, scores, reranked = [], [], [], 0
    first = min(4 * k, len(ids))
    rounding = 2 * codes.dim * np.finfo(np.float32).eps  # more than two products of unit vectors in single precision are off
    for s in range(0, len(q), QUERIES):
        part = q[s : s + QUERIES]
        about, wide = codes.estimate(part)
        own = np.searchsorted(ids, qids[s : s + QUERIES]).clip(max=len(ids) - 1)
        mine = np.flatnonzero(ids[own] == qids[s : s + QUERIES])
        about[mine, own[mine]] = -np.inf
        best = leaders(about, first)
        i = np.repeat(np.arange(len(part)), first)
        sample = exact_products(part, x, i, best.ravel()).reshape(len(part), first)
        sample[np.isneginf(np.take_along_axis(about, best, axis=1))] = -np.inf
        least = np.partition(sample, first - k, axis=1)[:, first - k] if first >= k else np.full(len(part), -np.inf)
        about += wide
        chosen = about >= (least - 1e-6)[:, None].astype(np.float32)
        chosen[mine, own[mine]] = False
        for r in range(len(part)):
            j = np.flatnonzero(chosen[r])
            reranked += len(j)
            near = x[j] @ part[r]
            if len(j) > k:
                j = j[near >= np.partition(near, len(j) - k)[len(j) - k] - rounding]
            exact = exact_products(part, x, np.full(len(j), r), j)
            order = np.lexsort((ids[j], -exact))[:k]
            rows.append(np.full(len(order), s + r))
            found.append(ids[j[order]])
            scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores), reranked


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows with an id and a vector of the commonest length, without null, NaN, infinite or all zero coordinates; one row for each id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    v = v.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < 1e18) and exists(v, e -> abs(e) > 1e-18)")
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    return v.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def nearest(vectors: DataFrame, k: int = K, list_size: int = LIST, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbor_id, rank, score): for every vector whose id is divisible by ``every`` the k others of greatest cosine among all, rank 1 first.

    Ties go to the smaller neighbor_id. Rows are left out, as queries and as neighbours, if the id or the vector is
    null, or if the vector has no coordinate of more than 1e-18 (so that it counts as zero), has a null, NaN or infinite
    one or one of 1e18 or more, or hasn't the commonest length. Of rows with one id the least vector counts. vec_id must
    be a number, or text that spells one. Other columns are ignored. With fewer than k other vectors all are given; no
    rows, or none whose id is divisible, give no rows. The number of probes is set so that ``TUNE`` sampled queries, held
    against an exact scan of the whole table, reach a recall of ``RECALL``.
    """
    spark = vectors.sparkSession
    v, dim = valid(vectors)
    out = "vec_id long, neighbor_id long, rank int, score double"
    if not dim:
        return spark.createDataFrame([], out)
    v = cut(v)
    n = v.count()

    def take(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        t = v.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(m).toArrow()
        return t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)

    lists = min(LISTS, max(1, round(n / list_size)))
    c = centroids(unit_rows(take(max(lists * TRAIN, 256), 1)[1], dim), lists)
    lists, p = len(c), rotation(dim)
    probes = _probes(v, *take(TUNE, 2), c, dim, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(b.column("v").flatten().to_numpy(), dim)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.argmax(x @ c.T, axis=1).astype(np.int32)), b.column("v")], names=["vec_id", "l", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_rows(b.column("v").flatten().to_numpy(), dim)
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                for s in range(0, len(x), 512):
                    m = len(near[s : s + 512])
                    at = pa.array(np.repeat(np.arange(s, s + m), probes))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), pa.array(near[s : s + 512].ravel().astype(np.int32)), b.column("v").take(at)], names=["vec_id", "l", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        codes = None
        for b in batches:
            if b.num_rows == 0:
                continue
            key = b.column("l").to_numpy().astype(np.int64) << 32 | b.column("s").to_numpy()
            role, ids, x = b.column("role").to_numpy(), b.column("vec_id").to_numpy(), unit_rows(b.column("v").flatten().to_numpy(), dim)
            bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (role[1:] != role[:-1])]))
            for lo, hi in zip(bounds, np.append(bounds[1:], len(key))):
                if key[lo] != block:
                    block, held, codes = key[lo], [], None
                if role[lo] == 0:
                    held.append((ids[lo:hi].copy(), x[lo:hi].copy()))
                elif held:
                    if codes is None:
                        own, vec = (np.concatenate(a) for a in zip(*held))
                        codes = Codes(vec, c[block >> 32], p)
                    for s in range(lo, hi, 4096):
                        e = min(hi, s + 4096)
                        i, found, score, _ = search(own, vec, codes, ids[s:e], x[s:e], k)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[s + i]), pa.array(found), pa.array(score)], names=["vec_id", "neighbor_id", "score"])

    stored = cut(v.mapInArrow(assign, "vec_id long, l int, v array<float>"))
    # a row a list, LISTS at most, so always small enough to be broadcast
    parts = cut(stored.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    data = stored.join(F.broadcast(parts), "l").select("vec_id", "l", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("s"), F.lit(0).alias("role"), "v")
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(visit, "vec_id long, l int, v array<float>").join(F.broadcast(parts), "l").select("vec_id", "l", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.lit(1).alias("role"), "v")
    both = data.union(asked).repartition("l", "s").sortWithinPartitions("l", "s", "role", "vec_id")
    hits = both.mapInArrow(scan, "vec_id long, neighbor_id long, score double")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")))
    return best.where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


def _probes(v: DataFrame, qids: np.ndarray, q: np.ndarray, c: np.ndarray, dim: int, k: int) -> int:
    """The fewest lists that give the sampled queries the recall RECALL; all lists if there is no other vector."""
    q = unit_rows(q, dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list | None = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x, ids = unit_rows(b.column("v").flatten().to_numpy(), dim), b.column("vec_id").to_numpy()
            s = q @ x.T
            s[qids[:, None] == ids[None, :]] = -np.inf
            new = [s, np.broadcast_to(np.argmax(x @ c.T, axis=1), s.shape)]
            both = [np.concatenate(t, axis=1) for t in zip(best, new)] if best else new
            top = np.argsort(-both[0], axis=1)[:, :k]
            best = [np.take_along_axis(t, top, axis=1) for t in both]
        if best:
            i = np.repeat(np.arange(len(q)), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[0].ravel().astype(np.float64)), pa.array(best[1].ravel().astype(np.int64))], names=["q", "score", "l"])

    found = v.mapInArrow(exact, "q long, score double, l long").where("score > -2")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "l"))).where(F.col("r") <= k).select("q", "l").collect()
    if not top:
        return len(c)
    i, at = (np.array(t, np.int64) for t in zip(*top))
    order = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(min(len(c), np.quantile(order[i, at], RECALL, method="higher") + 1))
