"""Quality by kernel ridge regression on document statistics, with random Fourier features and isotonic calibration.

The features approximate a Gaussian kernel; each partition adds up its part of the normal equations over all labelled
documents, so the fit is one small sum whatever their number. Scores become probabilities by isotonic regression on
labelled documents that were kept out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecrest.llm.common import cut, list_array, slices, small_batches, string_buffers
from gatecrest.llm.tokens import SLICE, Tokenizer

#: Random features; squared width of the kernel over standardised statistics; ridge; every CALIBRATE-th labelled document is kept for calibration, ISOTONIC of them at most.
FEATURES, WIDTH, RIDGE, CALIBRATE, ISOTONIC = 192, 8.0, 1e-3, 5, 50_000
KEEP = 0.5
STATISTICS = 15


def statistics(texts: pa.Array) -> np.ndarray:
    """Of each text: log words, bytes a word, distinct words, commonest word; upper case, digits, blanks, lines, full stops, commas, exclamation marks, bars, symbols; words that repeat the one before; lines that occur before."""
    tokenizer, out = Tokenizer(), []
    classes = [np.zeros(256, np.int64) for _ in range(9)]
    for c, s in zip(classes, (bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]=+\\")):
        c[[*s]] = 1
    everything = string_buffers(texts)
    for lo, hi in slices(everything[0], SLICE):
        w = tokenizer(texts.slice(lo, hi - lo))
        off = everything[0][lo : hi + 1]
        data, off = everything[1][off[0] : off[-1]], off - off[0]
        size, words = np.maximum(np.diff(off), 1), np.diff(w.offsets)
        x = np.zeros((hi - lo, STATISTICS))
        for k, c in enumerate(classes):
            sums = np.concatenate([[0], np.cumsum(c[data])])
            x[:, 4 + k] = (sums[off[1:]] - sums[off[:-1]]) / size
        x[:, 0] = np.log1p(words)
        letters = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        x[:, 1] = (letters[w.offsets[1:]] - letters[w.offsets[:-1]]) / np.maximum(words, 1)
        breaks = np.flatnonzero(data == 10)
        for i in range(hi - lo):
            h = w.hashes[w.offsets[i] : w.offsets[i + 1]]
            if len(h):
                _, n = np.unique(h, return_counts=True)
                x[i, 2], x[i, 3], x[i, 13] = len(n) / len(h), n.max() / len(h), (h[1:] == h[:-1]).mean() if len(h) > 1 else 0
            b = breaks[np.searchsorted(breaks, off[i]) : np.searchsorted(breaks, off[i + 1])]
            if len(b):
                text = data[off[i] : off[i + 1]].tobytes().split(b"\n")
                x[i, 14] = 1 - len(set(text)) / len(text)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, STATISTICS))


def statistics_column(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = statistics(texts)
            yield list_array(x.ravel(), np.arange(len(x) + 1) * STATISTICS, pa.float64())

    return F.arrow_udf(run, "array<double>")(text)


class Map:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(width)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def normal_equations(rows: DataFrame, to: Map) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z' and z y over rows (x, y), by partition, then by a second level, then here."""
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + 2))
        for b in batches:
            if b.num_rows:
                z, y = to(b.column("x").flatten().to_numpy().reshape(-1, STATISTICS)), b.column("y").to_numpy()
                a[:, :d] += z.T @ z
                a[:, d] += z.T @ y
                a[0, d + 1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(d * (d + 2))
        for b in batches:
            for v in b.column("a"):
                a += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    sums = rows.mapInArrow(part, "a binary").repartition(8).mapInArrow(add, "a binary").collect()
    a = sum((np.frombuffer(r["a"]) for r in sums), np.zeros(d * (d + 2))).reshape(d, d + 2)
    return a[:, :d], a[:, d], int(a[0, d + 1])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the least score of each pool, and the pool's mean label. Equal scores are one point."""
    order = np.argsort(scores, kind="stable")
    s, first = np.unique(scores[order], return_index=True)
    w = np.diff(np.append(first, len(scores))).astype(float)
    y = np.add.reduceat(labels[order].astype(float), first) / w
    pools: list[list[float]] = []
    for a, m, n in zip(s, y, w):
        pools.append([a, m, n])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            _, m2, n2 = pools.pop()
            a1, m1, n1 = pools[-1]
            pools[-1] = [a1, (m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, probability, keep) of every row of docs.

    probability is that of label 1; keep is whether it reaches ``keep``. A null text, or one without a word, has null
    score and probability and isn't kept. Of several labels for a document the least counts; null labels don't. Without
    labels of both classes nothing can be learnt: score and probability are null and every text with a word is kept.
    Rows with equal text are judged alike. Other columns are ignored. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x = cut(docs.select("doc_id", statistics_column(F.coalesce("text", F.lit(""))).alias("x")))
    usable = x.where("x[0] > 0")
    moments = usable.select(*(F.struct(F.avg(F.col("x")[k]), F.stddev_pop(F.col("x")[k])) for k in range(STATISTICS))).first()
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    both = cut(usable.join(y, "doc_id").select("doc_id", "x", "y"))
    classes = {r["y"] > 0 for r in both.select("y").distinct().collect()}
    if len(classes) < 2:
        return x.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), (F.col("x")[0] > 0).alias("keep"))
    to = Map(np.array([m[0] for m in moments]), np.array([m[1] for m in moments]))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)) == 0
    a, b, n = normal_equations(both.where(~held), to)
    if n == 0:
        a, b, n = normal_equations(both, to)
    weights = np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            v = to(r.column("x").flatten().to_numpy().reshape(-1, STATISTICS)) @ weights if r.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(v), r.column("y")], names=["s", "y"])

    kept_out = both.where(held).orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(ISOTONIC)
    pairs = kept_out.mapInArrow(raw, "s double, y double").toPandas()
    if pairs.y.nunique() < 2:
        pairs = both.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(ISOTONIC).mapInArrow(raw, "s double, y double").toPandas()
    edges, values = isotonic(pairs.s.to_numpy(), (pairs.y.to_numpy() > 0).astype(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            m = r.column("x").flatten().to_numpy().reshape(-1, STATISTICS)
            s = to(m) @ weights
            p = values[np.maximum(np.searchsorted(edges, s, side="right") - 1, 0)]
            none = m[:, 0] <= 0
            yield pa.RecordBatch.from_arrays([r.column("doc_id"), pa.array(s, mask=none), pa.array(p, mask=none), pa.array((p >= keep) & ~none)], names=["doc_id", "score", "probability", "keep"])

    return x.mapInArrow(judge, "doc_id long, score double, probability double, keep boolean")
