"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

It is trained in numpy on a bounded sample of labelled documents. The others that are labelled set the thresholds: they
are scored where they are, and their scores counted by language. All documents are scored, over their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.llm.common import broadcast_if_small, cut, give_back, slices, small_batches, string_buffers
from gatecrest.llm.tokens import SLICE, Tokenizer

#: Labelled documents of each class to train on at most, and bytes of their texts together.
TRAIN_EACH, TRAIN_BYTES = 3000, 64 << 20
#: Of ten labelled documents so many may be trained on; the others set the thresholds.
SHARE = 7
#: Equal parts of the scores' range in which they are counted for that.
BINS = 2000
#: Bytes of a word's beginnings that have embeddings of their own, for words that no labelled document has.
PREFIXES = (4, 5, 6, 7)
BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS = 1 << 17, 8, 8, (1, 2, 3), 6
#: Toxic and clean documents that a language needs among those for a threshold of its own.
LEAST = 12
#: How much more a clean document that is rejected costs than a toxic one that passes, in choosing thresholds.
COST = 2.0


def features(words) -> np.ndarray:  # noqa: ANN001
    """Buckets of each word: two of its hash, so that a clash in one is no clash in both, and those of its beginnings."""
    m = np.uint64(BUCKETS - 1)
    h = words.hashes
    return np.stack([h & m, (h >> np.uint64(32)) & m, *(words.prefixes(n) & m for n in PREFIXES)], 1).astype(np.int32)


def feature_lists(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and text offsets of slices of the texts, in order."""
    tokenizer = Tokenizer()
    for lo, hi in slices(string_buffers(texts)[0], SLICE):
        w = tokenizer(texts.slice(lo, hi - lo))
        yield features(w), w.offsets


@dataclass
class Net:
    """tables: one for each kind of bucket; filters: (offset, DIM, FILTERS) for each width."""

    tables: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5

    def embed(self, x: np.ndarray) -> np.ndarray:
        return sum(self.tables[k][x[:, k]] for k in range(x.shape[1]))

    def maps(self, e: np.ndarray) -> list[np.ndarray]:
        """Filter outputs at each first word; words beyond the end of the array count as zero."""
        out = []
        for f in self.filters:
            z = e @ f[0]
            for k in range(1, len(f)):
                z[:-k] += e[k:] @ f[k]
            out.append(z)
        return out

    def pooled(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max pooled outputs of each text, the words that gave them, and the embeddings; a filter reaches past no end of a text by more than zeros."""
        e = self.embed(x)
        n, width = len(offsets) - 1, max(WIDTHS) - 1
        count = np.diff(offsets)
        at = np.arange(len(x)) + np.repeat(np.arange(n), count) * width  # zeros between texts
        padded = np.zeros((len(x) + n * width, DIM), np.float32)
        padded[at] = e
        top, where = np.zeros((n, len(self.out)), np.float32), np.zeros((n, len(self.out)), np.int64)
        for i, z in enumerate(self.maps(padded)):
            s = slice(i * FILTERS, (i + 1) * FILTERS)
            for d in range(n):
                lo, hi = offsets[d] + d * width, offsets[d + 1] + d * width
                if hi > lo:
                    where[d, s] = lo + z[lo:hi].argmax(0)
                    top[d, s] = z[where[d, s], np.arange(FILTERS)]
        top += self.bias
        return np.maximum(top, 0), where, padded

    def scores(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.pooled(x, offsets)[0] @ self.out + self.out_bias
        p = 1 / (1 + np.exp(-z.astype(np.float64)))
        return np.where(np.diff(offsets) > 0, p, 0.0)


def encoded(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words; the words of all texts as rows of them, 4 bytes each; the first word of each text."""
    tokenizer = Tokenizer()
    hashes, kinds, words, offsets = [], [], [], [np.zeros(1, np.int64)]
    seen = count = 0
    for col in texts:
        for lo, hi in slices(string_buffers(col)[0], SLICE):
            w = tokenizer(col.slice(lo, hi - lo))
            one, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            hashes.append(one)
            kinds.append(features(w)[at])
            words.append((back + seen).astype(np.int32))
            offsets.append(w.offsets[1:] + count)
            seen, count = seen + len(one), count + len(back)
    if not hashes:
        return np.zeros((0, 2 + len(PREFIXES)), np.int32), np.zeros(0, np.int32), offsets[0]
    _, at, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return np.concatenate(kinds)[at], back.astype(np.int32)[np.concatenate(words)], np.concatenate(offsets)


def train(docs: list[np.ndarray], vocabulary: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Net:
    """Adagrad on the log loss. The first coordinate of an embedding starts as the log odds of its bucket in toxic documents.

    docs hold rows of vocabulary, the features of the distinct words.
    """
    rng = np.random.default_rng(seed)
    kinds = vocabulary.shape[1]
    tables = (rng.normal(size=(kinds, BUCKETS, DIM)) * 0.02).astype(np.float32)
    tables[:, :, 0] = 0
    for k in range(kinds):
        seen = [np.ones(BUCKETS) * 0.5, np.ones(BUCKETS) * 0.5]
        for d, y in zip(docs, labels):
            seen[int(y)][vocabulary[d, k]] += 1
        balance = np.log((labels == 0).sum() + 1) - np.log((labels == 1).sum() + 1)
        tables[k, :, 0] = (np.log(seen[1]) - np.log(seen[0]) + np.where(seen[0] + seen[1] > 1, balance, 0)) / (2 * kinds)
    total = FILTERS * len(WIDTHS)
    filters = [(rng.normal(size=(w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0])
    net = Net(tables, filters, np.full(total, -0.3, np.float32), np.full(total, 0.5, np.float32), -1.0)
    params = [net.bias, net.out, *net.filters]
    square = [np.full(p.shape, 1e-3, np.float32) for p in params]
    table_square = np.full((kinds, BUCKETS), 1e-2, np.float32)
    bias_square, rate = 1e-3, 0.05
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), 16):
            part = [docs[i] for i in order[s : s + 16]]
            y = labels[order[s : s + 16]].astype(np.float32)
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in part])])
            x = vocabulary[np.concatenate(part)]
            top, where, padded = net.pooled(x, offsets)
            p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias)))
            g = ((p - y) / len(part)).astype(np.float32)
            d_top = g[:, None] * net.out * (top > 0)
            grads = [d_top.sum(0), g @ top]
            word = np.full(len(padded), -1)
            word[np.arange(len(x)) + np.repeat(np.arange(len(part)), np.diff(offsets)) * (max(WIDTHS) - 1)] = np.arange(len(x))
            touched, amount = [], []
            for i, f in enumerate(net.filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                w, dt, df = where[:, cols], d_top[:, cols], np.zeros_like(f)
                for k in range(len(f)):
                    at = np.minimum(w + k, len(padded) - 1)
                    df[k] = np.einsum("nfd,nf->df", padded[at], dt)
                    touched.append(at.ravel())
                    amount.append((dt[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                grads.append(df)
            at, amount = np.concatenate(touched), np.concatenate(amount)
            live = (word[at] >= 0) & (amount != 0).any(1)
            at, amount = word[at[live]], amount[live]
            for q, gr, sq in zip(params, grads, square):
                sq += gr * gr
                q -= rate * gr / np.sqrt(sq)
            bias_square += float(g.sum()) ** 2
            net.out_bias -= rate * float(g.sum()) / bias_square**0.5
            for k in range(kinds):
                rows, inverse = np.unique(x[at, k], return_inverse=True)
                gr = np.zeros((len(rows), DIM), np.float32)
                np.add.at(gr, inverse, amount)
                table_square[k, rows] += (gr * gr).mean(1)
                net.tables[k, rows] -= rate * gr / np.sqrt(table_square[k, rows])[:, None]
    return net


def best_threshold(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The border between bins of scores, given how many toxic and clean documents each has, that makes the weighted mistakes fewest; of several the middle of the longest row of neighbouring ones."""
    missed = np.concatenate([[0], np.cumsum(toxic)])
    wrong = np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    cost = missed + COST * wrong
    least = np.flatnonzero(cost == cost.min())
    rows = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    best = max(rows, key=len)
    return float((best[0] + best[-1]) / 2 / len(toxic))


def sampled(docs: DataFrame, y: DataFrame, train_each: int, train_bytes: int) -> DataFrame:
    """(id, toxic) of the documents to train on: by a hash of the id the first of each class, and of these the first whose texts fit in train_bytes."""
    picks = [y.where((F.col("part") == 0) & (F.col("toxic") > 0) if c else (F.col("part") == 0) & (F.col("toxic") <= 0)).orderBy("o", "doc_id").limit(train_each) for c in (0, 1)]
    sample = cut(picks[0].union(picks[1]).select(F.col("doc_id").alias("id"), "toxic", "o"))
    sizes = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("id", "toxic", "o").agg(F.sum(F.octet_length("text")).alias("bytes"))  # 2 * train_each rows at most
    before = F.sum("bytes").over(Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1))
    return cut(sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("bytes") <= train_bytes).select("id", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, train_each: int = TRAIN_EACH, train_bytes: int = TRAIN_BYTES) -> Net | None:
    """The net, with thresholds, from documents that labels cover; None if one of the classes has none.

    What is trained on goes by a hash of doc_id, and is all that comes to the driver of the texts: 2 * train_each documents
    and train_bytes at most. Thresholds are set by all other labelled documents, or where there are none by those trained
    on. Of several labels for a document the greatest counts; null labels don't.
    """
    small_batches(labels.sparkSession)
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    y = cut(y.withColumn("o", F.xxhash64("doc_id", F.lit(5))).withColumn("part", F.when(F.pmod("o", F.lit(10)) < SHARE, 0).otherwise(1)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("text is not null")
    sample = sampled(docs, y, train_each, train_bytes)
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "text").toArrow()
    ids, toxic = (rows.column(c).to_numpy() for c in ("doc_id", "toxic"))
    vocabulary, flat, off = encoded(rows.column("text").chunks)
    del rows
    use = [i for i in np.argsort(ids, kind="stable") if off[i + 1] > off[i]]
    if len({int(toxic[i] > 0) for i in use}) < 2:
        return None
    net = train([flat[off[i] : off[i + 1]] for i in use], vocabulary, np.array([toxic[i] > 0 for i in use], np.int64))
    known = y.select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).alias("y"), "part")
    calibrate(net, docs, known.where("part = 1")) or calibrate(net, docs, known)
    return net


def calibrate(net: Net, docs: DataFrame, known: DataFrame) -> bool:
    """Sets the thresholds of the net by the scores of the documents in known (id, y); False if there are none."""
    held = docs.join(broadcast_if_small(known.select("id", "y"), known.count(), 24), F.col("doc_id") == F.col("id"))
    scored = held.select(F.coalesce("lang", F.lit("")).alias("lang"), "y", score_column(net, F.col("text")).alias("score"))
    # texts without a word, of score 0, go last: a filter by the score would be moved before the join and score all documents
    at = F.when(F.col("score") > 0, F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")).alias("bin")
    counts = cut(scored.groupBy("lang", "y", at).agg(F.count("*").alias("n")))
    counts = counts.where("bin is not null")
    total = np.zeros((2, BINS))
    for r in counts.groupBy("y", "bin").agg(F.sum("n").alias("n")).collect():  # 2 * BINS rows at most
        total[int(r.y), r.bin] = r.n
    if not total.any():
        return False
    net.default = best_threshold(total[1], total[0])
    enough = counts.groupBy("lang").agg(F.sum(F.when(F.col("y"), F.col("n"))).alias("t"), F.sum(F.when(~F.col("y"), F.col("n"))).alias("c")).where((F.col("t") >= LEAST) & (F.col("c") >= LEAST)).select("lang")
    own: dict[str, np.ndarray] = {}
    for r in counts.join(enough, "lang").collect():  # 2 * BINS rows at most for a language that has enough
        own.setdefault(r.lang, np.zeros((2, BINS)))[int(r.y), r.bin] = r.n
    net.thresholds = {lang: best_threshold(n[1], n[0]) for lang, n in own.items()}
    return True


def score_column(net: Net, text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [net.scores(f, off) for f, off in feature_lists(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        give_back()

    return F.arrow_udf(run, "double")(text)


def threshold_column(net: Net, lang: Column) -> Column:
    out = F.lit(net.default)
    for name, t in sorted(net.thresholds.items()):
        out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, score, toxic) of every row of docs.

    toxic is whether the score exceeds its language's threshold; a null language, or one with too few labels, has that of
    all languages together. Null texts and texts without a word have score 0 and aren't toxic. Where the labels don't
    cover both classes nothing can be learnt: all scores are 0 and nothing is toxic. Rows with equal text and language
    are judged alike. Other columns are ignored. No rows give no rows.
    """
    net = fit(docs, labels)
    docs = docs.select("doc_id", "lang", "text")
    score = score_column(net, F.coalesce("text", F.lit(""))) if net else F.lit(0.0)
    out = docs.select("doc_id", "lang", score.alias("score"))
    toxic = (F.col("score") > threshold_column(net, F.coalesce("lang", F.lit("")))) if net else F.lit(False)
    return out.select("doc_id", "lang", F.round("score", 6).alias("score"), (toxic & (F.col("score") > 0)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() doesn't call toxic, with all their columns."""
    net = fit(docs, labels)
    if net is None:
        return docs
    score = score_column(net, F.coalesce(docs["text"], F.lit("")))
    return docs.where(~((score > threshold_column(net, F.coalesce(docs["lang"], F.lit("")))) & (score > 0)))
