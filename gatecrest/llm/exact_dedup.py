"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string is its polynomial modulo two primes below 2^31, with its length. That of a
concatenation is ``H(xy) = H(x) * B^len(y) + H(y)``, so chunks are hashed apart, each shifted by the length that follows
it, and added. Texts of more than ``HUGE`` bytes become chunk rows, hashed in parallel and combined by a sum; others are
hashed by blocks within their batch. Rows with equal fingerprints are then compared chunk by chunk in one stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecrest.llm.common import broadcast_if_small, cut, give_back, slices, small_batches, string_buffers

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525111)
#: Bytes hashed in one dot product; bytes of a chunk row; bytes from which a text is hashed by chunk rows; bytes compared at once.
BLOCK, CHUNK, HUGE, COMPARED = 4096, 1 << 20, 8 << 20, 1 << 16
#: Rows of one fingerprint that a task compares.
HOT = 100_000
#: Bytes of texts that are hashed at once; bounds the working memory.
HASHED = 1 << 18
FP = ["_h1", "_h2", "_len"]


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime, elementwise."""
    out, b, e = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    p = np.uint64(prime)
    while e.any():
        out = np.where(e & np.uint64(1), out * b % p, out)
        b, e = b * b % p, e >> np.uint64(1)
    return out


_LOW: dict[tuple[int, int], np.ndarray] = {}


def low_powers(base: int, prime: int) -> np.ndarray:
    if (base, prime) not in _LOW:
        low = np.ones(BLOCK, np.uint64)
        for k in range(1, BLOCK):
            low[k] = low[k - 1] * np.uint64(base) % np.uint64(prime)
        _LOW[base, prime] = low
    return _LOW[base, prime]


def polynomial(data: np.ndarray, offsets: np.ndarray, base: int, prime: int) -> np.ndarray:
    """The polynomial hash of each of the byte strings that offsets bound."""
    p = np.uint64(prime)
    low = low_powers(base, prime)
    length = np.diff(offsets)
    blocks = np.maximum(-(-length // BLOCK), 0)
    doc = np.repeat(np.arange(len(length)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)])
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first[:-1][doc]) * BLOCK
    end = np.minimum(start + BLOCK, offsets[1:][doc])
    out = np.zeros(len(length), np.uint64)
    if len(doc) == 0:
        return out
    after = np.repeat(end, end - start) - 1 - np.arange(offsets[0], offsets[-1])
    sums = np.add.reduceat((data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * low[after], start - offsets[0]) % p
    np.add.at(out, doc, sums * power(base, offsets[1:][doc] - end, prime) % p)
    return out % p


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """The hash of a concatenation from its parts' hashes."""
    return (left * pow(base, right_length, prime) + right) % prime


def _hash(column: str) -> Column:
    """Struct of h1 and h2 of a text or binary column; only that column goes to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            offsets, data = string_buffers(col)
            h = [np.zeros(len(col), np.int64) for _ in PRIMES]
            for lo, hi in slices(offsets, HASHED):
                for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
                    h[k][lo:hi] = polynomial(data, offsets[lo : hi + 1], base, prime).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(x) for x in h], names=["h1", "h2"])
        give_back()

    return F.arrow_udf(run, "struct<h1:bigint,h2:bigint>")(F.col(column))


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_h", _hash(column)).withColumn("_h1", F.col("_h.h1")).withColumn("_h2", F.col("_h.h2")).drop("_h")


def fingerprints(docs: DataFrame, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """docs with _h1, _h2 and _len (bytes) of text; the text is not null."""
    small_batches(docs.sparkSession)
    size = F.octet_length("text").cast("long")
    small = _hashed(docs.withColumn("_len", size).where(F.col("_len") <= huge), "text")
    large = docs.withColumn("_len", size).where(F.col("_len") > huge)
    if large.isEmpty():
        return small
    large = cut(large.withColumn("_row", F.monotonically_increasing_id()))
    chunks = large.select("_row", "_len", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("_len") - 1) / chunk).cast("int")), lambda k: F.substring(F.col("text").cast("binary"), k * chunk + 1, F.lit(chunk)))).alias("_k", "_chunk"))
    chunks = _hashed(chunks.repartition("_row", "_k"), "_chunk")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = b.column("_k").to_numpy(), b.column("_len").to_numpy()
            tail = np.maximum(n - (k.astype(np.int64) + 1) * chunk, 0)
            h = [(b.column(f"_h{i + 1}").to_numpy().astype(np.uint64) * power(BASES[i], tail, PRIMES[i]) % np.uint64(PRIMES[i])).view(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *map(pa.array, h)], names=["_row", "_h1", "_h2"])

    whole = chunks.drop("_chunk").mapInArrow(shift, "_row long, _h1 long, _h2 long").groupBy("_row").agg((F.sum("_h1") % PRIMES[0]).alias("_h1"), (F.sum("_h2") % PRIMES[1]).alias("_h2"))
    return small.unionByName(large.join(whole, "_row").drop("_row").select(small.columns))


def same_bytes(a: memoryview, b: memoryview) -> bool:
    """Chunkwise; ends at the first chunk that differs."""
    return len(a) == len(b) and all(a[k : k + COMPARED] == b[k : k + COMPARED] for k in range(0, len(a), COMPARED))


def compared(rows: DataFrame, key: list[str] = FP) -> DataFrame:
    """Appends _keep, the doc_id of the first row with the same text, _nth, 0 for that row, 1 for others, and _class, which of the key's texts it is. rows come sorted by key, then in the order of preference."""
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, firsts = None, []  # distinct texts of the current key; one, but for collisions
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in key)))
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            keep, nth, cls = [], [], []
            for k, f in enumerate(keys):
                if f != current:
                    current, firsts = f, []
                view = memoryview(texts[k].as_buffer() or b"").cast("B")
                hit = next((c for c, (_, t) in enumerate(firsts) if same_bytes(t, view)), None)
                nth.append(int(hit is not None))
                if hit is None:
                    hit = len(firsts)
                    firsts.append((ids[k], memoryview(bytes(view))))
                keep.append(firsts[hit][0])
                cls.append(hit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keep, b.schema.field("doc_id").type), pa.array(nth, pa.int32()), pa.array(cls, pa.int32())], names=[*b.schema.names, "_keep", "_nth", "_class"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_keep", kind), T.StructField("_nth", T.IntegerType()), T.StructField("_class", T.IntegerType())]))


def split(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint is theirs alone, and the others after comparison. Texts are not null.

    All texts are fingerprinted once. Only documents that have a fingerprint which occurs more than once are read again,
    fingerprinted again and shuffled; where they are few their ids are broadcast. A fingerprint of more than ``hot`` rows
    is shared out to as many tasks as it has times that many rows; the first rows of these meet in a second comparison.
    """
    narrow = cut(fingerprints(docs).select("doc_id", *FP))
    repeated = cut(narrow.groupBy(*FP).agg(F.count("*").alias("_c")).where("_c > 1"))
    few = repeated.count()
    ids = cut(narrow.join(broadcast_if_small(repeated, few, 64), FP, "left_semi").where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct())
    ids = broadcast_if_small(ids, ids.count(), 40)
    again = fingerprints(docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi").union(docs.where("doc_id is null")))
    alone = docs.where("doc_id is not null").join(ids, docs["doc_id"] == ids["_id"], "left_anti")
    order: list[Column] = [F.col("doc_id").asc_nulls_last(), *(F.col(f"`{f.name}`").asc_nulls_last() for f in docs.schema.fields if f.name not in ("doc_id", "text") and isinstance(f.dataType, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.BooleanType)))]
    whole = lambda rows, key: compared(rows.repartition(*key).sortWithinPartitions(*key, *order), key)
    large = repeated.where(F.col("_c") > hot).select(*FP, F.ceil(F.col("_c") / hot).cast("int").alias("_shares"))
    if large.isEmpty():
        return alone, whole(again, FP).drop("_class")
    large = broadcast_if_small(large, large.count(), 64)
    rest = whole(again.join(large.drop("_shares"), FP, "left_anti"), FP).drop("_class")
    shared = again.join(large, FP).withColumn("_share", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("_shares")).cast("int")).drop("_shares")
    one = whole(shared, [*FP, "_share"])
    firsts = whole(one.where("_nth = 0").withColumnRenamed("_class", "_of").drop("_keep", "_nth"), FP).select(*FP, "_share", F.col("_of").alias("_class"), F.col("_keep").alias("_first"), F.col("_nth").alias("_later"))
    firsts = cut(firsts)
    both = one.join(broadcast_if_small(firsts, firsts.count(), 64), [*FP, "_share", "_class"])
    return alone, rest.unionByName(both.withColumn("_keep", F.col("_first")).withColumn("_nth", F.greatest("_nth", "_later")).select(rest.columns))


def duplicate_map(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, is_duplicate) of every row: keep_id is the least doc_id with the same bytes of text.

    A null text equals no other. Empty texts equal one another. Null ids come last, so keep_id is null only where the
    group has no id. Repeated rows give a row each, of which the first is no duplicate. doc_id must be a number, or text
    that spells one. Only doc_id and text are read. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    alone, again = split(docs.where("text is not null"), hot)
    first = lambda df: df.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(False).alias("is_duplicate"))
    return first(alone).union(first(docs.where("text is null"))).union(again.select("doc_id", "_keep", F.col("_nth") > 0))


def drop_exact_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of docs without copies: of rows with the same text that of the least doc_id stays, of equal ids the one whose other columns sort first. Rows with a null text stay. All columns are kept. doc_id may be of any type that has an order."""
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"_x{k}" for k, c in enumerate(names)))  # so that no name clashes
    alone, again = split(docs.where("text is not null"), hot)
    return alone.select(docs.columns).union(again.where("_nth = 0").select(docs.columns)).union(docs.where("text is null")).toDF(*names)
