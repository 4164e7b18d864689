"""Sharding by fixed virtual slots.

A record's slot is a hash of its key and never changes. Which shard holds a slot is a small versioned table of one row a
slot: rebalancing edits it, moving as few slots as it can, and stores the result as the next version.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecrest.llm.common import checkpoint_dir

SLOTS, SHARDS = 4096, 64
#: Greatest bytes of a shard after rebalancing, as a multiple of the mean, as far as whole slots allow.
TOLERANCE = 1.02


def slot(key: Column, slots: int = SLOTS) -> Column:
    """From the first 32 bits of the key's md5; a null key has that of the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def initial_map(slots: int, shards: int) -> list[int]:
    return [s * shards // slots for s in range(slots)]


def rebalanced(shard_of: list[int], size: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Slots move, one at a time, from the fullest shard to the emptiest, as long as that lowers the greater of the two.

    Of a shard's slots the greatest that doesn't fill the emptiest shard beyond the mean goes, else the least; ties go to
    the lower slot. A shard that no move lowers is set aside for good, as the emptiest one only grows, and the next
    fullest follows, until no shard above the tolerance has a move. Each move lowers the sum of the squared loads, so
    that comes. The result is a function of the arguments alone.
    """
    out, load, held = list(shard_of), [0] * shards, [[] for _ in range(shards)]
    for s, k in enumerate(out):
        load[k] += size[s]
        held[k].append(s)
    mean = sum(load) / shards
    heavy, light = [(-b, k) for k, b in enumerate(load)], [(b, k) for k, b in enumerate(load)]
    heapq.heapify(heavy)
    heapq.heapify(light)
    aside: set[int] = set()
    while len(aside) < shards:
        while heavy[0][1] in aside or -heavy[0][0] != load[heavy[0][1]]:
            heapq.heappop(heavy)
        while light[0][0] != load[light[0][1]]:
            heapq.heappop(light)
        a, b = heavy[0][1], light[0][1]
        if load[a] <= tolerance * mean:
            break
        fits = [s for s in held[a] if 0 < size[s] and load[b] + size[s] <= mean] or sorted((s for s in held[a] if size[s]), key=lambda s: (size[s], s))[:1]
        s = max(fits, key=lambda s: (size[s], -s), default=None)
        if s is None or load[b] + size[s] >= load[a]:
            aside.add(a)
            continue
        out[s] = b
        held[a].remove(s)
        held[b].append(s)
        load[a] -= size[s]
        load[b] += size[s]
        for k in (a, b):
            heapq.heappush(heavy, (-load[k], k))
            heapq.heappush(light, (load[k], k))
    return out


def store(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Adds a version of the map; versions are never overwritten."""
    spark.createDataFrame([(s, k) for s, k in enumerate(shard_of)], "slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of the slots that hold a record; a null text has no bytes."""
    return docs.groupBy(slot(F.col("doc_id"), slots).alias("slot")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"), F.count("*").alias("records"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored under path, ascending; a version whose write didn't end doesn't count."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    known = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n.removeprefix("version=").isdigit()]
    return sorted(v for v in known if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS")))


def shards_of(spark: SparkSession, path: str, version: int) -> list[int]:
    """The shard of each slot in a stored version."""
    return [r.shard for r in load(spark, path, version).orderBy("slot").collect()]  # a row a slot


def assign(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """(doc_id, slot, shard, previous_shard, version) of every row, under the latest map after rebalancing it to the bytes of docs.

    Maps are stored under ``path``, by default a new folder in the shared one. Where it holds none, version 1 gives the
    shards equal ranges of slots. The latest version is edited, by as few moves as level the load, and stored as the next;
    an edit that moves nothing stores nothing, and previous_shard is then the shard. A stored map of other than ``slots``
    slots is refused, as a record's slot would change; one with more than ``shards`` shards, too, as their records would
    have no place, while more shards than before are filled from the others.

    Rows with equal ids share a slot; a null id has the slot of the empty string. Only doc_id and text are read. Where
    all texts are empty, or there are no rows, nothing moves.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    size = [0] * slots
    for row in slot_bytes(docs, slots).collect():  # at most a row a slot
        size[row["slot"]] = row["bytes"]
    known = versions(spark, path)
    if not known:
        store(spark, path, 1, initial_map(slots, shards))
        known = [1]
    version = known[-1]
    now = shards_of(spark, path, version)
    if len(now) != slots or max(now) >= shards:
        raise ValueError(f"version {version} has {len(now)} slots on {max(now) + 1} shards, not {slots} on {shards}")
    new = rebalanced(now, size, shards)
    if new != now:
        version += 1
        store(spark, path, version, new)
    maps = load(spark, path, version).join(load(spark, path, known[-1]).withColumnRenamed("shard", "previous_shard"), "slot")
    rows = docs.select("doc_id", slot(F.col("doc_id"), slots).alias("slot"))
    return rows.join(F.broadcast(maps), "slot").select("doc_id", "slot", "shard", "previous_shard", F.lit(version).alias("version"))  # maps: a row a slot
