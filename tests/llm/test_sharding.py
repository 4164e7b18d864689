"""Rebalancing of skewed slots."""

import random

import pytest

from gatecrest.llm import sharding


def loads(shard_of, size, shards):
    out = [0] * shards
    for s, k in enumerate(shard_of):
        out[k] += size[s]
    return out


@pytest.mark.parametrize("giants", [1, 3])
def test_giant_slots_leave_no_other_shard_above_the_tolerance(giants):
    rng = random.Random(1)
    first = sharding.initial_map(256, 8)
    size = [rng.randrange(1, 10) * (1 + first[s]) ** 2 for s in range(256)]  # the later the shard, the fuller
    for g in range(giants):
        size[g * 32] = 12_000
    after = sharding.rebalanced(first, size, 8)
    load, mean = loads(after, size, 8), sum(size) / 8
    # nothing is left to move: no slot of a shard above the tolerance would lower it
    low = min(load)
    for k, b in enumerate(load):
        if b > sharding.TOLERANCE * mean:
            assert all(low + size[s] >= b for s in range(256) if after[s] == k and size[s])
    assert sorted(load)[-giants:] == [12_000] * giants
    assert sharding.rebalanced(after, size, 8) == after


def test_the_shard_beside_a_giant_is_levelled():
    size = [1000] + [0] * 7 + [100] * 8 + [1] * 16  # shards of 8 slots: one giant, 800, 8 and 8
    after = sharding.rebalanced(sharding.initial_map(32, 4), size, 4)
    assert sorted(loads(after, size, 4), reverse=True)[:2] == [1000, 400]


def test_stored_maps_are_edited(spark, tmp_path):
    rng = random.Random(2)
    docs = lambda seed, n: spark.createDataFrame([(seed * 1000 + k, "x" * rng.randrange(1, 2000)) for k in range(n)], "doc_id long, text string")
    path = str(tmp_path / "map")
    one = sharding.assign(docs(1, 300), 128, 8, path).collect()
    assert {r.version for r in one} == {2} and sharding.versions(spark, path) == [1, 2]
    before = sharding.shards_of(spark, path, 2)
    two = sharding.assign(docs(2, 400), 128, 8, path).collect()  # edits version 2, not the initial map
    assert {r.version for r in two} == {3} and all(r.previous_shard == before[r.slot] for r in two)
    same = docs(3, 50).coalesce(1)
    same = spark.createDataFrame(same.collect(), same.schema)
    three = sharding.assign(same, 128, 8, path).collect()
    again = sharding.assign(same, 128, 8, path).collect()  # level already: nothing moves, nothing is stored
    assert {r.version for r in again} == {r.version for r in three} and all(r.shard == r.previous_shard for r in again)
    more = sharding.assign(same, 128, 10, path).collect()  # two new shards are filled from the others
    assert max(r.shard for r in more) >= 8
    with pytest.raises(ValueError):
        sharding.assign(same, 256, 10, path)
    with pytest.raises(ValueError):
        sharding.assign(same, 128, 4, path)
    (tmp_path / "map" / "version=99").mkdir()  # a write that didn't end
    assert 99 not in sharding.versions(spark, path)
