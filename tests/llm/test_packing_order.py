"""The curriculum's order outlives packing."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from gatecrest.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("written", [True, False])
def test_bins_follow_the_positions_of_mixing(spark, tmp_path, written):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, "w " * rng.randrange(0, 300), "en", "big" if k % 10 else "small") for k in range(3000)], SCHEMA).repartition(5)
    due = {r.doc_id: (r.position, r.tokens) for r in mixing.schedule(docs).collect()}
    mixed = mixing.mixed(docs)
    if written:
        mixed.write.parquet(f"{tmp_path}/mixed")
        mixed = spark.read.parquet(f"{tmp_path}/mixed")
    rows = packing.pack_in_order(mixed, capacity=512, range_=16).collect()
    ranges, got = defaultdict(list), defaultdict(int)
    for r in rows:
        ranges[int(r.bin_id.split("-")[0])].append((due[r.doc_id][0], r.position))
        got[r.doc_id] += r.tokens
    assert dict(got) == {i: n for i, (_, n) in due.items() if n}
    assert len(ranges) > 20
    for a, b in zip(sorted(ranges), sorted(ranges)[1:]):
        assert max(ranges[a])[0] <= min(ranges[b])[0] and max(p for _, p in ranges[a]) < min(p for _, p in ranges[b])
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    bins = {r.bin_id: r.bin_tokens for r in rows}
    assert sum(bins.values()) / (512 * len(bins)) > 0.93


def test_the_pipeline_packs_in_order(spark):
    docs = spark.createDataFrame([(k, "w " * 30, "en", "s") for k in range(2000)], SCHEMA).coalesce(1)
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert rows[0].doc_id == 0 and [r.position for r in rows] == sorted(r.position for r in rows)


def test_bins_that_could_be_merged_are(spark):
    """Many partitions of one small document each: the tree fills bins up, and no two of the bins it leaves fit together on one node."""
    sizes = [60 + k % 37 for k in range(600)]
    docs = spark.createDataFrame([(k, "w " * n) for k, n in enumerate(sizes)], "doc_id long, text string").repartition(60)
    bins = {}
    for r in packing.pack(docs, capacity=256, node=1000).collect():
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.tokens, r.doc_id, r.bin_tokens))
    used = sorted(sum(t for _, t, *_ in b) for b in bins.values())
    assert sum(used) == sum(sizes) and sorted(x[2] for b in bins.values() for x in b) == list(range(600))
    assert used[0] + used[1] > 256 and len(bins) <= 1.12 * sum(sizes) / 256
    for b in bins.values():
        at = 0
        for offset, t, _, total in sorted(b):
            assert offset == at
            at += t
        assert at == total
