"""The pipeline's packing sends the underfull bins of its ranges up a tree."""

import random
from collections import defaultdict

import corpus_pipeline
from gatecrest.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string"


def bins_of(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at and r.bin_tokens == b[0].bin_tokens and r.position == b[0].position
            at += r.tokens
        assert at == b[0].bin_tokens
    return bins


def test_the_pipeline_merges_underfull_bins_of_ranges(spark):
    """Of the bins that are left no two fit together, however far their ranges lie apart."""
    sizes = [1100] * 1500 + [900] * 572
    assert sum(sizes) > 4 * packing.RANGE * packing.CAPACITY
    docs = spark.createDataFrame([(k, "w " * n, "en", "s") for k, n in enumerate(sizes)], SCHEMA).coalesce(1)
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    assert sorted((r.doc_id, r.tokens) for r in rows) == list(enumerate(sizes))
    used = sorted(b[0].bin_tokens for b in bins_of(rows).values())
    assert used[0] + used[1] > packing.CAPACITY
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_the_tree_only_merges(spark):
    """Bins of the tree are those of the ranges, whole, at the mean of their places; most documents stay where they were."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, "w " * rng.randrange(0, 300), "en", "s") for k in range(3000)], SCHEMA).coalesce(1)
    ranges, tree = (packing.pack_in_order(docs, 512, 16, tree=t).collect() for t in (False, True))
    old, new = bins_of(ranges), bins_of(tree)
    assert len(new) < len(old) and {(r.doc_id, r.piece, r.start, r.tokens) for r in tree} == {(r.doc_id, r.piece, r.start, r.tokens) for r in ranges}
    place = {(r.doc_id, r.piece): r for r in ranges}
    merged = 0
    for b in new.values():
        of = {place[r.doc_id, r.piece].bin_id for r in b}
        assert sum(len(old[i]) for i in of) == len(b)
        assert abs(sum(old[i][0].position * old[i][0].bin_tokens for i in of) / b[0].bin_tokens - b[0].position) < 1e-9
        merged += len(b) if len(of) > 1 else 0
    assert 0 < merged < 0.1 * len(tree)


def test_many_underfull_bins_of_one_size(spark):
    """More bins of a size than go up the tree: the small ones of other ranges still find them, and as many are left as a fit of all at once leaves."""
    sizes = [150] * 2000 + [40] * 3 + [150] * 2000 + [45] * 2
    docs = spark.createDataFrame([(k, "w " * n, "en", "s") for k, n in enumerate(sizes)], SCHEMA).coalesce(1)
    assert len(bins_of(packing.pack_in_order(docs, 256, 8).collect())) == 4001
    bins = bins_of(packing.pack_in_order(docs, 256, 8, tree=True).collect())
    assert len(bins) == len(packing.best_fit(sorted(sizes, reverse=True), 256)) == 4000
    none = packing.pack_in_order(docs.where("false"), tree=True)
    assert none.count() == 0 and "position" in none.columns
