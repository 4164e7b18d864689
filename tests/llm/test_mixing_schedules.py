"""Weights of one's own over time."""

import pytest

from gatecrest.llm import mixing


def test_schedules_set_the_share_of_each_source(spark):
    rows = [(s * 10_000 + k, "w " * 10, f"s{s}") for s in range(3) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.schedule(docs, schedules={"s0": (3.0, 0.0), "s1": (0.0, 1.0), "s2": (1.0, 1.0)}).collect()
    assert len({r.doc_id for r in got}) == len(got)
    # s0 has 3/4 of the weight at first and none at last: an area of 3/8; s1 of 1/4, s2 of 3/8; 9,000 documents are asked for
    count = {s: sum(r.source == s for r in got) for s in ("s0", "s1", "s2")}
    assert count["s0"] == 3000 and count["s2"] == 3000 and count["s1"] == pytest.approx(2250, abs=2)
    for t in (0.25, 0.5, 0.75):
        part = {s: sum(r.source == s and r.position < t for r in got) / count[s] for s in count}
        assert part["s1"] == pytest.approx(t * t, abs=0.01) and part["s0"] == pytest.approx(2 * t - t * t, abs=0.01)
        a, b = 0.25, 0.5
        assert part["s2"] == pytest.approx((a * t + (b - a) * t * t / 2) / (a + (b - a) / 2), abs=0.01)


def test_a_source_without_weight(spark):
    docs = spark.createDataFrame([(k, "w " * 5, f"s{k % 2}") for k in range(100)], "doc_id long, text string, source string")
    got = mixing.schedule(docs, schedules={"s1": (0.0, 0.0)}).collect()
    assert sum(r.source == "s1" for r in got) == 1 and sum(r.source == "s0" for r in got) == 50
    with pytest.raises(ValueError):
        mixing.schedule(docs, schedules={"s1": (-1.0, 0.0)})
