"""Fingerprints that many rows share, and ids that are no numbers."""

import pytest

from gatecrest.llm import exact_dedup


@pytest.mark.parametrize("hot", [exact_dedup.HOT, 7])
def test_hot_texts(spark, hot):
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(200)] + [(None, "the same text"), (5, "the same text"), (9, None), (None, "nobody's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.duplicate_map(docs, hot).collect()
    assert len(got) == len(rows) and sum(r.is_duplicate for r in got) == sum(t == "the same text" for _, t in rows) - 1
    assert {r.keep_id for r in got if r.is_duplicate} == {1}
    assert {r.doc_id for r in got if not r.is_duplicate} == {k for k in range(200) if k % 3 == 0} | {1, None, 9}
    kept = exact_dedup.drop_exact_duplicates(docs, hot).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted([(False, k, f"text {k}") for k in range(0, 200, 3)] + [(False, 1, "the same text"), (False, 9, ""), (True, 0, "nobody's")])


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", "y", 3), ("a", "x", 0)], "doc_id string, text string, n int")
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == [("a", "x", 0), ("c", "y", 3)]
