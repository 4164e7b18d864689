"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from gatecrest.llm import ann, exact_dedup, mixing, ngram_jaccard, packing, quality, secret_scan, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (2, "one two three four five six", "en", "b", 27),
    (2, "one two three four five six", "en", "b", 27),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, "", "fr", None, 0),
    (6, LONG, "de", "a", len(LONG)),
    (7, LONG + " tail", "de", "b", len(LONG) + 5),
    (None, "a text without an id, token: 'abcdefgh12345678'", None, None, None),
    (None, None, None, None, None),
    (8, "?! ...\n\n", "en", "a", 8),
    (9, "žluťoučký kůň 漢字 😀", "xx", "c", 20),
]
#: Names that the operators use inside.
CLASH = ["_h1", "_h2", "_len", "_keep", "_nth", "_row", "_gone", "_tokens", "_position", "_source", "_order", "_c", "key", "n", "u", "v", "x", "component", "node", "slot", "shard", "score", "toxic", "owner", "id", "x3", "_x3"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 1), (6, None, None), (None, 1, 1), (1, 0, 0)], LABELS)


def clashing(df):
    return df.select("*", *(F.lit("other").alias(c) for c in CLASH))


OPERATORS = {
    "ngram": lambda d, y: ngram_jaccard.near_duplicates(d),
    "keep_one": lambda d, y: ngram_jaccard.keep_one(d).select("doc_id", "text", "lang"),
    "exact": lambda d, y: exact_dedup.duplicate_map(d),
    "drop_exact": lambda d, y: exact_dedup.drop_exact_duplicates(d).select("doc_id", "text", "lang"),
    "secrets": lambda d, y: secret_scan.scan(d),
    "schedule": lambda d, y: mixing.schedule(d),
    "mixed": lambda d, y: mixing.mixed(d).select("doc_id", "text", "lang"),
    "toxicity": lambda d, y: toxicity.classify(d, y),
    "drop_toxic": lambda d, y: toxicity.drop_toxic(d, y).select("doc_id", "text", "lang"),
    "packing": lambda d, y: packing.pack(d).drop("bin_id"),
    "quality": lambda d, y: quality.classify(d, y),
    "sharding": lambda d, y: sharding.assign(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(docs, labels, name):
    plain = OPERATORS[name](docs, labels).collect()
    other = OPERATORS[name](clashing(docs), labels).collect()
    assert sorted(map(str, plain)) == sorted(map(str, other))


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_give_no_rows(spark, labels, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), labels).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "drop_toxic", "quality"])
def test_no_labels(spark, docs, name):
    assert OPERATORS[name](docs, spark.createDataFrame([], LABELS)).count() == len(ROWS)


@pytest.mark.parametrize("name", [k for k in OPERATORS if k not in ("packing", "ngram")])
def test_only_null_rows(spark, labels, name):
    nulls = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    kept = OPERATORS[name](nulls, labels).count()
    assert kept == (0 if name == "secrets" else 3)


def test_whole_tables_are_judged(docs, labels):
    for name in ("exact", "toxicity", "quality", "sharding"):
        assert OPERATORS[name](docs, labels).count() == len(ROWS), name


def test_exact_dedup_of_edge_rows(docs):
    got = sorted(map(str, ((r.doc_id, r.keep_id, r.is_duplicate) for r in exact_dedup.duplicate_map(docs).collect())))
    want = [(1, 1, False), (2, 1, True), (2, 1, True), (3, 3, False), (4, 4, False), (5, 4, True), (6, 6, False), (7, 7, False), (8, 8, False), (9, 9, False), (None, None, False), (None, None, False)]
    assert got == sorted(map(str, want))


def test_near_duplicates_of_edge_rows(docs):
    got = {(r.doc_id, r.group_id, r.group_size) for r in ngram_jaccard.near_duplicates(docs).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (6, 6, 2), (7, 6, 2)}
    assert sorted(r.doc_id or 0 for r in ngram_jaccard.keep_one(docs).collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9]


def test_texts_without_a_word_are_not_judged(docs, labels):
    for r in toxicity.classify(docs, labels).collect():
        if r.doc_id in (3, 4, 5, 8):
            assert r.score == 0 and not r.toxic
    for r in quality.classify(docs, labels).collect():
        if r.doc_id in (3, 4, 5, 8):
            assert r.score is None and r.probability is None and not r.keep


def test_packing_of_edge_rows(docs):
    rows = packing.pack(docs, capacity=1000).collect()
    tokens = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
    assert got == {k: v * (2 if k == 2 else 1) for k, v in tokens.items() if v and k is not None} | {None: 7}


def test_shards_of_edge_rows(docs):
    rows = sharding.assign(docs).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.doc_id, set()).add((r.slot, r.shard))
    assert all(len(s) == 1 for s in slots.values())


def test_sources_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "full", 5), (2, "", "en", "bare", 0), (3, None, "en", "bare", None)], SCHEMA)
    assert {(r.doc_id, r.tokens, r.position) for r in mixing.schedule(df).collect()} == {(1, 3, 0.0), (2, 0, 0.0), (3, 0, 0.0)}


def test_owner_of_unknown_source(docs):
    rows = secret_scan.scan(docs).collect()
    assert [(r.doc_id, r.kind, r.occurrences, r.n_documents, r.n_owners, r.verdict) for r in rows] == [(None, "assigned_token", 1, 1, 1, "live")]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors_of_edge_rows(spark):
    bad = [(None, [1.0, 0.0], 0), (20, None, 0), (21, [], 0), (22, [0.0, 0.0], 0), (23, [None, 1.0], 0), (24, [float("nan"), 1.0], 0), (25, [float("inf"), 1.0], 0), (26, [1.0, 2.0, 3.0], 0)]
    good = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 2), (3, [0.0, 1.0], 2), (4, [2.0, 0.0], None)]
    df = spark.createDataFrame(good + bad, VECTORS)
    for one in (df, df.select("*", *(F.lit(1).alias(c) for c in ("v", "l", "s", "role", "d", "rank", "score", "parts")))):
        rows = {(r.vec_id, r["rank"]): (r.neighbor_id, r.score) for r in ann.nearest(one, every=1).collect()}
        assert {k[0] for k in rows} == {1, 2, 3, 4} and len(rows) == 12
        assert rows[1, 1] == (2, 1.0) and rows[1, 2] == (4, 1.0) and rows[4, 1] == (1, 1.0) and rows[3, 1] == (1, 0.0)
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.nearest(spark.createDataFrame(bad, VECTORS).where("vec_id = 20"), every=1).count() == 0
    assert ann.nearest(spark.createDataFrame(good[:1], VECTORS), every=1).count() == 0


PAGES = "page_id long, url string, html string"


def test_pages_of_edge_rows(spark):
    rows = [
        (1, "https://good.org/a", '<link rel="canonical" href="http://casino.example/x">'),
        (2, "http://www.casino.example/x/", None),
        (3, None, "<p>"),
        (4, "  ", "<link rel=canonical href='http://casino.example/x'>"),
        (5, "https://good.org/a#part", ""),
        (5, "https://good.org/a#part", ""),
        (6, "https://tionble.example.org/b", "<meta http-equiv='refresh' content='0; url=http://casino.example/x'>"),
        (None, "https://plain.org/", None),
        (7, "https://far.org/z", "<script>location.href = 'https://good.org/a'</script>"),
    ]
    df = spark.createDataFrame(rows, PAGES)
    for one in (df, clashing(df).drop("u")):
        got = sorted(((r.page_id or 0, r.decision, r.reason) for r in url_filter.decide(one).collect()))
        assert got == [(0, "keep", "clean"), (1, "block", "alias"), (2, "block", "listed"), (3, "keep", "no url"), (4, "keep", "no url"), (5, "block", "alias"), (5, "block", "alias"), (6, "keep", "allowed"), (7, "block", "alias")]
    assert url_filter.decide(spark.createDataFrame([], PAGES)).count() == 0
