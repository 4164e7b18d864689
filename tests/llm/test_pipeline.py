"""Every stage of the pipeline against a brute-force version of it, on what the stage before kept."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from gatecrest.llm import mixing, ngram_jaccard, packing, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table before each stage, and the result."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "mixing sources to target weights", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    first = by_id(stages[0])
    for df in stages[:-1]:
        assert df.columns == COLUMNS
        assert all(first[i] == r for i, r in by_id(df).items())


def test_toxic_documents_go_and_only_they(spark, stages):
    judged = toxicity.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(by_id(stages[1])) == {r.doc_id for r in judged if not r.toxic}


def test_exact_copies_go(stages):
    first = {}
    for i, r in sorted(by_id(stages[1]).items()):
        first.setdefault(r.text, i)
    assert set(by_id(stages[2])) == set(first.values())


def test_one_of_each_group_stays(stages):
    sets = {}
    for i, r in by_id(stages[2]).items():
        w = re.findall(r"\w+", (r.text or "").lower())
        if w:
            sets[i] = {tuple(w[k : k + ngram_jaccard.N]) for k in range(len(w) - ngram_jaccard.N + 1)} or {tuple(w)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= ngram_jaccard.THRESHOLD * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    gone = {i for i in sets if find(i) != i}
    dropped = set(by_id(stages[2])) - set(by_id(stages[3]))
    assert gone and dropped <= gone and len(dropped) >= 0.95 * len(gone)


def test_mixing_by_hand(stages):
    docs = by_id(stages[3])
    n = {i: len([x for x in re.split("[ \\t\\n\\r\\f]+", r.text or "") if x]) for i, r in docs.items()}
    order = sorted(docs, key=lambda i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest())
    supply = defaultdict(int)
    for i, r in docs.items():
        supply[r.source] += n[i]
    total = sum(supply.values())
    a, b = ({s: (v / total) ** e for s, v in supply.items()} for e in (mixing.START, mixing.END))
    a, b = ({s: v / sum(w.values()) for s, v in w.items()} for w in (a, b))
    at, before = {}, defaultdict(int)
    for i in order:
        s = docs[i].source
        c, mean = before[s], (a[s] + b[s]) / 2
        span = min(total, supply[s] / mean) if mean else total
        before[s] += n[i]
        if c == 0 or c < span * mean or n[i] == 0 and c <= span * mean:
            y = c / span if span else 0
            at[i] = 0.0 if c == 0 else min(1.0, 2 * y / (a[s] + max(0.0, a[s] ** 2 + 2 * (b[s] - a[s]) * y) ** 0.5))
    assert set(by_id(stages[4])) == set(at)
    got = {r.doc_id: r.position for r in mixing.schedule(stages[3]).collect()}
    assert got == pytest.approx({i: round(p, 6) for i, p in at.items()}, abs=2e-6)


def test_packing_holds_every_token_once(stages):
    n = {i: len([x for x in re.split("[ \\t\\n\\r\\f]+", r.text or "") if x]) for i, r in by_id(stages[4]).items()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id] += range(r.start, r.start + r.tokens)
        bins[r.bin_id] += range(r.bin_offset, r.bin_offset + r.tokens)
    assert {i: sorted(v) for i, v in got.items()} == {i: list(range(k)) for i, k in n.items() if k}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= packing.CAPACITY for v in bins.values())


def test_run_gives_the_stages_rows(spark, stages):
    rows = lambda df: sorted(map(str, df.drop("bin_id").collect()))
    got, want = corpus_pipeline.run(spark, SF), stages[-1]
    assert got.columns == want.columns and len(rows(got)) == len(rows(want))
    assert sorted((r.doc_id, r.piece, r.tokens) for r in got.collect()) == sorted((r.doc_id, r.piece, r.tokens) for r in want.collect())


def test_a_whole_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "position" in out.columns
