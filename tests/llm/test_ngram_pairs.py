"""The links of the join, not only its groups."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from gatecrest.llm import ngram_jaccard, tokens

SCHEMA = "doc_id long, text string"
T = ngram_jaccard.THRESHOLD


def grams(text, n=3):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for f in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(60):  # of 60 documents every third is an exact copy of the family's first
            copy = list(base)
            if k % 3:
                for at in rng.sample(range(300), 8):
                    copy[at] = f"x{rng.randrange(5000)}"
            out.append((f * 100 + k, " ".join(copy)))
    out += [(1000 + k, " ".join(f"w{k * 30 + j}" for j in range(60))) for k in range(6)]  # a chain: neighbours share half
    base = [f"y{rng.randrange(9000)}" for _ in range(400)]
    out += [(2000 + k, " ".join(base[: 100 + 7 * k])) for k in range(40)]  # prefixes: sizes from 100 to 373 words
    shared = " ".join(f"s{k}" for k in range(60))
    out += [(3000 + k, shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(300))) for k in range(80)]  # a passage in common, no more
    return out + [(0, "a text of its own two rows have"), (900, "a text of its own two rows have")]  # a document of two texts


@pytest.fixture(scope="module")
def truth(rows):
    """Jaccard coefficients of the pairs of documents that reach the threshold."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(grams(t))
    jaccard = lambda i, j: max(len(x & y) / len(x | y) for x in sets[i] for y in sets[j])
    return {p: j for p in combinations(sorted(sets), 2) if (j := jaccard(*p)) >= T}


@pytest.mark.parametrize(("part", "tile"), [(ngram_jaccard.PART, ngram_jaccard.TILE), (7, 4000)])  # the second cuts blocks into parts and groups into tiles
def test_every_link_is_found(spark, rows, truth, part, tile):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    classes, copies, linked = (d.collect() for d in ngram_jaccard.class_pairs(docs, part=part, tile=tile))
    members = {c.set_hash: [c.first] for c in classes}
    for c in copies:
        members[c.set_hash] += [c.doc_id] if c.doc_id != c.first else []
    got = {}
    for a, b, j in [(p.a, p.b, p.jaccard) for p in linked] + [(s, s, 1.0) for s in members]:
        for x in members[a]:
            for y in members[b]:
                if x != y:
                    got[min(x, y), max(x, y)] = max(j, got.get((min(x, y), max(x, y)), 0))
    assert len(truth) > 5000 and set(got) <= set(truth) and len(got) >= 0.998 * len(truth)
    assert all(got[p] == pytest.approx(truth[p], abs=1e-6) for p in got)
    assert len(linked) == len({(p.a, p.b) for p in linked}) and all(p.a < p.b for p in linked)
    near = ngram_jaccard.near_duplicates(docs, part=part, tile=tile).collect()
    links, best = {}, {}
    for (a, b), j in got.items():
        for x in (a, b):
            links[x] = links.get(x, 0) + 1
            best[x] = max(best.get(x, 0), j)
    assert {r.doc_id for r in near} == set(links)
    for r in near:
        if r.doc_id:  # the document of two texts has a row for each
            assert (r.links, r.jaccard) == (links[r.doc_id], pytest.approx(best[r.doc_id], abs=1e-6))
            assert got[min(r.doc_id, r.match_id), max(r.doc_id, r.match_id)] == pytest.approx(r.jaccard, abs=1e-6)
            assert r.group_id <= r.class_id <= r.doc_id


def sketch(sets):
    return ngram_jaccard.Forest(np.array([len(s) for s in sets]), np.stack([ngram_jaccard.bitmap(s, ngram_jaccard.BITS) for s in sets]), [None] * len(sets), np.zeros((len(sets), 1), np.int32), np.zeros(len(sets), np.int64), T)


@pytest.mark.parametrize("sides", [1, 2])
def test_signature_trees_lose_no_pair(sides):
    rng = np.random.default_rng(1)
    sets = []
    for f in range(80):
        base = tokens.mix(rng.integers(0, 1 << 62, int(rng.integers(10, 400)), np.uint64))
        for _ in range(int(rng.integers(1, 8))):
            s = base.copy()
            s[rng.random(len(s)) < rng.uniform(0, 0.4)] = tokens.mix(rng.integers(0, 1 << 62, 1, np.uint64))[0]
            sets.append(np.unique(s))
    job = np.sort(rng.integers(0, 3, len(sets)))
    side = np.concatenate([np.sort(rng.integers(0, sides, int((job == j).sum()))) for j in range(3)])
    order = np.lexsort(([len(s) for s in sets], side, job))
    sets = [sets[k] for k in order]
    forest = sketch(sets)
    got = {(x, y) for p, q in forest.pairs(job, side) for x, y in zip(p.tolist(), q.tolist())}
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    every = [(i, j) for i, j in combinations(range(len(sets)), 2) if job[i] == job[j] and (sides == 1 or side[i] != side[j])]
    close = {p for p in every if jaccard(*p) >= T}
    assert close and close <= got and len(got) < 0.2 * len(every)


def test_the_tree_drops_most_pairs_before_they_are_compared():
    """Families of different sizes: node pairs are dropped by size ranges, others by the bits of whole nodes."""
    rng = np.random.default_rng(4)
    sets = sorted((np.unique(tokens.mix(rng.integers(0, 1 << 62, int(n), np.uint64))) for n in np.geomspace(8, 1000, 600)), key=len)
    forest = sketch(sets)
    found = sum(len(p) for p, _ in forest.pairs(np.zeros(600), np.zeros(600)))
    assert forest.seen["nodes dropped"] > 0.3 * forest.seen["nodes"]
    assert forest.seen["sets"] < 0.5 * 600 * 599 / 2 and found < 0.05 * 600 * 599 / 2
