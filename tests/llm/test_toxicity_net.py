"""The net against plain loops, its training against differences, its thresholds against all of them."""

import numpy as np
import pyarrow as pa
import pytest

from gatecrest.llm import toxicity


def net(rng):
    total = toxicity.FILTERS * len(toxicity.WIDTHS)
    kinds = 2 + len(toxicity.PREFIXES)
    tables = rng.normal(size=(kinds, toxicity.BUCKETS, toxicity.DIM)).astype(np.float32) * 0.3
    return toxicity.Net(tables, [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rng.normal(size=total).astype(np.float32), rng.normal(size=total).astype(np.float32), 0.3)


def plain_score(n, x):
    """Embedding, convolution, rectified maximum and logistic, one number at a time."""
    e = [sum(n.tables[k][row[k]] for k in range(len(row))) for row in x]
    top = []
    for f in n.filters:
        for j in range(toxicity.FILTERS):
            top.append(max(sum(float(e[at + k] @ f[k][:, j]) for k in range(len(f)) if at + k < len(e)) for at in range(len(e))))
    z = sum(max(0.0, t + b) * w for t, b, w in zip(top, n.bias, n.out)) + n.out_bias
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(2)
    n = net(rng)
    texts = ["one", "two words", "three little words", "a longer text of quite a few words, with some words again", ""]
    (x, off), = toxicity.feature_lists(pa.array(texts))
    got = n.scores(x, off)
    for k in range(4):
        assert got[k] == pytest.approx(plain_score(n, x[off[k] : off[k + 1]]), abs=1e-5)
    assert got[4] == 0


def test_training_lowers_the_loss_and_tells_words_apart():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["calm", "river", "stone", "cloud", "paper"], 12)) + (" vile filth" if k % 2 else "") for k in range(120)]
    vocabulary, flat, off = toxicity.encoded([pa.array(texts)])
    y = np.arange(120) % 2
    docs = [flat[off[k] : off[k + 1]] for k in range(120)]
    loss = lambda n: -np.mean([np.log(max(1e-9, s if t else 1 - s)) for t, s in ((t, n.scores(vocabulary[d], np.array([0, len(d)]))[0]) for t, d in zip(y, docs))])
    losses = [loss(toxicity.train(docs, vocabulary, y, epochs=e)) for e in (0, 2, 6)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_threshold_has_the_fewest_weighted_mistakes():
    rng = np.random.default_rng(4)
    toxic, clean = rng.poisson(0.3, 50) + (np.arange(50) > 30), rng.poisson(0.3, 50) + (np.arange(50) < 25)
    t = toxicity.best_threshold(toxic.astype(float), clean.astype(float)) * 50
    cost = [toxic[:k].sum() + toxicity.COST * clean[k:].sum() for k in range(51)]
    assert min(cost) in (cost[int(np.floor(t))], cost[int(np.ceil(t))])
    one, two = np.zeros(10), np.zeros(10)
    one[8], two[1] = 5, 5
    assert toxicity.best_threshold(one, two) == pytest.approx(0.5)  # the middle of the gap
