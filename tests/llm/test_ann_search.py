"""The search of one block: exact results, with few products in double precision."""

import numpy as np
import pytest

from gatecrest.llm import ann


def block(n, dim, copies=0):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        x[rng.permutation(n)[:copies]] = x[0]
    x = ann.unit_rows(x.ravel(), dim)
    ids = np.sort(rng.permutation(10 * n)[:n])
    return ids, x, ann.Codes(x, x.mean(0), ann.rotation(dim))


def test_few_products_are_taken_in_double_precision(monkeypatch):
    """On vectors without structure the bounds leave a third of the pairs; only the first ones and near ties are reranked in double."""
    ids, x, codes = block(4000, 64)
    taken, plain = [], ann.exact_products
    monkeypatch.setattr(ann, "exact_products", lambda q, x, i, j: taken.append(len(i)) or plain(q, x, i, j))
    rows, found, score, reranked = ann.search(ids, x, codes, ids[:128], x[:128], 10)
    assert reranked > 128 * 400
    assert sum(taken) < 128 * 60
    s = x[:128].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(128), np.arange(128)] = -9
    truth = ids[np.argsort(-s, axis=1)[:, :10]]
    assert np.mean([len({*found[rows == r]} & {*truth[r]}) / 10 for r in range(128)]) > 0.97


@pytest.mark.parametrize("n, dim, copies", [(700, 70, 300), (41, 8, 20), (40, 8, 0), (12, 8, 4), (5, 8, 0), (1, 8, 0)])
def test_ties_and_small_blocks(n, dim, copies):
    """Equal products go by id, a vector isn't its own neighbour, and blocks of fewer than k others give all of them."""
    ids, x, codes = block(n, dim, copies)
    qids, q = np.append(ids[:9], -5), np.concatenate([x[:9], x[:1]])
    rows, found, score, _ = ann.search(ids, x, codes, qids, q, 10)
    for r, (i, v) in enumerate(zip(qids, q)):
        exact = np.einsum("ij,j->i", x.astype(np.float64), v.astype(np.float64))
        want = sorted((-round(e, 9), j) for e, j in zip(exact, ids) if j != i)[:10]
        got = [(-round(e, 9), j) for e, j in zip(score[rows == r], found[rows == r])]
        assert len(got) == len(want)
        if n <= 40 or r in (0, 9):  # at most 4 k vectors, all of which are reranked, or the one that has copies
            assert got == want
