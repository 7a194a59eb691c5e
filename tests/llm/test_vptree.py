"""Nearest neighbours: recall with the production factor and shard size, ties, exactness of factor 1."""

import numpy as np
import pandas as pd
import pytest

from versarium.llm import vptree


@pytest.mark.parametrize("mixed", [False, True])
def test_recall_with_mixed_norms_and_an_outlier(mixed):
    random = np.random.default_rng(3)
    x = random.normal(size=(vptree.SHARD, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if mixed:
        x *= random.uniform(0.5, 2, size=(len(x), 1))
    x[17] *= 3 / np.linalg.norm(x[17])
    asked = np.arange(0, len(x), 80)
    shard = pd.DataFrame({"vec_id": np.arange(len(x)), "v": list(x)})
    block = pd.DataFrame({"query_id": asked, "v": list(x[asked] * random.uniform(0.2, 5, size=(len(asked), 1)))})
    got = vptree._searched(shard, block, 20, vptree.FACTOR).groupby("query_id")["vec_id"].agg(set)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[i] & set(w.tolist())) / 20 for i, w in zip(asked.tolist(), want)]) >= 0.9


def searched(x, asked, k, factor, ids=None):
    ids = np.arange(1, len(x) + 1) if ids is None else ids
    shard = pd.DataFrame({"vec_id": ids, "v": list(x)})
    block = pd.DataFrame({"query_id": [a for a, _ in asked], "v": [q for _, q in asked]})
    found = vptree._searched(shard, block, k, factor)
    return {q: list(zip(g["vec_id"], g["score"])) for q, g in found.groupby("query_id")}


def brute(x, query_id, q, k, ids=None):
    ids = np.arange(1, len(x) + 1) if ids is None else ids
    scores = np.einsum("ij,j->i", x, q)
    return sorted(((i, s) for i, s in zip(ids.tolist(), scores.tolist()) if i != query_id), key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_ties_go_to_the_smaller_id(factor):
    random = np.random.default_rng(7)
    plane = np.column_stack([np.full(3000, 0.5), *random.uniform(-1, 1, (2, 3000))])
    for got in searched(plane, [(0, np.array([1.0, 0, 0])), (-1, np.array([2.0, 0, 0]))], 20, factor).values():
        assert [i for i, _ in got] == list(range(1, 21))
    grid = random.integers(-2, 3, (4000, 4)).astype(float)
    grid = grid[(grid != 0).any(axis=1)]
    asked = [(i + 1, grid[i]) for i in range(0, 200, 7)]
    got = searched(grid, asked, 20, 1.0)
    for one, q in asked:
        assert got[one] == brute(grid, one, q, 20)
    if factor > 1:
        near = searched(grid, asked, 20, factor)
        assert np.mean([len(set(near[one]) & set(got[one])) / 20 for one, _ in asked]) > 0.95


def test_factor_one_is_exact():
    random = np.random.default_rng(8)
    x = random.normal(size=(5000, 6)) * random.uniform(0.01, 3, size=(5000, 1))
    ids = random.permutation(5000) * 3 + 1
    asked = [(int(ids[i]), x[i] * 2) for i in range(0, 5000, 250)]
    got = searched(x, asked, 20, 1.0, ids)
    for one, q in asked:
        want = brute(x, one, q, 20, ids)
        assert [i for i, _ in got[one]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[one]], [s for _, s in want], rtol=1e-13)
    few = searched(x[:5], [(99, x[7])], 20, 1.0)
    assert len(few[99]) == 5
