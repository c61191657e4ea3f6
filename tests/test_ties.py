"""Ranks of some scores among all: a few ties do not put all scores in order, and ties keep to the order of ids."""

import numpy as np
import pytest

from vecsieve.operators import search


def plain(s):
    order = np.argsort(-s, kind="stable")
    nan = np.isnan(s[order])
    return np.concatenate([order[nan], order[~nan]])


def test_one_tie_does_not_order_all(monkeypatch):
    monkeypatch.setattr(search, "descending", lambda s: pytest.fail("all scores were put in order"))
    s = np.array([0.5, 0.25, 0.5, 0.75, 0.5, 0.1])
    assert search.places(s, np.array([4, 1, 2])).tolist() == [3, 4, 2]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_ranks_with_ties(monkeypatch, most):
    monkeypatch.setattr(search, "FEW_TIES", most, raising=False)
    rng = np.random.default_rng(5)
    for n in range(60):
        s = rng.integers(0, 1 + n, n) / 8 - 2
        s[: n // 9] = rng.choice([np.nan, -0.0, 0.0, np.inf, -np.inf], n // 9)
        rng.shuffle(s)
        at = np.flatnonzero(rng.random(n) < 0.4)
        rank = np.empty(n, int)
        rank[plain(s)] = np.arange(n)
        order, got = search.in_order(s, at)
        assert search.descending(s).tolist() == plain(s).tolist() and search.places(s, at).tolist() == rank[at].tolist()
        assert got.tolist() == sorted(rank[at]) and rank[at[order]].tolist() == got.tolist()
