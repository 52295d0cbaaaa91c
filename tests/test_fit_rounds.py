"""Fits of LDA settle rows in few rounds, by the same test as rounds one after another."""

import numpy as np

from themeloom.functions import sparse as S
from themeloom.operators import lda as LDA


def _rows(rng, sizes, width):
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.concatenate([np.sort(rng.choice(width, n, replace=False)) for n in sizes]).astype(np.int32)
    return offsets, columns, rng.integers(1, 4, offsets[-1]).astype(float)


def _counted(monkeypatch):
    seen, once = [0], LDA._exp_digamma

    def counted(x):
        seen[0] += len(x)
        return once(x)

    monkeypatch.setattr(LDA, "_exp_digamma", counted)
    return seen


def test_a_fit_leaps_over_most_rounds_where_topics_are_alike(monkeypatch):
    rng = np.random.default_rng(3)
    rows = _rows(rng, rng.integers(0, 120, 300), 400)
    words = LDA.expected_log(rng.gamma(100.0, 0.01, (8, 400)))
    seen = _counted(monkeypatch)
    plain = LDA._statistics([(words, 1 / 8)], 400)(rows)
    many, seen[0] = seen[0], 0
    leaps = LDA._statistics([(words, 1 / 8)], 400, leaps=True)(rows)
    assert seen[0] < many / 2, (seen[0], many)
    # Every count goes to some topic, whichever way rows settle.
    whole = np.bincount(rows[1], weights=rows[2], minlength=400)
    for sums in (plain, leaps):
        np.testing.assert_allclose((np.stack(sums[:-1]) * words).sum(axis=0), whole, rtol=1e-9, atol=1e-12)
        assert sums[-1][0] == 300


def test_rows_settled_in_leaps_stay_in_a_whole_round_and_are_those_of_endless_rounds():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([[1, 1], rng.integers(2, 200, 400), [390]])
    rows = _rows(rng, sizes, 400)
    words = LDA.expected_log(rng.gamma(0.5, 1.0, (6, 400)) + 0.1)
    prior, alone = 1 / 6, 0
    for group, cells, counts, _ in LDA._groups(rows, 6):
        weights = LDA._weights(words, rows[1][cells])
        gamma = LDA._settle_in_leaps(weights, counts, prior)
        assert (gamma >= prior).all()
        after = gamma
        for turn in range(2000):
            mix = LDA._exp_digamma(after)[:, None, :]
            after = prior + (mix * (weights @ (counts / (mix @ weights + 1e-100)).transpose(0, 2, 1)).transpose(0, 2, 1))[:, 0]
            if not turn:
                assert (np.abs(after - gamma).mean(axis=1) <= 1.5e-3).all()
        near = np.abs(after - gamma).mean(axis=1) < 0.05
        alone += int((~near).sum())
    assert alone <= 4  # a row may have two rests


def test_statistics_of_several_models_are_those_of_each():
    rng = np.random.default_rng(5)
    rows = _rows(rng, [0, 3, 90, 1, 0, 40, 41, 42], 100)
    models = [(LDA.expected_log(rng.gamma(1.0, 1.0, (k, 100)) + 0.1), 1 / k) for k in (2, 5)]
    together = LDA._statistics(models, 100, leaps=True)(rows)
    alone = [part for model in models for part in LDA._statistics([model], 100, leaps=True)(rows)[:-1]]
    for a, b in zip(together, alone, strict=False):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    gamma, ratio = LDA.mixes(rows, models[1][0], 1 / 5)
    plain = S.transposed_times((rows[0], rows[1], ratio), LDA.expected_log(gamma), 100)
    np.testing.assert_allclose(np.stack(LDA._statistics(models, 100)(rows)[2:-1]), plain, rtol=1e-9, atol=1e-12)
    empty = LDA._statistics(models, 100, leaps=True)((np.array([0, 0, 0]), np.zeros(0, np.int32), np.zeros(0)))
    assert empty[-1][0] == 2 and not np.any(np.stack(empty[:-1]))
