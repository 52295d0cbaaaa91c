"""Non-negative matrix factorisation X = W H by alternating non-negative least squares.

Only H (topics x vocabulary, bounded by the vocabulary limit) lives on the driver. Each iteration is
one job: tasks solve their rows of W against H and return W'X and W'W, which are summed by topic in
two steps. W is never stored, so lineage does not grow and a lost executor costs only its own rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.operators.blocks import summed
from themeloom.session import materialise

_OVERSAMPLING, _POWER_PASSES = 10, 6


@dataclass
class Factorisation:
    topic_term: np.ndarray
    objective: list[float] = field(default_factory=list)

    @property
    def iterations(self) -> int:
        return len(self.objective)


def _leading_subspace(cells: DataFrame, width: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right singular vectors by randomised subspace iteration."""
    r = min(width, k + _OVERSAMPLING)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, r)))[0]

    def pass_over(q: np.ndarray) -> np.ndarray:
        return np.stack(summed(cells, lambda rows: list(S.transposed_times(rows, S.times(rows, q), width)))).T

    for _ in range(_POWER_PASSES):
        image = pass_over(basis)
        basis = np.linalg.qr(image)[0]
    values, vectors = np.linalg.eigh(basis.T @ pass_over(basis))
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0.0)), basis @ vectors[:, order]


def _spectral_start(cells: DataFrame, width: int, k: int, seed: int) -> np.ndarray:
    """Start from the singular vectors: each topic takes the stronger sign of its vector pair."""
    sigma, right = _leading_subspace(cells, width, k, seed)

    def side_norms(rows: S.Rows) -> list[np.ndarray]:
        left = S.times(rows, right)
        return [(np.maximum(left, 0) ** 2).sum(axis=0), (np.maximum(-left, 0) ** 2).sum(axis=0)]

    above, below = (np.sqrt(part) for part in summed(cells, side_norms))
    start = np.zeros((len(sigma), width))
    for j, s in enumerate(sigma):
        if s <= 0:
            continue
        if j == 0:
            start[0] = np.sqrt(s) * np.abs(right[:, 0])
            continue
        positive, negative = np.maximum(right[:, j], 0), np.maximum(-right[:, j], 0)
        strength = [above[j] * np.linalg.norm(positive), below[j] * np.linalg.norm(negative)]
        part = positive if strength[0] >= strength[1] else negative
        start[j] = np.sqrt(max(strength)) * part / max(np.linalg.norm(part), 1e-300)
    return start


def fit_many(
    df: DataFrame,
    indices: Column,
    values: Column,
    width: int,
    topics: Iterable[int],
    seed: int = C.SEED,
    init: str = "nndsvd",
    max_iterations: int = C.NMF_MAX_ITERATIONS,
    tolerance: float = C.NMF_TOLERANCE,
) -> dict[int, Factorisation]:
    """Fits H for each number of topics on the sparse rows given by two array columns, in the same scans.

    The rows are written once, so that no executor holds them in memory. One scan per iteration serves every fit that has
    not settled: a fit stops when its objective does. The spectral start is found once, for the most topics, and its
    leading part serves the others.
    """
    cells = materialise(df.select(indices.alias("indices"), values.alias("values")), "nmf-cells")
    topics = sorted(set(topics))
    squares, rows = cells.agg(
        F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")
    ).first()
    if init == "nndsvd":
        start = _spectral_start(cells, width, topics[-1], seed)
        models = {k: Factorisation(np.vstack([start[:k], np.zeros((max(k - len(start), 0), width))])) for k in topics}
    else:
        models = {}
        for k in topics:
            mean = np.sqrt((squares / max(rows, 1)) / (width * k))
            models[k] = Factorisation(mean * np.abs(np.random.default_rng(seed).standard_normal((k, width))))
    going = list(topics)
    for _ in range(max_iterations):
        solved = _row_solutions(cells, [models[k].topic_term for k in going], width)
        for k, (cross, gram) in zip(list(going), solved):
            model = models[k]
            h = model.topic_term = _update_topics(model.topic_term, cross, gram)
            error = squares - 2 * (cross * h).sum() + (gram * (h @ h.T)).sum()
            previous = model.objective[-1] if model.objective else np.inf
            model.objective.append(float(error))
            if previous - error <= tolerance * max(error, 1e-12):
                going.remove(k)
        if not going:
            break
    return models


def fit_nmf(df: DataFrame, indices: Column, values: Column, width: int, n_topics: int = C.N_TOPICS, seed: int = C.SEED, **options) -> Factorisation:
    """One fit; `options` as for `fit_many`."""
    return fit_many(df, indices, values, width, [n_topics], seed, **options)[n_topics]


def _row_solutions(cells: DataFrame, fits: list[np.ndarray], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """W'X and W'W of every fit, from one scan in which each task solves its rows of W against each H."""
    # Columns of all fits side by side: a row is multiplied with them once.
    stacked = np.ascontiguousarray(np.vstack(fits).T)
    grams = [h @ h.T for h in fits]
    ends = np.cumsum([0] + [len(h) for h in fits])

    def solve(rows: S.Rows) -> list[np.ndarray]:
        targets = S.times(rows, stacked)
        out = []
        for gram, a, b in zip(grams, ends, ends[1:]):
            w = S.non_negative_least_squares(targets[:, a:b], gram)
            out += list(np.hstack([S.transposed_times(rows, w, width), w.T @ w]))
        return out

    sums = summed(cells, solve)
    parts = [np.stack(sums[a:b]) for a, b in zip(ends, ends[1:])]
    return [(p[:, :width], p[:, width:]) for p in parts]


def _update_topics(h: np.ndarray, cross: np.ndarray, gram: np.ndarray, sweeps: int = 20) -> np.ndarray:
    h = h.copy()
    for _ in range(sweeps):
        for k in np.flatnonzero(np.diag(gram) > 0):
            h[k] = np.maximum(0.0, h[k] + (cross[k] - gram[k] @ h) / gram[k, k])
    return h


def infer(indices: Column, values: Column, topic_term: np.ndarray) -> Column:
    """Topic weights of new rows with H fixed; an empty row gets zeros. A narrow, vectorised step."""
    columns = np.ascontiguousarray(topic_term.T)
    gram = topic_term @ topic_term.T

    def solve(idx: pa.Array, val: pa.Array) -> pa.Array:
        blocks = [S.non_negative_least_squares(S.times(rows, columns), gram) for rows in S.row_blocks(idx, val)]
        weights = np.vstack(blocks) if blocks else np.zeros((0, gram.shape[0]))
        offsets = np.arange(len(weights) + 1, dtype=np.int32) * gram.shape[0]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights.ravel()))

    # Not for its results, but so that filters on them never make the solver run twice.
    return F.arrow_udf(solve, "array<double>").asNondeterministic()(indices, values)
