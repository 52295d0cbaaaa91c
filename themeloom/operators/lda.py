"""Latent Dirichlet allocation by online variational Bayes.

Rows are dealt once into mini-batches, stored apart, and every step reads its own batch only: a pass over the corpus
is one scan of it, however many steps it has. Several numbers of topics are fitted by the same scans. The topics
(topics x vocabulary, bounded by the vocabulary limit) are all the state there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.operators.blocks import summed
from themeloom.session import materialise

BATCH_FRACTION = 0.5  # of the corpus in a mini-batch
_CELLS = 1 << 20  # of a block that is sorted by length: some ten MB
_WEIGHTS = 1 << 19  # of rows that settle together: 4 MB
_FILLED = 1.25  # the longest of them to the shortest
_KEPT = 0.6  # fewer live rows than this share of them are moved together
_FEW = 64  # rows of a group that may be filled up to twice the length
_ROUNDS, _SETTLED = 100, 1e-3  # of a document's mix
_LEAP = 64.0  # of a leap, in moves


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for positive arguments."""
    shift = sum(1.0 / (x + i) for i in range(6))
    y = x + 6.0
    z = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - shift


def expected_log(parameters: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet rows."""
    return np.exp(digamma(parameters) - digamma(parameters.sum(axis=1))[:, None])


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)): the terms of `digamma`, with its six reciprocals as one fraction and no logarithm."""
    u = x * (x + 5.0)
    shift = (2.0 * x + 5.0) * ((3.0 * u + 20.0) * u + 24.0) / (u * ((u + 10.0) * u + 24.0))
    y = x + 6.0
    z = 1.0 / (y * y)
    return y * np.exp(-0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - shift)


def _settle(weights: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Dirichlet parameters of the rows' mixes; `weights` is rows x topics x cells, `counts` rows x 1 x cells.

    A settled row stays as it is, so that a row's mix does not depend on its neighbours. A common factor of a row's mix
    cancels in a round, so mixes are not normalised here.
    """
    k = weights.shape[1]
    gamma = np.ones((len(weights), k))
    active, current, live = np.arange(len(weights)), gamma, np.ones(len(weights), bool)
    for _ in range(_ROUNDS):
        mix = _exp_digamma(current)
        ratio = np.matmul(mix[:, None, :], weights)
        ratio += 1e-100
        np.divide(counts, ratio, out=ratio)
        after = prior + mix * np.matmul(weights, ratio.transpose(0, 2, 1))[:, :, 0]
        moved = np.abs(after - current).mean(axis=1) > _SETTLED
        current = np.where(live[:, None], after, current)
        live &= moved
        if live.sum() <= _KEPT * len(active):
            gamma[active] = current
            active, current, weights, counts = active[live], current[live], weights[live], counts[live]
            live = np.ones(len(active), bool)
        if not len(active):
            break
    gamma[active] = current
    return gamma


def _settle_in_leaps(weights: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """As `_settle`, with fewer rounds: every third one starts from where the two before it point to.

    Where rounds shrink a row's distance by a steady factor, which is close to one while topics are alike, the length
    of two moves and of their difference tells how far the rest leads. A row is settled by the same test of a whole
    round, and leaps end at the prior, below which no round ends.
    """
    n, k = weights.shape[:2]
    gamma = np.ones((n, k))
    active, current, before, live = np.arange(n), gamma, gamma, np.ones(n, bool)
    share = np.full(k, 1.0 / k)
    for turn in range(_ROUNDS):
        mix = _exp_digamma(current)
        ratio = np.matmul(mix[:, None, :], weights)
        ratio += 1e-100
        np.divide(counts, ratio, out=ratio)
        after = prior + mix * np.matmul(weights, ratio.transpose(0, 2, 1))[:, :, 0]
        move = after - current
        settled = live & (np.abs(move) @ share <= _SETTLED)
        if turn + 1 == _ROUNDS:
            settled = live
        gamma[active[settled]] = after[settled]
        live &= ~settled
        if turn % 3 == 1:
            step = current - before
            bend = move - step
            far = np.sqrt(np.einsum("ij,ij->i", step, step) / (np.einsum("ij,ij->i", bend, bend) + 1e-300))
            far = np.clip(far, 1.0, _LEAP)[:, None]
            after = np.maximum(before + far * (2.0 * step + far * bend), prior)
        before, current = current, after
        left = int(live.sum())
        if not left:
            break
        if left <= _KEPT * len(active):
            active, current, before, weights, counts = active[live], current[live], before[live], weights[live], counts[live]
            live = np.ones(left, bool)
    return gamma


def _groups(rows: S.Rows, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about the same length, filled up with cells of no count: row numbers, cells, counts and which cells are held.

    Their rounds are products of small matrices that stay in the processor's cache, several times faster than sums over
    cells of mixed rows. Rows without cells are in no group. A group of few rows may be filled up more.
    """
    offsets, _, counts = rows
    n, sizes = len(offsets) - 1, np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    lengths = sizes[order]
    start = int(np.searchsorted(lengths, 1))
    while start < n:
        least = lengths[start]
        longest = max(least * _FILLED, least + 8, min(lengths[min(start + _FEW, n) - 1], 2 * least))
        stop = int(np.searchsorted(lengths, longest, side="right"))
        stop = min(stop, start + max(1, _WEIGHTS // (k * int(lengths[stop - 1]))))
        group, longest = order[start:stop], int(lengths[stop - 1])
        held = np.arange(longest) < sizes[group][:, None]
        cells = offsets[group][:, None] + np.where(held, np.arange(longest), 0)
        yield group, cells, np.where(held, counts[cells], 0.0)[:, None, :], held
        start = stop


def _weights(words: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Rows x topics x cells; a view of topics x rows x cells, which are taken faster."""
    return np.take(words, columns, axis=1).transpose(1, 0, 2)


def mixes(rows: S.Rows, words: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Dirichlet parameters of each row's mix given `words` (topics x vocabulary), and count / norm of each cell."""
    offsets, columns, _ = rows
    gamma, ratio = np.full((len(offsets) - 1, len(words)), prior), np.empty(len(columns))
    columns = columns.astype(np.intp)
    for group, cells, count, held in _groups(rows, len(words)):
        weights = _weights(words, columns[cells])
        gamma[group] = _settle(weights, count, prior)
        norms = np.matmul(expected_log(gamma[group])[:, None, :], weights) + 1e-100
        ratio[cells[held]] = (count / norms)[:, 0][held]
    return gamma, ratio


def _statistics(models: list[tuple[np.ndarray, float]], width: int, leaps: bool = False):
    """Per block, the topic-word counts that each model expects, its topics one after another, and the rows.

    A group is laid out once for all models. A common factor of a row's mix is in its norms too and cancels.
    """
    most = max(len(words) for words, _ in models)
    settle = _settle_in_leaps if leaps else _settle

    def count(rows: S.Rows) -> list[np.ndarray]:
        offsets, columns, _ = rows
        sums = [np.zeros((len(words), width)) for words, _ in models]
        for _, cells, counts, _ in _groups(rows, most):
            column = columns[cells].astype(np.intp)
            flat = column.ravel()
            for (words, prior), total in zip(models, sums):
                weights = _weights(words, column)
                mix = _exp_digamma(settle(weights, counts, prior))
                ratio = (counts / (np.matmul(mix[:, None, :], weights) + 1e-100))[:, 0]
                for topic in range(len(words)):
                    total[topic] += np.bincount(flat, weights=(ratio * mix[:, topic, None]).ravel(), minlength=width)
        return [*np.concatenate(sums), np.array([float(len(offsets) - 1)])]

    return count


def fit_many(
    df: DataFrame,
    indices: Column,
    values: Column,
    width: int,
    topics: Iterable[int],
    seed: int = C.SEED,
    passes: int = C.LDA_PASSES,
    fraction: float = BATCH_FRACTION,
    state: str | None = None,
    leaps: bool = False,
) -> dict[int, np.ndarray]:
    """Topic-word parameters for each number of topics, all of them fitted by the same `passes` scans.

    With `leaps`, rows settle by the same test in fewer rounds, and closer to where endless rounds would lead.

    Rows are dealt by a stored key, so equal rows spread too, and a lost executor costs its tasks of one step. With a
    folder `state`, the topics are written there after every pass, and a fit that was broken off goes on from them.
    """
    spark = df.sparkSession
    batches = max(1, round(1 / fraction))
    keyed = df.select(indices.alias("indices"), values.alias("values"), F.monotonically_increasing_id().alias("_key"))
    dealt = materialise(keyed.withColumn("batch", F.pmod(F.xxhash64("_key"), F.lit(batches)).cast("int")).drop("_key"), "lda-batches", by="batch")
    sizes = {r["batch"]: r["count"] for r in dealt.groupBy("batch").count().collect()}
    rows = sum(sizes.values())
    fitted = {k: np.random.default_rng([seed, k]).gamma(100.0, 0.01, (k, width)) for k in topics}
    done = _resumed(df, state, fitted)
    for number in range(done, passes):
        for place, batch in enumerate(sorted(sizes)):
            step = number * len(sizes) + place + 1
            words = {k: expected_log(t) for k, t in fitted.items()}
            models = [(w, 1.0 / k) for k, w in words.items()]
            *sums, seen = summed(dealt.where(F.col("batch") == batch).select("indices", "values"), _statistics(models, width, leaps), _CELLS)
            rate, start = (C.LDA_OFFSET + step) ** -C.LDA_DECAY, 0
            for k, w in words.items():
                found = 1.0 / k + rows / seen[0] * np.stack(sums[start : start + k]) * w
                fitted[k], start = (1 - rate) * fitted[k] + rate * found, start + k
        if state:
            flat = [(k, t, number + 1, row.tolist()) for k, m in fitted.items() for t, row in enumerate(m)]
            spark.createDataFrame(flat, "k int, topic int, passes int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{state}/{(number + 1) % 2}")
    return fitted


def _resumed(df: DataFrame, state: str | None, fitted: dict[int, np.ndarray]) -> int:
    """Loads the later of two states that turns are taken in writing; gives the passes it holds."""
    best = 0
    for turn in (0, 1) if state else ():
        try:
            rows = df.sparkSession.read.parquet(f"{state}/{turn}").orderBy("k", "topic").collect()
        except Exception:  # never written, or broken off while it was
            continue
        if len(rows) == sum(fitted) and {r["k"] for r in rows} == set(fitted) and rows[0]["passes"] > best:
            best = rows[0]["passes"]
            for k in fitted:
                fitted[k] = np.array([r["weights"] for r in rows if r["k"] == k])
    return best


def fit_lda(df: DataFrame, indices: Column, values: Column, width: int, n_topics: int = C.N_TOPICS, seed: int = C.SEED, **options) -> np.ndarray:
    """Topic-word parameters, topics x vocabulary; `options` as for `fit_many`."""
    return fit_many(df, indices, values, width, [n_topics], seed, **options)[n_topics]


def steps(passes: int = C.LDA_PASSES, fraction: float = BATCH_FRACTION) -> int:
    """Mini-batch steps of a fit: they read the corpus `passes` times in all."""
    return passes * max(1, math.floor(0.5 + 1 / fraction))


def infer(indices: Column, values: Column, topic_term: np.ndarray) -> Column:
    """Topic weights of new rows that sum to one; a row without known terms is uniform. A narrow, vectorised step."""
    words, k = expected_log(topic_term), topic_term.shape[0]

    def solve(idx: pa.Array, val: pa.Array) -> pa.Array:
        blocks = [mixes(rows, words, 1.0 / k)[0] for rows in S.row_blocks(idx, val, _CELLS)]
        gamma = np.vstack(blocks) if blocks else np.zeros((0, k))
        offsets = np.arange(len(gamma) + 1, dtype=np.int32) * k
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((gamma / gamma.sum(axis=1, keepdims=True)).ravel()))

    # Not for its results, but so that filters on them never make the solver run twice.
    return F.arrow_udf(solve, "array<double>").asNondeterministic()(indices, values)
