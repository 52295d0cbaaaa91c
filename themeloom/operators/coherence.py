"""Sliding-window c_v coherence of topics' top words against the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.functions import text as T

_SEGMENTS_AT_ONCE = 4096
_SEGMENT_WORDS = 1 << 20  # segments x words at once: 8 MB
_COUNT_SCHEMA = "model string, word1 string, word2 string, windows long"


def dictionary(corpus: DataFrame) -> DataFrame:
    """Distinct words of the corpus."""
    return corpus.select(F.explode(T.words_of(F.col("clean_text"))).alias("word")).distinct()


def usable_words(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """`(model, topic, word, times)`: top terms that are words of the corpus.

    A topic none of whose terms is a single word falls back to the words inside its n-grams. Only the
    topics' own words are looked up, so the corpus' full dictionary is never built.
    """
    terms = _held(terms.select("model", "topic", "term"))
    parts = terms.select("model", "topic", "term", F.explode(F.split("term", " ")).alias("word"))
    candidates = terms.select(F.col("term").alias("word")).union(parts.select("word")).distinct()
    tokens = corpus.select(F.explode(T.words_of(F.col("clean_text"))).alias("word"))
    known = tokens.join(F.broadcast(candidates), "word", "left_semi").distinct()
    whole = terms.select("model", "topic", F.col("term").alias("word")).join(known, "word", "left_semi")
    stranded = terms.select("model", "topic").distinct().join(whole, ["model", "topic"], "left_anti")
    split = parts.join(stranded, ["model", "topic"], "left_semi").join(known, "word", "left_semi")
    return (
        whole.select("model", "topic", "word").unionByName(split.select("model", "topic", "word"))
        .groupBy("model", "topic", "word").agg(F.count("*").alias("times"))
    )


def _spans(word: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's windows as separate spans: those of neighbouring places overlap and become one."""
    order = np.lexsort((first, word))
    word, first, after = word[order], first[order], after[order]
    opens = np.concatenate([[True], (word[1:] != word[:-1]) | (first[1:] > after[:-1])])
    closes = np.append(opens[1:], True)
    return word[opens], first[opens], after[closes]


def _add_joint(joint: np.ndarray, word: np.ndarray, first: np.ndarray, after: np.ndarray) -> None:
    """Adds to `joint` the number of windows that hold both words, for all words and windows of the spans.

    Between consecutive ends of spans the set of present words is constant, so windows are counted in whole segments.
    """
    edges = np.unique(np.concatenate([first, after]))
    opens, closes, sizes = np.searchsorted(edges, first), np.searchsorted(edges, after), np.diff(edges).astype(float)
    by_open = np.argsort(opens, kind="stable")
    word, opens, closes = word[by_open], opens[by_open], closes[by_open]
    n = len(joint)
    at_once = min(_SEGMENTS_AT_ONCE, max(_SEGMENT_WORDS // n, n))  # a table of all pairs is made at most once for as many segments
    for start in range(0, len(sizes), at_once):
        stop = min(start + at_once, len(sizes))
        here = np.flatnonzero(closes[: np.searchsorted(opens, stop)] > start)
        low, high = np.maximum(opens[here], start), np.minimum(closes[here], stop)
        held = high - low
        segment = np.repeat(low - start - (np.cumsum(held) - held), held) + np.arange(held.sum())
        present = np.repeat(word[here], held)
        weight = sizes[start:stop]
        count = np.bincount(segment, minlength=stop - start)
        if (count * count).sum() > (stop - start) * n:
            inside = np.zeros((stop - start, n))
            inside[segment, present] = 1.0
            joint += inside.T @ (inside * weight[:, None])
            continue
        order = np.argsort(segment, kind="stable")
        segment, present = segment[order], present[order]
        each = count[segment]  # every word of a segment meets as many words as the segment has
        one = np.repeat(np.arange(len(segment)), each)
        two = np.repeat((np.cumsum(count) - count)[segment] - (np.cumsum(each) - each), each) + np.arange(len(one))
        joint += np.bincount(present[one] * n + present[two], weights=weight[segment[one]], minlength=n * n).reshape(n, n)


def _counter(words: list[str], groups: dict[str, np.ndarray], pairs: np.ndarray, window: int):
    """Arrow function that sums window counts over its whole partition before anything is shuffled.

    The windows of a block of documents are numbered one after another, so one sweep serves all of them. The word at
    place p of a document is inside its windows p-window+1 .. p.
    """
    known = pa.array(words, pa.string())
    names = list(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((len(words), len(words)))
        totals = np.zeros(len(names))
        for block in (block for batch in batches for block in S.text_blocks(batch.column(0))):
            lists = pc.split_pattern(pc.fill_null(block, ""), " ")
            starts = lists.offsets.to_numpy().astype(np.int64)
            found = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known), -1).to_numpy()
            hits = np.flatnonzero(found >= 0)
            if not len(hits):
                continue
            windows = np.maximum(1, np.diff(starts) - window + 1)
            before = np.cumsum(windows) - windows
            document = np.searchsorted(starts, hits, side="right") - 1
            place, word = hits - starts[document], found[hits].astype(np.int64)
            first = before[document] + np.maximum(place - window + 1, 0)
            after = before[document] + np.minimum(place, windows[document] - 1) + 1
            _add_joint(joint, *_spans(word, first, after))
            for g, name in enumerate(names):
                totals[g] += windows[np.unique(document[groups[name][word]])].sum()
        i, j = pairs[:, 0], pairs[:, 1]
        seen = joint[i, j] > 0
        n = int(seen.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None] * n + names, pa.string()),
                pa.concat_arrays([known.take(pa.array(i[seen])), pa.nulls(len(names), pa.string())]),
                pa.concat_arrays([known.take(pa.array(j[seen])), pa.nulls(len(names), pa.string())]),
                pa.array(np.concatenate([joint[i, j][seen], totals]).astype(np.int64)),
            ],
            ["model", "word1", "word2", "windows"],
        )

    return count


def window_counts(usable: DataFrame, corpus: DataFrame, window: int = C.COHERENCE_WINDOW) -> DataFrame:
    """`(model, word1, word2, windows)` over all boolean sliding windows of the corpus.

    Rows with words count the windows that hold both (`word1 = word2` counts one word), for the pairs
    that share a topic. Rows with a model count the windows of the documents that hold any of its
    words. `usable` has a few words per topic; they travel with the tasks, and each task returns one
    row per pair, so the corpus itself is never shuffled.
    """
    rows = usable.select("model", "topic", "word").collect()
    words = sorted({r["word"] for r in rows})
    if not words:
        return corpus.sparkSession.createDataFrame([], _COUNT_SCHEMA)
    index = {w: i for i, w in enumerate(words)}
    topics: dict[tuple[str, int], set[int]] = {}
    groups: dict[str, np.ndarray] = {}
    for r in rows:
        topics.setdefault((r["model"], r["topic"]), set()).add(index[r["word"]])
        groups.setdefault(r["model"], np.zeros(len(words), dtype=bool))[index[r["word"]]] = True
    pairs = np.array(sorted({(i, j) for t in topics.values() for i in t for j in t if i <= j}))
    count = _counter(words, groups, pairs, window)
    return (
        corpus.select("clean_text").mapInArrow(count, _COUNT_SCHEMA)
        .groupBy("model", "word1", "word2").agg(F.sum("windows").alias("windows"))
    )


def _npmi(joint: Column, first: Column, second: Column, windows: Column) -> Column:
    """Normalised pointwise mutual information, in double arithmetic and with a fixed epsilon."""
    together = joint / windows + F.lit(C.COHERENCE_EPSILON)
    apart = (first / windows) * (second / windows)
    return F.try_divide(F.ln(F.try_divide(together, apart)), -F.ln(together))


def topic_coherence(usable: DataFrame, counts: DataFrame) -> DataFrame:
    """`(model, topic, coherence)` from the window counts.

    Every word is described by its NPMI with each word of the topic and compared, by cosine, with the
    sum over the topic's words. All tables here have topics x top-words rows.
    """
    totals = counts.where(F.col("model").isNotNull()).select("model", F.col("windows").cast("double").alias("all"))
    joint = counts.where(F.col("model").isNull()).select("word1", "word2", F.col("windows").cast("double").alias("both"))
    single = joint.where(F.col("word1") == F.col("word2")).select(F.col("word1").alias("word"), F.col("both").alias("n"))
    described = usable.join(single, "word").join(totals, "model")
    left = described.select("model", "topic", "all", F.col("word").alias("a"), F.col("times").alias("ta"), F.col("n").alias("na"))
    right = described.select("model", "topic", F.col("word").alias("b"), F.col("times").alias("tb"), F.col("n").alias("nb"))
    cells = (
        left.join(right, ["model", "topic"])
        .withColumn("word1", F.least("a", "b")).withColumn("word2", F.greatest("a", "b"))
        .join(joint, ["word1", "word2"], "left")
        .select("model", "topic", "a", "ta", "b", "tb",
                _npmi(F.coalesce("both", F.lit(0.0)), F.col("na"), F.col("nb"), F.col("all")).alias("v"))
    )
    whole = cells.groupBy("model", "topic", "b").agg(F.sum(F.col("ta") * F.col("v")).alias("s"))
    words = cells.join(whole, ["model", "topic", "b"]).groupBy("model", "topic", "a", "ta").agg(
        F.sum(F.col("tb") * F.col("v") * F.col("s")).alias("dot"),
        F.sum(F.col("tb") * F.col("v") * F.col("v")).alias("vv"),
        F.sum(F.col("tb") * F.col("s") * F.col("s")).alias("ss"),
    )
    norms = F.nullif(F.sqrt("vv") * F.sqrt("ss"), F.lit(0.0))
    cosine = F.coalesce(F.try_divide(F.col("dot"), norms), F.lit(0.0))
    return words.groupBy("model", "topic").agg((F.sum(F.col("ta") * cosine) / F.sum("ta")).alias("coherence"))


def _held(df: DataFrame) -> DataFrame:
    """A table of topics x top-words rows, kept as a local relation so that it is computed once."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def coherence_cv(terms: DataFrame, corpus: DataFrame, window: int = C.COHERENCE_WINDOW) -> DataFrame:
    """`(model, coherence)` of the top terms `(model, topic, rank, term)`."""
    usable = _held(usable_words(terms, corpus))
    counts = _held(window_counts(usable, corpus, window))
    return topic_coherence(usable, counts).groupBy("model").agg(F.avg("coherence").alias("coherence"))
