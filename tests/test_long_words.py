"""The word check of narratives on words of any length and characters."""

import time

from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T


def test_words_are_runs_of_anything_but_whitespace(spark):
    texts = ["a" * 2_000_000 + " b", "é" * 1_000_000 + " b c", "aé" * 1_000_000, "a\x7fé\x00b c d", "　a é", "", "  ", None]
    texts += [f"a{space}é{space}{space}!" for space in C.WHITESPACE]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4):
        got = [r[0] for r in frame.select(T.has_words(F.col("t"), n)).collect()]
        assert got == [None if t is None else len("".join(" " if c in C.WHITESPACE else c for c in t).split(" ")) - _gaps(t) >= n for t in texts]


def _gaps(text):
    return sum(not w for w in "".join(" " if c in C.WHITESPACE else c for c in text).split(" "))


def test_word_check_is_quick_on_plain_text(spark):
    """Less time than the class of all characters that are no whitespace, tried one character at a time."""
    text = "ordinary words, of a narrative; " * 60
    frame = spark.range(3_000, numPartitions=4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).cache()
    frame.count()
    space = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in C.WHITESPACE) + "]"
    word = space.replace("[", "[^", 1)
    slow = F.rlike(F.col("t"), F.lit(rf"^{space}*+(?:{word}++{space}++){{299}}{word}"))
    spent = []
    for check in (T.has_words(F.col("t"), 300), slow):
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            assert frame.where(check).count() == 3_000
            runs.append(time.perf_counter() - start)
        spent.append(min(runs))
    assert spent[0] < 0.75 * spent[1]
