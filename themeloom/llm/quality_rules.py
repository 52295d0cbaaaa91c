"""Quality rules: a threshold table compiled into one projection of native expressions.

`measure` adds per text the counts the rules use, `judge` compiles a table of `Rule`s over ratios of them.
No user function, shuffle or second pass is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import SEPARATOR_CHARS, words_of

# Frequent function words of English, German, French and Spanish. Words count as written here, in
# lower case and without punctuation.
STOP_WORDS = (
    "a an and are as at be been but by can for from had has have he her his i if in into is it its not of on or our "
    "she so than that the their them then there these they this to was we were what when which who will with would "
    "you your "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich "
    "im in ist mit nach nicht noch oder sich sie sind über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas "
    "plus pour que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre era es esta este ha la las lo los más me muy no o para pero por que se si sin "
    "sobre su sus también un una y ya"
).split()

SYMBOLS = r"[#*$%&|<>]"
_INDEX_BITS = 31


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= metric <= high; a null bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# Ratios are per word, or per line with a word for `dup_line_ratio`.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.06),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)

METRICS = {
    "n_words": lambda c: c("n_words"),
    "mean_word_length": lambda c: F.try_divide(c("word_chars"), c("n_words")),
    "symbol_ratio": lambda c: F.try_divide(c("n_symbols"), c("n_words")),
    "stop_word_ratio": lambda c: F.try_divide(c("n_stop_words"), c("n_words")),
    "dup_line_ratio": lambda c: F.try_divide(c("n_dup_lines"), c("n_lines")),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _neighbour_equal(items: Column, key) -> Column:
    """Of a sorted array, the items whose key equals that of the item before or after."""
    return F.filter(
        items,
        lambda x, j: ((j > 0) & (key(F.get(items, j - 1)) == key(x)))
        | F.coalesce(key(F.get(items, j + 1)) == key(x), F.lit(False)),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of COUNTS (long) to every row, in one narrow pass.

    A null, empty or blank text has 0 everywhere. Repeated 3-word windows are found by sorting hashed windows
    with their positions in one array of longs; windows whose hashes meet are compared as text, so the count is
    exact, and the cost is n log n for a text of n words however long it is.
    """
    kept = [c for c in docs.columns if c not in COUNTS]
    source = F.coalesce(docs[text], F.lit(""))
    base = docs.select(*[docs[c] for c in kept], source.alias("_q_text"), words_of(source).alias("_q_w"))
    w = F.col("_q_w")

    def window(i):
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    hashed = F.transform(
        F.when(F.size(w) >= 3, F.slice(w, 1, F.size(w) - 2)).otherwise(F.array().cast("array<string>")),
        lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), _INDEX_BITS).bitwiseOR(i.cast("long")),
    )
    step = base.withColumn("_q_h", F.sort_array(hashed))
    step = step.withColumn("_q_c", _neighbour_equal(F.col("_q_h"), lambda v: F.shiftright(v, _INDEX_BITS)))
    exact = F.sort_array(F.transform(
        F.col("_q_c"),
        lambda v: F.struct(
            window(v.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).cast("int")).alias("g"),
            v.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).cast("int").alias("i"),
        ),
    ))
    step = step.withColumn("_q_e", exact)
    repeated = _neighbour_equal(F.col("_q_e"), lambda v: v["g"])
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda v: F.array(v["i"], v["i"] + 1, v["i"] + 2))))
    step = step.withColumn("_q_l", F.filter(F.split(F.col("_q_text"), "\n"), lambda s: F.btrim(s, F.lit(SEPARATOR_CHARS)) != ""))
    stop = F.filter(w, lambda x: x.isin(*STOP_WORDS))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_q_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_q_l").cast("long").alias("n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )
    # A generator of one row: a later filter on the counts stays above it. Pushed below, it would put the arrays'
    # expressions in place of their names inside the lambdas and evaluate them for every element.
    return step.select(*[F.col(c) for c in kept], F.inline(F.array(counts)))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the failed rules, in table order, joined by commas; '' when all hold. 0/0 counts as 0."""
    failed = []
    for rule in rules:
        value = F.coalesce(METRICS[rule.metric](F.col), F.lit(0.0))
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        failed.append(F.when(bad, F.lit(rule.name)))
    return F.concat_ws(",", *failed)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the counts, base_failed, failed_rules and kept to every row; rows are never dropped here.

    base_failed: under 50 words, or over half of the words lie in 3-word windows found twice or more.
    kept: not base_failed and no rule of the table fails. Null and empty texts have base_failed true and kept
    false. Repeated rows are judged alike, and columns that clash with the added ones are replaced.
    """
    measured = measure(docs, text)
    plain = [c for c in measured.columns if c not in ("base_failed", "failed_rules", "kept")]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.select(*plain, base.alias("base_failed"), compile_rules(rules).alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
