"""Column expressions that clean, tokenise and display narratives. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions import constants as C

# An address fills a whole run of non-space characters that holds "@" somewhere inside. Anchoring
# at the start of the run and not giving characters back keeps long junk tokens linear.
_EMAIL_LINEAR = r"(?<![^ ])[^ ][^@ ]*+@[^ ]+"
_CONTRACTION = r"\b(?:" + "|".join(f"({a})(?={b}\\b)" for a, b in C.CONTRACTIONS) + ")"
_CONTRACTION_HEADS = "".join(f"${i}" for i in range(1, len(C.CONTRACTIONS) + 1)) + " "
_WORD = r"\p{L}\p{N}_"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once per row however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any_of(text: Column, markers: Iterable[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in markers])


def _replace(text: Column, markers: Iterable[str], pattern: str, new: str = " ") -> Column:
    """Regex replacement, tried only on rows that hold one of the literal markers."""
    return bind(text, lambda t: F.when(_any_of(t, markers), F.regexp_replace(t, pattern, new)).otherwise(t))


def plain_spaces(text: Column) -> Column:
    """Every Unicode whitespace character becomes a space."""
    return F.translate(text, C.WHITESPACE, " " * len(C.WHITESPACE))


def _without_links(text: Column) -> Column:
    """URLs and addresses end at whitespace of any kind, so spaces are made plain first."""
    spaced = plain_spaces(text)
    return F.regexp_replace(F.regexp_replace(spaced, C.URL, " "), _EMAIL_LINEAR, " ")


def clean_text(text: Column) -> Column:
    """Lower-case letters and single spaces only; null becomes the empty string."""
    cleaned = _replace(F.lower(text), ["xx"], C.REDACTION_RUN)
    cleaned = _replace(cleaned, ["$"], C.DOLLAR_AMOUNT)
    cleaned = bind(
        cleaned, lambda t: F.when(_any_of(t, ["http", "www.", "@"]), _without_links(t)).otherwise(t)
    )
    return F.coalesce(F.trim(F.regexp_replace(cleaned, C.NON_LETTERS, " ")), F.lit(""))


def has_words(text: Column, n: int) -> Column:
    """Whether the raw text holds n whitespace-separated words; reads no further than the n-th."""
    if n < 1:
        return F.lit(True)
    space = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in C.WHITESPACE) + "]"
    word = rf"(?:[!-~]++|{space.replace('[', '[^', 1)})"  # printable ASCII first: the class of all other characters is slow
    return F.rlike(text, F.lit(rf"^{space}*+(?:{word}++{space}++){{{n - 1}}}{word}"))


def content_tokens(
    cleaned: Column,
    min_length: int = C.MIN_TOKEN_LENGTH,
    stopwords: Iterable[str] | None = None,
) -> Column:
    """Words of cleaned text without stopwords and short words, tested on the surface form."""
    stop = sorted(set(C.ENGLISH_STOPWORDS + C.DOMAIN_STOPWORDS if stopwords is None else stopwords))
    whole = [a + b for a, b in C.CONTRACTIONS]
    words = F.split(_replace(cleaned, whole, _CONTRACTION, _CONTRACTION_HEADS), " ")
    return _filter_words(words, f"length(w) >= {int(min_length)}" + (f" AND w NOT IN {_listed(stop)}" if stop else ""))


def _listed(words: Iterable[str]) -> str:
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return "(" + ", ".join(f"'{w}'" for w in quoted) + ")"


def _filter_words(words: Column, condition: str) -> Column:
    """Array filter with its condition on `w` as SQL: long word lists parse at once and become a hash set."""
    return F.call_function("filter", words, F.expr(f"w -> {condition}"))


def words_of(cleaned: Column) -> Column:
    """Array of the words in a space-joined text; the empty text has none."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def _ngrams(words: Column, n: int) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)]))


def vector_terms(words: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """Terms for vectorising: n-grams over the words of two or more characters."""
    low, high = ngram_range

    def every_size(kept: Column) -> Column:
        sizes = [kept if n == 1 else _ngrams(kept, n) for n in range(low, high + 1)]
        return sizes[0] if len(sizes) == 1 else F.concat(*sizes)

    return bind(F.filter(words, lambda w: F.length(w) >= 2), every_size)


def recognised_words(words: Column, vocabulary: Iterable[str]) -> Column:
    """Distinct words that the vocabulary holds, in the order they first appear."""
    known = [w for w in vocabulary if " " not in w]
    if not known:
        return F.array().cast("array<string>")
    return F.array_distinct(_filter_words(words, f"w IN {_listed(known)}"))


def _masked(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<![{_WORD}]){C.MASKED_RUN}(?![{_WORD}])", C.REDACTED)


def _single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(text), " {2,}", " "))


def readable(text: Column) -> Column:
    """Masked details become a marker and braced amounts lose their braces."""
    return _single_spaced(F.regexp_replace(_masked(text), C.BRACED_AMOUNT, "$1"))


def shorten(text: Column, limit: int, suffix: str) -> Column:
    """At most `limit` characters, cut back to a word boundary and marked with `suffix`."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(suffix)))


def sheet_example(text: Column, limit: int = C.SHEET_CHARS) -> Column:
    """A narrative as raters see it: masks replaced, shortened, amounts left as they are."""
    return shorten(_single_spaced(_masked(text)), limit, " ...")


def quote(text: Column, limit: int = C.QUOTE_CHARS) -> Column:
    """A narrative as quoted on a report page."""
    return shorten(readable(text), limit, " …")


def duration(seconds: Column) -> Column:
    """Seconds as m:ss, rounded half to even; null counts as zero."""
    whole = F.bround(F.coalesce(seconds.cast("double"), F.lit(0.0)), 0).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)
