"""Transcripts: turns, review windows, neighbours, paragraphs, proposals and speakers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions import text as T
from corpusloom.functions.order import folded

#: fixed values: characters of a window, words that a boundary may move, and the limits of a spelling
WINDOW_CHARS, BOUNDARY_WORDS, SPELLING_CHARS, SPELLING_WORDS = 24_000, 12, 40, 3


def timed(turns: DataFrame, key: str, order: str, text: str, ms_per_word: int = 400) -> DataFrame:
    """turns with n_words, start_ms and end_ms: each word takes the same time and turns follow one another."""
    n = turns.withColumn("n_words", F.size(T.split_words(F.col(text))))
    upto = F.sum("n_words").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return n.withColumn("end_ms", (upto * ms_per_word).cast("long")).withColumn("start_ms", (F.col("end_ms") - F.col("n_words") * ms_per_word).cast("long"))


def heading(start_ms: Column, end_ms: Column, who: Column) -> Column:
    return F.concat(T.clock(start_ms), F.lit(" --> "), T.clock(end_ms), F.lit(" · "), who)


def windows(turns: DataFrame, key: str, order: str, size: str, limit: int = WINDOW_CHARS) -> DataFrame:
    """key, order, window (from 1): turns in order fill a window until the next would pass the limit.

    A turn over the limit has a window of its own; one without a size has none.
    """

    def step(state: tuple[int, int], s: int | None) -> tuple[tuple[int, int], int]:
        filled, w = state
        s = s or 0
        return ((s, w + 1), w + 1) if filled and filled + s > limit else ((filled + s, w), w)

    return folded(turns, key, order, size, lambda: (0, 1), step, "window", "int")


def neighbours(turns: DataFrame, keys: list[str], order: str, who: str) -> DataFrame:
    """turns with previous and next speaker within the same keys (a window of review)."""
    w = W.partitionBy(*keys).orderBy(order)
    return turns.withColumn("previous", F.lag(who).over(w)).withColumn("next", F.lead(who).over(w))


def paragraphs(text: Column, breaks: Column) -> Column:
    """A long turn's sentences with a blank line before those numbered in breaks (2 and up); other turns as they are."""
    found = T.sentences(text)
    parts = F.transform(found, lambda s, i: F.concat(F.when(i == 0, "").when(F.array_contains(breaks, (i + 1).cast("int")), "\n\n").otherwise(" "), s))
    return F.when(T.is_long(text), F.array_join(parts, "")).otherwise(text)


def boundary_refused(words_moved: Column, n_words: Column, speaker: Column, neighbour: Column) -> Column:
    """Why a proposal to move words to a neighbour is refused; null if it isn't."""
    return F.when((words_moved < 1) | (words_moved > F.least(F.lit(BOUNDARY_WORDS), n_words - 1)), "too-many-words").when(neighbour.isNull(), "no-neighbour").when(neighbour == speaker, "same-speaker")


def spelling_refused(written: Column, proposed: Column, text: Column) -> Column:
    """Why a spelling is refused: not in the turn, too long, too many words, or with characters that tables use."""
    return F.when(~text.contains(written), "not-in-turn").when(F.length(proposed) > SPELLING_CHARS, "too-long").when(F.size(T.split_words(proposed)) > SPELLING_WORDS, "too-many-words").when(proposed.rlike(r"[|`\n{}]"), "characters")


@F.arrow_udf(DoubleType())
def _ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two short texts, which no built-in function gives; null if either is."""
    return _ratio(a, b)


def speakers(turns: DataFrame, keys: list[str], who: str) -> DataFrame:
    """keys, who: turns, words, seconds and first start, from ``timed`` turns."""
    return turns.groupBy(*keys, who).agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 3).alias("seconds"), F.min("start_ms").alias("first_start"))
