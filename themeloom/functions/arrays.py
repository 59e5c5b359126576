"""Column helpers that keep work inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_DIGITS = 9  # scores are ranked by their value at this many digits, ties by key
OUTPUT_DIGITS = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bag_of_words(tokens: Column) -> Column:
    """``array<struct<term, n>>`` of an array of tokens, in term order.

    A document lies in one row, so its counts need no shuffle: sort the tokens and measure
    the length of each run.
    """

    def runs(words: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, i: F.struct(
                    F.get(words, at).alias("term"),
                    (F.coalesce(F.get(s, i + 1), F.size(words)) - at).cast("bigint").alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,n:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(empty)


def rank_key(score: Column) -> Column:
    return F.round(score, RANK_DIGITS)


def shown(score: Column) -> Column:
    return F.round(score, OUTPUT_DIGITS)
