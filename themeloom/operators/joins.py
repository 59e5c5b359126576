"""A lookup that keeps its balance when a third of the rows share one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import materialise_counted

SALTS = 16
HOT_KEYS = 32  # keys looked after; a key below the 32nd in size is no burden to one task
TRACKED = 1_000  # keys the sketch keeps while it looks for them
PLAIN_ROWS = 2_000_000  # a join of so few rows needs no care
BROADCAST_ROWS = 50_000  # rows of a stored, counted table that may go to every task


def lookup(left: DataFrame, right: DataFrame, on: list[str], row_key: str, rows: int | None = None) -> DataFrame:
    """Left join to a table that holds each key once, e.g. a label per group.

    ``rows`` is the number of rows of ``left`` if the caller knows it; few rows are joined as
    they are. Otherwise a frequent-items sketch over ``left`` finds the heaviest keys: their
    rows are dealt to ``SALTS`` tasks by ``row_key``, and only their entries in ``right`` are
    copied. Which keys the sketch names changes the balance, never the result.
    """
    if rows is not None and rows <= PLAIN_ROWS:
        return left.join(right, on, "left")
    key = F.xxhash64(*on)
    sketch = F.expr(f"transform(approx_top_k(_key, {HOT_KEYS}, {TRACKED}), x -> x.item)")
    hot = left.select(key.alias("_key")).agg(sketch.alias("hot")).scalar()
    dealt = F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int")
    salted = left.withColumn("_salt", F.when(F.array_contains(hot, key), dealt).otherwise(0))
    copies = F.when(F.array_contains(hot, key), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_salt", F.explode(copies))
    return salted.join(copied, [*on, "_salt"], "left").drop("_salt")


def small_lookup(left: DataFrame, right: DataFrame, on: list[str], row_key: str, name: str) -> DataFrame:
    """``lookup`` of a table expected to be small, such as one row per topic.

    The table is stored and counted first: up to ``BROADCAST_ROWS`` rows it is broadcast and
    ``left`` stays in place, beyond that the rows of ``left`` are dealt out as in ``lookup``.
    """
    stored, rows = materialise_counted(right, name)
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(stored), on, "left")
    return lookup(left, stored, on, row_key)
