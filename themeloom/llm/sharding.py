"""Sharding by a Feistel permutation of the row numbers.

Rows are numbered 0 … n-1 in the order of their ids. A Feistel network over Z_a x Z_b, with a
and b about the square root of n, permutes 0 … ab-1; a value of n or more is sent through the
network again until it falls below n (cycle walking), which makes a permutation of 0 … n-1.
Position p goes to shard ``p mod shards`` at slot ``p div shards``, so shards differ by one
row at most, and both numbers can be computed for any row number, and back, without a table.

Nulls: a null id is numbered first, a null text is empty. Rows that are equal in id, size and
checksum are numbered in any order among themselves, which gives the same rows. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.arrays import let
from themeloom.llm.common import documents, fresh, full_text, utf8_crc32, with_row_ids
from themeloom.session import dense_ids

ROUNDS = 6
WALK = 8  # passes through the network in one expression; the rest is walked in further ones
SEED = 20_240


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(seed: int, i: Column, half: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def network(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of ``x`` through the Feistel network over at least ``n`` values."""
    a, b = _sides(n)

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (s["l"] + _mix(seed, i, s["r"])) % a).otherwise(s["l"])
        right = F.when(i % 2 == 1, (s["r"] + _mix(seed, i, s["l"])) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = let(x, lambda v: F.struct(F.floor(v / b).cast("bigint").alias("l"), (v % b).alias("r")))
    if 2**53 <= n:
        start = let(x, lambda v: F.struct(((v - v % b) / b).cast("bigint").alias("l"), (v % b).alias("r")))
    order = F.array(*[F.lit(i) for i in range(rounds)])
    return F.aggregate(order, start, step, lambda s: s["l"] * b + s["r"])


def permuted(numbered: DataFrame, row: str, name: str, n: int, seed: int = SEED) -> DataFrame:
    """Add ``name``: the place of row number ``row`` in the permutation of 0 … n-1."""
    again = F.array(*[F.lit(i) for i in range(WALK)])

    def walked(x: Column) -> Column:
        return F.aggregate(again, x, lambda v, _: F.when(v < n, v).otherwise(network(v, n, seed)))

    out = numbered.withColumn(name, walked(network(F.col(row), n, seed)))
    while out.filter(F.col(name) >= n).limit(1).count():
        out = out.withColumn(name, walked(F.col(name)))
    return out


def place_of(row: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The same for one row number, without Spark."""
    a, b = _sides(n)
    x = row
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            digest = lambda half, i=i: int(hashlib.md5(f"{seed}:{i}:{half}".encode()).hexdigest()[:8], 16)
            if i % 2 == 0:
                left = (left + digest(right)) % a
            else:
                right = (right + digest(left)) % b
        x = left * b + right
        if x < n:
            return x


def row_of(place: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The row number at a place: the network run backwards."""
    a, b = _sides(n)
    x = place
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(rounds)):
            digest = lambda half, i=i: int(hashlib.md5(f"{seed}:{i}:{half}".encode()).hexdigest()[:8], 16)
            if i % 2 == 0:
                left = (left - digest(right)) % a
            else:
                right = (right - digest(left)) % b
        x = left * b + right
        if x < n:
            return x


def shard(df: DataFrame, order: list[str], shards: int = 8, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; row numbers follow the columns ``order``.

    ``order`` should identify a row. Columns of these names in ``df`` are replaced.
    """
    df = df.drop("shard", "slot")
    row, place = fresh(df, "_row"), fresh(df, "_place")
    numbered = dense_ids(df, [F.col(c) for c in order], row)
    out = permuted(numbered, row, place, numbered.count(), seed)
    return out.select(
        *df.columns,
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col(place) / shards).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """All columns of ``docs(doc_id, text, …)`` with ``shard`` and ``slot``.

    Only ids and checksums are sorted and numbered; the text stays beside its row number.
    """
    docs = docs.drop("shard", "slot")
    rid = fresh(docs, "_rid")
    stored = with_row_ids(docs, rid)
    text = full_text("text")
    narrow = stored.select("doc_id", utf8_crc32(text).alias("crc"), F.col(rid).alias("rid"))
    placed = shard(narrow, ["doc_id", "crc", "rid"], shards, seed).select(F.col("rid").alias(rid), "shard", "slot")
    return stored.join(placed.hint("merge"), rid).select(*docs.columns, "shard", "slot")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents over shards 0 to 7; only ids, sizes and checksums are moved."""
    text = full_text("text")
    narrow = documents(spark, folder).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), utf8_crc32(text).alias("text_crc32")
    )
    return shard(narrow, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
