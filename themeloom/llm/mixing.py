"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words; a document's expected copies are target over source size.
The whole part is taken as it is. The fractions of a source's documents are paired: words are
moved at random from one to the other, so that expectations hold and the sum of words stays
exactly the same, until one of the two is 0 or 1. Blocks of documents are worked through side
by side; each leaves one document undecided, and these are paired again, block by block, up a
tree until one per source is left, whose last fraction is drawn. A source's taken words
therefore miss its target by less than one document, and that a short one where there are short
ones: documents of like length are paired, long before short, and one that only much shorter
ones are left for is drawn at once, the words it takes too many or too few being shared out over
all of these, in proportion to what each can bear. Expectations and sums hold in this step too.

Nulls: a null source is a source of its own, ranked last; a null text has no words. Documents
without words take none. Repeated rows are documents of their own. An empty table gives an
empty table. The result depends on the rows only, not on their order or partitions; but rows
of an id that stands in more than ``REPEATS`` rows are dealt to blocks by their row numbers, so
that no block holds them all.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, fresh, full_text, with_row_ids
from themeloom.operators.joins import lookup, small_lookup
from themeloom.session import dense_ids, materialise, materialise_counted

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5  # of all words
CAP = 2.0  # copies at most
BLOCK = 2_048  # documents paired in one task step
REPEATS = 128  # rows of one id from which on they are dealt to blocks by their numbers too
BRANCH = 64  # blocks that meet in one block of the next level
LONGER = 2  # times the next document's length from which on a document isn't paired with it
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"

_FLAT = "rid bigint, doc_id bigint, source string, block bigint, size bigint, source_size bigint, target double, copies bigint, part double"


def words(text: str | Column) -> Column:
    return F.regexp_count(full_text(text), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, docs, source_size, target)`` from ``(source, size)``.

    Targets share ``share`` of all words by weight; one that would exceed ``cap`` times its
    source stops there and the excess is shared again by weight, until none exceeds. Each
    round is one aggregate over the table of sources, and each but the last fills a source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = dense_ids(per, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = materialise(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap), "sources")
    first = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).head()
    total = (first["size"] or 0) * share
    level, full = (total / first["weight"] if first["weight"] else 0.0), -1
    while True:
        over = F.col("most") <= F.col("weight") * level
        now = table.agg(
            F.count(F.when(over, 1)).alias("full"),
            F.sum(F.when(over, F.col("most"))).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).head()
        if now["full"] == full or not now["weight"]:
            break
        full, level = now["full"], (total - (now["held"] or 0.0)) / now["weight"]
    target = F.least("most", F.col("weight") * level)
    return table.select("source", "docs", "source_size", target.alias("target"))


def _paired(rows: pd.DataFrame, level: int, seed: int, last: bool) -> pd.DataFrame:
    """Round the fractions of one block; all but one row end with ``part`` 0."""
    rows = rows.sort_values(["size", "doc_id", "rid"], ascending=[False, True, True], kind="stable", na_position="first")
    head = rows.iloc[0]
    draw = random.Random(f"{seed}/{head['source']}/{level}/{head['block']}").random
    size, part = rows["size"].tolist(), rows["part"].tolist()
    more = [0] * len(part)
    held = -1
    for j in range(len(part)):
        if held >= 0 and 0.0 < part[j] < 1.0 and size[held] > LONGER * size[j] > 0:
            settled = _shared_out(size, part, j, part[held], size[held], draw)
            if settled is not None:
                more[held], part[held], held = settled, 0.0, -1
        p = part[j]
        if not 0.0 < p < 1.0 or size[j] == 0:
            more[j], part[j] = (1 if p >= 1.0 else 0), 0.0
            continue
        if held < 0:
            held = j
            continue
        i, ratio = held, size[held] / size[j]
        up, down = min(1.0 - part[i], p / ratio), min(part[i], (1.0 - p) / ratio)
        if draw() * (up + down) < down:
            ends = (up == 1.0 - part[i], up == p / ratio)
            x, y = (1.0 if ends[0] else part[i] + up), (0.0 if ends[1] else p - up * ratio)
        else:
            ends = (down == part[i], down == (1.0 - p) / ratio)
            x, y = (0.0 if ends[0] else part[i] - down), (1.0 if ends[1] else p + down * ratio)
        part[i], part[j], held = x, y, -1
        for k in (i, j):
            if part[k] <= 0.0 or part[k] >= 1.0:
                more[k], part[k] = int(part[k] >= 1.0), 0.0
            else:
                held = k
    if last and held >= 0:
        more[held], part[held] = int(draw() < part[held]), 0.0
    return rows.assign(copies=rows["copies"] + more, part=part)


def _shared_out(size: list[int], part: list[float], begin: int, chance: float, whole: int, draw) -> int | None:
    """Draw whether a document of ``whole`` words is taken (1, with ``chance``) or not (0), and let the rows
    from ``begin`` on make up for it; None, and nothing done, where they can bear neither."""
    lengths, parts = np.array(size[begin:], float), np.array(part[begin:], float)
    bears = np.where((lengths > 0) & (parts > 0) & (parts < 1), parts * (1 - parts), 0.0)
    room = float(lengths @ bears)
    inside = parts[bears > 0]
    if not len(inside):
        return None
    less, more = whole * (1 - chance), whole * chance  # words that the others lose, or gain
    possible = [more * inside.max() <= room, less * (1 - inside.min()) <= room]  # not taken, taken
    if not any(possible):
        return None
    taken = int(draw() < chance) if all(possible) else int(possible[1])
    moved = parts + (-less if taken else more) * bears / room
    part[begin:] = np.where(bears > 0, np.clip(moved, 0.0, 1.0), parts).tolist()
    return taken


def _step(level: int, seed: int, last: bool):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        return _paired(rows, level, seed, last)

    return block


def rounded(shares: DataFrame, deepest: int, seed: int = SEED) -> DataFrame:
    """Whole copies for rows with ``copies`` and a fraction ``part``; sums of words per source stay.

    ``deepest`` is the largest number of blocks in a source.
    """
    settled, waiting, level = [], shares, 0
    while True:
        last = deepest <= 1

        step = _step(level, seed, last)
        done = materialise(waiting.groupBy("source", "block").applyInPandas(step, _FLAT), f"rounded{level}")
        settled.append(done.filter(F.col("part") == 0))
        if last:
            break
        waiting = done.filter(F.col("part") > 0).withColumn("block", F.floor(F.col("block") / BRANCH).cast("bigint"))
        deepest, level = -(-deepest // BRANCH), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``(rid, doc_id, size, source_size, target, copies, taken)`` from ``(rid, doc_id, source, size)``."""
    sized, rows = materialise_counted(sized.select("rid", "doc_id", "source", "size").withColumn("_place", F.xxhash64("doc_id", F.lit(seed))), "sized")
    goal = targets(sized, weights, share, cap)
    named = lambda df: df.withColumns({"_name": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    blocks = F.ceil(F.col("docs") / BLOCK).cast("bigint")
    goal = materialise(named(goal).withColumn("blocks", blocks), "targets").drop("source")
    deepest = goal.agg(F.max("blocks").alias("most")).head()["most"] or 1
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    repeated, n_repeated = materialise_counted(sized.groupBy("_place").agg(F.count("*").alias("n")).filter(F.col("n") > REPEATS).select("_place", F.lit(True).alias("_often")), "repeated")
    if n_repeated:
        dealt = F.when(F.col("_often"), F.xxhash64("_place", "rid")).otherwise(F.col("_place"))
        sized = lookup(sized, repeated, ["_place"], "rid", rows).withColumn("_place", dealt).drop("_often")
    shares = (
        small_lookup(named(sized), goal, ["_name", "_none"], "rid", "goal")
        .withColumn("x", expected)
        .select(
            "rid",
            "doc_id",
            "source",
            F.pmod(F.col("_place"), F.col("blocks")).alias("block"),
            "size",
            "source_size",
            "target",
            F.floor("x").cast("bigint").alias("copies"),
            (F.col("x") - F.floor("x")).alias("part"),
        )
    )
    out = rounded(shares, deepest, seed)
    return out.select("rid", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the same columns.

    ``docs`` has ``doc_id``, ``source`` and ``text``.
    """
    rid = fresh(docs, "_rid")
    stored = with_row_ids(docs, rid)
    sized = stored.select(F.col(rid).alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), words("text").alias("size"))
    copies = mix(sized, **options).filter("copies > 0").select(F.col("rid").alias(rid), F.col("copies").alias(fresh(docs, "_copies")))
    count = copies.columns[1]
    again = F.explode(F.array_repeat(F.lit(0), F.col(count).cast("int"))).alias(fresh(docs, "_again"))
    return stored.join(copies.hint("merge"), rid).select(*docs.columns, again).select(*docs.columns)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", words("text").alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")
