"""Classes of similar items from buckets of candidates, without all pairs of a bucket.

In each bucket every member is compared with one leader: the member whose buckets are the
fullest, which in a group of edited copies is one that was edited little, so that most of the
group links to it. Buckets whose members are then of one component are settled. Where the caller
names a small number ``few``, a bucket of one pair is settled too, and the members of other buckets up
to that size are all compared with each other. The members of the others are joined exactly, by what a pair of Jaccard similarity ``least`` must share:

- elements are ordered from rare to frequent, the same way for all sets; two such sets share
  an element among the first ``n - ceil(least * n) + 1`` of each, and among the first
  ``n - ceil(2 * least / (1 + least) * n) + 1`` of the smaller one;
- elements of one set only can't be shared, and a set with too many of them has no partner;
- from a shared element on, both sets must have enough elements left.

Only pairs of two components meet, and pairs within the component that is the most frequent
one of an element are not even looked at. No bound on partners or candidates is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.density import components
from themeloom.operators.joins import lookup
from themeloom.session import materialise, materialise_counted

_SLACK = 1e-9  # of products that should be whole numbers


def shared_buckets(places: DataFrame) -> tuple[DataFrame, int]:
    """``(key, id, n)`` of the keys that ``n > 1`` ids have, and the rows; ``places`` holds each once."""
    keys = places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return materialise_counted(places.join(keys, "key"), "buckets")


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _labelled(members: DataFrame, labels: DataFrame | None, name: str, label: str) -> DataFrame:
    """Add the component of column ``name``: the id itself where no link holds it yet.

    A plain join, whose skewed side Spark splits at run time; a sketch of heavy keys would
    evaluate the pairs twice.
    """
    if labels is None:
        return members.withColumn(label, F.col(name))
    known = labels.select(F.col("id").alias(name), F.col("label").alias("_label"))
    return members.join(known, [name], "left").withColumn(label, F.coalesce("_label", name)).drop("_label")


def leader_pairs(buckets: DataFrame, rows: int) -> DataFrame:
    """``(a, b)``: each member of a bucket with the member whose buckets are the fullest."""
    score = buckets.groupBy("id").agg(F.sum("n").alias("score"))
    top = buckets.join(score, "id").groupBy("key").agg(F.max(F.struct("score", "id")).alias("top"))
    met = lookup(buckets, top.select("key", F.col("top.id").alias("leader")), ["key"], "id", rows)
    return _ordered(met.filter("id <> leader"), "id", "leader")


def _at_least(share: float, n: Column) -> Column:
    return F.ceil(F.lit(share) * n - _SLACK)


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``(id, label, n, pos, e)``: the elements by which a set of ``sets(id, label, bag)`` can meet a partner.

    ``n`` is the size of the set and ``pos`` the place of ``e`` in it, rare elements first.
    """
    elements = sets.select("id", "label", F.size("bag").alias("n"), F.explode("bag").alias("e"))
    shared = elements.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    common = elements.join(shared, "e").groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    needed = _at_least(least, F.col("n"))
    able = common.filter(F.size("es") >= needed).withColumn("own", F.col("n") - F.size("es"))
    first = F.slice("es", 1, (F.col("n") - needed + 1 - F.col("own")).cast("int"))
    return able.select("id", "label", "n", "own", F.posexplode(first).alias("at", "el")).select(
        "id", "label", "n", (F.col("own") + F.col("at")).alias("pos"), F.col("el.e").alias("e")
    )


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of two labels: all pairs of ``sets(id, label, bag)`` that can be ``least`` similar."""
    found = materialise(prefixes(sets, least), "prefixes")
    kinds = found.groupBy("e", "label").agg(F.count("*").alias("n_label"))
    mixed = kinds.groupBy("e").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("n_label", "label")).alias("main"))
    rows = materialise(found.join(mixed.filter("low < high").select("e", "main"), "e"), "mixed-prefixes")
    both = 2 * least / (1 + least)
    small = rows.filter(F.col("pos") <= F.col("n") - _at_least(both, F.col("n")))

    def meet(some: DataFrame, others: DataFrame) -> DataFrame:
        x = some.select("e", *[F.col(c).alias(f"{c}_x") for c in ("id", "label", "n", "pos")])
        y = others.select("e", *[F.col(c).alias(f"{c}_y") for c in ("id", "label", "n", "pos")])
        left = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
        able = (F.col("n_x") <= F.col("n_y")) & (F.col("n_x") >= _at_least(least, F.col("n_y")))
        able &= left >= _at_least(both / 2, F.col("n_x") + F.col("n_y"))
        return x.join(y, "e").filter((F.col("label_x") != F.col("label_y")) & able).select("id_x", "id_y")

    main = F.col("label") == F.col("main")
    pairs = meet(small, rows.filter(~main)).union(meet(small.filter(~main), rows.filter(main)))
    return _ordered(pairs, "id_x", "id_y")


def _pairs_of_few(named: DataFrame) -> DataFrame:
    """``(a, b)`` of two labels in a bucket of ``named(key, id, label)``; a bucket has few members."""
    other = named.select("key", F.col("id").alias("other"), F.col("label").alias("other_label"))
    return _ordered(named.join(other, "key").filter((F.col("id") < F.col("other")) & (F.col("label") != F.col("other_label"))), "id", "other")


def linked_components(buckets: DataFrame, rows: int, bags: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float, few: int = 0) -> DataFrame | None:
    """``(id, label)`` of all ids that have a link; None where there is no link.

    ``buckets`` and ``rows`` come from ``shared_buckets``, ``bags(id, bag)`` holds the set of
    each of its ids, and ``verify`` takes distinct pairs ``(a, b)`` and gives ``(a, b, sim)``.
    With ``few``, a small number, the pairs of buckets of at most so many members are formed as they are.
    """

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        return materialise_counted(verify(pairs).filter(F.col("sim") >= least).select("a", "b"), "links")

    links, n = linked(leader_pairs(buckets, rows))
    labels = components(links) if n else None
    named = materialise(_labelled(buckets.select("key", "id"), labels, "id", "label"), "named", rows)
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high")
    members = named.join(mixed.filter(F.col("n") > few).select("key"), "key", "left_semi").select("id", "label").distinct()
    sets, n_sets = materialise_counted(bags.join(members, "id").select("id", "label", "bag"), "sets")
    undecided = [prefix_pairs(sets, least)] if n_sets else []
    if few > 2:
        undecided.append(_pairs_of_few(named.join(mixed.filter(F.col("n").between(3, few)).select("key"), "key")))
    if not undecided:
        return labels
    more, n_more = linked(reduce(DataFrame.union, undecided).distinct())
    if not n_more:
        return labels
    if labels is None:
        return components(more)
    between = _labelled(_labelled(more, labels, "a", "_a"), labels, "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    joint = materialise(components(between), "joint", 2 * n_more)
    moved = joint.select(F.col("id").alias("label"), F.col("label").alias("_now"))
    kept = lookup(labels, moved, ["label"], "id", 2 * n).select("id", F.coalesce("_now", "label").alias("label"))
    added = joint.join(labels.select("id"), "id", "left_anti")  # ids that had no link before
    return materialise(kept.unionByName(added), "labels")
