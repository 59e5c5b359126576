"""Scores for topics and for pairs of labelings, search and distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.arrays import rank_key
from themeloom.session import materialise


def _pair_counts(terms: DataFrame, top: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents per top word, and documents per pair of top words of one topic.

    Only top words leave the scan. Pairs are formed inside one document and topic, so their
    number is bounded by the length of the word list, not by the data.
    """
    hits = terms.join(top.select("topic", "rank", "term"), "term").select(key, "topic", "rank")
    hits = materialise(hits, "hits")
    single = hits.groupBy("topic", "rank").agg(F.count("*").alias("d"))
    listed = hits.groupBy(key, "topic").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    pairs = F.flatten(
        F.transform(
            "ranks",
            lambda a: F.transform(F.filter("ranks", lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j"))),
        )
    )
    both = (
        listed.filter(F.size("ranks") > 1)
        .select("topic", F.inline(pairs))
        .groupBy("topic", "i", "j")
        .agg(F.count("*").alias("d_both"))
    )
    return single, both


def _scored_pairs(top: DataFrame, single: DataFrame, both: DataFrame) -> DataFrame:
    """Every pair of words of a topic with its counts, 0 for a pair never seen together."""
    words = top.select("topic", "rank").join(single, ["topic", "rank"], "left").select(
        "topic", "rank", F.coalesce("d", F.lit(0)).alias("d")
    )
    a = words.select("topic", F.col("rank").alias("i"), F.col("d").alias("d_i"))
    b = words.select("topic", F.col("rank").alias("j"), F.col("d").alias("d_j"))
    return (
        a.join(b, "topic")
        .filter(F.col("i") < F.col("j"))
        .join(both, ["topic", "i", "j"], "left")
        .withColumn("d_both", F.coalesce("d_both", F.lit(0)))
    )


def coherence_umass(terms: DataFrame, top: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(topic, coherence)``: sum over pairs of ``ln((D(i, j) + 1) / D(i))``, i ranked higher.

    A pair whose higher word occurs in no document has no value and is left out.
    """
    top = materialise(top, "top")
    scored = _scored_pairs(top, *_pair_counts(terms, top, key))
    return scored.groupBy("topic").agg(
        F.sum(F.when(F.col("d_i") > 0, F.log((F.col("d_both") + 1) / F.col("d_i")))).alias("coherence")
    )


def coherence_npmi(terms: DataFrame, top: DataFrame, n_docs: int | Column, key: str = "doc_id") -> DataFrame:
    """``(topic, coherence)``: mean normalised pointwise mutual information over documents."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    both = F.col("d_both") / n
    alone = (F.col("d_i") / n) * (F.col("d_j") / n)
    npmi = (
        F.when(F.col("d_both") == 0, -1.0)
        .when(F.col("d_both") == n, 1.0)
        .otherwise(F.log(both / alone) / -F.log(both))
    )
    top = materialise(top, "top")
    scored = _scored_pairs(top, *_pair_counts(terms, top, key))
    return scored.groupBy("topic").agg(F.avg(npmi).alias("coherence"))


def topic_diversity(top: DataFrame) -> DataFrame:
    """``(n_words, n_distinct, diversity)``: distinct words among the top words of all topics."""
    words = top.groupBy("term").agg(F.count("*").alias("n"))
    return words.agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct")).withColumn(
        "diversity", F.col("n_distinct") / F.col("n_words")
    )


def contingency(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)``: rows per pair of labels."""
    return labelled.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, purity, nmi)`` of two labelings, from their contingency table."""
    table = contingency(labelled, a, b)
    n_a = F.sum("n").over(Window.partitionBy("a"))
    n_b = F.sum("n").over(Window.partitionBy("b"))
    total = table.agg(F.sum("n")).scalar()
    cells = table.withColumn("n_a", n_a).withColumn("n_b", n_b).withColumn("total", total)
    n, all_a, all_b, whole = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total"))
    per_a = cells.groupBy("a").agg(
        F.max("n").alias("majority"),
        F.sum(n / whole * F.log(n * whole / (all_a * all_b))).alias("information"),
        F.sum(-n / whole * F.log(all_a / whole)).alias("entropy_a"),
        F.sum(-n / whole * F.log(all_b / whole)).alias("entropy_b"),
        F.sum("n").alias("n"),
    )
    sums = per_a.agg(
        F.sum("n").alias("n"),
        (F.sum("majority") / F.sum("n")).alias("purity"),
        F.sum("information").alias("information"),
        ((F.sum("entropy_a") + F.sum("entropy_b")) / 2).alias("entropy"),
    )
    nmi = F.when(F.col("entropy") == 0, 1.0).otherwise(F.col("information") / F.col("entropy"))
    return sums.select("n", "purity", nmi.alias("nmi"))


def search(terms: DataFrame, query: DataFrame, n_docs: Column, k: int = 20, key: str = "doc_id") -> DataFrame:
    """The ``k`` documents that match the words of ``query(term)`` best, by summed TF-IDF.

    Only matching rows leave the scan; ``(rank, key, score, n_matched)``.
    """
    hits = materialise(terms.join(query.select("term").distinct(), "term"), "hits")
    frequency = hits.groupBy("term").agg(F.count("*").alias("_df"))
    weight = (1 + F.log(F.col("n").cast("double"))) * F.log(n_docs / F.col("_df"))
    found = (
        hits.join(frequency, "term")
        .groupBy(key)
        .agg(F.sum(weight).alias("score"), F.count("*").alias("n_matched"))
        .withColumn("_key", rank_key(F.col("score")))
    )
    top = found.orderBy(F.desc("_key"), key).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("_key"), key)).alias("rank")
    return top.select(rank, key, "score", "n_matched")


def best_documents(assigned: DataFrame, topic, k: int = 20, key: str = "doc_id") -> DataFrame:
    """The ``k`` documents of one topic with the highest score."""
    members = assigned.filter(F.col("topic") == F.lit(topic)).withColumn("_key", rank_key(F.col("score")))
    return members.orderBy(F.desc("_key"), key).limit(k).select(key, "topic", "score")


def topic_trend(assigned: DataFrame, axis: str) -> DataFrame:
    """``(axis, topic, n, share)``: how the documents of each axis value fall on topics."""
    counts = assigned.groupBy(axis, "topic").agg(F.count("*").alias("n"))
    in_axis = F.sum("n").over(Window.partitionBy(axis))
    return counts.select(axis, "topic", "n", (F.col("n") / in_axis).alias("share"))
