"""Reports over long tables, shared by all four families of model.

``topic_term(topic, term, score)`` and ``doc_topic(doc_id, topic, weight)`` are all they
need. Ranks follow the score at nine digits, then the term or the lower topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.arrays import rank_key
from themeloom.operators.assign import best_share
from themeloom.operators.joins import small_lookup

OUTLIER = -1


def top_terms(topic_term: DataFrame, n: int, score: str = "score") -> DataFrame:
    """``(topic, rank, term, score)``: the ``n`` best terms of each topic, rank from 1.

    Each task keeps its own ``n`` best per topic before the shuffle, so a topic with a third
    of all terms is no heavier than any other.
    """
    best_first = Window.partitionBy("topic").orderBy(rank_key(F.col(score)).desc(), "term")
    return (
        topic_term.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= n)
        .select("topic", "rank", "term", score)
    )


def keywords(top: DataFrame, n: int, separator: str = ", ") -> DataFrame:
    """``(topic, keywords)``: the first ``n`` terms of each topic as one string."""
    return keyword_lists(top, n).select("topic", F.array_join("terms", separator).alias("keywords"))


def keyword_lists(top: DataFrame, n: int) -> DataFrame:
    """``(topic, terms)``: the first ``n`` terms of each topic as an array."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return (
        top.filter(F.col("rank") <= n)
        .groupBy("topic")
        .agg(listed.alias("_listed"))
        .select("topic", F.col("_listed.term").alias("terms"))
    )


def words_of_topic(topic_term: DataFrame, topic, n: int = 5, score: str = "score") -> DataFrame:
    """The ``n`` best terms of one topic."""
    return top_terms(topic_term.filter(F.col("topic") == F.lit(topic)), n, score)


def wordcloud_weights(top: DataFrame, score: str = "score") -> DataFrame:
    """The data of a word cloud: each score relative to the best one of its topic."""
    best = F.max(score).over(Window.partitionBy("topic"))
    return top.select("topic", "term", score, (F.col(score) / best).alias("weight"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    """``(topic, n)``: documents per topic, the largest first."""
    return assigned.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")


def topic_count(assigned: DataFrame) -> DataFrame:
    """``(n_topics, n_without_outliers)``: distinct topics, with and without -1."""
    labels = assigned.groupBy("topic").count()
    return labels.agg(
        F.count("topic").alias("n_topics"),
        F.count(F.when(F.col("topic") != OUTLIER, 1)).alias("n_without_outliers"),
    )


def dominant_topic(doc_topic: DataFrame, key: str = "doc_id", label: str = "Tema ") -> DataFrame:
    """``(key, topic, weight, dominant)``: the heaviest topic of each document, lowest on a tie.

    The label counts topics from 1.
    """
    ranked = F.struct(rank_key(F.col("weight")), -F.col("topic"), F.struct("topic", "weight").alias("best"))
    return (
        doc_topic.groupBy(key)
        .agg(F.max(ranked).alias("_top"))
        .select(key, "_top.best.topic", "_top.best.weight")
        .withColumn("dominant", F.concat(F.lit(label), (F.col("topic") + 1).cast("string")))
    )


def dominant_share(docs: DataFrame, ids: list[int], key: str = "doc_id", shares: str = "shares", label: str = "Tema ") -> DataFrame:
    """``dominant_topic`` for rows that hold all their shares, in the order of ``ids``: nothing is shuffled.

    A row without shares is kept as an outlier, with no weight and no label.
    """
    best = docs.select(key, best_share(ids, F.col(shares)).alias("_best"))
    topic = F.col("_best.topic")
    return best.select(
        key,
        F.coalesce(topic, F.lit(OUTLIER)).alias("topic"),
        F.col("_best.confidence").alias("weight"),
        F.concat(F.lit(label), (topic + 1).cast("string")).alias("dominant"),
    )


def wide_shares(docs: DataFrame, k: int, key: str = "doc_id", shares: str = "shares", label: str = "Tema ") -> DataFrame:
    """``wide_weights`` for rows that hold all their shares as an array: nothing is shuffled."""
    names = [f"{label}{i + 1}" for i in range(k)]
    out = docs.select(key, *[F.coalesce(F.get(shares, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    return out.withColumn(f"{label}dominante", _first_largest(names))


def wide_weights(doc_topic: DataFrame, k: int, key: str = "doc_id", label: str = "Tema ") -> DataFrame:
    """One column per topic (``Tema 1`` … ``Tema k``) and the dominant one."""
    wide = doc_topic.groupBy(key).pivot("topic", list(range(k))).agg(F.first("weight"))
    names = [f"{label}{i + 1}" for i in range(k)]
    out = wide.select(key, *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    return out.withColumn(f"{label}dominante", _first_largest(names))


def _first_largest(names: list[str]) -> Column:
    """The name of the first of the columns that holds the largest value."""
    if len(names) == 1:
        return F.lit(names[0])
    largest = F.greatest(*[rank_key(F.col(f"`{n}`")) for n in names])
    return F.coalesce(*[F.when(rank_key(F.col(f"`{n}`")) == largest, F.lit(n)) for n in names])


def topic_info(assigned: DataFrame, top: DataFrame, key: str = "doc_id", score: str = "score", samples: int = 3) -> DataFrame:
    """One row per topic, outliers too: size, name, keywords and the best-scored documents.

    The name is the topic number and its first four terms.
    """
    best_first = Window.partitionBy("topic").orderBy(rank_key(F.col(score)).desc(), key)
    picked = (
        assigned.select("topic", key, score)
        .withColumn("_at", F.row_number().over(best_first))
        .filter(F.col("_at") <= samples)
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("_at", key))).alias("_docs"))
        .select("topic", F.col(f"_docs.{key}").alias("sample_docs"))
    )
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    described = sizes.join(picked, "topic").join(keyword_lists(top, 10), "topic", "left")
    return described.select(
        "topic",
        "n",
        F.concat_ws("_", F.col("topic").cast("string"), F.slice("terms", 1, 4)).alias("name"),
        F.col("terms").alias("keywords"),
        "sample_docs",
    )


def topic_listing(assigned: DataFrame, top: DataFrame, n: int = 8) -> DataFrame:
    """``(topic, n, keywords)`` of every topic but the outliers."""
    sizes = assigned.filter(F.col("topic") != OUTLIER).groupBy("topic").agg(F.count("*").alias("n"))
    return sizes.join(keywords(top, n), "topic", "left")


def with_keywords(assigned: DataFrame, top: DataFrame, n: int, separator: str = ", ", key: str = "doc_id") -> DataFrame:
    """Each document with the keywords of its topic; outliers are looked up like any other."""
    return small_lookup(assigned, keywords(top, n, separator), ["topic"], key, "keywords")
