"""Topics by entropic optimal transport between documents and topic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as v
from themeloom.operators.assign import MAX_DRIVER_CELLS, long_weights, on_driver
from themeloom.session import materialise


@dataclass
class TransportResult:
    topics: DataFrame  # topic, vector
    doc_topic: DataFrame  # doc_id, topic, weight: shares of a document, summing to 1
    weights: np.ndarray  # share of the corpus each topic was asked to take
    shares: DataFrame  # doc_id, shares in topic order, known: whether the document has a vector


def _plan_rows(x: np.ndarray, topics: np.ndarray, scale: np.ndarray, epsilon: float) -> np.ndarray:
    """Row-normalised transport plan: ``exp(-|x - c|^2 / epsilon) * scale``, summing to 1."""
    squared = (x * x).sum(axis=1, keepdims=True) + (topics * topics).sum(axis=1) - 2.0 * x @ topics.T
    logit = np.log(scale) - squared / epsilon
    plan = np.exp(logit - logit.max(axis=1, keepdims=True))
    return plan / plan.sum(axis=1, keepdims=True)


def _one_pass(vectors: DataFrame, topics: np.ndarray, scale: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Mass and weighted vector sum of each topic: one job, K x (dim + 1) numbers come back.

    Every task adds up its own documents before anything is shuffled.
    """
    rows_of = _plan_rows
    k, dim = topics.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, dim + 1))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].to_numpy())
                plan = rows_of(x, topics, scale, epsilon)
                sums[:, 0] += plan.sum(axis=0)
                sums[:, 1:] += plan.T @ x
        at = np.indices(sums.shape)
        yield pd.DataFrame({"topic": at[0].ravel(), "at": at[1].ravel(), "value": sums.ravel()})

    added = (
        vectors.select("embedding")
        .mapInPandas(partial, "topic int, at int, value double")
        .groupBy("topic", "at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sums = np.zeros((k, dim + 1))
    for row in added:
        sums[row["topic"], row["at"]] = row["value"]
    return sums[:, 0], sums[:, 1:]


def _start(vectors: DataFrame, k: int, key: str) -> np.ndarray:
    """``k`` different documents, first in the order of a hash of their key."""
    # Copies count once, however many there are, so k rows are all that is brought in.
    order = F.struct(F.xxhash64(key).alias("hash"), F.col(key).alias("key"), "embedding")
    distinct = vectors.groupBy(F.xxhash64("embedding")).agg(F.min(order).alias("one"))
    rows = [tuple(r["one"]["embedding"]) for r in distinct.orderBy("one.hash", "one.key").limit(k).collect()]
    if len(rows) < k:
        raise ValueError(f"fewer than {k} different documents found for {k} topics")
    return np.array(rows[:k])


def fit_transport(
    docs: DataFrame,
    k: int = 3,
    epsilon: float = 0.2,
    rounds: int = 12,
    balance_rounds: int = 6,
    weights: list[float] | None = None,
    key: str = "doc_id",
    embedding: str = "embedding",
) -> TransportResult:
    """``k`` topic vectors such that moving all documents onto them costs least.

    Alternates scaling (rows exactly, columns towards ``weights``, uniform by default) with
    moving each topic to the weighted mean of its documents. Only topic vectors and column
    scales are on the driver; each round is one pass over the stored vectors. A document
    without a vector takes no part and gets all topics in equal shares.
    """
    every = materialise(docs.select(key, v.unit(F.col(embedding)).alias("embedding")), "vectors")
    vectors = every.filter(F.col("embedding").isNotNull())
    n = vectors.count()
    share = np.full(k, 1.0 / k) if weights is None else np.asarray(weights, dtype="f8") / np.sum(weights)
    topics = _start(vectors, k, key)
    if topics.size > MAX_DRIVER_CELLS:
        raise ValueError("topics x dim exceed the driver")
    scale = np.ones(k)
    for i in range(rounds + balance_rounds):
        mass, sums = _one_pass(vectors, topics, scale, epsilon)
        scale = scale * share * n / np.maximum(mass, 1e-300)
        scale = scale / scale.sum()
        if i < rounds:
            topics = sums / np.maximum(mass, 1e-300)[:, None]
    return _result(every, topics, scale, epsilon, share, key)


def _result(vectors: DataFrame, topics: np.ndarray, scale: np.ndarray, epsilon: float, share: np.ndarray, key: str) -> TransportResult:
    rows_of = _plan_rows
    k = len(topics)

    def plan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = rows_of(np.stack(batch.to_numpy()), topics, scale, epsilon) if len(batch) else []
            yield pd.Series(list(rows), index=batch.index)

    moved = F.pandas_udf(plan, "array<double>").asNondeterministic()(F.col("embedding"))
    known = vectors.filter(F.col("embedding").isNotNull()).select(key, moved.alias("shares"), F.lit(True).alias("known"))
    equal = F.array_repeat(F.lit(1.0 / k), k).alias("shares")
    unknown = vectors.filter(F.col("embedding").isNull()).select(key, equal, F.lit(False).alias("known"))
    shares = known.unionByName(unknown)
    spark = vectors.sparkSession
    table = spark.createDataFrame(
        [(i, [float(x) for x in topics[i]]) for i in range(k)], "topic int, vector array<double>"
    )
    return TransportResult(table, long_weights(shares, list(range(k)), key), share, shares)


def word_shares(words: DataFrame, topics: DataFrame, temperature: float = 0.5, embedding: str = "embedding") -> DataFrame:
    """``(topic, term, weight)``: softmax over the words of ``-|c - w|^2 / temperature``.

    Weights sum to 1 per topic; the totals are added up by task before the shuffle.
    """
    held = on_driver(topics)
    if held is None:
        raise ValueError("too many topics for one distribution over all words each")
    ids, matrix = held
    apart = words.select("term", v.squared_distances(F.col(embedding), matrix).alias("shares"))
    near = long_weights(apart, ids, "term").select(
        "topic", "term", F.exp(-F.col("weight") / F.lit(temperature)).alias("near")
    )
    # One row per topic, of topics that fit the driver: words stay where they are.
    totals = F.broadcast(near.groupBy("topic").agg(F.sum("near").alias("total")))
    return near.join(totals, "topic").select("topic", "term", (F.col("near") / F.col("total")).alias("weight"))
