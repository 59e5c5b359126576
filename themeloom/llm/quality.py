"""Quality classifier: naive Bayes support vectors.

Features are words and word pairs, hashed, each counted once a document. Their log-count
ratios between the classes come from all labelled training rows. Each indicator is scaled by
its ratio, and a linear hinge-loss model is fitted to a bounded sample of those rows by dual
coordinate descent; its weights are drawn towards their mean size. Margins are turned into
probabilities by a logistic curve fitted to other training rows.

The bound is ``SAMPLE`` distinct texts a class for the fit and half as many for the curve, those
with the smallest hashes; each weighs as much as it has rows in the class. Where labels hold one class only or none, the score is the share of good
rows (0.5 where there is none).

Null and empty texts hold no feature and get the score of the model's constant. Rows with a
null label are not learnt from; a document with several labels is learnt from each. Very long
texts are scored whole. Repeated rows are scored alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, full_text, in_fold
from themeloom.llm.features import class_counts, ngrams, sigmoid
from themeloom.session import materialise

BITS = 18
SAMPLE = 3_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
BLEND = 0.25  # share of the fitted weights; the rest is their mean size
KEEP = 0.7
FOLDS, HELD_OUT = 4, 2


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``(text, y, mix, digest)`` of the labelled rows; ``mix`` is a hash of the text for sampling.

    Both hashes are made before the join, so that whoever needs only them moves no text.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    text = full_text("text")
    hashed = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)).alias("mix"), _digest("text").alias("digest")
    )
    return hashed.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "y", "mix", "digest")


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model by dual coordinate descent.

    Row i is ``ratio`` at the places ``rows[i]``, at unit length, followed by a constant 1.
    """
    weights, constant = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = [_unit(ratio[held]) for held in rows]
    square = np.array([float(v @ v) for v in values]) + 1.0
    order = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(weights[rows[i]] @ values[i]) + constant) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[rows[i]] += step * values[i]
                constant += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, constant


def _unit(values: np.ndarray) -> np.ndarray:
    length = np.sqrt(float(values @ values))
    return values / length if length else values


class Model:
    """``score(text)``; weights are 2**BITS numbers, whatever the corpus."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, constant: float, slope: float, shift: float):
        self.ratio, self.weights, self.constant, self.slope, self.shift = ratio, weights, constant, slope, shift

    def margin(self, text: str) -> float:
        held = ngrams(text, BITS)
        return float(self.weights[held] @ _unit(self.ratio[held])) + self.constant

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.slope * self.margin(text or "") + self.shift))


def _curve(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, on softened labels."""
    n1, n0 = weight @ good, weight @ (1 - good)
    goal = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (goal - p)) - 1e-6 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def sampled(rows: DataFrame, texts: DataFrame, wanted: int) -> DataFrame:
    """``(text, mix, n0, n1, in0, in1)``: of each class the ``wanted`` distinct texts with the smallest hashes.

    ``texts(digest, mix, n0, n1)`` are the distinct texts with their labelled rows of each class, and
    ``rows(text)`` any rows that hold these texts; ``in0`` and ``in1`` say for which class a text was drawn.
    """
    picked = [texts.filter(F.col(f"n{y}") > 0).orderBy("mix", "digest").limit(wanted).withColumn("of", F.lit(y)) for y in (0, 1)]
    chosen = picked[0].union(picked[1]).groupBy("digest", "mix", "n0", "n1").agg(*[F.max((F.col("of") == y).cast("int")).alias(f"in{y}") for y in (0, 1)])
    chosen = materialise(chosen, "sample", 2 * wanted)
    # Copies of a text are joined in their task first, so only one a task is moved.
    found = rows.select("text", _digest("text").alias("digest")).join(F.broadcast(chosen), "digest")
    return found.groupBy("digest", "mix", "n0", "n1", "in0", "in1").agg(F.first("text").alias("text")).drop("digest")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(digest, mix, n0, n1)``: the distinct texts of ``rows(text, y, mix)`` with their rows of each class."""
    counts = [F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)]
    digest = F.col("digest") if "digest" in rows.columns else _digest("text")
    return materialise(rows.groupBy(digest.alias("digest"), "mix").agg(*counts), "texts")


def fit(rows: DataFrame, docs: DataFrame | None = None) -> Model:
    """A model of ``rows(text, y, mix)``; the texts of its sample are read from ``docs(text)`` if given.

    Labelled texts are moved once, to be counted by class.
    """
    texts = distinct_texts(rows)
    size = texts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).head()
    n0, n1 = size["n0"] or 0, size["n1"] or 0
    zeros = np.zeros(1 << BITS)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(zeros, zeros, 0.0, 0.0, float(np.log(share / (1 - share))))
    good, bad = class_counts(rows.withColumn("weight", F.col("y").cast("double")), BITS, ngrams)
    good, bad = good + SMOOTHING, bad + SMOOTHING
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    wanted = int(1.5 * SAMPLE)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [ngrams(t, BITS).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("mix", "n0", "n1", "in0", "in1")), pa.array(features, pa.binary())], ["mix", "n0", "n1", "in0", "in1", "held"])

    source = rows if docs is None else docs.select(full_text("text").alias("text"))
    chosen = sampled(source, texts, wanted).mapInArrow(held, "mix bigint, n0 bigint, n1 bigint, in0 int, in1 int, held binary")
    got = sorted(chosen.collect(), key=lambda r: (r["mix"], r["held"]))  # 2 * wanted rows at most
    parts = {y: [(np.frombuffer(r["held"], "<i4"), r[f"n{y}"], y) for r in got if r[f"in{y}"]] for y in (0, 1)}
    cut = {y: max(1, (2 * len(parts[y])) // 3) for y in (0, 1)}
    train = [row for y in (0, 1) for row in parts[y][: cut[y]]]
    check = [row for y in (0, 1) for row in (parts[y][cut[y] :] or parts[y])]
    y = np.array([1.0 if label else -1.0 for *_, label in train])
    rows_of = np.array([float(n) for _, n, _ in train])
    cost = COST * len(y) / 2 * rows_of / np.where(y > 0, rows_of[y > 0].sum(), rows_of[y < 0].sum())
    weights, constant = descend([h for h, _, _ in train], y, ratio, cost)
    weights = (1 - BLEND) * np.abs(weights).mean() * np.sign(weights) + BLEND * weights if weights.any() else weights
    model = Model(ratio, weights, constant, 1.0, 0.0)
    margin = np.array([float(weights[h] @ _unit(ratio[h])) + constant for h, _, _ in check])
    truth, share = np.array([label for *_, label in check], float), np.array([n for _, n, _ in check], float)
    # Each class weighs as it does among all labelled rows.
    model.slope, model.shift = _curve(margin, truth, share)
    seen = np.average(truth, weights=share)
    seen = seen if 0 < seen < 1 else 0.5
    model.shift += float(np.log(n1 / n0) - np.log(seen / (1 - seen)))
    return model


def scored(model: Model, spark: SparkSession):
    """A column function that scores a text column with the broadcast model (4 MB)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for some in texts:
            yield some.map(lambda t: model.score(t) if t is not None else model.score(""))

    return score


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled(docs.filter(~in_fold("doc_id", FOLDS, HELD_OUT)), labels, "quality")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; the same columns."""
    score: Column = scored(fit(training_rows(docs, labels), docs), docs.sparkSession)(F.col("text"))
    return docs.filter(score >= least)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")), docs)
    score = scored(model, spark)(F.col("text"))
    return docs.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= KEEP).cast("int")
    )
