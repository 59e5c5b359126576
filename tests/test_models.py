"""Fitted models: shapes, sums, numbering and repeatability."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import cleaning, lda
from themeloom.plans import models
from themeloom.session import materialise, scratch_folder


@pytest.fixture(scope="module")
def docs(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    tokens = cleaning.without_stopwords(cleaning.with_tokens(table), "english", "spanish", "french", "german")
    empty = spark.createDataFrame([(10_000, [])], "doc_id bigint, tokens array<string>")
    return materialise(tokens.select("doc_id", "tokens").unionByName(empty), "tokens")


def check(model, docs, n_words):
    n = docs.count()
    assigned = model.assigned.collect()
    assert len(assigned) == n == len({r["doc_id"] for r in assigned})
    topics = sorted({r["topic"] for r in assigned} - {-1})
    described = {r["topic"] for r in model.top.select("topic").distinct().collect()}
    assert set(topics) <= described
    per_topic = model.top.groupBy("topic").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()
    assert all(r["n"] == r["m"] <= n_words for r in per_topic)
    return {r["doc_id"]: r["topic"] for r in assigned}


def test_clustered_topics(docs):
    model = models.clustered_topics(docs)
    topics = check(model, docs, 10)
    assert topics[10_000] == -1
    sizes = [r["n"] for r in model.sizes().filter("topic >= 0").orderBy("topic").collect()]
    assert sizes == sorted(sizes, reverse=True) and min(sizes) >= 2
    assert sorted(set(topics.values())) == list(range(-1, len(sizes)))
    info = model.info().collect()
    assert sum(r["n"] for r in info) == docs.count()
    assert model.listing().count() == len(sizes)
    report = model.report(docs.select("doc_id"))
    assert report.count() == docs.count() and set(report.columns) == {"doc_id", "topic", "score", "keywords"}
    again = {r["doc_id"]: r["topic"] for r in models.clustered_topics(docs).assigned.collect()}
    assert again == topics


def test_joint_embedding_topics(docs):
    model = models.joint_embedding_topics(docs)
    topics = check(model, docs, 50)
    assert topics[10_000] == -1
    assert all(t >= 0 for d, t in topics.items() if d != 10_000)
    scores = model.assigned.agg(F.min("score").alias("a"), F.max("score").alias("b")).head()
    assert -1.0 <= scores["a"] <= scores["b"] <= 1.0 + 1e-9
    assert model.words(0, 5).count() == 5
    assert model.wordcloud().filter("weight > 1.000001").isEmpty()


def test_own_embedding_column_is_used(spark, docs):
    given = docs.withColumn("embedding", F.array(F.lit(1.0), (F.col("doc_id") % 2) * 5.0, F.lit(0.5)))
    model = models.joint_embedding_topics(given, words=spark.createDataFrame([("x", [1.0, 0.0, 0.0])], "term string, embedding array<double>"), components=2)
    rows = model.assigned.collect()
    assert len({r["topic"] for r in rows if r["doc_id"] % 2}) == 1
    assert len({r["topic"] for r in rows}) == 2


def test_transport_topics(docs):
    model = models.transport_topics(docs)
    n = docs.filter(F.size(F.filter("tokens", lambda w: F.length(w) > 1)) > 0).count()
    assert model.doc_topic.count() == 3 * docs.count()  # a document without words has equal shares
    topics = check(model, docs, 15)
    assert topics[10_000] == -1 and sum(t >= 0 for t in topics.values()) == n
    assert model.chart(10).count() == 30
    assert model.keywords(15, " ").count() == 3


def test_lda(docs):
    fitted = lda.fit_lda(docs, k=4, iterations=5, max_vocab=2_000)
    assert fitted.topic_term.count() == 4 * 2_000
    for table, by in ((fitted.topic_term, "topic"), (fitted.doc_topic, "doc_id")):
        sums = [r["s"] for r in table.groupBy(by).agg(F.sum("weight").alias("s")).collect()]
        assert sums == pytest.approx([1.0] * len(sums), abs=1e-6)
    again = lda.fit_lda(docs, k=4, iterations=5, max_vocab=2_000)
    a = {(r["topic"], r["term"]): r["weight"] for r in fitted.topic_term.collect()}
    b = {(r["topic"], r["term"]): r["weight"] for r in again.topic_term.collect()}
    assert a == pytest.approx(b, rel=1e-6)


def planted(spark, seed=3, n=150, k=3, start=0):
    """Documents of two topics each; topics have words of their own and share some."""
    rng = random.Random(seed)
    words = [[f"t{t}w{i}" for i in range(30)] for t in range(k)]
    rows = []
    for d in range(n):
        main = d % k
        rows.append((start + d, [rng.choice(words[main if rng.random() < 0.9 else rng.randrange(k)]) for _ in range(40)] + ["common"] * 3))
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")


@pytest.mark.parametrize("pairs", [lda.WORDS_PER_BLOCK, 500])
def test_lda_finds_planted_topics(spark, monkeypatch, pairs):
    monkeypatch.setattr(lda, "WORDS_PER_BLOCK", pairs)
    monkeypatch.setattr(lda, "CELLS", 600)
    fitted = lda.fit_lda(planted(spark), k=3, iterations=12)
    best = {r["doc_id"]: max(range(3), key=lambda t: r["shares"][t]) for r in fitted.shares.collect()}
    pairs = {(d % 3, t) for d, t in best.items()}
    assert len(pairs) == 3 and len({t for _, t in pairs}) == 3
    unseen = planted(spark, seed=9, n=30, start=1_000)
    more = lda.perplexity(fitted, unseen).head()
    assert more["n_words"] == sum(sum(i % 2 for i in range(len(r["tokens"]))) for r in unseen.collect())
    less = lda.perplexity(lda.fit_lda(planted(spark), k=3, iterations=1), unseen).head()
    assert more["log_perplexity"] < less["log_perplexity"] - 0.3
    done = {r["doc_id"]: r["n_words"] for r in lda.completion(fitted, unseen.unionByName(spark.createDataFrame([(5, ["unknown"] * 4), (6, []), (7, None)], unseen.schema))).collect()}
    assert done[5] == done[6] == done[7] == 0 and len(done) == 33


def test_lda_looks_at_documents_topic_by_topic():
    """A row for each topic and all looks in one call, as counted word by word."""
    rng = np.random.default_rng(4)
    k, sizes, alpha = 3, np.array([2, 1, 4], "i4"), 0.1
    places, counts = rng.integers(0, 5, 7), rng.integers(1, 4, 7).astype("f8")
    words, start = rng.random((k, 5)), np.full((k, 3), 1.0 / k)
    dealt, weights = lda._topics_of(places, counts, sizes, start, words, alpha, 2)
    owner, expected = np.repeat(np.arange(3), sizes), start.T
    for _ in range(2):
        shares = [[expected[d][t] * words[t][w] for t in range(k)] for d, w in zip(owner, places)]
        numbers = [[n * x / sum(row) for x in row] for n, row in zip(counts, shares)]
        sums = [[alpha + sum(numbers[i][t] for i in range(7) if owner[i] == d) for t in range(k)] for d in range(3)]
        expected = [[x / sum(row) for x in row] for row in sums]
    assert np.allclose(dealt.T, numbers, rtol=1e-12) and np.allclose(weights.T, expected, rtol=1e-12)


def test_lda_of_nothing(spark):
    fitted = lda.fit_lda(spark.createDataFrame([(1, []), (2, None)], "doc_id bigint, tokens array<string>"), k=2, iterations=2)
    assert fitted.topic_term.count() == 0
    assert [(r["shares"], r["known"]) for r in fitted.shares.collect()] == [([0.5, 0.5], False)] * 2


def test_lda_keeps_nothing_on_the_driver(docs, monkeypatch):
    """One row of totals at a time comes back, however many words and documents there are."""
    rows, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: rows.append(collect(self)) or rows[-1])
    lda.fit_lda(docs, k=4, iterations=1)
    assert rows and all(len(found) == 1 and len(found[0]) <= 4 for found in rows)


def test_lda_keeps_no_round_on_disk(spark):
    """What the rounds wrote, and the blocks, are gone when the fit is done; several blocks took part."""
    before = set(os.listdir(scratch_folder(spark)))
    fitted = lda.fit_lda(planted(spark), k=3, iterations=2)
    left = {name.rpartition("-")[0] for name in set(os.listdir(scratch_folder(spark))) - before}
    assert left == {"lda-docs", "lda-vocabulary", "lda-words", "lda-shares"}
    assert fitted.shares.count() == 150


def test_lda_model(docs):
    model = models.lda_topics(docs, k=4, iterations=3, max_vocab=1_000)
    assert model.keywords(5).count() == 4
    topics = check(model, docs, 50)
    assert topics[10_000] == -1 and set(topics.values()) == {-1, 0, 1, 2, 3}


def test_one_topic_takes_all_known_documents(docs):
    topics = check(models.lda_topics(docs, k=1, iterations=1), docs, 50)
    assert topics.pop(10_000) == -1 and set(topics.values()) == {0}
