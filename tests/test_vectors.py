import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.functions import vectors as v
from themeloom.operators import assign, embedding as em, represent, transport

RNG = np.random.default_rng(7)
POINTS = RNG.normal(size=(60, 8))


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, i % 4, [float(x) for x in p]) for i, p in enumerate(POINTS)] + [(60, 0, None), (61, 1, [0.0] * 8)]
    return spark.createDataFrame(rows, "doc_id bigint, topic int, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def topics(spark):
    rows = [(10 + i, [float(x) for x in c]) for i, c in enumerate(POINTS[:6])]
    return spark.createDataFrame(rows, "topic int, vector array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_unit(points):
    found = {r["doc_id"]: r["u"] for r in points.select("doc_id", v.unit(F.col("embedding")).alias("u")).collect()}
    assert found[60] is None and found[61] is None
    assert np.allclose([found[i] for i in range(60)], unit(POINTS))


def test_float_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],)], "e array<float>")
    assert rows.select(v.unit(F.col("e")).alias("u")).head()["u"] == pytest.approx([0.6, 0.8])


def test_centroids(points):
    found = {r["topic"]: r["vector"] for r in assign.topic_centroids(points.filter("doc_id < 60")).collect()}
    for topic in range(4):
        assert np.allclose(found[topic], POINTS[topic::4].mean(axis=0))


def nearest_by_hand():
    scores = unit(POINTS) @ unit(POINTS[:6]).T
    return {i: (10 + int(s.argmax()), s.max()) for i, s in enumerate(scores)}


@pytest.mark.parametrize("max_cells", [assign.MAX_DRIVER_CELLS, 16])
def test_nearest_topic_on_driver_and_in_blocks(points, topics, monkeypatch, max_cells):
    monkeypatch.setattr(assign, "TOPICS_PER_BLOCK", 2)
    found = {r["doc_id"]: (r["topic"], r["score"]) for r in assign.nearest_topic(points, topics, max_cells=max_cells).collect()}
    assert len(found) == 62 and found[60] == (-1, 0.0)
    for doc, (topic, score) in nearest_by_hand().items():
        assert found[doc] == (topic, pytest.approx(score))


def test_nearest_tie_takes_the_lowest(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, embedding array<double>")
    topics = spark.createDataFrame([(7, [2.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])], "topic int, vector array<double>")
    assert assign.nearest_topic(docs, topics).head()["topic"] == 3
    assert assign.nearest_topic(docs, topics, max_cells=2).head()["topic"] == 3


def test_no_topics(points, topics):
    assert assign.nearest_topic(points, topics.limit(0)).filter("topic <> -1").isEmpty()


def test_more_topics_than_one_slice(points, topics, monkeypatch):
    monkeypatch.setattr(v, "_CELLS", 6)
    found = {r["doc_id"]: r["topic"] for r in assign.nearest_topic(points, topics).collect()}
    assert all(found[d] == t for d, (t, _) in nearest_by_hand().items())


def test_rows_are_not_repeated_for_blocks_of_topics(spark, monkeypatch):
    """Topics pass by held rows in several batches; both ways to find the nearest agree, ties included."""
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, size=(60, 4)).astype(float)
    topics = spark.createDataFrame([(i, [float(x) for x in vectors[(i * 7) % 50]]) for i in range(60)], "topic int, vector array<double>")
    rows = [(f"d{i}", [float(x) for x in rng.integers(-2, 3, size=4)]) for i in range(80)] + [("none", None), ("zero", [0.0] * 4)]
    docs = spark.createDataFrame(rows, "name string, embedding array<double>").repartition(3)
    expected = {r["name"]: r for r in assign.nearest_topic(docs, topics, "name").collect()}

    def refused(*_):
        raise AssertionError("every row meets every block in a shuffle")

    monkeypatch.setattr(assign, "_scores_in_blocks", refused)
    monkeypatch.setattr(assign, "MAX_TASK_CELLS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = assign.nearest_topic(docs, topics, "name", max_cells=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for r in found:
        assert r["topic"] == expected[r["name"]]["topic"] and r["score"] == pytest.approx(expected[r["name"]]["score"])
    assert {r["topic"] for r in found if r["name"] in ("none", "zero")} == {-1}


@pytest.mark.parametrize("max_cells", [assign.MAX_DRIVER_CELLS, 16])
def test_word_scores(points, topics, monkeypatch, max_cells):
    monkeypatch.setattr(assign, "TOPICS_PER_BLOCK", 2)
    words = points.filter("doc_id < 60").select(F.col("doc_id").cast("string").alias("term"), "embedding")
    found = {(r["term"], r["topic"]): r["score"] for r in assign.word_scores(words, topics, max_cells=max_cells).collect()}
    scores = unit(POINTS) @ unit(POINTS[:6]).T
    assert found == {(str(i), 10 + k): pytest.approx(scores[i, k]) for i in range(60) for k in range(6)}


def test_softmax(points, topics):
    docs, ids = assign.topic_shares(points.filter("doc_id < 60"), topics, 0.7)
    assert ids == list(range(10, 16))
    found = {r["doc_id"]: r["shares"] for r in docs.collect()}
    squared = ((POINTS[:, None] - POINTS[None, :6]) ** 2).sum(axis=2)
    expected = np.exp(-squared / 0.7)
    expected /= expected.sum(axis=1, keepdims=True)
    assert np.allclose([found[i] for i in range(60)], expected)
    best = docs.select("doc_id", assign.best_share(ids, F.col("shares")).alias("b")).collect()
    assert {r["doc_id"]: r["b"]["topic"] for r in best} == {i: 10 + int(e.argmax()) for i, e in enumerate(expected)}
    long = assign.long_weights(docs, ids).groupBy("doc_id").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    assert all(r["n"] == 6 and r["s"] == pytest.approx(1.0) for r in long.collect())


def sign_vector(word, dim):
    bits = "".join(f"{byte:08b}" for byte in hashlib.md5(word.encode()).digest())[:dim]
    return np.array([1.0 if b == "1" else -1.0 for b in bits])


@pytest.mark.parametrize("dim", [64, 100])
def test_hashed_embedding(spark, monkeypatch, dim):
    monkeypatch.setattr(v, "_CELLS", 3 * dim)
    texts = ["gato gato perro", "", "sol", "año ñandú sol luna mar cielo", "a", "gato perro gato"]
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id bigint, tokens array<string>")
    found = {r["doc_id"]: r["embedding"] for r in em.hashed_embedding(docs.coalesce(1), dim).collect()}
    for i, text in enumerate(texts):
        words = [w for w in text.split() if len(w) > 1]
        if not words:
            assert found[i] is None
            continue
        expected = sum((1 + math.log(words.count(w))) * sign_vector(w, dim) for w in set(words))
        assert np.allclose(found[i], unit(expected))


def test_learned_words(spark):
    texts = ["gato gato perro", "", "sol", "gato luna sol cielo", "a", "perro luna", "sol"]
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id bigint, tokens array<string>")
    hashed = em.hashed_embedding(docs, length="length")
    expected, seen = {}, {}
    for text in texts:
        words = [w for w in text.split() if len(w) > 1]
        weight = {w: 1 + math.log(words.count(w)) for w in words}
        total = sum((weight[w] * sign_vector(w, 64) for w in weight), np.zeros(64))
        for w in weight:
            others = (total - weight[w] * sign_vector(w, 64)) / np.linalg.norm(total)
            expected[w] = expected.get(w, 0) + weight[w] * others
            seen[w] = seen.get(w, 0) + words.count(w)
    found = {r["term"]: r for r in em.learned_words(hashed, length="length").collect()}
    assert {w: r["n"] for w, r in found.items()} == seen
    assert all(np.allclose(found[w]["embedding"], unit(expected[w])) for w in seen)
    assert {r["term"] for r in em.learned_words(hashed, 2, length="length").collect()} == {w for w, n in seen.items() if n > 1}
    alone = em.hashed_embedding(docs.filter("doc_id in (1, 2, 6)"), length="length")
    assert em.learned_words(alone, length="length").count() == 0  # a word that never has company


def test_document_vector_hashes_a_word_once(spark):
    """However many documents of a batch hold a word; nulls, empty lists and short words are none."""
    lists = pa.array([["sol", "luna", "sol", "a", None], [], None, ["sol"] * 3, ["luna", "sol"]], pa.list_(pa.string()))
    words, word, owner = v.words_of(lists, 2)
    assert words.to_pylist() == ["luna", "sol"] and word.tolist() == [1, 0, 1, 1, 1, 1, 0, 1] and owner.tolist() == [0, 0, 0, 3, 3, 3, 4, 4]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lists.to_pylist())], "doc_id int, tokens array<string>")
    found = {r["doc_id"]: r["embedding"] for r in em.hashed_embedding(docs).collect()}
    assert found[1] is None and found[2] is None
    assert np.allclose(found[0], unit(sign_vector("luna", 64) + (1 + math.log(2)) * sign_vector("sol", 64)))
    assert np.allclose(found[3], unit(sign_vector("sol", 64)))


def test_learned_words_in_pieces(spark, monkeypatch):
    """Words are added up in each task before they move: copies of a document send no further rows."""
    texts = ["gato gato perro sol", "perro luna sol", "luna gato"] * 20
    docs = em.hashed_embedding(spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id bigint, tokens array<string>"), length="length")
    whole = {r["term"]: (r["n"], r["embedding"]) for r in em.learned_words(docs, length="length").collect()}
    one = pa.Table.from_pylist([{"tokens": r["tokens"], "x": r["embedding"], "length": r["length"]} for r in docs.collect()])
    assert em._company(one, 64).num_rows == 4
    monkeypatch.setattr(em, "TOKENS_AT_ONCE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pieces = {r["term"]: (r["n"], r["embedding"]) for r in em.learned_words(docs, length="length").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(whole) == set(pieces) == {"gato", "perro", "sol", "luna"}
    assert all(whole[w][0] == pieces[w][0] and np.allclose(whole[w][1], pieces[w][1]) for w in whole)


def test_learned_words_of_given_vectors(spark):
    docs = spark.createDataFrame(
        [(["ab", "cd"], [1.0, 0.0, 0.0]), (["cd", "cd"], [0.0, 2.0, 0.0]), (["ef"], None)],
        "tokens array<string>, embedding array<double>",
    )
    found = {r["term"]: r["embedding"] for r in em.learned_words(docs).collect()}
    assert np.allclose(found["ab"], [1, 0, 0]) and np.allclose(found["cd"], unit([1, 2 * (1 + math.log(2)), 0]))
    assert set(found) == {"ab", "cd"}


def test_top_words_of_separate_vocabularies(spark):
    """Every word of a topic occurs in a document of that topic."""
    rng = random.Random(8)
    words = {t: [f"w{t}{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] for t in range(4)}
    rows = [(i, i % 4, [rng.choice(words[i % 4]) for _ in range(30)]) for i in range(400)]
    docs = em.hashed_embedding(spark.createDataFrame(rows, "doc_id int, topic int, tokens array<string>"), length="length")
    scores = assign.word_scores(em.learned_words(docs, length="length"), assign.topic_centroids(docs))
    top = represent.top_terms(scores, 50).collect()
    assert len(top) == 200 and all(r["term"] in words[r["topic"]] for r in top)
    shares = transport.word_shares(em.learned_words(docs, length="length"), assign.topic_centroids(docs))
    assert all(r["term"] in words[r["topic"]] for r in represent.top_terms(shares, 15, "weight").collect())


@pytest.mark.parametrize("cells", [assign.MAX_DRIVER_CELLS, 0])
def test_zero_vector_has_no_topic(spark, cells):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, None)], "doc_id int, embedding array<double>")
    topics = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 1.0])], "topic int, vector array<double>")
    found = {r["doc_id"]: (r["topic"], round(r["score"], 6)) for r in assign.nearest_topic(docs, topics, max_cells=cells).collect()}
    assert found == {1: (-1, 0.0), 2: (1, 0.995037), 3: (-1, 0.0)}


def test_hash_dim_is_checked():
    with pytest.raises(ValueError):
        v.check_hash_dim(129)


def test_plugged_in_encoder(spark):
    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id bigint, text string")
    found = em.encoded(docs, make).filter("embedding is not null")
    assert {r["doc_id"]: r["embedding"] for r in found.collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_pca_keeps_rows_and_orders_components(points):
    found = em.reduced(points, 3).collect()
    assert len(found) == 62
    kept = np.array([r["reduced"] for r in found if r["reduced"] is not None])
    assert kept.shape == (60, 3)
    spread = kept.var(axis=0)
    assert spread[0] >= spread[1] >= spread[2] > 0
    centred = unit(POINTS) - unit(POINTS).mean(axis=0)
    assert spread.sum() == pytest.approx((np.linalg.svd(centred)[1][:3] ** 2).sum() / 60)


def test_pca_without_vectors(points):
    assert em.reduced(points.filter("doc_id = 60")).head()["reduced"] is None


def test_word2vec(spark):
    rows = [(i, ["gato", "perro", "sol", f"raro{i}"]) for i in range(20)] + [(20, [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    with_vectors, words = em.word2vec(docs, dim=4, partitions=1)
    assert {r["term"] for r in words.collect()} == {"gato", "perro", "sol"}
    found = {r["doc_id"]: r["embedding"] for r in with_vectors.collect()}
    assert found[20] is None and np.linalg.norm(found[0]) == pytest.approx(1.0)


@pytest.mark.parametrize("passes", [1, 2])
def test_word2vec_beyond_the_driver(spark, monkeypatch, passes):
    monkeypatch.setattr(em, "MAX_DRIVER_WEIGHTS", 0)
    rng, rows = np.random.default_rng(1), []
    for i in range(600):  # two languages that share no word
        rows.append((i, [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 20, 60)] + [f"rare{i}"], "x"))
    rows += [(600, [], "x"), (601, None, "x"), (602, ["rare602", None], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, embedding string")
    with_vectors, words = em.word2vec(docs, dim=16, passes=passes, partitions=3)
    assert with_vectors.columns == ["doc_id", "tokens", "embedding"]
    found = {r["doc_id"]: (r["tokens"], r["embedding"]) for r in with_vectors.collect()}
    assert len(found) == 603 and [found[i][0] for i in range(603)] == [r[1] for r in rows]
    assert all(found[i][1] is None for i in (600, 601, 602))
    of = {r["term"]: np.array(r["embedding"]) for r in words.collect()}
    assert set(of) == {f"{side}{k}" for side in "ab" for k in range(20)}
    near = lambda p, q: np.mean([of[f"{p}{i}"] @ of[f"{q}{j}"] for i in range(20) for j in range(20) if i != j])
    assert near("a", "a") > near("a", "b") + 0.3 and near("b", "b") > near("a", "b") + 0.3
    assert np.dot(found[0][1], found[2][1]) > 0.8 > np.dot(found[0][1], found[1][1])


def clustered(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(3, 6) * 3
    rows = [(i, [float(x) for x in centres[i % 3] + rng.normal(scale=0.1, size=6)]) for i in range(90)]
    rows += [(90 + i, rows[0][1]) for i in range(30)] + [(120, None)]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")


def test_transport_marginals_and_repeat(spark):
    docs = clustered(spark)
    first = transport.fit_transport(docs, k=3, weights=[0.5, 0.25, 0.25])
    sums = {r["doc_id"]: r["s"] for r in first.doc_topic.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()}
    assert len(sums) == 121 and all(s == pytest.approx(1.0, abs=1e-9) for s in sums.values())
    with_vector = docs.filter("embedding is not null").select("doc_id")
    taken = {r["topic"]: r["m"] for r in first.doc_topic.join(with_vector, "doc_id", "left_semi").groupBy("topic").agg(F.avg("weight").alias("m")).collect()}
    assert taken == pytest.approx({0: 0.5, 1: 0.25, 2: 0.25}, abs=1e-3)
    second = transport.fit_transport(docs, k=3, weights=[0.5, 0.25, 0.25])
    a = {(r["doc_id"], r["topic"]): r["weight"] for r in first.doc_topic.collect()}
    b = {(r["doc_id"], r["topic"]): r["weight"] for r in second.doc_topic.collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_transport_finds_separate_groups(spark):
    docs = clustered(spark).filter("doc_id < 90")
    shares = transport.fit_transport(docs, k=3, epsilon=0.1).shares
    best = shares.select("doc_id", assign.best_share([0, 1, 2], F.col("shares")).alias("b")).collect()
    topics = {}
    for r in best:
        topics.setdefault(r["doc_id"] % 3, set()).add(r["b"]["topic"])
    assert sorted(len(t) for t in topics.values()) == [1, 1, 1]
    assert len(set.union(*topics.values())) == 3


def test_transport_needs_enough_documents(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "doc_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="different documents"):
        transport.fit_transport(docs, k=2)


def test_word_shares_sum_to_one(points, topics):
    words = points.filter("doc_id < 60").select(F.col("doc_id").cast("string").alias("term"), "embedding")
    found = transport.word_shares(words, topics).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert len(found) == 6 and all(r["s"] == pytest.approx(1.0) for r in found)
