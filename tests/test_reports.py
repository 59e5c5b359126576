import math

import pytest
from pyspark.sql import functions as F

from themeloom.operators import evaluate, represent

TOP = [(t, r, w, s) for t, words in {0: "uno dos tres", 1: "mar sol dos", -1: "x y z"}.items()
       for r, (w, s) in enumerate(zip(words.split(), (0.9, 0.6, 0.3)), 1)]
ASSIGNED = [(1, 0, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, -1, 0.0), (5, 0, 0.9), (6, 0, 0.1)]


@pytest.fixture(scope="module")
def top(spark):
    return spark.createDataFrame(TOP, "topic int, rank int, term string, score double")


@pytest.fixture(scope="module")
def assigned(spark):
    return spark.createDataFrame(ASSIGNED, "doc_id bigint, topic int, score double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keywords(top):
    assert rows(represent.keywords(top, 2)) == [(-1, "x, y"), (0, "uno, dos"), (1, "mar, sol")]


def test_words_of_topic(top):
    assert rows(represent.words_of_topic(top, 1, 2).select("rank", "term")) == [(1, "mar"), (2, "sol")]


def test_wordcloud(top):
    weights = rows(represent.wordcloud_weights(top).filter("topic = 0").select("weight"))
    assert [w[0] for w in weights] == pytest.approx([1 / 3, 2 / 3, 1.0])


def test_sizes_largest_first(assigned):
    assert [tuple(r) for r in represent.topic_sizes(assigned).collect()] == [(0, 4), (-1, 1), (1, 1)]


def test_count(assigned, spark):
    assert rows(represent.topic_count(assigned)) == [(3, 2)]
    assert rows(represent.topic_count(assigned.filter("topic = -1"))) == [(1, 0)]


WEIGHTS = [(1, 0, 0.2), (1, 1, 0.5), (1, 2, 0.3), (2, 0, 0.4), (2, 1, 0.4), (2, 2, 0.2), (3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)]


def test_dominant_topic_lowest_on_a_tie(spark):
    doc_topic = spark.createDataFrame(WEIGHTS, "doc_id bigint, topic int, weight double")
    found = rows(represent.dominant_topic(doc_topic).select("doc_id", "topic", "dominant"))
    assert found == [(1, 1, "Tema 2"), (2, 0, "Tema 1"), (3, 0, "Tema 1")]


def test_wide(spark):
    doc_topic = spark.createDataFrame(WEIGHTS, "doc_id bigint, topic int, weight double")
    wide = represent.wide_weights(doc_topic, 3)
    assert wide.columns == ["doc_id", "Tema 1", "Tema 2", "Tema 3", "Tema dominante"]
    assert rows(wide) == [(1, 0.2, 0.5, 0.3, "Tema 2"), (2, 0.4, 0.4, 0.2, "Tema 1"), (3, 0.0, 0.0, 0.0, "Tema 1")]


def test_topic_info(assigned, top):
    info = {r["topic"]: r for r in represent.topic_info(assigned, top).collect()}
    assert info[0]["n"] == 4 and info[0]["name"] == "0_uno_dos_tres"
    assert info[0]["sample_docs"] == [1, 5, 2]
    assert info[-1]["keywords"] == ["x", "y", "z"]


def test_listing_leaves_outliers_out(assigned, top):
    assert rows(represent.topic_listing(assigned, top, 2)) == [(0, 4, "uno, dos"), (1, 1, "mar, sol")]


def test_document_keywords_keep_outliers(assigned, top):
    found = rows(represent.with_keywords(assigned, top, 1).select("doc_id", "keywords"))
    assert found == [(1, "uno"), (2, "uno"), (3, "mar"), (4, "x"), (5, "uno"), (6, "uno")]


TERMS = [(1, "uno", 1), (1, "dos", 2), (2, "uno", 1), (3, "mar", 1), (3, "sol", 1), (3, "dos", 1), (4, "tres", 1), (5, "w", 1)]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "doc_id bigint, term string, n bigint")


def documents_with(*words):
    held = {}
    for doc, term, _ in TERMS:
        held.setdefault(doc, set()).add(term)
    return sum(set(words) <= found for found in held.values())


PAIRS = {0: [("uno", "dos"), ("uno", "tres"), ("dos", "tres")], 1: [("mar", "sol"), ("mar", "dos"), ("sol", "dos")]}


def test_umass(terms, top):
    found = dict(rows(evaluate.coherence_umass(terms, top.filter("topic >= 0"))))
    for topic, pairs in PAIRS.items():
        assert found[topic] == pytest.approx(sum(math.log((documents_with(a, b) + 1) / documents_with(a)) for a, b in pairs))


def test_npmi(terms, top):
    def npmi(a, b):
        p_a, p_b, p_ab = documents_with(a) / 5, documents_with(b) / 5, documents_with(a, b) / 5
        return -1.0 if p_ab == 0 else math.log(p_ab / (p_a * p_b)) / -math.log(p_ab)

    found = dict(rows(evaluate.coherence_npmi(terms, top.filter("topic >= 0"), 5)))
    for topic, pairs in PAIRS.items():
        assert found[topic] == pytest.approx(sum(npmi(a, b) for a, b in pairs) / 3)


def test_npmi_of_words_in_every_document(spark):
    terms = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "doc_id bigint, term string, n bigint")
    top = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "b", 1.0)], "topic int, rank int, term string, score double")
    assert rows(evaluate.coherence_npmi(terms, top, 1)) == [(0, 1.0)]


def test_diversity(top):
    assert rows(evaluate.topic_diversity(top)) == [(9, 8, 8 / 9)]


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 10) for i in range(9)], "a int, b int")
    assert rows(evaluate.agreement(same, "a", "b")) == [(9, 1.0, pytest.approx(1.0))]
    crossed = spark.createDataFrame([(i // 2, i % 2) for i in range(4)], "a int, b int")
    assert rows(evaluate.agreement(crossed, "a", "b")) == [(4, 0.5, pytest.approx(0.0))]
    single = spark.createDataFrame([(0, 0)] * 3, "a int, b int")
    assert rows(evaluate.agreement(single, "a", "b")) == [(3, 1.0, 1.0)]


def test_search(spark, terms):
    query = spark.createDataFrame([("dos",), ("uno",), ("dos",)], "term string")
    found = [tuple(r) for r in evaluate.search(terms, query, F.lit(5), 2).collect()]
    idf = math.log(5 / 2)
    assert found == [
        (1, 1, pytest.approx((1 + math.log(2)) * idf + idf), 2),
        (2, 2, pytest.approx(idf), 1),
    ]


def test_best_documents(assigned):
    assert rows(evaluate.best_documents(assigned, 0, 2).select("doc_id")) == [(1,), (5,)]


def test_trend(spark):
    data = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1)], "source string, topic int")
    assert rows(evaluate.topic_trend(data, "source")) == [("a", 0, 2, 2 / 3), ("a", 1, 1, 1 / 3), ("b", 1, 1, 1.0)]
