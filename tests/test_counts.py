import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.functions.arrays import bag_of_words
from themeloom.operators import represent, vocabulary
from themeloom.session import dense_ids

DOCS = [
    (1, 0, "gato gato perro sol".split()),
    (2, 0, "gato luna".split()),
    (3, 1, "barco mar mar sol a".split()),
    (4, 1, []),
    (5, -1, "mar viento".split()),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, topic int, tokens array<string>")


def test_bag_of_words(spark):
    texts = ["b a b", "", "x", "z z z", "á a Á"]
    rows = spark.createDataFrame([(t.split(),) for t in texts], "t array<string>").select("t", bag_of_words(F.col("t")).alias("bag"))
    for row in rows.collect():
        assert {b["term"]: b["n"] for b in row["bag"]} == Counter(row["t"])


def test_doc_terms(docs):
    found = {(r["doc_id"], r["term"]): r["n"] for r in vocabulary.doc_terms(docs, "doc_id").collect()}
    assert found == {(d, t): n for d, _, ws in DOCS for t, n in Counter(w for w in ws if len(w) > 1).items()}


def test_counting_needs_no_shuffle(docs, capsys):
    vocabulary.doc_terms(docs, "doc_id").explain()
    assert "Exchange" not in capsys.readouterr().out


def test_vocabulary(docs):
    found = vocabulary.vocabulary(vocabulary.doc_terms(docs)).orderBy("term_id").collect()
    assert [r["term"] for r in found] == ["barco", "gato", "luna", "mar", "perro", "sol", "viento"]
    assert [r["term_id"] for r in found] == list(range(7))
    assert [(r["df"], r["cf"]) for r in found] == [(1, 1), (2, 3), (1, 1), (2, 3), (1, 1), (2, 2), (1, 1)]


def test_vocabulary_cap_keeps_the_frequent_then_the_first(docs):
    found = vocabulary.vocabulary(vocabulary.doc_terms(docs), max_vocab=4).orderBy("term_id").collect()
    assert [r["term"] for r in found] == ["barco", "gato", "mar", "sol"]
    found = vocabulary.vocabulary(vocabulary.doc_terms(docs), min_df=2).orderBy("term_id").collect()
    assert [r["term"] for r in found] == ["gato", "mar", "sol"]


def test_dense_ids_over_many_partitions(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k")).repartition(13)
    found = dense_ids(rows, [F.desc("k")], "n").collect()
    assert [r["n"] for r in sorted(found, key=lambda r: -r["k"])] == list(range(10_000))


def brute_tfidf(outlier=None):
    classes = {}
    for _, topic, words in DOCS:
        if topic != outlier:
            classes.setdefault(topic, Counter()).update(w for w in words if len(w) > 1)
    mean = sum(sum(c.values()) for c in classes.values()) / len(classes)
    total = sum(classes.values(), Counter())
    return {
        (t, w): n / sum(c.values()) * math.log(1 + mean / total[w]) for t, c in classes.items() for w, n in c.items()
    }


@pytest.mark.parametrize("outlier", [None, -1])
def test_class_tfidf(docs, outlier):
    found = vocabulary.class_tfidf(vocabulary.doc_terms(docs, "topic"), outlier=outlier).collect()
    assert {(r["topic"], r["term"]): r["score"] for r in found} == pytest.approx(brute_tfidf(outlier))


def test_class_shares_sum_to_one(docs):
    found = vocabulary.class_shares(vocabulary.doc_terms(docs, "topic")).groupBy("topic").agg(F.sum("weight").alias("s"))
    assert [r["s"] for r in found.collect()] == pytest.approx([1.0, 1.0, 1.0])


def test_a_null_class_is_no_class(spark):
    rows = spark.createDataFrame([(None, ["aa"]), (1, ["bb"])], "topic int, tokens array<string>")
    found = vocabulary.class_tfidf(vocabulary.doc_terms(rows, "topic")).collect()
    assert [r["term"] for r in found] == ["bb"]


def test_count_vectors_have_vocabulary_order(docs):
    vocab = vocabulary.vocabulary(vocabulary.doc_terms(docs))
    out = vocabulary.count_vectorizer(vocab).transform(docs.filter("doc_id = 1")).head()["features"]
    assert out.toArray().tolist() == [0, 2, 0, 0, 1, 1, 0]


def test_vocabulary_too_large_for_the_driver(docs, monkeypatch):
    monkeypatch.setattr(vocabulary, "MAX_DRIVER_VOCABULARY", 3)
    with pytest.raises(ValueError, match="max_vocab"):
        vocabulary.count_vectorizer(vocabulary.vocabulary(vocabulary.doc_terms(docs)))


def test_top_terms_ties_and_limit(spark):
    rows = [(0, "b", 1.0), (0, "a", 1.0 + 1e-12), (0, "c", 2.0), (1, "z", 0.5)]
    top = represent.top_terms(spark.createDataFrame(rows, "topic int, term string, score double"), 2).collect()
    assert sorted((r["topic"], r["rank"], r["term"]) for r in top) == [(0, 1, "c"), (0, 2, "a"), (1, 1, "z")]


def test_top_terms_are_cut_before_the_shuffle(spark, capsys):
    rows = spark.range(100).select((F.col("id") % 3).alias("topic"), F.col("id").cast("string").alias("term"), F.rand(1).alias("score"))
    represent.top_terms(rows, 5).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
