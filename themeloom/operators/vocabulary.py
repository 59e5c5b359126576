"""Counts of words: per document, over the corpus, per class."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.arrays import bag_of_words
from themeloom.operators.joins import lookup
from themeloom.session import dense_ids, materialise_counted

MIN_LENGTH = 2  # shorter words are no terms
MAX_DRIVER_VOCABULARY = 2_500_000


def doc_terms(docs: DataFrame, *carry: str, tokens: str = "tokens") -> DataFrame:
    """One row per document and term with its count ``n``; narrow, nothing is shuffled.

    ``carry`` names the columns to keep (a document key, a class); text is left behind.
    """
    long_enough = F.filter(F.col(tokens), lambda w: F.length(w) >= MIN_LENGTH)
    return docs.select(*carry, F.inline(bag_of_words(long_enough)))


def vocabulary(terms: DataFrame, min_df: int = 1, max_vocab: int | None = None) -> DataFrame:
    """``(term_id, term, df, cf)`` with alphabetical ids from 0.

    ``terms`` has one row per document and term, so the document frequency is a plain count.
    ``max_vocab`` keeps the most frequent terms (ties alphabetical) before ids are given.
    """
    words = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    if min_df > 1:
        words = words.filter(F.col("df") >= min_df)
    if max_vocab is not None:
        words = words.orderBy(F.desc("cf"), "term").limit(max_vocab)
    return dense_ids(words, [F.col("term")], "term_id").select("term_id", "term", "df", "cf")


def count_vectorizer(vocab: DataFrame) -> CountVectorizerModel:
    """The same matrix as sparse vectors, for MLlib; the vocabulary is held by the driver."""
    words = vocab.orderBy("term_id").select("term").limit(MAX_DRIVER_VOCABULARY + 1).collect()
    if len(words) > MAX_DRIVER_VOCABULARY:
        raise ValueError(f"more than {MAX_DRIVER_VOCABULARY} terms: give vocabulary() a max_vocab")
    return CountVectorizerModel.from_vocabulary(
        [w["term"] for w in words], inputCol="tokens", outputCol="features"
    )


def class_counts(terms: DataFrame, topic: str = "topic") -> DataFrame:
    """``(topic, term, n)``: each class read as one long document; a null class is none."""
    return (
        terms.filter(F.col(topic).isNotNull())
        .groupBy(F.col(topic).alias("topic"), "term")
        .agg(F.sum("n").alias("n"))
    )


def _counts_and_sizes(terms: DataFrame, topic: str) -> tuple[DataFrame, DataFrame, int]:
    """Class counts with ``_words``, the size of the class, the sizes alone, and the number of counts.

    The counts are stored, so that the texts behind ``terms`` are read once.
    """
    counts, rows = materialise_counted(class_counts(terms, topic), "class-counts")
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("_words"))
    return lookup(counts, sizes, ["topic"], "term", rows), sizes, rows


def class_tfidf(terms: DataFrame, topic: str = "topic", outlier: int | None = None) -> DataFrame:
    """``(topic, term, n, score)`` by class-based TF-IDF.

    ``score = n / words in class * ln(1 + mean words per class / n over all classes)``.
    The outlier class counts as a class unless it is named in ``outlier``.
    """
    if outlier is not None:
        terms = terms.filter(F.col(topic) != outlier)
    counts, sizes, rows = _counts_and_sizes(terms, topic)
    mean_words = sizes.agg(F.avg("_words")).scalar()
    # Added up in each task first; a term of all classes is looked up like any other.
    over_classes = counts.groupBy("term").agg(F.sum("n").alias("_total"))
    inverse = F.log1p(mean_words / F.col("_total"))
    return lookup(counts, over_classes, ["term"], "topic", rows).select("topic", "term", "n", (F.col("n") / F.col("_words") * inverse).alias("score"))


def class_shares(terms: DataFrame, topic: str = "topic") -> DataFrame:
    """``(topic, term, weight)``: the share of the words of a class; sums to 1 per class."""
    counts, _, _ = _counts_and_sizes(terms, topic)
    return counts.select("topic", "term", (F.col("n") / F.col("_words")).alias("weight"))
