"""Stopword lists: the ones Spark ships, by language name."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LANGUAGES = ("spanish", "english")


def stopword_list(*languages: str) -> list[str]:
    """The union of the lists, sorted; needs a running session."""
    words: set[str] = set()
    for language in languages or DEFAULT_LANGUAGES:
        words.update(StopWordsRemover.loadDefaultStopWords(language))
    return sorted(words)


def stopword_table(spark: SparkSession, *languages: str) -> DataFrame:
    """``(term, languages)``: each listed word once, with the lists that hold it."""
    rows = [
        (word, language)
        for language in languages or DEFAULT_LANGUAGES
        for word in StopWordsRemover.loadDefaultStopWords(language)
    ]
    listed = spark.createDataFrame(rows, "term string, language string")
    return listed.groupBy("term").agg(
        F.array_join(F.sort_array(F.collect_set("language")), " ").alias("languages")
    )
