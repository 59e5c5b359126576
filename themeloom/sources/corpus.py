"""Corpora in, reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.session import dense_ids, spread
from themeloom.sources import folder as folder_source


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A parquet corpus; a file too small to fill the cores is spread by its key."""
    return spread(spark.read.parquet(path), key)


def read_text_folder(
    spark: SparkSession, folder: str, pattern: str = "*", keep_empty: bool = True
) -> DataFrame:
    """``(doc_id, name, text, n_words)``: one row per UTF-8 file, in file-name order.

    Files of no length are empty documents, unless ``keep_empty`` is False. Ids, texts and empty
    files come from one reading (``sources.folder``); a store that only Spark's own readers open is
    read by those.
    """
    if not folder_source.reachable(folder):
        return _read_by_spark(spark, folder, pattern, keep_empty)
    spark.dataSource.register(folder_source.TextFolder)
    files = (
        spark.read.format("text_folder")
        .options(pattern=pattern, keepEmpty=keep_empty, tasks=spark.sparkContext.defaultParallelism)
        .load(folder)
    )
    return corpus_frame(files, "doc_id", "name", "value")


def write_text_folder(docs: DataFrame, folder: str, name: str, text: str) -> None:
    """One UTF-8 file for each row; a null text is an empty file.

    A name has to be a file name of its own: null and repeated ones, and those that a folder of
    documents does not show, raise before anything is written, as does a folder that is there.
    """
    if folder_source.reachable(folder):
        raise FileExistsError(folder)
    files = docs.select(F.col(name).alias("name"), F.col(text).alias("value"))
    unfit = F.col("name").isNull() | F.col("name").rlike("^$|^[._]|/") | (F.col("n") > 1)
    if files.groupBy("name").agg(F.count("*").alias("n")).filter(unfit).limit(1).count():
        raise ValueError(f"{name} holds a null, repeated or unfit file name")
    docs.sparkSession.dataSource.register(folder_source.TextFolder)
    files.write.format("text_folder").mode("append").save(folder)


def _read_by_spark(spark: SparkSession, folder: str, pattern: str, keep_empty: bool) -> DataFrame:
    """The same rows by Spark's file sources, which pass over files of no length; a second reading finds them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    if keep_empty:
        whole = spark.sparkContext.wholeTextFiles(f"{folder}/{pattern}")
        empty = whole.filter(lambda file: not file[1]).map(lambda file: (file[0],))
        files = files.union(spark.createDataFrame(empty, "path string"))
    ids = dense_ids(files, [F.col("path")], "doc_id")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    texts = (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(path.alias("path"), tx.strip_space(F.col("value")).alias("text"))
    )
    return ids.join(texts, "path", "left").select(
        "doc_id",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(tx.word_count(F.col("text")), F.lit(0)).alias("n_words"),
    )


def read_latex_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, name, text, n_words)`` of the ``.tex`` files, stripped to their prose."""
    files = read_text_folder(spark, folder, "*.tex")
    prose = files.withColumn("text", tx.strip_space(tx.strip_latex(F.col("text"))))
    return prose.withColumn("n_words", tx.word_count(F.col("text")))


def corpus_frame(docs: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """The same frame from any table with a key, a name and a text."""
    stripped = docs.select(
        F.col(key).alias("doc_id"), F.col(name).alias("name"), tx.strip_space(F.col(text)).alias("text")
    )
    return stripped.withColumn("n_words", tx.word_count(F.col("text")))


def corpus_profile(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Documents and words in total and per value of each column in ``by``.

    Texts are counted once, into one small row per combination; the grouping sets run over
    those rows.
    """
    cells = (
        docs.select(*by, tx.word_count(F.col(text)).alias("w"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("docs"),
            F.sum("w").alias("words"),
            F.min("w").alias("least"),
            F.max("w").alias("most"),
        )
    )
    columns = [F.col(c) for c in by]
    words = F.sum("words")
    docs_in = F.sum("docs")
    return cells.groupingSets([[], *[[c] for c in columns]], *columns).agg(
        docs_in.alias("n_docs"),
        words.alias("n_words"),
        F.min("least").alias("min_words"),
        F.max("most").alias("max_words"),
        (words / docs_in).alias("avg_words"),
    )


def write_report(report: DataFrame, path: str, topic: str | None = None) -> None:
    """Store a report as parquet, one folder per topic if a topic column is named."""
    writer = report.write.mode("error")
    if topic:
        writer = writer.partitionBy(topic)
    writer.parquet(path)
