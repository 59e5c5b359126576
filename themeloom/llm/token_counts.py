"""Token counts of whole texts, with a cache of counts by content digest.

The cache is a Parquet folder of ``(tokenizer, content, n_tokens)``: digests of the
tokenizer's version and of a text. Texts are digested, the distinct digests joined to the
cache, only the distinct misses encoded, and their counts appended. Appending twice after a
lost run does no harm: a content digest has one count, and reading takes it once.

Before it is digested a text is normalised as far as counts allow: a null is the empty text,
which has no tokens. Very long texts are encoded whole. Repeated rows give repeated rows; an
empty table gives an empty table and leaves the cache as it is. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import tokens
from themeloom.llm.common import documents, full_text
from themeloom.operators.joins import lookup
from themeloom.session import scratch_folder

LIMIT = 512
STORED = "tokenizer string, content binary, n_tokens bigint"
BATCH_BYTES = 8 << 20  # text encoded at once in a task


def content_digest(text):
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def encoded_counts(misses: DataFrame, spec: str) -> DataFrame:
    """``(content, n_tokens)`` for rows ``(content, text)``."""
    shared = misses.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file: a few MB, whatever the corpus

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        for batch in batches:
            counts = []
            for texts in in_bytes(batch.column("text").to_pylist()):
                counts += [len(ids) // 4 for ids in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(count, "content binary, n_tokens bigint")


def in_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``most`` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version, or None where nothing is stored yet."""
    try:
        stored = spark.read.schema(STORED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    spec = tokens.read_file(tokenizer_path)
    version = tokens.digest(spec)
    text = full_text("text")
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), content_digest(text).alias("content"))
    # One row per distinct text; the copies of a text meet as digests, and only one keeps its text.
    texts = docs.select(content_digest(text).alias("content"), text.alias("text")).dropDuplicates(["content"])
    stored = read_cache(spark, cache, version)
    misses = texts if stored is None else texts.join(stored, "content", "left_anti")
    new = encoded_counts(misses, spec).select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
    new.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    return lookup(rows, counts, ["content"], "doc_id").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all documents; the cache of this call starts empty, so each distinct text is encoded."""
    import public_tokenizers

    cache = f"{scratch_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    return count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), cache)
