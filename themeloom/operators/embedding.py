"""Vectors for documents and words, and their reduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as v
from themeloom.operators import skipgram
from themeloom.operators.vocabulary import MIN_LENGTH

MAX_PCA_DIM = 1_000
ALONE = 1e-9  # a sum of neighbours no longer than this is a rounding error
TOKENS_AT_ONCE = 4_000_000  # whose words' vectors a task adds up before they are shuffled
WORDS_PER_BATCH = 20_000
MAX_DRIVER_WEIGHTS = 50_000_000  # words x dim that the driver and every task hold while MLlib's Word2Vec trains


def hashed_embedding(docs: DataFrame, dim: int = v.HASH_DIM, tokens: str = "tokens", length: str | None = None) -> DataFrame:
    """Add ``embedding``: a unit vector made of the words alone, no model and no shuffle.

    Null for a document without words. ``length`` names a further column for the length the
    vector had, which ``learned_words`` needs to tell a word's own part in it.
    """
    found = docs.withColumn("_hashed", v.document_vector(F.col(tokens), dim, MIN_LENGTH))
    if length is not None:
        found = found.withColumn(length, F.col("_hashed.length"))
    return found.withColumn("embedding", F.col("_hashed.vector")).drop("_hashed")


def learned_words(
    docs: DataFrame, min_count: int = 1, tokens: str = "tokens", embedding: str = "embedding", length: str | None = None
) -> DataFrame:
    """``(term, n, embedding)``: each word as the company it keeps, in the space of the documents.

    A word's vector is the sum of the vectors of the documents that hold it, each times
    ``1 + ln n``, at length 1 (random indexing). With ``length``, the column that
    ``hashed_embedding`` adds, the word's own sign vector is taken out of every one of them, so
    that only its neighbours count; vectors of an encoder have no such part. A word that never
    stands beside another, or is found fewer than ``min_count`` times, has no row. Tasks
    add up their own documents as matrices and send a row for each of their words; those of a word
    meet by a shuffle and are added in the order of the words. Nothing is held by the driver.
    """
    known = docs.filter(F.col(embedding).isNotNull())
    first = known.select(F.size(embedding).alias("d")).head()
    dim = first["d"] if first else 1
    own_length = F.col(length).cast("double") if length else F.lit(None).cast("double")
    rows = known.select(F.col(tokens).alias("tokens"), v.as_doubles(F.col(embedding)).alias("x"), own_length.alias("length"))
    most = TOKENS_AT_ONCE
    parts = rows.mapInArrow(lambda batches: _company_of_task(batches, dim, most), "term string, n bigint, own double, company binary")
    together = parts.repartition("term").sortWithinPartitions("term")
    hashed = length is not None
    return together.mapInArrow(lambda batches: _learned(batches, dim, min_count, hashed), "term string, n bigint, embedding array<double>")


def _company_of_task(batches: Iterator[pa.RecordBatch], dim: int, most: int) -> Iterator[pa.RecordBatch]:
    """``(term, n, own, company)`` of the words of some ``most`` tokens at a time."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += len(batch.column("tokens").flatten())
        if tokens >= most:
            yield from _company(pa.Table.from_batches(held), dim).to_batches(WORDS_PER_BATCH)
            held, tokens = [], 0
    if tokens:
        yield from _company(pa.Table.from_batches(held), dim).to_batches(WORDS_PER_BATCH)


def _company(table: pa.Table, dim: int) -> pa.Table:
    # As first found: rare words of one document have one vector and stay together, which packs well.
    words, word, doc = v.words_of(table.column("tokens").combine_chunks(), MIN_LENGTH, ordered=False)
    # Each (word, document) once, by word.
    pairs, n = np.unique(word * table.num_rows + doc, return_counts=True)
    word, doc = pairs // table.num_rows, pairs % table.num_rows
    weight = 1.0 + np.log(n)
    x = v.matrix_of(table.column("x").combine_chunks())
    lengths = table.column("length").to_numpy(zero_copy_only=False).astype("f8")
    found = len(words)
    sums = np.zeros((found, dim))
    for s in v.slices(len(pairs), dim):
        begins = np.flatnonzero(np.diff(word[s], prepend=-1))
        sums[word[s][begins]] += np.add.reduceat(x[doc[s]] * weight[s, None], begins, axis=0)
    own = np.bincount(word, weight * weight / lengths[doc], found)
    return pa.table(
        {
            "term": words.cast(pa.string()),
            "n": pa.array(np.bincount(word, n, found).astype("i8")),
            "own": pa.array(own),
            "company": _packed(sums),
        }
    )


def _packed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _learned(batches: Iterator[pa.RecordBatch], dim: int, min_count: int, hashed: bool) -> Iterator[pa.RecordBatch]:
    """The words of one task, whose parts lie together; the last word of a batch may go on in the next."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term").to_pylist()
        begins = np.flatnonzero([True, *(a != b for a, b in zip(terms, terms[1:]))])
        n = np.add.reduceat(batch.column("n").to_numpy(), begins)
        own = np.add.reduceat(batch.column("own").to_numpy(zero_copy_only=False), begins)
        packed = batch.column("company").cast(pa.binary(8 * dim))
        company = np.frombuffer(packed.buffers()[1], "f8", dim * len(packed), 8 * dim * packed.offset).reshape(-1, dim)
        company = np.add.reduceat(company, begins, axis=0)
        names = [terms[i] for i in begins]
        if last is not None and last[0][0] == names[0]:
            n[0], own[0], company[0] = n[0] + last[1][0], own[0] + last[2][0], company[0] + last[3][0]
        elif last is not None:
            yield _units(*last, min_count, hashed)
        if len(names) > 1:
            yield _units(names[:-1], n[:-1], own[:-1], company[:-1], min_count, hashed)
        last = names[-1:], n[-1:], own[-1:], company[-1:]
    if last is not None:
        yield _units(*last, min_count, hashed)


def _units(terms: list[str], n: np.ndarray, own: np.ndarray, company: np.ndarray, min_count: int, hashed: bool) -> pa.RecordBatch:
    """Vectors at length 1 of the words that are frequent enough and have company."""
    if hashed:
        # The sign vector in a document's sum is at length sqrt(dim), not at length 1.
        company = company - own[:, None] * v.signs(v.digests_of(pa.array(terms)), company.shape[1])
    kept = (n >= min_count) & (np.sqrt((company * company).sum(axis=1)) > ALONE)
    vectors = v.lists_of(v.unit_rows(company[kept]), np.ones(int(kept.sum()), bool))
    names = pa.array([term for term, k in zip(terms, kept) if k], pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(n[kept]), vectors], names=["term", "n", "embedding"])


def encoded(
    docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list]], text: str = "text"
) -> DataFrame:
    """Add ``embedding`` from a plugged-in sentence encoder.

    ``make_encoder`` runs once per task and returns a function from a list of texts to a
    list of vectors. The call is marked non-deterministic so that no text is encoded twice.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series([[float(x) for x in row] for row in encoder(texts.tolist())], index=texts.index)

    return docs.withColumn("embedding", encode.asNondeterministic()(F.col(text)))


def word2vec(
    docs: DataFrame, dim: int = 32, min_count: int = 2, seed: int = 42, partitions: int | None = None, passes: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Train word vectors; returns ``docs`` with ``embedding`` and ``(term, embedding)``.

    A document's vector is the mean of its words' vectors. MLlib's Word2Vec trains them in
    ``partitions`` tasks (all cores by default), each and the driver with all words x dim numbers.
    Where these are too many, no place holds them: ``skipgram`` trains in shards of documents.
    """
    counts = docs.select(F.explode("tokens").alias("term")).groupBy("term").count()
    size = F.count_if(F.col("count") >= min_count).alias("words")
    found = counts.agg(size, F.coalesce(F.sum("count"), F.lit(0)).alias("tokens")).head()
    spark = docs.sparkSession
    tasks = partitions or spark.sparkContext.defaultParallelism
    if found["words"] * dim > MAX_DRIVER_WEIGHTS:
        return _word2vec_in_shards(docs, dim, min_count, seed, max(tasks, -(-found["tokens"] // skipgram.TOKENS_PER_SHARD)), passes)
    model = Word2Vec(
        vectorSize=dim,
        minCount=min_count,
        seed=seed,
        maxIter=passes,
        numPartitions=tasks,
        inputCol="tokens",
        outputCol="_vector",
    ).fit(docs.select("tokens"))
    with_vectors = model.transform(docs).withColumn("embedding", v.unit(vector_to_array("_vector"))).drop("_vector")
    words = model.getVectors().select(F.col("word").alias("term"), v.unit(vector_to_array("vector")).alias("embedding"))
    return with_vectors, words


def _word2vec_in_shards(docs: DataFrame, dim: int, min_count: int, seed: int, shards: int, passes: int) -> tuple[DataFrame, DataFrame]:
    held = skipgram.sharded(docs.drop("embedding"), shards, seed)
    words = skipgram.shard_words(held, min_count)
    vectors = skipgram.trained(held, words, dim, seed, passes)
    return skipgram.with_means(held, words, vectors, dim), vectors.select("term", v.unit(F.col("x")).alias("embedding"))


def reduced(docs: DataFrame, k: int = 5, embedding: str = "embedding") -> DataFrame:
    """Add ``reduced``: the first ``k`` principal components of the unit vectors.

    Rows without a vector get null; they take no part in the fit.
    """
    first = docs.filter(F.col(embedding).isNotNull()).select(F.size(embedding).alias("d")).head()
    if first is None:
        return docs.withColumn("reduced", F.lit(None).cast("array<double>"))
    if first["d"] > MAX_PCA_DIM:
        raise ValueError(f"PCA keeps a {first['d']} x {first['d']} matrix on the driver; limit is {MAX_PCA_DIM}")
    rows = docs.withColumn("_unit", v.unit(F.col(embedding)))
    fit_on = rows.filter(F.col("_unit").isNotNull()).select(array_to_vector("_unit").alias("_vector"))
    model = PCA(k=min(k, first["d"]), inputCol="_vector", outputCol="_reduced").fit(fit_on)
    zero = F.array_repeat(F.lit(0.0), F.lit(first["d"]))
    projected = model.transform(rows.withColumn("_vector", array_to_vector(F.coalesce("_unit", zero))))
    return projected.withColumn(
        "reduced", F.when(F.col("_unit").isNotNull(), vector_to_array("_reduced"))
    ).drop("_unit", "_vector", "_reduced")
