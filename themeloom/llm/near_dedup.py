"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (lower case, words by white space). For
each shingle, Poisson processes run over the weights 0 … 1, 1 … 2, 2 … 4, 4 … 8 and so on, each
with as many points as its length; a point has a time, a weight within its interval and one of
``SIZE`` places, and counts if its weight is at most the shingle's number of occurrences. The
signature holds the first time of each place, so the share of equal places estimates the
weighted Jaccard similarity without bias. Points are drawn from a hash of the shingle in order
of time and no further than the latest first time so far, so most shingles draw one point.
Bands of ``ROWS`` places bring candidates together; their multisets are compared exactly, with
a leader of each bucket first, then by the rare shingles they share (``llm/links.py``).

A class is a component of links of ``LEAST`` or more. A text under five words is one shingle;
texts without words, null ones included, are one class. Equal texts meet as one before the
comparison; repeated rows belong to the same class. Very long texts are taken whole. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, fresh, full_text, with_row_ids
from themeloom.llm.features import _hashes
from themeloom.llm.links import linked_components, shared_buckets
from themeloom.llm.token_counts import in_bytes
from themeloom.operators.joins import lookup
from themeloom.session import materialise

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 18, 4
SIZE = BANDS * ROWS
_U = np.uint64
_NO_WORDS = -1  # the key of a text without words


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) + _U(1)
    if len(raw) < WORDS:
        raw = np.concatenate((raw, np.zeros(WORDS - len(raw), np.uint64)))
    n = len(raw) - WORDS + 1
    value = np.zeros(n, np.uint64)
    for k in range(WORDS):
        value = value * _U(0x9E3779B97F4A7C15) + raw[k : k + n]
    return np.unique(mixed(value), return_counts=True)


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """Signatures, one row a bag: the first time of each of ``size`` places."""
    counts = [len(e) for e, _ in bags]
    first = np.full(len(bags) * size, np.inf)
    doc = np.repeat(np.arange(len(bags)), counts)
    element = np.concatenate([e for e, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]).astype(float) if bags else np.zeros(0)
    todo = []
    low, high, level = 0.0, 1.0, 0
    while len(element):  # the processes of one interval of weights, for the shingles that reach it
        todo.append((doc, mixed(element + _U((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)), weight, low, high))
        reach = weight > high
        doc, element, weight = doc[reach], element[reach], weight[reach]
        low, high, level = high, high * 2, level + 1
    latest = np.full(len(bags), np.inf)
    for doc, seed, weight, low, high in todo:
        time = np.zeros(len(doc))
        while len(doc):
            seed = seed + _U(0x9E3779B97F4A7C15)
            one, two = mixed(seed), mixed(seed ^ _U(0xA5A5A5A55A5A5A5A))
            time = time - np.log1p(-((one >> _U(11)).astype(float) * 2.0**-53)) / (size * (high - low))
            place = ((two >> _U(32)) * _U(size)) >> _U(32)
            inside = low + (two & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * (high - low) < weight
            np.minimum.at(first, (doc * size + place.astype(np.int64))[inside], time[inside])
            touched = np.unique(doc)
            latest[touched] = first.reshape(-1, size)[touched].max(1)
            go = time < latest[doc]
            doc, seed, weight, time = doc[go], seed[go], weight[go], time[go]
    return first.reshape(-1, size)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def set_of(text: str) -> np.ndarray:
    """The multiset as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    element, count = shingles(text)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(mixed(np.repeat(element, count) + nth.astype(np.uint64) * _U(0xD6E8FEB86659FD93)).astype(np.uint32))


def _signed(docs: DataFrame) -> DataFrame:
    """``(id, digest, first, keys)``: each distinct text once, with its smallest row key."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for texts in in_bytes(batch.column("text").to_pylist(), 2 << 20):
                bags = [shingles(t) for t in texts]
                keys = bands(bag_min_hash(bags))
                keys[[not len(e) for e, _ in bags]] = _NO_WORDS
                digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                values = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array(digests, pa.binary()), values], ["doc_id", "digest", "keys"]
                )
                at += len(texts)

    signed = docs.mapInArrow(sign, "doc_id bigint, digest binary, keys array<bigint>")
    one = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    return materialise(one.withColumn("id", F.monotonically_increasing_id()), "signatures")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, bag)`` of the texts whose digests are ``wanted(id, digest)``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(t).view(np.int32) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            bags = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), bags], ["id", "bag"])

    # The row that stands for a text is known, so only that row's text is moved.
    rows = docs.select("doc_id", "text", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"))
    texts = rows.join(wanted, (rows["digest"] == wanted["_digest"]) & rows["doc_id"].eqNullSafe(wanted["first"])).select("id", "text")
    return materialise(texts.dropDuplicates(["id"]).mapInArrow(gather, "id bigint, bag array<int>"), "bags")


def _compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for one, other in zip(batch.column("bag_a"), batch.column("bag_b")):
                x, y = one.values.to_numpy(), other.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                sims.append(common / union if union else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    side = lambda end: bags.select(F.col("id").alias(end), F.col("bag").alias(f"bag_{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a bigint, b bigint, sim double")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, class_id)`` for each row of ``docs(doc_id, text)``; a class is named by its smallest id."""
    docs = docs.select("doc_id", full_text("text").alias("text"))
    signed = _signed(docs)
    buckets, rows = shared_buckets(signed.select("id", F.explode(F.array_distinct("keys")).alias("key")))
    wanted = signed.join(buckets.select("id").distinct(), "id", "left_semi").select("id", F.col("digest").alias("_digest"), "first")
    bags = _bags(docs, wanted)
    labels = linked_components(buckets, rows, bags, lambda pairs: _compared(pairs, bags), least)
    of_text = signed.select("id", "digest", "first")
    if labels is None:
        named = of_text.select("digest", F.col("first").alias("class_id"))
    else:
        grouped = of_text.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        names = grouped.groupBy("label").agg(F.min("first").alias("class_id"))
        named = lookup(grouped, names, ["label"], "id").select("digest", "class_id")
    every = docs.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"))
    return lookup(every, materialise(named, "classes"), ["digest"], "doc_id").select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each class; the same columns."""
    rid = fresh(docs, "_rid")
    stored = with_row_ids(docs, rid)
    classes = near_classes(stored.select(F.col(rid).alias("doc_id"), "text"), least)
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias(rid))
    # Both sides are moved at every size; a broadcast would stop being one as the rows grow.
    return stored.join(kept.hint("merge"), rid, "left_semi").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(documents(spark, folder))
