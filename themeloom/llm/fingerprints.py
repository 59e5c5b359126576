"""Document fingerprints from prefix polynomial hashes.

With ``P[i]`` the sum of ``c[j] * B**j`` over the code points before place i, modulo a prime,
the hash of any span is ``(P[j] - P[i]) * B**-i``: equal spans have equal hashes wherever they
stand. Two such hashes, of two bases, make 62 bits. They answer whether two spans are equal
and, by binary search, how far two texts agree from given places on.

A fingerprint names the length and the hash of the whole text and keeps the ``KEPT`` smallest
mixed hashes of all its spans of ``SPAN`` code points. The likeness of two fingerprints is
estimated from those: 2J / (1 + J) with J the share of common ones among the smallest of both,
which is the share of spans the texts have in common; equal fingerprints have 1.

Nulls: a null text is empty. A text shorter than a span has one span, the whole of it; an empty
one has none, is like another empty one (1) and unlike any other (0). Very long texts are
hashed whole. Rows with the same id follow each other by text; repeated rows are kept. The
document after the last is the first. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.arrays import let
from themeloom.llm.common import documents, full_text

PRIME = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 1_566_083_941)
SPAN = 16
KEPT = 48
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, same_prefix bigint, same_prefix_next bigint"
)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base and of its inverse, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.inverse = base % int(PRIME), pow(base, -1, int(PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, _mod(self.up * np.uint64(pow(self.base, k, int(PRIME))))))
            self.down = np.concatenate((self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(PRIME))))))
        return self


_powers = tuple(Powers(base) for base in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for power in _powers:
            terms = _mod((points + np.uint64(1)) * power.upto(self.n + 1).up[: self.n])
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # below 2**64 for 2**33 code points
            self.sums.append(_mod(sums))

    def span(self, begin: int, end: int) -> tuple[int, int]:
        """The hash of one span, the same wherever the span stands."""
        p = int(PRIME)
        return tuple((int(s[end]) - int(s[begin])) * int(w.down[begin]) % p for s, w in zip(self.sums, _powers))

    def spans(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of a length."""
        count = self.n - length + 1
        one, two = (_mod((s[length:] + PRIME - s[:count]) * w.down[:count]) for s, w in zip(self.sums, _powers))
        return (one << np.uint64(31)) | two


def extension(a: Prefixes, b: Prefixes, at: int = 0, of: int = 0) -> int:
    """How many code points agree from place ``at`` of one and ``of`` the other on."""
    low, high = 0, min(a.n - at, b.n - of)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(at, at + middle) == b.span(of, of + middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(text: Prefixes) -> np.ndarray:
    """The smallest mixed hashes of the distinct spans, in order."""
    if text.n == 0:
        return np.zeros(0, np.uint64)
    found = text.spans(min(SPAN, text.n))
    found = (found ^ (found >> np.uint64(30))) * _MIX[0]
    found = (found ^ (found >> np.uint64(27))) * _MIX[1]
    if len(found) > 8 * KEPT:
        few = np.unique(np.partition(found, 2 * KEPT)[: 2 * KEPT])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(found)[:KEPT]


def shown(text: Prefixes, kept: np.ndarray) -> str:
    whole = text.span(0, text.n)
    return f"{text.n:x}:{whole[0]:08x}{whole[1]:08x}:" + kept.astype(">u8").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray, equal: bool) -> float:
    if equal:
        return 1.0
    if not len(one) or not len(other):
        return 0.0
    both = np.union1d(one, other)[:KEPT]
    common = np.intersect1d(one, other, assume_unique=True)
    j = len(np.intersect1d(both, common, assume_unique=True)) / len(both)
    return 2 * j / (1 + j)


def _bucket(doc_id: str, bounds: list[int]) -> Column:
    """How many bounds are at most the id, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    listed = F.expr("array(" + ", ".join("array(" + ", ".join(f"{b}L" for b in g) + ")" for g in groups) + ")")
    key = F.coalesce(F.col(doc_id), F.lit(-(2**63) + 1).cast("bigint"))
    group = F.size(F.filter(listed, lambda g: F.get(g, F.lit(0)) <= key)) - 1
    inside = let(group, lambda g: F.when(g < 0, 0).otherwise(g * wide + F.size(F.filter(F.get(listed, g), lambda b: b <= key))))
    return inside


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``RESULT`` for ``docs(doc_id, text)``, each document compared with its edited text and its successor.

    Rows are dealt by ranges of ids; the first row of a range is also given to the range
    before it, where it follows the last, so texts are moved once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", full_text("text").alias("text"))
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(c) for c in cuts]), F.lit(100 * buckets)).alias("b")).head()["b"]
    bounds = sorted(set(found or []))
    placed = docs.withColumn("bucket", _bucket("doc_id", bounds).cast("int"))
    # The first row of each range: one id a range, then the texts of those ids only.
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f"))
    heads = sorted((r["bucket"], r["f"]["doc_id"]) for r in firsts.collect())  # as many rows as ranges
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}  # the first follows the last
    ids = [i for _, i in heads if i is not None]
    chosen = docs.filter(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if len(ids) < len(heads) else F.lit(False)))
    known = F.expr("map(" + ", ".join(f"{b}, {to}" for b, to in before.items()) + ")") if before else F.lit(None)
    sentinel = (
        chosen.groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .withColumn("bucket", F.element_at(known, _bucket("doc_id", bounds).cast("int")) if before else F.lit(0))
    )
    rows = placed.withColumn("extra", F.lit(False)).unionByName(sentinel.withColumn("extra", F.lit(True)).select("doc_id", "text", "bucket", "extra"))
    dealt = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "extra", "doc_id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a document that waits for the next
        out: list[dict] = []
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                points = code_points(text)
                own = Prefixes(points)
                kept = sketch(own)
                now = (bucket, extra, doc_id, points, own, kept, shown(own, kept))
                if held is not None:
                    out.append(_compared(held, now))
                held = None if extra else now
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow())
                out = []

    return dealt.mapInArrow(hashed, RESULT)


def _compared(one: tuple, after: tuple) -> dict:
    _, _, doc_id, points, own, kept, name = one
    n = len(points)
    edited = np.concatenate((points[: n - n // 2], after[3][: n // 2]))
    theirs = Prefixes(edited)
    few = sketch(theirs)
    edited_name = shown(theirs, few)
    raw = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return {
        "doc_id": doc_id,
        "n_chars": n,
        "edited_sha256": hashlib.sha256(raw).hexdigest(),
        "fingerprint": name,
        "edited_fingerprint": edited_name,
        "near_edited": likeness(kept, few, name == edited_name),
        "near_next": likeness(kept, after[5], name == after[6]),
        "same_prefix": extension(own, theirs),
        "same_prefix_next": extension(own, after[4]),
    }


def _arrow() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in RESULT.split(","))])


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))
