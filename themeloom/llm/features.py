"""Hashed words and word pairs of a text, and their document counts by class."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")
STEMS = (4, 5, 6, 7, 8)  # letters of a word that count as its stem
MARK = zlib.crc32(b"^")  # begins the name of a stem
KEPT = 600_000  # words that a task remembers something of
KEPT_HASHES = 150_000  # words whose hash it remembers; another one costs little


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEPT_HASHES:
            self[word] = value
        return value


_hashes = _Hashes()


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def word_features(word: str, bits: int) -> list[int]:
    """The features of one word: itself and its first letters, whose checksum goes on from that of fewer."""
    raw = word.encode("utf-8", "surrogatepass")
    sums = [zlib.crc32(raw)]
    so_far, at = MARK, 0
    for n in STEMS:
        if len(word) <= n:
            break
        part = raw[at:n] if len(raw) == len(word) else word[at:n].encode("utf-8", "surrogatepass")
        so_far, at = zlib.crc32(part, so_far), n
        sums.append(so_far)
    return [(s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits) for s in sums]


class PerChunk(dict):
    """What ``make`` says of a run of characters without white space, remembered for a bounded number."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, chunk: str) -> object:
        value = self.make(chunk)
        if len(self) < KEPT:
            self[chunk] = value
        return value

    def of(self, chunks: Iterable[str]) -> set:
        """The different answers for some chunks."""
        return set(map(self.__getitem__, chunks))


def stems(text: str, bits: int, known: dict[int, PerChunk] = {}) -> np.ndarray:  # noqa: B006
    """The distinct features of a text's words and of their first letters, ascending."""
    if bits not in known:
        known[bits] = PerChunk(lambda chunk: tuple(f for word in tokens(chunk) for f in word_features(word, bits)))
    flat = list(chain.from_iterable(known[bits].of(text.lower().split())))
    return np.unique(np.array(flat, np.int64))


def ngrams(text: str, bits: int) -> np.ndarray:
    """The distinct features of single tokens and of pairs, ascending.

    A token that follows itself is the same feature whichever token it is.
    """
    found = tokens(text)
    raw = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    pairs = (raw[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (raw[1:] + np.uint64(0x165667B19E3779F9))
    pairs[raw[:-1] == raw[1:]] = np.uint64(0x27D4EB2F165667C5)
    every = np.concatenate((raw, pairs)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((every >> np.uint64(64 - bits)).astype(np.int64))


def class_counts(rows: DataFrame, bits: int, extract) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays over all features: the sums of ``weight`` and of ``1 - weight`` of the rows that hold one.

    ``rows(text, weight)``; each task adds up its rows, so a task sends 2**bits numbers at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, zero = np.zeros(1 << bits), np.zeros(1 << bits)
        for batch in batches:
            for text, weight in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist()):
                held = extract(text, bits)
                one[held] += weight
                zero[held] += 1.0 - weight
        seen = np.flatnonzero(one + zero)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(one[seen]), pa.array(zero[seen])], ["feature", "one", "zero"])

    sums = (
        rows.select("text", "weight")
        .mapInArrow(count, "feature bigint, one double, zero double")
        .groupBy("feature")
        .agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
        .toArrow()  # 2**bits rows at most
    )
    at = sums.column("feature").to_numpy()
    one, zero = np.zeros(1 << bits), np.zeros(1 << bits)
    one[at], zero[at] = sums.column("one").to_numpy(), sums.column("zero").to_numpy()
    return one, zero


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
