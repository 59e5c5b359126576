"""Dense vector arithmetic on ``array<double>`` columns.

Spark has no matrix product for array columns, and higher-order functions box every number.
These Arrow functions see a whole batch at once as a NumPy matrix; each one closes over at
most a small matrix (the topic vectors) and is narrow. A null vector gives a null result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.arrays import RANK_DIGITS

HASH_DIM = 64
MAX_HASH_DIM = 128  # bits of the digest of a word
_CELLS = 4_000_000  # numbers held at once while a batch is worked through


def vector_function(returns: str) -> Callable:
    """An Arrow function that is computed once, where it is written.

    Marked as non-deterministic, since the optimizer otherwise repeats it in the filters it
    derives from a result (and cannot run those when the arguments hold lambdas).
    """
    return lambda body: F.arrow_udf(returns)(body).asNondeterministic()


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """The non-null vectors of a batch as rows; they must all have one length."""
    n = len(vectors) - vectors.null_count
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def lists_of(rows: np.ndarray, kept: np.ndarray) -> pa.Array:
    """A batch with ``rows`` at the places where ``kept`` holds and null elsewhere."""
    width = rows.shape[1] if len(rows) else 0
    ends = np.cumsum(kept * width)
    offsets = pa.array(np.concatenate([[0], ends]).astype("i4"))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()), mask=pa.array(~kept))


def present(vectors: pa.Array) -> np.ndarray:
    return vectors.is_valid().to_numpy(zero_copy_only=False).astype(bool)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def unit(vector: Column) -> Column:
    """The vector at length 1; null for an all-zero vector."""

    @vector_function("array<double>")
    def scale(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors)
        nonzero = rows.any(axis=1) if len(rows) else np.zeros(0, bool)
        kept = present(vectors)
        kept[kept] = nonzero
        return lists_of(unit_rows(rows[nonzero]), kept)

    return scale(as_doubles(vector))


def cosines(vector: Column, topics: np.ndarray) -> Column:
    """Cosine to each row of ``topics``, as an array in that order."""
    targets = unit_rows(np.asarray(topics, dtype="f8")).T

    @vector_function("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        rows = unit_rows(matrix_of(vectors))
        parts = [rows[s] @ targets for s in slices(len(rows), targets.shape[1])]
        return lists_of(np.concatenate(parts) if parts else rows, present(vectors))

    return score(as_doubles(vector))


def nearest(vector: Column, ids: list[int], topics: np.ndarray) -> Column:
    """``struct<topic, score>`` of the topic with the highest cosine; the lowest id wins a tie."""
    order = np.argsort(ids)
    numbers = np.asarray(ids, dtype="i4")[order]
    targets = unit_rows(np.asarray(topics, dtype="f8"))[order].T

    @vector_function("struct<topic:int,score:double>")
    def best(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors)
        kept = present(vectors)
        nonzero = rows.any(axis=1) if len(rows) else np.zeros(0, bool)
        kept[kept] = nonzero  # a zero vector is near no topic
        rows = unit_rows(rows[nonzero])
        topic = np.full(len(vectors), -1, dtype="i4")
        score = np.zeros(len(vectors))
        at = np.flatnonzero(kept)
        for s in slices(len(rows), targets.shape[1]):
            found = rows[s] @ targets
            first = np.round(found, RANK_DIGITS).argmax(axis=1)
            topic[at[s]] = numbers[first]
            score[at[s]] = found[np.arange(len(first)), first]
        return pa.StructArray.from_arrays(
            [pa.array(topic), pa.array(score)], names=["topic", "score"], mask=pa.array(~kept)
        )

    return best(as_doubles(vector))


def softmax_to(vector: Column, topics: np.ndarray, temperature: float) -> Column:
    """Softmax over the topics of ``-|x - c|^2 / temperature``, as an array in topic order."""
    targets = np.asarray(topics, dtype="f8")
    lengths = (targets * targets).sum(axis=1)

    @vector_function("array<double>")
    def share(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors)
        parts = []
        for s in slices(len(rows), len(targets)):
            x = rows[s]
            logit = (2.0 * x @ targets.T - lengths - (x * x).sum(axis=1, keepdims=True)) / temperature
            weight = np.exp(logit - logit.max(axis=1, keepdims=True))
            parts.append(weight / weight.sum(axis=1, keepdims=True))
        return lists_of(np.concatenate(parts) if parts else rows, present(vectors))

    return share(as_doubles(vector))


def squared_distances(vector: Column, topics: np.ndarray) -> Column:
    """Squared distance to each row of ``topics``, as an array in that order."""
    targets = np.asarray(topics, dtype="f8")
    lengths = (targets * targets).sum(axis=1)

    @vector_function("array<double>")
    def apart(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors)
        parts = []
        for s in slices(len(rows), len(targets)):
            x = rows[s]
            parts.append((x * x).sum(axis=1, keepdims=True) + lengths - 2.0 * x @ targets.T)
        return lists_of(np.concatenate(parts) if parts else rows, present(vectors))

    return apart(as_doubles(vector))


def signs(digests: pa.Array, dim: int) -> np.ndarray:
    """One row of +1 / -1 per 16-byte digest: bit j of the digest, highest first."""
    fixed = digests.cast(pa.binary(16))
    raw = np.frombuffer(fixed.buffers()[1], dtype="u1", count=16 * len(fixed), offset=16 * fixed.offset)
    return np.unpackbits(raw.reshape(-1, 16)[:, : (dim + 7) // 8], axis=1)[:, :dim].astype("f8") * 2.0 - 1.0


def digest(word: Column) -> Column:
    return F.unhex(F.md5(word))


def check_hash_dim(dim: int) -> int:
    if not 0 < dim <= MAX_HASH_DIM:
        raise ValueError(f"dim must be between 1 and {MAX_HASH_DIM}")
    return dim


def word_vector(word: Column, dim: int = HASH_DIM) -> Column:
    """The fixed sign vector of a word, at length 1."""
    check_hash_dim(dim)

    @vector_function("array<double>")
    def vector(digests: pa.Array) -> pa.Array:
        kept = present(digests)
        return lists_of(signs(digests.drop_null(), dim) / np.sqrt(dim), kept)

    return vector(digest(word))


def words_of(lists: pa.Array, min_length: int, ordered: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch of token lists, and the word's number and the list of each token.

    Null and shorter tokens are left out. Words are in order, or as they are first found.
    """
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    kept = pc.fill_null(pc.greater_equal(pc.utf8_length(flat), min_length), False)
    owner = np.repeat(np.arange(len(sizes)), sizes)[kept.to_numpy(zero_copy_only=False)]
    coded = flat.filter(kept).dictionary_encode()
    if not ordered:
        return coded.dictionary, coded.indices.to_numpy().astype("i8"), owner
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()], owner


def digests_of(words: pa.Array) -> pa.Array:
    return pa.array([hashlib.md5(word.encode()).digest() for word in words.to_pylist()], pa.binary())


def document_vector(tokens: Column, dim: int = HASH_DIM, min_length: int = 1) -> Column:
    """``struct<vector, length>``: the sum of the sign vectors of a document's words, each times
    ``1 + ln n``, scaled to length 1, and the length it had.

    A random projection of the document's log-count vector: cosines are kept up to noise of
    about ``1 / sqrt(dim)``, and documents and words share one space. Null without words. A
    batch counts its tokens as numbers and hashes a word once.
    """
    check_hash_dim(dim)

    @vector_function("struct<vector:array<double>,length:double>")
    def vector(lists: pa.Array) -> pa.Array:
        words, word, owner = words_of(lists, min_length)
        # Each (document, word) once, a document's words in order.
        pairs, n = np.unique(owner * max(1, len(words)) + word, return_counts=True)
        owner, word = pairs // max(1, len(words)), pairs % max(1, len(words))
        weight = 1.0 + np.log(n)
        digests = digests_of(words)
        out = np.zeros((len(lists), dim))
        ends = np.searchsorted(owner, np.arange(len(lists)), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        first = 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(ends, begins[first] + _CELLS // dim, side="right")))
            span = slice(begins[first], ends[last - 1])
            filled = first + np.flatnonzero(ends[first:last] > begins[first:last])
            if len(filled):
                used, at = np.unique(word[span], return_inverse=True)
                rows = signs(digests.take(pa.array(used)), dim)[at] * weight[span, None]
                out[filled] = np.add.reduceat(rows, begins[filled] - begins[first], axis=0)
            first = last
        nonzero = out.any(axis=1)
        length = pa.array(np.sqrt((out * out).sum(axis=1)))
        return pa.StructArray.from_arrays(
            [lists_of(unit_rows(out[nonzero]), nonzero), length], names=["vector", "length"], mask=pa.array(~nonzero)
        )

    return vector(tokens)
