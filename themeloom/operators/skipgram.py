"""Word vectors without a table of all words in one place: skip-gram in shards of documents.

As in MLlib's Word2Vec each task trains on its own documents, and the vectors of a word are
averaged after each pass. Here a task holds the words of its shard only. They reach it by a
shuffle, start as signs of the word's digest, which are the same in every shard, and are averaged
by another shuffle, weighted by how often the shard holds the word. A word is told from words
drawn at random (negative sampling), since a Huffman tree would need all words at once.

Documents are dealt to shards at random, so neither copies nor repeated ids gather in one; a
shard has about ``TOKENS_PER_SHARD`` words or one longer document. Words found fewer than
``min_count`` times in all documents are left out before windows are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vectors as v
from themeloom.session import materialise

TOKENS_PER_SHARD = 4_000_000
WINDOW = 5
NEGATIVES = 5  # words drawn for each pair of neighbours
DRAWN = 64  # words drawn for all pairs of a step, weighted to count as NEGATIVES
STEPS, STEP = 1_000, (50, 2_000)  # steps of a pass, and the bounds of the words whose windows make one
RATE = 0.1
_SHARD = "_shard"


def sharded(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    return materialise(docs.withColumn(_SHARD, F.floor(F.rand(seed) * shards).cast("int")), "shards")


def shard_words(held: DataFrame, min_count: int) -> DataFrame:
    """``(_shard, term, n)``: the words of each shard that all documents together hold often enough."""
    tokens = held.select(_SHARD, F.explode("tokens").alias("term")).filter("term is not null")
    local = materialise(tokens.groupBy(_SHARD, "term").agg(F.count("*").alias("n")), "shard-words")
    often = local.groupBy("term").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_count).select("term")
    return materialise(local.join(often, "term").select(_SHARD, "term", "n"), "shard-vocabulary")


def trained(held: DataFrame, words: DataFrame, dim: int, seed: int, passes: int) -> DataFrame:
    """``(term, x)``: the vector of each word after ``passes`` passes over ``held(_shard, tokens)``."""
    tokens = held.select(_SHARD, "tokens")
    vectors = None
    for number in range(passes):
        sides = ["x"] if number + 1 == passes else ["x", "y"]
        known = words if vectors is None else words.join(vectors, "term")
        fields = "".join(f", {side} array<float>" for side in sides)
        together = tokens.groupBy(_SHARD).cogroup(known.groupBy(_SHARD))
        parts = together.applyInArrow(_trainer(dim, seed, number, sides), f"term string, n bigint{fields}")
        mean = lambda side: F.array(*[F.sum(F.get(side, F.lit(i)) * F.col("n")) / F.sum("n") for i in range(dim)])
        # Moved as they are: sums of 8 bytes a number would take twice the room, and few words meet in one task before.
        vectors = materialise(parts.repartition("term").groupBy("term").agg(*[mean(side).cast("array<float>").alias(side) for side in sides]), "word-vectors")
    return vectors.select("term", "x")


def with_means(held: DataFrame, words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``held`` without its shard and with ``embedding``: the mean of its words' vectors, at length 1."""
    known = words.select(_SHARD, "term").join(vectors, "term")
    fields = held.drop(_SHARD).withColumn("embedding", F.lit(None).cast("array<double>")).schema
    return held.groupBy(_SHARD).cogroup(known.groupBy(_SHARD)).applyInArrow(lambda left, right: _means(left, right, dim), fields)


def _found(documents: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(word, document)`` of all words in ``terms``, as they stand."""
    words, places = [], []
    begin = 0
    for chunk in documents.column("tokens").chunks:
        at = pc.index_in(pc.list_flatten(chunk), value_set=terms)
        kept = at.is_valid()
        words.append(at.filter(kept).to_numpy(zero_copy_only=False).astype("i8"))
        places.append(pc.list_parent_indices(chunk).filter(kept).to_numpy(zero_copy_only=False).astype("i8") + begin)
        begin += len(chunk)
    none = np.zeros(0, "i8")
    return np.concatenate([none, *words]), np.concatenate([none, *places])


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return v.matrix_of(table.column(name).combine_chunks()).astype("f4")


def _rows(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype="i4") * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.astype("f4").ravel()))


def start(terms: pa.Array, dim: int, seed: int) -> np.ndarray:
    """The vectors that words begin with, the same wherever a word is found."""
    named = pc.binary_join_element_wise(pa.scalar(str(seed)), terms, " ")
    blocks = [v.signs(v.digests_of(pc.binary_join_element_wise(named, pa.scalar(str(k)), " ")), min(v.MAX_HASH_DIM, dim - k)) for k in range(0, dim, v.MAX_HASH_DIM)]
    return (np.concatenate(blocks, axis=1) * (0.5 / dim)).astype("f4")


def _trainer(dim: int, seed: int, number: int, sides: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    return lambda key, documents, words: _train(key[0].as_py(), documents, words, dim, seed, number, sides)


def _train(shard: int, documents: pa.Table, words: pa.Table, dim: int, seed: int, number: int, sides: list[str]) -> pa.Table:
    names = ["term", "n", *sides]
    if not words.num_rows:
        empty = pa.array([], pa.list_(pa.float32()))
        return pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), *[empty] * len(sides)], names)
    words = words.sort_by("term")  # a shuffle has no order, and a rerun should agree
    terms = words.column("term").combine_chunks()
    n = words.column("n").to_numpy()
    first = "x" not in words.column_names
    x = start(terms, dim, seed) if first else _matrix(words, "x")
    y = np.zeros_like(x) if first else _matrix(words, "y")
    word, place = _found(documents, terms)
    descend(x, y, word, place, n, np.random.default_rng([seed, number, shard]))
    return pa.table([terms, words.column("n"), *[_rows(m) for m in (x, y)[: len(sides)]]], names)


def _pairs(word: np.ndarray, place: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(centre, neighbour)`` of a step's centres at a time; ``reach`` is how far each one's window goes."""
    step = min(max(len(word) // STEPS, STEP[0]), STEP[1])
    for a in range(0, len(word), step):
        b = min(a + step, len(word))
        centres, others = [], []
        for far in range(1, WINDOW + 1):
            at = a + np.flatnonzero(reach[a:b] >= far)
            for other in (at - far, at + far):
                inside = (other >= 0) & (other < len(word))
                one, two = at[inside], other[inside]
                same = place[one] == place[two]
                centres.append(word[one[same]])
                others.append(word[two[same]])
        yield np.concatenate(centres), np.concatenate(others)


def descend(x: np.ndarray, y: np.ndarray, word: np.ndarray, place: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over a shard's words, in place; steps shrink by what a word has moved already (AdaGrad by rows)."""
    chance = np.cumsum(n.astype("f8") ** 0.75)
    moved_x, moved_y = np.zeros(len(x), "f4"), np.zeros(len(y), "f4")
    reach = rng.integers(1, WINDOW + 1, len(word))

    def move(matrix: np.ndarray, moved: np.ndarray, rows: np.ndarray, by: np.ndarray) -> None:
        moved[rows] += (by * by).mean(axis=1)
        matrix[rows] -= RATE * by / np.sqrt(moved[rows] + 1e-12)[:, None]

    for centre, other in _pairs(word, place, reach):
        if not len(centre):
            continue
        order = np.argsort(centre, kind="stable")
        centre, other = centre[order], other[order]
        begins = np.flatnonzero(np.diff(centre, prepend=-1))
        rows, times = centre[begins], np.diff(np.append(begins, len(centre)))
        drawn = np.searchsorted(chance, rng.random(DRAWN) * chance[-1], side="right").clip(max=len(n) - 1)
        xs, ys, ns = x[centre], y[other], y[drawn]
        miss = -1 / (1 + np.exp(np.einsum("ij,ij->i", xs, ys)))
        wrong = (NEGATIVES / DRAWN) * times[:, None] / (1 + np.exp(-(x[rows] @ ns.T)))
        by_x = np.add.reduceat(ys * miss[:, None], begins, axis=0) + wrong @ ns
        taken = np.concatenate([other, drawn])
        by_y = np.concatenate([xs * miss[:, None], wrong.T @ x[rows]])
        order = np.argsort(taken, kind="stable")
        begins = np.flatnonzero(np.diff(taken[order], prepend=-1))
        move(y, moved_y, taken[order][begins], np.add.reduceat(by_y[order], begins, axis=0).astype("f4"))
        move(x, moved_x, rows, by_x.astype("f4"))


def _means(documents: pa.Table, words: pa.Table, dim: int) -> pa.Table:
    count = documents.num_rows
    sums = np.zeros((count, dim))
    if words.num_rows and count:
        words = words.sort_by("term")
        word, place = _found(documents, words.column("term").combine_chunks())
        x = _matrix(words, "x")
        for s in v.slices(len(word), dim):
            begins = np.flatnonzero(np.diff(place[s], prepend=-1))
            sums[place[s][begins]] += np.add.reduceat(x[word[s]].astype("f8"), begins, axis=0)
    kept = sums.any(axis=1)
    return documents.drop_columns([_SHARD]).append_column("embedding", v.lists_of(v.unit_rows(sums[kept]), kept))
