"""Benchmark decontamination: every passage of every document against an index of test items.

The items form an inverted index with BM25 impacts, divided by the item's score against itself,
so 1 is a passage that holds all its words. Items are sorted by that score and cut into blocks;
the index keeps each term's largest impact over all items, over each block, and by item. A
passage is a query for all items above a threshold: bounds are added up over all items first,
then over the blocks of passages that could still reach the threshold, and only blocks that
could are scored exactly (block-max pruning, without loss). What remains is verified by words:
the item is aligned (longest common subsequence) with the stretch around the passage, a quarter
longer than itself, that holds most of its words; ``OVERLAP`` of its words have to be found in
order. An item under ``ALIGNED`` words is verified by its five-word shingles alone. The question
of an item, if it has five words, is in the index by itself too, so that it is found with
another answer or none.

Passages are windows that overlap by half and are twice as long as the longest item of a class
of lengths (doubling from ``SHORTEST`` words), so an item lies whole in some window. Every word
of every document is in one. The index of one run is bounded by ``INDEX_BYTES`` of item text;
a larger benchmark is dealt to several indexes, each of which meets all documents.

Results: one row for each document and item it holds. Null or empty texts and items without
words match nothing; an item of under five words is its own shingle. Where only the question is
found, ``bm25`` and ``self_share`` are the question's. Copies of an item are
found as items of their own; repeated documents give repeated rows. Empty tables give an
empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, full_text
from themeloom.llm.token_counts import in_bytes
from themeloom.operators.joins import lookup
from themeloom.session import materialise

THRESHOLD = 0.5  # of an item's score against itself
OVERLAP = 0.8  # of the words of an item, or of its question
SHINGLE = 5
ALIGNED = 10  # words from which on some may be changed
SHORTEST = 64
BLOCK = 16
K1, B = 1.2, 0.75
INDEX_BYTES = 16 << 20
CELLS = 1 << 20  # passages times blocks whose bounds are added up at a time
WORD = re.compile(r"\w+")
ANSWER = re.compile(r"(?s)^(.*[.!?:])\s+(\S.*)$")

RESULT = "doc_id bigint, item_id bigint, bm25 double, self_share double, question_overlap double, answer_overlap double"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence answers the ones before."""
    cut = ANSWER.match(text.strip())
    if cut and words(cut.group(1)) and words(cut.group(2)):
        return words(cut.group(1)), words(cut.group(2))
    return words(text), []


class Index:
    """An index of items ``(item_id, question words, answer words, {term: df})``."""

    def __init__(self, items: list[tuple], n: int, mean: float):
        def impact(tf: int, df: int, length: int) -> float:
            return float(np.log1p((n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

        scored = []
        for number, (item_id, question, answer, dfs) in enumerate(items):
            whole = (question + answer, False)
            for wanted, asked_only in [whole, (question, True)] if answer and len(question) >= SHINGLE else [whole]:
                if wanted:
                    weights = {w: impact(x, dfs[w], len(wanted)) for w, x in Counter(wanted).items()}
                    scored.append((sum(weights.values()), item_id, question, answer, weights, number, asked_only))
        classes: dict[int, list] = {}
        for row in scored:
            length = SHORTEST
            while length < len(row[2]) + (0 if row[6] else len(row[3])):
                length *= 2
            classes.setdefault(length, []).append(row)
        self.classes = [Class(length, sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3], r[6]))) for length, rows in sorted(classes.items())]


class Class:
    """The items of one class of lengths."""

    def __init__(self, length: int, rows: list[tuple]):
        self.length = length
        self.items = [(item_id, question, answer) for _, item_id, question, answer, *_ in rows]
        self.number = [row[5] for row in rows]
        self.asked_only = [row[6] for row in rows]
        self.own = np.array([row[0] for row in rows])
        self.shingles = [_shingles(q if only else q + a) for (_, q, a), only in zip(self.items, self.asked_only)]
        self.term = {w: i for i, w in enumerate(sorted({w for row in rows for w in row[4]}))}
        postings = sorted((self.term[w], i, x / row[0]) for i, row in enumerate(rows) for w, x in row[4].items())
        term, item, share = (np.array(x) for x in zip(*postings))
        self.item, self.share = item.astype(np.int64), share.astype(float)
        self.item_at = np.searchsorted(term, np.arange(len(self.term) + 1))
        block = term * (len(rows) // BLOCK + 1) + self.item // BLOCK
        pairs, first = np.unique(block, return_index=True)
        self.blocks = len(rows) // BLOCK + 1
        self.block = pairs % self.blocks
        self.block_most = np.maximum.reduceat(self.share, first)
        self.pair_at = np.append(first, len(term))
        self.block_at = np.searchsorted(pairs // self.blocks, np.arange(len(self.term) + 1))
        self.most = np.maximum.reduceat(self.share, self.item_at[:-1])

    def candidates(self, lengths: list[int], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, place, item, share)`` of all passages and items that reach the threshold.

        ``terms`` are the term numbers of all documents' words, -1 for words not in the index.
        """
        length = np.array(lengths, np.int64)
        doc = np.repeat(np.arange(len(length)), length)
        start = np.repeat(np.cumsum(length) - length, length)
        at = np.flatnonzero(terms >= 0)
        piece = (np.arange(len(terms)) - start)[at] // self.length
        pieces = np.maximum(1, -(-length // self.length))
        base = np.cumsum(pieces) - pieces
        here, term = base[doc[at]] + piece, terms[at].astype(np.int64)
        # A passage is a piece and the next one; the last piece of a document closes the one before.
        front = piece > 0
        passage = np.concatenate((here, here[front] - 1))
        key = _distinct(passage * len(self.term) + np.concatenate((term, term[front])))
        passage, term = key // len(self.term), key % len(self.term)
        bound = np.bincount(passage, self.most[term], int(pieces.sum()))
        alive = bound[passage] >= THRESHOLD
        passage, term = passage[alive], term[alive]
        found = [self._scored(passage[a:b], term[a:b]) for a, b in _ranges(passage, max(1, CELLS // self.blocks))]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0)
        passage, item, share = (np.concatenate(x) for x in zip(*found))
        of = np.searchsorted(base, passage, side="right") - 1
        return of, (passage - base[of]) * self.length, item, share

    def _scored(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(passage, item, share)`` at the threshold or above; passages ascend and their range is short."""
        low = passage[0]
        row, pair = _spread(self.block_at, term)
        cell = (passage[row] - low) * self.blocks + self.block[pair]
        reach = np.bincount(cell, self.block_most[pair]) >= THRESHOLD
        kept = reach[cell]
        cell, pair = cell[kept], pair[kept]
        live = np.flatnonzero(reach)
        rank = np.cumsum(reach) - 1
        entry, posting = _spread(self.pair_at, pair)
        share = np.bincount(rank[cell[entry]] * BLOCK + self.item[posting] % BLOCK, self.share[posting])
        found = np.flatnonzero(share >= THRESHOLD)
        at = live[found // BLOCK]
        return low + at // self.blocks, at % self.blocks * BLOCK + found % BLOCK, share[found]

    def verified(self, text: list[str], place: int, item: int) -> tuple[float, float] | None:
        """Found shares of the question and the answer, if the item, or the question alone, is there."""
        _, question, answer = self.items[item]
        shingles, asked_only = self.shingles[item], self.asked_only[item]
        wanted = question if asked_only else question + answer
        size = len(shingles[0])
        around = text[max(0, place - self.length) : place + 3 * self.length]
        there = set(zip(*(around[k:] for k in range(size))))
        covered = np.zeros(len(wanted), bool)
        for k, shingle in enumerate(shingles):
            if shingle in there:
                covered[k : k + size] = True
        enough = covered.mean() >= OVERLAP
        if not enough and len(wanted) < ALIGNED:
            return None
        begin, end = _fullest(around, wanted)
        here = around[begin:end]
        if not enough and _in_order(wanted, here) < OVERLAP * len(wanted):
            return None
        if asked_only:
            here = around[begin : end + len(answer) + len(answer) // 4]
        asked = max(float(covered[: len(question)].mean()), _in_order(question, here) / len(question))
        answered = _in_order(answer, here) / len(answer) if answer else 1.0
        return asked, max(answered, float(covered[len(question) :].mean())) if answer and not asked_only else answered


def _fullest(around: list[str], wanted: list[str]) -> tuple[int, int]:
    """The stretch, a quarter longer than ``wanted``, that holds the most of its words."""
    length = len(wanted) + len(wanted) // 4
    left = Counter(wanted)
    held, most, end = 0, -1, 0
    for k, word in enumerate(around):
        if word in left:
            held += left[word] > 0
            left[word] -= 1
        if k >= length and (gone := around[k - length]) in left:
            left[gone] += 1
            held -= left[gone] > 0
        if held > most:
            most, end = held, k + 1
    # The last word of the stretch is one of ``wanted``; it begins as far before as that leaves room.
    return max(0, end - length), min(len(around), max(end, length))


def _in_order(wanted: list[str], here: list[str]) -> int:
    """The length of the longest common subsequence, a bit for each word of ``wanted``."""
    places: dict[str, int] = {}
    for k, word in enumerate(wanted):
        places[word] = places.get(word, 0) | 1 << k
    every = (1 << len(wanted)) - 1
    row = every
    for word in here:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & every
    return len(wanted) - row.bit_count()


def _spread(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``term`` its postings: places repeated, and posting numbers."""
    count = at[term + 1] - at[term]
    row = np.repeat(np.arange(len(term)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[term], count)


def _distinct(key: np.ndarray) -> np.ndarray:
    """The distinct keys in order; sorting numbers beats hashing them."""
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _ranges(passage: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ends of the runs of a sorted ``passage`` that span at most ``width`` numbers."""
    begin = 0
    while begin < len(passage):
        end = int(np.searchsorted(passage, passage[begin] + width))
        yield begin, end
        begin = end


def _shingles(every: list[str]) -> list[tuple]:
    size = min(SHINGLE, len(every))
    return [tuple(every[k : k + size]) for k in range(len(every) - size + 1)]


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes over ``items(item_id, text)``, of ``INDEX_BYTES`` of text each; document frequencies are of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text", "key"))):
                question, answer = parts(text)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key], pa.int64()),
                        "item_id": pa.array([item_id], pa.int64()),
                        "question": pa.array([question], pa.list_(pa.string())),
                        "answer": pa.array([answer], pa.list_(pa.string())),
                    }
                )

    keyed = items.select("item_id", full_text("text").alias("text"), F.monotonically_increasing_id().alias("key"))
    stored = materialise(keyed.mapInArrow(cut, "key bigint, item_id bigint, question array<string>, answer array<string>"), "items")
    every = F.concat("question", "answer")
    size = stored.agg(
        F.count(F.when(F.size(every) > 0, 1)).alias("n"),
        F.sum(F.size(every)).alias("words"),
        F.sum(F.length(F.array_join(every, " ")) + 1).alias("bytes"),
    ).head()
    if not size["n"]:
        return
    terms = stored.select("key", F.explode(F.array_distinct(every)).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    with_df = lookup(terms, counts, ["term"], "key").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    ready = materialise(stored.join(with_df, "key"), "postings")
    shards = -(-size["bytes"] // INDEX_BYTES)
    for s in range(shards):
        rows = ready.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).collect()  # about INDEX_BYTES
        yield Index([(r["item_id"], r["question"], r["answer"], r["df"]) for r in rows], size["n"], size["words"] / size["n"])


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``RESULT`` for ``docs(doc_id, text)`` and ``items(item_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", full_text("text").alias("text"))
    out = spark.createDataFrame([], RESULT)
    for index in indexes(items):
        out = out.unionByName(_matched(docs, spark.sparkContext.broadcast(index)))  # bounded by INDEX_BYTES
    return out


def _matched(docs: DataFrame, shared) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in in_bytes(batch.column("text").to_pylist(), 2 << 20):
                found = _hits(index, ids[at : at + len(texts)], texts)
                at += len(texts)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_arrow())

    return docs.mapInArrow(match, RESULT)


def _hits(index: Index, ids: list, texts: list[str]) -> list[dict]:
    cut = [words(t) for t in texts]
    lengths = [len(c) for c in cut]
    every = [w for c in cut for w in c]
    best: dict[tuple[int, int], tuple] = {}  # by document and item, the whole item before its question
    for group in index.classes:
        number = group.term.get
        terms = np.fromiter(map(number, every, repeat(-1)), np.int32, len(every))
        for doc, place, item, share in zip(*(x.tolist() for x in group.candidates(lengths, terms))):
            key, rank = (doc, group.number[item]), (not group.asked_only[item], share)
            if key in best and best[key][0] >= rank:
                continue
            overlap = group.verified(cut[doc], place, item)
            if overlap:
                best[key] = rank, {
                    "doc_id": ids[doc],
                    "item_id": group.items[item][0],
                    "bm25": share * float(group.own[item]),
                    "self_share": share,
                    "question_overlap": overlap[0],
                    "answer_overlap": overlap[1],
                }
    return [row for _, row in best.values()]


def _arrow() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in RESULT.split(","))])


def _holds_item(shared):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        out: list[bool] = []
        for some in in_bytes(texts.tolist(), 2 << 20):
            hit = {row["doc_id"] for row in _hits(shared.value, list(range(len(some))), some)}
            out += [k in hit for k in range(len(some))]
        return pd.Series(out, dtype=bool)

    return holds


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; the same columns.

    Each index drops the rows it matches as they pass, so no row is moved.
    """
    spark = docs.sparkSession
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)  # bounded by INDEX_BYTES

        docs = docs.filter(~_holds_item(shared)(full_text("text")))
    return docs


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
