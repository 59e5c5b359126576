"""Token ids in compressed shards (Re-Pair), with random access by document.

Documents are put in ascending order of their ids (ties by text) by a range partitioning,
encoded, and closed by an end id. A task cuts its documents into shards; a shard holds whole
documents, about ``SHARD_IDS`` ids or one longer document. Within a shard frequent pairs of ids
are replaced by nonterminals, again and again, pairs across a document's end excepted. A shard
is one row of a Parquet folder: rules, expansion lengths, the remaining symbols, and for each
document its id, its number of ids and the place where its symbols end. One document is decoded from its
symbols alone; the expansion lengths find an id inside it.

Nulls: a null text is empty and holds the end id only; a null id comes first. Repeated rows
are kept. An empty table gives an empty folder. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm import tokens
from themeloom.llm.common import documents, full_text
from themeloom.llm.token_counts import in_bytes
from themeloom.session import materialise

END_ID = 2
SHARD_IDS = 1 << 20
ROUNDS = 5
PER_ROUND = 3_000  # pairs replaced in a round
LEAST = 16  # occurrences of a pair worth a rule
GAIN = 0.01  # a round that replaces less of the symbols is the last
_SLOTS = 17  # bits of the table in which pairs are counted
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))

FILES = (
    "part int, shard int, n_ids bigint, first_rule bigint, rules binary, lengths binary, wide boolean, symbols binary,"
    " doc_id array<bigint>, n_tokens array<bigint>, ends array<bigint>"
)


def repair(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rules, symbols, ends)``: rule k is the pair that symbol ``first + k`` stands for.

    ``ends`` are the places after each document's last id; no rule reaches across them.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    symbol = first
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        slot = ((seq[:-1] * _FACTORS[0] + seq[1:] * _FACTORS[1]) >> np.uint32(32 - _SLOTS)).astype(np.int64)
        slot[last[:-1]] = 1 << _SLOTS  # never counted
        count = np.bincount(slot, minlength=(1 << _SLOTS) + 1)
        count[-1] = 0
        chosen = np.argpartition(count, -PER_ROUND)[-PER_ROUND:]
        chosen = chosen[count[chosen] >= LEAST]
        rank = np.zeros((1 << _SLOTS) + 1, np.int32)
        rank[chosen] = count[chosen]
        order = rank[slot]
        at = np.flatnonzero(order)
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        of = slot[at]
        pair = np.zeros((1 << _SLOTS) + 1, np.uint64)
        pair[of] = key  # of pairs that share a slot, one is kept: mostly the frequent one
        order[at[pair[of] != key]] = 0
        before = np.concatenate(([0], order[:-1]))
        after = np.concatenate((order[1:], [0]))
        take = np.flatnonzero((order > before) & (order >= after))
        often = np.bincount(slot[take], minlength=len(rank)) >= LEAST // 2
        take = take[often[slot[take]]]
        if len(take) < GAIN * len(seq):
            break
        which = (np.cumsum(often) - 1)[slot[take]]
        found = pair[often]
        rules.append(np.stack([(found >> np.uint64(32)).astype(np.uint32), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        seq[take] = symbol + which
        last[take] = last[take + 1]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq, last = seq[keep], last[keep]
        symbol += len(found)
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return all_rules, seq, np.flatnonzero(last) + 1


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1))
    return np.array(lengths, np.uint32)


class Decoder:
    """Expands symbols of one shard; any run of them, so any document, by itself."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int):
        spelled: list[np.ndarray] = []
        for a, b in rules.tolist():
            left = spelled[a - first] if a >= first else np.array([a], np.uint32)
            right = spelled[b - first] if b >= first else np.array([b], np.uint32)
            spelled.append(np.concatenate((left, right)))
        self.first = first
        self.spelled = np.concatenate([np.arange(first, dtype=np.uint32), *spelled])
        self.length = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
        self.start = np.cumsum(self.length) - self.length

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        length = self.length[symbols]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.start[symbols] - (ends - length), length) + np.arange(total)
        return self.spelled[place]

    def id_at(self, symbols: np.ndarray, place: int) -> int:
        """The id at one place of a document, expanding a single symbol."""
        ends = np.cumsum(self.length[symbols])
        k = int(np.searchsorted(ends, place, side="right"))
        begin = int(ends[k] - self.length[symbols[k]])
        return int(self.spelled[self.start[symbols[k]] + place - begin])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """The folder of shards, read back as a table with the columns ``FILES``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokens.read_file(tokenizer_path))  # a few MB, whatever the corpus
    ordered = (
        docs.select("doc_id", full_text("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        part, number = TaskContext.get().partitionId(), 0
        first = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        closing = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes = np.array([len(x) // 4 for x in parts], np.int64)
            rules, symbols, ends = repair(ids, np.cumsum(sizes), first)
            wide = first + len(rules) > 1 << 16
            row = {
                "part": part,
                "shard": number,
                "n_ids": len(ids),
                "first_rule": first,
                "rules": rules.astype("<u4").tobytes(),
                "lengths": expansion_lengths(rules, first).astype("<u4").tobytes(),
                "wide": wide,
                "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
                "doc_id": names,
                "n_tokens": sizes.tolist(),
                "ends": ends.tolist(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow_files())

        for batch in batches:
            ids_of, at = batch.column("doc_id").to_pylist(), 0
            for texts in in_bytes(batch.column("text").to_pylist()):
                for coded in encoder.encode(texts):
                    names.append(ids_of[at])
                    parts.append(coded + closing)
                    held += len(coded) // 4 + 1
                    at += 1
                    if held >= SHARD_IDS:
                        yield shard()
                        names, parts, held, number = [], [], 0, number + 1
        if parts:
            yield shard()

    return materialise(ordered.mapInArrow(encode, FILES), "token-shards")


def _arrow_files() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in FILES.split(","))])


def opened(row: dict) -> tuple[Decoder, np.ndarray]:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    decoder = Decoder(rules, np.frombuffer(row["lengths"], "<u4"), row["first_rule"])
    return decoder, np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")


def read_documents(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, decoded from the shards; start counts all ids before."""
    of_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    begin = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(of_part), F.lit(0)).alias("_inside")).join(before, "part")
    begin = begin.select("part", "shard", (F.col("_before") + F.col("_inside")).alias("_begin"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                decoder, symbols = opened(row)
                ids = decoder.ids(symbols).astype("<u4")
                sizes = np.array(row["n_tokens"], np.int64)
                starts = np.cumsum(sizes) - sizes
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * n, pa.int32()),
                        "shard": pa.array([row["shard"]] * n, pa.int32()),
                        "doc_id": pa.array(row["doc_id"], pa.int64()),
                        "inside": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    read = files.drop("ends", "n_ids").mapInArrow(
        decode, "part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return read.join(begin, ["part", "shard"]).select("doc_id", (F.col("_begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")))
