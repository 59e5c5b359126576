"""Two tokenizers side by side: where their tokens meet, and which ids stand for each other.

Texts are brought together by their full text, so each distinct one is tokenised and aligned
once, however often it occurs; what it counts for is weighted by its number of copies, and its
measures are joined back to the documents by digest.

Byte offsets at which a token of A and a token of B both end cut a text into groups. All pairs of
an A and a B token of a group are links. The count of an id pair is the number of documents that
hold it linked. It is summed over the links of each text in two parts: of pairs so frequent that
there can only be ``HEAVY`` of them the counts travel with the tasks; the rows of the others,
none of which is hot, are joined.

Both tokenizers cut a text before a single space that stands between two words, so a word that
was met before isn't tokenised and aligned again, and texts are put together from words. That
the pieces give the bytes back is checked for each word; a text with other white space, or with a
word that fails, is tokenised whole, and has no tokens if its bytes don't come back.

A null or empty text has no tokens: zeros and an empty string. Special tokens' strings are plain
text. Very long texts are aligned whole in one task, in memory in proportion to their links.
Repeated rows are documents of their own; an empty table gives an empty one. Further columns are
not read; ``doc_id`` may be of any type, null and repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import tokens
from themeloom.llm.common import documents
from themeloom.llm.token_counts import content_digest, in_bytes
from themeloom.operators.joins import lookup
from themeloom.session import materialise

BATCH_CHARACTERS = 2 << 20  # of text aligned at once
KEPT_WORDS = 400_000  # aligned words remembered by a task before it starts anew
JOINED = 4_096  # words tokenised as one string
LARGE_GROUP = 1 << 20  # links of one group from which they are counted by distinct ids
HEAVY = 500_000  # pairs whose counts travel with the tasks: those with more than 1 / HEAVY of all entries
HELD = 4_000_000  # entries added up at once in a task
SMALL_VOCABULARY = 1_000_000  # ids of A up to which one number for each may be sent to the tasks
SPACE = "▁"

ALIGNED = (
    "content binary, n_docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " codes binary, times binary"
)
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def code_type(size_a: int, size_b: int) -> str:
    """The number type of ``a * size_b + b``."""
    return "<u4" if size_a * size_b < 2**32 else "<u8"


class Side:
    """One tokenizer: ids of strings that begin with a space, and the bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], "i8")
        self.spaced = np.array([e[:1] == b" " for e in entries])

    def text_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level tokenizer file; strings come with their leading space."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        hidden = tokens._byte_letters()  # bytes that are written as another character
        byte_of = {hidden.get(byte, chr(byte)): byte for byte in range(256)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            entries[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        super().__init__(entries)
        given = json.loads(spec)
        before = given.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not given.get("normalizer")
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A sentence-piece model, which adds the leading space itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        is_byte = [self.model.is_byte(i) for i in range(len(names))]
        super().__init__([bytes([int(p[3:-1], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(names, is_byte)])
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p, b in zip(names, is_byte) if not b)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Ragged:
    """Runs of one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.begin = np.cumsum(sizes) - sizes

    def places(self, runs: np.ndarray) -> np.ndarray:
        """Where the elements of the given runs stand, one run after the other."""
        sizes = self.sizes[runs]
        return np.arange(sizes.sum()) + np.repeat(self.begin[runs] - (np.cumsum(sizes) - sizes), sizes)


class Found:
    """Tokens of numbered strings by both sides, in the order in which they were found."""

    def __init__(self, n: int):
        self.place = np.full(n, -1, "i8")  # of a string among those found
        self.n = 0
        self.flat: tuple[list, list] = ([np.zeros(0, "i8")], [np.zeros(0, "i8")])
        self.sizes: tuple[list, list] = ([np.zeros(0, "i8")], [np.zeros(0, "i8")])

    def add(self, numbers: np.ndarray, both: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.place[numbers] = np.arange(self.n, self.n + len(numbers))
        self.n += len(numbers)
        for side, (flat, sizes) in enumerate(both):
            self.flat[side].append(flat)
            self.sizes[side].append(sizes)

    def tokens(self) -> tuple[Ragged, Ragged]:
        return tuple(Ragged(np.concatenate(flat), np.concatenate(sizes)) for flat, sizes in zip(self.flat, self.sizes))


class Units:
    """Strings that were tokenised and aligned for themselves, numbered as they were added."""

    def __init__(self, a: Side, b: Side, tokens_a: Ragged, tokens_b: Ragged):
        """Run k of ``tokens_a`` and of ``tokens_b`` are the tokens of string k; both spell it out."""
        flat_a, flat_b, size_a, size_b = tokens_a.flat, tokens_b.flat, tokens_a.sizes, tokens_b.sizes
        end_a, end_b = np.cumsum(a.length[flat_a]), np.cumsum(b.length[flat_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        past_a, past_b = np.cumsum(in_a), np.cumsum(in_b)
        last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        self.n_a, self.n_b = size_a, size_b
        self.n_groups = np.diff(group_a[last_a] + 1, prepend=0) if len(size_a) else np.zeros(0, "i8")

        links = in_a * in_b
        large = links > LARGE_GROUP
        # Each A token with all B tokens of its group, those of large groups left out.
        times = np.where(large[group_a], 0, in_b[group_a])
        partner = np.arange(times.sum()) + np.repeat((past_b - in_b)[group_a] - (np.cumsum(times) - times), times)
        codes = np.repeat(flat_a, times) * b.size + flat_b[partner]
        per_unit = np.diff(np.cumsum(times)[last_a], prepend=0) if len(size_a) else np.zeros(0, "i8")
        self.codes = Ragged(codes, per_unit)
        group_end = past_groups = np.cumsum(self.n_groups)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[past_groups], prepend=0) if len(size_a) else group_end
        self.large: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for g in np.flatnonzero(large):
            one, n_one = np.unique(flat_a[past_a[g] - in_a[g] : past_a[g]], return_counts=True)
            two, n_two = np.unique(flat_b[past_b[g] - in_b[g] : past_b[g]], return_counts=True)
            pairs = (one[:, None] * b.size + two).ravel(), np.multiply.outer(n_one, n_two).ravel()
            self.large.setdefault(int(np.searchsorted(group_end, g, "right")), []).append(pairs)

        # Written down: the A ids of a group, the B ids of a group, and what stands behind each.
        seq = np.empty(len(flat_a) + len(flat_b), "i8")
        closes_a = np.diff(group_a, append=-1) != 0
        closes_b = np.diff(group_b, append=-1) != 0
        seq[np.arange(len(flat_a)) + (past_b - in_b)[group_a]] = 2 * flat_a + closes_a
        seq[np.arange(len(flat_b)) + past_a[group_b]] = 2 * a.size + 2 * flat_b + closes_b
        table = _written(a.size, b.size)
        written = [table[i] for i in seq.tolist()]
        cuts = np.concatenate([[0], np.cumsum(size_a + size_b)]).tolist()
        self.shown = ["".join(written[i:j])[:-1] for i, j in zip(cuts, cuts[1:])]

    @classmethod
    def none(cls, a: Side, b: Side) -> "Units":
        return cls(a, b, *Found(0).tokens())

    def plus(self, other: "Units") -> "Units":
        """These units, and behind them the others."""
        out = object.__new__(Units)
        for name in MEASURES:
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        out.codes = Ragged(*(np.concatenate([getattr(x.codes, part) for x in (self, other)]) for part in ("flat", "sizes")))
        out.large = self.large | {len(self.shown) + u: pairs for u, pairs in other.large.items()}
        out.shown = self.shown + other.shown
        return out


_tables: dict[tuple[int, int], list[str]] = {}


def _written(size_a: int, size_b: int) -> list[str]:
    """Ids as they are written within a group and at the end of its A or B side."""
    if (size_a, size_b) not in _tables:
        _tables[size_a, size_b] = [f"{i}{s}" for i in range(size_a) for s in ",|"] + [f"{i}{s}" for i in range(size_b) for s in ",;"]
    return _tables[size_a, size_b]


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.by_word = self.a.by_word and self.b.by_word
        self.codes = code_type(self.a.size, self.b.size)
        self.known = {"": -1}
        self.units = Units.none(self.a, self.b)

    def _spelt(self, side: Side, ids: list[int], raw: bytes) -> bool:
        return side.text_of(ids) == raw

    def _words(self, words: list[str], found: Found) -> None:
        """Tokens of words, each behind a space, where they spell the word."""
        alone: list[int] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            text = " ".join(some)
            raw = b" " + text.encode()
            cut = []
            for side in (self.a, self.b):
                ids = side.encode([text])[0]
                flat = np.array(ids, "i8")
                begins = np.flatnonzero(side.spaced[flat]) if len(flat) else flat
                if len(begins) == len(some) and begins[0] == 0 and self._spelt(side, ids, raw):
                    cut.append((flat, np.diff(begins, append=len(flat))))
            if len(cut) == 2:
                found.add(np.arange(at, at + len(some)), cut)
            else:
                alone += range(at, at + len(some))
        self._whole([words[k] for k in alone], alone, found)

    def _whole(self, texts: list[str], numbers: list[int], found: Found) -> None:
        if texts:
            for text, number, *both in zip(texts, numbers, *(side.encode(texts) for side in (self.a, self.b))):
                raw = b" " + text.encode()
                if all(ids and self._spelt(side, ids, raw) for side, ids in zip((self.a, self.b), both)):
                    found.add(np.array([number]), [(np.array(ids, "i8"), np.array([len(ids)])) for ids in both])

    def align(self, texts: list[str]) -> list[dict]:
        """For each text (not empty) its measures and its linked pairs with their times."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.units = {"": -1}, Units.none(self.a, self.b)
        cut: list[list[str] | None] = [text.split(" ") if self.by_word else None for text in texts]
        self._learn([word for word in dict.fromkeys(chain.from_iterable(words or () for words in cut)) if word not in self.known])
        runs = [np.array(list(map(self.known.__getitem__, words or ("",))), "i8") for words in cut]
        whole = [k for k, run in enumerate(runs) if run.min() < 0]
        units = self.units
        if whole:
            found = Found(len(whole))
            self._whole([texts[k] for k in whole], list(range(len(whole))), found)
            units = units.plus(Units(self.a, self.b, *found.tokens()))
            for k, place in zip(whole, found.place.tolist()):  # a text that doesn't come back has no tokens
                runs[k] = np.array([] if place < 0 else [len(self.units.shown) + place], "i8")
        return list(self._texts(units, runs))

    def _learn(self, words: list[str]) -> None:
        """Number new words as units; -1 stands for one that must not be cut from its text."""
        whole = [not word or word[0].isspace() or word[-1].isspace() for word in words]
        self.known.update((word, -1) for word, odd in zip(words, whole) if odd)
        words = [word for word, odd in zip(words, whole) if not odd]
        found = Found(len(words))
        self._words(words, found)
        first = len(self.units.shown)
        self.known.update(zip(words, np.where(found.place < 0, -1, first + found.place).tolist()))
        self.units = self.units.plus(Units(self.a, self.b, *found.tokens()))

    def _texts(self, units: Units, runs: list[np.ndarray]) -> Iterator[dict]:
        flat = np.concatenate(runs) if runs else np.zeros(0, "i8")
        sizes = np.array([len(r) for r in runs], "i8")
        text_of = np.repeat(np.arange(len(runs)), sizes)
        sums = {
            name: np.bincount(text_of, getattr(units, name)[flat], len(runs)).astype("i8") for name in MEASURES
        }
        codes = units.codes.flat[units.codes.places(flat)]
        owner = np.repeat(text_of, units.codes.sizes[flat])
        times = np.ones(len(codes), "i8")
        if units.large:
            extra = [(t, *pair) for t, u in zip(text_of.tolist(), flat.tolist()) for pair in units.large.get(u, ())]
            codes = np.concatenate([codes, *[c for _, c, _ in extra]])
            owner = np.concatenate([owner, *[np.full(len(c), t) for t, c, _ in extra]])
            times = np.concatenate([times, *[n for _, _, n in extra]])
        span = self.a.size * self.b.size
        key = owner * span + codes
        if units.large:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        else:
            key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        owner, codes = np.divmod(key[first], span)
        codes, times = codes.astype(self.codes), times.astype("<u4")
        ends = np.searchsorted(owner, np.arange(len(runs) + 1))
        for k, run in enumerate(runs):
            begin, end = ends[k], ends[k + 1]
            shown = ";".join([units.shown[u] for u in run.tolist()])
            yield {name: int(sums[name][k]) for name in MEASURES} | {
                "groups": shown, "codes": codes[begin:end].tobytes(), "times": times[begin:end].tobytes()
            }


_aligners: dict[str, Aligner] = {}


def aligner(spec: str, model: bytes) -> Aligner:
    """One for each worker process."""
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(spec, model)
    return _aligners[key]


def aligned_texts(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """One row for each distinct text: its digest, copies, measures, and linked pairs with their times."""
    files = docs.sparkSession.sparkContext.broadcast((spec, model))  # two tokenizer files, whatever the corpus
    distinct = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("n_docs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*files.value)
        for batch in batches:
            at = 0
            for texts in in_bytes(batch.column("text").to_pylist(), BATCH_CHARACTERS):
                rows = both.align(texts)
                part = batch.slice(at, len(texts))
                at += len(texts)
                shown = [hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "" for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("content"),
                        part.column("n_docs"),
                        *[pa.array([r[name] for r in rows], pa.int64()) for name in MEASURES],
                        pa.array(shown, pa.string()),
                        *[pa.array([r[name] for r in rows], pa.binary()) for name in ("codes", "times")],
                    ],
                    ["content", "n_docs", *MEASURES, "groups_sha256", "codes", "times"],
                )

    return distinct.select(content_digest(F.col("text")).alias("content"), "n_docs", "text").mapInArrow(work, ALIGNED)


# Counts of pairs


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``(code, docs, texts)``: in how many documents, and distinct texts, a pair is linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}  # codes of texts by their number of copies
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for copies, some in held.items():
                codes, texts = np.unique(np.frombuffer(b"".join(some), kind), return_counts=True)
                for part in (slice(i, i + 100_000) for i in range(0, len(codes), 100_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[part].astype("i8")) for x in (codes, texts * copies, texts)], ["code", "docs", "texts"]
                    )
            held.clear()

        for batch in batches:
            for copies, codes in zip(batch.column("n_docs").to_pylist(), batch.column("codes").to_pylist()):
                held.setdefault(copies, []).append(codes)
                size += len(codes) // np.dtype(kind).itemsize
                if size > HELD:
                    yield from counted()
                    size = 0
        yield from counted()

    found = aligned.select("n_docs", "codes").mapInArrow(work, "code bigint, docs bigint, texts bigint")
    return found.groupBy("code").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))


def with_best(counts: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """Add ``best``: no pair of the same A id has a higher count."""
    by_a = F.floor(F.col("code") / F.lit(size_b)).alias("a")
    counts = counts.withColumn("a", by_a)
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    # One row for each id of A: bounded by its vocabulary.
    if size_a <= SMALL_VOCABULARY:
        most = F.broadcast(most)
    return counts.join(most, "a").select("code", "docs", "texts", (F.col("docs") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """``(content, n_best, count_sum)`` over the links of each text; ``counts`` is stored."""
    entries = counts.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n")).head()["n"]
    is_heavy = F.col("texts") * HEAVY > entries  # fewer than HEAVY pairs can be
    heavy = counts.filter(is_heavy).select("code", "docs", "best").toArrow()
    order = np.argsort(heavy.column("code").to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(
        tuple(heavy.column(c).to_numpy()[order] for c in ("code", "docs", "best"))
    )

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        known = sent.value[0]
        for content, codes, times in zip(*(batch.column(c).to_pylist() for c in ("content", "codes", "times"))):
            code, n = np.frombuffer(codes, kind).astype("i8"), np.frombuffer(times, "<u4").astype("i8")
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            yield content, code, n, at, known[at] == code if len(known) else np.zeros(len(code), bool)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, best = sent.value
        for batch in batches:
            out = []
            for content, _, n, at, hit in rows(batch):
                n, at = n[hit], at[hit]
                out.append((content, int(n[best[at]].sum()), int((n * docs[at]).sum())))
            columns = list(zip(*out)) or [(), (), ()]
            types = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["content", "n_best", "count_sum"]
            )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, sizes, codes, times = [], [], [], []
            for content, code, n, _, hit in rows(batch):
                contents.append(content)
                sizes.append(int((~hit).sum()))
                codes.append(code[~hit])
                times.append(n[~hit])
            if not sum(sizes):
                continue
            repeated = pa.array(contents, pa.binary()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays(
                [repeated, pa.array(np.concatenate(codes)), pa.array(np.concatenate(times))], ["content", "code", "n"]
            )

    packed = aligned.select("content", "codes", "times")
    here = packed.mapInArrow(frequent, "content binary, n_best bigint, count_sum bigint")
    rest = packed.mapInArrow(others, "content binary, code bigint, n bigint").join(counts.filter(~is_heavy), "code")
    n_best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    there = rest.groupBy("content").agg(n_best, F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    both = here.unionByName(there).groupBy("content")
    return both.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_alignment(docs: DataFrame, byte_level_path: str, pieces_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for ``docs(doc_id, text)``."""
    spec = tokens.read_file(byte_level_path)
    with open(pieces_path, "rb") as file:
        model = file.read()
    size_a, size_b = ByteLevel(spec).size, Pieces(model).size
    kind = code_type(size_a, size_b)
    aligned = materialise(aligned_texts(docs, spec, model), "aligned")
    counts = materialise(with_best(pair_counts(aligned, kind), size_a, size_b), "pair-counts")
    measures = aligned.drop("codes", "times", "n_docs").join(link_sums(aligned, counts, kind), "content", "left")
    digest = F.when(F.length("text") > 0, content_digest(F.col("text")))
    found = lookup(docs.select("doc_id", digest.alias("content")), measures, ["content"], "doc_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return found.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, aligned between the byte-level and the piece vocabulary."""
    import public_tokenizers

    return cross_alignment(
        documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
