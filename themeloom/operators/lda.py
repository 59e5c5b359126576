"""Latent Dirichlet allocation as tables: expected counts of topics by word and by document.

All expected counts are taken at once in every round (collapsed variational inference of order
zero without the exclusion of a word's own count). Word k's share of topic t is
``(eta + count) / (terms * eta + total)``, a document's ``(alpha + count) / (k * alpha + words)``,
and a word in a document is dealt to the topics in proportion to the product of both.

Documents become blocks where they are read, of about ``WORDS_PER_BLOCK`` (document, word) pairs, one
for each core if they are fewer; inside a block a word is a number. Blocks stay where they are, packed and kept on
local disk. Each word has an owner among the blocks that hold it. A round has two halves, in which
blocks write to each other: ``_dealt`` works through a block as matrices and sends what it has
counted to the owners, ``_added`` adds that up and sends the new counts to the holders. Both sides
know the order of the words between them, so a letter holds numbers and nothing else, and a word
that only one block holds is in none. Neither the vocabulary nor the weights are ever in one place:
only one total for each topic reaches the driver. Rounds start from a hash of the words, so they can
be repeated; the letters of a round are deleted when the next one is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.arrays import bag_of_words
from themeloom.operators.vocabulary import MIN_LENGTH
from themeloom.session import forget, materialise, release_shuffles, stored_at

WORDS_PER_BLOCK = 16_000_000  # (document, word) pairs that one task holds, 8 bytes each
LEAST_IN_BLOCK = 20_000  # fewer aren't worth a task
PAIRS_PER_ROW = 1_000_000  # of a block, packed into one row
MOST_OF_TASK = 10_000  # blocks
CELLS = 800_000  # numbers worked on at once, few enough to stay in a core's cache from one step to the next
BLOCK = "block int, chunk int, row binary, sizes binary, places binary, counts binary, scored binary, at int, term string, n bigint"
INDEX = "owner int, holder int, owned binary, held binary"
LETTER = "block int, kind string, sender int, numbers binary"


@dataclass
class LdaResult:
    topic_term: DataFrame  # topic from 0, term, weight: shares of a topic, summing to 1
    doc_topic: DataFrame  # doc_id, topic, weight: shares of a document, summing to 1
    shares: DataFrame  # doc_id, shares in topic order, known: whether the document has a word of the vocabulary
    words: DataFrame  # term, counts: expected number of occurrences for each topic
    totals: list[float]  # for each topic
    n_terms: int
    alpha: float
    eta: float


# Blocks of documents


def _bag(tokens: Column) -> Column:
    return bag_of_words(F.filter(tokens, lambda w: F.length(w) >= MIN_LENGTH))


def _term_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.inline(F.arrays_zip("terms", "counts", "scored"))).withColumnRenamed("terms", "term")


def _in_vocabulary(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``rows`` with only the words of ``vocab(term)``; rows may lose all of them."""
    kept = (
        _term_rows(rows)
        .join(vocab, "term", "left_semi")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("term", "counts", "scored"))).alias("_kept"))
    )
    return kept.select("row", *[F.col(f"_kept.{old}").alias(new) for old, new in (("term", "terms"), ("counts", "counts"), ("scored", "scored"))])


def _numbered_words(block: int, table: pa.Table) -> pa.Table:
    """One block: its documents packed, the words as numbers, and a row that says which word has which."""
    terms = table.column("terms").combine_chunks()
    words = terms.flatten().dictionary_encode()
    sizes = terms.value_lengths().to_numpy().astype("i4")
    places = words.indices.to_numpy().astype("i4")
    numbers = {name: table.column(name).combine_chunks().flatten().to_numpy().astype("i4") for name in ("counts", "scored")}
    row = table.column("row").to_numpy()
    rows = [
        {
            "block": block, "chunk": i, "row": row[docs].tobytes(), "sizes": sizes[docs].tobytes(), "places": places[span].tobytes(),
            **{name: flat[span].tobytes() for name, flat in numbers.items()},
        }
        for i, (docs, span) in enumerate(_slices(sizes, PAIRS_PER_ROW))
    ]
    v = len(words.dictionary)
    of_word = {"block": pa.array([block] * v, pa.int32()), "at": pa.array(np.arange(v), pa.int32()), "term": words.dictionary.cast(pa.string())}
    of_word["n"] = pa.array(np.bincount(places, numbers["counts"], v).astype("i8"))
    schema = _arrow(BLOCK)
    packed = pa.Table.from_pylist(rows, schema)
    listed = pa.table([of_word.get(f.name, pa.nulls(v, f.type)) for f in schema], schema)
    return pa.concat_tables([packed, listed])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    kinds["array<double>"] = pa.list_(pa.float64())
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The documents of a task in blocks of about ``most`` pairs, numbered so that no other task uses the number."""
    part, number, held, pairs = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        held.append(batch)
        pairs += len(batch.column("terms").flatten())
        if pairs >= most:
            yield from _numbered_words(part * MOST_OF_TASK + number, pa.Table.from_batches(held)).to_batches()
            number, held, pairs = number + 1, [], 0
    if pairs:
        yield from _numbered_words(part * MOST_OF_TASK + number, pa.Table.from_batches(held)).to_batches()


def _blocks(rows: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
    """Stored blocks of ``rows(row, terms, counts, scored)`` that have words, and their numbers.

    Documents become blocks where they are read. The numbers are such that a hash partitioning into
    as many parts as there are blocks puts one into each, so that blocks are dealt evenly.
    """
    pairs = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).head()["n"]
    spark = rows.sparkSession
    n = max(1, -(-pairs // WORDS_PER_BLOCK), min(spark.sparkContext.defaultParallelism, -(-pairs // LEAST_IN_BLOCK)))
    docs = rows.filter(F.size("terms") > 0).select("row", "terms", "counts", "scored").coalesce(n)
    most = WORDS_PER_BLOCK
    blocks = materialise(docs.mapInArrow(lambda batches: _cut(batches, most), BLOCK), name, compression="zstd")
    cut = blocks.filter(F.col("chunk") == 0).agg(F.array_sort(F.collect_set("block"))).head()[0]
    parts = max(1, len(cut))
    firsts = spark.range(64 * parts + 64).select(F.col("id").cast("int").alias("id"))
    firsts = firsts.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
    numbers = firsts.agg(F.array_sort(F.collect_list("id"))).head()[0][: len(cut)]
    place = F.array_position(F.array(*[F.lit(x).cast("int") for x in cut]), F.col("block")).cast("int") - 1
    return blocks.withColumn("block", F.get(F.array(*[F.lit(x).cast("int") for x in numbers]), place)), numbers


def _packed_docs(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("chunk").isNotNull()).select("block", "chunk", "row", "sizes", "places", "counts", "scored")


def _index(words: DataFrame) -> DataFrame:
    """``INDEX``: the numbers that two blocks have for the words of the one that the other one holds.

    ``words(term, owner, owned, holders)``; a block is a holder of its own words.
    """
    links = words.select("owner", "owned", F.inline("holders").alias("holder", "held"))

    def pack(table: pa.Table) -> pa.Table:
        owned, held = (table.column(c).to_numpy() for c in ("owned", "held"))
        order = np.argsort(owned)
        row = {"owner": table.column("owner")[0].as_py(), "holder": table.column("holder")[0].as_py()}
        row |= {"owned": owned[order].astype("i4").tobytes(), "held": held[order].astype("i4").tobytes()}
        return pa.Table.from_pylist([row], _arrow(INDEX))

    return materialise(links.groupBy("owner", "holder").applyInArrow(pack, INDEX), "lda-index")


def _held(table: DataFrame, n: int) -> DataFrame:
    """Rows that lie with their block until ``unpersist``, so that a round moves letters only."""
    return table.repartition(n, "block").persist(StorageLevel.DISK_ONLY)


# One round


def _bytes(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The numbers packed in the rows of a column, one after the other."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _columns(docs: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Sizes, places, counts and scored counts of each packed row of documents, in order."""
    for one in docs:
        counts, scored = (np.frombuffer(one[c], "i4").astype("f8") if one[c] is not None else None for c in ("counts", "scored"))
        yield np.frombuffer(one["sizes"], "i4"), np.frombuffer(one["places"], "i4"), counts, scored


def _topics_of(places: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, words: np.ndarray, alpha: float, looks: int):
    """Expected counts of words by topic after so many looks at the documents, and the documents' shares that follow from them.

    ``weights``, ``words`` and both results have a row for each topic, so that every step runs along a row.
    """
    of_word = words.take(places, axis=1)
    dealt = np.empty_like(of_word)
    begins = np.cumsum(sizes) - sizes
    for _ in range(looks):
        for share, numbers, out in zip(weights, of_word, dealt):
            np.multiply(numbers, np.repeat(share, sizes), out=out)
        dealt *= counts / dealt.sum(axis=0)
        sums = np.add.reduceat(dealt, begins, axis=1) + alpha
        weights = sums / sums.sum(axis=0)
    return dealt, weights


def _slices(sizes: np.ndarray, pairs: int):
    """Runs of documents with about so many pairs, and their runs of words."""
    ends = np.cumsum(sizes, dtype="i8")
    first = 0
    while first < len(sizes):
        begin = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + pairs, side="right")))
        yield slice(first, last), slice(begin, ends[last - 1])
        first = last


def _letters(rows: list[tuple]) -> pa.Table:
    schema = _arrow(LETTER)
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema) if rows else schema.empty_table()


def _by_kind(letters: pa.Table, k: int) -> dict[str, dict[int, np.ndarray]]:
    """Kind of letter and sender, in the senders' order: sums come out alike whenever letters arrive."""
    found: dict[str, dict[int, np.ndarray]] = {}
    for one in sorted(letters.to_pylist(), key=lambda one: one["sender"]):
        found.setdefault(one["kind"], {})[one["sender"]] = np.frombuffer(one["numbers"], "f8").reshape(-1, k)
    return found


def _dealt(held: pa.Table, letters: pa.Table, n_terms: int, k: int, alpha: float, eta: float, inner: int) -> pa.Table:
    """One block: its documents' new shares, and what it counted, for the owners of the words."""
    packed = held.to_pylist()
    me = packed[0]["block"]
    index = {one["owner"]: np.frombuffer(one["held"], "i4") for one in packed if one["held"] is not None}
    docs = sorted((one for one in packed if one["chunk"] is not None), key=lambda one: one["chunk"])
    found = _by_kind(letters, k)
    totals = sum(found["totals"].values())[0]
    words = np.empty((sum(len(at) for at in index.values()), k))
    for owner, at in index.items():
        words[at] = (eta + found["counts"][owner]) / (n_terms * eta + totals)
    words = np.ascontiguousarray(words.T)
    given = found.get("weights", {})
    sums, out = np.zeros_like(words), []
    for one, (sizes, places, counts, _) in zip(docs, _columns(docs)):
        weights = np.array(given[one["chunk"]].T if given else np.full((k, len(sizes)), 1.0 / k), order="C")
        dealt = np.empty((k, len(places)))
        for rows, span in _slices(sizes, CELLS // k):
            dealt[:, span], weights[:, rows] = _topics_of(places[span], counts[span], sizes[rows], weights[:, rows], words, alpha, inner)
        for topic in range(k):
            sums[topic] += np.bincount(places, dealt[topic], words.shape[1])
        out.append((me, "weights", one["chunk"], weights.T.tobytes()))
    sums = np.ascontiguousarray(sums.T)
    out += [(owner, "sums", me, sums[at].tobytes()) for owner, at in index.items()]
    return _letters(out)


def _added(owned: pa.Table, letters: pa.Table, blocks: list[int], k: int) -> pa.Table:
    """One block: the new counts of its own words, for all that hold them, and their total, for all blocks."""
    if not letters.num_rows:  # a block that owns no word and got no letter
        return _letters([])
    found = _by_kind(letters, k)
    index = {one["holder"]: np.frombuffer(one["owned"], "i4") for one in owned.to_pylist()}
    me = letters.column("block")[0].as_py()
    own = index.get(me, np.zeros(0, "i4"))
    counts = np.zeros((max((int(at.max()) for at in index.values() if len(at)), default=-1) + 1, k))
    for holder, numbers in found.get("sums", {}).items():
        counts[index[holder]] += numbers
    out = [(holder, "counts", me, counts[at].tobytes()) for holder, at in index.items()]
    out += [(block, "totals", me, counts[own].sum(axis=0).tobytes()) for block in blocks]
    out += [(me, "weights", chunk, numbers.tobytes()) for chunk, numbers in found.get("weights", {}).items()]
    return _letters(out)


def _first_letters(words: pa.Table, k: int) -> pa.Table:
    """The counts that one block's own words begin with, as if it alone had counted them."""
    me = words.column("block")[0].as_py()
    at, counts = words.column("owned").to_numpy(), words.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, k)
    return _letters([(me, "sums", me, counts[np.argsort(at)].tobytes())])


def _together(table: DataFrame, letters: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    # New names for the same columns: both sides may come from one table.
    letters = letters.select(*[F.col(c).alias(c) for c in letters.columns])
    return table.groupBy("block").cogroup(letters.groupBy("block")).applyInArrow(lambda rows, sent: work(rows, sent), schema)


def _forgotten(letters: DataFrame | None) -> None:
    """Delete stored letters that have been answered, and the shuffled ones between them and the answers."""
    if letters is not None:
        forget(letters.sparkSession, stored_at(letters))
        release_shuffles(letters.sparkSession)


def _totals(words: DataFrame, k: int) -> list[float]:
    return list(words.agg(*[F.sum(F.get("counts", F.lit(i))) for i in range(k)]).head())


def _owned_words(blocks: DataFrame) -> DataFrame:
    """``(term, cf, owner, owned, holders)``: the block a word belongs to and its number there; all its blocks and numbers."""
    places = F.array_sort(F.collect_list(F.struct(F.col("block").alias("holder"), F.col("at").alias("held"))))
    words = blocks.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("cf"), places.alias("holders"))
    owner = F.get("holders", F.pmod(F.xxhash64("term"), F.size("holders")).cast("int"))
    chosen = words.withColumn("_owner", owner)
    return materialise(
        chosen.select("term", "cf", F.col("_owner.holder").alias("owner"), F.col("_owner.held").alias("owned"), "holders"), "lda-vocabulary"
    )


def _start(vocab: DataFrame, k: int, *carry: str) -> DataFrame:
    """Counts to begin with: a word's occurrences, times 0.5 to 1.5 by a hash of word and topic."""
    def share(topic: int) -> Column:
        digest = F.md5(F.concat("term", F.lit(f":{topic}")))
        return 0.5 + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)

    return vocab.select(*carry, F.array(*[F.col("cf") * share(i) for i in range(k)]).alias("counts"))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k).astype("i4")), pa.array(matrix.ravel()))


def _named(words: pa.Table, letters: pa.Table, k: int) -> pa.Table:
    """The words of one block and their counts, which are in the order of the words' numbers."""
    by_number = words.take(np.argsort(words.column("owned").to_numpy()))
    numbers = _bytes(letters, "numbers", "f8").reshape(-1, k)
    return pa.table({"term": by_number.column("term").combine_chunks().cast(pa.string()), "counts": _lists(numbers)})


def _shares(docs: pa.Table, letters: pa.Table, k: int) -> pa.Table:
    rows = _bytes(docs.sort_by("chunk"), "row", "i8")
    numbers = _bytes(letters.sort_by("sender"), "numbers", "f8").reshape(-1, k) if letters.num_rows else np.full((len(rows), k), 1.0 / k)
    return pa.table({"row": pa.array(rows), "_shares": _lists(numbers)})


def fit_lda(
    docs: DataFrame,
    k: int = 8,
    iterations: int = 10,
    inner: int = 3,
    alpha: float = 0.1,
    eta: float = 0.01,
    min_df: int = 1,
    max_vocab: int | None = None,
    key: str = "doc_id",
) -> LdaResult:
    """Topics of ``docs(key, tokens)`` after ``iterations`` rounds over all documents.

    In each round a document's topics are found again ``inner`` times before its words count.
    ``min_df`` and ``max_vocab`` (the most frequent words, ties alphabetical) are options that
    leave words out; by default all take part. A document without a word of the vocabulary
    takes no part and gets all topics in equal shares.
    """
    bag = _bag(F.col("tokens"))
    every = materialise(
        docs.select(key, F.monotonically_increasing_id().alias("row"), bag.alias("_bag")).select(
            key, "row", F.col("_bag.term").alias("terms"), F.col("_bag.n").cast("array<int>").alias("counts")
        ),
        "lda-docs",
        compression="zstd",
    ).withColumn("scored", F.array_repeat(F.lit(0), F.size("terms")))
    rows = every.drop(key)
    if min_df > 1 or max_vocab is not None:
        vocab = _term_rows(every).groupBy("term").agg(F.count("*").alias("df"), F.sum("counts").alias("cf")).filter(F.col("df") >= min_df)
        if max_vocab is not None:
            vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_vocab)
        rows = materialise(_in_vocabulary(rows.filter(F.size("terms") > 0), vocab), "lda-rows")
    blocks, numbers = _blocks(rows, "lda-blocks")
    n_blocks = max(1, len(numbers))
    words = _owned_words(blocks)
    n_terms = words.count()
    index = _index(words)
    as_holder = index.select(F.col("holder").alias("block"), "owner", "held")
    held = _held(_packed_docs(blocks).drop("row", "scored").withColumn("scored", F.lit(None).cast("binary")).unionByName(as_holder, True), n_blocks)
    owned = _held(index.select(F.col("owner").alias("block"), "holder", "owned"), n_blocks)
    started = _start(words.withColumnRenamed("owner", "block"), k, "block", "owned")
    first = started.groupBy("block").applyInArrow(lambda table: _first_letters(table, k), LETTER)
    add = partial(_added, blocks=numbers, k=k)
    deal = partial(_dealt, n_terms=n_terms, k=k, alpha=alpha, eta=eta, inner=inner)
    letters, stored = _together(owned, first, add, LETTER), None
    for _ in range(iterations if n_terms else 0):
        letters = materialise(_together(owned, _together(held, letters, deal, LETTER), add, LETTER), "lda-letters")
        _forgotten(stored)
        stored = letters
    own = letters.filter((F.col("kind") == "counts") & (F.col("block") == F.col("sender")))
    named = words.select(F.col("owner").alias("block"), "owned", "term")
    words = materialise(_together(named, own, partial(_named, k=k), "term string, counts array<double>"), "lda-words")
    rows_of = _packed_docs(blocks).select("block", "chunk", "row")
    shared = _together(rows_of, letters.filter("kind = 'weights'"), partial(_shares, k=k), "row bigint, _shares array<double>")
    totals = [x or 0.0 for x in _totals(words, k)]
    spread = F.array(*[(F.lit(eta) + F.get("counts", F.lit(i))) / F.lit(n_terms * eta + t) for i, t in enumerate(totals)])
    topic_term = words.select("term", F.posexplode(spread).alias("topic", "weight")).select("topic", "term", "weight")
    equal = F.array_repeat(F.lit(1.0 / k), k)
    shares = materialise(
        every.select(key, "row").join(shared, "row", "left").select(
            key, F.coalesce("_shares", equal).alias("shares"), F.col("_shares").isNotNull().alias("known")
        ),
        "lda-shares",
    )
    for table in (held, owned):
        table.unpersist()
    for table in (stored, index, blocks):
        _forgotten(table)
    doc_topic = shares.select(key, F.posexplode("shares").alias("topic", "weight"))
    return LdaResult(topic_term, doc_topic, shares, words, totals, n_terms, alpha, eta)


# Documents that took no part


def _completed(docs: pa.Table, route: pa.Table, n_terms: int, totals: np.ndarray, alpha: float, eta: float, steps: int) -> pa.Table:
    """Topics of each document from its observed words, and the log-likelihood of the others; unknown words are left out."""
    at = route.column("at").to_numpy()
    k, v = len(totals), int(at.max()) + 1 if len(at) else 0
    known, words = np.zeros(v, bool), np.empty((v, k))
    known[at] = True
    counts_of = route.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, k)
    words[at] = (eta + counts_of) / (n_terms * eta + totals)
    words = np.ascontiguousarray(words.T)
    parts = []
    packed = docs.to_pylist()
    for one, (sizes, places, counts, scored) in zip(packed, _columns(packed)):
        kept = np.flatnonzero(places < v)
        kept = kept[known[places[kept]]]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        row, sizes = np.frombuffer(one["row"], "i8")[sizes > 0], sizes[sizes > 0]
        places, counts, scored = places[kept], counts[kept], scored[kept]
        likelihood = np.zeros(len(sizes))
        for rows, span in _slices(sizes, CELLS // k):
            of_docs = sizes[rows]
            equal = np.full((k, len(of_docs)), 1.0 / k)
            _, weights = _topics_of(places[span], counts[span], of_docs, equal, words, alpha, steps)
            each = scored[span] * np.log((np.repeat(weights, of_docs, axis=1) * words.take(places[span], axis=1)).sum(axis=0))
            likelihood[rows] = np.add.reduceat(each, np.cumsum(of_docs) - of_docs)
        if len(row):
            n_scored = np.add.reduceat(scored, np.cumsum(sizes) - sizes)
            parts.append((row, likelihood, n_scored.astype("i8")))
    schema = _arrow("row bigint, log_likelihood double, n_words bigint")
    if not parts:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(column)) for column in zip(*parts)], schema)


def completion(result: LdaResult, docs: DataFrame, steps: int = 20, key: str = "doc_id") -> DataFrame:
    """``(key, log_likelihood, n_words)`` of documents that took no part in the fit.

    The words at even places of ``tokens`` (from 0) tell a document's topics, in ``steps`` rounds
    with the topics held; those at odd places are scored. Words the fit doesn't know are left
    out of both. A document without a known word has 0 for both numbers.
    """
    even = _bag(F.filter("tokens", lambda w, i: i % 2 == 0))
    odd = _bag(F.filter("tokens", lambda w, i: i % 2 == 1))
    listed = F.concat(
        F.transform(even, lambda b: F.struct(b["term"].alias("term"), b["n"].cast("int").alias("counts"), F.lit(0).alias("scored"))),
        F.transform(odd, lambda b: F.struct(b["term"].alias("term"), F.lit(0).alias("counts"), b["n"].cast("int").alias("scored"))),
    )
    every = materialise(
        docs.select(key, F.monotonically_increasing_id().alias("row"), listed.alias("_both")).select(
            key, "row", *[F.col(f"_both.{old}").alias(new) for old, new in (("term", "terms"), ("counts", "counts"), ("scored", "scored"))]
        ),
        "held-out",
        compression="zstd",
    )
    blocks, _ = _blocks(every.drop(key), "held-out-blocks")
    # A word is in a block once, so none is hot.
    routed = blocks.filter(F.col("term").isNotNull()).select("block", "at", "term").join(result.words, "term").select("block", "at", "counts")
    work = partial(
        _completed, n_terms=result.n_terms, totals=np.array(result.totals), alpha=result.alpha, eta=result.eta, steps=steps
    )
    found = _together(_packed_docs(blocks), routed, work, "row bigint, log_likelihood double, n_words bigint")
    return every.select(key, "row").join(found, "row", "left").select(
        key, F.coalesce("log_likelihood", F.lit(0.0)).alias("log_likelihood"), F.coalesce("n_words", F.lit(0)).alias("n_words")
    )


def perplexity(result: LdaResult, held_out: DataFrame, steps: int = 20, key: str = "doc_id") -> DataFrame:
    """``(n_words, log_likelihood, log_perplexity)`` of the scored words of documents not fitted."""
    sums = completion(result, held_out, steps, key).agg(
        F.sum("n_words").alias("n_words"), F.sum("log_likelihood").alias("log_likelihood")
    )
    return sums.select("n_words", "log_likelihood", (-F.col("log_likelihood") / F.col("n_words")).alias("log_perplexity"))
