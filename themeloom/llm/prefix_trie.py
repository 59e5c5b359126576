"""The trie of conversation prefixes: padded matrices of turn ids, sorted and cut by column.

A turn is known by 16 bytes of the digest of its role and text. Conversations are cut into
blocks of ``WIDTH`` turns; the conversations of a block are dealt by ranges of their turn ids to
shards of about ``ROWS_PER_SHARD``. A shard is a matrix with a row for each conversation and a
column for each depth, padded behind short ones. Its rows are sorted (``numpy.lexsort``); the
places where a column differs from the row above are or-ed from left to right, and what is then
set marks the first row of a node. ``reduceat`` over these rows gives members, children, leaves
and saved bytes of all nodes of a depth at once.

A node can lie in several shards only if it holds a shard's first or last row. These nodes,
two paths a shard, are added up by their path's digest: members and sums as they are; what each
shard counted anew (a shared child, the bytes of a shared turn, a leaf) is taken off once for
each further shard, in the node and all above it. All other nodes are final in their shard.

A later block only takes conversations that share their whole past with another one, so the
number of blocks follows the longest common prefix; the rest of a conversation that shares it
with no one is a plain chain, written down without sorting. Blocks are worked through from the
last to the first, and what hangs below a block's last column enters it with one row. So no task
holds a whole conversation, nor all copies of one: the rows of a shard are bounded, and ranges go
on by ``conv_id`` within copies.

Turns are ordered by ``turn``, null first, ties by digest. A null role or text is an empty one.
Rows without ``conv_id`` are no conversation. Repeated rows are repeated turns. Texts are only
digested and measured, whatever their length. An empty table has no node, not even a root.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import full_text, utf8_crc32
from themeloom.operators.joins import lookup, small_lookup
from themeloom.session import dense_ids, materialise, materialise_counted

WIDTH = 32  # turns of a block; a row's sort key is 16 bytes for each and 16 for what came before
ROWS_PER_SHARD = 8_192
IDS_PER_BLOCK = 1_024  # member ids joined to one piece of text before hashing
ENDS_PER_TASK = 100_000
ID_BYTES = 16

NODE, END = 0, 1
PARTS = (
    "kind int, node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint,"
    " n_children bigint, n_leaves bigint, saved bigint, size bigint, childless boolean, line array<binary>"
)
COUNTS = ("n_convs", "n_children", "n_leaves", "saved")


@dataclass
class Trie:
    nodes: DataFrame  # conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved
    ends: DataFrame  # member, conv_id, depth: the node at which each conversation ends


# Turns in order


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, n, id, size)``: the turns of each conversation numbered from 0, and their number."""
    role, text = full_text("role"), full_text("text")
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(F.encode(content, "UTF-8"), 256)), 1, ID_BYTES).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("id")]
    # One order over all rows and an offset for each conversation: a conversation may be of any length.
    ordered = materialise(dense_ids(turns, order, "place").drop("turn"), "turns")
    whole = ordered.groupBy("conv_id").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    both = lookup(ordered, whole, ["conv_id"], "place")
    return both.select("conv_id", (F.col("place") - F.col("begin")).alias("at"), "n", "id", "size")


def sharing_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of the first of each ``every``: ``(turns, everyone)``.

    Conversation c gets the first h turns of c - c mod ``every`` (all if fewer, none if there is
    no such conversation), then its own behind its first h; h is crc32 of c mod ``most``.
    """
    turns = materialise(turns, "numbered")
    head = F.pmod(utf8_crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    convs = turns.filter("at = 0").select("conv_id", "n", head.alias("h"), base.alias("base"))
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = materialise(
        convs.join(bases, "base", "left").select(
            "conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
        ),
        "heads",
    )
    own = lookup(turns, convs, ["conv_id"], "at").filter("at >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "id", "size")
    lent = turns.filter((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("at") < most - 1)).withColumn(
        "conv_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + every - 1))
    )
    lent = lent.join(convs, "conv_id").filter("at < h").select("conv_id", "at", "id", "size")
    return own.unionByName(lent), convs.select("conv_id")


# One shard


def _dense(ids: np.ndarray) -> np.ndarray:
    """Numbers of 16-byte ids in the order of their bytes."""
    high, low = ids[:, 0], ids[:, 1]
    order = np.lexsort((low, high))
    new = np.ones(len(ids), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(len(ids), "i8")
    out[order] = np.cumsum(new) - 1
    return out


def _path_id(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:ID_BYTES]


def _column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])


def shard_nodes(batches: list[pa.RecordBatch], first_depth: int) -> pa.RecordBatch:
    """Nodes and ends of the conversations of one shard; ``first_depth`` is that of column 0."""
    keys = [k for b in batches for k in b.column("key").to_pylist()]
    conv = _column(batches, "conv_id")
    more = _column(batches, "more").astype(bool)
    below = {name: _column(batches, name) for name in ("below_children", "below_leaves", "below_saved")}
    sizes = np.concatenate([b.column("sizes").flatten().to_numpy(zero_copy_only=False) for b in batches])
    n = len(keys)
    lens = np.array([len(k) // ID_BYTES for k in keys])
    width = int(lens.max())
    filled = np.arange(width) < lens[:, None]
    ids = np.full((n, width), -1, "i8")
    ids[filled] = _dense(np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype("u8"))
    weight = np.zeros((n, width), "i8")
    weight[:, 1:][filled[:, 1:]] = sizes  # column 0 is the past, whose bytes count in the block before

    order = np.lexsort((conv, *ids.T[::-1]))
    ids, weight, conv, more, lens = ids[order], weight[order], conv[order], more[order], lens[order]
    below = {name: values[order] for name, values in below.items()}
    last = lens - 1
    changed = np.ones((n, width), bool)
    changed[1:] = ids[1:] != ids[:-1]
    real = ids >= 0
    start = np.logical_or.accumulate(changed, axis=1) & real
    # Bytes that a row shares with the row above, from each column on, and what is saved below the block.
    shared = np.where(real & ~start, weight, 0)
    shared = np.cumsum(shared[:, ::-1], axis=1)[:, ::-1] + below["below_saved"][:, None]

    rows_of = [np.flatnonzero(real[:, j]) for j in range(width)]
    starts_of = [np.flatnonzero(start[rows, j]) for j, rows in enumerate(rows_of)]
    leaf = below["below_leaves"].astype("i8")
    deeper_of = []
    for j, (rows, starts) in enumerate(zip(rows_of, starts_of)):
        deeper = np.logical_or.reduceat((last[rows] > j) | more[rows], starts)
        deeper_of.append(deeper)
        leaf[rows[starts[~deeper]]] += 1

    edge = {k: [_path_id(keys[order[row]][: ID_BYTES * (j + 1)]) for j in range(lens[row])] for k, row in ((1, 0), (2, n - 1))}
    out: dict[str, list] = {name.split()[0]: [] for name in PARTS.split(", ")}
    opened, smallest = np.zeros(n, "i1"), np.zeros(n, "i8")  # of the node in the column before, for each row
    for j, (rows, starts, deeper) in enumerate(zip(rows_of, starts_of, deeper_of)):
        first = rows[starts]
        members = np.diff(np.append(starts, len(rows)))
        least = np.minimum.reduceat(conv[rows], starts)
        children = start[rows, j + 1].astype("i8") if j + 1 < width else np.zeros(len(rows), "i8")
        children = children + np.where(last[rows] == j, below["below_children"][rows], 0)
        on_edge = np.zeros(len(first), "i1")
        if real[n - 1, j]:
            on_edge[-1] = 2
        if real[0, j]:
            on_edge[0] = 1
        parents = [None] * len(first) if j == 0 else [edge[k][j - 1] if k else None for k in opened[first]]
        above = [None] * len(first) if j == 0 else [None if k else int(c) for k, c in zip(opened[first], smallest[first])]
        out["kind"] += [NODE] * len(first)
        out["node"] += [edge[k][j] if k else None for k in on_edge]
        out["parent"] += parents
        out["depth"] += [first_depth + j] * len(first)
        out["conv_id"] += least.tolist()
        out["parent_conv_id"] += above
        out["n_convs"] += members.tolist()
        out["n_children"] += np.add.reduceat(children, starts).tolist()
        out["n_leaves"] += np.add.reduceat(leaf[rows], starts).tolist()
        out["saved"] += np.add.reduceat(shared[rows, j], starts).tolist()
        out["size"] += weight[first, j].tolist()
        out["childless"] += (~deeper).tolist()
        out["line"] += [edge[k][: j + 1] if k else None for k in on_edge]

        opened[rows], smallest[rows] = np.repeat(on_edge, members), np.repeat(least, members)
        ended = rows[(last[rows] == j) & ~more[rows]]
        out["kind"] += [END] * len(ended)
        out["node"] += [edge[k][j] if k else None for k in opened[ended]]
        out["depth"] += [first_depth + j] * len(ended)
        out["conv_id"] += conv[ended].tolist()
        out["parent_conv_id"] += smallest[ended].tolist()
        for name in ("parent", *COUNTS, "size", "childless", "line"):
            out[name] += [None] * len(ended)
    types = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    arrays = [pa.array(out[name], types[kind]) for name, kind in (x.split() for x in PARTS.split(", "))]
    return pa.RecordBatch.from_arrays(arrays, list(out))


def _sharded(rows: DataFrame, n: int, first_depth: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield shard_nodes(held, first_depth)

    named = ("key", "conv_id", "sizes", "more", "below_children", "below_leaves", "below_saved")
    shards = rows.select(*named).repartitionByRange(-(-n // ROWS_PER_SHARD), "key", "conv_id")
    return shards.mapInArrow(work, PARTS)


# Shards recombined


def _recombined(open_parts: DataFrame) -> DataFrame:
    """Nodes of several shards, one row each with their path's digest."""
    merged = open_parts.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.first("size").alias("size"),
        F.first("line").alias("line"),
        (F.count("*") - 1).alias("again"),
        (F.bool_and("childless").cast("bigint") - F.sum(F.col("childless").cast("bigint"))).alias("leaf_again"),
    )
    merged = materialise(merged, "edges")
    counted_again = (
        merged.filter("again > 0")
        .select(F.explode("line").alias("at"), "node", "parent", "again", "size", "leaf_again")
        .groupBy(F.col("at").alias("node"))
        .agg(
            F.sum(F.when(F.col("at") == F.col("parent"), F.col("again")).otherwise(0)).alias("_children"),
            F.sum("leaf_again").alias("_leaves"),
            F.sum(F.col("again") * F.col("size")).alias("_saved"),
        )
    )
    none = F.lit(0)
    return merged.join(counted_again, "node", "left").select(
        "node",
        "parent",
        "depth",
        "conv_id",
        "n_convs",
        (F.col("n_children") - F.coalesce("_children", none)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("_leaves", none)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", none)).alias("saved"),
    )


def _block(rows: DataFrame, n: int, first_depth: int) -> tuple[DataFrame, DataFrame]:
    """Final nodes of a block, those of column 0 among them, and where its conversations end."""
    parts = materialise(_sharded(rows, n, first_depth), "shards")
    nodes, ends = parts.filter(F.col("kind") == NODE), parts.filter(F.col("kind") == END)
    edges = materialise(_recombined(nodes.filter(F.col("node").isNotNull())), "edge-nodes")
    known = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    inner = nodes.filter(F.col("node").isNull()).select("parent", "depth", "conv_id", "parent_conv_id", *COUNTS)
    both = inner.unionByName(edges.drop("node").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    named = small_lookup(both, known, ["parent"], "conv_id", "edge-names")
    finished = named.select("conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), *COUNTS)
    on_edge = edges.select("node", F.col("conv_id").alias("_at"))
    found = small_lookup(ends.select("node", "depth", "conv_id", "parent_conv_id"), on_edge, ["node"], "conv_id", "edge-ends")
    return finished, found.select(
        F.col("conv_id").alias("member"), F.coalesce("_at", "parent_conv_id").alias("conv_id"), "depth"
    )


# Blocks


def _joined(ids: Column) -> Column:
    return F.aggregate(ids, F.unhex(F.lit("")), lambda whole, one: F.concat(whole, one))


def _two_words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(2)]


def _word(number: str) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def _later_blocks(segments: DataFrame) -> DataFrame:
    """Blocks from the second on, with the digest of all before and whether another conversation shares it."""
    later = segments.filter(F.col("n") >= WIDTH)
    digest = F.sha2(F.concat(F.encode(F.col("block").cast("string"), "UTF-8"), F.lit(b":"), F.col("ids")), 256)
    words = later.select("*", *[w.alias(f"_w{i}") for i, w in enumerate(_two_words(digest))])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Bitwise sums over digests that hold their place: added up as the window moves, nothing is gathered.
    pasts = words.select(
        "*", *[F.expr(f"bit_xor(_w{i})").over(before).alias(f"_p{i}") for i in range(2)]
    ).filter("block > 0")
    pasts = materialise(
        pasts.select("conv_id", "block", "n", "ids", "sizes", F.unhex(F.concat(_word("_p0"), _word("_p1"))).alias("past")), "blocks"
    )
    held = pasts.groupBy("block", "past").agg(F.count("*").alias("_held"))
    with_count = lookup(pasts, held, ["block", "past"], "conv_id")
    return materialise(with_count.withColumn("shares", F.col("_held") > 1).drop("_held"), "later-blocks")


def _chains(lone: DataFrame) -> DataFrame:
    """Nodes of turns that no other conversation has come to."""
    at = F.posexplode("sizes").alias("k", "_size")
    depth = F.col("block") * WIDTH + F.col("k") + 1
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return lone.select("conv_id", "block", "n", at).select(
        "conv_id",
        depth.alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(depth < F.col("n"), one).otherwise(none).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved"),
    )


def prefix_trie(turns: DataFrame, everyone: DataFrame) -> Trie:
    """The trie over ``turns(conv_id, at, id, size)``, ``at`` gapless from 0; ``everyone(conv_id)`` names
    all conversations once, also those without a turn."""
    block = F.floor(F.col("at") / WIDTH).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("at", "id", "size")))
    segments = turns.groupBy("conv_id", block.alias("block")).agg(listed.alias("_turns"))
    segments = segments.select("conv_id", "block", _joined(F.col("_turns.id")).alias("ids"), F.col("_turns.size").alias("sizes"))
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    # A conversation that fills its last block ends in the next one, with those that share all of it.
    full = lengths.filter(F.col("n") % WIDTH == 0).select(
        "conv_id", F.floor(F.col("n") / WIDTH).cast("bigint").alias("block"), F.unhex(F.lit("")).alias("ids"),
        F.array().cast("array<bigint>").alias("sizes"),
    )
    segments = segments.unionByName(full)
    segments, _ = materialise_counted(lookup(segments, lengths, ["conv_id"], "block"), "segments")
    opening = everyone.select("conv_id").join(segments.filter("block = 0"), "conv_id", "left")
    opening, n = materialise_counted(
        opening.select(
            "conv_id",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("ids", F.unhex(F.lit(""))).alias("ids"),
            F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"),
            F.unhex(F.lit("00" * ID_BYTES)).alias("past"),
        ),
        "openings",
    )
    counts = {name: F.lit(0).cast("bigint") for name in ("below_children", "below_leaves", "below_saved")}
    if n == 0:
        empty = opening.select(
            "conv_id", F.col("n").alias("depth"), F.col("conv_id").alias("parent_conv_id"), *[F.col("n").alias(c) for c in COUNTS]
        )
        return Trie(empty, opening.select(F.col("conv_id").alias("member"), "conv_id", F.col("n").alias("depth")))

    finished: list[DataFrame] = []
    ended: list[DataFrame] = []
    below: DataFrame | None = None  # for each conversation that goes on: what its row brings to the block before
    if opening.filter(F.col("n") >= WIDTH).head() is not None:
        later = _later_blocks(segments)
        lone = later.filter(~F.col("shares"))
        finished.append(_chains(lone))
        ended.append(
            lone.filter(F.col("n") < (F.col("block") + 1) * WIDTH).select(
                F.col("conv_id").alias("member"), "conv_id", F.col("n").alias("depth")
            )
        )
        shared = later.filter("shares")
        sizes = {r["block"]: r["rows"] for r in shared.groupBy("block").agg(F.count("*").alias("rows")).collect()}
        goes_on = (F.size("sizes") > 0).cast("bigint")
        alone = lone.select(
            "conv_id", "block", *[x.cast("bigint").alias(c) for c, x in zip(counts, (goes_on, F.lit(1), F.lit(0)))]
        )
        for k in range(max(sizes, default=0), 0, -1):
            here = shared.filter(F.col("block") == k)
            nodes, ends = _block(_with_below(here, alone, below, k), sizes[k], k * WIDTH)
            nodes = materialise(nodes, "block-nodes")
            finished.append(nodes.filter(F.col("depth") > k * WIDTH))
            ended.append(ends)
            below = nodes.filter(F.col("depth") == k * WIDTH).select(
                "conv_id", *[F.col(c).alias(name) for c, name in zip(COUNTS[1:], counts)]
            )
        opening = _with_below(opening, alone, below, 0)
    else:
        opening = _with_below(opening, None, None, 0)
    nodes, ends = _block(opening, n, 0)
    finished.append(nodes)
    ended.append(ends)
    return Trie(reduce(DataFrame.unionByName, finished), reduce(DataFrame.unionByName, ended))


def _with_below(rows: DataFrame, alone: DataFrame | None, below: DataFrame | None, block: int) -> DataFrame:
    """Rows of a block as a shard takes them: the key of their past and turns, and what follows the block."""
    names = ("below_children", "below_leaves", "below_saved")
    hanging = [] if alone is None else [alone.filter(F.col("block") == block + 1).select("conv_id", *names)]
    hanging += [] if below is None else [below.select("conv_id", *names)]
    if hanging:
        rows = rows.join(reduce(DataFrame.unionByName, hanging), "conv_id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        F.concat("past", "ids").alias("key"),
        "conv_id",
        "sizes",
        (F.col("n") >= (block + 1) * WIDTH).alias("more"),
        *[(F.coalesce(name, zero) if hanging else zero).alias(name) for name in names],
    )


# Digests of the members that end at a node


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)``: SHA-256 of the members' decimal ids, ascending, comma-joined.

    Ids are sorted and written out in ranges, whatever their nodes; a hash is a sequence by
    nature, so the pieces of one node then pass through one task, one after the other.
    """
    ends, n = materialise_counted(ends, "ends")
    order = ["conv_id", "depth", "member"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in order)
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])
            begins = np.flatnonzero(new)
            cuts = [c for b, e in zip(begins, np.append(begins[1:], len(conv))) for c in range(b, e, IDS_PER_BLOCK)]
            text = [",".join(map(str, member[b:e].tolist())) for b, e in zip(cuts, [*cuts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[cuts]), pa.array(depth[cuts]), pa.array(member[cuts]), pa.array(text, pa.string())], [*order, "text"]
            )

    ranges = ends.select(*order).repartitionByRange(-(-max(1, n) // ENDS_PER_TASK), *order).sortWithinPartitions(*order)
    written = ranges.mapInArrow(pieces, "conv_id bigint, depth bigint, member bigint, text string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text"))):
                if (conv, depth) == at:
                    running.update(b",")
                else:
                    if at is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = (conv, depth), hashlib.sha256()
                running.update(text.encode())
            yield _digest_rows(done)
        if at is not None:
            yield _digest_rows([(*at, running.hexdigest())])

    gathered = written.repartition("conv_id", "depth").sortWithinPartitions(*order)
    return gathered.mapInArrow(hashed, "conv_id bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "depth", "ends_sha256"])


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of all conversations, each rebuilt on the head of the first of its five."""
    turns, everyone = sharing_heads(numbered_turns(spark.read.parquet(f"{folder}/conversations.parquet")))
    trie = prefix_trie(turns, everyone)
    nothing = hashlib.sha256(b"").hexdigest()
    return trie.nodes.join(ends_digests(trie.ends), ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


OP11_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
whole AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS own,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h
  FROM turns GROUP BY conv_id
),
rebuilt AS (
  SELECT w.conv_id, list_concat(CASE WHEN b.conv_id IS NULL OR w.h = 0 THEN [] ELSE b.own[1:w.h] END, w.own[w.h + 1:]) AS turns
  FROM whole w LEFT JOIN whole b ON b.conv_id = w.conv_id - (w.conv_id % 5 + 5) % 5
),
paths AS (
  SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].t) END AS size
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, max(n) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
),
below AS (
  SELECT p.path, p.depth, sum((w.n_convs - 1) * w.size) AS saved, count(*) FILTER (w.leaf) AS n_leaves,
    count(*) FILTER (w.depth = p.depth + 1) AS n_children
  FROM paths p JOIN nodes w ON w.conv_id = p.conv_id AND w.depth >= p.depth GROUP BY p.path, p.depth
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.path = v.path AND b.depth = v.depth
LEFT JOIN nodes u ON u.depth = v.depth - 1 AND v.depth > 0 AND u.path = v.path[1:v.depth - 1]
"""
