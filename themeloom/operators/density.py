"""Density clustering of points in a few dimensions, without distances between pairs.

``linked_groups`` is single linkage at one scale: two points are linked when they share a cell
in one of ``d + 1`` grids of that side, shifted along the diagonal.

``density_clusters`` takes its scales from the data. The extent of the points is halved again
and again, so the cells of all scales form a tree; ``D + 1`` such trees (``D`` the even number
from ``d`` on) are shifted along the diagonal by ``1 / (D + 1)`` of the extent each, which brings
near points into one cell of a size near their distance in at least one of them. Along the
bits of its coordinates, interleaved, every cell of a tree is one run of points, so the links of
a tree at all scales are those between neighbours in that order, each as strong as the finest
cell that holds both. Tasks keep of their links a strongest spanning forest, which joins the same
points at every scale. Going from fine to coarse, groups merge into larger groups by the links of
that scale alone; the tree of merges is then cut where clusters are most stable (excess of mass).

No pair of points is formed but that of neighbours, and copies count once. Every step is a range
sort, an aggregate with map-side combine or a salted lookup, so one huge cluster does not end up
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import vector_function
from themeloom.operators import joins
from themeloom.operators.joins import lookup
from themeloom.session import dense_ids, materialise, materialise_counted, read_stored

OUTLIER = -1
BITS = 40  # of a coordinate, the extent being 1: doubles of this size tell no more apart
FEW_EDGES = 2_000_000  # whose components one task finds sooner than a loop of joins
LINKS_AT_ONCE = 4_000_000  # of which a task keeps a spanning forest


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of ``edges(a, b)``: the smallest id it is connected to.

    Labels form trees that hang from smaller ids. Each round a vertex, and the vertex its
    label names, move to the smallest label two steps up from any neighbour, so whole trees
    move at once and the rounds grow with the logarithm of the longest chain (the scheme
    published as FastSV). Labels only fall and stay inside a component; when none falls, all
    vertices of a component name its smallest id. Up to ``FEW_EDGES`` edges go to one task.
    """
    once, n = materialise_counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if n <= min(FEW_EDGES, joins.PLAIN_ROWS):
        return materialise(once.coalesce(1).mapInArrow(_labels_of_task, "id bigint, label bigint"), "labels")
    both, rows = once.union(once.select("b", "a")), 2 * n
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label"))
    while rows:
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        trees = lookup(labels, up, ["label"], "id", rows)
        around = (
            lookup(both, trees.select(F.col("id").alias("b"), F.col("above").alias("near")), ["b"], "a", rows)
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("near").alias("near"))
        )
        own = trees.join(around, "id")
        pulled = own.groupBy(F.col("label").alias("id")).agg(F.min("near").alias("pull"))
        step = own.join(pulled, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", "above", "near", "pull").alias("label")
        )
        changes = Observation()
        moved = F.count(F.when(F.col("old") != F.col("label"), 1)).alias("moved")
        labels = materialise(step.observe(changes, moved).select("id", "label"), "labels", rows)
        if changes.get["moved"] == 0:
            break
    return labels


def _ends(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the edges' ends in order, and the places of ``a`` and ``b`` among them."""
    ids, at = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    return ids, at[: len(table)], at[len(table) :]


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest vertex each one is connected to, by edges ``(x, y)`` or by its root so far."""
    while True:
        u, w = root[x], root[y]
        apart = u != w
        if not apart.any():
            return root
        x, y, u, w = x[apart], y[apart], u[apart], w[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(u, w), np.minimum(u, w))
        while (root[root] != root).any():
            root = root[root]


def _labels_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if held:
        ids, x, y = _ends(pa.Table.from_batches(held))
        label = ids[_united(np.arange(len(ids)), x, y)]
        yield from pa.table({"id": pa.array(ids), "label": pa.array(label)}).to_batches(100_000)


def _forest(table: pa.Table) -> pa.Table:
    """The links of a spanning forest with the strongest links; what is left out closes a ring of links
    no weaker, so at every level the same points stay connected (Borůvka's rounds)."""
    table = table.sort_by([("level", "descending")])
    ids, x, y = _ends(table)
    root = np.arange(len(ids))
    kept = np.zeros(len(table), bool)
    left = np.arange(len(table))
    while True:
        u, w = root[x[left]], root[y[left]]
        left, u, w = left[u != w], u[u != w], w[u != w]
        if not len(left):
            return table.filter(pa.array(kept))
        # The first link of each group in this order is its strongest; no two are alike, so no ring is closed.
        best = np.full(len(ids), len(table))
        np.minimum.at(best, u, left)
        np.minimum.at(best, w, left)
        chosen = np.unique(best[best < len(table)])
        kept[chosen] = True
        root = _united(root, x[chosen], y[chosen])


def _forest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LINKS_AT_ONCE:
            yield from _forest(pa.Table.from_batches(held)).to_batches(100_000)
            held, rows = [], 0
    if rows:
        yield from _forest(pa.Table.from_batches(held)).to_batches(100_000)


def _atoms(points: DataFrame, coordinates: str, side: float, d: int) -> DataFrame:
    """Add ``atom``: the cell of a point in the grid of side ``side / (d + 1)``."""
    step = side / (d + 1)
    return points.withColumn("atom", F.transform(coordinates, lambda x: F.floor(x / F.lit(step))))


def _links(places: DataFrame, d: int) -> DataFrame:
    """``edges(a, b)`` between groups that share a shifted cell; places = ``(comp, atom)``.

    A cell spans ``(d + 1) ** d`` atoms, so the groups in one cell are bounded in number.
    """
    cells = (
        places.withColumn("_shift", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .select(
            "comp",
            "_shift",
            F.transform("atom", lambda x: F.floor((x + F.col("_shift")) / F.lit(d + 1))).alias("_cell"),
        )
        .distinct()
    )
    first = F.min("comp").over(Window.partitionBy("_shift", "_cell"))
    return (
        cells.withColumn("b", first)
        .filter(F.col("comp") != F.col("b"))
        .select(F.col("comp").alias("a"), "b")
        .distinct()
    )


def _dimension(points: DataFrame, coordinates: str) -> int:
    row = points.filter(F.col(coordinates).isNotNull()).select(F.size(coordinates).alias("d")).head()
    return row["d"] if row else 0


def numbered(members: DataFrame, key: str, group: str, min_size: int, rows: int, *carry: str) -> DataFrame:
    """``(key, topic)`` and ``carry``: groups numbered from 0 by size, then by smallest member.

    No group, or one with fewer than ``min_size`` members, is -1.
    """
    sizes = (
        members.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("n"), F.min(key).alias("first"))
        .filter(F.col("n") >= min_size)
    )
    topics = dense_ids(sizes, [F.desc("n"), F.col("first")], "topic").select(group, F.col("topic").cast("int").alias("topic"))
    return lookup(members, topics, [group], key, rows).select(key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"), *carry)


def linked_groups(points: DataFrame, side: float, min_size: int = 2, key: str = "doc_id", coordinates: str = "reduced") -> DataFrame:
    """``(key, topic)``: the groups at one scale; groups below ``min_size`` points become -1."""
    points = materialise(points.select(key, coordinates), "coordinates")
    d = _dimension(points, coordinates)
    if d == 0:
        return points.select(key, F.lit(OUTLIER).alias("topic"))
    placed = _atoms(points.filter(F.col(coordinates).isNotNull()).select(key, coordinates), coordinates, side, d)
    placed, n_points = materialise_counted(placed.select(key, "atom"), "points")
    items = materialise(placed.groupBy("atom").agg(F.min(key).alias("comp")), "items")
    labels = components(_links(items, d)).withColumnRenamed("id", "comp")
    groups = items.join(labels, "comp", "left").select("atom", F.coalesce("label", "comp").alias("_group"))
    members = materialise(lookup(placed, groups, ["atom"], key, n_points).select(key, "_group"), "members")
    found = numbered(members, key, "_group", min_size, n_points)
    rest = points.filter(F.col(coordinates).isNull()).select(key, F.lit(OUTLIER).alias("topic"))
    return found.unionByName(rest)


def _placed(points: DataFrame, coordinates: str, d: int) -> DataFrame:
    """Add ``atom``: whole coordinates of ``BITS`` bits, the widest dimension spanning them all."""
    at = [F.get(coordinates, F.lit(i)) for i in range(d)]
    bounds = points.agg(*[f(x) for x in at for f in (F.min, F.max)]).head()
    lows = list(bounds[::2])
    extent = max((high - low for low, high in zip(lows, bounds[1::2]) if low is not None), default=0.0) or 1.0
    whole = [F.least(F.floor((x - F.lit(low)) / F.lit(extent) * F.lit(2.0**BITS)), F.lit(2**BITS - 1)) for x, low in zip(at, lows)]
    return points.withColumn("atom", F.array(*[w.cast("bigint") for w in whole]))


def _interleaved(atoms: pa.Array) -> pa.Array:
    """The bits of all coordinates in turn, the highest of each first."""
    n = len(atoms)
    if not n:
        return pa.array([], pa.binary())
    numbers = atoms.flatten().to_numpy(zero_copy_only=False).astype(">u8").reshape(n, -1)
    bits = np.unpackbits(numbers.view("u1").reshape(n, numbers.shape[1], 8), axis=2)[:, :, 63 - BITS :]
    packed = np.packbits(bits.transpose(0, 2, 1).reshape(n, -1), axis=1)
    width = packed.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())


def _code(atom: Column) -> Column:
    return vector_function("binary")(_interleaved)(atom)


def _levels(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The finest level whose cell holds both of two atoms."""
    return (BITS + 1 - np.frexp((one ^ other).max(axis=1).astype("f8"))[1]).astype("i4")


PAIRS = "a bigint, b bigint, level int, tree int, atom array<bigint>, part int"


def _pairs_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of neighbours in a task's rows; ``b`` is null in two more rows, its first (``level`` 0) and last (1)."""
    part = TaskContext.get().partitionId()
    names = [field.split()[0] for field in PAIRS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32()]

    def end(level: int, item: int, tree: int, atom: np.ndarray) -> pa.RecordBatch:
        row = [item, None, level, tree, atom.tolist(), part]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        item, tree = batch.column("item").to_numpy(), batch.column("tree").to_numpy()
        atom = batch.column("atom").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        if last is None:
            yield end(0, item[0], tree[0], atom[0])
        else:
            item, tree, atom = (np.concatenate([x, y]) for x, y in zip(last, (item, tree, atom)))
        level = _levels(atom[:-1], atom[1:])
        kept = (tree[:-1] == tree[1:]) & (level >= 1)
        found = [np.minimum(item[:-1], item[1:])[kept], np.maximum(item[:-1], item[1:])[kept], level[kept]]
        none = [pa.nulls(int(kept.sum()), t) for t in types[3:]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(found, types)), *none], names=names)
        last = item[-1:], tree[-1:], atom[-1:]
    if last is not None:
        yield end(1, last[0][0], last[1][0], last[2][0])


def _neighbours(items: DataFrame, d: int) -> DataFrame:
    """``(a, b, level)``, ``a < b``: neighbours in the order of a tree, and the finest level whose cell holds both.

    Level 1 has cells of the whole extent, each further level cells of half the side. The neighbours
    on two sides of a border between tasks are matched from two rows for each task.
    """
    shifts = 2 * -(-d // 2) + 1
    step = 2**BITS // shifts
    trees = items.select("item", "atom", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("tree"))
    moved = F.transform("atom", lambda x: x + F.col("tree") * F.lit(step)).alias("atom")
    coded = trees.select("item", "tree", moved).withColumn("code", _code(F.col("atom")))
    ordered = coded.orderBy("tree", "code").select("item", "tree", "atom")
    found = materialise(ordered.mapInArrow(_pairs_of_task, PAIRS), "neighbours")
    along = Window.orderBy("part", "level")
    ends = found.filter("b IS NULL").select(
        "level", "tree", "a", "atom", *(F.lead(c).over(along).alias(f"_{c}") for c in ("tree", "a", "atom"))
    )
    differ = F.array_max(F.zip_with("atom", "_atom", lambda x, y: x.bitwiseXOR(y)))
    across = ends.filter("level = 1 AND tree = _tree").select(
        F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b"), (F.lit(BITS + 1) - F.length(F.bin(differ))).alias("level")
    )
    inner = found.filter("b IS NOT NULL").select("a", "b", "level")
    return inner.unionByName(across.filter("level >= 1"))


def _links_of_all_levels(items: DataFrame, d: int) -> tuple[DataFrame, dict[int, int]]:
    """``(a, b, level)`` between items, enough of them to connect what belongs together at each level, and
    how many there are of a level.

    Items are numbered along the first tree, so near ones meet in one task, by their lower and then
    by their higher end.
    """
    links = _neighbours(items, d)
    for end in ("a", "b"):
        links = links.repartitionByRange(end).mapInArrow(_forest_of_task, "a bigint, b bigint, level int")
        links = materialise(links, "links")
    return links, {r["level"]: r["count"] for r in links.groupBy("level").count().collect()}


def _runs(n_links: dict[int, int], most: int) -> list[list[int]]:
    """The levels that have links, the finest first, in runs of at most ``most`` links; a level with more is alone."""
    runs, links = [], 0
    for level in sorted(n_links, reverse=True):
        links += n_links[level]
        if not runs or links > most:
            runs.append([])
            links = n_links[level]
        runs[-1].append(level)
    return runs


def _merges(links: DataFrame, levels: list[int], rows: int, at: DataFrame | None) -> DataFrame:
    """``(level, comp, root)`` of the groups linked at each of these levels, and with level 0 of what each is in after the last.

    ``at`` holds the group each item is in so far, if it isn't itself. A run of levels is gone
    through by one task, a level with too many links by rounds over all of them.
    """
    edges = links.filter(F.col("level").isin(levels))
    for end in ("a", "b") if at is not None else ():
        group = at.select(F.col("item").alias(end), "comp")
        edges = lookup(edges, group, [end], "a", rows).drop(end).withColumnRenamed("comp", end)
    edges = edges.select("a", "b", "level").filter("a <> b")
    if rows <= min(FEW_EDGES, joins.PLAIN_ROWS):
        return materialise(edges.repartition(1).mapInArrow(_merges_of_task, "level int, comp bigint, root bigint"), "merges")
    found = components(edges.select("a", "b")).select(F.col("id").alias("comp"), F.col("label").alias("root"))
    return found.select(F.explode(F.array(F.lit(levels[0]), F.lit(0))).alias("level"), "comp", "root")


def _merges_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, x, y = _ends(table)
    of_link = table["level"].to_numpy()
    root = np.arange(len(ids))

    def rows(level: int, comps: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(np.full(len(comps), level, "i4")), pa.array(ids[comps]), pa.array(ids[root[comps]])]
        yield from pa.table(columns, names=["level", "comp", "root"]).to_batches(100_000)

    for level in np.unique(of_link)[::-1]:
        here = of_link == level
        u, w = root[x[here]], root[y[here]]
        apart = u != w
        root = _united(root, u[apart], w[apart])
        yield from rows(level, np.unique(np.concatenate([u[apart], w[apart]])))
    yield from rows(0, np.arange(len(ids)))


def density_clusters(points: DataFrame, min_size: int = 2, key: str = "doc_id", coordinates: str = "reduced") -> DataFrame:
    """``(key, topic, strength)``: the most stable clusters over all scales; -1 for what is in none.

    A group with ``min_size`` points is a cluster; it lives from the scale where it forms
    until it merges with another cluster, gaining ``points / (2 * side)`` of stability per
    scale. A cluster is kept when that is at least what the clusters inside it gain. The group
    of all points is none. Scales are those of the data: points a hundred times as far apart
    give the same clusters.

    ``strength`` says how early a point belonged: the side at which the cluster formed, over the
    side at which the point came to a cluster; 1 for those in at its start, 0 for outliers.
    """
    points = materialise(points.select(key, coordinates), "coordinates")
    d = _dimension(points, coordinates)
    outlier = [F.lit(OUTLIER).alias("topic"), F.lit(0.0).alias("strength")]
    if d == 0:
        return points.select(key, *outlier)
    placed = _placed(points.filter(F.col(coordinates).isNotNull()).select(key, coordinates), coordinates, d)
    placed, n_points = materialise_counted(placed.select(key, "atom"), "points")
    # The number of items bounds the groups and the clusters.
    items = placed.groupBy("atom").agg(F.count("*").alias("n")).withColumn("code", _code(F.col("atom")))
    items, n_items = materialise_counted(dense_ids(items, [F.col("code")], "item").drop("code"), "items")
    links, n_links = _links_of_all_levels(items, d)
    finest = max(n_links, default=0)

    groups = items.select(
        F.col("item").alias("comp"),
        "n",
        F.lit(None).cast("string").alias("node"),
        F.lit(0.0).alias("stability"),
        F.lit(0.0).alias("inside"),
    )
    n_groups = n_items
    runs = _runs(n_links, min(FEW_EDGES, joins.PLAIN_ROWS))
    merges = at = None
    parts = []
    for step, level in enumerate(range(finest, 0, -1)):
        side = 2.0 ** (1 - level)
        if level not in n_links:  # after the first step every group that is large enough is a cluster
            groups = groups.withColumn("stability", F.when(F.col("n") < min_size, 0.0).otherwise(F.col("stability") + _gain(side)))
            continue
        if runs and level == runs[0][0]:
            if merges is not None:
                at = items.select("item", F.col("item").alias("comp")) if at is None else at
                around = lookup(at, merges.filter("level = 0").drop("level"), ["comp"], "item", n_items)
                at = materialise(around.select("item", F.coalesce("root", "comp").alias("comp")), "at", n_items)
            run = runs.pop(0)
            merges = _merges(links, run, sum(n_links[x] for x in run), at)
        merged = merges.filter(F.col("level") == level).drop("level")
        joined = groups.join(merged, "comp", "left").withColumn("root", F.coalesce("root", "comp"))
        grown, n_groups = materialise_counted(_grown(joined, step, side, min_size), "groups", n_groups)
        # A group that merged with none has no branch but for its start. Stored at each step: what all
        # steps left unread would be one plan that grows with their number.
        changed, most = (joined, n_items) if step == 0 else (groups.join(merged, "comp"), 2 * n_links[level])
        now_in = grown.select(F.col("comp").alias("root"), F.col("node").alias("parent"))
        parts.append(materialise(_branches(lookup(changed, now_in, ["root"], "comp", most), step), "branches", most))
        groups = grown
        if n_groups == 1:
            break

    # What is left at the coarsest scale; a group that holds everything is no cluster.
    left_over = groups.withColumn("root", F.lit(None).cast("bigint")).withColumn("parent", F.lit(None).cast("string"))
    tree = _branches(left_over, finest).withColumn("kept", F.col("kept") & F.lit(n_groups > 1))
    if parts:
        tree = tree.unionByName(read_stored(parts))
    chosen = _topmost(tree, finest + 1, 2 * n_items)
    born = F.split("cluster", ":")[0].cast("int")
    strength = F.pow(F.lit(2.0), -F.greatest(F.col("joined") - born, F.lit(0)).cast("double"))
    atoms = items.select("atom", _lone(F.col("item")).alias("node")).join(chosen, "node").select("atom", "cluster", strength.alias("strength"))
    members = materialise(lookup(placed, atoms, ["atom"], key, n_points).select(key, "cluster", "strength"), "members")
    rest = points.filter(F.col(coordinates).isNull()).select(key, *outlier)
    found = numbered(members, key, "cluster", min_size, n_points, "strength")
    return found.withColumn("strength", F.when(F.col("topic") == OUTLIER, 0.0).otherwise(F.col("strength"))).unionByName(rest)


def _lone(comp: Column) -> Column:
    """The tree's name for a group too small to be a cluster."""
    return F.concat(F.lit("."), comp.cast("string"))


def _branches(joined: DataFrame, step: int) -> DataFrame:
    """``(node, parent, kept, joined)`` of the groups that became part of another one at some scale.

    ``joined`` holds the groups before, with the ``root`` they are now in and its cluster; the
    column ``joined`` is the step at which a group came to a cluster.
    """
    return joined.select(
        F.coalesce("node", _lone(F.col("comp"))).alias("node"),
        F.coalesce("parent", _lone(F.col("root"))).alias("parent"),
        (F.col("node").isNotNull() & (F.col("stability") >= F.col("inside"))).alias("kept"),
        F.when(F.col("parent").isNotNull(), F.lit(step)).alias("joined"),
    ).filter(F.col("parent").isNull() | (F.col("node") != F.col("parent")))


def _gain(side: float) -> Column:
    """What a cluster gains in stability at a scale."""
    return F.col("n") * F.lit(1 / (2 * side))


def _grown(joined: DataFrame, level: int, side: float, min_size: int) -> DataFrame:
    """The groups after a merge, with the cluster each one stands for."""
    is_cluster = F.col("node").isNotNull()
    merged = joined.groupBy(F.col("root").alias("comp")).agg(
        F.sum("n").alias("n"),
        F.count("node").alias("_clusters"),
        F.max("node").alias("_node"),
        F.sum("stability").alias("_stability"),
        F.sum("inside").alias("_inside"),
        F.sum(F.when(is_cluster, F.greatest("stability", "inside")).otherwise(0.0)).alias("_best"),
    )
    goes_on = F.col("_clusters") == 1
    born = F.concat_ws(":", F.lit(level), F.col("comp"))
    gain = _gain(side)
    return merged.select(
        "comp",
        "n",
        F.when(goes_on, F.col("_node")).when(F.col("n") >= min_size, born).alias("node"),
        F.when(F.col("n") < min_size, 0.0)
        .when(goes_on, F.col("_stability") + gain)
        .otherwise(gain)
        .alias("stability"),
        F.when(goes_on, F.col("_inside")).otherwise(F.col("_best")).alias("inside"),
    )


def _topmost(tree: DataFrame, levels: int, rows: int) -> DataFrame:
    """``(node, cluster, joined)``: the highest kept cluster among a node and the ones around it, and the
    step at which the node came to any."""
    found = materialise(
        tree.select("node", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("node")).alias("cluster"), "joined"), "tree"
    )
    reach = 1
    while reach <= levels:
        above = found.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("cluster").alias("_cluster"), F.col("joined").alias("_joined")
        )
        found = materialise(
            lookup(found, above, ["up"], "node", rows).select(
                "node", F.col("_up").alias("up"), F.coalesce("_cluster", "cluster").alias("cluster"),
                F.coalesce("joined", "_joined").alias("joined"),
            ),
            "tree",
        )
        reach *= 2
    return found.select("node", "cluster", "joined")
