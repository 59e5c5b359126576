"""Clustering against brute force: union-find over all pairs, on small fixtures."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from themeloom.operators import density, joins
from themeloom.session import materialise


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(params=["plain", "salted"])
def any_join(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(joins, "PLAIN_ROWS", -1)


def labels(spark, edges):
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    return {r["id"]: r["label"] for r in density.components(frame).collect()}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, any_join, shape):
    rng = random.Random(5)
    edges = {
        "chain": [(i, i + 1) for i in range(200)] + [(500, 501)],
        "star": [(1000, i) for i in range(300)] + [(2000, 2001)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[shape]
    edges = [(a, b) for a, b in edges if a != b]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    assert labels(spark, edges) == {x: sets.find(x) for e in edges for x in e}


def test_components_of_nothing(spark):
    assert labels(spark, []) == {}


def cells_of(point, side):
    d = len(point)
    atom = [math.floor(x / (side / (d + 1))) for x in point]
    return {(s, tuple((a + s) // (d + 1) for a in atom)) for s in range(d + 1)}


def groups_at(points, side, sets=None):
    """All pairs are compared; points sharing a shifted cell are one group."""
    sets = sets or Sets()
    cells = {k: cells_of(p, side) for k, p in points.items()}
    for a, b in itertools.combinations(points, 2):
        if cells[a] & cells[b]:
            sets.join(a, b)
    out = defaultdict(set)
    for k in points:
        out[sets.find(k)].add(k)
    return list(out.values()), sets


def numbered(clusters, points, min_size=2):
    topics = {k: -1 for k in points}
    kept = sorted((c for c in clusters if len(c) >= min_size), key=lambda c: (-len(c), min(c)))
    for i, members in enumerate(kept):
        topics.update({k: i for k in members})
    return topics


def whole(points):
    lows = [min(x) for x in zip(*points.values())]
    extent = max(max(x) - min(x) for x in zip(*points.values())) or 1.0
    return {k: [min(math.floor((x - low) / extent * 2.0**40), 2**40 - 1) for x, low in zip(p, lows)] for k, p in points.items()}


def pair_levels(points):
    """For every pair the finest level at which a cell of one of the shifted trees holds both."""
    placed = whole(points)
    shifts = 2 * math.ceil(len(next(iter(points.values()))) / 2) + 1
    step = 2**40 // shifts
    return {
        (a, b): max(
            41 - max(((x + s * step) ^ (y + s * step)).bit_length() for x, y in zip(placed[a], placed[b])) for s in range(shifts)
        )
        for a, b in itertools.combinations(points, 2)
    }


def stable_clusters(points, min_size):
    """The merge tree as nested Python objects, then the best cut of it: (members, {member: strength})."""
    levels = pair_levels(points)
    finest = max([level for level in levels.values() if level <= 40], default=0)
    live = {}  # group -> cluster
    groups = []
    came = {}  # point -> side at which it came to a cluster
    for level in range(finest, 0, -1):
        side = 2.0 ** (1 - level)
        sets = Sets()
        for (a, b), shared in levels.items():
            if shared >= level:
                sets.join(a, b)
        found = defaultdict(set)
        for k in points:
            found[sets.find(k)].add(k)
        groups = list(found.values())
        new = {}
        for members in groups:
            inside = [c for g, c in live.items() if set(g) <= members]
            gain = len(members) / (2 * side)
            if len(members) < min_size:
                continue
            for k in members:
                came.setdefault(k, side)
            if len(inside) == 1:
                cluster = inside[0]
                cluster["stability"] += gain
                cluster["members"] = members
            else:
                cluster = {"stability": gain, "members": members, "inside": inside, "born": side}
            new[frozenset(members)] = cluster
        live = new
        if len(groups) == 1:
            break

    def best(cluster):
        parts = [best(c) for c in cluster["inside"]]
        below = sum(p[0] for p in parts)
        if cluster["stability"] >= below:
            return cluster["stability"], [cluster]
        return below, [m for p in parts for m in p[1]]

    chosen = []
    for cluster in live.values():
        if len(groups) > 1:
            chosen += best(cluster)[1]
        else:
            chosen += [m for c in cluster["inside"] for m in best(c)[1]]
    strength = {k: 0.0 for k in points}
    for c in chosen:
        strength.update({k: c["born"] / max(came[k], c["born"]) for k in c["members"]})
    return [c["members"] for c in chosen], strength


def cloud(seed, d=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, size=(4, d))
    rows = [centres[i % 4] + rng.normal(scale=[0.01, 0.03, 0.05, 0.15][i % 4], size=d) for i in range(60)]
    rows += [rows[0]] * 25 + [rng.uniform(-1, 1, size=d) for _ in range(15)]
    return {i + 1: tuple(float(x) for x in p) for i, p in enumerate(rows)}


def frame(spark, points, extra=()):
    rows = [(k, list(p)) for k, p in points.items()] + [(k, None) for k in extra]
    return spark.createDataFrame(rows, "doc_id bigint, reduced array<double>").repartition(4)


@pytest.mark.parametrize("side", [0.05, 0.3])
def test_groups_at_one_scale(spark, any_join, side):
    points = cloud(1)
    found = {r["doc_id"]: r["topic"] for r in density.linked_groups(frame(spark, points, [500]), side).collect()}
    assert found == {**numbered(groups_at(points, side)[0], points), 500: -1}


def clustered(spark, points, min_size=2, extra=()):
    rows = density.density_clusters(frame(spark, points, extra), min_size).collect()
    assert len(rows) == len(points) + len(extra)
    return {r["doc_id"]: r["topic"] for r in rows}, {r["doc_id"]: r["strength"] for r in rows}


@pytest.mark.parametrize("seed, d, min_size", [(2, 3, 2), (3, 2, 5)])
def test_stable_clusters(spark, seed, d, min_size):
    points = cloud(seed, d)
    topics, strength = clustered(spark, points, min_size, [500])
    groups, expected = stable_clusters(points, min_size)
    assert topics == {**numbered(groups, points, min_size), 500: -1}
    assert strength == pytest.approx({**expected, 500: 0.0})
    assert len(set(topics.values())) > 2
    for topic in set(topics.values()) - {-1}:
        assert max(strength[k] for k, t in topics.items() if t == topic) == 1.0


def test_stable_clusters_salted(spark, monkeypatch):
    monkeypatch.setattr(joins, "PLAIN_ROWS", -1)
    points = cloud(4)
    topics, _ = clustered(spark, points)
    assert topics == numbered(stable_clusters(points, 2)[0], points)


def test_links_are_not_repeated_for_each_scale(spark, monkeypatch):
    """Many tasks, so that neighbours lie on both sides of their borders; links kept a few at a time."""
    rows = []

    def counted(df, name, *more):
        stored, n = joins.materialise_counted(df, name, *more)
        rows.append((name, n))
        return stored, n

    monkeypatch.setattr(density, "materialise_counted", counted)
    monkeypatch.setattr(density, "LINKS_AT_ONCE", 50, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = cloud(6, 3)
        topics, _ = clustered(spark, points)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert topics == numbered(stable_clusters(points, 2)[0], points)
    assert sum(n for name, n in rows if name == "edges") < 3 * len(points)


def test_runs_of_levels():
    assert density._runs({9: 5, 7: 6, 6: 1, 4: 30, 3: 2, 1: 2}, 11) == [[9, 7], [6], [4], [3, 1]]
    assert density._runs({2: 5, 1: 1}, -1) == [[2], [1]] and density._runs({}, 5) == []


@pytest.mark.parametrize("few", [10, 60])
def test_runs_find_what_levels_find(spark, monkeypatch, few):
    monkeypatch.setattr(density, "FEW_EDGES", few)
    points = cloud(7, 3)
    topics, strength = clustered(spark, points)
    groups, expected = stable_clusters(points, 2)
    assert topics == numbered(groups, points) and strength == pytest.approx(expected)


def test_levels_cost_the_driver_little(spark, monkeypatch):
    """Few links need no rounds for each level, and the tree is read from what the levels stored, not from one plan of them all."""
    scans = []

    def counted(df, name, *more, **options):
        if name == "tree":
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return materialise(df, name, *more, **options)

    monkeypatch.setattr(density, "materialise", counted)
    monkeypatch.setattr(density, "components", None)
    points = cloud(6, 3)
    topics, _ = clustered(spark, points)
    assert topics == numbered(stable_clusters(points, 2)[0], points)
    assert max(scans) <= 2


def test_scale_is_that_of_the_data(spark):
    points = cloud(5)
    found = clustered(spark, points)
    for factor in (2.0**-7, 2.0**7):
        assert clustered(spark, {k: tuple(x * factor + 0.0 for x in p) for k, p in points.items()}) == found


def test_linked_points_are_near_and_near_points_linked(spark):
    """What the rule promises about distances, on the groups of two points."""
    rng = random.Random(2)
    side, d = 0.3, 3
    for _ in range(300):
        a = [rng.uniform(-1, 1) for _ in range(d)]
        b = [x + rng.uniform(-0.4, 0.4) for x in a]
        apart = max(abs(x - y) for x, y in zip(a, b))
        linked = bool(cells_of(a, side) & cells_of(b, side))
        if linked:
            assert apart < side
    assert density.linked_groups(frame(spark, {1: (0.0, 0.0), 2: (5.0, 5.0)}), 0.3).filter("topic <> -1").isEmpty()


@pytest.mark.parametrize("points", [{1: (0.0, 0.0), 2: (7.0, 1.0)}, {i: (3.0, 4.0) for i in range(6)}, {1: (1.0,)}])
def test_one_group_of_all_is_no_cluster(spark, points):
    topics, strength = clustered(spark, points)
    assert set(topics.values()) == {-1} and set(strength.values()) == {0.0}


def test_no_vectors_at_all(spark):
    found = density.density_clusters(frame(spark, {}, [1, 2])).collect()
    assert [(r["doc_id"], r["topic"]) for r in sorted(found)] == [(1, -1), (2, -1)]


@pytest.mark.parametrize("broadcast_rows", [joins.BROADCAST_ROWS, 0])
def test_small_lookup(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    left = spark.range(100).selectExpr("id", "id % 3 as topic")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "topic bigint, w string")
    found = {r["id"]: r["w"] for r in joins.small_lookup(left, right, ["topic"], "id", "t").collect()}
    assert found == {i: ["a", "b", None][i % 3] for i in range(100)}


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "PLAIN_ROWS", -1)
    left = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as k")
    right = spark.range(0, 3000, 2).selectExpr("id as k", "id * 10 as v")
    right = right.union(spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    found = joins.lookup(left, right, ["k"], "id").collect()
    assert len(found) == 3000
    for r in found:
        expected = None if r["k"] is None else 70 if r["k"] == 7 else r["k"] * 10 if r["k"] % 2 == 0 else None
        assert r["v"] == expected
