"""Exact search against all scores."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import topk_search as tk

SCHEMA = "vec_id bigint, embedding array<double>, rank int, score string"


def brute(rows, k=10):
    kept = [
        (i, r[0], [math.floor(1024 * x) for x in r[1]])
        for i, r in enumerate(rows)
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    out = []
    for i, query, q in kept:
        if query is None or query % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), other is None, other or 0) for j, other, v in kept if j != i]
        out += [(query, n + 1, None if unknown else other, -s) for n, (s, unknown, other) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(spark, rows):
    found = tk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, found.collect()), key=str)


def table(seed, n, width, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], 1, "x") for i in range(n)]


@pytest.mark.parametrize("group", [8192, 40])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(tk, "ROWS_PER_GROUP", group)
    monkeypatch.setattr(tk, "FEW", 2)
    rows = table(1, 700, 12)
    rows += [(i, rows[5][1], 1, "x") for i in range(900, 960)]  # ties, one of them a query
    rows += [(200, rows[3][1], 1, "x"), (200, rows[3][1], 1, "x"), (None, rows[7][1], 1, "x")]
    rows += [(1000, None, 1, "x"), (1100, [1.0, None], 1, "x"), (1200, [float("nan")], 1, "x"), (1300, [float("inf"), 1.0], 1, "x")]
    rows += [(1400, [], 1, "x"), (1500, [0.3] * 20, 1, "x"), (1600, [-0.5], 1, "x"), (1700, [0.0] * 12, 1, "x")]
    assert searched(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0], 1, "x")]) == []
    rows = table(2, 4, 3)
    assert searched(spark, rows) == brute(rows) and len(brute(rows)) == 3


def test_reading_stops_early_and_bounds_hold():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(2000, 6)) ** 3 * 100).astype("i8")
    lists = tk.SortedLists(np.arange(2000), np.arange(2000), np.ones(2000, bool), vectors)
    queries = vectors[:20]
    exact = vectors @ queries.T
    steps = 0
    for lower, upper in lists.bounds(queries):
        steps += 1
        assert (lower <= exact).all() and (exact <= upper).all()
    assert steps == 4 and (lower == exact).all() and (upper == exact).all()
    first = next(iter(lists.bounds(queries)))
    kth = np.sort(first[0], axis=0)[-10]
    left = (first[1] >= kth).sum(axis=0)
    assert (left < 500).sum() > 10  # of most queries three quarters of the rows are out after an eighth of the lists


def test_large_numbers_are_exact():
    vectors = np.array([[2**30, 1], [2**30, 2], [-(2**30), 3]], "i8")
    lists = tk.SortedLists(np.arange(3), np.arange(3), np.ones(3, bool), vectors)
    *_, (lower, _) = lists.bounds(vectors)
    assert (lower == vectors @ vectors.T).all()


def test_query_equals_sql(spark, folder):
    ours = tk.op12_topk_search(spark, folder)
    assert ours.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    database = duckdb.connect()
    database.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    theirs = database.sql(tk.OP12_SQL)
    assert theirs.columns == ours.columns
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())
