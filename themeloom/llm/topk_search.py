"""Exact top-k by inner product: sorted lists read in step, with lower and upper score bounds.

Rows are dealt by their number to groups of about ``ROWS_PER_GROUP``. A group sorts each of its
components once. A query reads every list from its favourable end, a run of entries at a time
and all lists equally deep. What a row has shown so far adds to its score; a list that has not
shown it yet holds at best the value at which reading stands, at worst its last value. That
gives an upper and a lower bound of every score without ever looking a row up in a list. Rows
whose upper bound is below the k-th lower bound can no longer qualify; reading stops when few
enough are left, and those are scored to the end.

Two passes: first each query meets only the group it belongs to, which gives it a score that k
rows surely reach. With that floor it then meets all groups, so that groups return hardly more
rows than those that count. The queries are copied to each group in blocks and the groups'
results are cut to k per query by a ranked window; no pair of vectors is shuffled.

Scores are 64-bit integers (the sum of the products must fit them). Vectors that are null or
hold a null, a NaN or an infinite component take no part, neither as query nor as candidate.
Vectors of different lengths meet as if the shorter one went on with zeros; an empty one scores
0 with all. A query leaves out its own row only, so repeated ids meet each other and a repeated
query row has its own k rows. Equal scores go to the smaller id, a null id last; rows equal in
both are interchangeable. Fewer than k candidates give fewer rows, an empty table none. Further
columns are not read. Text columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.session import materialise_counted

ROWS_PER_GROUP = 8_192
QUERIES_AT_ONCE = 256  # queries that read a group's lists together
FIRST_DEPTH = 8  # the first stop is after an eighth of the lists, then reading doubles
FEW = 64  # rows for each query that are scored to the end rather than read further
EXACT = 2**53  # below it sums of whole numbers are exact in double precision

FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: str, steps: int) -> Column:
    """``floor(steps * x)`` of each component; null where the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(steps))).cast("bigint"))
    return F.when(F.col(vector).isNotNull() & ~odd, whole)


def padded(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix, zeros after their ends."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("i8")
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), "i8")
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class SortedLists:
    """The candidates of one group, sorted by each component."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.known, self.vectors = rows, ids, known, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.ordered = np.take_along_axis(vectors, self.order, axis=0)

    def _product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``left @ right`` without rounding."""
        most = np.abs(left).max(initial=0).item() * np.abs(right).max(initial=0).item() * max(1, left.shape[1])
        if most < EXACT:
            return (left.astype("f8") @ right.astype("f8")).astype("i8")
        return left @ right

    def bounds(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lower and upper bounds (candidates x queries) at growing depths of reading."""
        n, width = self.vectors.shape
        up, down = np.maximum(queries, 0).T, np.maximum(-queries, 0).T  # lists read from the top, from the bottom
        seen_up, seen_down = np.zeros((n, width), bool), np.zeros((n, width), bool)
        column = np.arange(width)
        low, high = self.ordered[0], self.ordered[-1]
        read, depth = 0, max(1, n // FIRST_DEPTH)
        while True:
            depth = min(depth, n)
            seen_down[self.order[read:depth], column] = True
            seen_up[self.order[n - depth : n - read], column] = True
            at_up, at_down = self.ordered[n - depth], self.ordered[depth - 1]
            above = np.where(seen_up, self.vectors - low, 0)
            below = np.where(seen_down, high - self.vectors, 0)
            worst = low @ up - high @ down  # the score of a row that comes last in every list
            lower = self._product(above, up) + self._product(below, down) + worst
            # A list that has not shown a row adds at most the way from its last value to where reading stands.
            rest_up = np.where(seen_up, 0, at_up - low)
            rest_down = np.where(seen_down, 0, high - at_down)
            yield lower, lower + self._product(rest_up, up) + self._product(rest_down, down)
            if depth == n:
                return
            read, depth = depth, 2 * depth

    def best(self, rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, candidate, score): for each query the rows that can be among its k best.

        ``floor`` is a score that k rows are known to reach, somewhere.
        """
        n = len(self.ids)
        width = max(self.vectors.shape[1], queries.shape[1])
        if width > self.vectors.shape[1]:
            queries = queries[:, : self.vectors.shape[1]]
        own = self.rows[:, None] == rows
        open_pairs = None
        for lower, upper in self.bounds(queries):
            lower[own] = np.iinfo("i8").min
            if n > k:
                floor = np.maximum(floor, np.partition(lower, n - k, axis=0)[n - k])
            open_pairs = (upper >= floor) & ~own
            if open_pairs.sum() <= FEW * len(rows):
                break
        at, query = np.nonzero(open_pairs)
        score = np.empty(len(at), "i8")
        for part in (slice(i, i + 65_536) for i in range(0, len(at), 65_536)):
            score[part] = np.einsum("ij,ij->i", self.vectors[at[part]], queries[query[part]])
        # Best first within a query, the smaller id before the larger, an unknown one last.
        first = np.lexsort((self.ids[at], ~self.known[at], -score, query))
        query, at, score = query[first], at[first], score[first]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep = (place < k) & (score >= floor[query])
        return query[keep], at[keep], score[keep]


def _search(k: int, with_floor: bool):
    """A function over a group's rows: candidates first, then the queries that meet them."""

    def found(lists: SortedLists, rows, ids, vectors, floor) -> Iterator[pa.RecordBatch]:
        for some in (slice(i, i + QUERIES_AT_ONCE) for i in range(0, len(rows), QUERIES_AT_ONCE)):
            query, at, score = lists.best(rows[some], vectors[some], floor[some], k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[some][query]),
                    pa.array(ids[some][query]),
                    pa.array(lists.ids[at], mask=~lists.known[at]),
                    pa.array(score),
                ],
                ["query_row", "query_id", "vec_id", "score"],
            )

    def columns(batch: pa.RecordBatch, width: int):
        ids = batch.column("vec_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        floor = batch.column("floor").to_numpy(zero_copy_only=False)
        return (
            batch.column("row").to_numpy(zero_copy_only=False),
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            known,
            padded(batch.column("vector"), width),
            floor,
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lists = None, [], None
        for batch in batches:
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(groups)]):
                if begin == end:
                    continue
                if groups[begin] != group:
                    group, held, lists = groups[begin], [], None
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    held.append(part)
                    continue
                if lists is None:
                    if not held:
                        continue
                    parts = [columns(x, 0) for x in held]
                    width = max(x[3].shape[1] for x in parts)
                    matrix = np.concatenate([np.pad(x[3], ((0, 0), (0, width - x[3].shape[1]))) for x in parts])
                    lists = SortedLists(*(np.concatenate([x[i] for x in parts]) for i in range(3)), matrix)
                    held = []
                if not lists.vectors.shape[1]:  # all vectors of the group are empty
                    lists = SortedLists(lists.rows, lists.ids, lists.known, np.zeros((len(lists.ids), 1), "i8"))
                rows, ids, _, vectors, floor = columns(part, lists.vectors.shape[1])
                yield from found(lists, rows, ids, vectors, floor if with_floor else np.full(len(rows), np.iinfo("i8").min))

    return search


def _meet(candidates: DataFrame, queries: DataFrame, groups: int, k: int, with_floor: bool) -> DataFrame:
    """Union of both tables, dealt by group, candidates before queries."""
    named = ["group", "asks", "row", "vec_id", "vector", "floor"]
    nothing = F.lit(None).cast("bigint")
    both = candidates.select("group", F.lit(False).alias("asks"), "row", "vec_id", "vector", nothing.alias("floor"))
    both = both.unionByName(queries.select("group", F.lit(True).alias("asks"), "row", "vec_id", "vector", "floor"))
    dealt = both.repartition(groups, "group").sortWithinPartitions("group", "asks")
    return dealt.select(*named).mapInArrow(_search(k, with_floor), FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", embedding: str = "embedding", steps: int = 1024
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best partners of each row where ``is_query`` holds."""
    kept = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        quantised(embedding, steps).alias("vector"),
    ).filter(F.col("vector").isNotNull())
    numbered, n = materialise_counted(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    groups = max(1, -(-n // ROWS_PER_GROUP))
    candidates = numbered.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    queries = candidates.filter("is_query")
    home = _meet(candidates, queries.withColumn("floor", F.lit(None).cast("bigint")), groups, k, False)
    lowest = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-(2**63)))
    # Every query is looked for in one group first: k rows found there are a floor for the rest.
    floors = home.groupBy("query_row").agg(lowest.alias("floor"))
    asked = queries.join(floors.withColumnRenamed("query_row", "row"), "row", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(-(2**63)))
    )
    everywhere = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = _meet(candidates, everywhere, groups, k, True)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best partners, of all rows, of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
