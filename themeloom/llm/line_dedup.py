"""Near-duplicate lines by MinHash, in DataFrame functions only.

A line is lower-cased and freed of white space at its ends. Its shingles are all its windows
of ``WINDOW`` characters, one from each character on; a shorter line is its own shingle. A
shingle is hashed once, and the hash names one of ``PLACES`` bins and its value there; a bin keeps the
smallest. A place of a signature takes its own bin or, where that is empty, the first one that
isn't in a random order of all bins that only this place uses. So two lines agree in each place
with a probability of their Jaccard similarity, whatever their length.
``BANDS`` bands bring candidates together, the exact similarity of the shingle sets is computed,
and components of links of ``LEAST`` or more keep their first line by document and place.

Nulls and empty texts have no lines; blank lines are left as they are and are in no class.
Lines of the same document may be copies of each other. Repeated rows of one document id count
as one document. Very long lines are taken whole. An empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import documents, fresh, full_text
from themeloom.llm.links import linked_components, shared_buckets
from themeloom.operators.joins import lookup
from themeloom.session import materialise

WINDOW = 8
LEAST = 0.8
BANDS, ROWS = 14, 5
PLACES = BANDS * ROWS
PROBED = 8  # bins of a place's order that are looked at one by one; sparse lines look through the rest
FEW = 8  # lines of a bucket that are all compared with each other, 28 pairs at most
BLANKS = " \t\r\f\x0b\xa0"
_SHINGLE = rf"(?s)(?=(.{{{WINDOW}}}|^.{{1,{WINDOW - 1}}}\z))."


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line, digest)`` of all lines but blank ones, normalised."""
    split = docs.select("doc_id", F.posexplode(F.split(full_text("text"), "\n")).alias("line_no", "line"))
    return split.select("doc_id", "line_no", F.trim(F.lower("line"), F.lit(BLANKS)).alias("line")).filter("line <> ''").withColumn("digest", F.unhex(F.md5(F.encode("line", "UTF-8"))))


def shingles(line: str) -> Column:
    """The windows as text, for a look at them; the steps below use their hashes."""
    return F.regexp_extract_all(line, F.lit(_SHINGLE), F.lit(1))


def bag(line: str) -> Column:
    """The 64-bit hashes of the line's distinct windows, cut at places as ``band_keys`` does.

    Two windows of a pair of lines have one hash by chance in one of 10**14 pairs of lines of 350 windows.
    """
    # The outer list holds one encoded line, so that it isn't encoded again for each window.
    hashed = f"transform(sequence(0, greatest(int(octet_length(wide) / 4) - {WINDOW}, 0)), i -> xxhash64(substring(wide, i * 4 + 1, {4 * WINDOW})))"
    return F.expr(f"get(transform(array(encode({line}, 'UTF-32')), wide -> array_distinct({hashed})), 0)")


def _orders() -> list[list[int]]:
    """For each place the bins from its own on, in an order of its own."""
    deal = random.Random(1)
    return [[own, *deal.sample([b for b in range(PLACES) if b != own], PLACES - 1)] for own in range(PLACES)]


def band_keys(all_lines: DataFrame) -> DataFrame:
    """``(digest, key0 … )`` of ``all_lines(digest, line)``, which names each digest once.

    Nothing is shuffled where rows are in partitions by ``digest``.
    """
    # Four bytes a character, so that a window is cut without counting characters from the line's begin.
    cut = all_lines.select("digest", F.encode("line", "UTF-32").alias("wide"), F.greatest(F.length("line") - WINDOW, F.lit(0)).alias("last"))
    at = cut.select("digest", "wide", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    hashed = at.select("digest", F.xxhash64(F.substring("wide", F.col("at") * 4 + 1, F.lit(4 * WINDOW))).alias("h"))
    binned = hashed.withColumn("bin", F.pmod("h", F.lit(PLACES)).cast("int"))
    banded = binned.select("digest", "h", (F.col("bin") % BANDS).alias("band"), F.floor(F.col("bin") / BANDS).cast("int").alias("row"))
    least = banded.groupBy("digest", "band").agg(*[F.min(F.when(F.col("row") == r, F.col("h"))).alias(f"m{r}") for r in range(ROWS)])
    # Written as SQL: as columns these are some ten thousand calls to the JVM.
    bins = [F.expr(f"max(CASE WHEN band = {b % BANDS} THEN m{b // BANDS} END)") for b in range(PLACES)]
    found = least.groupBy("digest").agg(*[b.alias(f"b{k}") for k, b in enumerate(bins)])
    found = found.select("digest", F.expr(f"array({', '.join(f'b{b}' for b in range(PLACES))})").alias("bins"))

    def place(order: list[int]) -> str:
        first = ", ".join(f"get(bins, {b})" for b in order[:PROBED])
        further = f"transform(array({', '.join(map(str, order[PROBED:]))}), b -> get(bins, b))"
        return f"coalesce({first}, get(filter({further}, h -> h IS NOT NULL), 0))"

    orders = _orders()
    keys = [", ".join(place(orders[k + r * BANDS]) for r in range(ROWS)) for k in range(BANDS)]
    return found.select("digest", *[F.expr(f"xxhash64({k}, {places})").alias(f"key{k}") for k, places in enumerate(keys)])


def signed(all_lines: DataFrame) -> DataFrame:
    """``(id, digest, key0 … )``: each distinct line once with its band keys."""
    one = band_keys(all_lines.select("digest", "line").dropDuplicates(["digest"]))
    return materialise(one.withColumn("id", F.monotonically_increasing_id()), "line-signatures")


def _texts(all_lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, line)`` of the lines ``wanted(id, digest)``; their windows would take eight times the room."""
    found = all_lines.select("digest", "line").join(wanted, "digest").dropDuplicates(["id"])
    return materialise(found.select("id", "line"), "line-texts")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda end: texts.select(F.col("id").alias(end), F.col("line").alias(f"line_{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    sets = both.select("a", "b", *[bag(f"line_{end}").alias(f"bag_{end}") for end in "ab"])
    counted = sets.select("a", "b", F.size("bag_a").alias("n_a"), F.size("bag_b").alias("n_b"), F.size(F.array_intersect("bag_a", "bag_b")).alias("common"))
    return counted.select("a", "b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("sim"))


def line_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, line_no, kept_doc_id, kept_line_no, kept)`` for each line that isn't blank."""
    every = lines(docs)
    found = signed(every)
    places = found.select("id", F.explode(F.array_distinct(F.array(*[f"key{k}" for k in range(BANDS)]))).alias("key"))
    buckets, rows = shared_buckets(places)
    wanted = found.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "digest")
    texts = _texts(every, wanted)
    bags = texts.select("id", bag("line").alias("bag"))
    labels = linked_components(buckets, rows, bags, lambda pairs: _compared(pairs, texts), least, FEW)
    of_line = found.select("digest", "id")
    if labels is None:
        of_line = of_line.select("digest", F.col("id").alias("label"))
    else:
        of_line = of_line.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    where = every.select("doc_id", "line_no", "digest")
    members = materialise(lookup(where, of_line, ["digest"], "line_no").select("doc_id", "line_no", "label"), "members")
    keepers = members.groupBy("label").agg(F.min(F.struct("doc_id", "line_no")).alias("keeper"))
    out = lookup(members, keepers, ["label"], "line_no")
    mine = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("line_no") == F.col("keeper.line_no"))
    return out.select(
        "doc_id", "line_no", F.col("keeper.doc_id").alias("kept_doc_id"), F.col("keeper.line_no").alias("kept_line_no"), mine.alias("kept")
    )


def dedup_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with only the kept and the blank lines in ``text``; the same columns and rows."""
    rid, gone = fresh(docs, "_rid"), fresh(docs, "_gone")
    stored = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "lined")
    classes = line_classes(stored.select(F.col(rid).alias("doc_id"), "text"), least)
    dropped = classes.filter("not kept").groupBy(F.col("doc_id").alias(rid)).agg(F.collect_list("line_no").alias(gone))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")
    return stored.join(dropped, rid, "left").select(*[text if c == "text" else F.col(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_classes(documents(spark, folder))
