"""The pipeline operators on small tables, against plain Python: nulls, empty and long texts, ties, copies, other columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import (
    decontaminate, features, fingerprints, line_dedup, links, mixing, near_dedup, quality, sharding, token_counts, token_files, tokens, toxicity,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, source string, shard string, _rid string, digest string"
WORDS = [f"w{i}x" for i in range(400)]


def prose(seed: int, n: int) -> str:
    pick = np.random.default_rng(seed)
    return " ".join(pick.choice(WORDS, n))


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, copies, repeated rows, clashing names."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a", "x", "y", "z"), (2, base, "b", None, None, None), (3, " ".join(near), None, "x", "y", "z"),
        (4, None, "a", "x", "y", "z"), (5, "", "b", "x", "y", "z"), (6, "  \n\t ", "c", "x", "y", "z"), (7, "one two", "c", "x", "y", "z"),
        (8, prose(2, 30_000), "a", "x", "y", "z"), (9, "Año ñandú l'eau <|endoftext|> 日本\n\nline  two  x", "c", "x", "y", "z"),
        (10, "same line here again\nsame line here again\nSame line here again \nother words stand here", "b", "x", "y", "z"),
        (10, "same line here again\nsame line here again\nSame line here again \nother words stand here", "b", "x", "y", "z"),
        (None, prose(3, 50), "c", "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_shards_are_a_permutation(spark):
    docs = awkward(spark)
    out = rows_of(sharding.shard_documents(docs, 4))
    places = sorted(r["slot"] * 4 + r["shard"] for r in out)
    assert places == list(range(12))
    assert set(out[0]) == set(docs.columns) | {"slot"}
    assert sharding.shard_documents(nothing(spark)).count() == 0
    for n in (1, 2, 3, 12, 1000):
        assert sorted(sharding.place_of(i, n) for i in range(n)) == list(range(n))
        assert all(sharding.row_of(sharding.place_of(i, n), n) == i for i in range(0, n, 7))
    numbered = spark.range(1000).withColumnRenamed("id", "row")
    got = {r["row"]: r["place"] for r in rows_of(sharding.permuted(numbered, "row", "place", 1000))}
    assert got == {i: sharding.place_of(i, 1000) for i in range(1000)}


def test_mix_keeps_targets(spark):
    docs = awkward(spark)
    mixed = mixing.mix(docs.select(F.lit(0).cast("bigint").alias("rid"), "doc_id", "source", mixing.words("text").alias("size")))
    out = rows_of(mixed)
    assert len(out) == 12 and all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in out)
    assert mixing.mix(nothing(spark).select(F.lit(0).cast("bigint").alias("rid"), "doc_id", "source", mixing.words("text").alias("size"))).count() == 0
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert mixing.apply_mix(nothing(spark)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 30)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    total, most, weight = 1540 * 1.5, {"a": 20, "b": 2000, "c": 1000, None: 60}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, open_to = {}, set(most)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_to)
        over = {s for s in open_to if most[s] <= weight[s] * level}
        if not over:
            want |= {s: weight[s] * level for s in open_to}
            break
        want |= {s: float(most[s]) for s in over}
        open_to -= over
    assert {s: pytest.approx(v) for s, v in want.items()} == got


def test_mix_misses_by_less_than_a_document(spark):
    rows = [(i, i, f"s{i % 3}", 5 + (i * 37) % 200) for i in range(9000)]
    out = mixing.mix(spark.createDataFrame(rows, "rid bigint, doc_id bigint, source string, size bigint"))
    out = out.join(spark.createDataFrame(rows, "rid bigint, d bigint, source string, s bigint").select("rid", "source"), "rid")
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) < 205


def test_short_documents_carry_the_rest(spark):
    """Long documents and short ones in each source: no source misses by more than a short one."""
    lengths = [4000, 1500, 900, 350] + [20 + i for i in range(100)] + [5 + i % 9 for i in range(40)]
    rows = [(1000 * s + i, 1000 * s + i, f"s{s}", n) for s in range(20) for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(rows, "rid bigint, doc_id bigint, source string, size bigint")
    for seed in range(3):
        out = mixing.mix(frame, weights=(3, 1, 2, 5), share=0.7, seed=seed)
        out = out.join(frame.select("rid", "source"), "rid").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))
        missed = [abs(r["t"] - r["g"]) for r in out.collect()]
        assert max(missed) < 15, max(missed)


def test_sharing_out_keeps_sums_and_expectations():
    size, part = [100, 9, 0, 8, 7, 30] + [20] * 20, [0.3, 0.2, 0.5, 0.9, 1.0, 0.5] + [0.4] * 20
    words = sum(s * p for s, p in zip(size, part))
    for value, wanted in ((0.1, 1), (0.9, 0)):
        moved = list(part)
        assert mixing._shared_out(size, moved, 1, 0.3, 100, lambda: value) == wanted
        assert sum(s * p for s, p in zip(size[1:], moved[1:])) + 100 * wanted == pytest.approx(words)
        assert moved[2] == 0.5 and moved[4] == 1.0 and all(0 <= p <= 1 for p in moved)
        expected = [0.3 * a + 0.7 * b for a, b in zip(*(_after(size, part, v) for v in (0.1, 0.9)))]
        assert expected[1:] == pytest.approx(part[1:])
    assert mixing._shared_out(size, list(part), 24, 0.3, 100, lambda: 0.1) is None


def _after(size, part, value):
    moved = list(part)
    mixing._shared_out(size, moved, 1, 0.3, 100, lambda: value)
    return moved


def test_rows_of_one_id_are_dealt_to_several_blocks(spark, monkeypatch):
    largest = []
    real = mixing.rounded
    monkeypatch.setattr(mixing, "rounded", lambda shares, *rest: (largest.append(shares.groupBy("source", "block").count().agg(F.max("count")).head()[0]), real(shares, *rest))[1])
    for same in ("cast(7 as bigint)", "cast(null as bigint)"):
        often = spark.range(9000).selectExpr("id as rid", f"if(id < 6000, {same}, id) as doc_id", "'a' as source", "5 + id % 7 as size")
        out = mixing.mix(often, weights=(1,), share=0.5).cache()
        assert out.count() == 9000 and out.select("rid").distinct().count() == 9000
        assert abs(out.agg(F.sum("taken")).head()[0] - out.head()["target"]) <= 11
    assert max(largest) < 1.2 * mixing.BLOCK


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    texts = ["", " ", "a", " a", "a  b", "a\nb", "a \n b", "it's we'll,don't", "x<|endoftext|> y", "é ñ ß,日本 . .", "tab\tend \x85  z", "ab.\n\ncd", prose(5, 300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(tokens.read_file(PATH)).encode(texts)] == whole(texts)


def test_encoder_gives_letters_to_the_model_once():
    encoder, asked = tokens.Encoder(tokens.read_file(PATH)), []

    class Counting:
        def __init__(self, model):
            self.model = model

        def tokenize(self, letters):
            asked.append(letters)
            return self.model.tokenize(letters)

    encoder.model = Counting(encoder.model)
    texts = ["x thing thing, thing. thing.\nthing thing\nx", "x thing; thing\nx", "x,\n thing", "x\r\nthing thing\n\nx \u00e9\u00e9!\n\u00e9\u00e9 \u00aax thing\x85x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == whole(texts)
    assert len(asked) == len(set(asked)) == 5  # x, and thing and \u00e9\u00e9 with and without a blank before them
    encoder.old, encoder.new, encoder.cores = encoder.new, {}, {}
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[::-1])] == whole(texts[::-1])


def test_counts_and_cache(spark, tmp_path):
    docs, cache = awkward(spark), f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()), key=str)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 512) for r, i in zip(docs.collect(), whole([r["text"] for r in docs.collect()]))), key=str)
    assert first == want
    stored = spark.read.parquet(cache).count()
    assert sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    assert token_counts.count_tokens(nothing(spark), PATH, cache).count() == 0


def test_token_files_round_trip(spark):
    docs = awkward(spark)
    got = sorted(map(tuple, token_files.read_documents(token_files.write_shards(docs, PATH)).collect()), key=str)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r, ids in zip(rows, whole([r["text"] for r in rows])):
        ids = [*ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want, key=str)
    assert token_files.read_documents(token_files.write_shards(nothing(spark), PATH)).count() == 0


def test_repair_decodes_any_document():
    pick = np.random.default_rng(1)
    ids = pick.integers(0, 20, 20_000).astype(np.uint32)
    cuts = np.unique(np.append(pick.integers(1, 20_000, 50), 20_000))
    rules, symbols, ends = token_files.repair(ids, cuts, 100)
    assert len(rules) and len(symbols) < len(ids) and len(ends) == len(cuts)
    decoder = token_files.Decoder(rules, token_files.expansion_lengths(rules, 100), 100)
    begin = at = 0
    for end, cut in zip(ends.tolist(), cuts.tolist()):
        own = symbols[begin:end]
        assert decoder.ids(own).tolist() == ids[at:cut].tolist()
        assert decoder.id_at(own, cut - at - 1) == ids[cut - 1]
        begin, at = end, cut


def test_prefix_hashes():
    a, b = "abcabcabd xyz", "zzabcabcabq"
    one, two = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in (a, b))
    assert one.span(0, 3) == one.span(3, 6) == two.span(2, 5) != one.span(1, 4)
    assert fingerprints.extension(one, two, 0, 2) == 8 and fingerprints.extension(one, one) == len(a)


def test_fingerprints(spark):
    docs = awkward(spark)
    got = sorted((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in rows_of(fingerprints.fingerprints(docs, 3)))
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    texts = [r["text"] or "" for r in rows]
    want = []
    for k, t in enumerate(texts):
        n = len(t)
        edited = t[: n - n // 2] + texts[(k + 1) % len(texts)][: n // 2]
        want.append((rows[k]["doc_id"] or 0, n, hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)
    by = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprints(docs))}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0 and 0.5 < by[2]["near_next"] < 1.0
    assert by[4]["near_next"] == 1.0 and by[5]["near_next"] == 0.0
    assert fingerprints.fingerprints(nothing(spark)).count() == 0


def test_near_classes(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_dedup.near_classes(docs))}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9, 10: 10, None: None}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert near_dedup.near_classes(nothing(spark)).count() == 0


def test_near_group_without_a_common_centre(spark):
    """A chain of texts, each like its neighbours only, and crowds around it, is one class."""
    words = prose(9, 200).split()
    texts = [" ".join(words[:i * 3] + [f"n{j}" for j in range(i * 3, 0, -1)][: 0] + [f"c{k}" for k in range(i * 3)] + words[i * 3:]) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, prose(50 + i, 80)) for i in range(20)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_dedup.near_classes(docs))}
    sets = [set(near_dedup.set_of(t).tolist()) for t in texts]
    label = list(range(12))
    for _ in label:
        for i in range(12):
            for j in range(i):
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(12)] == label and all(got[100 + i] == 100 + i for i in range(20))


def test_bag_min_hash_is_unbiased():
    pick = np.random.default_rng(4)
    elements = pick.integers(0, 2**63, 300).astype(np.uint64)
    x, y = pick.integers(1, 9, 300), pick.integers(1, 9, 300)
    truth = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    one, two = near_dedup.bag_min_hash([(elements, x), (elements, y)], 2048)
    assert abs((one == two).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 2048)


def test_line_classes(spark):
    docs = awkward(spark)
    out = rows_of(line_dedup.line_classes(docs))
    ten = {r["line_no"]: (r["kept_line_no"], r["kept"]) for r in out if r["doc_id"] == 10}
    assert ten == {0: (0, True), 1: (0, False), 2: (0, False), 3: (3, True)}
    assert {r["kept_doc_id"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert not [r for r in out if r["doc_id"] in (4, 5, 6)]
    clean = line_dedup.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == 12
    assert line_dedup.line_classes(nothing(spark)).count() == 0


def test_lines_without_white_space_are_compared_at_every_character(spark):
    japanese = "".join(chr(0x3042 + (i * i * 7 + i * 13) % 80) for i in range(120))
    coded = hashlib.sha512(b"a").hexdigest() + hashlib.sha512(b"b").hexdigest()
    other = hashlib.sha512(b"c").hexdigest() + hashlib.sha512(b"d").hexdigest()
    rows = [(1, japanese), (2, "ん" + japanese), (3, coded), (4, "0" + coded), (5, other), (6, "short"), (7, "shorn")]
    out = rows_of(line_dedup.line_classes(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r["doc_id"]: r["kept_doc_id"] for r in out} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}
    got = spark.createDataFrame([("abcdefghij",), ("abc",), ("a\u20ac\U0001f600defgh\u2028",)], "line string").select(line_dedup.shingles("line"))
    assert [r[0] for r in got.collect()] == [["abcdefgh", "bcdefghi", "cdefghij"], ["abc"], ["a\u20ac\U0001f600defgh", "\u20ac\U0001f600defgh\u2028"]]


def test_bands_of_lines_miss_few_pairs(spark):
    pick, rows = np.random.default_rng(4), []
    for n in (4, 20, 60):
        for i in range(1000):  # n windows of n / 0.8
            line = "".join(map(chr, pick.integers(0x4E00, 0x9000, n * 5 // 4 + 7)))
            rows += [(f"{n}/{i}/0", line[: n + 7]), (f"{n}/{i}/1", line)]
    keyed = line_dedup.band_keys(spark.createDataFrame(rows, "digest string, line string").repartition(8))
    of = {r["digest"]: r[1:] for r in keyed.collect()}
    for n in (4, 20, 60):
        same = [sum(x == y for x, y in zip(of[f"{n}/{i}/0"], of[f"{n}/{i}/1"])) for i in range(1000)]
        assert sum(x == 0 for x in same) <= 14  # 4 by independent places
        assert abs(np.mean(same) / line_dedup.BANDS - 0.8**line_dedup.ROWS) < 0.03


def test_band_keys_of_a_megabyte_of_lines(spark):
    pick, rows = np.random.default_rng(5), []
    for i in range(2500):  # 400 characters each; of 1,500 letters, so that a bin of a long line is seldom empty
        line = "".join(map(chr, pick.integers(0x4E00, 0x53DC, 400)))
        rows += [(f"{i}/0", line), (f"{i}/1", line[:360])]
    rows += [("many", "ab" * 5000), ("few", "ab" * 20), ("one", "a" * 300), ("same", "a" * 8), ("tiny", "a")]
    lines = spark.createDataFrame(rows, "digest string, line string").repartition(8, "digest").localCheckpoint()
    cut = line_dedup.band_keys(lines)
    assert "regexp" not in cut._jdf.queryExecution().executedPlan().toString().lower()  # windows are not cut by a look-ahead
    of = {r["digest"]: r[1:] for r in cut.collect()}
    assert len(of) == len(rows) and of["many"] == of["few"] and of["one"] == of["same"] != of["tiny"]
    assert all(any(x == y for x, y in zip(of[f"{i}/0"], of[f"{i}/1"])) for i in range(2500))


def test_lines_are_compared_by_hashed_windows(spark):
    some = ["abcdefghij", "abc", "a\u20ac\U0001f600defgh\u2028", "ab" * 50, "x" * 8, "the same words and the same words"]
    lines = spark.createDataFrame(list(enumerate(some)), "id bigint, line string")
    for r in lines.select(line_dedup.bag("line").alias("bag"), F.array_distinct(line_dedup.shingles("line")).alias("windows")).collect():
        assert len(r["bag"]) == len(set(r["bag"])) == len(r["windows"])
    texts = spark.createDataFrame([(0, "abcdefghij"), (1, "bcdefghijk"), (2, "zz")], "id bigint, line string")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a bigint, b bigint")
    found = line_dedup._compared(pairs, texts)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 0.5), (0, 2, 0.0)]
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_pairs_of_small_buckets_are_compared_as_they_are(spark, monkeypatch):
    # 4 is the leader of both buckets by its fullness; 1 and 2 are alike, but neither is like 4, and 7 is only with 4.
    buckets = spark.createDataFrame([(10, i, 4) for i in (1, 2, 3, 4)] + [(11, i, 2) for i in (4, 7)], "key bigint, id bigint, n bigint")
    bags = spark.createDataFrame([(i, [i]) for i in (1, 2, 3, 4, 7)], "id bigint, bag array<bigint>")
    met = []

    def verify(pairs):
        met.append({tuple(r) for r in pairs.collect()})
        return pairs.withColumn("sim", F.when(F.expr("(a = 1 AND b = 2) OR (a = 3 AND b = 4)"), 1.0).otherwise(0.0))

    monkeypatch.setattr(links, "prefix_pairs", lambda *_: pytest.fail("buckets of few members need no sets"))
    found = {r["id"]: r["label"] for r in links.linked_components(buckets, 6, bags, verify, 0.8, 8).collect()}
    assert found[1] == found[2] != found[3] == found[4] and 7 not in found
    assert met == [{(1, 4), (2, 4), (3, 4), (4, 7)}, {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)}]


def test_quality_learns_a_clear_sign(spark):
    good = [(i, prose(i, 40)) for i in range(0, 300)]
    bad = [(i, " ".join(w + "###" for w in prose(i, 40).split())) for i in range(300, 400)]
    docs = spark.createDataFrame(good + bad + [(500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(500, None)], "doc_id bigint, quality int")
    model = quality.fit(quality.training_rows(docs, labels))
    assert all((model.score(t) >= 0.7) == (i < 300) for i, t in good + bad)
    assert 0 <= model.score("") <= 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 300 and doc_id < 400").count() == 0
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    alone = quality.fit(quality.training_rows(docs, labels.filter("quality = 1")))
    assert 0.5 < alone.score("anything") < 1


def test_samples_are_of_distinct_texts(spark):
    rows = [(prose(i, 20), i % 2, i) for i in range(60)] + [("the same text", 1, 0)] * 500 + [("the same text", 0, 0)] * 3
    frame = spark.createDataFrame(rows, "text string, y int, mix bigint").repartition(4)
    got = rows_of(quality.sampled(frame, quality.distinct_texts(frame), 10))
    assert sorted(sum(r[f"in{y}"] for r in got) for y in (0, 1)) == [10, 10] and len({r["text"] for r in got}) == len(got)
    assert [(r["n0"], r["n1"], r["in0"], r["in1"]) for r in got if r["text"] == "the same text"] == [(3, 500, 1, 1)]
    docs = spark.createDataFrame([(i, "the same text") for i in range(500)] + [(500 + i, prose(i, 20)) for i in range(60)], "doc_id bigint, text string")
    known = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id bigint, label int")
    found = rows_of(toxicity.sampled(docs, known, 30))
    assert len(found) == 30 and len({r["text"] for r in found}) == 30
    every = {r["text"]: r for r in rows_of(toxicity.sampled(docs, known, 100))}
    assert len(every) == 61 and {k: every["the same text"][k] for k in ("n", "marked", "toxic")} == {"n": 500, "marked": 3, "toxic": 2}


def test_toxicity_learns_lists_and_stems(spark):
    clean = [(i, prose(i, 30)) for i in range(300)]
    toxic = [(i, prose(i, 30) + (" you idiot, pathetic moron" if i % 2 else f" grobel{i % 7}a grobel{i % 5}b")) for i in range(300, 420)]
    docs = spark.createDataFrame(clean + toxic + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(420)] + [(900, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert np.mean([(model.score(t) >= 0.5) == (i >= 300) for i, t in clean + toxic]) > 0.98
    assert 0 <= model.score("") < 0.5
    assert 0 <= toxicity.fit(docs.limit(0), labels).score("anything") <= 1
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert unlabelled.score("what an idiot, you pathetic moron") > unlabelled.score(prose(2, 30))


def test_leaks_are_found_and_nothing_else(spark):
    items = [(1, "What is the tall tower of the old river town called? It is called the lantern of the north."), (2, prose(70, 150)), (3, None), (4, "tiny item"), (None, prose(71, 40))]
    item = items[0][1]
    edited = item.replace("old", "new")
    docs = [
        (1, prose(80, 500) + " " + item + " " + prose(81, 300)), (2, prose(82, 400)), (3, edited), (4, items[1][1].upper()), (5, None), (6, ""),
        (7, item[:30]), (8, "a tiny item here"), (9, prose(83, 90) + "\n" + items[4][1]),
    ]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.find_leaks(table, bench))}
    assert got == {(1, 1), (3, 1), (4, 2), (8, 4), (9, None)}
    assert {r["doc_id"] for r in rows_of(decontaminate.without_leaks(table, bench))} == {2, 5, 6, 7}
    assert decontaminate.find_leaks(table.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_block_bounds_lose_no_candidate(monkeypatch, cells):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, rng.choices(vocabulary, k=rng.randint(5, 30)), []) for k in range(70)]
    df = {w: sum(w in q for _, q, _ in items) for w in vocabulary}
    index = decontaminate.Index([(*x, df) for x in items], len(items), 17.0)
    texts = [rng.choices(vocabulary + ["other"] * 90, k=n) for n in (0, 3, 64, 65, 200, 700)]
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    for group in index.classes:
        terms = np.array([group.term.get(w, -1) for t in texts for w in t], np.int32)
        got = {(d, p, i): s for d, p, i, s in zip(*(x.tolist() for x in group.candidates([len(t) for t in texts], terms)))}
        weight = {}
        for w, k in group.term.items():
            for posting in range(group.item_at[k], group.item_at[k + 1]):
                weight[w, group.item[posting]] = group.share[posting]
        wanted = {}
        for doc, text in enumerate(texts):
            for place in range(0, max(1, len(text)), group.length):
                held = set(text[place : place + 2 * group.length])
                for item in range(len(group.items)):
                    share = sum(weight.get((w, item), 0.0) for w in held)
                    if share >= decontaminate.THRESHOLD:
                        wanted[doc, place, item] = share
        assert got.keys() == wanted.keys() and got
        assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_edited_copies_and_questions_alone_are_leaks():
    pick = np.random.default_rng(9)
    items, df = [], {}
    for i in range(60):
        asked, answer = prose(900 + i, 30).split(), prose(2000 + i, 2).split()
        items.append((i, asked, answer))
        for w in set(asked + answer):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index([(*x, df) for x in items], 60, 32.0)

    def found(texts):
        full = [prose(5000 + i, 150) + " " + t + " " + prose(6000 + i, 90) for i, t in enumerate(texts)]
        return [(r["doc_id"], r["item_id"]) for r in decontaminate._hits(index, list(range(len(full))), full)]

    edited = []
    for _, asked, answer in items:
        copy = asked + answer
        for k in pick.choice(32, 4, replace=False):
            copy[k] = f"new{k}"
        edited.append(" ".join(copy))
    same = [(i, i) for i in range(60)]
    assert len(set(found(edited)) & set(same)) >= 58 and set(found(edited)) <= set(same)
    assert sorted(found([" ".join(asked) for _, asked, _ in items])) == same  # each pair once
    assert sorted(found([" ".join(asked + ["other", answer[1]]) for _, asked, answer in items])) == same
    assert not found([" ".join(asked[::-1]) for _, asked, _ in items])
    assert decontaminate._in_order(list("abcde"), list("xaycze")) == 3


def test_block_max_bounds_lose_nothing():
    items = [(i, decontaminate.words(prose(200 + i, 25)), [], None) for i in range(60)]
    df = {}
    for _, q, _, _ in items:
        for w in set(q):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index([(i, q, a, df) for i, q, a, _ in items], 60, 25.0)
    (group,) = index.classes
    texts = [decontaminate.words(prose(200 + i, 25) + " " + prose(600 + i, 300)) for i in range(0, 60, 5)]
    every = [w for t in texts for w in t]
    terms = np.array([group.term.get(w, -1) for w in every], np.int32)
    got = {(d, p // group.length, i) for d, p, i, _ in zip(*(x.tolist() for x in group.candidates([len(t) for t in texts], terms)))}
    want = set()
    for d, t in enumerate(texts):
        for p in range(max(1, -(-len(t) // group.length))):
            held = {group.term[w] for w in t[p * group.length : (p + 2) * group.length] if w in group.term}
            for i in range(60):
                mine = [(k, x) for k in held for j, x in zip(group.item[group.item_at[k] : group.item_at[k + 1]], group.share[group.item_at[k] : group.item_at[k + 1]]) if j == i]
                if sum(x for _, x in mine) >= decontaminate.THRESHOLD:
                    want.add((d, p, i))
    assert got == want and want


def test_word_pattern():
    assert features.tokens("Ab, c!!") == ["ab", ",", "c", "!!"] and re.findall(mixing.WORD, "a\tb  c\x85d") == ["a", "b", "c\x85d"]


def test_checksums_of_stems_go_on_from_shorter_ones(monkeypatch):
    """The same features as of whole names, without encoding every stem of a word anew."""
    import zlib

    from themeloom.llm import features

    words = ["", "a", "four", "fives", "imbécile", "überflüssiges", "𐀀stems", "日本語の言葉です", "extraordinary"]
    encoded = []

    def counted(data, *start):
        encoded.append(len(data))
        return zlib.crc32(data, *start)

    monkeypatch.setattr(features, "zlib", type("counting", (), {"crc32": staticmethod(counted)}))
    for word in words:
        names = [word, *("^" + word[:n] for n in features.STEMS if len(word) > n)]
        expected = [(zlib.crc32(n.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44 for n in names]
        encoded.clear()
        assert features.word_features(word, 20) == expected
        assert sum(encoded) <= 2 * len(word.encode("utf-8", "surrogatepass"))
