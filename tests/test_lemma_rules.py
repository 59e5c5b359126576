import random

import pytest
from pyspark.sql import functions as F

from themeloom.functions.lemmas import paradigm_rows
from themeloom.operators import lemma_rules

SCHEMA = "lang string, form string, lemma string"


def brute_rules(table, least):
    """Every ending of every form counted in plain Python."""
    known = {(lang, lemma): lemma for lang, _, lemma in table}
    for lang, form, lemma in sorted(table, reverse=True):
        known[lang, form] = lemma
    endings = {}
    for (lang, form), lemma in known.items():
        same = 0
        while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
            same += 1
        for n in range(max(1, len(form) - same), len(form) + 1):
            endings.setdefault((lang, form[-n:]), []).append((len(form) - same, lemma[same:]))
    rules = {}
    for at, edits in endings.items():
        edit = min(edits, key=lambda e: (-edits.count(e), e))
        if edits.count(edit) >= least:
            rules[at] = edit
    return known, rules


def brute_lemma(known, rules, lang, word):
    if (lang, word) in known:
        return known[lang, word]
    for n in range(len(word), 0, -1):
        cut, added = rules.get((lang, word[-n:]), (len(word), ""))
        if cut < len(word):
            return word[: len(word) - cut] + added
    return word


def random_table(rng):
    pick = lambda: "".join(rng.choices("ab'ñ\\", k=rng.randint(1, 5)))
    return [(rng.choice(["x", "y"]), pick(), pick()) for _ in range(120)]


@pytest.mark.parametrize("joined", [False, True])
def test_rules_and_lemmas_equal_brute_force(spark, monkeypatch, joined):
    rng = random.Random(3)
    table = random_table(rng)
    lemmas = spark.createDataFrame(table + [("x", "", "a"), ("x", "a", ""), (None, "a", "b"), ("x", None, "b"), ("x", "b", None)], SCHEMA)
    known, rules = brute_rules(table, 2)
    got = {(r["lang"], r["suffix"]): (r["cut"], r["added"]) for r in lemma_rules.learn(lemmas).collect()}
    assert got == rules and len(rules) > 20
    if joined:
        monkeypatch.setattr(lemma_rules, "MAX_INLINE_RULES", 0)
    rows = [(k, rng.choice(["x", "y", "z"]), ["".join(rng.choices("ab'ñ\\", k=rng.randint(1, 7))) for _ in range(30)]) for k in range(40)]
    rows += [(7, "x", ["ab", "ab"]), (50, "x", []), (51, "x", None), (52, None, ["ab"]), (None, "y", ["ba", "ab"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, tokens array<string>")
    out = lemma_rules.lemmatise(docs, lemmas)
    assert out.columns == docs.columns
    wanted = [(k, lang, None if ws is None else [brute_lemma(known, rules, lang, w) for w in ws]) for k, lang, ws in rows]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, wanted))


@pytest.mark.parametrize("joined", [False, True])
def test_no_lemmas_leave_words_alone(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(lemma_rules.cleaning, "MAX_INLINE_LEMMAS", -1)
    docs = spark.createDataFrame([("es", ["casas", None])], "lang string, tokens array<string>")
    none = spark.createDataFrame([], SCHEMA)
    assert lemma_rules.learn(none).count() == 0
    assert lemma_rules.lemmatise(docs, none).head()["tokens"] == ["casas", None]
    assert lemma_rules.lemmatise(docs.limit(0), none).count() == 0


def test_held_out_words(spark):
    """Rules learned without a word and all its forms give the lemma of at least four fifths of the forms."""
    rows = sorted(set(paradigm_rows()))
    stems = sorted({lemma for _, _, lemma in rows})
    out = {lemma for k, lemma in enumerate(stems) if k % 5 == 0}
    learned = spark.createDataFrame([r for r in rows if r[2] not in out], SCHEMA)
    held = [r for r in rows if r[2] in out and r[1] not in {x[1] for x in rows if x[2] not in out}]
    docs = spark.createDataFrame(held, SCHEMA).withColumn("tokens", F.array("form"))
    got = lemma_rules.lemmatise(docs, learned).collect()
    right = sum(r["tokens"] == [r["lemma"]] for r in got)
    print(f"{right} of {len(got)} held-out forms")
    assert len(got) > 50 and right >= 0.8 * len(got)


def test_nothing_is_shuffled_for_small_tables(spark):
    docs = spark.createDataFrame([("es", ["casas"])], "lang string, tokens array<string>")
    out = lemma_rules.lemmatise(docs, spark.createDataFrame(paradigm_rows(), SCHEMA))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
