"""Lemmas of forms that no table lists: edits of word endings, learned from those it does list.

The edit of a listed form takes ``cut`` characters off its end and puts ``added`` in their place;
a lemma that is no listed form is its own form, with nothing to edit. The rule of an ending is the
edit of the most listed forms that end so, of ``MIN_FORMS`` at least; of equals the one that cuts
less, then the first in the order of what it adds. A form that is not listed has the edit of its
longest ending that has a rule and leaves something of the word; other words stay as they are.
Rules are of one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import cleaning
from themeloom.operators.joins import small_lookup

MIN_FORMS = 2
MAX_INLINE_RULES = 2_000  # rules that go into a projection; more are joined


def known_forms(lemmas: DataFrame) -> DataFrame:
    """``(lang, form, lemma)``: each listed form once, with the first of its lemmas, and each lemma itself."""
    listed = lemmas.filter("lang IS NOT NULL AND form <> '' AND lemma <> ''").select("lang", "form", "lemma")
    own = listed.select("lang", F.col("lemma").alias("form"), "lemma")
    order = F.struct(F.col("itself"), F.col("lemma"))
    both = listed.withColumn("itself", F.lit(False)).union(own.withColumn("itself", F.lit(True)))
    return both.groupBy("lang", "form").agg(F.min(order).alias("first")).select("lang", "form", "first.lemma")


def learn(lemmas: DataFrame, min_forms: int = MIN_FORMS) -> DataFrame:
    """``(lang, suffix, cut, added)``: the rules that ``lemmas(lang, form, lemma)`` bears out."""
    length = F.length("form")
    shared = F.size(
        F.filter(F.sequence(F.lit(1), F.least(length, F.length("lemma"))), lambda i: F.left(F.col("form"), i) == F.left(F.col("lemma"), i))
    )
    edits = known_forms(lemmas).select(
        "lang",
        "form",
        (length - shared).alias("cut"),
        F.substring("lemma", shared + 1, F.length("lemma")).alias("added"),
    )
    endings = edits.select("lang", "form", "cut", "added", F.explode(F.sequence(F.lit(1), length)).alias("n"))
    counted = (
        endings.filter(F.col("n") >= F.col("cut"))
        .groupBy("lang", F.expr("right(form, n)").alias("suffix"), "cut", "added")
        .agg(F.count("*").alias("forms"))
        .filter(F.col("forms") >= min_forms)
    )
    first = F.min(F.struct(-F.col("forms"), "cut", "added")).alias("edit")
    return counted.groupBy("lang", "suffix").agg(first).select("lang", "suffix", "edit.cut", "edit.added")


def lemmatise(docs: DataFrame, lemmas: DataFrame, lang: str = "lang", min_forms: int = MIN_FORMS) -> DataFrame:
    """Replace each of ``tokens`` by its lemma: that of the table, or else that of the rules learned from it.

    Small tables go into the projection, the rules as a tree over the word's last characters, and
    nothing is shuffled. Beyond ``MAX_INLINE_RULES`` rules or ``cleaning.MAX_INLINE_LEMMAS`` forms,
    the distinct words of the corpus are looked up once and joined back. Null tokens stay null, and
    rows without a language keep their words.
    """
    known = known_forms(lemmas)
    forms = known.limit(cleaning.MAX_INLINE_LEMMAS + 1).collect()
    rules = learn(lemmas, min_forms)
    if len(forms) <= cleaning.MAX_INLINE_LEMMAS:
        rows = rules.limit(MAX_INLINE_RULES + 1).collect()
        if len(rows) <= MAX_INLINE_RULES:
            return docs.withColumn("tokens", _inline(forms, rows, lang))
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.array_distinct("tokens")).alias("form")).distinct()
    unseen = words.join(known.select("lang", "form"), ["lang", "form"], "left_anti")
    return cleaning._joined_lemmas(docs, known.union(guess(unseen, rules)), lang)


def longest_endings(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """``(lang, form, suffix, cut, added)``: the rule of each of the distinct ``forms(lang, form)`` that has one."""
    endings = forms.filter("lang IS NOT NULL AND form <> ''").select(
        "lang", "form", F.explode(F.sequence(F.lit(1), F.length("form"))).alias("n")
    )
    endings = endings.select("lang", "form", "n", F.expr("right(form, n)").alias("suffix"))
    met = small_lookup(endings, rules, ["lang", "suffix"], "form", "lemma_rules").filter(F.col("cut") < F.length("form"))
    longest = met.groupBy("lang", "form").agg(F.max_by(F.struct("suffix", "cut", "added"), "n").alias("rule"))
    return longest.select("lang", "form", "rule.*")


def guess(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """``(lang, form, lemma)`` of the distinct ``forms(lang, form)`` that a rule covers."""
    lemma = F.concat(F.expr("left(form, length(form) - cut)"), "added")
    return longest_endings(forms, rules).select("lang", "form", lemma.alias("lemma"))


def _inline(forms: list, rules: list, lang: str) -> Column:
    """The lemmas of ``tokens`` as one expression: listed forms by a map, others by a tree of endings."""
    if not forms:
        return F.col("tokens")
    trees: dict[str, dict] = {}
    for row in rules:
        node = trees.setdefault(row["lang"], {})
        for letter in reversed(row["suffix"]):
            node = node.setdefault(letter, {})
        node["edit"] = row["cut"], row["added"]
    branches = " ".join(f"WHEN {tx.sql_text(name)} THEN {_tree(tree, 0, 'w')}" for name, tree in sorted(trees.items()))
    guessed = f"CASE `{lang}` {branches} ELSE w END" if branches else "w"
    entries = ", ".join(tx.sql_text(x) for r in forms for x in (f"{r['lang']} {r['form']}", r["lemma"]))
    listed = ", ".join(sorted({tx.sql_text(r["form"]) for r in forms}))
    found = f"CASE WHEN w IN ({listed}) THEN try_element_at(map({entries}), concat_ws(' ', `{lang}`, w)) END"
    return F.expr(f"transform(tokens, w -> coalesce({found}, {guessed}))")


def _tree(node: dict, depth: int, otherwise: str) -> str:
    """The lemma of ``w``, whose last ``depth`` characters led to ``node``; ``otherwise`` is that of a shorter ending."""
    if "edit" in node:
        cut, added = node["edit"]
        stem = f"left(w, length(w) - {cut})" if cut else "w"
        edited = f"concat({stem}, {tx.sql_text(added)})" if added else stem
        # Only an ending that is cut off whole can leave nothing of the word.
        otherwise = f"if(length(w) > {cut}, {edited}, {otherwise})" if cut == depth else edited
    letters = sorted(letter for letter in node if letter != "edit")
    if not letters:
        return otherwise
    branches = " ".join(f"WHEN {tx.sql_text(x)} THEN {_tree(node[x], depth + 1, otherwise)}" for x in letters)
    return f"CASE substring(w, -{depth + 1}, 1) {branches} ELSE {otherwise} END"
