"""Corpus cleaning: one projection per corpus, plus a lemma lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions.stopwords import stopword_list
from themeloom.operators.joins import lookup
from themeloom.session import materialise

MAX_INLINE_LEMMAS = 1_000


def with_tokens(docs: DataFrame, text: str = "text", letters: bool = False, urls_first: bool = False) -> DataFrame:
    """Add ``tokens``: the words of the cleaned text, in order."""
    return docs.withColumn("tokens", tx.tokens(tx.clean(F.col(text), letters, urls_first)))


def lemmatise(docs: DataFrame, lemmas: DataFrame, lang: str = "lang") -> DataFrame:
    """Replace each token by its lemma in ``lemmas(lang, form, lemma)``; unknown words stay.

    A form listed with several lemmas has the first of them in order. A table of up to
    ``MAX_INLINE_LEMMAS`` rows goes into the projection itself and nothing is shuffled; a
    larger one is joined, and the tokens are put back in order. Null tokens stay null, and
    rows that share a key keep their own tokens.
    """
    lemmas = lemmas.filter(F.col("lemma").isNotNull()).groupBy("lang", "form").agg(F.min("lemma").alias("lemma"))
    rows = lemmas.limit(MAX_INLINE_LEMMAS + 1).collect()
    if len(rows) <= MAX_INLINE_LEMMAS:
        return docs.withColumn("tokens", _inline_lemmas(rows, F.col("tokens"), F.col(lang)))
    return _joined_lemmas(docs, lemmas, lang)


def _inline_lemmas(rows: list, words: Column, lang: Column) -> Column:
    if not rows:
        return words
    table = {f"{r['lang']} {r['form']}": r["lemma"] for r in rows}
    entries = ", ".join(tx.sql_text(x) for pair in table.items() for x in pair)
    lemma_of = F.expr(f"map({entries})")
    forms = sorted({r["form"] for r in rows})

    def one(word: Column) -> Column:
        found = F.try_element_at(lemma_of, F.concat_ws(" ", lang, word))
        return F.when(word.isin(forms), F.coalesce(found, word)).otherwise(word)

    return F.transform(words, one)


def _joined_lemmas(docs: DataFrame, lemmas: DataFrame, lang: str) -> DataFrame:
    forms = lemmas.select(F.col("lang").alias("_lang"), "form", "lemma")
    stored = materialise(docs.withColumn("_id", F.monotonically_increasing_id()), "unlemmatised")
    words = stored.select("_id", F.col(lang).alias("_lang"), F.posexplode("tokens").alias("_pos", "form"))
    found = (
        lookup(words.withColumn("_row", F.xxhash64("_id", "_pos")), forms, ["_lang", "form"], "_row")
        .groupBy("_id")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form").alias("lemma")))).alias("_found"))
        .select("_id", F.col("_found.lemma").alias("_tokens"))
    )
    # A row without words has nothing to look up and keeps what it has: an empty list or null.
    return stored.join(found, "_id", "left").withColumn("tokens", F.coalesce("_tokens", "tokens")).select(*docs.columns)


def without_stopwords(docs: DataFrame, *languages: str, min_length: int = 1, extra: list[str] | None = None) -> DataFrame:
    """Drop tokens found in the stopword lists; run it after the lemmas, which it looks at."""
    listed = stopword_list(*languages) + (extra or [])
    return docs.withColumn("tokens", tx.without("tokens", listed, min_length))


def clean_corpus(
    docs: DataFrame,
    text: str = "text",
    languages: tuple[str, ...] = (),
    lemmas: DataFrame | None = None,
    lang: str = "lang",
    letters: bool = False,
    urls_first: bool = False,
    surface: bool = False,
) -> DataFrame:
    """The whole cleaning job: adds ``tokens``, ``clean_text`` and ``n_words``.

    Stopwords are looked for among the lemmas; with ``surface`` a word whose form in the text is
    listed goes too, whatever its lemma.
    A document left without words keeps its row, with an empty text and a count of 0.
    """
    out = with_tokens(docs, text, letters, urls_first)
    if surface:
        out = without_stopwords(out, *languages)
    if lemmas is not None:
        out = lemmatise(out, lemmas, lang)
    return (
        without_stopwords(out, *languages)
        .withColumn("clean_text", F.array_join("tokens", " "))
        .withColumn("n_words", F.size("tokens"))
    )
