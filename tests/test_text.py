"""One inline row per cleaning rule."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import cleaning
from themeloom.plans import duckdb_sql


def applied(spark, values, function):
    """``function`` of each value, in order, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    found = rows.select("i", function(F.col("text")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in found]


def squeezed(text):
    return " ".join(text.split())


@pytest.mark.parametrize(
    "text, n", [("", 0), (" \n\t ", 0), ("a  b\n\nc", 3), ("año—ñ ☕", 2), ("a\u00a0b\u2003c\x1cd", 4)]
)
def test_word_count(spark, text, n):
    assert applied(spark, [text], tx.word_count) == [n]


def test_strip_takes_every_space(spark):
    values = ["\u00a0\n x y \t\x1f", "", " \n", "x"]
    assert applied(spark, values, tx.strip_space) == [v.strip() for v in values]


def test_words_and_strip_like_python(spark):
    texts = []

    @settings(max_examples=200, database=None, derandomize=True)
    @given(st.text(alphabet=st.sampled_from("ab\n\t \u00a0\u2003\u3000\x1c\x85é☕\u200b"), max_size=20))
    def gather(text):
        texts.append(text)

    gather()
    assert applied(spark, texts, tx.word_count) == [len(t.split()) for t in texts]
    assert applied(spark, texts, tx.strip_space) == [t.strip() for t in texts]


HTML = {
    "uno<!-- dos\n-->tres": "uno tres",
    "a<script>var x='</p>';</script>b": "a b",
    "a<STYLE type='x'>p{}</STYLE >b": "a b",
    "a<template><p>x</p></template>b": "a b",
    "<p class='x'>hola<br/>mundo</p>": "hola mundo",
    "<!DOCTYPE html><?xml v?>x": "x",
    "&amp;lt;": "&lt;",
    "&lt;i&gt; &ntilde;&#241;&#xF1; &#x1F600;": "<i> ñññ 😀",
    "a < b & c &nada; &": "a < b & c &nada; &",
    "&#0; &#xD800;": "&#0; &#xD800;",
    "sin cerrar <b": "sin cerrar <b",
    '<a title="x > y" href=z>uno</a>': "uno",
    "<a title = 'x > y'>uno</a>": "uno",
    "<a title=don't>uno</a> isn't": "uno isn't",
    '<p title="abc>uno</p> dos': "uno dos",
    "<a b" + '="c" d' * 200: "<a b" + '="c" d' * 200,
    "a<script>s='<!--'</script>b<!-- c -->d": "a b d",
    "a<!-- <script> -->b<script>x</script>c": "a b c",
    "<a " + "b='c>' " * 3000 + ">uno": "uno",
}


def test_html_like_the_database(spark):
    sql = duckdb_sql.html("x")
    theirs = [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS x)", [h]).fetchall()[0][0] for h in HTML]
    assert applied(spark, list(HTML), tx.strip_html) == theirs


def test_html(spark):
    assert [squeezed(x) for x in applied(spark, list(HTML), tx.strip_html)] == list(HTML.values())


MARKDOWN = {
    "a\n```\ncode <KEY>\n```\nb": "a b",
    "correo: ```x@y.z``` fin": "correo: fin",
    "a ```b``` c ```d": "a c d",
    "# T *x* _y_ > z - w `v` ~u~": "T x y z w v u",
    "ver https://a.org/b?c fin": "ver fin",
    "www.a.org/b": "",
    "https://a.org/uno_dos y": "dos y",
    "https://a.org/uno-dos y": "dos y",
    "HTTP://A.ORG x": "HTTP://A.ORG x",
    "http://a\u00a0b": "b",
    "![a](b.png) c": "c",
    "[![a](b)](c)": "[ ](c)",
    "![a](b\nc)": "![a](b c)",
    "![a](b\u2028c) d": "d",
}


def test_markdown(spark):
    assert [squeezed(x) for x in applied(spark, list(MARKDOWN), tx.strip_markdown)] == list(MARKDOWN.values())


def test_addresses_first_leave_no_tail(spark):
    out = applied(spark, ["x https://a.org/uno_dos-tres y"], lambda c: tx.strip_markdown(c, urls_first=True))
    assert squeezed(out[0]) == "x y"


def test_letters_only_keeps_accents(spark):
    assert [squeezed(x) for x in applied(spark, ["Ñandú 3, über; ok!"], tx.letters_only)] == ["Ñandú über ok"]


TOKENS = {
    "sha256 256sha a1b2 word": ["word"],
    "l'eau": ["l", "eau"],
    "año ñandú": ["año", "ñandú"],
    "a😀b x": ["a", "b", "x"],
    "uno,dos;tres": ["uno", "dos", "tres"],
    "x² ½ y": ["y"],
    "": [],
    "123 --": [],
}


def test_tokens(spark):
    assert applied(spark, list(TOKENS), tx.tokens) == list(TOKENS.values())


LATEX = {
    "a % nota\nb 50\\% c": "a b 50 c",
    "\\documentclass{x}\n\\begin{document}hola\\end{document} z": "hola",
    "\\section{Uno} \\textbf{dos \\emph{tres}} \\LaTeX{} fin": "Uno dos tres fin",
    "sea $x^2$ y $$a\nb$$ z \\[c\\]": "sea y z",
    "ver~\\cite[p. 1]{k} y \\ref{f}": "ver y",
    "a\\begin{figure}[h]\\caption{no}\\end{figure}b": "a b",
    "\\begin{itemize}\n\\item uno\n\\item[b] dos\n\\end{itemize}": "uno [b] dos",
}


def test_latex(spark):
    assert [squeezed(x) for x in applied(spark, list(LATEX), tx.strip_latex)] == list(LATEX.values())


def test_whole_cleaning_job(spark):
    rows = [
        (1, "es", "# La <b>Casa</b> de las FLORES y el sha256 http://x.y"),
        (2, "es", "de la que el"),
        (3, "es", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    out = {r["doc_id"]: (r["clean_text"], r["n_words"]) for r in cleaning.clean_corpus(docs).collect()}
    assert out == {1: ("casa flores", 2), 2: ("", 0), 3: ("", 0)}


LEMMAS = [("es", "flores", "flor"), ("es", "gatas", "la"), ("es", "mis", "propio"), ("en", "flores", "x")]


def lemma_docs(spark):
    rows = [(1, "es", "flores gatas mis flores otra"), (2, "en", "flores gatas"), (3, "es", ""), (4, "xx", "flores")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    return cleaning.with_tokens(docs), spark.createDataFrame(LEMMAS, "lang string, form string, lemma string")


EXPECTED = {1: ["flor", "la", "propio", "flor", "otra"], 2: ["x", "gatas"], 3: [], 4: ["flores"]}


def test_lemmas_inline(spark):
    docs, lemmas = lemma_docs(spark)
    out = cleaning.lemmatise(docs, lemmas).collect()
    assert {r["doc_id"]: r["tokens"] for r in out} == EXPECTED


def test_lemmas_joined(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "MAX_INLINE_LEMMAS", 1)
    docs, lemmas = lemma_docs(spark)
    out = cleaning.lemmatise(docs, lemmas).collect()
    assert {r["doc_id"]: r["tokens"] for r in out} == EXPECTED


def test_no_lemmas(spark):
    docs, lemmas = lemma_docs(spark)
    out = cleaning.lemmatise(docs, lemmas.limit(0)).collect()
    assert {r["doc_id"]: r["tokens"] for r in out}[1] == ["flores", "gatas", "mis", "flores", "otra"]


def test_stopwords_look_at_the_lemma(spark):
    """``gatas`` is listed by its lemma only and goes; ``mis`` is listed by its form only and stays."""
    docs, lemmas = lemma_docs(spark)
    out = cleaning.without_stopwords(cleaning.lemmatise(docs, lemmas)).collect()
    assert {r["doc_id"]: r["tokens"] for r in out}[1] == ["flor", "propio", "flor"]


def test_lemmas_both_ways_agree(spark, monkeypatch):
    """Null tokens, a key held by two rows and a form with two lemmas mean the same both ways."""
    rows = [(1, "es", ["flores", "x"]), (1, "es", ["gatas"]), (2, "es", None), (3, None, ["flores"]), (4, "es", [])]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, tokens array<string>")
    lemmas = spark.createDataFrame([("es", "flores", "flor"), ("es", "flores", "flora"), ("es", "gatas", "gato")], "lang string, form string, lemma string")
    inline = sorted(map(str, cleaning.lemmatise(docs, lemmas).collect()))
    monkeypatch.setattr(cleaning, "MAX_INLINE_LEMMAS", 1)
    assert sorted(map(str, cleaning.lemmatise(docs, lemmas).collect())) == inline
    assert "Row(doc_id=1, lang='es', tokens=['flor', 'x'])" in inline and "Row(doc_id=2, lang='es', tokens=None)" in inline
