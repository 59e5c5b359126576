"""The registered queries once more, as SQL for an independent database (DuckDB).

Written from the definitions, sharing only the fixed values: patterns, word lists, entities.
"""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from themeloom.functions import patterns as p
from themeloom.functions.lemmas import lemma_rows, paradigm_rows
from themeloom.functions.text import entity_names


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stopwords(language: str) -> list[str]:
    """A stopword list read straight from Spark's library file, without a session."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as archive:
        return archive.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8").split("\n")


def listed(*languages: str) -> str:
    return ", ".join(text(w) for w in sorted({w for lang in languages for w in stopwords(lang) if w}))


def drop(column: str, *found: str) -> str:
    for pattern in found:
        column = f"regexp_replace({column}, {text(pattern)}, ' ', 'g')"
    return column


def entities(column: str) -> str:
    names = ", ".join(f"{text(k)}: {text(v)}" for k, v in entity_names().items())
    name = f"regexp_extract(x, {text(p.HTML_ENTITY)}, 1)"
    code = (
        f"CASE WHEN lower({name}) LIKE '#x%' THEN ('0x' || substr({name}, 3))::BIGINT"
        f" WHEN {name} LIKE '#%' THEN substr({name}, 2)::BIGINT END"
    )
    found = (
        f"CASE WHEN {name} = '' THEN NULL"
        f" WHEN {name} LIKE '#%' THEN CASE WHEN ({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343"
        f" THEN chr(({code})::INTEGER) END"
        f" ELSE MAP {{{names}}}[{name}] END"
    )
    return (
        f"array_to_string(list_transform(string_split({column}, '&'), lambda x, i: CASE WHEN i = 1 THEN x"
        f" ELSE coalesce(({found}) || substr(x, length({name}) + 2), '&' || x) END), '')"
    )


def html(column: str) -> str:
    return entities(drop(column, p.HTML_MARKUP))


def markdown(column: str, urls_first: bool = False) -> str:
    middle = [p.URL, p.MARKS] if urls_first else [p.MARKS, p.URL]
    return drop(column, p.CODE_FENCE, *middle, p.IMAGE_LINK)


def clean(column: str) -> str:
    return f"lower({markdown(html(column))})"


def tokens(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all({column}, {text(p.TOKEN_RUN)}),"
        f" lambda w: regexp_full_match(w, {text(p.LETTERS)}))"
    )


def latex(column: str) -> str:
    column = f"regexp_replace({column}, {text(p.LATEX_COMMENT)}, '\\1', 'g')"
    column = drop(
        column, p.LATEX_PREAMBLE, p.LATEX_AFTER_END, p.LATEX_FLOAT, p.LATEX_DISPLAY_MATH,
        p.LATEX_INLINE_MATH, p.LATEX_REFERENCE, p.LATEX_ENVIRONMENT,
    )
    for _ in range(p.LATEX_NESTING):
        column = f"regexp_replace({column}, {text(p.LATEX_UNWRAP)}, '\\2', 'g')"
    return drop(column, p.LATEX_COMMAND, p.LATEX_LEFTOVER)


def stripped(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, {text(p.LEADING_SPACE)}, ''), {text(p.TRAILING_SPACE)}, '')"


def words(column: str) -> str:
    return f"len(regexp_extract_all({column}, {text(p.WORD)}))::INTEGER"


def shown(column: str) -> str:
    return f"(round({column}, 6) + 0.0)::DOUBLE"


IN_MARKDOWN = (
    text("# Informe &amp; notas\n\n![logo](img/logo.png) **")
    + " || lang || "
    + text('** <b class="x">')
    + " || text || "
    + text(
        "</b>\n```\ncode <KEY> block\n```\nver https://example.org/a-b_c y www.example.org"
        " &ntilde; &#233; &#xE9; &lt;i&gt; sha256\n> fin `x` ~y~ [![a](b.png)](c) ```z\n<!-- nota -->"
    )
)
IN_LATEX = (
    text("\\documentclass{book}\n% preamble\n\\begin{document}\n\\section{Informe ")
    + " || lang || "
    + text("}\n\\textbf{\\emph{")
    + " || source || "
    + text("}} ")
    + " || text || "
    + text(
        "\n% note\nen 50\\% de $x^2$ y \\[ y = 2 \\] ver \\cite[p. 3]{k1} y~\\ref{f}.\n"
        "\\begin{figure}[h]\n\\caption{nada}\n\\end{figure}\n\\begin{itemize}\n\\item uno\n\\end{itemize}\n"
        "\\end{document}\nresto"
    )
)


def build() -> dict[str, str]:
    stop = listed("spanish", "english")

    def keep_words(column: str) -> str:
        return f"list_filter({column}, lambda w: w NOT IN ({stop}))"

    lemma_map = "MAP {" + ", ".join(f"{text(lang + ' ' + form)}: {text(lemma)}" for lang, form, lemma in lemma_rows()) + "}"

    def lemmas(column: str) -> str:
        return f"list_transform({column}, lambda w: coalesce({lemma_map}[lang || ' ' || w], w))"

    # Shared tables.
    cleaned = (
        f"cleaned AS (SELECT doc_id, lang, source, text, {tokens('t')} AS tok FROM"
        f" (SELECT doc_id, lang, source, text, {clean('text')} AS t FROM documents))"
    )
    terms = cleaned + (
        f", terms AS (SELECT doc_id, lang, source, term, count(*) AS n FROM"
        f" (SELECT doc_id, lang, source, unnest(tok) AS term FROM cleaned)"
        f" WHERE length(term) >= 2 AND term NOT IN ({stop}) GROUP BY ALL)"
    )

    def tfidf(topic: str, source: str = "terms") -> str:
        return (
            f", counts AS (SELECT {topic} AS topic, term, sum(n) AS n FROM {source} GROUP BY ALL)"
            ", sizes AS (SELECT topic, sum(n) AS words FROM counts GROUP BY topic)"
            ", mean AS (SELECT avg(words) AS a FROM sizes)"
            ", totals AS (SELECT term, sum(n) AS f FROM counts GROUP BY term)"
            ", tfidf AS (SELECT topic, term, n / words * ln(1 + a / f) AS score"
            " FROM counts JOIN sizes USING (topic) JOIN totals USING (term), mean)"
            ", ranked AS (SELECT topic, term, score,"
            " row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM tfidf)"
        )

    shares = (
        ", counts AS (SELECT lang AS topic, term, sum(n) AS n FROM terms GROUP BY ALL)"
        ", shares AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS weight FROM counts)"
        ", ranked AS (SELECT topic, term, weight,"
        " row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM shares)"
    )
    by_quality = (
        ", classed AS (SELECT terms.*, coalesce(quality, -1) AS topic FROM terms LEFT JOIN labels USING (doc_id))"
        ", in_class AS (SELECT doc_id, text, coalesce(quality, -1) AS topic FROM documents LEFT JOIN labels USING (doc_id))"
    )
    lang_number = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE -1 END"
    signs = (
        ", signs AS (SELECT term, j, CASE WHEN (('0x' || substr(md5(term), (1 + j // 4)::INTEGER, 1))::INTEGER"
        " >> (3 - j % 4)::INTEGER) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s"
        " FROM (SELECT DISTINCT term FROM terms), range(64) r(j))"
    )
    embedded = signs + (
        ", raw AS (SELECT doc_id, j, sum((1 + ln(n)) * s) AS x FROM terms JOIN signs USING (term) GROUP BY ALL)"
        ", embedded AS (SELECT doc_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM raw)"
        ", doc_vec AS (SELECT doc_id, list(x ORDER BY j) AS v FROM embedded GROUP BY doc_id)"
        f", lang_centre AS (SELECT topic, list(x ORDER BY j) AS c FROM (SELECT {lang_number} AS topic, j, avg(x) AS x"
        " FROM embedded JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY topic)"
    )
    learned = (
        ", norms AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM raw GROUP BY doc_id)"
        ", word_sum AS (SELECT term, j, sum((1 + ln(n)) * x) AS y FROM terms JOIN embedded USING (doc_id) GROUP BY ALL)"
        ", word_own AS (SELECT term, sum(n) AS n, sum(pow(1 + ln(n), 2) / len) AS o FROM terms JOIN norms USING (doc_id) GROUP BY term)"
        ", word_all AS (SELECT term, any_value(n) AS n, list(y - s * o ORDER BY j) AS w, sqrt(sum(pow(y - s * o, 2))) AS len"
        " FROM word_sum JOIN signs USING (term, j) JOIN word_own USING (term) GROUP BY term)"
        ", word_vec AS (SELECT term, n, list_transform(w, lambda x: x / len) AS w FROM word_all WHERE len > 1e-9)"
    )
    word_vec = learned + (
        ", word_score AS (SELECT topic, term, list_cosine_similarity(w, c) AS score FROM word_vec, lang_centre WHERE n >= 2)"
        ", word_rank AS (SELECT topic, term, score,"
        " row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM word_score)"
    )
    assigned = (
        ", assigned AS (SELECT doc_id, topic, score FROM (SELECT doc_id, topic, list_cosine_similarity(v, c) AS score,"
        " row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, topic) AS k"
        " FROM doc_vec, lang_centre) WHERE k = 1)"
        ", everyone AS (SELECT d.doc_id, d.text, d.source, coalesce(a.topic, -1) AS topic, coalesce(a.score, 0.0) AS score"
        " FROM documents d LEFT JOIN assigned a USING (doc_id))"
    )
    vectors = (
        "vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
        ", parts AS (SELECT vec_id, label, i, v[i + 1] AS x FROM vec, range(64) r(i))"
        ", means AS (SELECT label AS topic, i, avg(x) AS x FROM parts GROUP BY ALL)"
        ", centre AS (SELECT topic, list(x ORDER BY i) AS c FROM means GROUP BY topic)"
    )
    nearest = vectors + (
        ", found AS (SELECT vec_id, topic, score FROM (SELECT vec_id, topic, list_cosine_similarity(v, c) AS score,"
        " row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, topic) AS k"
        " FROM vec, centre) WHERE k = 1)"
    )
    softmax = vectors + (
        ", near AS (SELECT vec_id, topic, exp(-pow(list_distance(v, c), 2) / 0.5) AS e FROM vec, centre)"
        ", weights AS (SELECT vec_id, topic, e / sum(e) OVER (PARTITION BY vec_id) AS weight FROM near)"
        ", best AS (SELECT vec_id, topic, weight FROM (SELECT *, row_number() OVER"
        " (PARTITION BY vec_id ORDER BY round(weight, 9) DESC, topic) AS k FROM weights) WHERE k = 1)"
    )
    capped = (
        ", vocab AS (SELECT term, count(*) AS df, sum(n) AS cf FROM terms GROUP BY term {having}"
        " ORDER BY cf DESC, term LIMIT 5000)"
    )
    word_softmax = learned + (
        ", word_near AS (SELECT topic, term, exp(-pow(list_distance(w, c), 2) / 0.5) AS e FROM word_vec, lang_centre)"
        ", word_share AS (SELECT topic, term, e / sum(e) OVER (PARTITION BY topic) AS weight FROM word_near)"
        ", topic_words AS (SELECT topic, string_agg(term, ' ' ORDER BY k) AS keywords FROM (SELECT topic, term,"
        " row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS k FROM word_share)"
        " WHERE k <= 15 GROUP BY topic)"
    )
    pairs = tfidf("lang") + (
        ", top AS (SELECT topic, term, rank FROM ranked WHERE rank <= 10)"
        ", hits AS (SELECT doc_id, topic, rank FROM terms JOIN top USING (term))"
        ", one AS (SELECT topic, rank, count(*) AS d FROM hits GROUP BY ALL)"
        ", two AS (SELECT a.topic, a.rank AS i, b.rank AS j, count(*) AS d FROM hits a JOIN hits b"
        " ON a.doc_id = b.doc_id AND a.topic = b.topic AND a.rank < b.rank GROUP BY ALL)"
        ", pair AS (SELECT a.topic, a.d AS d_i, b.d AS d_j, coalesce(two.d, 0) AS d_ij, (SELECT count(*) FROM documents) AS n"
        " FROM one a JOIN one b ON a.topic = b.topic AND a.rank < b.rank"
        " LEFT JOIN two ON two.topic = a.topic AND two.i = a.rank AND two.j = b.rank)"
    )
    by_two = (
        "pair AS (SELECT lang AS a, quality AS b, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"
        ", whole AS (SELECT sum(n) AS t FROM pair)"
        ", of_a AS (SELECT a, sum(n) AS n, max(n) AS most FROM pair GROUP BY a)"
        ", of_b AS (SELECT b, sum(n) AS n FROM pair GROUP BY b)"
    )

    held = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0)"

    def lda_rounds(fitted: str, rounds: int = 2) -> str:
        """``lam`` and ``beta`` of the words, ``th`` of the documents in ``fitted``, for each round."""
        sql = (
            f", cf AS (SELECT term, sum(n) AS cf FROM {fitted} GROUP BY term)"
            ", ks AS (SELECT unnest(range(8))::INTEGER AS k)"
            ", lam0 AS (SELECT term, k, cf * (0.5 + ('0x' || substr(md5(term || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS l"
            " FROM cf, ks)"
        )
        for r in range(rounds + 1):
            sql += (
                f", tot{r} AS (SELECT k, sum(l) AS s FROM lam{r} GROUP BY k)"
                f", beta{r} AS (SELECT term, k, (0.01 + l) / (0.01 * (SELECT count(*) FROM cf) + s) AS b FROM lam{r} JOIN tot{r} USING (k))"
            )
            if r < rounds:
                sql += lda_step(fitted, f"beta{r}", f"th{r}" if r else "", f"phi{r + 1}", f"th{r + 1}")
                sql += f", lam{r + 1} AS (SELECT term, k, sum(v) AS l FROM phi{r + 1} GROUP BY ALL)"
        return sql

    def lda_step(words: str, beta: str, before: str, phi: str, after: str) -> str:
        weight, given = ("w", f" JOIN {before} USING (doc_id, k)") if before else ("1.0::DOUBLE", "")
        return (
            f", {phi} AS (SELECT doc_id, term, k, n * p / sum(p) OVER (PARTITION BY doc_id, term) AS v FROM"
            f" (SELECT doc_id, term, k, n, b * {weight} AS p FROM {words} JOIN {beta} USING (term){given}))"
            f", {after} AS (SELECT doc_id, k, (0.1 + x) / sum(0.1 + x) OVER (PARTITION BY doc_id) AS w FROM"
            f" (SELECT doc_id, k, sum(v) AS x FROM {phi} GROUP BY ALL))"
        )

    def with_(*parts: str) -> str:
        return "WITH " + "".join(parts) + " "

    sql = {}
    sql["corpus_scan"] = (
        f"SELECT doc_id, source AS name, {stripped('text')} AS text, {words(stripped('text'))} AS n_words FROM documents"
    )
    sql["corpus_folder"] = (
        "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, lpad(doc_id::VARCHAR, 20, '0') || '.txt' AS name,"
        f" coalesce({stripped('text')}, '') AS text, coalesce({words(stripped('text'))}, 0) AS n_words FROM documents"
    )
    sql["corpus_profile"] = (
        "SELECT lang, source, count(*) AS n_docs, sum(w)::BIGINT AS n_words, min(w) AS min_words, max(w) AS max_words,"
        f" {shown('sum(w) / count(*)')} AS avg_words FROM (SELECT lang, source, {words('text')} AS w FROM documents)"
        " GROUP BY GROUPING SETS ((), (lang), (source))"
    )
    sql["word_counts"] = f"SELECT doc_id, {words('text')} AS n_words FROM documents"
    sql["clean_html"] = f"SELECT page_id, {html('html')} AS text FROM pages"
    wrapped = f"(SELECT doc_id, lang, {IN_MARKDOWN} AS m FROM documents)"
    sql["clean_markdown"] = f"SELECT doc_id, {markdown('m')} AS text FROM {wrapped}"
    sql["clean_markdown_urls_first"] = f"SELECT doc_id, {markdown('m', True)} AS text FROM {wrapped}"
    sql["clean_latex"] = f"SELECT doc_id, {latex('m')} AS text FROM (SELECT doc_id, {IN_LATEX} AS m FROM documents)"
    only = drop(markdown("h"), p.NOT_LETTER_OR_SPACE)
    sql["letters_only"] = f"SELECT doc_id, lower({only}) AS text FROM (SELECT doc_id, {html('m')} AS h FROM {wrapped})"
    sql["tokens"] = (
        "SELECT doc_id, len(tok)::INTEGER AS n, array_to_string(tok, ' ') AS words FROM"
        f" (SELECT doc_id, {tokens('t')} AS tok FROM (SELECT doc_id, {clean('m')} AS t FROM {wrapped}))"
    )
    sql["lemma_lookup"] = (
        f"WITH {cleaned} SELECT doc_id, array_to_string({lemmas('tok')}, ' ') AS lemmas FROM cleaned"
    )
    listed_forms = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in lemma_rows() + paradigm_rows())
    rules = (
        f"listed(lang, form, lemma) AS (VALUES {listed_forms}), known AS (SELECT lang, form, arg_min(lemma, (itself, lemma)) AS lemma FROM"
        " (SELECT lang, form, lemma, 0 AS itself FROM listed UNION ALL SELECT lang, lemma, lemma, 1 FROM listed) GROUP BY ALL),"
        " edits AS (SELECT lang, form, lemma,"
        " len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: form[:i] = lemma[:i])) AS same FROM known),"
        " ends AS (SELECT lang, form, (length(form) - same)::INTEGER AS cut, lemma[same + 1:] AS added,"
        " unnest(range(1, length(form) + 1)) AS n FROM edits),"
        " rules AS (SELECT lang, right(form, n) AS suffix, cut, added FROM ends WHERE n >= cut GROUP BY lang, right(form, n), cut, added HAVING count(*) >= 2"
        " QUALIFY row_number() OVER (PARTITION BY lang, right(form, n) ORDER BY count(*) DESC, cut, added) = 1),"
        f" said AS (SELECT DISTINCT lang, unnest(tok) AS form FROM (SELECT lang, {tokens('t')} AS tok FROM (SELECT lang, {clean('text')} AS t FROM documents))),"
        " chosen AS (SELECT s.lang, s.form, arg_max((r.suffix, r.cut, r.added), length(r.suffix)) AS rule FROM said s"
        " JOIN rules r ON s.lang = r.lang AND ends_with(s.form, r.suffix) AND r.cut < length(s.form)"
        " ANTI JOIN known k ON s.lang = k.lang AND s.form = k.form GROUP BY ALL)"
    )
    sql["lemma_guess"] = (
        f"WITH {rules}, lemmas AS (SELECT * FROM known UNION ALL"
        " SELECT lang, form, left(form, length(form) - rule[2]) || rule[3] FROM chosen),"
        f" said_at AS (SELECT doc_id, lang, unnest(tok) AS form, generate_subscripts(tok, 1) AS place FROM"
        f" (SELECT doc_id, lang, {tokens('t')} AS tok FROM (SELECT doc_id, lang, {clean('text')} AS t FROM documents))),"
        " joined AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY place) AS lemmas"
        " FROM said_at LEFT JOIN lemmas USING (lang, form) GROUP BY doc_id)"
        " SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(lemmas, '') END AS lemmas FROM documents LEFT JOIN joined USING (doc_id)"
    )
    sql["lemma_rule_use"] = (
        f"WITH {rules} SELECT r.lang, r.suffix, r.cut, r.added, count(c.form) AS n_words FROM rules r"
        " LEFT JOIN chosen c ON c.lang = r.lang AND c.rule[1] = r.suffix GROUP BY ALL"
    )
    sql["stopword_filter"] = (
        f"WITH {cleaned}, kept AS (SELECT doc_id, {keep_words('tok')} AS k FROM cleaned)"
        " SELECT doc_id, len(k)::INTEGER AS n, array_to_string(k, ' ') AS words FROM kept"
    )
    sql["clean_text"] = (
        f"WITH tok AS (SELECT doc_id, lang, {tokens('t')} AS tok FROM (SELECT doc_id, lang, {clean('m')} AS t FROM {wrapped})),"
        f" lem AS (SELECT doc_id, {lemmas('tok')} AS tok FROM tok), kept AS (SELECT doc_id, {keep_words('tok')} AS k FROM lem)"
        " SELECT doc_id, array_to_string(k, ' ') AS clean_text, len(k)::INTEGER AS n_words FROM kept"
    )
    sql["clean_text_surface"] = (
        f"WITH tok AS (SELECT doc_id, lang, {keep_words(tokens('t'))} AS tok FROM (SELECT doc_id, lang, {clean('m')} AS t FROM {wrapped})),"
        f" lem AS (SELECT doc_id, {lemmas('tok')} AS tok FROM tok), kept AS (SELECT doc_id, {keep_words('tok')} AS k FROM lem)"
        " SELECT doc_id, array_to_string(k, ' ') AS clean_text, len(k)::INTEGER AS n_words FROM kept"
    )
    sql["clean_pages"] = (
        f"WITH kept AS (SELECT page_id, {keep_words(tokens('t'))} AS k FROM (SELECT page_id, {clean('html')} AS t FROM pages))"
        " SELECT page_id, array_to_string(k, ' ') AS clean_text, len(k)::INTEGER AS n_words FROM kept"
    )
    union = (
        f"WITH {cleaned}, listed AS (SELECT term, string_agg(language, ' ' ORDER BY language) AS languages FROM ("
        f"SELECT unnest([{listed('spanish')}]) AS term, 'spanish' AS language UNION"
        f" SELECT unnest([{listed('english')}]) AS term, 'english' AS language) GROUP BY term),"
        " found AS (SELECT term, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(tok) AS term FROM cleaned) GROUP BY term)"
        " SELECT term, languages, coalesce(n_docs, 0) AS n_docs FROM listed LEFT JOIN found USING (term)"
    )
    sql["stopword_union"] = union
    sql["stopword_sample"] = union + " ORDER BY term LIMIT 15"
    sql["vocabulary"] = (
        f"WITH {terms} SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, count(*) AS df, sum(n)::BIGINT AS cf"
        " FROM terms GROUP BY term"
    )
    sql["vocabulary_capped"] = (
        f"WITH {terms}{capped.format(having='HAVING count(*) >= 2')}"
        " SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf::BIGINT AS cf FROM vocab"
    )
    sql["doc_term_counts"] = f"WITH {terms} SELECT doc_id, term, n FROM terms"
    spoken = (
        f"spoken AS (SELECT role, unnest({tokens('t')}) AS term FROM (SELECT role, {clean('text')} AS t FROM conversations))"
        f", terms AS (SELECT role, term, count(*) AS n FROM spoken WHERE length(term) >= 2 AND term NOT IN ({stop}) GROUP BY ALL)"
    )
    sql["conversation_terms"] = (
        with_(spoken, tfidf("role"))
        + f"SELECT topic AS role, rank::INTEGER AS rank, term, {shown('score')} AS score FROM ranked WHERE rank <= 10"
    )
    sql["ctfidf_topic_words"] = (
        with_(terms, tfidf("lang"))
        + f"SELECT topic AS lang, rank::INTEGER AS rank, term, {shown('score')} AS score FROM ranked WHERE rank <= 10"
    )
    sql["topic_keywords"] = (
        with_(terms, shares) + "SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 5 GROUP BY topic"
    )
    sql["topic_chart_data"] = (
        with_(terms, shares) + f"SELECT topic, rank::INTEGER AS rank, term, {shown('weight')} AS weight FROM ranked WHERE rank <= 10"
    )
    sql["wordcloud_weights"] = (
        with_(terms, tfidf("lang"))
        + f"SELECT topic, term, {shown('score')} AS score, {shown('score / max(score) OVER (PARTITION BY topic)')} AS weight"
        " FROM ranked WHERE rank <= 10"
    )
    sql["topic_words_n"] = (
        with_(terms, tfidf("lang"))
        + f"SELECT topic, rank::INTEGER AS rank, term, {shown('score')} AS score FROM ranked WHERE rank <= 5 AND topic = 'es'"
    )
    sql["topic_listing"] = (
        with_(terms, by_quality, tfidf("topic", "classed"))
        + "SELECT topic, count(*) AS n, keywords FROM in_class JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords"
        " FROM ranked WHERE rank <= 8 GROUP BY topic) USING (topic) WHERE topic <> -1 GROUP BY topic, keywords"
    )
    sql["topic_info"] = (
        with_(terms, by_quality, tfidf("topic", "classed"), embedded)
        + ", centre AS (SELECT topic, list(x ORDER BY j) AS c FROM (SELECT topic, j, avg(x) AS x FROM embedded"
        " JOIN in_class USING (doc_id) GROUP BY ALL) GROUP BY topic)"
        ", own AS (SELECT doc_id, topic, coalesce(list_cosine_similarity(v, c), 0.0) AS score FROM in_class JOIN centre USING (topic)"
        " LEFT JOIN doc_vec USING (doc_id))"
        ", sample AS (SELECT topic, string_agg(doc_id::VARCHAR, ', ' ORDER BY k) AS sample_docs FROM (SELECT topic, doc_id,"
        " row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, doc_id) AS k FROM own) WHERE k <= 3 GROUP BY topic)"
        ", described AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords,"
        " topic || '_' || string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS name FROM ranked WHERE rank <= 10 GROUP BY topic)"
        " SELECT topic, n, name, keywords, sample_docs FROM (SELECT topic, count(*) AS n FROM in_class GROUP BY topic)"
        " JOIN described USING (topic) JOIN sample USING (topic)"
    )
    sql["doc_keywords"] = (
        with_(terms, by_quality, tfidf("topic", "classed"))
        + "SELECT doc_id, text, topic, keywords FROM in_class JOIN (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords"
        " FROM ranked WHERE rank <= 5 GROUP BY topic) USING (topic)"
    )
    sql["doc_embedding"] = (
        with_(terms, embedded)
        + f"SELECT doc_id, j::INTEGER AS dim, {shown('x')} AS value FROM documents LEFT JOIN embedded USING (doc_id)"
    )
    sql["topic_centroids"] = with_(vectors) + f"SELECT topic, i::INTEGER AS dim, {shown('x')} AS value FROM means"
    sql["doc_topic_affinity"] = with_(nearest) + f"SELECT vec_id, topic, {shown('score')} AS score FROM found"
    sql["topic_sizes"] = with_(nearest) + "SELECT topic, count(*) AS n FROM found GROUP BY topic"
    sql["topic_count"] = (
        "SELECT count(DISTINCT topic) AS n_topics, count(DISTINCT topic) FILTER (topic <> -1) AS n_without_outliers FROM"
        " (SELECT coalesce(quality, -1) AS topic FROM documents LEFT JOIN labels USING (doc_id))"
    )
    sql["topic_words_cosine"] = (
        with_(terms, embedded, word_vec)
        + f"SELECT topic, rank::INTEGER AS rank, term, {shown('score')} AS score FROM word_rank WHERE rank <= 50"
    )
    sql["doc_topic_report"] = (
        with_(terms, embedded, word_vec, assigned)
        + f"SELECT doc_id, text, topic, {shown('score')} AS score, words FROM everyone LEFT JOIN"
        " (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words FROM word_rank WHERE rank <= 50 GROUP BY topic) USING (topic)"
    )
    sql["doc_topic_softmax"] = with_(softmax) + f"SELECT vec_id, topic, {shown('weight')} AS weight FROM weights"
    sql["topic_confidence"] = with_(softmax) + f"SELECT vec_id, topic, {shown('weight')} AS confidence FROM best"
    sql["dominant_topic"] = (
        with_(softmax) + f"SELECT vec_id, topic, {shown('weight')} AS weight, 'Tema ' || (topic + 1) AS dominant FROM best"
    )
    columns = ", ".join(
        f"{shown(f'max(weight) FILTER (topic = {i})')} AS \"Tema {i + 1}\"" for i in range(10)
    )
    sql["doc_topic_wide"] = (
        with_(softmax)
        + f"SELECT vec_id, {columns}, 'Tema ' || (arg_min(topic, rn) + 1) AS \"Tema dominante\" FROM"
        " (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(weight, 6) DESC, topic) AS rn FROM weights) GROUP BY vec_id"
    )
    sql["ot_topic_words"] = with_(terms, embedded, word_softmax) + "SELECT topic, keywords FROM topic_words"
    sql["doc_confidence_report"] = (
        with_(terms, embedded, word_softmax)
        + ", dw AS (SELECT doc_id, topic, e / sum(e) OVER (PARTITION BY doc_id) AS weight FROM"
        " (SELECT doc_id, topic, exp(-pow(list_distance(v, c), 2) / 0.5) AS e FROM doc_vec, lang_centre))"
        ", db AS (SELECT doc_id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id"
        " ORDER BY round(weight, 9) DESC, topic) AS k FROM dw) WHERE k = 1)"
        f", kept AS (SELECT doc_id, array_to_string({keep_words('tok')}, ' ') AS text FROM cleaned)"
        f" SELECT doc_id, text, coalesce(topic, -1) AS topic, {shown('coalesce(weight, 0.0)')} AS confidence, keywords AS topic_words"
        " FROM kept LEFT JOIN db USING (doc_id) LEFT JOIN topic_words USING (topic)"
    )
    sql["coherence_umass"] = (
        with_(terms, pairs) + f"SELECT topic, {shown('sum(ln((d_ij + 1) / d_i))')} AS coherence FROM pair GROUP BY topic"
    )
    npmi = (
        "CASE WHEN d_ij = 0 THEN -1.0 WHEN d_ij = n THEN 1.0"
        " ELSE ln((d_ij / n) / ((d_i / n) * (d_j / n))) / -ln(d_ij / n) END"
    )
    sql["coherence_npmi"] = (
        with_(terms, pairs)
        + f"SELECT topic, {shown('avg(v)')} AS coherence FROM (SELECT topic, {npmi} AS v FROM pair WHERE d_ij > 0"
        " UNION ALL SELECT topic, -1.0 FROM pair WHERE d_ij = 0) GROUP BY topic"
    )
    sql["topic_diversity"] = (
        with_(terms, tfidf("lang"))
        + "SELECT count(*) AS n_words, count(DISTINCT term) AS n_distinct,"
        f" {shown('count(DISTINCT term) / count(*)')} AS diversity FROM ranked WHERE rank <= 10"
    )
    sql["topic_contingency"] = (
        "SELECT lang AS a, quality AS b, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL"
    )
    sql["topic_agreement"] = (
        with_(by_two)
        + ", info AS (SELECT sum(pair.n / t * ln(pair.n * t / (of_a.n * of_b.n))) AS i"
        " FROM pair JOIN of_a USING (a) JOIN of_b USING (b), whole)"
        ", ha AS (SELECT -sum(n / t * ln(n / t)) AS h FROM of_a, whole), hb AS (SELECT -sum(n / t * ln(n / t)) AS h FROM of_b, whole)"
        f" SELECT t::BIGINT AS n, {shown('(SELECT sum(most) FROM of_a) / t')} AS purity,"
        f" {shown('CASE WHEN ha.h + hb.h = 0 THEN 1.0 ELSE i / ((ha.h + hb.h) / 2) END')} AS nmi FROM whole, info, ha, hb"
    )
    sql["topic_search"] = (
        with_(terms, tfidf("lang"))
        + ", query AS (SELECT term FROM ranked WHERE topic = 'es' AND rank <= 5)"
        ", frequency AS (SELECT term, count(*) AS df FROM terms WHERE term IN (SELECT term FROM query) GROUP BY term)"
        ", scored AS (SELECT doc_id, sum((1 + ln(n)) * ln((SELECT count(*) FROM documents) / df)) AS score, count(*) AS n_matched"
        " FROM terms JOIN frequency USING (term) GROUP BY doc_id)"
        f" SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank, doc_id, {shown('score')} AS score, n_matched"
        " FROM scored ORDER BY rank LIMIT 20"
    )
    sql["topic_search_by_topic"] = (
        with_(nearest)
        + f"SELECT vec_id, topic, {shown('score')} AS score FROM found WHERE topic = 3 ORDER BY round(found.score, 9) DESC, vec_id LIMIT 20"
    )
    sql["topic_trend"] = (
        with_(terms, embedded, assigned)
        + f"SELECT source, topic, n, {shown('n / sum(n) OVER (PARTITION BY source)')} AS share FROM"
        " (SELECT source, topic, count(*) AS n FROM everyone GROUP BY ALL)"
    )
    sql["lda_round"] = (
        with_(terms, lda_rounds("terms"))
        + f"SELECT doc_id, k AS topic, {shown('coalesce(w, 1.0 / 8)')} AS weight FROM documents CROSS JOIN ks"
        " LEFT JOIN th2 USING (doc_id, k)"
    )
    sql["lda_round_words"] = (
        with_(terms, lda_rounds("terms"))
        + f"SELECT topic, rank::INTEGER AS rank, term, {shown('b')} AS weight FROM (SELECT k AS topic, term, b,"
        " row_number() OVER (PARTITION BY k ORDER BY round(b, 9) DESC, term) AS rank FROM beta2) WHERE rank <= 20"
    )
    sql["lda_completion"] = (
        with_(terms)
        + f", fitted AS (SELECT * FROM terms WHERE NOT {held})"
        + lda_rounds("fitted")
        + f", kept AS (SELECT doc_id, {keep_words('tok')} AS k FROM cleaned WHERE {held})"
        ", placed AS (SELECT doc_id, unnest(k) AS term, unnest(range(len(k))) % 2 AS odd FROM kept)"
        ", half AS (SELECT doc_id, term, odd, count(*) AS n FROM placed WHERE length(term) >= 2 AND term IN (SELECT term FROM cf) GROUP BY ALL)"
        ", seen AS (SELECT doc_id, term, n FROM half WHERE odd = 0)"
        + lda_step("seen", "beta2", "", "q1", "u1")
        + lda_step("seen", "beta2", "u1", "q2", "u2")
        + ", chance AS (SELECT h.doc_id, term, any_value(n) AS n, sum(b * coalesce(w, 1.0 / 8)) AS p FROM half h JOIN beta2 USING (term)"
        " LEFT JOIN u2 ON u2.doc_id = h.doc_id AND u2.k = beta2.k WHERE odd = 1 GROUP BY h.doc_id, term)"
        ", sums AS (SELECT doc_id, sum(n * ln(p)) AS l, sum(n)::BIGINT AS n FROM chance GROUP BY doc_id)"
        f" SELECT doc_id, {shown('coalesce(l, 0.0)')} AS log_likelihood, coalesce(n, 0) AS n_words FROM documents"
        f" LEFT JOIN sums USING (doc_id) WHERE {held}"
    )
    coordinates = ", ".join(
        f"sum(CASE WHEN j & {bit} = 0 THEN x ELSE -x END) / 8.0 AS x{i}" for i, bit in enumerate((1, 2, 4, 8, 16))
    )
    atom = ", ".join(f"floor(x{i} / (0.25 / 6)) AS a{i}" for i in range(5))
    cell = ", ".join(f"floor((a{i} + s) / 6) AS c{i}" for i in range(5))
    same = ", ".join(f"c{i}" for i in range(5))
    sql["density_cluster_exact"] = (
        "WITH RECURSIVE "
        + terms
        + embedded
        + f", points AS (SELECT doc_id, {coordinates} FROM embedded GROUP BY doc_id)"
        f", atoms AS (SELECT doc_id, {atom} FROM points)"
        f", cells AS (SELECT doc_id, s, {cell} FROM atoms, range(6) r(s))"
        f", links AS (SELECT DISTINCT doc_id AS a, min(doc_id) OVER (PARTITION BY s, {same}) AS b FROM cells)"
        ", edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"
        ", reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)"
        ", labels_of AS (SELECT a AS doc_id, min(b) AS g FROM reach GROUP BY a)"
        ", sizes_of AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS topic FROM labels_of"
        " GROUP BY g HAVING count(*) >= 2)"
        " SELECT d.doc_id, coalesce(s.topic, -1)::INTEGER AS topic FROM documents d LEFT JOIN labels_of l USING (doc_id)"
        " LEFT JOIN sizes_of s USING (g)"
    )
    return sql
