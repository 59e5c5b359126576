"""One query per operator over the given tables, for checks and benchmarks.

Every query takes ``(spark, folder)`` and reads whole tables. Classes given by the data
stand in for fitted topics where an operator reports on topics: the language of a document,
its quality label (-1 where it has none), the label of a vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.functions.arrays import shown
from themeloom.functions.lemmas import inflected_table, lemma_table
from themeloom.functions.stopwords import stopword_list, stopword_table
from themeloom.operators import assign, cleaning, density, embedding as em, evaluate, lda, lemma_rules, represent, transport, vocabulary
from themeloom.operators.joins import small_lookup
from themeloom.plans import models
from themeloom.session import materialise, scratch_folder
from themeloom.sources import corpus

LANGUAGE_TOPICS = ["de", "en", "es", "fr"]  # topic number = place in this list
TEMPERATURE = 0.5
WORD_TEMPERATURE = 0.5
SEARCH_TOPIC = "es"

Query = Callable[[SparkSession, str], DataFrame]


# Inputs


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.read_table(spark, f"{folder}/documents.parquet", "doc_id")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.without_stopwords(cleaning.with_tokens(documents(spark, folder)))


def terms(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    return vocabulary.doc_terms(cleaned(spark, folder), *carry)


def language_topic() -> Column:
    number = F.lit(-1)
    for i, lang in enumerate(LANGUAGE_TOPICS):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
    return number


def language_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a vector and their language as topic."""
    return em.hashed_embedding(cleaned(spark, folder).withColumn("topic", language_topic()), length="length")


def quality_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality label as topic, -1 where they have none."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    return cleaned(spark, folder).join(labels, "doc_id", "left").withColumn("topic", F.coalesce("quality", F.lit(-1)))


def stored_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Words and vector of each document, written once for queries that read them repeatedly."""
    docs = language_docs(spark, folder)
    return materialise(docs.select("doc_id", "lang", "source", "topic", "tokens", "embedding", "length"), "docs")


def stored_terms(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(terms(spark, folder, "doc_id", "lang"), "terms")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    table = corpus.read_table(spark, f"{folder}/embeddings.parquet", "vec_id")
    return table.withColumnRenamed("label", "topic")


def language_words(counted: DataFrame) -> DataFrame:
    return represent.top_terms(vocabulary.class_tfidf(counted, "lang"), 10)


def quality_words(docs: DataFrame) -> DataFrame:
    return represent.top_terms(vocabulary.class_tfidf(vocabulary.doc_terms(docs, "topic")), 10)


def in_markdown() -> Column:
    """Document text wrapped in the marks that cleaning takes out."""
    return F.concat(
        F.lit("# Informe &amp; notas\n\n![logo](img/logo.png) **"),
        "lang",
        F.lit('** <b class="x">'),
        "text",
        F.lit(
            "</b>\n```\ncode <KEY> block\n```\nver https://example.org/a-b_c y www.example.org"
            " &ntilde; &#233; &#xE9; &lt;i&gt; sha256\n> fin `x` ~y~ [![a](b.png)](c) ```z\n<!-- nota -->"
        ),
    )


def in_latex() -> Column:
    """Document text as the body of a LaTeX source."""
    return F.concat(
        F.lit("\\documentclass{book}\n% preamble\n\\begin{document}\n\\section{Informe "),
        "lang",
        F.lit("}\n\\textbf{\\emph{"),
        "source",
        F.lit("}} "),
        "text",
        F.lit(
            "\n% note\nen 50\\% de $x^2$ y \\[ y = 2 \\] ver \\cite[p. 3]{k1} y~\\ref{f}.\n"
            "\\begin{figure}[h]\n\\caption{nada}\n\\end{figure}\n\\begin{itemize}\n\\item uno\n\\end{itemize}\n"
            "\\end{document}\nresto"
        ),
    )


# Sources and cleaning


def corpus_scan(spark, folder):
    return corpus.corpus_frame(documents(spark, folder), "doc_id", "source", "text")


def corpus_folder(spark, folder):
    """Documents written as one text file each and read back from the folder."""
    docs = documents(spark, folder).withColumn("name", F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".txt")))
    texts = f"{scratch_folder(spark)}/texts-{uuid.uuid4().hex}"
    corpus.write_text_folder(docs, texts, "name", "text")
    return corpus.read_text_folder(spark, texts, "*.txt")


def corpus_profile(spark, folder):
    return corpus.corpus_profile(documents(spark, folder), "lang", "source").withColumn("avg_words", shown(F.col("avg_words")))


def word_counts(spark, folder):
    return documents(spark, folder).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


def clean_html(spark, folder):
    pages = corpus.read_table(spark, f"{folder}/pages.parquet", "page_id")
    return pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


def clean_markdown(spark, folder):
    return documents(spark, folder).select("doc_id", tx.strip_markdown(in_markdown()).alias("text"))


def clean_markdown_urls_first(spark, folder):
    return documents(spark, folder).select("doc_id", tx.strip_markdown(in_markdown(), urls_first=True).alias("text"))


def clean_latex(spark, folder):
    return documents(spark, folder).select("doc_id", tx.strip_latex(in_latex()).alias("text"))


def letters_only(spark, folder):
    return documents(spark, folder).select("doc_id", tx.clean(in_markdown(), letters=True).alias("text"))


def tokens(spark, folder):
    words = documents(spark, folder).select("doc_id", tx.clean_tokens(in_markdown()).alias("tokens"))
    return words.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))


def lemma_lookup(spark, folder):
    words = cleaning.lemmatise(cleaning.with_tokens(documents(spark, folder)), lemma_table(spark))
    return words.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


def lemma_guess(spark, folder):
    """Lemmas of all words: listed ones by the table, others by the rules learned from it."""
    words = lemma_rules.lemmatise(cleaning.with_tokens(documents(spark, folder)), inflected_table(spark))
    return words.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


def lemma_rule_use(spark, folder):
    """Each rule, with the distinct words of the documents that it gives a lemma to."""
    table = inflected_table(spark)
    words = cleaning.with_tokens(documents(spark, folder)).select("lang", F.explode(F.array_distinct("tokens")).alias("form")).distinct()
    unseen = words.join(lemma_rules.known_forms(table).select("lang", "form"), ["lang", "form"], "left_anti")
    rules = lemma_rules.learn(table)
    used = lemma_rules.longest_endings(unseen, rules).groupBy("lang", "suffix").agg(F.count("*").alias("n_words"))
    return rules.join(used, ["lang", "suffix"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def stopword_filter(spark, folder):
    return cleaned(spark, folder).select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))


def clean_text(spark, folder):
    docs = documents(spark, folder).withColumn("text", in_markdown())
    out = cleaning.clean_corpus(docs, lemmas=lemma_table(spark))
    return out.select("doc_id", "clean_text", "n_words")


def clean_text_surface(spark, folder):
    """Stopwords go by their form in the text as well as by their lemma."""
    docs = documents(spark, folder).withColumn("text", in_markdown())
    out = cleaning.clean_corpus(docs, lemmas=lemma_table(spark), surface=True)
    return out.select("doc_id", "clean_text", "n_words")


def clean_pages(spark, folder):
    pages = corpus.read_table(spark, f"{folder}/pages.parquet", "page_id")
    return cleaning.clean_corpus(pages, "html").select("page_id", "clean_text", "n_words")


def stopword_union(spark, folder):
    """The union of the lists, with the number of documents each word is found in."""
    words = cleaning.with_tokens(documents(spark, folder)).select(F.explode(F.array_distinct("tokens")).alias("term"))
    found = words.filter(F.col("term").isin(stopword_list())).groupBy("term").agg(F.count("*").alias("n_docs"))
    listed = stopword_table(spark)
    return listed.join(found, "term", "left").select("term", "languages", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def stopword_sample(spark, folder):
    return stopword_union(spark, folder).orderBy("term").limit(15)


# Counts


def vocabulary_all(spark, folder):
    return vocabulary.vocabulary(terms(spark, folder))


def vocabulary_capped(spark, folder):
    return vocabulary.vocabulary(terms(spark, folder), min_df=2, max_vocab=5_000)


def doc_term_counts(spark, folder):
    return terms(spark, folder, "doc_id")


def conversation_terms(spark, folder):
    """Class TF-IDF over a second corpus: the words that mark each speaker."""
    turns = corpus.read_table(spark, f"{folder}/conversations.parquet", "conv_id")
    spoken = vocabulary.doc_terms(cleaning.without_stopwords(cleaning.with_tokens(turns)), "role")
    top = represent.top_terms(vocabulary.class_tfidf(spoken, "role"), 10)
    return top.select(F.col("topic").alias("role"), "rank", "term", shown(F.col("score")).alias("score"))


# Topic tables from class counts


def ctfidf_topic_words(spark, folder):
    top = language_words(terms(spark, folder, "lang"))
    return top.select(F.col("topic").alias("lang"), "rank", "term", shown(F.col("score")).alias("score"))


def topic_keywords(spark, folder):
    shares = vocabulary.class_shares(terms(spark, folder, "lang"), "lang")
    return represent.keywords(represent.top_terms(shares, 5, "weight"), 5)


def topic_chart_data(spark, folder):
    shares = vocabulary.class_shares(terms(spark, folder, "lang"), "lang")
    return represent.top_terms(shares, 10, "weight").withColumn("weight", shown(F.col("weight")))


def wordcloud_weights(spark, folder):
    cloud = represent.wordcloud_weights(language_words(terms(spark, folder, "lang")))
    return cloud.select("topic", "term", shown(F.col("score")).alias("score"), shown(F.col("weight")).alias("weight"))


def topic_words_n(spark, folder):
    tfidf = vocabulary.class_tfidf(terms(spark, folder, "lang"), "lang")
    return represent.words_of_topic(tfidf, "es", 5).withColumn("score", shown(F.col("score")))


def topic_listing(spark, folder):
    docs = materialise(quality_docs(spark, folder).select("doc_id", "topic", "tokens"), "docs")
    return represent.topic_listing(docs, quality_words(docs))


def topic_info(spark, folder):
    docs = em.hashed_embedding(quality_docs(spark, folder)).select("doc_id", "topic", "tokens", "embedding")
    docs = materialise(docs, "docs")
    scored = models.own_topic_score(docs, assign.topic_centroids(docs))
    info = represent.topic_info(scored, quality_words(docs))
    return info.select(
        "topic",
        "n",
        "name",
        F.array_join("keywords", ", ").alias("keywords"),
        F.array_join(F.col("sample_docs").cast("array<string>"), ", ").alias("sample_docs"),
    )


def doc_keywords(spark, folder):
    docs = quality_docs(spark, folder)
    out = represent.with_keywords(docs.select("doc_id", "text", "topic"), quality_words(docs), 5)
    return out.select("doc_id", "text", "topic", "keywords")


# Vectors


def doc_embedding(spark, folder):
    docs = language_docs(spark, folder).select("doc_id", F.posexplode_outer("embedding").alias("dim", "value"))
    return docs.withColumn("value", shown(F.col("value")))


def topic_centroids(spark, folder):
    centres = assign.topic_centroids(vectors(spark, folder)).select("topic", F.posexplode("vector").alias("dim", "value"))
    return centres.withColumn("value", shown(F.col("value")))


def doc_topic_affinity(spark, folder):
    docs = vectors(spark, folder)
    found = assign.nearest_topic(docs.select("vec_id", "embedding"), assign.topic_centroids(docs), "vec_id")
    return found.select("vec_id", "topic", shown(F.col("score")).alias("score"))


def topic_sizes(spark, folder):
    return represent.topic_sizes(doc_topic_affinity(spark, folder))


def topic_count(spark, folder):
    return represent.topic_count(quality_docs(spark, folder).select("topic"))


def language_word_scores(docs: DataFrame) -> DataFrame:
    return assign.word_scores(em.learned_words(docs, 2, length="length"), assign.topic_centroids(docs))


def topic_words_cosine(spark, folder):
    top = represent.top_terms(language_word_scores(stored_docs(spark, folder)), 50)
    return top.withColumn("score", shown(F.col("score")))


def doc_topic_report(spark, folder):
    """Texts never move: they are cleaned again where they are read, and meet only the topics."""
    docs = stored_docs(spark, folder)
    top = represent.top_terms(language_word_scores(docs), 50)
    found = assign.nearest_topic(language_docs(spark, folder).drop("topic"), assign.topic_centroids(docs))
    out = represent.with_keywords(found, top, 50)
    return out.select("doc_id", "text", "topic", shown(F.col("score")).alias("score"), F.col("keywords").alias("words"))


def _vector_shares(spark, folder):
    docs = vectors(spark, folder)
    return assign.topic_shares(docs.select("vec_id", "embedding"), assign.topic_centroids(docs), TEMPERATURE)


def doc_topic_softmax(spark, folder):
    docs, ids = _vector_shares(spark, folder)
    return assign.long_weights(docs, ids, "vec_id").withColumn("weight", shown(F.col("weight")))


def topic_confidence(spark, folder):
    docs, ids = _vector_shares(spark, folder)
    best = docs.select("vec_id", assign.best_share(ids, F.col("shares")).alias("b"))
    return best.select("vec_id", "b.topic", shown(F.col("b.confidence")).alias("confidence"))


def dominant_topic(spark, folder):
    docs, ids = _vector_shares(spark, folder)
    return represent.dominant_share(docs, ids, "vec_id").withColumn("weight", shown(F.col("weight")))


def doc_topic_wide(spark, folder):
    docs, ids = _vector_shares(spark, folder)
    rounded = docs.withColumn("shares", F.transform("shares", lambda w: shown(w)))
    return represent.wide_shares(rounded, len(ids), "vec_id")


def _nearest_words(docs: DataFrame) -> DataFrame:
    words = materialise(em.learned_words(docs, length="length"), "words")
    shares = transport.word_shares(words, assign.topic_centroids(docs), WORD_TEMPERATURE)
    return represent.keywords(represent.top_terms(shares, 15, "weight"), 15, " ")


def ot_topic_words(spark, folder):
    """The words nearest to each language's mean vector, by softmax over all words."""
    return _nearest_words(stored_docs(spark, folder))


def doc_confidence_report(spark, folder):
    docs = stored_docs(spark, folder)
    shared, ids = assign.topic_shares(docs.drop("topic"), assign.topic_centroids(docs), TEMPERATURE)
    best = shared.select("doc_id", F.array_join("tokens", " ").alias("text"), assign.best_share(ids, F.col("shares")).alias("b"))
    found = best.select(
        "doc_id",
        "text",
        F.coalesce("b.topic", F.lit(-1)).alias("topic"),
        shown(F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"),
    )
    return small_lookup(found, _nearest_words(docs), ["topic"], "doc_id", "words").withColumnRenamed("keywords", "topic_words")


# Evaluation, search, distribution


def coherence_umass(spark, folder):
    counted = stored_terms(spark, folder)
    scores = evaluate.coherence_umass(counted, language_words(counted))
    return scores.withColumn("coherence", shown(F.col("coherence")))


def coherence_npmi(spark, folder):
    counted = stored_terms(spark, folder)
    n_docs = documents(spark, folder).agg(F.count("*")).scalar()
    scores = evaluate.coherence_npmi(counted, language_words(counted), n_docs)
    return scores.withColumn("coherence", shown(F.col("coherence")))


def topic_diversity(spark, folder):
    return evaluate.topic_diversity(language_words(terms(spark, folder, "lang"))).withColumn("diversity", shown(F.col("diversity")))


def _labelled(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source")
    return docs.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")


def topic_contingency(spark, folder):
    return evaluate.contingency(_labelled(spark, folder), "lang", "quality")


def topic_agreement(spark, folder):
    out = evaluate.agreement(_labelled(spark, folder), "lang", "quality")
    return out.select("n", shown(F.col("purity")).alias("purity"), shown(F.col("nmi")).alias("nmi"))


def topic_search(spark, folder):
    counted = stored_terms(spark, folder)
    query = language_words(counted).filter((F.col("topic") == SEARCH_TOPIC) & (F.col("rank") <= 5))
    n_docs = documents(spark, folder).agg(F.count("*")).scalar()
    found = evaluate.search(counted, query, n_docs, 20)
    return found.withColumn("score", shown(F.col("score")))


def topic_search_by_topic(spark, folder):
    docs = vectors(spark, folder)
    found = assign.nearest_topic(docs.select("vec_id", "embedding"), assign.topic_centroids(docs), "vec_id")
    return evaluate.best_documents(found, 3, 20, "vec_id").withColumn("score", shown(F.col("score")))


def topic_trend(spark, folder):
    docs = stored_docs(spark, folder)
    found = assign.nearest_topic(docs.drop("topic"), assign.topic_centroids(docs)).select("source", "topic")
    return evaluate.topic_trend(found, "source").withColumn("share", shown(F.col("share")))


# Fitted models


def _model_docs(spark, folder):
    return materialise(cleaned(spark, folder).select("doc_id", "tokens"), "tokens")


def _lda_docs(spark, folder):
    """Not stored: a fit reads each document once, and those held out are others than those fitted."""
    return cleaned(spark, folder).select("doc_id", "tokens")


def lda_fit(spark, folder):
    return lda.fit_lda(_lda_docs(spark, folder)).doc_topic


def lda_topics(spark, folder):
    model = models.lda_topics(_lda_docs(spark, folder))
    return model.keywords(5)


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, by a hash of their id."""
    digest = F.md5(F.col(doc_id).cast("string"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 5 == 0


def lda_perplexity(spark, folder):
    """Of documents that took no part in the fit."""
    docs = _lda_docs(spark, folder)
    return lda.perplexity(lda.fit_lda(docs.filter(~held_out())), docs.filter(held_out()))


ROUNDS = 2  # as many as the SQL unrolls


def lda_round(spark, folder):
    """Two rounds from the hashed start: the documents' shares."""
    doc_topic = lda.fit_lda(_lda_docs(spark, folder), iterations=ROUNDS, inner=1).doc_topic
    return doc_topic.withColumn("weight", shown(F.col("weight")))


def lda_round_words(spark, folder):
    """Two rounds from the hashed start: the words of each topic."""
    topic_term = lda.fit_lda(_lda_docs(spark, folder), iterations=ROUNDS, inner=1).topic_term
    return represent.top_terms(topic_term, 20, "weight").withColumn("weight", shown(F.col("weight")))


def lda_completion(spark, folder):
    """Two rounds on four fifths of the documents, half of the words of the others completed."""
    docs = _lda_docs(spark, folder)
    fitted = lda.fit_lda(docs.filter(~held_out()), iterations=ROUNDS, inner=1)
    scored = lda.completion(fitted, docs.filter(held_out()), steps=ROUNDS)
    return scored.withColumn("log_likelihood", shown(F.col("log_likelihood")))


def word2vec_embedding(spark, folder):
    docs, _ = em.word2vec(_model_docs(spark, folder))
    return docs.select("doc_id", "embedding")


def embedding_pca(spark, folder):
    docs = vectors(spark, folder)
    return em.reduced(docs, 5).select("vec_id", "reduced")


def _reduced_docs(spark, folder):
    return em.reduced(models.stored_vectors(cleaned(spark, folder)))


def density_cluster(spark, folder):
    return density.density_clusters(_reduced_docs(spark, folder))


PROJECTION_BITS = (1, 2, 4, 8, 16)  # rows of a 64 x 64 Hadamard matrix
LINK_SIDE = 0.25


def density_cluster_exact(spark, folder):
    """Groups at one scale, on a projection that SQL can repeat: five orthogonal sign sums."""
    docs = language_docs(spark, folder).select("doc_id", "embedding")

    def coordinate(bit: int) -> Column:
        signed = F.transform("embedding", lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) == 0, x).otherwise(-x))
        return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x) / 8.0

    points = docs.select(
        "doc_id", F.when(F.col("embedding").isNotNull(), F.array(*[coordinate(b) for b in PROJECTION_BITS])).alias("reduced")
    )
    return density.linked_groups(points, LINK_SIDE)


def top2vec_fit(spark, folder):
    model = models.joint_embedding_topics(_model_docs(spark, folder))
    return model.assigned


def bertopic_fit(spark, folder):
    return models.clustered_topics(_model_docs(spark, folder)).listing()


def bertopic_assign(spark, folder):
    return models.clustered_topics(_model_docs(spark, folder)).assigned


def ot_topics_fit(spark, folder):
    return models.transport_topics(_model_docs(spark, folder)).doc_topic


QUERIES: dict[str, Query] = {
    "corpus_scan": corpus_scan,
    "corpus_folder": corpus_folder,
    "corpus_profile": corpus_profile,
    "word_counts": word_counts,
    "clean_html": clean_html,
    "clean_markdown": clean_markdown,
    "clean_markdown_urls_first": clean_markdown_urls_first,
    "clean_latex": clean_latex,
    "letters_only": letters_only,
    "tokens": tokens,
    "lemma_lookup": lemma_lookup,
    "lemma_guess": lemma_guess,
    "lemma_rule_use": lemma_rule_use,
    "stopword_filter": stopword_filter,
    "clean_text": clean_text,
    "clean_text_surface": clean_text_surface,
    "clean_pages": clean_pages,
    "stopword_union": stopword_union,
    "stopword_sample": stopword_sample,
    "vocabulary": vocabulary_all,
    "vocabulary_capped": vocabulary_capped,
    "doc_term_counts": doc_term_counts,
    "conversation_terms": conversation_terms,
    "ctfidf_topic_words": ctfidf_topic_words,
    "topic_keywords": topic_keywords,
    "topic_chart_data": topic_chart_data,
    "wordcloud_weights": wordcloud_weights,
    "topic_words_n": topic_words_n,
    "topic_listing": topic_listing,
    "topic_info": topic_info,
    "doc_keywords": doc_keywords,
    "doc_embedding": doc_embedding,
    "topic_centroids": topic_centroids,
    "doc_topic_affinity": doc_topic_affinity,
    "topic_sizes": topic_sizes,
    "topic_count": topic_count,
    "topic_words_cosine": topic_words_cosine,
    "doc_topic_report": doc_topic_report,
    "doc_topic_softmax": doc_topic_softmax,
    "topic_confidence": topic_confidence,
    "dominant_topic": dominant_topic,
    "doc_topic_wide": doc_topic_wide,
    "ot_topic_words": ot_topic_words,
    "doc_confidence_report": doc_confidence_report,
    "coherence_umass": coherence_umass,
    "coherence_npmi": coherence_npmi,
    "topic_diversity": topic_diversity,
    "topic_contingency": topic_contingency,
    "topic_agreement": topic_agreement,
    "topic_search": topic_search,
    "topic_search_by_topic": topic_search_by_topic,
    "topic_trend": topic_trend,
    "density_cluster_exact": density_cluster_exact,
    "lda_fit": lda_fit,
    "lda_topics": lda_topics,
    "lda_perplexity": lda_perplexity,
    "lda_round": lda_round,
    "lda_round_words": lda_round_words,
    "lda_completion": lda_completion,
    "word2vec_embedding": word2vec_embedding,
    "embedding_pca": embedding_pca,
    "density_cluster": density_cluster,
    "top2vec_fit": top2vec_fit,
    "bertopic_fit": bertopic_fit,
    "bertopic_assign": bertopic_assign,
    "ot_topics_fit": ot_topics_fit,
}
