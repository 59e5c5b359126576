"""The report tables of the four families under their customary column names.

Topics are numbered from 1 in the LDA tables only. Words come as one string or as a list, as
each table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import represent
from themeloom.operators.joins import small_lookup
from themeloom.plans.models import TopicModel

# The column names and word counts of the tables.
LDA_TOPIC = ("Tema", "Palabras Clave")
LDA_WEIGHT = "Tema "
LDA_DOCUMENT = "Documento"
JOINT_DOCUMENT = ("documento_id", "contenido_raw", "topico_asignado", "score_afinidad", "palabras")
CLUSTERED_DOCUMENT = ("documento_id", "contenido_raw", "topico_numero", "palabras_clave")
TRANSPORT_DOCUMENT = ("documento", "texto", "tema", "confianza", "palabras_tema")
LDA_WORDS = 5
JOINT_WORDS = 50
CLUSTERED_WORDS = 5
TRANSPORT_WORDS = 15


def lda_topic_table(model: TopicModel) -> DataFrame:
    """Topic number and its first words."""
    words = model.keywords(LDA_WORDS)
    return words.select((F.col("topic") + 1).alias("topic"), "keywords").toDF(*LDA_TOPIC)


def lda_document_table(model: TopicModel, docs: DataFrame, k: int, name: str = "name") -> DataFrame:
    """One weight column per topic, the document's name and its dominant topic."""
    wide = represent.wide_weights(model.doc_topic, k, label=LDA_WEIGHT)
    named = wide.join(docs.select("doc_id", F.col(name).alias(LDA_DOCUMENT)), "doc_id")
    weights = [f"{LDA_WEIGHT}{i + 1}" for i in range(k)]
    return named.select("doc_id", *weights, LDA_DOCUMENT, f"{LDA_WEIGHT}dominante")


def joint_document_table(model: TopicModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw text, nearest topic, cosine to it and the list of its words."""
    lists = represent.keyword_lists(model.top, JOINT_WORDS)
    found = _with_text(docs, text, small_lookup(model.assigned, lists, ["topic"], "doc_id", "keywords"))
    return found.select("doc_id", "text", "topic", "score", "terms").toDF(*JOINT_DOCUMENT)


def clustered_document_table(model: TopicModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw text, group and its first words; outliers have words too."""
    found = _with_text(docs, text, represent.with_keywords(model.assigned, model.top, CLUSTERED_WORDS))
    return found.select("doc_id", "text", "topic", "keywords").toDF(*CLUSTERED_DOCUMENT)


def transport_document_table(model: TopicModel, docs: DataFrame, text: str = "clean_text") -> DataFrame:
    """Clean text, heaviest topic, its weight and the topic's words."""
    found = _with_text(docs, text, represent.with_keywords(model.assigned, model.top, TRANSPORT_WORDS, " "))
    return found.select("doc_id", "text", "topic", "score", "keywords").toDF(*TRANSPORT_DOCUMENT)


def _with_text(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """The text joins last, on its unique key, so that it moves at most once."""
    return docs.select("doc_id", F.col(text).alias("text")).join(found, "doc_id")
