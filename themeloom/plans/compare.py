"""Models side by side: quality of their topics, and agreement of their assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import evaluate
from themeloom.plans.models import TopicModel
from themeloom.session import materialise


def quality(models: dict[str, TopicModel], terms: DataFrame, n_words: int = 10, n_docs: int | None = None) -> DataFrame:
    """``(model, n_topics, umass, npmi, diversity)``, coherence as the mean over topics.

    ``terms`` has one row per document and term (``vocabulary.doc_terms``); store it first,
    since each model reads it. ``n_docs`` is the number of documents, those without a term
    included, which ``terms`` doesn't know; by default those with one. Outliers are no topic.
    """
    n_docs = terms.agg(F.countDistinct("doc_id")).scalar() if n_docs is None else F.lit(n_docs)
    rows = []
    for name, model in models.items():
        top = materialise(model.top.filter((F.col("rank") <= n_words) & (F.col("topic") >= 0)), "top")
        umass = evaluate.coherence_umass(terms, top).withColumnRenamed("coherence", "umass")
        npmi = evaluate.coherence_npmi(terms, top, n_docs).withColumnRenamed("coherence", "npmi")
        means = umass.join(npmi, "topic").agg(
            F.count("*").alias("n_topics"), F.avg("umass").alias("umass"), F.avg("npmi").alias("npmi")
        )
        diversity = evaluate.topic_diversity(top).select("diversity").scalar()
        rows.append(means.select(F.lit(name).alias("model"), "*", diversity.alias("diversity")))
    return reduce(DataFrame.unionByName, rows)


def agreement(a: TopicModel, b: TopicModel) -> DataFrame:
    """``(n, purity, nmi)`` of the topics two models give to the same documents."""
    left = a.assigned.select("doc_id", F.col("topic").alias("a"))
    both = left.join(b.assigned.select("doc_id", F.col("topic").alias("b")), "doc_id")
    return evaluate.agreement(materialise(both, "labels"), "a", "b")
