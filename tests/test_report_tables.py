"""The named report tables, from a small model given as tables."""

import pytest

from themeloom.plans import compare, reports
from themeloom.plans.models import TopicModel


@pytest.fixture(scope="module")
def model(spark):
    top = [(t, r, f"w{t}{r}", 1.0 / r) for t in (-1, 0, 1) for r in range(1, 61)]
    weights = [(1, 0, 0.25), (1, 1, 0.75), (2, 0, 0.5), (2, 1, 0.5)]
    return TopicModel(
        assigned=spark.createDataFrame([(1, 1, 0.75), (2, 0, 0.5), (3, -1, 0.0)], "doc_id bigint, topic int, score double"),
        top=spark.createDataFrame(top, "topic int, rank int, term string, score double"),
        doc_topic=spark.createDataFrame(weights, "doc_id bigint, topic int, weight double"),
    )


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"d{i}.md", f"Texto {i}", f"texto {i}") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id bigint, name string, text string, clean_text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lda_topics(model):
    table = reports.lda_topic_table(model)
    assert table.columns == ["Tema", "Palabras Clave"]
    assert rows(table)[1] == (1, "w01, w02, w03, w04, w05")


def test_lda_documents(model, docs):
    table = reports.lda_document_table(model, docs, 2)
    assert table.columns == ["doc_id", "Tema 1", "Tema 2", "Documento", "Tema dominante"]
    assert rows(table) == [(1, 0.25, 0.75, "d1.md", "Tema 2"), (2, 0.5, 0.5, "d2.md", "Tema 1")]


def test_joint_documents(model, docs):
    table = reports.joint_document_table(model, docs)
    assert table.columns == ["documento_id", "contenido_raw", "topico_asignado", "score_afinidad", "palabras"]
    first = table.filter("documento_id = 1").head()
    assert tuple(first)[:4] == (1, "Texto 1", 1, 0.75)
    assert first["palabras"] == [f"w1{r}" for r in range(1, 51)]


def test_clustered_documents(model, docs):
    table = reports.clustered_document_table(model, docs)
    assert table.columns == ["documento_id", "contenido_raw", "topico_numero", "palabras_clave"]
    assert rows(table)[2] == (3, "Texto 3", -1, "w-11, w-12, w-13, w-14, w-15")


def test_transport_documents(model, docs):
    table = reports.transport_document_table(model, docs)
    assert table.columns == ["documento", "texto", "tema", "confianza", "palabras_tema"]
    assert rows(table)[1] == (2, "texto 2", 0, 0.5, " ".join(f"w0{r}" for r in range(1, 16)))


def test_models_side_by_side(spark, model):
    terms = spark.createDataFrame(
        [(d, f"w{t}{r}", 1) for d, t in ((1, 1), (2, 0), (3, 0)) for r in (1, 2)], "doc_id bigint, term string, n bigint"
    )
    other = TopicModel(model.assigned, model.top.filter("topic <> 1"))
    table = {r["model"]: r for r in compare.quality({"a": model, "b": other}, terms, 2).collect()}
    assert (table["a"]["n_topics"], table["b"]["n_topics"]) == (2, 1)
    assert table["a"]["npmi"] == pytest.approx(1.0) and table["a"]["diversity"] == 1.0
    assert rows(compare.agreement(model, other)) == [(3, 1.0, pytest.approx(1.0))]
