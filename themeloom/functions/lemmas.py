"""A small table of irregular forms; bring a larger ``(lang, form, lemma)`` table for real use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lemma, then its forms.
LEMMAS = {
    "en": {
        "be": "am is are was were been being",
        "have": "has had having",
        "do": "does did done doing",
        "go": "goes went gone going",
        "this": "these",
        "that": "those",
        "a": "an",
    },
    "es": {
        "el": "la los las lo",
        "uno": "un una unos unas",
        "ser": "es son era eran fue fueron sido siendo",
        "haber": "ha han hay hubo había",
        "tener": "tiene tienen tuvo tenido",
        "este": "esta estos estas esto",
        "su": "sus",
    },
    "fr": {
        "le": "la les",
        "un": "une des",
        "être": "est sont était étaient été",
        "avoir": "a ont avait eu",
        "ce": "cette ces cet",
        "son": "sa ses",
    },
    "de": {
        "der": "die das den dem des",
        "ein": "eine einen einem einer eines",
        "sein": "ist sind war waren gewesen",
        "haben": "hat hatte hatten gehabt",
        "werden": "wird wurde wurden geworden",
    },
}


# For each lemma's ending, stems of some words and the endings of their regular forms.
PARADIGMS = {
    "en": [
        ("", "walk talk play open jump", "s ed ing"),
        ("y", "tr carr stud", "ies ied ying"),
    ],
    "es": [
        ("ar", "habl trabaj cant compr llev mir", "o as a amos an é aste ó aron ando ado aba aban"),
        ("er", "com beb corr vend aprend", "o es e emos en í iste ió ieron iendo ido ía ían"),
        ("ir", "viv part sub escrib recib", "o es e imos en í iste ió ieron iendo ido ía ían"),
        ("ión", "nac canc reg estac", "iones"),
        ("dad", "ciu ver e", "dades"),
    ],
    "fr": [
        ("er", "parl aim donn chant march", "e es ons ez ent ais ait aient é ée és ées ant"),
        ("tion", "na ac por sta", "tions"),
        ("eau", "bat cad chât", "eaux"),
    ],
    "de": [
        ("en", "mach sag lern spiel", "e st t te ten test"),
        ("ung", "zeit wohn rechn", "ungen"),
        ("heit", "frei krank ein", "heiten"),
    ],
}


def paradigm_rows() -> list[tuple[str, str, str]]:
    """Regular forms, built from their stems and endings."""
    return [
        (lang, stem + ending, stem + own)
        for lang, table in PARADIGMS.items()
        for own, stems, endings in table
        for stem in stems.split()
        for ending in endings.split()
    ]


def lemma_rows() -> list[tuple[str, str, str]]:
    return [
        (lang, form, lemma)
        for lang, table in LEMMAS.items()
        for lemma, forms in table.items()
        for form in forms.split()
    ]


def lemma_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lemma_rows(), "lang string, form string, lemma string")


def inflected_table(spark: SparkSession) -> DataFrame:
    """The irregular forms and some regular ones, from which rules can be learned."""
    return spark.createDataFrame(lemma_rows() + paradigm_rows(), "lang string, form string, lemma string")
