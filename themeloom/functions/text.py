"""Cleaning steps as native column expressions: no Python runs per row.

All of them stay narrow, so a whole cleaning job is one projection over the scan (and works
unchanged on a streaming DataFrame).
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions import patterns as p


def _drop(text: Column, *found: str) -> Column:
    for pattern in found:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(" "))
    return text


def sql_text(value: str) -> str:
    """A SQL string literal; long lists reach the plan faster as one text than value by value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_space(text: Column) -> Column:
    """Trim every kind of white space; Spark's own ``trim`` knows the blank only."""
    text = F.regexp_replace(text, F.lit(p.LEADING_SPACE), F.lit(""))
    return F.regexp_replace(text, F.lit(p.TRAILING_SPACE), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(p.WORD))


def entity_names() -> dict[str, str]:
    """The named HTML 4 entities, as the standard library lists them."""
    return {name: chr(code) for name, code in sorted(html.entities.name2codepoint.items())}


def decode_entities(text: Column) -> Column:
    """Decode ``&name;``, ``&#233;`` and ``&#xE9;`` once; anything else stays as written."""
    names = F.expr("map(" + ", ".join(sql_text(x) for pair in entity_names().items() for x in pair) + ")")

    def from_code(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(name: Column) -> Column:
        return (
            F.when(
                name.rlike("^#[xX]"),
                from_code(F.conv(F.substring(name, 3, 6), 16, 10).cast("bigint")),
            )
            .when(name.startswith("#"), from_code(F.substring(name, 2, 7).cast("bigint")))
            .otherwise(F.try_element_at(names, name))
        )

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, p.HTML_ENTITY, 1)
        replaced = F.when(name != "", F.concat(decoded(name), F.substr(part, F.length(name) + 2)))
        return F.when(i == 0, part).otherwise(F.coalesce(replaced, F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def strip_html(text: Column) -> Column:
    """The text between the tags; scripts, styles, templates and comments are no text."""
    return decode_entities(_drop(text, p.HTML_MARKUP_JAVA))


def strip_markdown(text: Column, urls_first: bool = False) -> Column:
    """Drop code fences, marks, addresses and image links, in that order.

    Marks go before addresses, so an address holding ``_`` or ``-`` leaves its tail behind;
    ``urls_first`` takes the addresses out whole.
    """
    steps = [p.CODE_FENCE, p.MARKS, p.URL]
    if urls_first:
        steps = [p.CODE_FENCE, p.URL, p.MARKS]
    text = _drop(text, *steps)
    # Only a line feed ends a line here, which the Java engine has to be told.
    return _drop(text, "(?d)" + p.IMAGE_LINK)


def letters_only(text: Column) -> Column:
    return _drop(text, p.NOT_LETTER_OR_SPACE)


def strip_latex(text: Column) -> Column:
    """Prose of a LaTeX source: no preamble, comments, mathematics, floats or commands."""
    text = F.regexp_replace(text, F.lit("(?d)" + p.LATEX_COMMENT), F.lit("$1"))
    text = _drop(
        text,
        p.LATEX_PREAMBLE,
        p.LATEX_AFTER_END,
        p.LATEX_FLOAT,
        p.LATEX_DISPLAY_MATH,
        p.LATEX_INLINE_MATH,
        p.LATEX_REFERENCE,
        p.LATEX_ENVIRONMENT,
    )
    for _ in range(p.LATEX_NESTING):
        text = F.regexp_replace(text, F.lit(p.LATEX_UNWRAP), F.lit("$2"))
    return _drop(text, "(?d)" + p.LATEX_COMMAND, p.LATEX_LEFTOVER)


def clean(text: Column, letters: bool = False, urls_first: bool = False) -> Column:
    """HTML, Markdown, then lower case; ``letters`` also drops digits and signs."""
    text = strip_markdown(strip_html(text), urls_first)
    if letters:
        text = letters_only(text)
    return F.lower(text)


def tokens(text: Column) -> Column:
    """Words made of letters only; ``sha256`` is dropped whole, not cut."""
    return F.regexp_extract_all(text, F.lit(p.LETTER_RUN), F.lit(0))


def without(tokens: str, stopwords: list[str], min_length: int = 1) -> Column:
    """Column ``tokens`` less the listed and the short words; one hash lookup per word."""
    listed = ", ".join(sql_text(w) for w in stopwords)
    not_listed = f"w NOT IN ({listed}) AND " if listed else ""
    return F.expr(f"filter({tokens}, w -> {not_listed}length(w) >= {min_length})")


def clean_tokens(text: Column) -> Column:
    return tokens(clean(text))
