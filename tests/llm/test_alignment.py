"""Alignment of whole documents against a token by token version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from themeloom.llm import alignment as al
from themeloom.llm import tokens

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, n_links string, content int"
TEXTS = [
    "hello world", "hello world again", "hello world", "", None, "  two  spaces ", "x<|endoftext|>y z", "日本語のテキスト です",
    "tab\tand\nnew\n\nline \n x", "▁no way back", " nbsp　x", "é̀ é", "\x00nul a", "😀😃 emoji😀", "don't we'll I'M",
    "a\r\nb c\x0b d", "-" * 3001 + "=" * 777, "ا ب پ", "a" * 5000, "word " * 3000 + "end", " ", "\n",
]


@pytest.fixture(scope="module")
def sides():
    with open(PATHS[1], "rb") as file:
        return al.ByteLevel(tokens.read_file(PATHS[0])), al.Pieces(file.read())


def ends(side, ids):
    return np.cumsum([len(side.entries[i]) for i in ids]).tolist()


def one_text(a, b, text):
    """(n_a, n_b, groups, Counter of linked id pairs), or None without tokens."""
    if not text:
        return None
    ids_a, ids_b = a.encode([text])[0], b.encode([text])[0]
    raw = (" " + text).encode()
    if a.text_of(ids_a) != raw or b.text_of(ids_b) != raw:
        return None
    at_a, at_b = ends(a, ids_a), ends(b, ids_b)
    groups, links = [], Counter()
    for begin, end in zip([0, *sorted(set(at_a) & set(at_b))], sorted(set(at_a) & set(at_b))):
        one = [i for i, e in zip(ids_a, at_a) if begin < e <= end]
        two = [i for i, e in zip(ids_b, at_b) if begin < e <= end]
        groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
        links.update((x, y) for x in one for y in two)
    return len(ids_a), len(ids_b), groups, links


def brute(a, b, rows):
    found = [(doc_id, one_text(a, b, text)) for doc_id, text, *_ in rows]
    counts = Counter(pair for _, got in found if got for pair in got[3])
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, got in found:
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = got
        best = sum(n for (x, y), n in links.items() if counts[x, y] == most[x])
        total = sum(n * counts[pair] for pair, n in links.items())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, total, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy, large, held", [(al.HEAVY, al.LARGE_GROUP, al.HELD), (20, 2, 100), (0, 1, 50)])
def test_equals_brute_force(spark, sides, monkeypatch, heavy, large, held):
    monkeypatch.setattr(al, "HEAVY", heavy)
    monkeypatch.setattr(al, "HELD", held)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "hello world", "x", 1), (3, "hello you", "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, al.cross_alignment(frame, *PATHS).collect()), key=str) == brute(*sides, rows)


def test_large_groups_count_alike(sides, monkeypatch):
    texts = [t for t in TEXTS if t]
    aligner = al.Aligner(tokens.read_file(PATHS[0]), open(PATHS[1], "rb").read())
    plain = aligner.align(texts)
    monkeypatch.setattr(al, "LARGE_GROUP", 1)
    assert aligner.align(texts) == plain


def test_empty_table(spark):
    assert al.cross_alignment(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
    assert [r["n_a"] for r in al.cross_alignment(spark.createDataFrame([(1, None, "x", 1)], SCHEMA), *PATHS).collect()] == [0]


def test_query_on_whole_table(spark, sides, folder):
    ours = al.op13_alignment(spark, folder)
    assert ours.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, ours.collect()), key=str) == brute(*sides, rows)
