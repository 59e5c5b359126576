"""The trie against a dictionary of prefixes, in one block and in several, in one shard and in many."""

import hashlib
import random
import zlib

import duckdb
import pytest

from themeloom.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, text_2 string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, pt_id(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: heads[c]] + turns[heads[c] :] for c, turns in own.items()}


def pt_id(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below if p)
        leaves = sum(max(len(convs[c]) for c in m) == len(p) for p, m in below)
        children = sum(len(p) == len(path) + 1 for p, _ in below)
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(members), len(path), parent, len(members), children, leaves, saved, digest))
    return out


def result(spark, trie):
    found = trie.nodes.join(pt.ends_digests(trie.ends), ["conv_id", "depth"], "left").fillna(
        hashlib.sha256(b"").hexdigest(), ["ends_sha256"]
    )
    rows = found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None, "long text " * 9]), "x"))
    rows += [(400 + c, 0, "user", "hi", "x") for c in range(40)]
    rows += [(500, None, "user", "first", "x"), (500, 3, "user", "last", "x"), (500, 3, "user", "last", "x")]
    rows += [(None, 0, "user", "nobody", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, shard", [(32, 8192), (3, 7), (2, 5)])
def test_rebuilt_conversations(spark, monkeypatch, width, shard):
    monkeypatch.setattr(pt, "WIDTH", width)
    monkeypatch.setattr(pt, "ROWS_PER_SHARD", shard)
    monkeypatch.setattr(pt, "IDS_PER_BLOCK", 3)
    monkeypatch.setattr(pt, "ENDS_PER_TASK", 20)
    rows = corpus(width)
    turns, everyone = pt.sharing_heads(pt.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert result(spark, pt.prefix_trie(turns, everyone)) == brute(rebuilt(rows))


def test_long_copies_and_turnless(spark, monkeypatch):
    monkeypatch.setattr(pt, "WIDTH", 4)
    monkeypatch.setattr(pt, "ROWS_PER_SHARD", 3)
    convs = {c: [("u", f"t{i}") for i in range(23)] for c in range(11)}
    convs |= {c: [("u", f"t{i}") for i in range(23)][: c % 19] + [("v", "own")] * (c % 7) for c in range(20, 50)}
    convs |= {60: [], 61: [], 70: [("w", str(i)) for i in range(40)]}
    rows = [(c, i, pt_id(*t), len(t[1].encode())) for c, turns in convs.items() for i, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id bigint, at bigint, id binary, size bigint")
    trie = pt.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id bigint"))
    assert result(spark, trie) == brute(convs)


def test_empty(spark):
    turns, everyone = pt.sharing_heads(pt.numbered_turns(spark.createDataFrame([(None, 1, "a", "b", "c")], SCHEMA)))
    trie = pt.prefix_trie(turns, everyone)
    assert trie.nodes.count() == 0 and pt.ends_digests(trie.ends).count() == 0


def test_query_equals_sql(spark, folder):
    ours = pt.op11_prefix_trie(spark, folder)
    assert ours.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    theirs = database.sql(pt.OP11_SQL)
    assert theirs.columns == ours.columns
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs.fetchall(), key=str)
