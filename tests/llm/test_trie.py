"""The conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from gaugeline.llm import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    convs = {c: [x for _, x in sorted(t, key=lambda y: y[0])] for c, t in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in kids)
            saved[node[:d]] = saved.get(node[:d], 0) + ((len(who) - 1) * len(node[-1][1]) if node else 0)
    return sorted(((
        min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, who in members.items()), key=str)


def got(df):
    return sorted(map(tuple, op13_prefix_trie.trie(df).collect()), key=str)


def random_rows(seed, convs=260, longest=12):
    rng = random.Random(seed)
    openings = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "été 日本", "x" * 50])) for _ in range(longest)] for _ in range(6)]
    rows = []
    for c in rng.sample(range(50, 700), convs):
        turns = list(rng.choice(openings))[:rng.randint(1, longest)]
        if rng.random() < 0.4:
            turns[rng.randrange(len(turns))] = ("user", f"own {rng.randrange(3)}")
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, x string").repartition(3)
    assert got(df) == plain(rows)


def test_sql_agrees(spark):
    rows = random_rows(3)
    conversations = spark.createDataFrame(rows, SCHEMA).toArrow()  # noqa: F841  read by name
    found = duckdb.sql("select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from (" + op13_prefix_trie.SQL + ")").fetchall()
    assert sorted(found, key=str) == plain(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(op13_prefix_trie, "CHUNK", 7)
    rows = [(150, t, "user", f"turn {t % 5}") for t in range(200)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 330) for t in range(4)]
    rows += [(151, t, "user", f"turn {t % 5}") for t in range(90)] + [(100, 0, "user", "turn 0")]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 0, "user", "tie"), (7, 0, "assistant", "tie"),
        (7, -3, "user", "b"), (100, 5, "", ""), (101, 0, "user", "x" * 100_000), (102, 0, "user", "x" * 100_000), (102, 1, "us", "ery"), (103, 1, "user", "y"),
        (250, 0, "user", "short"), (251, 0, "user", "a"), (0, 0, "user", "zero"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows)
    assert got(df.where("false")) == []
    assert got(df.where("conv_id is null")) == []
    for c in (101, 250, 251, 300):  # of a conversation shorter than its head nothing may be left
        assert got(spark.createDataFrame([(c, 0, "user", "a")], SCHEMA)) == plain([(c, 0, "user", "a")])
