"""SimHash fingerprints and their groups against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from gaugeline.llm import op11_simhash


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, bits=2):
    """Component (a set of prints) of every print, over all pairs."""
    prints, of = sorted(set(prints)), {}
    for p in prints:
        joined = {p}.union(*[of[q] for q in of if (p ^ q).bit_count() <= bits])
        for q in joined:
            of[q] = joined
    return of


def expected(rows):
    prints = [(i, simhash(t)) for i, t in rows]
    of = components([p for _, p in prints])
    least = {p: min((i for i, q in prints if q in c and i is not None), default=None) for p, c in of.items()}
    return sorted(((i, f"{p:016x}", least[p]) for i, p in prints), key=str)


def got(df):
    return sorted((tuple(r) for r in op11_simhash.groups(df).collect()), key=str)


def test_texts_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)] + ["Été", "日本", "A"]
    rows, i = [], 0
    for _ in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy = list(text)
            if rng.random() < 0.6 and len(copy) > 3:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((i, rng.choice([" ", "\n", "\t  "]).join(copy)))
            i += 1
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, key int")
    want = expected(rows)
    assert got(df) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == expected(rows)
    assert got(nothing) == []
    alone = spark.createDataFrame([(None, "one two three four"), (None, "one two three four")], "doc_id long, text string")
    assert [r[2] for r in got(alone)] == [None, None]


def test_slices_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "Beta", "g", "ß"]) + str(rng.randrange(50)) for _ in range(3000))
    want = simhash(text)
    monkeypatch.setattr(op11_simhash, "SLICE", 64)
    assert op11_simhash.fingerprint(text) == want
    assert op11_simhash.fingerprint("a b") == simhash("a b") and op11_simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("crowd", [2, 32])
def test_links_of_near_fingerprints(spark, monkeypatch, crowd):
    """Chains and crowds of near fingerprints, through both ways of comparing."""
    monkeypatch.setattr(op11_simhash, "CROWD", crowd)
    rng = random.Random(3)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 20])):
            prints.add(p)
            for _ in range(rng.choice([0, 1, 2, 2, 2, 3, 5])):
                p ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    table = op11_simhash.PivotTable()
    edges = op11_simhash.links(spark.createDataFrame(signed, "fp long"), table).collect()
    found = {p: p for p in prints}

    def top(p):
        while found[p] != p:
            p = found[p]
        return p

    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        found[top(a)] = top(b)
    parts = {}
    for p in prints:
        parts.setdefault(top(p), set()).add(p)
    want = {frozenset(c) for c in components(prints).values()}
    assert {frozenset(c) for c in parts.values()} == want
    assert len(edges) < 40 * len(prints)


def test_pivots_keep_every_near_pair():
    table = op11_simhash.PivotTable()
    rng = random.Random(4)
    for _ in range(300):
        p = rng.getrandbits(64)
        q = p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        rows = table.rows(np.array([p, q], np.uint64))
        keys = table.keys(rows)
        assert (keys[0] == keys[1]).any() and (np.abs(rows[0].astype(int) - rows[1]) <= 2).all()
    with pytest.raises(ValueError):
        op11_simhash.PivotTable(bits=3)
