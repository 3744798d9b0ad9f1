"""License scan, quality, lines, near duplicates and decontamination against plain versions."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import op1_decontaminate, op2_license_scan, op3_jaccard, op8_quality, op9_line_dedup
from gaugeline.llm.words import ALNUM, batch_hashes

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# Licenses

def test_base_places():
    text = "Under the MIT License; under the mit license. CC-BY-NC! Apache License, Version 2.0"
    n, base, first, last, base_labels, labels, score, found = op2_license_scan.scan_text(text)
    assert (n, base, first, last, base_labels, score) == (16, 4, 0, 11, "apache-2,cc-by-nc,mit", 1.0)
    assert set(labels.split(",")) >= {"apache-2", "cc-by-nc", "mit"}


def test_longer_detections_suppress_what_they_hold():
    labels = lambda t: op2_license_scan.scan_text(t)[5]
    assert labels("licensed under the gnu lesser general public license version 2.1") == "lgpl-2.1"
    assert labels("SPDX-License-Identifier: BSD-3-Clause license") == "bsd-3-clause"
    assert labels("mit der Zeit, apache tribe, and the public") == ""


@pytest.mark.parametrize("text, labels", [
    ("Released as MIT No Attribution.", "mit-0"), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd-2-clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that: Neither the name of the X "
     "nor the names of its contributors may be used to endorse products", "bsd-3-clause"),
    ("the success of this", ""), ("nothing at all", ""),
])
def test_signatures(text, labels):
    assert op2_license_scan.scan_text(text)[5] == labels


def test_gate_drops_no_detection():
    """Every rule's keyword opens the gate, wherever a rule finds something."""
    for rule in op2_license_scan.rules():
        assert op2_license_scan.gate().search(b"x" + rule.keyword + b"y")


def test_base_columns_by_definition():
    rnd = random.Random(4)
    words = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "und\u00e9r", "MIT", "License"]
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for _ in range(400):
        text = rnd.choice([" ", "-", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places = [(i, k) for k, p in phrases.items() for i in range(len(found)) if found[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want = (len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places})))
        got = op2_license_scan.scan_text(text)
        assert got[:5] == want and set(filter(None, want[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


def test_scan_rows(odd, nothing):
    found = {r["doc_id"]: r for r in op2_license_scan.scan(odd).collect()}
    assert found[1]["n_words"] == 0 and found[1]["first_word"] is None and found[1]["labels"] == ""
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in odd.collect():
        assert found[r["doc_id"]]["n_words"] == len(words.findall((r["text"] or "").translate(LOWER)))
    assert op2_license_scan.scan(nothing).count() == 0


# Quality

def test_quality_on_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = op8_quality.quality(docs, labels).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    rows = op8_quality.quality(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r["keep"] and r["perplexity"] is None for r in rows if r["doc_id"] in (1, 2))
    assert op8_quality.quality(odd, labels.where("false")).where("keep").count() == odd.count()
    assert op8_quality.quality(nothing, labels).count() == 0


def test_scoring_keeps_the_questions_of_one_part_at_a_time(spark, monkeypatch):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} same end" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int")
    here, most, saved, discard = {}, [], op8_quality.common.saved, op8_quality.common.discard

    def seen(df, name):
        out = saved(df, name)
        if name == "questions":
            here[out.saved_at] = out.where("data is null").count()
            most.append(sum(here.values()))
        return out

    def gone(df):
        here.pop(df.saved_at, None)
        discard(df)

    monkeypatch.setattr(op8_quality.common, "saved", seen)
    monkeypatch.setattr(op8_quality.common, "discard", gone)
    assert op8_quality.quality(docs, labels).count() == 40
    assert sum(most) == 40 and max(most) < 30 and not here


def test_kept_rows_have_all_columns(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    out = op8_quality.kept(odd, labels)
    assert out.dtypes == odd.dtypes and 0 < out.count() <= odd.count()


def test_probabilities_sum_to_one(spark):
    import numpy as np

    counts = op8_quality.count_grams(spark.createDataFrame([("the cat sat on the mat",), ("the dog",)], "text string"))
    table = np.exp(op8_quality.probabilities(counts).astype(float)).reshape(-1, op8_quality.ALPHABET)
    assert np.allclose(table.sum(1), 1, atol=1e-4)


def test_the_table_of_characters_by_definition_in_little_memory(spark):
    import numpy as np

    rnd = random.Random(5)
    size = op8_quality.ALPHABET
    texts = [" ".join(rnd.choice(["the", "cat", "sat", "on", "mat", "Été", "42"]) for _ in range(12)) for _ in range(9)]
    counts = op8_quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"))
    tracemalloc.start()
    try:
        table = op8_quality.probabilities(counts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert table.dtype == np.float32 and table.nbytes == 4 * size ** op8_quality.ORDER and most < 2 * table.nbytes
    levels = [Counter(int(g) for t in texts for part in op8_quality.grams(t) for g in part)]
    for k in (3, 2, 1):
        levels.append(Counter(g % size ** k for g in levels[-1]))
    off = [[0, *op8_quality.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))] for c in levels]

    def p(gram, level):
        if level == len(levels):
            return 1 / size
        behind = [v for g, v in levels[level].items() if g // size == gram // size]
        lower = p(gram % size ** (3 - level), level + 1)
        if not behind:
            return lower
        n = levels[level][gram]
        return (n - off[level][min(n, 3)] + sum(off[level][min(v, 3)] for v in behind) * lower) / sum(behind)

    for gram in [*levels[0], *(rnd.randrange(len(table)) for _ in range(200))]:
        assert abs(table[gram] - np.log(p(gram, 0))) < 1e-5


def test_perplexity_of_words_by_definition(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(op8_quality, "VOCABULARY", 12)
    rnd = random.Random(8)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "far", "off", "by", "day", "zebra", "quagga", "b!!", "É"]
    texts = [" ".join(rnd.choice(words[:rnd.randint(2, 16)]) for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ["", " \n", "The CAT"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    by = {r[0]: r[1] for r in docs.select("doc_id", F.expr("pmod(xxhash64(text), 2)")).collect()}
    good = [i for i in range(0, 60, 2)]
    spelling = op8_quality.probabilities(op8_quality.count_grams(docs.join(labels, "doc_id", "left_semi")))
    split = lambda t: t.translate(LOWER).split()

    def logs(which):
        """log P(b | a) of the model by its formula."""
        own = [split(texts[i]) for i in good if by[i] != which]
        hashes = {w: int(batch_hashes([w], op8_quality.VISIBLE)[0].view(np.int64)[0]) for t in own for w in t}
        n = Counter(w for t in own for w in t)
        known = set(sorted(n, key=lambda w: (-n[w], hashes[w]))[:12])
        name = lambda w: w if w in known else "?"
        pairs = Counter(p for t in own if t for p in zip(["<", *map(name, t)], [*map(name, t), ">"]))
        follows = Counter(b for _, b in pairs)
        sizes = lambda c: op8_quality.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
        d1, d2 = sizes(follows), sizes(pairs)
        off = lambda c, d: d[min(c, 3) - 1] if c else 0
        total = sum(follows.values())

        def single(b):
            return (follows[b] - off(follows[b], d1)) / total + sum(off(v, d1) for v in follows.values()) / total / (len(known) + 2)

        def p(a, b):
            seen = {k: v for k, v in pairs.items() if k[0] == a}
            if not seen:
                return single(b)
            c = sum(seen.values())
            return (pairs[a, b] - off(pairs[a, b], d2)) / c + sum(off(v, d2) for v in seen.values()) / c * single(b)

        assert abs(sum(p("the", b) for b in [*known, "?", ">"]) - 1) < 1e-9
        return known, name, p

    models = [logs(0), logs(1)]
    for r in op8_quality.quality(docs, labels).collect():
        known, name, p = models[by[r["doc_id"]]]
        t = split(texts[r["doc_id"]])
        if not t:
            assert r["n_symbols"] == 0 and r["perplexity"] is None
            continue
        nll = -sum(np.log(p(a, b)) for a, b in zip(["<", *map(name, t)], [*map(name, t), ">"]))
        unknown = [w for w in texts[r["doc_id"]].split() if w.translate(LOWER) not in known]
        nll -= sum(float(spelling[g].sum(dtype=np.float64)) for g in op8_quality.grams(" ".join(unknown)))
        assert r["n_symbols"] == len(t) + 1
        assert abs(np.log(r["perplexity"]) * (len(t) + 1) - nll) < 1e-4 * max(1, nll)


# Lines

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed(rows):
    """By definition."""
    places = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" ")
            if len(line) >= op9_line_dedup.MIN_CHARS:
                places.append(((doc is not None, doc or 0, n), doc, n, line))
    places.sort()
    first = {}
    for p, _, _, line in places:
        first.setdefault(line, p)
    return {(d, n) for p, d, n, line in places if any(q < p and abs(len(x) - len(line)) < 2 and edits(x, line) < 2 for x, q in first.items())}


@pytest.mark.parametrize("small", [1, 2, 16])
def test_lines_against_definition(spark, monkeypatch, small):
    monkeypatch.setattr(op9_line_dedup, "SMALL", small)
    rnd, base = random.Random(small), ["the first long line of text", "a second line, rather longer than that", "dritte Zeile über Käse"]
    lines = []
    for _ in range(90):
        line = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            i = rnd.randrange(len(line))
            line[i:i + rnd.choice([0, 1])] = rnd.choice(["", "x", "é"])
        lines.append("".join(line))
    rows = [(i, "\n".join(rnd.sample(lines, 3) + ["short"])) for i in range(40)] + [(None, base[0]), (99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]) for r in op9_line_dedup.removed_lines(docs.fillna({"text": ""})).collect()}
    assert got == removed(rows)


def test_lines_rows(spark, odd, nothing):
    out = op9_line_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert op9_line_dedup.deduplicate(nothing).count() == 0
    docs = spark.createDataFrame([(1, "a line that repeats\nmore of the first", 3), (2, "a line that repeats", 4)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in op9_line_dedup.deduplicate(docs).collect()] == [(1, "a line that repeats\nmore of the first", 3)]


def test_lines_of_rows_with_the_same_id(spark):
    docs = spark.createDataFrame([
        (7, "first line of the row\na line that both rows have\nand one more of this row"), (7, "a line that both rows have\nthis line occurs in no other place"),
        (8, "a line that both rows have\nanother line of document 8"), (None, "a line that both rows have\nwithout a number"), (None, None),
    ], "doc_id long, text string")
    left = {r["text"] for r in op9_line_dedup.deduplicate(docs).collect()}
    # A row without doc_id comes before all others, so the line stays there alone.
    assert left == {
        "a line that both rows have\nwithout a number", "first line of the row\nand one more of this row", "this line occurs in no other place",
        "another line of document 8", None}
    counted = [(r["doc_id"], r["n_lines"], r["n_copies"], r["removed"]) for r in op9_line_dedup.line_counts(docs.fillna({"text": ""})).collect()]
    assert sorted(counted, key=str) == sorted([(7, 3, 1, "1"), (7, 2, 1, "0"), (8, 2, 1, "0"), (None, 2, 0, ""), (None, 1, 0, "")], key=str)
    lost = spark.createDataFrame([(None, "a line that repeats here\na line that repeats here")], "doc_id long, text string")
    assert [r["removed"] for r in op9_line_dedup.line_counts(lost).collect()] == ["1"]
    short = spark.createDataFrame([(1, "ab\nab"), (2, "ab")], "doc_id long, text string")
    assert [r["text"] for r in op9_line_dedup.deduplicate(short, min_chars=1).collect()] == ["ab"]


def test_lines_run_without_python(spark, odd):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        op9_line_dedup.deduplicate(odd).explain()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", out.getvalue())


# Near duplicates

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    met = defaultdict(list)
    for d in sorted(sets):
        both = Counter(e for s in sets[d] for e in met[s])
        for s in sets[d]:
            met[s].append(d)
        for e, n in both.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("crowd, frequent", [(48, 24), (3, 2), (5, 1000)])
def test_groups_against_all_pairs(spark, monkeypatch, crowd, frequent):
    monkeypatch.setattr(op3_jaccard, "CROWD", crowd)
    monkeypatch.setattr(op3_jaccard, "FREQUENT", frequent)
    rnd = random.Random(crowd)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 12, 60]))] for _ in range(8)]
    common_line = [rnd.choice(vocabulary) for _ in range(15)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "W1"), (1004, "w1")]
    for i in range(160):
        words = list(rnd.choice(base)) + (common_line if rnd.random() < 0.5 else [])
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, rnd.choice([" ", "\t", "\n "]).join(words)))
    rnd.shuffle(rows)  # copies with larger ids may come first
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3_jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_groups_odd_rows(odd, nothing):
    rows = op3_jaccard.groups(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] == r["doc_id"] for r in rows)
    assert op3_jaccard.groups(nothing).count() == 0
    assert op3_jaccard.deduplicate(odd).columns == odd.columns


def test_repeated_and_missing_ids(spark):
    words = [f"w{i}" for i in range(200)]
    text = lambda a, b, *more: " ".join([*words[a:b], *more])
    rows = [(1, text(0, 30)), (2, text(0, 30, "x", "y")), (2, text(100, 130)), (3, text(100, 130, "z")), (None, text(0, 30, "q")), (None, text(150, 180)), (7, text(150, 180))]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["class_id"], r["component_id"]) for r in op3_jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", 26, 1, 1), ("2", 28, 2, 1), ("2", 26, 2, 2), ("3", 27, 3, 2), ("None", 27, None, 1), ("None", 26, 7, 7), ("7", 26, 7, 7)])


def test_a_large_group_of_near_copies_stays_linear(spark, monkeypatch):
    """Copies with two edits each, of which many are not links: compared pairs grow with the group, not with its square."""
    compared = []
    monkeypatch.setattr(op3_jaccard, "CROWD", 8)  # small next to both groups
    real = op3_jaccard.verified
    monkeypatch.setattr(op3_jaccard, "verified", lambda pairs, *more: compared.append(pairs.count()) or real(pairs, *more))
    sizes = {}
    for size in (150, 450):
        rnd = random.Random(size)
        rows = []
        for i in range(size):
            words = [f"w{j}" for j in range(120)]
            for _ in range(2):
                words[rnd.randrange(120)] = f"e{i}x{rnd.randrange(9)}"
            rows.append((i, " ".join(words)))
        compared.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in op3_jaccard.groups(df).collect()}
        assert got == {d: c for d, (_, c) in components(rows).items()}
        sizes[size] = sum(compared)
    assert sizes[450] <= 5 * sizes[150]


def test_near_copies_that_do_not_link_are_not_paired_with_all(spark, monkeypatch):
    """Copies with up to seven edits, of which those with many link with nothing: rows of the last join grow with the group, not with its square."""
    made = []
    monkeypatch.setattr(op3_jaccard, "CROWD", 8)
    real = op3_jaccard.across
    monkeypatch.setattr(op3_jaccard, "across", lambda *args: made.append(real(*args).count()) or real(*args))
    sizes = {}
    for size in (150, 450):
        rnd = random.Random(size)
        rows = []
        for i in range(size):
            words = [f"w{j}" for j in range(120)]
            for e in range(i % 8):
                words[rnd.randrange(120)] = f"e{i}x{e}"
            rows.append((i, " ".join(words)))
        made.clear()
        want = {d: c for d, (_, c) in components(rows).items()}
        got = op3_jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert size // 3 < len(set(want.values())) < size  # many are alone
        sizes[size] = sum(made)
    assert sizes[450] <= 5 * max(sizes[150], 150)


def test_across_finds_every_fitting_pair(spark):
    """Rows of a crowd and of a small meeting against the definition: sizes, places and components of both."""
    rnd = random.Random(5)
    rows = [(t, d, rnd.randrange(40, 90), rnd.randrange(12), rnd.choice([1, 1, 1, 2, 3, 100 + d]), n) for t, n in ((1, 200), (2, 30)) for d in range(n)]
    got = Counter((r["token"], r["doc_id"], r["other"]) for r in op3_jaccard.across(
        spark.createDataFrame(rows, "token long, doc_id long, size int, at int, component long, n long"), (3, 4)).collect())
    want = Counter()
    for t, d, s, p, c, _ in rows:
        for u, e, z, q, k, _ in rows:
            need = 3 * (s + z) / 7
            if t == u and (s, d) < (z, e) and c != k and 3 * z <= 4 * s and s - p >= need and z - q >= need:
                want[t, d, e] += 1
    assert got == want and len({t for t, _, _ in want}) == 2


# Decontamination

def test_leaks_with_edits(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    items = [[word() for _ in range(rnd.randrange(1, 50))] for _ in range(30)]
    docs, planted = [], set()
    for d in range(300):
        text, i = [word() for _ in range(rnd.randrange(0, 200))], rnd.randrange(30)
        if d % 2:
            w = list(items[i])
            for _ in range(rnd.randrange(0, len(w) // 5 + 1)):
                p = rnd.randrange(len(w))
                w[p:p + rnd.choice([0, 1, 1])] = rnd.choice([[], [word()]])
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w
            if w:
                planted.add((d, i))
        docs.append((d, ", ".join(text)))
    found = op1_decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert len(planted - got.keys()) <= 0.02 * len(planted)
    for (d, i), r in got.items():
        w = docs[d][1].split(", ")[r["first_word"]:r["last_word"] + 1]
        assert edits(w, items[i]) == r["distance"] <= 0.2 * len(items[i])


def test_myers_against_table():
    rnd = random.Random(6)
    for _ in range(200):
        p, t = ([rnd.randrange(4) for _ in range(rnd.randrange(1, n))] for n in (9, 20))
        want = min((edits(p, t[a:b]), b) for b in range(len(t) + 1) for a in range(b + 1))
        assert op1_decontaminate.myers(p, t)[0] == want[0]
        d, a, b = op1_decontaminate.best_place(p, t, len(p))
        assert edits(p, t[a:b]) == d == want[0]


def test_leaks_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "alpha beta gamma delta alpha beta"), (5, "one"), (None, "x")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in op1_decontaminate.leaks(odd, items).collect())
    assert got == [(4, 1), (4, 1), (4, 5), (4, 5), (5, 4)]
    assert op1_decontaminate.leaks(nothing, items).count() == op1_decontaminate.leaks(odd, items.where("false")).count() == 0
    assert op1_decontaminate.leaks(odd, items, max_items=2).count() == 5
    clean = op1_decontaminate.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3


def test_hashing_many_texts_takes_little_memory():
    import pyarrow as pa

    from gaugeline.llm import words

    texts = pa.array(["some words of a text " * 200] * 1000)  # 4 MB
    words.powers.cache_clear()
    tracemalloc.start()
    try:
        n = sum(len(batch_hashes(group, ALNUM)[0]) for _, group in words.groups_of(texts))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_000_000 and most < 40 << 20


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from gaugeline.llm import words

    texts = ["alpha beta\ngamma", "", "Δelta x", "alpha " * 50]
    whole = batch_hashes(texts, ALNUM)
    monkeypatch.setattr(words, "SLICE", 16)
    parts = batch_hashes(texts, ALNUM)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].tolist() == [0, 3, 3, 5, 55]
