"""Alignment of two tokenizers against a walk over the tokens of each text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeline.llm import op12_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def walked(text, models):
    """Ids of both, groups and links of one text; None without tokens."""
    if not text:
        return None
    of = op12_alignment.byte_characters()
    a, b = models[0].encode(" " + text, add_special_tokens=False).ids, models[1].encode(text)
    bytes_a = [bytes(of[c] for c in models[0].id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(models[1].id_to_piece, b)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(bytes_a), spans(bytes_b)
    links, j = [], 0
    for i, (x, y) in enumerate(sa):
        while sb[j][1] <= x:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < y:
            links.append((a[i], b[k]))
            k += 1
    shared = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, i, j = [], 0, 0
    for end in shared:
        x, y = i, j
        while i < len(sa) and sa[i][1] <= end:
            i += 1
        while j < len(sb) and sb[j][1] <= end:
            j += 1
        groups.append((a[x:i], b[y:j]))
    return a, b, groups, links


def expected(rows, models):
    docs = [(i, walked(t, models)) for i, t in rows]
    count = Counter()
    for _, d in docs:
        count.update(set(d[3]) if d else ())
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str), count, Counter(p for _, d in docs if d for p in d[3])


ODD = [
    "a  b", "a   \n b\n\n\nc ", " lead", "tail ", "tab\tand nbsp", "x\x1cy", "é́ ΣΑΣ", "日本語のテキスト 日本", "<|endoftext|> <s> </s>", "it's we'll I'D",
    "▁ marked ▁▁x", "emoji 👩‍👩 x", "\x00 nul", "1234567 89", "\n", " ", "  ", "a b", "word " * 300, "x" * 500, "the the the the",
]


def test_against_a_walk(spark, models):
    rng = random.Random(1)
    words = ["the", "of", "elle", "Über", "schön", "réaux", "tion", "日本", "42", "foo_bar", "it's"]
    rows = list(enumerate(ODD)) + [(100 + i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pair string").repartition(5)
    want, docs, links = expected(rows, models)
    assert sorted(map(tuple, op12_alignment.aligned(df, A, B).collect()), key=str) == want
    table = op12_alignment.table(df, A, B).collect()
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in table} == {p: (n, links[p]) for p, n in docs.items()}


def test_odd_rows(spark, odd, nothing, models):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_alignment.aligned(odd, A, B).collect()), key=str) == expected(rows, models)[0]
    assert op12_alignment.aligned(nothing, A, B).count() == 0


def test_small_blocks_merge(models):
    """Bitmaps of parts of a block are merged, and several blocks add up."""
    left, right = op12_alignment.sides(A, B)
    texts = [t for t in ODD if walked(t, models)] * 3
    block = op12_alignment.Block()
    for k in range(0, len(texts), 7):
        part = texts[k:k + 7]
        block.add(list(range(k, k + len(part))), [(left.encode(" " + t), right.encode(" " + t)) for t in part], left, right)
    _, pairs, docs, links, *_ = block.row(0)
    count, total = Counter(), Counter()
    for t in texts:
        found = walked(t, models)[3]
        count.update(set(found))
        total.update(found)
    ids = [(int(p) >> op12_alignment.ID_BITS, int(p) & ((1 << op12_alignment.ID_BITS) - 1)) for p in pairs]
    assert dict(zip(ids, docs.tolist())) == count and dict(zip(ids, links.tolist())) == total


def test_both_libraries_give_the_same_ids(models):
    """The faster reader of the byte-level vocabulary, on texts that it gets and on texts that it does not."""
    left = op12_alignment.ByteLevel(A)
    assert left.fast is not None
    rng = random.Random(2)
    marks = "aZé ßΩж日の’—\n  .,'s't're1٣²½\t\u00a0\u2003😀́"
    texts = ODD + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 80))) for _ in range(3000)] + [" " * 5000 + "x", "ab" * 50_000]
    for t in texts:
        assert left.ids(" " + t) == models[0].encode(" " + t, add_special_tokens=False).ids
