"""Encoding, counting and files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gaugeline.llm import bpe, dac, op3_jaccard, op4_token_files, op6_bpe, op7_token_counts, op8_quality
from gaugeline.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_library_on_random_texts(library):
    rnd, codec = random.Random(5), bpe.codec(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzABCéüßñΣς'’!?.-_0123 \t\n ́日本한\U0001f600Ƛ"
    for n in (1, 3, 10, 60, 900):
        for _ in range(60):
            text = "".join(rnd.choice(letters) for _ in range(n))
            assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == ids_of(library, text), text


def test_stream_holds_back_and_agrees(library):
    merges = bpe.transducer(PATH).m
    assert merges.longest < bpe.lookahead(merges) < 10_000
    word = "".join(random.Random(2).choice("abcdeing") for _ in range(9000))
    stream, out, most = bpe.Stream(bpe.transducer(PATH)), [], 0
    data = word.encode()
    for s in (*data[:-1], data[-1] + 256):
        out += stream.feed(s)
        most = max(most, len(stream.ends))
    assert out and most <= 2 * stream.hold
    assert out + stream.flush() == ids_of(library, word)


def test_every_pair_of_merge_symbols_matches_the_definition():
    t = bpe.transducer(PATH)
    rnd = random.Random(3)
    for _ in range(400):
        word = bytes(rnd.choice(b"thernigaso") for _ in range(rnd.randrange(1, 14)))
        assert t.encode(word) == t.m.apply((*word[:-1], word[-1] + 256))
        assert t.count(word) == len(t.encode(word))


def test_encode_rows(odd, nothing, library):
    found = sorted(op6_bpe.encode(odd).collect(), key=str)
    given = sorted(odd.select("doc_id", "text").collect(), key=str)
    assert len(found) == len(given)
    by_id = {(r["doc_id"]): r for r in found}
    for r in given:
        ids = ids_of(library, r["text"])
        x = by_id[r["doc_id"]]
        assert list(x["ids"]) == ids and x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert op6_bpe.encode(nothing).count() == 0
    back = {r["doc_id"]: r["text"] for r in op6_bpe.decode(op6_bpe.encode(odd)).collect()}
    assert back[7] == library.decode(ids_of(library, odd.where("doc_id = 7").first()["text"]), skip_special_tokens=False)
    assert "it 's 日本語" in {r["doc_id"]: r["text"] for r in op6_bpe.decode(op6_bpe.encode(odd), readable=True).collect()}[7]


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 1 << 16])
def test_counts_do_not_depend_on_chunks(library, chunk):
    codec = bpe.codec(PATH)
    for text in ("", " ", "a", "it's the  end\n\nof <|endoftext|> lines ", "x" * 300, "été ΣΑΣ \x1c word next"):
        assert op7_token_counts.count_text(text, codec, chunk) == len(ids_of(library, text)), (text, chunk)


def test_prefix_scan_gives_every_prefix():
    codec = bpe.codec(PATH)
    text = "the quick brown fox, jumps over it's own tail " * 3
    maps = [op7_token_counts.state_map(text[i:i + 7], codec) for i in range(0, len(text), 7)]
    scanned = op7_token_counts.prefix_scan(maps, codec)
    one = maps[0]
    for i, m in enumerate(maps[1:], 1):
        one = op7_token_counts.compose(one, m, codec)
        assert scanned[i] == one


def test_count_rows(odd, nothing, library):
    for r in op7_token_counts.token_counts(odd, limit=100).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(ids_of(library, r["text"]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)
    assert op7_token_counts.token_counts(nothing).count() == 0


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [(int(i), rng.choice([rng.integers(0, 256), rng.integers(0, 49_408), 1 << 20], size=rng.integers(0, 2000)).astype("<u4").tobytes()) for i in range(12)]
    docs.append((None, b""))
    box = dac.Container(dac.pack(docs))
    whole = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert (box.ids() == whole).all() and box.docs == [d for d, _ in docs]
    assert all(box.token(int(i)) == whole[i] for i in rng.integers(0, len(whole), 500))
    with pytest.raises(IndexError):
        box.token(len(whole))
    assert len(dac.Container(dac.pack([])).docs) == 0


def test_files(spark, odd, nothing, library):
    path = fresh_path(spark, "ids")
    op4_token_files.write_ids(odd, path, container_tokens=500)
    found = op4_token_files.read_ids(spark, path).orderBy("start").collect()
    given = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, every = 0, []
    for x, r in zip(found, given, strict=True):
        ids = [*ids_of(library, r["text"]), 2]
        assert (x["doc_id"], x["start"], list(x["ids"])) == (r["doc_id"], start, ids)
        assert x["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start, every = start + len(ids), every + ids
    places = spark.range(0, start, 997).select("id").withColumnRenamed("id", "place")
    got = {r["place"]: r["token"] for r in op4_token_files.read_tokens(spark, path, places).collect()}
    assert got == {i: every[i] for i in range(0, start, 997)}
    empty = fresh_path(spark, "ids")
    op4_token_files.write_ids(nothing, empty)
    assert op4_token_files.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("step", [op8_quality.count_grams, lambda docs: op3_jaccard.sets_of(docs, 5, 6)], ids=["quality", "sets"])
def test_tasks_of_other_operators_let_go_of_automata(spark, step):
    class Here:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            list(run(iter(())))
            return self

        groupBy = agg = select

    bpe.codec(PATH)
    step(Here())
    assert not bpe.codec.cache_info().currsize and not bpe.transducer.cache_info().currsize


def test_library_encodes_a_plain_word_once_in_all_pieces(library):
    codec = op4_token_files.LibraryCodec(PATH)
    asked = []

    class Model:
        def tokenize(self, word, model=codec.model):
            asked.append(word)
            return model.tokenize(word)

    codec.model = Model()
    text = "Word word, WORD; (word) wörd it's a_b 12 a\x01b <|x a<|endoftext|>b \x7f x\x1cy"
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert asked.count("word") == 1 and len(codec.words) == len(set(asked))
