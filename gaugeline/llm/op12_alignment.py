"""Which tokens of two tokenizers stand for the same bytes, and how often over a corpus.

Every text is encoded by a byte-level BPE tokenizer (A) and a sentencepiece model (B).  Where both end a token, a group ends; an A and a B
token are linked where their bytes overlap.

Method: inverted pair bitmaps.  A *block* is a run of at most ``BLOCK_DOCS`` documents that one task has read.

* Per block and id pair there is a bitmap of the documents that hold the pair linked, kept as its non-zero 64-bit words, and planes that hold
  the bits of the multiplicities (plane k: documents whose number of such links has bit k).  Bitmaps of parts of a block are merged by OR.
* Popcounts of a pair's bitmap give its documents, popcounts of the planes its links; sums over blocks give both for the corpus.
* The corpus-wide counts go back to the blocks that hold the pair, and the bitmaps as postings return them to their documents.

What is shuffled is one small row per block and pair, so a pair that every document holds costs one row per block, and a block has a bounded
number of documents and links (a longer document is a block by itself).  Nothing is broadcast or collected.

Defined results: a null or empty text, and one whose joined token bytes are not a blank and the text, has no tokens, zero counts and an empty
digest; every row is a document of its own, also if its doc_id is null or repeated; the ids and links of a
very long text are held at once, so memory is bounded by the longest text; an empty table gives no rows; other columns are ignored; ties for the best count are all best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import groups_of

BLOCK_BITS = 11
BLOCK_DOCS = 1 << BLOCK_BITS
BLOCK_LINKS = 1 << 20
WORD_BITS = BLOCK_BITS - 6
ID_BITS = 20
# Fixed value: how byte-level vocabularies split a text.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Anything but characters that every version of Unicode has classed alike: Latin, Greek, Cyrillic, punctuation, kana, Han.
_UNSURE = re.compile("[^\n -~\u00a1-\u00ac\u00ae-\u0217\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]|[ \n]{1000}")


class Side:
    """One tokenizer: ids of a text that begins with a blank, and the bytes of every id."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(x) for x in entries], np.int64)

    def ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray | None:
        """The ids, or None if their bytes are not the text's."""
        ids, entries = self.ids(text), self.entries
        return np.array(ids, np.int32) if b"".join([entries[i] for i in ids]) == text.encode() else None


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel(Side):
    """A vocabulary whose ids follow its merges is also read by ``tiktoken``, which gives the same ids in less time.

    Texts with characters of which two libraries may think differently (classes changed over the versions of Unicode), or with very
    long runs of blanks, are left to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        of = byte_characters()
        added = {int(i) for i in self.tokenizer.get_added_tokens_decoder()}
        entries = []
        for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True)):
            entry = self.tokenizer.id_to_token(i) or ""
            entries.append(bytes(of[c] for c in entry) if i not in added and all(c in of for c in entry) else entry.encode())
        super().__init__(entries)
        self.fast = self._ranked(path, {e: i for i, e in enumerate(entries) if i not in added})

    @staticmethod
    def _ranked(path: str, ranks: dict[bytes, int]):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split, of = made["model"], made["pre_tokenizer"] or {}, byte_characters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        follows = all(ranks.get(bytes(of[c] for c in a + b)) == 256 + i for i, (a, b) in enumerate(merges))
        usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and made["normalizer"] is None
        if not (follows and usual and model["type"] == "BPE" and len(ranks) == 256 + len(merges)):
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _UNSURE.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces(Side):
    """The model itself puts a blank in front of a text, so the first blank of what is encoded is left out."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        super().__init__([bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names])

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteLevel(a), Pieces(b)


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Of every id below 2^20 its decimal digits in seven places, and which of these and of a separator behind them are written."""
    n = np.arange(1 << ID_BITS)
    digits = np.stack([n // 10 ** k % 10 + 48 for k in reversed(range(7))], axis=1).astype(np.uint8)
    keep = np.stack([*(n >= (10 ** k if k else 0) for k in reversed(range(7))), np.ones(len(n), bool)], axis=1)
    return digits, keep


class Aligned:
    """Several texts of which both tokenizers give tokens with the same bytes, side by side."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], left: Side, right: Side):
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.n_a, self.n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        end_a, end_b = np.cumsum(left.lengths[self.a]), np.cumsum(right.lengths[self.b])
        size = int(end_a[-1]) + 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[end_a], in_b[end_b] = True, True
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b)
        self.ends, shared = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        # Between two ends lies exactly one token of each, and every linked pair has exactly one such stretch.
        self.link_a = self.a[before_a[self.ends] - in_a[self.ends]]
        self.link_b = self.b[before_b[self.ends] - in_b[self.ends]]
        text_ends = end_a[np.cumsum(self.n_a) - 1]
        self.n_links = np.diff(np.searchsorted(self.ends, text_ends, side="right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(shared, text_ends, side="right"), prepend=0)
        self.group_a, self.group_b = before_a[shared], before_b[shared]  # tokens up to the end of each group

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text: ids of A and B as a1,a2|b1;a3|b2,b3."""
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        at_a = np.arange(len(self.a)) + np.repeat(self.group_b - size_b, size_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.group_a, size_b)
        ids = np.empty(len(self.a) + len(self.b), np.int32)
        ids[at_a], ids[at_b] = self.a, self.b
        digits, keep = _digits()
        written = np.full((len(ids), 8), ord(","), np.uint8)
        written[:, :7] = digits[ids]
        written[self.group_a + self.group_b - size_b - 1, 7] = ord("|")
        written[self.group_a + self.group_b - 1, 7] = ord(";")
        kept = keep[ids]
        last = np.cumsum(self.n_a + self.n_b) - 1
        kept[last, 7] = False
        ends = np.cumsum(kept.sum(axis=1))[last]
        data = memoryview(written[kept].tobytes())
        return [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]


def words_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct bit places as the numbers and values of their non-zero 64-bit words."""
    number = places >> 6
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, np.int64)
    bits = np.uint64(1) << (places & 63).astype(np.uint64)
    return number[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The OR of bitmaps."""
    number, word = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(number, kind="stable")
    number, word = number[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, np.int64)
    return number[first], np.bitwise_or.reduceat(word, first) if len(first) else word


class Block:
    """Pair bitmaps and multiplicity planes of some documents; a bit's place is (pair, number of the document)."""

    def __init__(self):
        self.documents: list[tuple] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.planes: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.links = 0

    @property
    def full(self) -> bool:
        return len(self.documents) >= BLOCK_DOCS or self.links >= BLOCK_LINKS

    def add(self, ids: list, encoded: list, left: Side, right: Side) -> None:
        good = [i for i, (a, b) in enumerate(encoded) if a is not None and b is not None and len(a)]
        rows = [[i, 0, 0, 0, 0, ""] for i in ids]
        if good:
            found = Aligned([encoded[i][0] for i in good], [encoded[i][1] for i in good], left, right)
            for i, *row in zip(good, found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.digests()):
                rows[i][1:] = row
            number = np.repeat(len(self.documents) + np.array(good), found.n_links)
            pair = found.link_a.astype(np.int64) << ID_BITS | found.link_b
            places, times = np.unique(pair << BLOCK_BITS | number, return_counts=True)
            self.held.append(words_of(places))
            for k in range(int(times.max()).bit_length()):
                if k == len(self.planes):
                    self.planes.append([])
                self.planes[k].append(words_of(places[times >> k & 1 == 1]))
            self.links += len(places)
        self.documents += rows

    def row(self, number: int) -> list:
        """The block as a row: what it holds of each pair, and its planes and documents."""
        held = merged(self.held) if self.held else (np.empty(0, np.int64), np.empty(0, np.uint64))
        planes = [merged(p) for p in self.planes]
        pairs, at = np.unique(held[0] >> WORD_BITS, return_inverse=True)
        docs, links = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        np.add.at(docs, at, np.bitwise_count(held[1]).astype(np.int64))
        for k, (where, word) in enumerate(planes):
            np.add.at(links, np.searchsorted(pairs, where >> WORD_BITS), np.bitwise_count(word).astype(np.int64) << k)
        sizes = np.array([len(planes), *(len(p[0]) for p in planes)], np.int64)
        data = b"".join([sizes.tobytes(), *(np.diff(p[0], prepend=0).tobytes() + p[1].tobytes() for p in planes)])
        return [number, pairs, docs, links, zstandard.ZstdCompressor(level=1).compress(data), *map(list, zip(*self.documents))]


def planes_of(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (count + 1)
    for n in np.frombuffer(raw, np.int64, count, 8).tolist():
        out.append((np.cumsum(np.frombuffer(raw, np.int64, n, at)), np.frombuffer(raw, np.uint64, n, at + 8 * n)))
        at += 16 * n
    return out


_BLOCKS = {
    "block": "long", "pairs": "array<long>", "docs": "array<long>", "links": "array<long>", "planes": "binary", "doc_id": "array<long>", "n_a": "array<long>",
    "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "groups_sha256": "array<string>",
}
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def blocks_of(docs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per block."""

    def run(batches):
        left, right = sides(a, b)
        block, made = Block(), 0

        def row():
            values = block.row(TaskContext.get().partitionId() << 32 | made)
            return pa.RecordBatch.from_arrays([pa.array([v], _ARROW[t]) for v, t in zip(values, _BLOCKS.values(), strict=True)], list(_BLOCKS))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in groups_of(batch.column(1), 1 << 19):
                for k in range(0, len(texts), BLOCK_DOCS):
                    part = texts[k:k + BLOCK_DOCS]
                    if block.documents and len(block.documents) + len(part) > BLOCK_DOCS:
                        yield row()
                        block, made = Block(), made + 1
                    encoded = [(left.encode(" " + t), right.encode(" " + t)) if t else (None, None) for t in part]
                    block.add(ids[first + k:first + k + len(part)], encoded, left, right)
                    if block.full:
                        yield row()
                        block, made = Block(), made + 1
        if block.documents:
            yield row()

    return common.texts(docs).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _BLOCKS.items()))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n_docs, n_links over the corpus, and whether no other pair of the same A id is in more documents."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "docs", "links")))
    total = common.saved(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links")), "pairs")
    most = total.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n_docs").alias("most"))
    joined = total.withColumn("a", F.shiftright("pair", ID_BITS)).join(most, "a")
    return joined.select("pair", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def table(docs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n_docs, n_links, best: the alignment of two vocabularies over the texts."""
    common.ship(docs.sparkSession)
    with common.small_batches(docs.sparkSession):
        blocks = common.saved(blocks_of(docs, a, b), "blocks")
    ids = F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b")
    return pair_counts(blocks).select(*ids, "n_docs", "n_links", "best")


def scored(block, scores):
    """The documents of one block with what the counts of their pairs add up to."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    n = len(block.column("doc_id")[0])
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = scores.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    counts, tops = scores.column("n_docs").to_numpy()[order], scores.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    for k, (where, words) in enumerate(planes_of(block.column("planes")[0].as_py())):
        at = np.searchsorted(pairs, where >> WORD_BITS)
        base = (where & ((1 << WORD_BITS) - 1)) << 6
        while len(words):  # one bit of every word that has bits left
            low = words & (~words + np.uint64(1))
            doc = base + np.bitwise_count(low - np.uint64(1))
            np.add.at(total, doc, counts[at] << k)
            np.add.at(best, doc, tops[at] << k)
            words = words ^ low
            left = words != 0
            words, at, base = words[left], at[left], base[left]
    columns = [block.column(c)[0].values if c in _BLOCKS else pa.array(best if c == "n_best" else total) for c in names]
    return pa.table(dict(zip(names, columns)))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    with common.small_batches(spark):
        blocks = common.saved(blocks_of(docs, a, b), "blocks")
    counts = common.saved(pair_counts(blocks).select("pair", "n_docs", "best"), "counts")
    asked = blocks.select(F.col("block").alias("asker"), F.explode("pairs").alias("pair")).join(counts, "pair").select("asker", "pair", "n_docs", "best")
    whole = blocks.drop("pairs", "docs", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return whole.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(scored, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
