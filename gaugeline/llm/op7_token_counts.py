"""Token counts of whole texts.

Method: the tokenizer is compiled to a deterministic transducer whose transitions carry how many tokens they add
(``bpe.Transducer``; states are built when first met).  A text is cut into chunks, each chunk becomes a map from the state
before it to the state after it and the tokens added, and the maps are composed by a parallel prefix scan.

White space resets the automaton.  So the map of a chunk is constant but for the stretch before its first white space,
and is kept as that stretch, the tokens of what lies between, and the stretch after the last white space.  This is an
associative composition, and chunks can be evaluated anywhere and in any order.

Defined results: a null text is empty with 0 tokens and 0 bytes; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common

VOCABULARY = "word_bpe_49k.json"
CHUNK = 1 << 16
LIMIT = 2048


class StateMap(NamedTuple):
    """head: what continues the state before; tail: the state after; closed: whether white space lies between."""

    head: str
    count: int
    tail: str
    closed: bool


def state_map(chunk: str, codec: bpe.Codec) -> StateMap:
    first = bpe.SPACE.search(chunk)
    if first is None:
        return StateMap(chunk, 0, "", False)
    back = bpe.SPACE.search(chunk[::-1])
    end = len(chunk) - back.start()
    inner = chunk[first.end():end]
    return StateMap(chunk[:first.start()], sum(codec.counted.all(bpe.pieces(inner))), chunk[end:], True)


def compose(a: StateMap, b: StateMap, codec: bpe.Codec) -> StateMap:
    if not a.closed and not b.closed:
        return StateMap(a.head + b.head, 0, "", False)
    if not a.closed:
        return StateMap(a.head + b.head, b.count, b.tail, True)
    if not b.closed:
        return StateMap(a.head, a.count, a.tail + b.head, True)
    joint = a.tail + b.head
    return StateMap(a.head, a.count + (codec.count(joint) if joint else 0) + b.count, b.tail, True)


def prefix_scan(maps: list[StateMap], codec: bpe.Codec) -> list[StateMap]:
    """The composition of the first 1, 2, ... maps; pairs are composed level by level."""
    if len(maps) < 2:
        return maps
    pairs = [compose(maps[i], maps[i + 1], codec) for i in range(0, len(maps) - 1, 2)]
    odd = prefix_scan(pairs, codec)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(odd[i // 2] if i % 2 else compose(odd[i // 2 - 1], maps[i], codec))
    return out


def count_text(text: str, codec: bpe.Codec, chunk: int = CHUNK) -> int:
    if len(text) <= chunk:
        return sum(codec.counted.all(bpe.pieces(text)))
    whole = prefix_scan([state_map(text[i:i + chunk], codec) for i in range(0, len(text), chunk)], codec)[-1]
    return whole.count + sum(codec.count(x) for x in (whole.head, whole.tail) if x)


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    common.ship(df.sparkSession)

    def run(batches):
        codec = bpe.codec(public_tokenizers.path(vocabulary))
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1):
                text = text.as_py()
                sizes.append(len(text.encode()))
                counts.append(count_text(text, codec, chunk))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.texts(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
