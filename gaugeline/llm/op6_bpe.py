"""BPE encoding and decoding of whole texts.

Method: bounded-lookahead streaming transducer (``bpe.Stream``): the sufficient lookahead is computed from the merge list,
tokens are emitted once nothing that follows can change them, so the working memory of a text is constant.  White space and
word borders settle everything before them; pieces of text met before are answered from a bounded memo.  Decoding is an
incremental state machine (``bpe.Decoder``).

Defined results: a null text is empty and has no tokens; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

VOCABULARY = "word_bpe_49k.json"


def encode(df: DataFrame, vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, and with ``ids`` the ids themselves as an array."""
    common.ship(df.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches):
        codec = bpe.codec(public_tokenizers.path(vocabulary))
        for batch in batches:
            sizes, id_digests, text_digests, encoded = [], [], [], []
            for text in batch.column(1):
                found, decoded = codec.both(text.as_py())
                sizes.append(len(found) // 4)
                id_digests.append(hashlib.sha256(found).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    encoded.append(found)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if ids:
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return common.texts(df).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str = VOCABULARY, readable: bool = False) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the library's own form, or ``readable`` text with words as words."""
    common.ship(df.sparkSession)

    def run(batches):
        path = public_tokenizers.path(vocabulary)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                machine = bpe.Decoder(path)
                step = machine.text if readable else machine.joined
                out.append("".join(step(t) for t in ids.as_py() or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), ids=False)
