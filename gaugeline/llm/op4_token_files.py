"""Token ids in files with random access.

Method: directly addressable codes (``dac``).  Texts are dealt out by ranges of doc_id and sorted, encoded with the
tokenizers library, and packed into containers of about ``container_tokens`` ids; a longer document has a container to
itself.  The containers are the rows of a Parquet table, so any store that Spark writes to can hold them and a lost
executor's files are written again as a whole.  ``read_ids`` and ``read_tokens`` read the files back.

The library's model encodes every different word once and its ids are remembered for the stretches between white space that hold it;
this vocabulary's tokenizer never joins anything across words, so the ids are those of the whole text.

Defined results: a null text is empty and has the end id alone; rows with equal doc_id follow in the order of their texts; a
null doc_id comes first; other columns are ignored; an empty table gives no containers.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from . import bpe, common, dac

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CONTAINER_TOKENS = 1 << 21
COLUMNS = "part int, seq int, first_doc long, n_docs long, n_tokens long, payload binary"


class LibraryCodec(bpe.Pieces):
    """The library's ids of whole texts: its model encodes every different word once and the ids are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        super().__init__(path, {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items()})
        self.model = tokenizer.model
        self.chars = bpe.byte_chars()
        self.words: dict[str, bytes] = {}
        self.encoded = bpe.Memo(self._encode, 2 * bpe.MEMO_BYTES)  # there is one memo here, not three

    def packed(self, shown: str) -> bytes:
        """The ids of a word, given by the characters that stand for its bytes."""
        found = self.words.get(shown)
        if found is None:
            if len(self.words) > 400_000:
                self.words.clear()
            ids = [x.id for x in self.model.tokenize(shown)]
            found = self.words[shown] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, w: bytes) -> list[int]:
        found = self.packed("".join(map(self.chars.__getitem__, w)))
        return struct.unpack(f"<{len(found) // 4}I", found)

    def _encode(self, piece: str) -> bytes:
        if "<|" in piece:
            return super()._encode(piece)
        if piece.isascii() and piece.isprintable():
            piece = piece.lower()  # each of these characters stands for its byte
            return self.packed(piece) if piece.isalpha() else b"".join(map(self.packed, bpe.WORDS.findall(piece)))
        return b"".join([self.packed("".join(map(self.chars.__getitem__, w))) for w in self.cut(piece)])


@lru_cache(maxsize=2)
def library(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def write_ids(df: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, container_tokens: int = CONTAINER_TOKENS) -> None:
    """Encode (doc_id, text) and write containers under ``path`` in ascending doc_id order."""
    common.ship(df.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        codec = library(public_tokenizers.path(vocabulary))
        part, seq, docs, size = TaskContext.get().partitionId(), 0, [], 0

        def container():
            row = [[part], [seq], [docs[0][0]], [len(docs)], [size], [dac.pack(docs)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in COLUMNS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = codec.encode(text.as_py())
                docs.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= container_tokens:
                    yield container()
                    seq, docs, size = seq + 1, [], 0
        if docs:
            yield container()

    dealt = common.texts(df).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, COLUMNS).write.parquet(path)


def containers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and the number of ids in all containers before; one row per container, of millions of ids each."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return containers(spark, path).select("part", "seq", "n_tokens").select(
        "part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and with ``ids`` the ids, from the files."""
    common.ship(spark)
    schema = "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                box = dac.Container(batch.column(2)[row].as_py())
                values = box.ids()
                cut = [values[a:b] for a, b in zip(box.starts, box.starts[1:])]
                n = len(cut)
                arrays = [
                    pa.array([batch.column(0)[row].as_py()] * n, pa.int32()), pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                    pa.array(box.docs, pa.int64()), pa.array(box.starts[:-1], pa.int64()), pa.array(box.lengths, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                names = ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(box.starts, pa.int32()), pa.array(values.astype("<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * ids)

    found = containers(spark, path).select("part", "seq", "payload").mapInArrow(run, schema)
    return found.join(starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, token for rows (place long): any ids by their place among all, read without decoding the containers."""
    common.ship(spark)
    spans = starts(spark, path).join(containers(spark, path).select("part", "seq", "n_tokens"), ["part", "seq"])
    step = CONTAINER_TOKENS // 2
    lo, hi = F.floor(F.col("before") / step), F.floor((F.col("before") + F.col("n_tokens") - 1) / step)
    cells = spans.withColumn("cell", F.explode(F.sequence(lo, hi)))
    asked = places.select(F.col("place").cast("long")).withColumn("cell", F.floor(F.col("place") / step))
    at = asked.join(cells, "cell").where("place >= before and place < before + n_tokens")
    grouped = at.groupBy("part", "seq", F.floor(F.hash("place") / 64).alias("salt")).agg(
        F.collect_list(F.struct("place", (F.col("place") - F.col("before")).alias("i"))).alias("asked"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                box = dac.Container(batch.column(1)[row].as_py())
                wanted = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["place"] for x in wanted], pa.int64()), pa.array([box.token(x["i"]) for x in wanted], pa.int64())],
                    ["place", "token"])

    return grouped.join(containers(spark, path), ["part", "seq"]).select("asked", "payload").mapInArrow(run, "place long, token long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_ids(common.table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, ids=False)
