"""Quality by the perplexity of a language model.

Method: an interpolated modified Kneser-Ney model of words (what stands between white space, A-Z in lower case), trained on the documents that
are labelled as good.  Every task counts the pairs of neighbouring words of its documents, the counts are summed in shards by pair,
continuation counts and context totals are derived from them by grouping, and the discounts come from the counts of counts.  The pairs of the
model and those of the documents meet in ranges of their hashes: the probability of a text is the sum of what each of its pairs adds, so only
sums come back to the documents.  Documents are scored in ``ROUNDS`` parts, so that the pairs of one part at a time are on disk.  A text begins
and ends with a mark.

The model has ids for the ``VOCABULARY`` most frequent words.  Any other word is the unknown word, spelled out by a model of its characters: an
interpolated modified Kneser-Ney model of ``ORDER`` classes of characters (``symbol_table``), which has at most ``ALPHABET ** ORDER`` entries.  So no
word is ignored and nothing that is held at once grows with the corpus.

There are two models of words, and the hash of a text decides which one scores it; the other one is trained on it, if it is a good one.  So no text,
nor any copy of it, is scored by a model that has seen it, and the scores of trusted and of other documents compare.

A document's score is its mean negative log probability by word, drawn to the mean of its language by ``PRIOR`` words so that a
few words are not judged by chance.  It is kept while the score is at most m + SPREAD * (q - m), where m and q are the median
and the 0.99 quantile of the trusted documents of its language; a language without trusted documents takes those of all.

Defined results: a text without words has no symbols, a null perplexity and is kept, any other one a symbol more than it has words, for its end; a
null language is a language; repeated rows are scored each; without any trusted document all are kept with a null threshold.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from .op3_jaccard import pack, unpack
from .words import VISIBLE, batch_hashes, groups_of

# Symbols of the model of words: marks at the ends of a text, the unknown word, and the words of the vocabulary.
BITS = 17
START, END, UNKNOWN, FIRST = 1, 2, 3, 4
VOCABULARY = (1 << BITS) - FIRST
MODEL = 1 << 2 * BITS  # this bit of a pair tells the model
FLUSH = 1 << 20
DOCS, DOC_BITS = 1 << 12, 12
RANGE_PAIRS = 1 << 19
ROUNDS = 4

ORDER = 4
ALPHABET = 48
PRIOR = 50.0
SPREAD = 3.0
SLICE = 1 << 20
MAX_BROADCAST_IDS = 1_000_000
MAX_BROADCAST_LANGUAGES = 10_000

# Symbol classes. 0 white space, 1-26 small letters, 27 capitals, 28 digits, 29-36 other small Latin letters,
# 37-40 other scripts, 41-46 the groups below, 47 anything else.
GROUPS = ((".,;:", 41), ("!?", 42), ("'\"", 43), ("()[]{}", 44), ("|-_/\\", 45), ("#$%&*@^~<>+=", 46))


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    t = np.full(0x110000, 47, np.uint8)
    t[97:123] = np.arange(1, 27)
    t[65:91] = 27
    t[48:58] = 28
    for c in range(0xC0, 0x250):
        if chr(c).isalpha():
            t[c] = 27 if chr(c).isupper() else 29 + c % 8
    t[0x250:] = 37 + np.arange(0x250, 0x110000) % 4
    for c in " \t\n\r\v\f\xa0":
        t[ord(c)] = 0
    for chars, k in GROUPS:
        for c in chars:
            t[ord(c)] = k
    return t


def grams(text: str):
    """The n-grams of a text as numbers, by slices; white space counts once, and each text begins and ends with some."""
    before = np.zeros(ORDER - 1, np.int32)
    for begin in range(0, len(text), SLICE):
        part = text[begin:begin + SLICE]
        try:
            codes = np.frombuffer(part.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        s = symbol_table()[codes].astype(np.int32)
        if begin + SLICE >= len(text):
            s = np.append(s, np.int32(0))
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        keep[0] |= before[-1] != 0 or begin == 0
        s = np.concatenate([before, s[keep]])
        if len(s) >= ORDER:
            out = s[:-3] * ALPHABET + s[1:-2]
            out = (out * ALPHABET + s[2:-1]) * ALPHABET + s[3:]
            yield out
        before = s[-(ORDER - 1):]


def count_grams(df: DataFrame) -> DataFrame:
    """gram, n: how often each n-gram occurs in the texts of all rows."""
    common.ship(df.sparkSession)

    def run(batches):
        bpe.release()
        total, waiting, size = np.zeros(ALPHABET ** ORDER, np.int32), [], 0  # of one task

        def add():
            seen, n = np.unique(np.concatenate(waiting), return_counts=True)
            total[seen] += n.astype(np.int32)

        for batch in batches:
            for text in batch.column(0):
                for g in grams(text.as_py()):
                    waiting.append(g)
                    size += len(g)
                    if size > 1 << 20:
                        add()
                        waiting, size = [], 0
        if waiting:
            add()
        seen = np.flatnonzero(total)
        for begin in range(0, len(seen), 100_000):
            some = seen[begin:begin + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], ["gram", "n"])

    counted = df.select("text").mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts of one, two and more, by how many counts are one, two, three and four."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    return [0.5, 0.75, 0.9]  # too few counts to estimate from


def probabilities(counts: DataFrame) -> np.ndarray:
    """log P of the last symbol of every n-gram of the alphabet, as a dense table.

    The driver gets the counts of the n-grams and of what stands behind each context, at most ALPHABET ** ORDER rows of 12 bytes, and fills the table
    in parts: besides it and them it holds no more than a few ALPHABET-ths of it.
    """
    levels = [common.saved(counts, "grams")]
    for k in range(ORDER - 1, 0, -1):  # how many different symbols come before each shorter n-gram
        levels.append(levels[-1].groupBy((F.col("gram") % ALPHABET ** k).alias("gram")).agg(F.count("*").alias("n")))
    dense = np.full(1, 1.0 / ALPHABET)
    for grams_of in reversed(levels):
        contexts = grams_of.groupBy(F.floor(F.col("gram") / ALPHABET).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("more"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).toArrow()
        at, sum_of, more, *sizes = (contexts[c].to_numpy() for c in ("context", "total", "more", "n1", "n2", "n3", "n4"))
        d = np.array([0.0, *discounts(*(int(n.sum()) for n in sizes))])
        width = len(dense)
        total, back = np.ones(width), np.ones(width)
        total[at] = sum_of
        back[at] = (sizes[0] * d[1] + sizes[1] * d[2] + (more - sizes[0] - sizes[1]) * d[3]) / sum_of
        last = grams_of is levels[0]
        out = np.empty(width * ALPHABET, np.float32 if last else np.float64)
        for begin in range(0, len(out), width):  # what was not met; the n-grams without their first symbol are the same in every part
            p = back[np.arange(begin, begin + width) // ALPHABET] * dense
            out[begin:begin + width] = np.log(p) if last else p
        for batch in grams_of.select(F.col("gram").cast("int").alias("gram"), "n").toArrow().to_batches():
            gram, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            p = (n - d[np.minimum(n, 3)]) / total[gram // ALPHABET] + back[gram // ALPHABET] * dense[gram % width]
            out[gram] = np.log(p) if last else p
        dense = out
    return dense


class Words:
    """What tasks know of one model of words, by the symbols of its vocabulary."""

    def __init__(self, words: np.ndarray):
        """``words``: hashes of the vocabulary, the symbols are given in this order."""
        place = np.argsort(words)
        self.words, self.symbols = words[place], place + FIRST

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), UNKNOWN)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.symbols[at], UNKNOWN)

    def learn(self, pairs: dict[str, np.ndarray], follows: dict[str, np.ndarray], cut: list[float]) -> None:
        """From the totals of each context (``pairs``), in how many different contexts a symbol stands (``follows``), and the discounts of pairs."""
        self.cut = np.array([0.0, *cut])
        n = follows["n"]
        off = np.array([0.0, *discounts(*(int((n == k).sum()) for k in (1, 2, 3, 4)))])[np.minimum(n, 3)]
        total, size = max(1, int(n.sum())), len(self.words) + 2  # the unknown word and the end are symbols too
        p = np.full(1 << BITS, (off.sum() / total if len(n) else 1.0) / size)
        p[follows["symbol"]] += (n - off) / total
        self.single = p
        self.total, self.back = np.ones(1 << BITS), np.ones(1 << BITS)  # a context that was not met leaves all to the single symbols
        self.total[pairs["symbol"]] = pairs["total"]
        self.back[pairs["symbol"]] = (pairs["ones"] * cut[0] + pairs["twos"] * cut[1] + pairs["more"] * cut[2]) / pairs["total"]
        self.log_single, self.log_back = np.log(p), np.log(self.back)

    def added(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How much larger the log probability of a pair that was met is than that of its second symbol alone, behind its first."""
        a, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
        p = (n - self.cut[np.minimum(n, 3)]) / self.total[a] + self.back[a] * self.single[b]
        return np.log(p) - self.log_back[a] - self.log_single[b]


def sequences(texts: list[str], which: np.ndarray, models: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of symbols of several texts, the text of each pair, the number of words of each text, and the unknown words."""
    hashes, cut = batch_hashes(texts, VISIBLE)
    n = np.diff(cut)
    word_in = np.repeat(np.arange(len(texts)), n)
    symbols = np.where(which[word_in] == 0, models[0].symbols_of(hashes), models[1].symbols_of(hashes)).astype(np.int64)
    length = np.where(n > 0, n + 2, 0)
    owner = np.repeat(np.arange(len(texts)), length)
    first = (np.cumsum(length) - length)[n > 0]
    last = (np.cumsum(length) - 1)[n > 0]
    seq, body = np.empty(len(owner), np.int64), np.ones(len(owner), bool)
    seq[first], seq[last] = START, END
    body[first] = body[last] = False
    seq[body] = symbols
    inside = seq[:-1] != END
    pairs = (seq[:-1] << BITS | seq[1:])[inside] if len(seq) else np.empty(0, np.int64)
    return pairs, owner[:-1][inside] if len(seq) else owner, n, symbols == UNKNOWN


def counted(df: DataFrame, keys_of, name: str) -> DataFrame:
    """``name``, n: how often each of the numbers that ``keys_of(texts, models)`` gives occurs in the texts of all rows (text, model)."""
    common.ship(df.sparkSession)

    def run(batches):
        bpe.release()
        waiting, size = [], 0

        def rows():
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], [name, "n"])

        for batch in batches:
            which = batch.column(1).to_numpy()
            for begin, texts in groups_of(batch.column(0)):
                waiting.append(keys_of(texts, which[begin:begin + len(texts)]))
                size += len(waiting[-1])
                if size >= FLUSH:
                    yield rows()
                    waiting, size = [], 0
        if waiting:
            yield rows()

    return df.select("text", "model").mapInArrow(run, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def learned(good: DataFrame) -> tuple[list[Words], DataFrame]:
    """Two models of words and the counts of their pairs (pair, n), from rows (text, model) of the trusted documents."""
    models = []
    for which in (0, 1):
        found = counted(good.where(F.col("model") == which), lambda texts, _: batch_hashes(texts, VISIBLE)[0], "word")
        found = found.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
        models.append(Words(found["word"].to_numpy().view(np.uint64)))
    known = good.sparkSession.sparkContext.broadcast(models)

    def pairs_of(texts, which):
        pairs, owner, _, _ = sequences(texts, which, known.value)
        return pairs + which[owner] * MODEL

    counts = common.saved(counted(good, pairs_of, "pair"), "pairs")
    symbol = lambda shift: F.shiftright("pair", shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("symbol")
    for which, model in enumerate(models):
        own = counts.where((F.col("pair") >= which * MODEL) & (F.col("pair") < (which + 1) * MODEL))
        sizes = dict(own.where("n < 5").groupBy("n").count().collect())  # four rows
        # A row per symbol at most, of which the vocabulary bounds the number.
        contexts = own.groupBy(symbol(BITS)).agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
            F.count_if(F.col("n") > 2).alias("more")).toArrow()
        follows = own.groupBy(symbol(0)).agg(F.count("*").alias("n")).toArrow()
        model.learn(
            {c: contexts[c].to_numpy() for c in contexts.column_names}, {c: follows[c].to_numpy() for c in follows.column_names},
            discounts(*(sizes.get(k, 0) for k in (1, 2, 3, 4))))
    return models, counts


def range_of(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def dealt(numbers: np.ndarray, ranges: np.ndarray):
    """(range, places) of numbers, ascending within each range."""
    place = np.argsort(numbers, kind="stable")
    place = place[np.argsort(ranges[place], kind="stable")]
    edges = np.flatnonzero(np.diff(ranges[place], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(ranges[place[a]]), place[a:b]


def planes(numbers: np.ndarray) -> np.ndarray:
    """Ascending numbers as the bytes of their steps, first bytes first, which packs well."""
    return np.ascontiguousarray(np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T)


def unplaned(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def packed(counts: DataFrame, bits: int) -> DataFrame:
    """range, data: the pairs of the models and their counts."""

    def run(batches):
        waiting, size = [], 0

        def rows():
            pairs, n = (np.concatenate(x) for x in zip(*waiting))
            found = [(r, pack(planes(pairs[at]), n[at].astype("<u8").view(np.uint8).reshape(-1, 8).T)) for r, at in dealt(pairs, range_of(pairs, bits))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary()))], ["range", "data"])

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= FLUSH:
                yield rows()
                waiting, size = [], 0
        if size:
            yield rows()

    return counts.mapInArrow(run, "range int, data binary")


def asked(df: DataFrame, models, spelling, columns: list[str], bits: int) -> DataFrame:
    """Rows of two kinds.  A document: ``columns``, the number of its symbols, their negative log probability by what tasks know, and its place (flush, doc).
    Packed pairs: range, flush, data."""
    common.ship(df.sparkSession)
    kept = df.select(*columns, "text", "model")
    schema = df.select(*columns).schema
    for name, kind in (("_n", "long"), ("_nll", "double"), ("flush", "long"), ("doc", "integer"), ("range", "integer"), ("data", "binary")):
        schema = schema.add(name, kind)
    for field in schema:
        field.nullable = True  # either kind lacks the columns of the other
    names, width = [f.name for f in schema], len(columns)
    more = [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        bpe.release()
        known, table = models.value, spelling.value
        flush, docs, waiting, size, types = TaskContext.get().partitionId() << 32, 0, [], 0, []

        def requests():
            numbers = np.concatenate(waiting)  # a pair and its document
            rows = []
            for r, at in dealt(numbers, range_of(numbers >> DOC_BITS, bits)):
                rows.append((flush, None, r, pack(planes(numbers[at]))))
            found = [pa.array(c, t) for c, t in zip(zip(*rows), more[2:])]
            nothing = [pa.nulls(len(rows), t) for t in (*types, *more[:2])]
            return pa.RecordBatch.from_arrays([*nothing, *found], names)

        for batch in batches:
            types = [c.type for c in batch.columns[:width]]
            model_of = batch.column(width + 1).to_numpy()
            for begin, texts in groups_of(batch.column(width)):
                if waiting and (docs + len(texts) > DOCS or size >= FLUSH):
                    yield requests()
                    waiting, size = [], 0
                    flush, docs = flush + 1, 0
                which = model_of[begin:begin + len(texts)]
                pairs, owner, n, unknown = sequences(texts, which, known)
                a, b, m = pairs >> BITS, pairs & ((1 << BITS) - 1), which[owner]
                log_p = np.where(m == 0, known[0].log_back[a] + known[0].log_single[b], known[1].log_back[a] + known[1].log_single[b])
                nll = -np.bincount(owner, log_p, len(texts))
                at = np.concatenate([[0], np.cumsum(n)])
                for i, text in enumerate(texts):
                    new = np.flatnonzero(unknown[at[i]:at[i + 1]])
                    if len(new):
                        spelled = text.encode().split()
                        for g in grams(b" ".join(map(spelled.__getitem__, new.tolist())).decode()):
                            nll[i] -= float(table[g].sum(dtype=np.float64))
                waiting.append((pairs + m * MODEL) << DOC_BITS | (owner + docs))
                size += len(pairs)
                found = [
                    pa.array(np.where(n > 0, n + 1, 0), pa.int64()), pa.array(nll, pa.float64()), pa.array(np.full(len(texts), flush)),
                    pa.array(np.arange(docs, docs + len(texts), dtype=np.int32)), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(texts)) for c in batch.columns[:width]), *found], names)
                docs += len(texts)
        if size:
            yield requests()

    return kept.mapInArrow(run, schema)


def answered(model: DataFrame, questions: DataFrame, models) -> DataFrame:
    """flush, doc, more: what the pairs that were met add to each document."""

    def run(batches):
        here, parts, pairs, values = None, [], None, None
        known = models.value
        for batch in batches:
            out = []
            for r, flush, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != here:
                    here, parts, pairs = r, [], None
                if flush is None:
                    steps, n = unpack(data.as_py(), ["V8", "V8"])
                    parts.append((unplaned(steps.view("u1")), np.ascontiguousarray(n.view("u1").reshape(8, -1).T).view("<i8").ravel()))
                    continue
                if not parts:
                    continue
                if pairs is None:
                    pairs, n = (np.concatenate(x) for x in zip(*parts))
                    parts = [None]
                    place = np.argsort(pairs, kind="stable")
                    pairs, n = pairs[place], n[place]
                    cut = np.searchsorted(pairs, MODEL)  # the pairs of the second model follow
                    values = np.concatenate([known[0].added(pairs[:cut], n[:cut]), known[1].added(pairs[cut:] - MODEL, n[cut:])])
                    values = values.astype(np.float32).astype(np.float64)
                numbers = unplaned(unpack(data.as_py(), ["u1"])[0])
                at = np.minimum(np.searchsorted(pairs, numbers >> DOC_BITS), len(pairs) - 1)
                met = pairs[at] == numbers >> DOC_BITS
                doc = numbers[met] & (DOCS - 1)
                if len(doc):
                    more = np.bincount(doc, values[at[met]], DOCS)
                    doc = np.flatnonzero(np.bincount(doc, minlength=DOCS))
                    out.append((flush, pack(doc.astype("<u2"), more[doc])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["flush", "data"])

    def add(group):
        more, met = np.zeros(DOCS), np.zeros(DOCS, bool)
        for x in group.column("data"):
            doc, part = unpack(x.as_py(), ["<u2", "<f8"])
            more[doc] += part
            met[doc] = True
        doc = np.flatnonzero(met)
        flush = np.full(len(doc), group.column("flush")[0].as_py())
        return pa.table({"flush": flush, "doc": doc.astype(np.int32), "more": more[doc]})

    # The model's rows come first in each range, and a task holds those of one range and one question at a time.
    both = model.select("range", F.lit(None).cast("long").alias("flush"), "data").union(questions.select("range", "flush", "data"))
    met = both.repartition("range").sortWithinPartitions("range", F.col("flush").asc_nulls_first()).mapInArrow(run, "flush long, data binary")
    return met.groupBy("flush").applyInArrow(add, "flush long, doc int, more double")


def scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of all documents, with the number of symbols ``_n`` and their summed negative log probability ``_nll``."""
    spark = docs.sparkSession
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    plain = plain.withColumn("model", F.pmod(F.xxhash64("text"), F.lit(2)))
    good = trusted(plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (1 - F.col("model")).alias("model")), labels)
    spelling = spark.sparkContext.broadcast(probabilities(count_grams(good)))
    models, counts = learned(good)
    bits = max(2, (counts.count() // RANGE_PAIRS).bit_length())
    known = spark.sparkContext.broadcast(models)
    model = common.saved(packed(counts, bits), "model")
    common.discard(counts)
    parts = []
    for k in range(ROUNDS):
        part = plain.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k)
        found = common.saved(asked(part, known, spelling, columns, bits), "questions")
        more = answered(model, found.where("data is not null"), known)
        rows = found.where("data is null").join(more, ["flush", "doc"], "left")
        parts.append(common.saved(rows.select(*columns, "_n", (F.col("_nll") - F.coalesce("more", F.lit(0.0))).alias("_nll")), "scores"))
        common.discard(found)
    common.discard(model)
    return reduce(DataFrame.unionAll, parts)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled as good; the list of labels is sent to all tasks only while it is short."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if good.count() <= MAX_BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left_semi")


def judged(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of all documents with _n, _nll, score, threshold and keep; ``columns`` must hold doc_id and lang."""
    found = scored(docs, labels, columns).withColumn("_lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    small = common.saved(trusted(found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lang").alias("lang"), "_n", "_nll"), labels), "trusted-scores")
    level = small.groupBy("lang").agg((F.sum("_nll") / F.greatest(F.sum("_n"), F.lit(1))).alias("level"))
    overall = small.agg((F.sum("_nll") / F.greatest(F.sum("_n"), F.lit(1))).alias("level")).first()["level"]
    drawn = lambda at: (F.col("_nll") + PRIOR * at) / (F.col("_n") + PRIOR)
    known = small.join(few(level), "lang").withColumn("score", drawn(F.col("level")))
    quantiles = F.percentile_approx("score", F.array(F.lit(0.5), F.lit(0.99)), 10_000)
    limits = common.saved(
        known.groupBy("lang").agg(quantiles.alias("q"), F.first("level").alias("level")).select(
            "lang", "level", (F.col("q")[0] + SPREAD * (F.col("q")[1] - F.col("q")[0])).alias("threshold")), "limits")
    q = known.agg(quantiles.alias("q")).first()["q"]
    other = float(q[0] + SPREAD * (q[1] - q[0])) if q else None
    rows = found.join(few(limits.withColumnRenamed("lang", "_lang")), "_lang", "left").drop("_lang")
    rows = rows.withColumn("threshold", F.coalesce("threshold", F.lit(other).cast("double")))
    rows = rows.withColumn("score", drawn(F.coalesce("level", F.lit(overall).cast("double"), F.lit(0.0)))).drop("level")
    return rows.withColumn("keep", F.coalesce(F.col("score") <= F.col("threshold") + 1e-9, F.lit(True)))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; what is rejected depends on text and language alone."""
    node = F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    found = judged(docs.select("doc_id", "lang", "text", node.alias("_node")), labels, ["doc_id", "lang", "_node"])
    rejected = common.saved(found.where("not keep").select("_node").distinct(), "rejected")
    return docs.withColumn("_node", node).join(rejected, "_node", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def few(by_language: DataFrame) -> DataFrame:
    """A row per language: sent to all tasks while there are few languages, joined by shuffle beyond."""
    return F.broadcast(by_language) if by_language.count() <= MAX_BROADCAST_LANGUAGES else by_language


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, score, threshold, keep of every document."""
    plain = common.texts(docs, "doc_id", "text", "lang")
    return judged(plain, labels, ["doc_id", "lang"]).select(
        "doc_id", "lang", F.col("_n").alias("n_symbols"), F.when(F.col("_n") > 0, F.exp(F.col("_nll") / F.col("_n"))).alias("perplexity"),
        "score", "threshold", "keep")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
