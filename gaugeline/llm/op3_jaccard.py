"""Documents whose sets of word n-grams are alike, and the groups they form.

Method: prefix filters under several global orders.  An order puts tokens (n-grams) that many documents hold last, the least frequent
first, and the rest by a hash; the second order uses another hash.  Two sets with a Jaccard similarity of at least t share a token among
the first n - ceil(t * n) + 1 tokens of each, under every order.  Documents that share such a token under the first order meet; a pair of
fitting sizes has to share one under the second order too before its sets are compared exactly.

How it stays linear:

* Equal sets are one class with its smallest doc_id; only these representatives are compared.
* Token frequencies come from all documents: every task packs its sorted tokens by range, and a range is counted in one piece.  Tokens of
  at least ``FREQUENT`` documents, at most ``MAX_FREQUENT`` of them, are sent to all tasks.  Which tokens these are only decides the order;
  any order gives the same result.
* Two similar sets share a token that stands, in both, before what they may lack of each other; only where a token stands so do they meet.  Of
  near copies, that leaves out those with too much of their own: their rare tokens come first.
* Where more than ``CROWD`` documents meet, each is first compared with at most ``HUBS`` of them, in rounds with different ones for as long as
  a round joins many of them and such crowds are left.  The first hubs are those with the fewest tokens before the shared one, which near copies
  have least to lack of.  What links is one component, and later only pairs across components are compared, those inside the largest component
  of a crowd are not even looked up.  So a large group of near copies costs some comparisons each.

Tokens are 64-bit hashes.  Inside, a row is known by a hash of its doc_id and text, so rows that repeat a doc_id with another text are
compared each on its own, and rows that agree in both are one.  Defined results: a null or empty text has no tokens, is linked with nothing
and is its own component; a row without doc_id has a result like any other and names no class or component (null if nothing else is in it);
the tokens of a very long text are held at once; ties of frequencies are ordered by hash; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from .op9_line_dedup import sieve
from .words import VISIBLE, batch_hashes, groups_of, mix, run_hashes

N = 5
SIMILARITY = (3, 4)  # at least 3 / 4
FREQUENT = 5
MAX_FREQUENT = 1_000_000
CROWD = 48
HUBS = 16
BAND = 1.03  # sizes of a crowd are looked up by bands of this ratio
FLUSH = 1 << 21


def token_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one token, a text without words none."""
    h, cut = batch_hashes(texts, VISIBLE)
    runs = run_hashes(h, n)
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            out.append(run_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int, similarity: tuple[int, int]) -> int:
    p, q = similarity
    return n - (p * n + q - 1) // q + 1 if n else 0


class Order:
    """The global orders: frequent tokens last, the less frequent of them first; the rest by value or by another hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = np.argsort(tokens)
        self.tokens, self.counts = tokens[place], counts[place]

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        top = (tokens >> np.uint64(32)).astype(np.uint32)
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, top), len(self.tokens) - 1)
        return np.where(self.tokens[at] == top, self.counts[at], 0)

    def prefix(self, tokens: np.ndarray, which: int, similarity: tuple[int, int]) -> np.ndarray:
        size = prefix_size(len(tokens), similarity)
        key = tokens if which == 0 else mix(tokens * np.uint64(2 * which + 1))
        classes = self.classes(tokens)
        if which == 0 and not classes.any():
            return tokens[:size]
        return tokens[np.lexsort((key, classes))[:size]]


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def unpack(data: bytes, types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def by_range(top: np.ndarray, bits: int):
    """(range, begin, end) of sorted 32-bit values by their first bits."""
    cut = np.searchsorted(top, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
    edges = np.concatenate([[0], cut, [len(top)]])
    for r in np.flatnonzero(np.diff(edges)):
        yield int(r), int(edges[r]), int(edges[r + 1])


def sets_of(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows of two kinds. A document: doc_id, size, f1, f2 (a fingerprint of the set). Packed tokens: range, data."""
    schema = "doc_id long, size int, f1 long, f2 long, range int, data binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        bpe.release()
        seen: set[bytes] = set()
        waiting: list[np.ndarray] = []
        size = 0

        def flush():
            top = np.sort((np.concatenate(waiting) >> np.uint64(32)).astype(np.uint32))
            rows = [(r, pack(np.diff(top[a:b], prepend=np.uint32(0)))) for r, a, b in by_range(top, bits)]
            columns = [[None] * len(rows)] * 4 + [list(x) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in groups_of(batch.column(1)):
                rows = []
                for doc, tokens in zip(ids[first:first + len(texts)], token_sets(texts, n), strict=True):
                    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                    f1, f2 = np.frombuffer(digest, "<i8").tolist()
                    rows.append((doc, len(tokens), f1, f2, None, None))
                    if len(tokens) and digest not in seen:  # copies in this task count once
                        seen.add(digest)
                        waiting.append(tokens)
                        size += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                if size >= FLUSH:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.mapInArrow(run, schema)


def frequent(packed: DataFrame) -> DataFrame:
    """token (its first 32 bits), n: tokens of at least FREQUENT documents."""

    def count(group):
        top = np.sort(np.concatenate([np.cumsum(unpack(x.as_py(), ["<u4"])[0], dtype=np.uint32) for x in group.column("data")]))
        edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        n = np.diff(np.append(edge, len(top)))
        keep = n >= FREQUENT
        return pa.table({"token": pa.array(top[edge[keep]].astype(np.int64)), "n": pa.array(n[keep].astype(np.int64))})

    return packed.groupBy("range").applyInArrow(count, "token long, n long")


def meetings(docs: DataFrame, order, n: int, bits: int, similarity: tuple[int, int]) -> DataFrame:
    """token, doc_id, size, at: documents that share a token of their prefixes under the first order, and its place there."""

    def run(batches):
        bpe.release()
        seen: dict[bytes, int] = {}  # of copies in this task only one is posted, or the one with the smallest doc_id as well
        waiting: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush():
            tokens = np.concatenate([w[0] for w in waiting])
            lengths = [len(w[0]) for w in waiting]
            doc = np.repeat(np.array([w[1] for w in waiting], np.int64), lengths)
            of = np.repeat(np.array([w[2] for w in waiting], np.int32), lengths)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            place = np.argsort(tokens, kind="stable")
            tokens, doc, of, at = tokens[place], doc[place], of[place], at[place]
            top = (tokens >> np.uint64(32)).astype(np.uint32)
            low = (tokens >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)
            rows = [(r, pack(top[a:b], low[a:b], doc[a:b], of[a:b], at[a:b])) for r, a, b in by_range(top, bits)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["range", "data"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in groups_of(batch.column(1)):
                for doc, tokens in zip(ids[first:first + len(texts)], token_sets(texts, n), strict=True):
                    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                    if len(tokens) and doc < seen.get(digest, doc + 1):
                        seen[digest] = doc
                        waiting.append((order.value.prefix(tokens, 0, similarity), doc, len(tokens)))
                        size += len(waiting[-1][0])
                if size >= FLUSH // 2:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    def meet(group):
        parts = [unpack(x.as_py(), ["<u4", "<u2", "<i8", "<i4", "<i4"]) for x in group.column("data")]
        top, low, doc, size, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        token = top.astype(np.int64) << 16 | low
        place = np.argsort(token, kind="stable")
        token, doc, size, at = token[place], doc[place], size[place], at[place]
        same = token[1:] == token[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pa.table({"token": token[keep], "doc_id": doc[keep], "size": size[keep], "at": at[keep]})

    return docs.mapInArrow(run, "range int, data binary").groupBy("range").applyInArrow(meet, "token long, doc_id long, size int, at int")


def verified(pairs: DataFrame, texts: DataFrame, order, n: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b: those pairs that share a prefix token under the second order and are similar."""
    p, q = similarity

    def run(batches):
        for batch in batches:
            a, b, keep, known = batch.column(0), batch.column(1), [], {}

            def sets(name, text, known=known):
                found = known.get(name)
                if found is None:
                    if len(known) > 256:
                        known.clear()
                    tokens = token_sets([text.as_py()], n)[0]
                    found = known[name] = tokens, order.value.prefix(tokens, 1, similarity)
                return found

            for i in range(batch.num_rows):
                x, px = sets(a[i].as_py(), batch.column(2)[i])
                y, py = sets(b[i].as_py(), batch.column(3)[i])
                need = -(-p * (len(x) + len(y)) // (p + q))
                if not np.intersect1d(px[:len(x) - need + 1], py[:len(y) - need + 1], assume_unique=True).size:
                    keep.append(False)
                    continue
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(q * both >= p * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (the smallest doc_id reachable) of all documents with an edge; labels are halved in each round."""
    both = common.saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "doc_id"), "labels")
    while True:
        seen = both.join(labels.select(F.col("doc_id").alias("b"), F.col("component").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        near = labels.join(seen.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", "component", F.least("component", "other").alias("new"))
        jump = labels.select(F.col("doc_id").alias("new"), F.col("component").alias("beyond"))
        moved = common.saved(
            near.join(jump, "new", "left").select("doc_id", F.least("new", F.coalesce("beyond", "new")).alias("component"), F.col("component").alias("old")), "labels")
        labels = moved.select("doc_id", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def starred(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: what is linked with a node is linked with the node's least neighbour instead."""
    far = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    least = far.groupBy("u").agg(F.min("v").alias("m"))
    others = far.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return least.select(F.col("u").alias("a"), F.col("m").alias("b")).union(others)


def extended(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels with more links: only components that these join are labelled anew."""
    if labels is None:
        return components(starred(edges))

    def of(c: str) -> DataFrame:
        return labels.select(F.col("doc_id").alias(c), F.col("component").alias(f"of_{c}"))

    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
    joined = components(starred(common.saved(between, "between")))
    moved = joined.select(F.col("doc_id").alias("component"), F.col("component").alias("newer"))
    old = labels.join(moved, "component", "left").select("doc_id", F.coalesce("newer", "component").alias("component"))
    fresh = joined.select("doc_id", "component").join(labels.select("doc_id"), "doc_id", "left_anti")
    return common.saved(old.union(fresh), "labels")


def labelled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return met.withColumn("component", F.col("doc_id"))
    return met.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def fitting(similarity: tuple[int, int], other: str):
    """A condition on two rows of a token, the columns of one begin with ``other``: sizes of similar sets, and enough of both sets from the token on.

    The first token that two similar sets share fulfils it: all that they share begins there.
    """
    p, q = similarity
    sizes, places = [F.col("size"), F.col(f"{other}_size")], [F.col("at"), F.col(f"{other}_at")]
    far = [(p + q) * (n - at) >= p * (sizes[0] + sizes[1]) for n, at in zip(sizes, places, strict=True)]
    return (p * sizes[0] <= q * sizes[1]) & (p * sizes[1] <= q * sizes[0]) & far[0] & far[1]


def across(here: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of fitting rows of a token in different components; ``other`` has the larger set, or the larger id of two alike.

    In a crowd, a larger set looks up the bands of sizes that its place of the token leaves to the smaller one, and one in the crowd's largest
    component looks up only what is outside of it.
    """
    p, q = similarity
    band = lambda x: F.floor(F.log(x) / math.log(BAND)).cast("int")
    crowd = here.where(F.col("n") > CROWD)
    parts = crowd.groupBy("token", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("token").agg(F.max(F.struct("c", "component")).getField("component").alias("main"))
    crowd = crowd.join(main, "token").withColumn("inside", F.col("component") == F.col("main"))
    least, most = F.col("size") * p / q, F.least((F.col("size") * q - F.col("at") * (p + q)) / p, F.col("size").cast("double"))
    kept = ["token", "doc_id", "size", "at", "component", "inside"]
    few = here.where(F.col("n") <= CROWD).withColumn("inside", F.lit(False)).withColumn("band", F.lit(0))
    smaller = few.select(*kept, "band").union(crowd.select(*kept, band(F.col("size")).alias("band"))).where(
        (p + q) * (F.col("size") - F.col("at")) >= 2 * p * F.col("size"))
    looks = crowd.withColumn("inside", F.explode(F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    larger = few.select(*kept, "band").union(looks.select(*kept, F.explode(F.sequence(band(least), band(most))).alias("band"))).select(
        "token", "inside", "band", F.col("doc_id").alias("other"), F.col("size").alias("other_size"), F.col("at").alias("other_at"),
        F.col("component").alias("other_component"))
    ordered = (F.col("size") < F.col("other_size")) | (F.col("size") == F.col("other_size")) & (F.col("doc_id") < F.col("other"))
    return smaller.join(larger, ["token", "inside", "band"]).where(ordered & (F.col("component") != F.col("other_component")) & fitting(similarity, "other"))


def links(docs: DataFrame, reps: DataFrame, order, n: int, bits: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, component of the representatives that are linked with others."""
    p, q = similarity
    met = meetings(docs, order, n, bits, similarity).join(reps.select("doc_id"), "doc_id", "left_semi")
    met = common.saved(met.select("token", "doc_id", "size", "at"), "met")
    crowds = met.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    met = common.saved(met.join(crowds, "token"), "meetings")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = common.saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("h", F.xxhash64("doc_id")), "wanted")
        likely = sieve(docs.withColumn("h", F.xxhash64("doc_id")), "h", wanted).drop("h")
        # An inner join with distinct rows: a semi join would be moved below the sieve, and all texts shuffled.
        return common.saved(likely.join(wanted.drop("h"), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "texts")

    labels = None
    crowded = met.where(F.col("n") > CROWD).withColumn("rest", F.col("n"))
    k = 0
    while not crowded.isEmpty():
        here = labelled(crowded, labels)
        # At most HUBS of the n documents that meet, the same ones wherever these meet again.
        drawn = F.xxhash64(F.lit(k), "doc_id")
        first = F.struct((F.col("at") if k == 0 else F.lit(0)).alias("rank"), drawn.alias("drawn"), "doc_id", "size", "at", "component")
        chosen = here.groupBy("token", F.pmod(drawn, F.lit(HUBS)).alias("slot")).agg(F.min(first).alias("hub"))
        hubs = chosen.select("token", F.col("hub.doc_id").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.at").alias("hub_at"), F.col("hub.component").alias("hub_component"))
        near = here.join(hubs, "token").where((F.col("component") != F.col("hub_component")) & fitting(similarity, "hub"))
        least, most = F.least("hub", "doc_id"), F.greatest("hub", "doc_id")
        pairs = common.saved(near.select(least.alias("a"), most.alias("b")).distinct(), "pairs")
        texts = texts_of(pairs)
        new = common.saved(verified(pairs, texts, order, n, similarity), "links")
        common.discard(texts)
        if new.isEmpty():
            break
        labels, k = extended(labels, new), k + 1
        # Crowds in which more than CROWD documents are outside of the largest component, and clearly fewer than before: where a round
        # joins hardly any documents, these have little in common but the token, and further hubs would not join them either.
        parts = labelled(crowded.select("token", "doc_id", "rest"), labels).groupBy("token", "component").agg(F.count("*").alias("c"), F.max("rest").alias("was"))
        rest = parts.groupBy("token").agg((F.sum("c") - F.max("c")).alias("rest"), F.max("was").alias("was"))
        left = rest.where((F.col("rest") > CROWD) & (4 * F.col("rest") <= 3 * F.col("was"))).select("token", "rest")
        crowded = common.saved(crowded.drop("rest").join(left, "token"), "crowds")
    here = labelled(met, labels).select("token", "doc_id", "size", "at", "component", "n")
    # What two sets can share: the tokens in which they meet, and at most what comes after the last of these.
    shared = across(here, similarity).groupBy(F.col("doc_id").alias("a"), F.col("other").alias("b"), "size", "other_size").agg(
        F.count("*").alias("met"), F.max("at").alias("at"), F.max("other_at").alias("other_at"))
    most = F.col("met") + F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) - 1
    pairs = common.saved(shared.where(most * (p + q) >= p * (F.col("size") + F.col("other_size"))).select("a", "b"), "pairs")
    return extended(labels, common.saved(verified(pairs, texts_of(pairs), order, n, similarity), "links"))


def groups(docs: DataFrame, n: int = N, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id."""
    common.ship(docs.sparkSession)
    with common.small_batches(docs.sparkSession):
        return grouped_sets(docs, n, similarity)


def grouped_sets(docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    spark = docs.sparkSession
    given = common.texts(docs)
    node = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")
    plain = given.select(node.alias("doc_id"), "text")
    bits = max(6, math.ceil(math.log2(max(1, plain.count()) / 1024 + 1)))
    made = common.saved(sets_of(plain, n, bits), "sets")
    order = spark.sparkContext.broadcast(Order(*frequent_tokens(made.where("data is not null").select("range", "data"))))
    sets = common.saved(made.where("data is null").select(F.col("doc_id").alias("node"), "size", "f1", "f2"), "documents")
    common.discard(made)
    # A class is known by one of its rows; only these are compared.
    reps = common.saved(sets.where("size > 0").groupBy("f1", "f2", "size").agg(F.min("node").alias("rep")), "classes")
    labels = links(plain, reps.select(F.col("rep").alias("doc_id")), order, n, bits, similarity).withColumnRenamed("doc_id", "rep")
    grouped = reps.join(labels, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    rows = common.saved(given.select("doc_id", node.alias("node")).join(sets.dropDuplicates(["node"]), "node").drop("node"), "rows")
    classes = rows.where("size > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id")).join(grouped, ["f1", "f2"])
    named = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = common.saved(classes.join(named, "component").select("f1", "f2", "class_id", "component_id"), "grouped")
    alone = F.col("size") == 0
    return rows.join(known, ["f1", "f2"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def frequent_tokens(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most MAX_FREQUENT; the others are ordered by their hash alone."""
    found = frequent(packed).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()  # not as rows, which take many times the memory
    return found["token"].to_numpy().astype(np.uint32), found["n"].to_numpy()


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of every component, that with the smallest doc_id, with all its columns; rows without doc_id stay."""
    known = groups(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(known, "doc_id", "left_anti")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
