"""The trie of conversations that begin alike, with totals per node.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then c's own turns after its first h, where h is the CRC-32
of c's decimal digits modulo 6.  A node is a distinct sequence of the first d rebuilt turns.

Method: van Emde Boas recursion, all parts of a level in one job.  With H the longest sequence, there are about log2(H) levels.

* *Cut.*  A stretch of 2^k turns that begins at a multiple of 2^k is cut at half its length.  Names of whole halves are made bottom up
  (``blocks``): the name of a block is the hash of the names of its two halves.
* *Name.*  Top down, the prefix that ends at the cut of a stretch is named from the name of the prefix before the stretch and the name of its
  first half (``prefixes``).  Each prefix is the cut of one stretch, so each is named once.  Equal names are equal prefixes (128 bits).
* *Graft.*  Bottom up, an upper trie of height 2^j gets the totals of the lower tries that hang below it: each adds its totals to its
  ancestors there (``grafted``).  So a node takes part in log2(H) rounds, not in one per turn of the longest conversation.

No task gets a whole conversation or a whole node: turns are numbered over range partitions, each row is joined by (conversation, depth),
which is unique, and groups are sums and minima, which fold before the shuffle.  The members that end at a node are packed into chunks of
sorted ids, and a chunk is one row of the task that hashes them one after the other.

Defined results: turns are ordered by turn, null first, then by the MD5 of role and text (ties; repeated rows all count); a null conv_id is no
conversation; null and empty roles and texts are the empty string; texts of any length are hashed where they are read and go no further; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARED = 100  # conversations of one hundred share the beginning of its first
HEADS = 6  # up to HEADS - 1 turns of it
CHUNK = 1 << 16
_ROW = (1 << 33) - 1


def _name(*parts: Column) -> list[Column]:
    """Two independent hashes of the parts, as x and y."""
    return [F.xxhash64(F.lit(k), *parts).alias(name) for k, name in enumerate(("x", "y"), 1)]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, at (its place from 0), x, y (name of the turn), chars."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), content.alias("content"), F.length(text).cast("long").alias("chars"))
    placed = turns.repartitionByRange("conv", F.asc_nulls_first("turn"), "content").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "content")
    placed = common.saved(placed.select(
        "conv", *_name(F.col("content")), "chars", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("row")), "turns")
    # One row per conversation and partition it reaches into.
    pieces = placed.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv", "part", "first", "before")
    return placed.join(pieces, ["conv", "part"]).select("conv", (F.col("row") - F.col("first") + F.col("before")).alias("at"), "x", "y", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: conv, depth (from 1), x, y, chars; and all of them: conv, turns."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = F.crc32(F.col("conv").cast("string")) % HEADS
    base = F.col("conv") - F.col("conv") % SHARED
    first = lengths.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = lengths.withColumn("base", base).withColumn("head", heads).join(first, "base", "left")
    kept = F.least("head", F.coalesce("there", F.lit(0)))
    rest = F.greatest(F.col("own") - F.col("head"), F.lit(0))
    convs = common.saved(convs.select("conv", "base", "head", kept.alias("kept"), (kept + rest).alias("turns")), "conversations")
    of_base = turns.where(F.col("at") < HEADS - 1).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "kept"), "base")
    of_base = of_base.where("at < kept").select("conv", (F.col("at") + 1).alias("depth"), "x", "y", "chars")
    own = turns.where(F.col("at") >= heads).join(convs.select("conv", "head", "kept"), "conv")
    own = own.select("conv", (F.col("kept") + F.col("at") - F.col("head") + 1).alias("depth"), "x", "y", "chars")
    return common.saved(of_base.union(own), "rebuilt"), convs


def blocks(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k the whole blocks of 2^k turns: conv, i, x, y and the chars of the last turn."""
    found = [rows.select("conv", (F.col("depth") - 1).alias("i"), "x", "y", "chars")]
    for k in range(1, levels):
        second = F.col("i") % 2 == 1
        halves = [F.max(F.when(~second, F.col(c))).alias(f"{c}1") for c in "xy"] + [F.max(F.when(second, F.col(c))).alias(f"{c}2") for c in "xy"]
        pairs = found[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(
            *halves, F.max(F.when(second, F.col("chars"))).alias("chars"), F.count("*").alias("n")).where("n = 2")
        found.append(common.saved(pairs.select("conv", "i", *_name(F.lit(k), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), "chars"), "blocks"))
    return found


def prefixes(rows: DataFrame, levels: int) -> DataFrame:
    """conv, depth, x, y (name of the prefix), chars of its last turn."""
    halves, named = blocks(rows, levels), None
    for k in reversed(range(levels)):
        # The first half of each stretch of 2^(k+1) turns ends at its cut.
        cuts = halves[k].where(F.col("i") % 2 == 0).select(
            "conv", F.shiftleft("i", k).alias("begin"), F.shiftleft(F.col("i") + 1, k).alias("depth"), F.col("x").alias("bx"), F.col("y").alias("by"), "chars")
        parts = []
        if named is not None:
            before = named.select("conv", F.col("depth").alias("begin"), F.col("x").alias("ax"), F.col("y").alias("ay"))
            parts.append(cuts.where("begin > 0").join(before, ["conv", "begin"]))
        parts.append(cuts.where("begin = 0").select("*", F.lit(0).cast("long").alias("ax"), F.lit(0).cast("long").alias("ay")))
        level = None
        for part in parts:
            part = part.select("conv", "depth", *_name(F.lit(-1), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), "chars")
            level = part if level is None else level.union(part)
        level = common.saved(level, "prefixes")
        named = level if named is None else named.union(level)
    for done in halves[1:]:
        common.discard(done)
    return named


def grafted(nodes: DataFrame, named: DataFrame, levels: int) -> DataFrame:
    """Nodes with n_leaves and saved_tokens of their whole subtrees; before, these are their own."""
    tree = nodes
    for k in range(levels):
        roots = tree.where(F.col("depth").bitwiseAND(F.lit((2 << k) - 1)) == 1 << k)
        if k == 0:
            above = roots.select(F.col("px").alias("x"), F.col("py").alias("y"), "n_leaves", "saved_tokens")
        else:
            ancestors = F.sequence(F.col("depth") - (1 << k), F.col("depth") - 1)
            up = roots.select(F.col("conv_id").alias("conv"), F.explode(ancestors).alias("depth"), "n_leaves", "saved_tokens")
            above = up.where("depth > 0").join(named.select("conv", "depth", "x", "y"), ["conv", "depth"]).select("x", "y", "n_leaves", "saved_tokens")
            zero = F.lit(0).cast("long")
            above = above.union(up.where("depth = 0").select(zero, zero, "n_leaves", "saved_tokens"))
        more = above.groupBy("x", "y").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        joined = tree.join(more, ["x", "y"], "left")
        grown = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        tree = common.saved(joined.select("x", "y", "px", "py", "depth", "conv_id", "n_convs", "n_children", *grown), "tree")
    return tree


def digests(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256 of the sorted ids ``conv`` of each node."""

    def pack(batches):
        node, ids = None, []

        def row():
            text = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([text], pa.binary())], ["x", "y", "first", "ids"])

        for batch in batches:
            for x, y, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node != (x, y) or len(ids) >= CHUNK:
                    if ids:
                        yield row()
                    node, ids = (x, y), []
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches):
        node, hashed = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([hashed.hexdigest()])], ["x", "y", "ends_sha256"])

        for batch in batches:
            for i in range(batch.num_rows):
                here, ids = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                if here == node:
                    hashed.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, hashed = here, hashlib.sha256()
                hashed.update(ids)
        if node is not None:
            yield row()

    chunks = ends.repartitionByRange("conv").sortWithinPartitions("x", "y", "conv").select("x", "y", "conv").mapInArrow(pack, "x long, y long, first long, ids binary")
    return chunks.repartition("x", "y").sortWithinPartitions("x", "y", "first").select("x", "y", "ids").mapInArrow(digest, "x long, y long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(ordered_turns(conversations))
    longest = convs.agg(F.max("turns")).first()[0] or 0
    levels = max(1, longest.bit_length())
    named = prefixes(rows, levels)
    zero = F.lit(0).cast("long")
    found = named.groupBy("x", "y", "depth").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"))
    above = named.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"))
    columns = ["x", "y", "px", "py", "depth", "conv_id", "n_convs", (F.col("chars") * (F.col("n_convs") - 1)).alias("saved_tokens")]
    inner = found.where("depth > 1").join(above, ["conv_id", "depth"]).select(*columns)
    tops = found.where("depth = 1").select("*", zero.alias("px"), zero.alias("py")).select(*columns)
    nodes = common.saved(inner.union(tops), "nodes")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"),
                       zero.alias("depth"), "conv_id", "n_convs", zero.alias("saved_tokens"))
    nodes = nodes.union(root)
    children = nodes.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = counted.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    tree = grafted(common.saved(own, "own"), named, levels)
    ending = convs.select("conv", F.col("turns").alias("depth"))
    ends = ending.where("depth > 0").join(named, ["conv", "depth"]).select("conv", "x", "y").union(ending.where("depth = 0").select("conv", zero, zero))
    parents = tree.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return tree.join(parents, ["px", "py"], "left").join(digests(ends), ["x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return trie(common.table(spark, sf_dir, "conversations"))


SQL = """
with recursive turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as at
  from conversations where conv_id is not null),
lengths as (select c, count(*) as own from turns group by c),
bytes as (select c, own, 1 as i, cast(4294967295 as bigint) as crc from lengths
  union all
  select c, own, i + 1, list_reduce(list_prepend(xor(crc, cast(ascii(substr(c::varchar, i, 1)) as bigint)), range(8)),
    lambda a, b: xor(a >> 1, cast(3988292384 as bigint) * (a & 1)))
  from bytes where i <= length(c::varchar)),
heads as (select c, own, xor(crc, cast(4294967295 as bigint)) % 6 as h from bytes where i = length(c::varchar) + 1),
convs as (select a.c, a.own, a.h, a.c - a.c % 100 as base, least(a.h, coalesce(b.own, 0)) as kept
  from heads a left join lengths b on b.c = a.c - a.c % 100),
rebuilt as (
  select v.c, t.at + 1 as depth, t.role, t.text from convs v join turns t on t.c = v.base and t.at < v.kept
  union all
  select v.c, v.kept + t.at - v.h + 1, t.role, t.text from convs v join turns t on t.c = v.c and t.at >= v.h),
names as (select c, depth, length(text) as chars, string_agg(md5(length(role) || ':' || role || text), ',') over (partition by c order by depth) as name
  from rebuilt union all select c, 0, 0, '' from convs),
member as (select c, depth, chars, depth || ':' || md5(name) as node from names),
ends as (select c, max(depth) as depth from member group by c),
nodes as (select node, depth, min(c) as conv_id, count(*) as n_convs, max(chars) as chars from member group by node, depth),
up as (select distinct lower.node, upper.node as above, upper.depth from member lower join member upper on upper.c = lower.c and upper.depth <= lower.depth),
parents as (select u.node, p.node as above, p.conv_id as parent_conv_id from up u join nodes n on n.node = u.node join nodes p on p.node = u.above
  where p.depth = n.depth - 1),
children as (select above, count(*) as n_children from parents group by above),
totals as (select u.above, count(*) filter (k.n_children is null) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
  from up u join nodes n on n.node = u.node left join children k on k.above = u.node group by u.above),
digests as (select m.node, sha256(string_agg(e.c::varchar, ',' order by e.c)) as ends_sha256 from ends e join member m on m.c = e.c and m.depth = e.depth group by m.node)
select n.conv_id, n.depth::bigint as depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, t.n_leaves,
  t.saved_tokens::bigint as saved_tokens, coalesce(d.ends_sha256, sha256('')) as ends_sha256
from nodes n left join parents p on p.node = n.node left join children k on k.above = n.node join totals t on t.above = n.node
  left join digests d on d.node = n.node
"""
