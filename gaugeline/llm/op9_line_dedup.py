"""Lines that repeat, up to one edit.

Method: segment-partition edit join.  With a threshold of one edit a line has two segments, one of which must occur unchanged in
any line within the threshold, at a place known from the lengths.  Every line posts its two segments in an index by length, and
probes with the two segments that a line of one character less would have there.  Lines that meet in an index entry are verified
with Spark's banded edit distance.

An entry in which many lines meet is not paired but cut further: the part that is not matched yet is split into ``WAYS`` segments,
all but one of which must be unchanged, until few lines are left or the unmatched part is one character; then all lines of an
entry are within the threshold of each other and one partner per line is enough.  So the pairs stay linear in the lines.

A line is removed if the same line comes earlier, by (doc_id, line number), or if any different line within one edit does.
Lines are compared without blanks at their ends; lines of fewer than ``MIN_CHARS`` characters are never removed.

Defined results: a null text is empty and has one empty line; rows with the same doc_id and different texts are documents of their
own (told apart by a hash of the text, which also orders them), rows that agree in both are one; a null doc_id comes before all others;
lines of any length take part, and of equal lines the earliest stays; an empty table gives no rows; other columns are kept by
``deduplicate`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 12
SMALL = 16
WAYS = 8
BITS = 1 << 26
BEFORE_ALL = str(-(1 << 63) - 1)  # below every 64-bit doc_id
ID = ["h1", "h2"]
ROW_BITS = 30


def row_of(text="text"):
    """Tells rows with the same doc_id apart."""
    return F.pmod(F.xxhash64(F.lit(11), F.coalesce(F.col(text), F.lit(""))), F.lit(1 << ROW_BITS)).alias("row_no")


def split_lines(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc_id, row_no, line_no, line of all lines that are long enough; ids by two independent 64-bit hashes."""
    least = MIN_CHARS if min_chars is None else max(1, min_chars)
    rows = docs.select("doc_id", row_of(), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "row_no", "line_no", F.trim("line").alias("line")).withColumn("len", F.length("line")).where(F.col("len") >= least)
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def halves(line, own, index_len) -> list:
    """Keys of the two segments that a line of ``index_len`` characters would have in this one."""
    half = F.floor(index_len / 2).cast("int")
    rest = (index_len - half).cast("int")
    return [
        F.xxhash64(F.lit("L"), index_len, F.substr(line, F.lit(1), half)),
        F.xxhash64(F.lit("R"), index_len, F.substr(line, own - rest + 1, rest)),
    ]


def place():
    """Where a line is, as one number in the order of (doc_id, row_no, line_no), null doc_ids first; a flat value can be folded by hash."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(BEFORE_ALL).cast("decimal(20,0)"))
    inside = F.col("row_no") * F.lit(1 << 31) + F.col("line_no")
    return (doc * F.lit(1 << (ROW_BITS + 31)).cast("decimal(19,0)") + inside.cast("decimal(19,0)")).cast("decimal(38,0)")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each different line once: where it comes first, how often, and its keys."""
    i0, i1 = halves(F.col("line"), F.col("len"), F.col("len"))
    p0, p1 = halves(F.col("line"), F.col("len"), F.col("len") - 1)
    keyed = lines.select(*ID, place().alias("place"), "len", i0.alias("i0"), i1.alias("i1"), p0.alias("p0"), p1.alias("p1"))
    return keyed.groupBy(*ID).agg(
        F.min("place").alias("place"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("len", "i0", "i1", "p0", "p1")])


def postings(firsts: DataFrame) -> DataFrame:
    """key, probe, index_len, prefix and suffix (characters matched so far) of every line."""
    def row(key, probe, left):
        size = F.col("len") - probe
        half = F.floor(size / 2).cast("int")
        return F.struct(
            F.col(key).alias("key"), F.lit(bool(probe)).alias("probe"), size.cast("int").alias("index_len"),
            (half if left else F.lit(0)).alias("prefix"), (F.lit(0) if left else (size - half).cast("int")).alias("suffix"))

    rows = F.array(row("i0", 0, True), row("i1", 0, False), row("p0", 1, True), row("p1", 1, False))
    return firsts.select(*ID, "place", F.explode(rows).alias("x")).select(*ID, "place", "x.*")


def sieve(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose hash may be among those wanted, before they are shuffled to find out; a bit table of ``BITS`` bits at most."""
    def bit(c):
        return (F.pmod(F.col(c), F.lit(BITS)) + 1).cast("long")

    table = wanted.select(F.bitmap_bucket_number(bit(column)).alias("_bucket"), F.bitmap_bit_position(bit(column)).alias("_at")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_at").alias("_bits"))
    at = F.bitmap_bit_position(bit(column))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    held = rows.withColumn("_bucket", F.bitmap_bucket_number(bit(column))).join(F.broadcast(table), "_bucket")
    return held.where(is_set).select(*rows.columns)


def sized(rows: DataFrame) -> DataFrame:
    """Postings whose entry holds an indexed line and another one, with the number of lines there."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("met"), F.count_if(~F.col("probe")).alias("indexed")).where("met > 1 and indexed > 0")
    sizes = common.saved(sizes, "sizes")
    return sieve(rows, "key", sizes).join(sizes, "key")


def pairs(rows: DataFrame) -> DataFrame:
    """Pairs of lines in entries of at most SMALL lines."""
    side = lambda t: [F.col(c).alias(f"{c}_{t}") for c in (*ID, "place")]
    few = rows.where(F.col("met") <= SMALL)
    a, b = few.select("key", F.col("probe").alias("probing"), *side("a")), few.where(~F.col("probe")).select("key", *side("b"))
    ordered = F.col("probing") | (F.struct("h1_a", "h2_a") < F.struct("h1_b", "h2_b"))
    return a.join(b, "key").where(ordered).select("h1_a", "h2_a", "place_a", "h1_b", "h2_b", "place_b").distinct()


def cut(rows: DataFrame) -> DataFrame:
    """Split what is unmatched: every new entry leaves one segment open and matches the others too."""
    open_len = F.col("index_len") - F.col("prefix") - F.col("suffix")
    ways = F.when(open_len < 2, 2).otherwise(F.least(open_len, F.lit(WAYS)))
    # One open character: an insertion is before or after it, nothing of the indexed line stays open.
    lo = F.when(open_len < 2, F.col("j") * open_len).otherwise(F.floor(F.col("j") * open_len / F.col("ways"))).cast("int")
    hi = F.when(open_len < 2, F.col("j") * open_len).otherwise(F.floor((F.col("j") + 1) * open_len / F.col("ways"))).cast("int")
    more = rows.withColumn("open", open_len).withColumn("ways", ways.cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    more = more.withColumn("lo", lo).withColumn("hi", hi).withColumn("tail", (F.col("open") - F.col("hi")).cast("int"))
    key = F.xxhash64(
        "key", "j", F.substr("line", F.col("prefix") + 1, F.col("lo")), F.substr("line", F.length("line") - F.col("suffix") - F.col("tail") + 1, F.col("tail")))
    return more.select(
        *ID, "place", "line", "probe", "index_len", key.alias("key"), (F.col("prefix") + F.col("lo")).alias("prefix"), (F.col("suffix") + F.col("tail")).alias("suffix"))


def near_edges(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2, earlier: lines with an earlier different line within one edit."""
    met = common.saved(sized(postings(firsts)), "met")
    wanted = met.select(*ID, "place").distinct()
    at = lines.select(*ID, "line", place().alias("place"))
    # An inner join with distinct rows: a semi join would be moved below the sieve, and all lines shuffled.
    texts = common.saved(sieve(at, "h1", wanted).join(wanted, [*ID, "place"]).dropDuplicates(ID).select(*ID, "line"), "lines")

    def named(t: str) -> DataFrame:
        return texts.select(F.col("h1").alias(f"h1_{t}"), F.col("h2").alias(f"h2_{t}"), F.col("line").alias(f"line_{t}"))

    close = F.levenshtein("line_a", "line_b", 1) >= 0
    found = [pairs(met).join(named("a"), ["h1_a", "h2_a"]).join(named("b"), ["h1_b", "h2_b"]).where(close)]
    hot = met.where(F.col("met") > SMALL).drop("met", "indexed").join(texts, ID)
    while True:
        hot = common.saved(hot, "hot")
        if hot.isEmpty():
            break
        level = common.saved(sized(cut(hot)), "level")
        small = level.where(F.col("met") <= SMALL)
        line = level.select(*ID, "line").dropDuplicates(ID)
        text = lambda t, line=line: line.select(*[F.col(c).alias(f"{c}_{t}") for c in (*ID, "line")])
        found.append(pairs(small).join(text("a"), ["h1_a", "h2_a"]).join(text("b"), ["h1_b", "h2_b"]).where(close))
        large = level.where(F.col("met") > SMALL)
        still = F.col("index_len") - F.col("prefix") - F.col("suffix")
        # All indexed lines of an entry with one open character are within one edit: the earliest is a partner of all.
        same = large.where((still <= 1) & ~F.col("probe"))
        earliest = same.groupBy("key").agg(F.min("place").alias("first"))
        found.append(as_edges(same.join(earliest, "key")))
        # With none open, the entry's one indexed line lacks one character of every probing line.
        whole = large.where(still == 0)
        target = whole.where(~F.col("probe")).groupBy("key").agg(F.min("place").alias("first"))
        found.append(as_edges(whole.where("probe").join(target, "key")))
        longer = whole.where("probe").groupBy("key").agg(F.min("place").alias("first"))
        found.append(as_edges(whole.where(~F.col("probe")).join(longer, "key")))
        hot = large.where(still >= 1).drop("met", "indexed")
        # With one open character only entries with probing lines have more to find.
        probing = hot.where("probe").select("key").distinct()
        hot = hot.where(still > 1).unionByName(hot.where(still == 1).join(probing, "key", "left_semi").select(hot.columns))
    edges = None
    for one in found:
        part = one if "earlier" in one.columns else one.select(
            F.when(F.col("place_a") < F.col("place_b"), F.col("h1_b")).otherwise(F.col("h1_a")).alias("h1"),
            F.when(F.col("place_a") < F.col("place_b"), F.col("h2_b")).otherwise(F.col("h2_a")).alias("h2"),
            F.least("place_a", "place_b").alias("earlier"))
        edges = part if edges is None else edges.unionByName(part)
    return edges.groupBy(*ID).agg(F.min("earlier").alias("earlier"))


def as_edges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("first") < F.col("place")).select(*ID, F.col("first").alias("earlier"))


def removed_lines(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc_id, row_no, line_no, near of all lines that are removed; near: not an exact copy of an earlier line."""
    lines = split_lines(docs, min_chars)
    firsts = common.saved(distinct_lines(lines), "firsts")
    near = common.saved(near_edges(lines, firsts), "near")
    known = firsts.select(*ID, "place", "n")
    maybe = known.where("n > 1").unionByName(sieve(known.where("n = 1"), "h1", near))  # other lines stay in any case
    judged = common.saved(
        maybe.join(near, ID, "left").where("n > 1 or earlier is not null").select(*ID, "place", F.col("earlier").isNotNull().alias("near")), "judged")
    at = sieve(lines.select(*ID, "doc_id", "row_no", "line_no"), "h1", judged)
    first = place().eqNullSafe(F.col("place"))
    return at.join(judged, ID).where(F.col("near") | ~first).select("doc_id", "row_no", "line_no", first.alias("near"))


def per_document(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc_id, row_no, lines removed as a sorted array, how many of them are copies and how many near copies."""
    return removed_lines(docs, min_chars).groupBy("doc_id", "row_no").agg(
        F.array_sort(F.collect_set("line_no")).alias("gone"), F.count_if(~F.col("near")).alias("n_copies"), F.count_if("near").alias("n_near"))


def deduplicate(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """The documents without the removed lines; one that loses all it had is gone.  ``n_chars`` follows if there is one."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), row_of().alias("doc_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = per_document(common.texts(docs), min_chars).select("doc_id", "row_no", "gone")
    same = F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("doc_row") == F.col("row_no"))
    marked = whole.join(gone, same, "left").select("row", "gone")
    left = F.array_join(F.filter(F.split(F.col("row")["text"], "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = marked.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(left).alias("left"))
    out = out.where(F.col("gone").isNull() | (F.trim("left") != ""))
    given = {"text": F.col("left"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("left")) if "n_chars" in docs.columns else None}
    return out.select(*[given.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go as copies and as near copies, and the numbers of those that go."""
    return line_counts(common.texts(common.table(spark, sf_dir, "documents")))


def line_counts(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_copies, n_near and removed of every row of ``docs`` (doc_id, text without nulls)."""
    gone = per_document(docs, min_chars).select(F.col("doc_id").alias("id"), F.col("row_no").alias("of"), "n_copies", "n_near", "gone")
    counted = docs.select("doc_id", row_of(), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return counted.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_no") == F.col("of")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


SQL = """
WITH lines AS (
    SELECT doc_id, i - 1 AS line_no, trim(parts[i]) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
          FROM documents)
    WHERE length(trim(parts[i])) >= 12
), firsts AS (
    SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS place FROM lines GROUP BY line
), met AS (
    SELECT a.line AS x, b.line AS y, a.place AS px, b.place AS py, b.n AS n FROM firsts a JOIN firsts b
    ON a.n = b.n AND a.line < b.line AND left(a.line, b.n // 2) = left(b.line, b.n // 2)
    UNION SELECT a.line, b.line, a.place, b.place, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n AND a.line < b.line AND right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2)
    UNION SELECT a.line, b.line, a.place, b.place, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n + 1 AND left(a.line, b.n // 2) = left(b.line, b.n // 2)
    UNION SELECT a.line, b.line, a.place, b.place, b.n FROM firsts a JOIN firsts b
    ON a.n = b.n + 1 AND right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2)
), close AS (
    SELECT * FROM met WHERE len(list_filter(range(0, n + 1),
        lambda p: left(x, p) = left(y, p) AND substr(x, p + 2) = substr(y, CASE WHEN length(x) = n THEN p + 2 ELSE p + 1 END))) > 0
), near AS (
    SELECT line FROM (SELECT CASE WHEN px < py THEN y ELSE x END AS line FROM close) GROUP BY line
), gone AS (
    SELECT l.doc_id, l.line_no, {'d': l.doc_id, 'l': l.line_no} = f.place AS near
    FROM lines l JOIN firsts f USING (line) LEFT JOIN near e USING (line)
    WHERE e.line IS NOT NULL OR {'d': l.doc_id, 'l': l.line_no} <> f.place
), per AS (
    SELECT doc_id, count(*) FILTER (NOT near) AS n_copies, count(*) FILTER (near) AS n_near,
           string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_copies, 0)::BIGINT AS n_copies,
       coalesce(n_near, 0)::BIGINT AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN per USING (doc_id)
"""
