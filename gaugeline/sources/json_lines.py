"""Readings from JSON lines: an object, an array of objects or several objects per line, also where the text is no proper JSON.

A line of flat objects in proper JSON, which is what loggers write, goes to Spark's JSON reader.  Any other line that holds a ``{`` is cut
into tokens (whole strings, marks, blanks, everything between) and read by a small state machine over them:

* an object begins at a ``{`` outside of arrays and strings; text around objects does not matter;
* a key is the next string, its value begins after the next colon; what stands between is skipped, and commas may be missing or too many;
* a value is a string, a nested array or object as it is written, or any text up to a comma or a closing mark (``nan``, ``+5``, ``abc``, or
  nothing);
* at the end of the line an object keeps the pairs that are complete.

Escapes in strings are decoded where all of a string's escapes are proper ones; otherwise the string stays as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shape of the text.
STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
PAIR = rf"\s*+{STRING}\s*+:\s*+(?:{STRING}|{NUMBER}|true|false|null)\s*+"
OBJECT = rf"\{{(?:{PAIR}(?:,{PAIR})*+)?+\s*+\}}"
PROPER = rf"^\s*+\[?+\s*+{OBJECT}(?:\s*+,?+\s*+{OBJECT})*+\s*+\]?+\s*+$"
NOTHING = r"^[\s,\[\]{}]*$"
TOUCHING_OBJECTS = r"\}\s*\{"
# Numbers whose text is changed by reading them as a number: trailing zeros, exponents, many digits, leading zeros.
FRAGILE_NUMBER = (
    r"\.(?:[0-9]*[1-9]0+|0{2,})[\s,}\]]|[0-9][eE]|[0-9]{16}|[0-9]{7}\.|\.[0-9]{15}|0\.00|-0[\s,}\]]|[:\s\[,]0[0-9]"
)
NEEDS_REPAIR = TOUCHING_OBJECTS + "|" + FRAGILE_NUMBER
PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'
NUMBER_TOKEN = r"-?[0-9][0-9.eE+\-]*"
# A whole string, a string that does not end, a mark, blanks, any other text.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|".*+|[{}\[\],:]|\s++|[^\s"{}\[\],:]++'
WHOLE_STRING = r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"$'

SCHEMA = "array<map<string,string>>"
_PAIRS = "array<struct<key:string,value:string,text:boolean>>"

# What the machine expects next.
OUTSIDE, BEHIND, FIELD, KEY, COLON, VALUE, PLAIN, NESTED, DONE = range(9)
# Objects are gathered in runs of this length, so that a line of many objects takes time in proportion.
RUN = 64


class _State(dict):
    """The columns of the machine's state; a list of objects is kept in runs."""

    @classmethod
    def of(cls, s: Column) -> _State:
        return cls({n: s[n] for n in ("mode", "depth", "key", "mark", "text", "pairs", "run", "runs")})

    def to(self, mode: int, **changes) -> _State:
        return _State(self | {"mode": F.lit(mode)} | changes)

    def paired(self, value: Column, text: bool, mode: int) -> _State:
        pair = F.struct(self["key"].alias("key"), value.alias("value"), F.lit(text).alias("text"))
        return self.to(mode, pairs=F.concat(self["pairs"], F.array(pair)), text=F.lit(""))

    def closed(self, mode: int) -> _State:
        """The object ends; one without pairs is none."""
        run = F.when(F.size(self["pairs"]) > 0, F.concat(self["run"], F.array(self["pairs"]))).otherwise(self["run"])
        full = F.size(self["run"]) >= RUN
        return self.to(
            mode, depth=F.lit(0), pairs=F.array().cast(_PAIRS), run=F.when(full, F.when(F.size(self["pairs"]) > 0, F.array(self["pairs"])).otherwise(
                F.array().cast(f"array<{_PAIRS}>"))).otherwise(run), runs=F.when(full, F.concat(self["runs"], F.array(self["run"]))).otherwise(self["runs"]))

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self.items()])


def _next(state: Column, token: Column) -> Column:
    s = _State.of(state)
    blank, whole = token.rlike(r"^\s"), token.rlike(WHOLE_STRING)
    broken = token.startswith('"') & ~whole
    same = s.struct()

    def deeper(by: int) -> Column:
        return s.to(OUTSIDE, depth=s["depth"] + by).struct()

    outside = (
        F.when((token == "{") & (s["depth"] == 0), s.to(FIELD).struct())
        .when(token.isin("{", "["), deeper(1)).when(token.isin("}", "]"), deeper(-1)).otherwise(s.to(OUTSIDE).struct())
    )
    key = F.when(whole, s.to(COLON, key=F.substring(token, 2, F.length(token) - 2)).struct()).when(broken, s.closed(DONE).struct())
    plain = F.rtrim(s["text"], F.lit(" \t\r\n"))
    # The end of a value that is neither a string nor nested; a "]" does not end the object.
    ended = (
        F.when(token == ",", s.paired(plain, False, FIELD).struct()).when(token == "}", s.paired(plain, False, FIELD).closed(BEHIND).struct())
        .when(token == "]", s.paired(plain, False, KEY).struct())
    )
    value = (
        F.when(blank, same).when(whole, s.paired(F.substring(token, 2, F.length(token) - 2), True, FIELD).struct())
        .when(broken, s.closed(DONE).struct())
        .when(token.isin("[", "{"), s.to(NESTED, mark=token, text=token, depth=F.lit(1)).struct())
        .when(token.isin(",", "}", "]"), ended).otherwise(s.to(PLAIN, text=token).struct())
    )
    closing = F.when(s["mark"] == "[", F.lit("]")).otherwise(F.lit("}"))
    longer = F.concat(s["text"], token)
    depth = s["depth"] + F.when(token == s["mark"], 1).when(token == closing, -1).otherwise(0)
    nested = F.when((token == closing) & (s["depth"] == 1), s.paired(longer, False, FIELD).to(FIELD, depth=F.lit(0)).struct()).otherwise(
        s.to(NESTED, text=longer, depth=depth).struct())
    mode = s["mode"]
    return (
        F.when(mode == FIELD, F.when(blank | (token == ","), same).when(token == "}", s.closed(BEHIND).struct()).otherwise(
            F.coalesce(key, s.to(KEY).struct())))
        .when(mode == COLON, F.when(token == ":", s.to(VALUE).struct()).otherwise(same))
        .when(mode == VALUE, value)
        .when(mode == PLAIN, F.when(token.isin(",", "}", "]"), ended).otherwise(s.to(PLAIN, text=longer).struct()))
        .when(mode == NESTED, nested)
        .when(mode == KEY, F.coalesce(key, same))
        .when(mode == BEHIND, F.when(blank | (token == ","), same).when(token == "]", s.to(DONE).struct()).otherwise(outside))
        .when(mode == OUTSIDE, outside)
        .otherwise(same)
    )


def _decoded(text: Column) -> Column:
    """A string's characters; as written if an escape is not a proper one."""
    read = F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")
    return F.when(F.contains(text, F.lit("\\")), F.coalesce(F.try_element_at(read, F.lit(1)), text)).otherwise(text)


def _loose_objects(line: Column) -> Column:
    """``ARRAY<MAP<STRING,STRING>>`` of any line that holds a ``{``."""
    start = _State(
        mode=F.lit(OUTSIDE), depth=F.lit(0), key=F.lit(""), mark=F.lit(""), text=F.lit(""), pairs=F.array().cast(_PAIRS),
        run=F.array().cast(f"array<{_PAIRS}>"), runs=F.array().cast(f"array<array<{_PAIRS}>>")).struct()
    tokens = F.regexp_extract_all(F.substring(line, F.instr(line, "{"), F.length(line)), F.lit(TOKEN), F.lit(0))

    def rest(state: Column) -> Column:
        s = _State.of(state)
        plain = F.rtrim(s["text"], F.lit(" \t\r\n"))
        return F.when(s["mode"] == PLAIN, s.paired(plain, False, DONE).closed(DONE).struct()).otherwise(s.closed(DONE).struct())

    # The end is a step of its own, so that the run over the tokens is computed once.
    last = F.transform(F.array(F.aggregate(tokens, start, _next)), rest)
    objects = F.flatten(F.transform(last, lambda s: F.flatten(F.concat(s["runs"], F.array(s["run"])))))

    def as_map(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: _decoded(p["key"]))
        named = F.transform(pairs, lambda p: F.struct(
            _decoded(p["key"]).alias("key"), F.when(p["text"], _decoded(p["value"])).otherwise(p["value"]).alias("value")))
        return F.map_from_entries(F.filter(named, lambda p, i: F.array_position(keys, p["key"]) == i + 1))

    return F.transform(objects, as_map)


def _repaired(text: Column) -> Column:
    """Put commas between touching objects, and quotes around numbers so that these keep their text."""

    def outside_strings(token: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(token, TOUCHING_OBJECTS, "},{"), NUMBER_TOKEN, '"$0"')

    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, lambda t: F.when(t.startswith('"'), t).otherwise(outside_strings(t))), "")


def _with_objects(lines: DataFrame) -> DataFrame:
    """Add ``_objects`` (``ARRAY<MAP<STRING,STRING>>``); every step is a projection of its own, so that none is computed twice."""
    columns = lines.columns
    value = F.col("value")
    judged = lines.select("*", value.rlike(PROPER).alias("_proper"))
    cut = judged.select(*columns, F.when(F.col("_proper"), F.regexp_extract(value, r"(?s)\{.*\}", 0)).alias("_text"))
    text = F.col("_text")
    ready = cut.select(*columns, F.when(text.rlike(NEEDS_REPAIR), _repaired(text)).otherwise(text).alias("_text"))
    proper = F.from_json(F.concat(F.lit("["), text, F.lit("]")), SCHEMA, {"allowSingleQuotes": "false"})
    return ready.select(*columns, F.when(text.isNotNull(), F.coalesce(proper, _loose_objects(value))).otherwise(_loose_objects(value)).alias("_objects"))


def _first_keys(fields: Column) -> Column:
    """The map with the first of equal keys, and with JSON null as the text ``null``."""
    keys = F.map_keys(fields)
    entries = F.filter(F.map_entries(fields), lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    distinct = F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(entries)).otherwise(fields)
    return F.transform_values(distinct, lambda _, v: F.coalesce(v, F.lit("null")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Replace ``value`` by ``pos, fields``: one row per non-empty object."""
    places = [c for c in lines.columns if c != "value"]
    read = _with_objects(lines.where(F.contains("value", F.lit("{"))))
    # Of an inner explode Spark would derive a filter on the array, move it below and parse every line twice.
    objects = read.select(*places, F.posexplode_outer("_objects").alias("pos", "_fields"))
    return objects.where(F.size("_fields") > 0).select(*places, "pos", _first_keys(F.col("_fields")).alias("fields"))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Lines in which there is something, but no reading."""
    something = lines.where(~F.col("value").rlike(NOTHING))
    read = _with_objects(something).where(~F.exists("_objects", lambda o: F.size(o) > 0))
    return read.select(*lines.columns)
