"""License scans.

Method: ordered signature rules.  Every rule is a regular expression over the words of a text, with a keyword that must
occur before the expression is tried, a priority and a confidence.  Detections are intervals of words; one that lies inside
the interval of another of the same or a higher priority is suppressed.  The base phrases are rules of the highest priority and
are never suppressed; all their places count.

Rules are products of license names and sentence forms, identifiers behind their mark, and sentences of the licenses
themselves, so the set is extended by a line in ``NAMES``, ``FORMS``, ``IDENTIFIERS`` or ``BODIES``.

Defined results: a null or empty text has no words, null places, empty labels and score 0; a very long text is scanned whole, in
time in proportion to it and its detections; repeated rows are kept, and ties of detections go to the earlier rule; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Base phrases with their labels.
BASE = (
    (b"under the mit license", "mit"),
    (b"apache license version 2", "apache-2"),
    (b"cc by nc", "cc-by-nc"),
)

VERSION = r"(?: version| v)?"
# Label, keyword, words of the name.
NAMES = (
    ("mit", "mit", r"(?:mit|expat)(?: x11)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("apache-2", "apache", rf"apache(?: software)?(?: licen[cs]e)?{VERSION} 2(?: 0)?"),
    ("apache-1", "apache", rf"apache(?: software)? licen[cs]e{VERSION} 1(?: [01])?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("agpl-3", "affero", rf"(?:gnu )?affero general public licen[cs]e{VERSION} 3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: v ?|v| )3(?: 0)?"),
    ("lgpl-3", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{VERSION} 3(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{VERSION} 2 1"),
    ("lgpl-2", "library", rf"(?:gnu )?library general public licen[cs]e{VERSION} 2(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: v ?|v| )3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: v ?|v| )2 1"),
    ("gpl-3", "general", rf"(?:gnu )?general public licen[cs]e{VERSION} 3(?: 0)?"),
    ("gpl-2", "general", rf"(?:gnu )?general public licen[cs]e{VERSION} 2(?: 0)?"),
    ("gpl-1", "general", rf"(?:gnu )?general public licen[cs]e{VERSION} 1(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: v ?|v| )3(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: v ?|v| )2(?: 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|revised bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd)(?: licen[cs]e)?"),
    ("bsd-0-clause", "bsd", r"(?:0bsd|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-2", "mozilla", rf"mozilla public licen[cs]e{VERSION} 2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{VERSION} 1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2", "eclipse", rf"eclipse public licen[cs]e{VERSION} 2(?: 0)?"),
    ("epl-1", "eclipse", rf"eclipse public licen[cs]e{VERSION} 1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?|common development and distribution licen[cs]e"),
    ("artistic-2", "artistic", rf"artistic licen[cs]e{VERSION} 2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "zero", r"creative commons zero"),
    ("cc-by-nc-nd", "cc", r"(?:creative commons )?cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"(?:creative commons )?cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"(?:creative commons )?cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"(?:creative commons )?cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"(?:creative commons )?cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"(?:creative commons )?cc by(?: [1-4] [05])"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "commons", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc", "commons", r"creative commons licen[cs]e"),
    ("odbl", "database", r"open database licen[cs]e"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
)
# Priority, confidence, sentence form around a name.
FORMS = (
    (1, 1.0, r"spdx licen[cs]e identifier {}"),
    (2, 0.95, r"(?:licensed|released|distributed|published|provided|available|shared) under (?:the )?(?:terms of (?:the )?)?{}"),
    (2, 0.95, r"(?:work|software|program|file|document|text|content|library) is (?:\w+ ){{0,2}}under (?:the )?(?:terms of (?:the )?)?{}"),
    (3, 0.9, r"(?:subject to|governed by|under) (?:the )?(?:terms of )?(?:the )?{}"),
    (3, 0.85, r"{} (?:applies|as published by|see licen[cs]e|found in the licen[cs]e file)"),
    (4, 0.6, r"{}"),
)
# Label, keyword, words behind "SPDX-License-Identifier:".
IDENTIFIERS = (
    ("mit", "mit", "mit"), ("mit-0", "mit", "mit 0"), ("apache-2", "apache", "apache 2 0"), ("apache-1", "apache", "apache 1 [01]"),
    ("agpl-3", "agpl", "agpl 3 0(?: only| or later)?"), ("lgpl-3", "lgpl", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1(?: only| or later)?"), ("lgpl-2", "lgpl", "lgpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl", "gpl 3 0(?: only| or later)?"), ("gpl-2", "gpl", "gpl 2 0(?: only| or later)?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause"), ("bsd-3-clause", "bsd", "bsd 3 clause"), ("bsd-4-clause", "bsd", "bsd 4 clause"), ("bsd-0-clause", "0bsd", "0bsd"),
    ("isc", "isc", "isc"), ("mpl-2", "mpl", "mpl 2 0"), ("mpl-1.1", "mpl", "mpl 1 1"), ("epl-2", "epl", "epl 2 0"), ("epl-1", "epl", "epl 1 0"),
    ("cddl", "cddl", "cddl 1 [01]"), ("artistic-2", "artistic", "artistic 2 0"), ("boost", "bsl", "bsl 1 0"), ("zlib", "zlib", "zlib"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("eupl", "eupl", "eupl 1 [12]"), ("cc0", "cc0", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd [1-4] [05]"), ("cc-by-nc-sa", "cc", "cc by nc sa [1-4] [05]"), ("cc-by-nc", "cc", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc", "cc by nd [1-4] [05]"), ("cc-by-sa", "cc", "cc by sa [1-4] [05]"), ("cc-by", "cc", "cc by [1-4] [05]"),
    ("odbl", "odbl", "odbl 1 0"), ("ofl", "ofl", "ofl 1 1"),
)
# Label, keyword, words that only the text of the license itself has.
BODIES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms(?: \w+){1,140}? neither the name of(?: \w+){1,20}? may be used to endorse"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "hereby", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty"),
    ("boost", "obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
)


class Rule(NamedTuple):
    priority: int
    order: int
    keyword: bytes
    confidence: float
    label: str
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All products of names and forms, by priority and then by the order in which they are written."""
    made = []
    for priority, confidence, form in FORMS:
        for label, keyword, name in NAMES:
            pattern = re.compile(rf"(?<= ){form.format(f'(?:{name})')}(?= )".encode())
            made.append(Rule(priority, len(made), keyword.encode(), confidence, label, pattern))
    for priority, confidence, form, names in ((1, 1.0, "spdx licen[cs]e identifier {}", IDENTIFIERS), (2, 0.9, "{}", BODIES)):
        for label, keyword, words in names:
            pattern = re.compile(rf"(?<= ){form.format(f'(?:{words})')}(?= )".encode())
            made.append(Rule(priority, len(made), keyword.encode(), confidence, label, pattern))
    return sorted(made, key=lambda r: (r.priority, r.order))


@lru_cache(maxsize=1)
def gate() -> re.Pattern:
    """Any keyword of a rule, or the last word of a base phrase; a text without one has no detection."""
    words = {r.keyword for r in rules()} | {phrase.split()[-1] for phrase, _ in BASE}
    return re.compile(b"|".join(sorted(map(re.escape, words))))


WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Found(NamedTuple):
    begin: int
    end: int
    priority: int
    order: int
    label: str
    confidence: float


def base_places(joined: bytes) -> list[Found]:
    out = []
    for order, (phrase, label) in enumerate(BASE):
        needle, at = b" " + phrase + b" ", -1
        while (at := joined.find(needle, at + 1)) >= 0:
            out.append(Found(at + 1, at + len(needle) - 1, 0, order, label, 1.0))
    return out


def detections(joined: bytes) -> list[Found]:
    """What the rules find, without detections that lie inside another of the same or a higher priority."""
    found = base_places(joined)
    for r in rules():
        if r.keyword in joined:
            found += [Found(m.start(), m.end(), r.priority, r.order, r.label, r.confidence) for m in r.pattern.finditer(joined)]
    # By begin, longest first: what could contain an interval comes before it.
    found.sort(key=lambda x: (x.begin, -x.end, x.priority, x.order))
    kept: list[Found] = []
    reach: dict[int, int] = {}  # of each priority, how far the intervals so far go
    for x in found:
        inside = any(reach.get(p, -1) >= x.end for p in range(x.priority + 1))
        if x.priority == 0 or not inside:
            kept.append(x)
        reach[x.priority] = max(reach.get(x.priority, -1), x.end)
    return kept


def scan_text(text: str):
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_found."""
    data = text.encode().lower()
    if not gate().search(data):
        flags = _IS_WORD[np.frombuffer(data, np.uint8)]
        return int(flags[:1].sum()) + int(np.count_nonzero(flags[1:] & ~flags[:-1])), 0, None, None, "", "", 0.0, 0
    found = WORDS.findall(data)
    joined = b" " + b" ".join(found) + b" "
    kept = detections(joined)
    base = [x for x in kept if x.priority == 0]
    begins = [x.begin for x in base]
    first = joined.count(b" ", 0, min(begins)) - 1 if begins else None
    last = first + joined.count(b" ", min(begins), max(begins)) if begins else None
    return (
        len(found), len(base), first, last,
        ",".join(sorted({x.label for x in base})), ",".join(sorted({x.label for x in kept})),
        max((x.confidence for x in kept), default=0.0), len(kept),
    )


COLUMNS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("n_found", pa.int64()),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_found long"


def scan(df: DataFrame) -> DataFrame:
    """The licenses that each text names."""
    common.ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [scan_text(x.as_py()) for x in batch.column(1)]
            values = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
            arrays = [pa.array(v, t) for v, (_, t) in zip(values, COLUMNS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(n for n, _ in COLUMNS)])

    return common.texts(df).mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
