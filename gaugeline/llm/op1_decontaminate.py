"""Benchmark items that occur in documents.

Method: CGK random walks with bit-sampling LSH.  A walk reads the words of a window; at step j it writes the word it stands on and
moves on if the j-th random bit of that word is one.  Two windows at a small edit distance get strings at a small Hamming distance, as
the walks fall into step again.  Each of ``WALKS`` walks is sampled ``SAMPLES`` times at ``BITS`` steps; item-sized windows that agree with an
item in any sample are verified by the exact edit distance over words (Myers' bit vectors), at most ``RATE`` of the item's words.

Windows are taken where enough runs of words occur that any text within the threshold must share with an item: with k edits, one of the
k + 1 stretches between them has at least (w - k) / (k + 1) words, and w - n + 1 - n * k runs of n words are left on diagonals that
differ by at most 2 * k.  So no window that could pass is left out.

Items are sent to the tasks in blocks of at most ``MAX_ITEMS``; more items take more passes.  Defined results: null or empty texts and
items have no words and match nothing; items with equal texts are all found; repeated rows give repeated results; other columns are
ignored.  There is one row per document and item: the nearest place, the first among equals.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import ALNUM, batch_hashes, groups_of, mix, run_hashes

RATE = 0.2
WALKS = 8
SAMPLES = 5
BITS = 3
RUN = 3
MAX_ITEMS = 20_000
SCHEMA = "doc_id long, item_id long, first_word long, last_word long, distance int, item_words int, similarity double"
TABLE = 1 << 20
GROUP = 1 << 22


def walk(h: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """What the walks over windows [begin, end) write at each step: a row per step; 0 beyond the window."""
    out = np.zeros((steps, len(begin)), np.uint64)
    odd = mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)
    at = begin.copy()
    for j in range(steps):
        inside = at < end
        x = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        out[j] = x
        at += inside & (x * odd[j] >> np.uint64(63)).astype(bool)
    return out


def samples(width: int) -> list[tuple[int, np.ndarray]]:
    """(walk, steps) of each sample for windows of ``width`` words; a walk leaves such a window after about twice as many steps."""
    rng = np.random.default_rng(width)
    return [(w, np.sort(rng.choice(2 * width, size=min(BITS, 2 * width), replace=False))) for w in range(WALKS) for _ in range(SAMPLES)]


def signatures(h: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """A row of sample hashes for every window."""
    plan = samples(width)
    out = np.zeros((len(begin), len(plan)), np.uint64)
    for w in range(WALKS):
        mine = [(n, s) for n, (v, s) in enumerate(plan) if v == w]
        written = walk(h, begin, end, int(max(s[-1] for _, s in mine)) + 1, w)
        for n, steps in mine:
            total = np.full(len(begin), (n + 1) * 0x51ED27 + width, np.uint64)
            for s in steps:
                total = mix(total + written[s])
            out[:, n] = total
    return out


def best_place(pattern: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """Distance, begin and end of the stretch of ``text`` nearest to ``pattern``, if within ``most`` edits."""
    found = myers(pattern, text)
    if found is None or found[0] > most:
        return None
    distance, end = found
    # The same from the end backwards: the nearest begin, at the shortest stretch.
    _, back = myers(pattern[::-1], text[:end][::-1], anchored=True)
    return distance, end - back, end


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int] | None:
    """Smallest distance of the pattern to a stretch of the text that ends at some place, and the first such place.

    ``anchored``: the stretch begins at the text's begin.
    """
    m = len(pattern)
    if not m:
        return None
    at: dict[int, int] = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, x in enumerate(text):
        eq = at.get(x, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """A block of items with everything that tasks look up."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        rows = sorted((r for r in rows if r[1]), key=lambda r: r[0])
        h, cut = batch_hashes([t for _, t in rows], ALNUM)
        self.ids, self.words = [], []
        for (name, _), a, b in zip(rows, cut, cut[1:]):
            if b > a:
                self.ids.append(name)
                self.words.append(h[a:b])
        self.most = [int(rate * len(w)) for w in self.words]
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        keys: dict[int, list] = {}
        for i, w in enumerate(self.words):
            k = self.most[i]
            n = max(1, min(RUN, (len(w) - k) // (k + 1)))
            r = run_hashes(w, n)
            keys.setdefault(n, []).append((r, np.full(len(r), i), np.arange(len(r))))
        for n, parts in keys.items():
            r, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(r, kind="stable")
            table = np.zeros(TABLE, bool)
            table[r & np.uint64(TABLE - 1)] = True
            self.runs[n] = r[order], item[order], offset[order], table
        self.width = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array(self.most, np.int64)
        buckets = []
        for width in np.unique(self.width):
            mine = np.flatnonzero(self.width == width)
            begin = np.arange(len(mine)) * width
            sig = signatures(np.concatenate([self.words[i] for i in mine]), begin, begin + width, int(width))
            buckets.append((sig.ravel(), np.repeat(mine, sig.shape[1])))
        sig, item = (np.concatenate(x) for x in zip(*buckets, strict=True)) if buckets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.argsort(sig, kind="stable")
        self.sig, self.sig_item = sig[order], item[order]

    def windows(self, h: np.ndarray, doc_of: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Distinct (begin, width) near shared runs, inside one document."""
        out = []
        for n, (keys, item, offset, table) in self.runs.items():
            r = run_hashes(h, n)
            hit = np.flatnonzero(table[r & np.uint64(TABLE - 1)])
            lo, hi = np.searchsorted(keys, r[hit], "left"), np.searchsorted(keys, r[hit], "right")
            real = hi > lo
            hit, lo, hi = hit[real], lo[real], hi[real]
            hit_ok = doc_of[hit] == doc_of[np.minimum(hit + n - 1, len(h) - 1)]
            hit, lo, hi = hit[hit_ok], lo[hit_ok], hi[hit_ok]
            if not len(hit):
                continue
            where = np.repeat(hit, hi - lo)
            entry = np.arange(len(where)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            i, middle = item[entry], where - offset[entry]
            width, slack, doc = self.width[i], self.slack[i], doc_of[where]
            # With k edits at least w - n + 1 - n * k runs are shared, whose diagonals differ by at most 2 * k.
            least = np.maximum(1, width - n + 1 - n * slack)
            band = (middle + len(h)) // (2 * slack + 1)
            group, of, met = np.unique(np.stack([doc, i, band], 1), axis=0, return_inverse=True, return_counts=True)
            following = np.r_[(group[1:] == group[:-1] + [0, 0, 1]).all(1), False]
            after = np.where(following, np.r_[met[1:], 0], 0)
            before = np.r_[0, np.where(following, met, 0)[:-1]]
            use = np.maximum(met + after, met + before)[of.ravel()] >= least
            middle, width, slack, doc = middle[use], width[use], slack[use], doc[use]
            if not len(middle):
                continue
            for d in range(-int(slack.max()), int(slack.max()) + 1):
                near = np.abs(d) <= slack
                begin = np.maximum(middle[near] + d, cut[doc[near]])
                inside = begin < cut[doc[near] + 1]
                out.append(np.stack([begin[inside], width[near][inside]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)

    def found(self, h: np.ndarray, cut: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, distance) over a group of texts; places count from the begin of the text."""
        if not len(h) or not self.ids:
            return []
        doc_of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        windows = self.windows(h, doc_of, cut)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for width in np.unique(windows[:, 1]):
            begin = windows[windows[:, 1] == width, 0]
            doc = doc_of[begin]
            end = np.minimum(begin + width, cut[doc + 1])
            sig = signatures(h, begin, end, int(width))
            lo, hi = np.searchsorted(self.sig, sig, "left"), np.searchsorted(self.sig, sig, "right")
            done: dict[tuple[int, int], int] = {}
            for n in np.flatnonzero((hi > lo).any(1)):
                met = {int(x) for a, b in zip(lo[n], hi[n]) for x in self.sig_item[a:b]}
                d = int(doc[n])
                for i in met:
                    k, w = self.most[i], self.words[i]
                    a = max(int(begin[n]) - k, int(cut[d]))
                    b = min(int(begin[n]) + len(w) + 2 * k, int(cut[d + 1]))
                    if done.get((d, i), -1) >= b:
                        continue  # a stretch that holds this one was verified
                    place = best_place(w.tolist(), h[a:b].tolist(), k)
                    if place is None:
                        continue
                    done[d, i] = a + place[2]
                    row = (place[0], a + place[1] - int(cut[d]), a + place[2] - int(cut[d]))
                    if (d, i) not in best or row < best[d, i]:
                        best[d, i] = row
        return [(d, i, a, b, x) for (d, i), (x, a, b) in sorted(best.items())]


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, max_items: int = MAX_ITEMS) -> DataFrame:
    """A row for every document and item that occurs in it."""
    spark = docs.sparkSession
    common.ship(spark)
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    blocks = max(1, -(-named.count() // max_items))
    plain = common.texts(docs)
    passes = []
    for b in range(blocks):
        some = named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about max_items rows
        block = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in some], rate))

        def run(batches, block=block):
            known = block.value
            for batch in batches:
                rows = []
                for first, texts in groups_of(batch.column(1), GROUP):
                    for d, i, a, b, x in known.found(*batch_hashes(texts, ALNUM)):
                        w = len(known.words[i])
                        rows.append((batch.column(0)[first + d].as_py(), known.ids[i], a, b - 1, x, w, 1 - x / w))
                if rows:
                    values = list(zip(*rows, strict=True))
                    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.float64()]
                    names = [x.split()[0] for x in SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

        passes.append(plain.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, passes)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    dirty = leaks(docs, items, **options).select("doc_id").distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["doc_id"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
