"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are hashed at once; each takes some 50 bytes while it is.
SLICE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and their inverses."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _ODD, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_ODD, -1, 1 << 64), np.uint64)])
    return up, down


def flags(*spans: tuple[int, int]) -> np.ndarray:
    """Which bytes are part of words: those in spans (first, last)."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a:b + 1] = True
    return out


#: Letters and digits after lower-casing, and every byte of characters beyond ASCII.
ALNUM = flags((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blanks.
VISIBLE = ~flags((0x20, 0x20), (0x09, 0x0D))


def _part(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], is_word[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    # One table serves all slices but those that a very long word makes longer.
    up, down = powers(2 * SLICE) if len(data) < 2 * SLICE else powers.__wrapped__(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[data] * up[:len(data)])])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of an already lower-cased text; long texts by slices that end between words."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= SLICE:
        return _part(raw, is_word)
    hashes, begins, at = [], [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and is_word[raw[end]]:
            end += 1
        h, b = _part(raw[at:end], is_word)
        hashes.append(h)
        begins.append(b + at)
        at = end
    return np.concatenate(hashes), np.concatenate(begins)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k:len(h) - n + 1 + k] * np.uint64((_ODD * (2 * k + 3)) & MASK | 1)
    return mix(out + np.uint64(n))


def batch_hashes(texts: list[str], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, and where the words of each begin (one more entry than texts)."""
    data = [t.encode().lower() for t in texts]  # lower() of bytes changes A-Z alone
    h, begin = word_hashes(b" ".join(data), is_word)
    ends = np.cumsum([len(x) + 1 for x in data]) if data else np.empty(0, np.int64)
    return h, np.concatenate([[0], np.searchsorted(begin, ends)]).astype(np.int64)


def groups_of(column, most_bytes: int = SLICE):
    """Texts of an Arrow column in groups of bounded size: (first row, texts)."""
    first, texts, size = 0, [], 0
    for i, x in enumerate(column):
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= most_bytes:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts
