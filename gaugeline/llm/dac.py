"""Directly addressable codes for token ids.

An id is split into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of all ids that have one, and a bitmap
that tells which of them continue on level k + 1.  A rank directory counts the ones before every 512 bits, so the place of
an id's next chunk is known at once and any token is read without decoding others.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A container of documents: (doc_id, ids as little-endian unsigned 32-bit integers) in their order."""
    known = np.array([d is not None for d, _ in docs], np.uint8)
    names = np.array([d or 0 for d, _ in docs], "<i8")
    lengths = np.array([len(x) // 4 for _, x in docs], "<u8")
    values = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    levels = []
    while True:
        more = values > 255
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % (BLOCK // 8))
        ones = _ONES[np.frombuffer(bits, np.uint8)].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.empty(0, "<u8")
        levels.append((len(values), (values & 255).astype(np.uint8).tobytes(), bits, rank.tobytes()))
        values = values[more] >> 8
        if not len(values):
            break
    head = struct.pack("<4sQI", MAGIC, len(docs), len(levels)) + b"".join(struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels)
    return head + names.tobytes() + known.tobytes() + lengths.tobytes() + b"".join(c + b + r for _, c, b, r in levels)


class Container:
    """Reads a packed container in place."""

    def __init__(self, data: bytes):
        magic, n, k = struct.unpack_from("<4sQI", data)
        if magic != MAGIC:
            raise ValueError("not a container of token ids")
        at = struct.calcsize("<4sQI")
        sizes = [struct.unpack_from("<QQQ", data, at + 24 * i) for i in range(k)]
        at += 24 * k
        names = np.frombuffer(data, "<i8", n, at)
        known = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.docs = [int(x) if y else None for x, y in zip(names, known, strict=True)]
        at += 9 * n
        self.lengths = np.frombuffer(data, "<u8", n, at).astype(np.int64)
        at += 8 * n
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.levels = []
        for size, n_bits, n_rank in sizes:
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + size)
            rank = np.frombuffer(data, "<u8", n_rank // 8, at + size + n_bits)
            self.levels.append((chunks, bits, rank))
            at += size + n_bits + n_rank

    def token(self, i: int) -> int:
        """The i-th id of the container: one look per level."""
        if not 0 <= i < self.starts[-1]:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * (BLOCK // 8):i >> 3]
            i = int(rank[block]) + int(_ONES[before].sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
        return value

    def ids(self) -> np.ndarray:
        """All ids, as unsigned 32-bit integers."""
        out, where = None, None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if out is None:
                out = chunks.astype("<u4")
                where = np.arange(len(chunks))
            else:
                out[where] |= chunks.astype("<u4") << (8 * k)
            where = where[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
        return out
