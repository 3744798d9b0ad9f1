"""Byte-pair encoding as a finite-state transducer, and decoding as an incremental state machine.

A word is a string over 512 base symbols: a byte, or a byte that ends the word.  The encoding of a prefix is a path of
valid neighbours: two tokens may stand next to each other exactly if encoding their joined symbols gives these two
tokens back.  So a state only has to remember, for every suffix that can still grow into a longer token, the token
that ends where this suffix begins and how many tokens come before.  States are built when they are first met and then
reused, up to ``MAX_STATES``; after that the automaton starts anew, so memory is bounded.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from functools import lru_cache

import regex

MAX_STATES = 300_000
MAX_PAIRS = 2_000_000
END = "</w>"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merge list of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        chars = byte_chars()
        self.base = [self.vocab[c] for c in chars] + [self.vocab[c + END] for c in chars]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.symbols: dict[int, tuple[int, ...]] = {t: (i,) for i, t in enumerate(self.base)}
        self.order: list[tuple[int, int]] = []
        for left, right in spec["model"]["merges"]:
            a, b, new = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.ranks.setdefault((a, b), (len(self.order), new))
            self.symbols.setdefault(new, self.symbols[a] + self.symbols[b])
            self.order.append((a, b))
        self.longest = max(map(len, self.symbols.values()))

    def apply(self, symbols: tuple[int, ...]) -> list[int]:
        """Encode by the definition: always the pair of lowest rank, leftmost first.  For short inputs only."""
        tokens = [self.base[s] for s in symbols]
        while len(tokens) > 1:
            found = min(((self.ranks[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.ranks), default=None)
            if found is None:
                break
            i = found[1]
            tokens[i:i + 2] = [self.ranks[tokens[i], tokens[i + 1]][1]]
        return tokens

    def lookahead(self) -> int:
        """Symbols after a position beyond which nothing can change the tokens before it.

        A change at the right moves left only through merges of rising rank whose right part shares its left edge with
        the left part of the merge before.  The longest such chain, counted in symbols, bounds how far it can reach;
        it is found by one pass over the merges from the highest rank down.
        """
        at: dict[tuple[int, ...], int] = {}      # longest chain of merges whose right part has exactly these symbols
        under: dict[tuple[int, ...], int] = {}   # the same over all right parts that begin with these symbols
        best = 0
        for a, b in reversed(self.order):
            left, right = self.symbols[a], self.symbols[b]
            reach = under.get(left, 0)
            for k in range(1, len(left)):
                reach = max(reach, at.get(left[:k], 0))
            reach += len(left)
            best = max(best, reach)
            at[right] = max(at.get(right, 0), reach)
            for k in range(1, len(right) + 1):
                if under.get(right[:k], 0) < reach:
                    under[right[:k]] = reach
        return best + self.longest


class Transducer:
    """Reads base symbols of a word; every transition tells the last token so far and by how much the count changes."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, symbols in merges.symbols.items():
            if len(symbols) > 1 and merges.apply(symbols) != [t]:
                continue  # never the result of encoding
            node = 0
            for s in symbols:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][s]
            self.token[node] = t
        self.length = {t: len(s) for t, s in merges.symbols.items()}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.ids = {start: 0}
        self.entries = [start]
        self.last = [-1]
        self.next: dict[int, int] = {}    # state << 9 | symbol -> state << 8 | change of the count + 128

    def fits(self, a: int, b: int) -> bool:
        key = a << 17 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.m.apply(self.m.symbols[a] + self.m.symbols[b]) == [a, b]
            self.pairs[key] = known
        return known

    def step(self, state: int, symbol: int) -> int:
        """Build a transition that was not met before."""
        grown, found = [], None
        for node, before, count in self.entries[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token >= 0 and (before < 0 or self.fits(before, token)):
                found = token, count + 1
            if self.children[child]:
                grown.append((child, before, count))
        token, change = found
        entries = ((0, token, 0), *((node, before, count - change) for node, before, count in grown))
        new = self.ids.get(entries)
        if new is None:
            new = self.ids[entries] = len(self.entries)
            self.entries.append(entries)
            self.last.append(token)
        value = self.next[state << 9 | symbol] = new << 8 | change + 128
        return value

    def count(self, word: bytes) -> int:
        """The number of tokens: the sum of what the transitions add."""
        if len(self.entries) > MAX_STATES:
            self.reset()
        state, total, get = 0, 0, self.next.get
        for s in (*word[:-1], word[-1] + 256):
            value = get(state << 9 | s)
            if value is None:
                value = self.step(state, s)
            state = value >> 8
            total += (value & 255) - 128
        return total

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word, by a stream whose hold-back is the sufficient lookahead."""
        if len(self.entries) > MAX_STATES:
            self.reset()
        if len(word) > 256:
            stream = Stream(self)
            out = [t for s in (*word[:-1], word[-1] + 256) for t in stream.feed(s)]
            return out + stream.flush()
        state, path, get = 0, [], self.next.get
        for s in (*word[:-1], word[-1] + 256):
            value = get(state << 9 | s)
            if value is None:
                value = self.step(state, s)
            state = value >> 8
            path.append(state)
        return self.back(path, len(path), 0)

    def back(self, path: list[int], end: int, begin: int) -> list[int]:
        out, last, length = [], self.last, self.length
        while end > begin:
            token = last[path[end - 1]]
            out.append(token)
            end -= length[token]
        return out[::-1]


class Stream:
    """Emits tokens once no continuation can change them; holds at most about twice the lookahead in symbols."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.hold = lookahead(transducer.m)
        self.state, self.ends, self.emitted = 0, [], 0

    def feed(self, symbol: int) -> list[int]:
        t = self.t
        value = t.next.get(self.state << 9 | symbol)
        if value is None:
            value = t.step(self.state, symbol)
        self.state = value >> 8
        self.ends.append(t.last[self.state])
        return self.settle() if len(self.ends) >= 2 * self.hold else []

    def settle(self) -> list[int]:
        """Tokens before the place where all the paths that can still be continued meet."""
        n, t = len(self.ends), self.t
        live = {n}
        for k in range(1, min(t.m.longest, n) + 1):
            live.add(n - k)
        while len(live) > 1:
            j = max(live)
            live.discard(j)
            if j > 0:
                live.add(max(0, j - t.length[self.ends[j - 1]]))
        cut = live.pop()
        out = self._tokens(cut)
        del self.ends[:cut]
        return out

    def flush(self) -> list[int]:
        out = self._tokens(len(self.ends))
        self.state, self.ends = 0, []
        return out

    def _tokens(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.ends[end - 1])
            end -= self.t.length[out[-1]]
        return out[::-1]


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(Merges(path))


_LOOKAHEAD: dict[int, int] = {}


def lookahead(merges: Merges) -> int:
    if id(merges) not in _LOOKAHEAD:
        _LOOKAHEAD[id(merges)] = merges.lookahead()
    return _LOOKAHEAD[id(merges)]


# How this vocabulary's tokenizer cuts normalised text into words, and what it takes for white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Python's split() also breaks at these.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def lower(text: str) -> str:
    """Lower case letter by letter: a sigma at the end of a word is like any other."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def pieces(text: str) -> list[str]:
    """The stretches between white space.  No word, special token or composed character crosses white space."""
    if NOT_SPACE.search(text):
        return [x for x in SPACE.split(text) if x]
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()  # nothing to compose here, so lower case may come first and more pieces are equal
        except UnicodeEncodeError:
            pass
    return text.split()


class Cutter:
    """Words of a piece, as UTF-8.  Characters newer than the interpreter's Unicode tables are left to the library's own
    normaliser and cutter, as the libraries differ in what they know of them."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        self.bytes = {c: b for b, c in enumerate(byte_chars())}
        self.assigned: set[str] = set()  # characters met that the interpreter knows

    def __call__(self, part: str) -> list[bytes]:
        if not part.isascii():
            if not self.assigned.issuperset(part):
                if any(c > "\u024f" and unicodedata.category(c) == "Cn" for c in part):
                    return self._new(part)
                self.assigned.update(part)
            part = unicodedata.normalize("NFC", part)
        return [w.encode() for w in WORDS.findall(lower(part))]

    def _new(self, part: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.bytes.__getitem__, w)) for w, _ in found]


#: What one memo may take.
MEMO_BYTES = 96 << 20


class Memo:
    """Remembers what became of a piece of text.

    Long pieces are worked out anew each time, and when the pieces and their results may fill ``limit`` bytes, all but those met since
    the last time are forgotten; so the size is bounded in any script.
    """

    LONGEST = 64
    ENTRY = 200  # bytes that an entry takes besides its texts

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.known, self.older, self.size = {}, {}, 0

    def one(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.LONGEST:
            self.known[key] = found
            self.size += self.ENTRY + 2 * len(key) + (4 if isinstance(found, int) else len(found))
        return found

    def all(self, keys: list) -> list:
        out = list(map(self.known.get, keys))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    out[i] = self.known.get(keys[i])
                    if out[i] is None:
                        out[i] = self.one(keys[i])
                        if self.size > self.limit // 2:
                            self.older, self.known, self.size = self.known, {}, 0
        return out


class Pieces:
    """Whole texts to ids by pieces; how a word is encoded is left to ``word``."""

    def __init__(self, path: str, special: dict[str, int]):
        self.cut = Cutter(path)
        self.specials = special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else re.compile("(?!)()")
        self.encoded = Memo(self._encode, MEMO_BYTES)

    def word(self, w: bytes) -> list[int]:
        raise NotImplementedError

    def parts(self, piece: str):
        """(special token or None, words) of a piece; special tokens are found before the text is normalised."""
        if "<|" not in piece:
            yield None, self.cut(piece)
            return
        for i, part in enumerate(self.special.split(piece)):
            yield (self.specials[part], []) if i % 2 else (None, self.cut(part))

    def tokens(self, piece: str) -> list[int]:
        out = []
        for special, found in self.parts(piece):
            if special is not None:
                out.append(special)
            for w in found:
                out += self.word(w)
        return out

    def _encode(self, piece: str) -> bytes:
        ids = self.tokens(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.encoded.all(pieces(text)))


class Codec(Pieces):
    """Whole texts to ids and back, by the transducer."""

    def __init__(self, path: str):
        self.t = transducer(path)
        super().__init__(path, self.t.m.special)
        self.word = self.t.encode
        self.decoded = Memo(self._decode, MEMO_BYTES)
        self.counted = Memo(self.count, MEMO_BYTES)

    def _decode(self, ids: bytes) -> str:
        return " ".join(map(self.t.m.strings.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def count(self, piece: str) -> int:
        return sum((special is not None) + sum(map(self.t.count, found)) for special, found in self.parts(piece))

    def both(self, text: str) -> tuple[bytes, str]:
        """The ids, and the text that the library's decoder makes of them: token strings joined by spaces."""
        found = [x for x in self.encoded.all(pieces(text)) if x]
        return b"".join(found), " ".join(self.decoded.all(found))


class Decoder:
    """Ids to text, a token at a time: bytes that do not yet complete a character wait in the state."""

    def __init__(self, path: str):
        self.m = transducer(path).m
        self.bytes = {c: b for b, c in enumerate(byte_chars())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def joined(self, token: int) -> str:
        """The library's own form: token strings with a space between them."""
        out = self.m.strings.get(token, "")
        if not out:
            return ""
        out, self.first = out if self.first else " " + out, False
        return out

    def text(self, token: int) -> str:
        """Readable text: bytes to characters, a space after each word."""
        s = self.m.strings.get(token, "")
        if token in self.m.special.values():
            return self.utf8.decode(b"", True) + s
        body = s.removesuffix(END)
        out = self.utf8.decode(bytes(self.bytes[c] for c in body))
        return out + (self.utf8.decode(b"", True) + " " if s != body else "")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def release() -> None:
    """Let go of automata and memos: a worker process goes on to tasks of other operators, which have no use for them."""
    for held in (codec, transducer):
        held.cache_clear()
    _LOOKAHEAD.clear()
