"""Token ids of whole texts for the word-level BPE vocabulary, through a table of known chunks.

The tokenizer drops white space and never merges across it, so a text's ids are those of its
white-space-free chunks.  Chunks are found, hashed and looked up for many texts at once; a
chunk that is new to the worker is encoded once.  Encoding a chunk follows the tokenizer file:
Unicode NFC, lower case, split into contractions, letters, single digits and other marks, and
merges with a mark at the word's end.  The merges run in ``tiktoken`` with that mark as a
control character; a chunk with characters beyond Latin letters, with that character or with
the start of a special token is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from ._bytes import chunks, span_hash, words

_END = "\x01"
#: Texts with white space other than ASCII's, or with separators that only some readers count.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_PLAIN = re.compile("[\x02-\u024f]*")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class ChunkTable:
    """Ids of chunks by their 64-bit hashes: open addressing over numpy arrays."""

    def __init__(self, bits: int = 22) -> None:
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.start = np.zeros(1 << self.bits, np.int32)
        self.length = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is unknown."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(20)).astype(np.int64) & mask
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[slot[todo]]
            hit = k == h[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (k != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct hashes with their ids."""
        mask = np.int64((1 << self.bits) - 1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        starts = self.used + np.cumsum(n) - n
        slot = (h >> np.uint64(20)).astype(np.int64) & mask
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            done = free[self.keys[slot[free]] == h[free]]
            self.start[slot[done]], self.length[slot[done]] = starts[done], n[done]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.used += total
        self.n += len(h)


class WordTokenizer:
    """Ids of texts by a tokenizer file of this kind; one for each worker process."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else re.compile(r"(?!)")
        shown = {c: b for b, c in _shown_bytes().items()}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token in specials:
                continue
            last = token.endswith("</w>")
            ranks[bytes(shown[c] for c in (token[:-4] if last else token)) + (_END.encode() if last else b"")] = number
        self.bpe = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[n for k, n in ranks.items() if len(k) > 1 and k.endswith(_END.encode())]] = True
        self.table = ChunkTable()

    def slow(self, text: str) -> list[int]:
        return self.hf.encode(text, add_special_tokens=False).ids

    def pieces(self, s: str) -> list[str] | None:
        """A chunk's normalised pieces before merging; None if only the tokenizer itself will do."""
        if s.isascii():
            s2 = s.lower()
        elif _PLAIN.fullmatch(s):
            s2 = "".join([c.lower() for c in unicodedata.normalize("NFC", s)])
        else:
            return None
        if s2.isalpha() and s2.isascii():
            return [s2]
        return None if _END in s or "<|" in s or not _PLAIN.fullmatch(s2) else _PIECES.findall(s2)

    def new(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks, those of plain pieces by one call."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(raw)
        at, count, joined = [], [], []
        for i, s in enumerate(map(bytes.decode, raw)):
            if (p := self.pieces(s)) is None:
                out[i] = np.array(self.slow(s), np.uint32)
            else:
                at.append(i)
                count.append(len(p))
                joined += p
        if joined:
            ids = np.array(self.bpe.encode_ordinary(_END.join(joined) + _END), np.uint32)
            last = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(self.ends[ids]) + 1))
            cut = last[np.cumsum([0, *count])].tolist()
            for i, a, b in zip(at, cut[:-1], cut[1:], strict=True):
                out[i] = ids[a:b]
        return out

    def encode(self, texts: list[bytes | None]):
        """Yields (number of the text, its ids as little-endian unsigned 32-bit integers)."""
        for first, last, data, offsets in chunks(texts):
            s, e = words(data, _SPACE)
            h = span_hash(data, s, e)
            h[h == 0] = 1
            slot = self.table.find(h)
            if (new := np.flatnonzero(slot < 0)).size:
                if self.table.n + len(new) > (1 << self.table.bits) // 2:
                    self.table.clear()
                    new = np.arange(len(h))
                keys, at = np.unique(h[new], return_index=True)
                raw = data.tobytes()
                self.table.add(keys, self.new([raw[a:b] for a, b in zip(s[new[at]].tolist(), e[new[at]].tolist(), strict=True)]))
                slot = self.table.find(h)
            n = self.table.length[slot].astype(np.int64)
            end = np.cumsum(n)
            total = int(end[-1]) if len(end) else 0
            ids = self.table.pool[np.repeat(self.table.start[slot] - (end - n), n) + np.arange(total)].astype("<u4")
            cuts = np.concatenate((np.zeros(1, np.int64), end))[np.searchsorted(s, offsets)]
            for i in range(first, last):
                t = texts[i]
                if t and not t.isascii() and _ODD.search(t.decode("utf-8")) or t and any(c in t for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
                    yield i, np.array(self.slow(t.decode("utf-8")), "<u4")
                else:
                    yield i, ids[cuts[i - first] : cuts[i - first + 1]]


def _shown_bytes() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
