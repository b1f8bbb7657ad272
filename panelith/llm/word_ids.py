"""Token ids of texts for a word-level vocabulary file, worked out for whole batches at once.

A batch of texts is one array of characters: a table of character classes gives the words' ends,
words are read as three 8-byte numbers and looked up in a hash table of bounded size, and what is
new in the batch is merged at once (``Merger``).  Words of 24 bytes and more are kept apart.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .bpe import Merger, WordPieces, load_table, normal, split_special
from .tables import slices

SPACE, LETTER, NUMBER, OTHER = range(4)
_WIDE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_EIGHT, _TOP = np.uint64(8), np.uint64(56)


#: Letters and numbers newer than Unicode 16, which the file's library takes for
#: unassigned (first and last of each run).
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every character, as the file's pattern has it."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for a, z in UNKNOWN:
        out[a : z + 1] = OTHER
    return out


def word_ends(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of letters, single numbers, runs of other characters, and
    an apostrophe at the start of such a run with s, t, re, ve, m, ll or d after it."""
    kind = classes()[chars]
    n = len(kind)
    before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
    starts = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    breaks = starts | ((kind == SPACE) & (before != SPACE))
    quote = np.flatnonzero((chars == 39) & (before != OTHER))
    if len(quote):
        padded = np.concatenate([chars, np.zeros(3, chars.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            starts[at + 1] = breaks[at + 1] = False
            end = at + size
            end = end[end < n]
            end = end[kind[end] == LETTER]
            starts[end] = breaks[end] = True
    begin, every = np.flatnonzero(starts), np.append(np.flatnonzero(breaks), n)
    return begin, every[np.searchsorted(every, begin, side="right")]


class WordTable:
    """Ids of words of up to 23 bytes, by their bytes."""

    def __init__(self, merger: Merger, kind: str, bits: int = 20):
        self.merger, self.kind, self.bits = merger, np.dtype(kind), bits
        self.clear()

    def clear(self) -> None:
        # bytes 0-7, 8-15, 16-22 with the length on top (0: free), place of the ids << 8 | their number
        self.rows = np.zeros((1 << self.bits, 4), np.uint64)
        self.ids, self.used, self.words = np.empty(1 << self.bits, self.kind), 0, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys[:, 0] ^ (keys[:, 1] * _MIX[1]) ^ (keys[:, 2] * _MIX[2])) * _MIX[0]
            h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The last column of each key's row; 0 where there is none."""
        out = np.zeros(len(keys), np.uint64)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            row, mine = self.rows[at], keys[left]
            hit = (row[:, 0] == mine[:, 0]) & (row[:, 1] == mine[:, 1]) & (row[:, 2] == mine[:, 2])
            out[left[hit]] = row[hit, 3]
            on = ~hit & (row[:, 2] != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges words that are not in the table, each once; returns their last columns."""
        last = np.zeros(len(keys), np.uint64)
        for row, s in self.merger.rows(data, starts, sizes):
            there = s >= 0
            n = there.sum(axis=1)
            flat = s[there]
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            last[row] = ((self.used + np.cumsum(n) - n) << 8 | n).astype(np.uint64)
            self.used += len(flat)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[at, 2] == 0
            put, place = left[free], at[free]
            self.rows[place, 3] = put  # of those that want one place, one gets it
            mine = self.rows[place, 3] == put.astype(np.uint64)
            self.rows[place[mine]] = np.concatenate([keys[put[mine]], last[put[mine], None]], axis=1)
            done = np.zeros(len(left), bool)
            done[np.flatnonzero(free)[mine]] = True
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)
        self.words += len(keys)
        return last


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Ids of texts as packed little-endian integers of 2 or 4 bytes."""

    def __init__(self, path: str, width: int = 2, bits: int = 20):
        table = load_table(path)
        WordPieces(table)  # knows which settings of the file are understood
        self.merger, self.special, self.width = Merger(table), table.special, width
        self.table = WordTable(self.merger, f"<u{width}", bits)

    def _words(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each has.  raw: bytes, 24 more than needed."""
        table, short = self.table, sizes < 24
        eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
        begin, size = starts[short], sizes[short]
        keys = np.empty((len(begin), 3), np.uint64)
        for k in range(3):
            keys[:, k] = np.ascontiguousarray(eight[begin + 8 * k]).view("<u8").ravel() & _WIDE[np.clip(size - 8 * k, 0, 8)]
        keys[:, 2] |= size.astype(np.uint64) << _TOP
        if 2 * table.words > 1 << table.bits:
            table.clear()
        last = table.find(keys)
        new = np.flatnonzero(last == 0)
        if len(new):
            _, first, back = np.unique(keys[new].view([("", np.uint64)] * 3).ravel(), return_index=True, return_inverse=True)
            # a batch may bring more than the table has room for: then it grows
            while 4 * (table.words + len(first)) > 3 << table.bits:
                table.bits += 1
                table.clear()
                return self._words(raw, starts, sizes)
            one = new[first]
            last[new] = table.learn(keys[one], raw, begin[one], size[one])[back]
        counts, place = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        counts[short], place[short] = (last & np.uint64(255)).astype(np.int64), (last >> _EIGHT).astype(np.int64)
        if short.all():
            return table.ids[spans(place, counts)], counts
        long = np.flatnonzero(~short)
        words = self.merger.packed([raw[a : a + n].tobytes() for a, n in zip(starts[long].tolist(), sizes[long].tolist())], table.kind)
        counts[long] = [len(w) // self.width for w in words]
        out, ends = np.empty(int(counts.sum()), table.kind), np.cumsum(counts)
        out[spans((ends - counts)[short], counts[short])] = table.ids[spans(place[short], counts[short])]
        for i, w in zip(long.tolist(), words):
            out[ends[i] - counts[i] : ends[i]] = np.frombuffer(w, table.kind)
        return out, counts

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without special strings, and where each text's end."""
        parts = [normal(p) for p in parts]
        text = "\n".join(parts)
        raw = text.encode()
        if len(raw) == len(text):
            chars = np.frombuffer(raw, np.uint8)
            begin, end = starts, ends = word_ends(chars)
        else:
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            begin, end = word_ends(chars)
            size = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            at = np.concatenate([[0], np.cumsum(size)])
            starts, ends = at[begin], at[end]
        ids, counts = self._words(np.frombuffer(raw + b"\0" * 24, np.uint8), starts, ends - starts)
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = np.cumsum([len(p) + 1 for p in parts])
        return ids, total[np.searchsorted(begin, edges)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for a, z in slices(texts, chars=1 << 18):
            parts, owners = [], []
            for i in range(a, z):
                for part, special in split_special(texts[i], self.special):
                    parts.append(part)
                    owners.append((i - a, special))
            ids, ends = self._parts(parts)
            raw, at, done = ids.tobytes(), 0, [b""] * (z - a)
            for (i, special), end in zip(owners, (ends * self.width).tolist()):
                done[i] += raw[at:end] if special is None else raw[at:end] + special.to_bytes(self.width, "little")
                at = end
            out += done
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // self.width for x in self.encode(texts)]


@lru_cache(maxsize=2)
def word_encoder(path: str, width: int) -> WordEncoder:
    """One for all tasks of a Python worker, so that what it remembers stays."""
    return WordEncoder(path, width)


def width_of(path: str, end_id: int = 0) -> int:
    return 2 if max(load_table(path).size, end_id + 1) <= 1 << 16 else 4
