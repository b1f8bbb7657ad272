"""Byte-pair merging shared by the encoder, the token counter and the record writer.

``MergeTable`` reads a tokenizer file (vocabulary, merge list, added tokens) whose path is a
parameter; nothing is trained or copied.  Two ways to apply the merge list are here:

* ``heap_merge``: a heap of adjacent pairs and a linked list of symbols; the lowest rank, and
  among equals the leftmost, is merged first.
* ``StreamingWord``: the same result from a window of constant size.  The merge list has a
  *sufficient lookahead*: bytes further away than that cannot change a token any more, so tokens
  that end early enough are emitted and forgotten (``MergeTable.lookahead``).

``Merger`` does what ``heap_merge`` does for many windows at once: every round merges the lowest
pair of every window.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex

#: The pre-tokenizer pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and ranked merges of one tokenizer file, in terms of token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-pair models are supported")
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        #: left id << 20 | right id  ->  (rank + 1) << 20 | merged id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        model["merges"] = ()  # what is kept is the table above
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens that strip or need normal text are not supported")
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes: dict[int, bytes] = {}
        for token, i in self.vocab.items():
            stem = token.removesuffix(self.suffix) if self.suffix else token
            self.token_bytes[i] = bytes(back[c] for c in stem)
        self.token_bytes.update({i: s.encode() for s, i in self.special.items()})

    @cached_property
    def lookahead(self) -> int:
        """Bytes to the right of a token's end beyond which nothing can change the token.

        Two texts that agree up to a point are merged alike up to a difference whose left edge
        starts at the first merge that crosses the point.  The edge moves left only by a later
        merge (a higher rank) whose right part starts at the edge, so its right part has the
        former left part on the left spine of its merge tree.  The longest such chain, in bytes,
        plus the longest token, is sufficient.  Merges are visited from the last to the first, so
        every chain found so far consists of higher ranks.
        """
        low = (1 << 20) - 1
        ranked = sorted((m >> 20, pair >> 20, pair & low, m & low) for pair, m in self.merges.items())
        parts = {new: left for _, left, _, new in reversed(ranked)}
        size = {t: len(b) for t, b in self.token_bytes.items()}
        reach: dict[int, int] = {}
        for _, left, right, _ in reversed(ranked):
            far = size[left] + reach.get(left, 0)
            spine = right
            while spine is not None:
                if reach.get(spine, 0) < far:
                    reach[spine] = far
                spine = parts.get(spine)
        return max(reach.values(), default=0) + max(size.values())

    def symbols(self, raw: bytes) -> list[int]:
        """The initial symbols of one word; its last byte carries the end-of-word suffix."""
        out = [self.first[b] for b in raw]
        if out:
            out[-1] = self.last[raw[-1]]
        return out


def heap_merge(symbols: list[int], merges: dict[int, int], count_only: bool = False):
    """Pop the lowest-rank adjacent pair until none is left.

    Returns the ids left over, or with ``count_only`` their number: the initial symbols minus the
    merges made, without ever building the list of ids.  ``merges``: see ``MergeTable``.  A heap
    entry is one integer, the rank above the place; it is stale unless the pair that stands at its
    place still has that rank.
    """
    n = len(symbols)
    get = merges.get
    heap, left = [], 0
    for i, right in enumerate(symbols):
        if i and (m := get(left << 20 | right)):
            heap.append((m >> 20) << 32 | i - 1)
        left = right
    if not heap:
        return n if count_only else symbols
    heapify(heap)
    at = symbols + [-1]  # the sentinel is in no pair
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    made = 0
    while heap:
        item = heappop(heap)
        i = item & 0xFFFFFFFF
        left = at[i]
        if left < 0:
            continue
        j = after[i]
        m = get(left << 20 | at[j])
        if m is None or m >> 20 != item >> 32:
            continue
        made += 1
        new = m & 0xFFFFF
        at[i], at[j] = new, -1
        k = after[i] = after[j]
        before[k] = i
        if m := get(new << 20 | at[k]):
            heappush(heap, (m >> 20) << 32 | i)
        h = before[i]
        if h >= 0 and (m := get(at[h] << 20 | new)):
            heappush(heap, (m >> 20) << 32 | h)
    return n - made if count_only else [t for t in at if t >= 0]


class Merger:
    """Merges many short byte strings at once, each as ``heap_merge`` would.

    The strings are rows of a matrix of symbols, like lengths together; in a round the leftmost
    pair of the lowest rank is merged in every row that has one.  Ranks are looked up in an open
    hash table of pairs.
    """

    LONGEST, ROWS, _NONE = 64, 8192, np.int32((1 << 31) - 1)

    def __init__(self, table: MergeTable):
        self.table = table
        self.first, self.last = np.array(table.first, np.int32), np.array(table.last, np.int32)
        bits = max(4, (4 * len(table.merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self._NONE, np.int32)
        pairs, values = np.array(list(table.merges), np.int64), np.array(list(table.merges.values()), np.int64)
        self.merged = np.zeros(int((values >> 20).max(initial=0)) + 1, np.int32)  # by rank
        self.merged[values >> 20] = values & 0xFFFFF
        ranks, at = (values >> 20).astype(np.int32), self._slot(pairs)
        while len(pairs):
            self.keys[at] = np.where(self.keys[at] < 0, pairs, self.keys[at])
            done = self.keys[at] == pairs
            self.values[at[done]] = ranks[done]
            pairs, ranks, at = pairs[~done], ranks[~done], (at[~done] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ids below 0 are in none."""
        pairs = left.astype(np.int64) << 20 | right
        pairs = np.where((left < 0) | (right < 0), np.int64(-2), pairs)
        at = self._slot(pairs)
        found = self.keys[at]
        out = np.where(found == pairs, self.values[at], self._NONE)
        open_ = np.nonzero((found != pairs) & (found >= 0) & (pairs >= 0))
        while len(open_[0]):
            some, at_some = pairs[open_], (at[open_] + 1) & self.mask
            found = self.keys[at_some]
            hit = found == some
            at[open_] = at_some
            out[tuple(x[hit] for x in open_)] = self.values[at_some[hit]]
            open_ = tuple(x[~hit & (found >= 0)] for x in open_)
        return out

    def rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Merges the words data[start : start + size]; yields (numbers of words, matrix of their
        ids, -1 behind the last) as rows are done."""
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for a in range(0, len(order), self.ROWS):
            row = order[a : a + self.ROWS]
            size = sizes[row]
            cols = np.arange(int(size[-1]))
            inside = cols < size[:, None]
            at = np.where(inside, starts[row][:, None] + cols, 0)
            s = np.where(inside, self.first[data[at]], np.int32(-1))
            s[np.arange(len(row)), size - 1] = self.last[data[starts[row] + size - 1]]
            r = self._ranks(s[:, :-1], s[:, 1:])
            while s.shape[1] > 1:
                i = r.argmin(axis=1)
                v = r[np.arange(len(row)), i]
                more = v < self._NONE
                if not more.all():
                    yield row[~more], s[~more]
                    row, s, r, i, v = row[more], s[more], r[more], i[more], v[more]
                    if not len(row):
                        break
                every, n = np.arange(len(row)), s.shape[1]
                s = np.take_along_axis(s, cols[: n - 1] + (cols[: n - 1] > i[:, None]), 1)
                s[every, i] = self.merged[v]
                r = np.take_along_axis(r, cols[: n - 2] + (cols[: n - 2] >= i[:, None]), 1)
                k = np.flatnonzero(i > 0)
                r[k, i[k] - 1] = self._ranks(s[k, i[k] - 1], s[k, i[k]])
                k = np.flatnonzero(i < n - 2)
                r[k, i[k]] = self._ranks(s[k, i[k]], s[k, i[k] + 1])
            if len(row):
                yield row, s

    def packed(self, words: list[bytes], kind: str) -> list[bytes]:
        """The ids of each word as integers of type ``kind`` (such as "<u4")."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= self.LONGEST]
        sizes = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        for row, s in self.rows(np.frombuffer(b"".join(words[i] for i in short), np.uint8), np.cumsum(sizes) - sizes, sizes):
            there = s >= 0
            raw, width = s[there].astype(kind).tobytes(), np.dtype(kind).itemsize
            ends = (np.cumsum(there.sum(axis=1)) * width).tolist()
            for i, a, z in zip(row.tolist(), [0, *ends], ends):
                out[short[i]] = raw[a:z]
        if len(short) < len(words):
            t = self.table
            for i, w in enumerate(words):
                if len(w) > self.LONGEST:
                    out[i] = np.array(heap_merge(t.symbols(w), t.merges), kind).tobytes()
        return out

    def counts(self, words: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in self.packed(words, "<u4")]


class StreamingWord:
    """Merges one word that arrives in pieces, keeping at most two windows of bytes."""

    def __init__(self, table: MergeTable):
        if table.suffix:
            raise ValueError("a vocabulary with word ends needs whole words")
        self.table = table
        self.window = max(1024, 4 * table.lookahead)
        self.held = b""

    def push(self, raw: bytes, final: bool = False):
        """Yields lists of tokens that no later byte can change."""
        t, start = self.table, 0
        data = self.held + raw
        while True:
            end = min(len(data), start + self.window)
            last = final and end == len(data)
            if not last and end - start < self.window:
                break
            tokens = heap_merge([t.first[b] for b in data[start:end]], t.merges)
            if last:
                self.held = b""
                yield tokens
                return
            stable, kept = end - t.lookahead, []
            for token in tokens:
                size = len(t.token_bytes[token])
                if start + size > stable:
                    break
                kept.append(token)
                start += size
            yield kept
        self.held = data[start:]


@lru_cache(maxsize=8)
def load_table(path: str) -> MergeTable:
    return MergeTable(path)


class Known:
    """Packed ids of pieces of text: what a batch has new is merged at once, and the pieces are
    remembered in bounded memory.

    ``words`` cuts a piece into the words that no merge crosses.
    """

    def __init__(self, merger: Merger, kind: str, words, entries: int = 400_000, longest: int = 48):
        self.merger, self.kind, self.words, self.entries, self.longest = merger, kind, words, entries, longest
        self.pieces: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        out = list(map(self.pieces.get, pieces))
        at = [i for i, x in enumerate(out) if x is None]
        if at:
            fresh = self._merged(list(dict.fromkeys(map(pieces.__getitem__, at))))
            for i in at:
                out[i] = fresh[pieces[i]]
            if len(self.pieces) > self.entries:
                self.pieces.clear()
            self.pieces.update((p, x) for p, x in fresh.items() if len(p) <= self.longest)
        return out

    def _merged(self, new: list[str]) -> dict[str, bytes]:
        ids, cut = self.ids, list(map(self.words, new))
        if len(ids) > self.entries:
            ids.clear()
        unknown = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in ids]
        ids.update(zip(unknown, self.merger.packed([w.encode() for w in unknown], self.kind)))
        fresh = {p: ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x)) for p, x in zip(new, cut)}
        for w in unknown:
            if len(w) > self.longest:
                del ids[w]
        return fresh


class WordCache(dict):
    """Remembers what was worked out for short pieces of text, in bounded memory."""

    def __init__(self, compute, entries: int = 300_000, longest: int = 48, line_end: str | bytes = "\n"):
        super().__init__()
        self.compute, self.entries, self.longest, self.line_end = compute, entries, longest, line_end

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest and self.line_end not in key:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def split_special(text: str, special: dict[str, int]):
    """Yields (piece of ordinary text, id of the special string after it or None)."""
    if not any(s in text for s in special):
        yield text, None
        return
    pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    at = 0
    for m in pattern.finditer(text):
        yield text[at : m.start()], special[m[0]]
        at = m.end()
    yield text[at:], None


#: Str.lower() has a final form of sigma, which the file's rule has not; the other
#: letters got their small forms in Unicode 16 and later.
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = re.compile(f"[{''.join(map(chr, LOWER))}]")


def normal(text: str) -> str:
    """NFC and lower case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(LOWER) if _CAPITALS.search(text) else text).lower()


#: Control characters that str.split() takes for white space although Unicode does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


class WordPieces:
    """Normalisation and pre-tokenization of the word-level file, down to single words.

    ``pieces`` cuts text at white space, which no word crosses, so that whole pieces can be
    looked up; ``words`` gives the words of a piece.
    """

    def __init__(self, table: MergeTable):
        steps = table.spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unknown normalizer")
        split = table.spec["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("unknown pre-tokenizer")
        self.find = regex.compile(split["pattern"]["Regex"]).findall

    def pieces(self, text: str) -> list[str]:
        text = normal(text)
        return [text] if _NOT_SPACE.search(text) else text.split()

    def words(self, piece: str) -> list[str]:
        if piece.isalpha():
            return [piece]
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return [piece[:-1], piece[-1]]
        return self.find(piece)
