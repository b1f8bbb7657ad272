"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoding.  Every text arrives in chunks of ``CHUNK`` characters.  The pre-tokenizer's state machine
keeps only what its pattern may still change; pre-tokens that are closed go to the merges.  These
are a transducer over a window of bytes: the merge list's sufficient lookahead says which tokens no
later byte can change, those are emitted and their bytes forgotten.  An open pre-token longer than
the lookahead is fed while it grows.  Memory is constant whatever the length of a text or of an
unbroken run of letters.  The windows of many closed pre-tokens are merged at once, and short ones
are remembered in bounded tables.

Decoding.  ``StreamingDecoder`` maps ids to bytes and feeds an incremental UTF-8 state machine;
bytes that are no valid text become U+FFFD, an unfinished character waits for the next id.

Nulls and empty texts: null counts as empty: no ids, and the digests of no bytes.  Very long
texts: constant memory beside the row itself.  Repeated rows: each encoded by itself.  Empty
tables: an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import BYTE_LEVEL_PATTERN, Known, Merger, MergeTable, StreamingWord, load_table, split_special
from .tables import arrow_map, batch, texts_of

#: Characters of a chunk; characters whose pre-tokens are merged together.
CHUNK, TOGETHER = 4096, 1 << 20

_FIND = regex.compile(BYTE_LEVEL_PATTERN)
_RUNS = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "P": regex.compile(r"[^\s\p{L}\p{N}]+"), "S": regex.compile(r"\s+")}
_KIND = regex.compile(r" ?(?:(?P<L>\p{L})|(?P<N>\p{N})|(?P<P>[^\s\p{L}\p{N}]))")
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
#: The last space before a visible character.
_LAST_WORD = re.compile(r".*( )(?=\S)", re.DOTALL)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Transducer:
    """From the bytes of pre-tokens to packed ids, window by window."""

    def __init__(self, table: MergeTable):
        self.table, self.merger, self.window = table, Merger(table), StreamingWord(table).window
        self.windows = 0

    def packed(self, words: list[bytes], kind: str) -> list[bytes]:
        """Closed pre-tokens: what ends inside the window is merged in one step, for all of them at
        once; a longer one leaves its window by the lookahead, step by step."""
        self.windows += len(words)
        out = self.merger.packed([w if len(w) <= self.window else b"" for w in words], kind)
        for i, w in enumerate(words):
            if len(w) > self.window:
                out[i] = b"".join(np.array(part, kind).tobytes() for part in StreamingWord(self.table).push(w, final=True))
        return out


SPACED, WORDS, IDS = range(3)


class StreamingEncoder:
    """feed(chunk) and finish() cut one text; encode(texts) yields (number of the text, packed ids)
    in order, as soon as they are final.

    What is cut: (SPACED, pieces that a space opens), (WORDS, pre-tokens), (IDS, packed ids of a
    pre-token that is still open).
    """

    def __init__(self, path: str, chunk: int = CHUNK):
        table = load_table(path)
        pre = table.spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or table.spec["normalizer"]:
            raise ValueError(f"{path}: unknown pre-tokenizer")
        self.table, self.chunk, self.machine = table, chunk, Transducer(table)
        self.known = (Known(self.machine, "<u4", self._spaced), Known(self.machine, "<u4", lambda w: [w]))
        self.known[1].ids = self.known[0].ids
        self.reset()

    def reset(self) -> None:
        self.tail, self.run, self.stream = "", "", None

    @staticmethod
    def _spaced(piece: str) -> list[str]:
        return [" " + piece] if piece.isalpha() else _FIND.findall(" " + piece)

    # ---- cutting

    def feed(self, chunk: str) -> list[tuple[int, list]]:
        text = self.tail + chunk
        if self.run:
            return self._advance(text, False)
        out: list[tuple[int, list]] = []
        # a space before a visible character always opens a pre-token: what is before it is closed
        if m := _LAST_WORD.match(text):
            closed, text = text[: m.start(1)], text[m.start(1) :]
            if _LOOSE_SPACE.search(closed):
                out.append((WORDS, _FIND.findall(closed)))
            else:
                first, *rest = closed.split(" ")
                out += [(WORDS, _FIND.findall(first)), (SPACED, rest)]
        self.tail = text
        # nothing of an open stretch within the lookahead could be emitted yet
        return out + self._advance(text, False) if len(text) > self.table.lookahead else out

    def finish(self) -> list[tuple[int, list]]:
        out = self._advance(self.tail, True)
        self.reset()
        return out

    def _advance(self, text: str, final: bool) -> list[tuple[int, list]]:
        at, self.tail, out = 0, "", []
        if self.run:
            m = _RUNS[self.run].match(text)
            end = m.end() if m else 0
            open_ended = end == len(text) and not final
            # the last white space before a visible character belongs to what follows
            at = max(0, end - 1) if self.run == "S" and (open_ended or end < len(text)) else end
            out.append((IDS, list(map(pack, self.stream.push(text[:at].encode(), final=not open_ended)))))
            if open_ended:
                self.tail = text[at:]
                return out
            self.run, self.stream = "", None
        words = []
        for m in _FIND.finditer(text, at):
            # near the end a contraction may still form, and a run that touches it may go on
            if not final and m.end() > len(text) - 3:
                self.tail = text[m.start() :]
                break
            words.append(m[0])
        out.append((WORDS, words))
        if len(self.tail) > self.table.lookahead and m.end() == len(text):
            kind = _KIND.match(self.tail)
            self.run, self.stream = kind.lastgroup if kind else "S", StreamingWord(self.table)
            keep = 1 if self.run == "S" else 0
            out.append((IDS, list(map(pack, self.stream.push(self.tail[: len(self.tail) - keep].encode())))))
            self.tail = self.tail[len(self.tail) - keep :]
        return out

    # ---- encoding

    def _cut(self, text: str):
        for part, special in split_special(text, self.table.special):
            for at in range(0, len(part), self.chunk):
                yield self.feed(part[at : at + self.chunk])
            yield self.finish()
            if special is not None:
                yield [(IDS, [pack([special])])]

    def encode(self, texts: list[str]):
        held, size = [], 0
        for i, text in enumerate(texts):
            for units in self._cut(text):
                held += [(i, kind, items) for kind, items in units if items]
                size += self.chunk if len(text) > self.chunk else len(text)
                if size >= TOGETHER:
                    yield from self._merged(held)
                    held, size = [], 0
        yield from self._merged(held)

    def _merged(self, held: list[tuple[int, int, list]]):
        ids = []
        for which, known in enumerate(self.known):
            got = known.ids_of(list(chain.from_iterable(items for _, kind, items in held if kind == which)))
            ids.append(iter(got))
        for i, kind, items in held:
            yield i, b"".join(items if kind == IDS else islice(ids[kind], len(items)))


@lru_cache(maxsize=2)
def streaming_encoder(path: str) -> StreamingEncoder:
    """One for all tasks of a Python worker, so that what it remembers stays."""
    return StreamingEncoder(path)


class StreamingDecoder:
    """From ids to text; an unfinished character waits for the next call."""

    def __init__(self, path: str):
        table = load_table(path)
        self.bytes = [table.token_bytes.get(i, b"") for i in range(table.size)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)), final)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, SHA-256 of the packed ids and of the decoded text.

    ``with_ids`` adds the packed ids as column ``ids`` (binary).
    """

    def make():
        encoder, decoder = streaming_encoder(path), StreamingDecoder(path)
        encoder.reset()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, a, d, kept = [], [], [], []
            hashes, count, whole = None, 0, []

            def close():
                hashes[1].update(decoder.feed((), final=True).encode())
                decoder.state.reset()
                n.append(count)
                a.append(hashes[0].hexdigest())
                d.append(hashes[1].hexdigest())
                kept.append(b"".join(whole))

            texts = texts_of(b)
            for i, part in chain(encoder.encode(texts), [(len(texts), b"")]):
                while len(n) + (hashes is not None) <= i:  # a text begins, and those before it are done
                    if hashes is not None:
                        close()
                    hashes, count, whole = (hashlib.sha256(), hashlib.sha256()), 0, []
                hashes[0].update(part)
                count += len(part) // 4
                hashes[1].update(decoder.feed(np.frombuffer(part, "<u4").tolist()).encode())
                if with_ids:
                    whole.append(part)
            out = {"id": (b.column(0), None), "n_tokens": (n, pa.int64()), "ids_sha256": (a, pa.string()), "decoded_sha256": (d, pa.string())}
            return batch(out | {"ids": (kept, pa.binary())} if with_ids else out)

        return run

    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return arrow_map(slim, make, schema).withColumnRenamed("id", id_col)
