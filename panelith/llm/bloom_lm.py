"""Language-model scores from a log-frequency Bloom filter.

Training.  Each task hashes its words and word pairs and counts them before anything is shuffled;
what moves is a block for each occupied bucket of the hash space: words with counts, and for pairs
the histories (first words), each with its followers.  A bucket is merged in one task and gives a
segment: a table of exact word counts, and a Bloom filter that holds, for every pair (h w) seen
twice or more, one entry for each level up to 1 + floor(log_BASE(c(h w) - 1)).

Model.  Absolute discounting by one, so that pairs seen once need no entry and lose nothing:

    P(w | h) = (q(h w) + (c(h) - R(h)) * P1(w)) / c(h),      P(w | h) = P1(w) for an unseen h,

with q the least count less one that has the level read off the filter (0: no entry), c(h) the
exact count of the history, R(h) the sum of q(h w) over all w, kept with the words, and P1 the
smoothed word distribution.  q is never above the true count less one, so R(h) < c(h) and the rows
sum to 1, quantised as they are, but for false positives.  Without quantisation, c(h) - R(h) is
the number of different followers.

Scoring.  Segments are broadcast to the workers in groups of at most ``max_broadcast_mb``, as
many groups as there are (one, as a rule; more passes where the corpus is larger: an exact way on,
not a cap).  A level is read off by probing one after the other until a probe fails.  Between
passes, texts go as hashes of their tokens.  The first history is the end token, which also closes
each text.

Nulls and empty texts: a null text is empty: one token, the end.  A null id counts as a training
document.  Very long texts: memory follows the longest text.  Repeated rows count as often as they
occur.  An empty training corpus gives P1 over no words: base 0.5/0.5, log 0.  Extra columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordCache
from .tables import arrow_map, batch, crc_mod5, slices, stored, texts_of

#: Quantisation base; bits of the filter an entry; probes a lookup; tokens counted at a time.
BASE, BITS, PROBES, FLUSH = 1.5, 10, 4, 1_000_000
END = xxhash.xxh3_64_intdigest(b"")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_S = [np.uint64(x) for x in (30, 27, 31, 32, 6, 63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S[0])) * _MIX[0]
        x = (x ^ (x >> _S[1])) * _MIX[1]
    return x ^ (x >> _S[2])


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * _MIX[2] + (w ^ np.uint64(0x5851F42D4C957F2D)))


class Tokens:
    """Hashes of the tokens of a batch of texts: each text's words, then one end."""

    def __init__(self):
        self.hash = WordCache(xxhash.xxh3_64_intdigest, 250_000, line_end=b"\n")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        for t in texts:
            words = t.encode().lower().split()  # ASCII case, ASCII white space
            a = np.empty(len(words) + 1, np.uint64)
            a[:-1] = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
            a[-1] = END
            parts.append(a)
            sizes.append(len(a))
        return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(sizes, np.int64)


def histories(tokens: np.ndarray) -> np.ndarray:
    """The token before each; END stands before each text, which is what closes the one before."""
    h = np.empty_like(tokens)
    h[:1] = END
    h[1:] = tokens[:-1]
    return h


def occupied(keys: np.ndarray, bits: int):
    """(bucket, from, to) of the runs of sorted keys that share a bucket."""
    if len(keys):
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
        for a, z in zip(edges, edges[1:]):
            yield int(bucket[a]), a, z


def _word_blocks(tokens: np.ndarray, bits: int):
    keys, counts = np.unique(tokens, return_counts=True)
    for b, a, z in occupied(keys, bits):
        yield 1, b, keys[a:z].astype("<u8").tobytes(), b"", b"", *_small(counts[a:z])


def _pair_blocks(history: np.ndarray, tokens: np.ndarray, bits: int):
    """Of each bucket the histories, how many followers each has, the followers' low 32 bits."""
    keys, at, counts = np.unique(pair_hash(history, tokens), return_index=True, return_counts=True)
    h, w = history[at], tokens[at].astype(np.uint32)
    for b, a, z in occupied(keys, bits):
        order = np.argsort(h[a:z], kind="stable")
        mine = h[a:z][order]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        runs = np.diff(np.append(first, z - a))
        yield 2, b, mine[first].astype("<u8").tobytes(), runs.astype("<u4").tobytes(), w[a:z][order].astype("<u4").tobytes(), *_small(counts[a:z][order])


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte a count; 255 stands for the next of the large ones."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<u4").tobytes()


def _counts(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<u4")
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


#: The least count of each level; level 0: none.
VALUE = np.array([0.0] + [float(math.ceil(BASE ** (j - 1) - 1e-9)) for j in range(1, 110)])


def place(keys: np.ndarray, level: int | np.ndarray, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bit mask of an entry (key, level) in a segment of ``words`` words."""
    with np.errstate(over="ignore"):
        x = mix(keys + np.uint64(level) * _MIX[2] if np.isscalar(level) else keys + level.astype(np.uint64) * _MIX[2])
    at = ((x >> _S[3]) * np.asarray(words).astype(np.uint64)) >> _S[3]
    mask = np.zeros_like(x)
    for _ in range(PROBES):
        mask |= np.uint64(1) << (x & _S[5])
        x = x >> _S[4]
    return at.astype(np.int64), mask


def entry_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What the filter knows of a pair: the history and 32 bits of the word."""
    return pair_hash(history, word & np.uint64(0xFFFFFFFF))


def summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their weights."""
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


def build_filter(keys: np.ndarray, levels: np.ndarray, entry_bits: int = BITS) -> np.ndarray:
    words = max(1, -(-int(levels.sum()) * entry_bits // 64))
    bits, level = np.zeros(words, np.uint64), 1
    while len(keys):
        at, mask = place(keys, level, words)
        np.bitwise_or.at(bits, at, mask)
        keep = levels > level
        keys, levels, level = keys[keep], levels[keep], level + 1
    return bits


def _merge(pdf: pd.DataFrame, entry_bits: int = BITS) -> pd.DataFrame:
    """Merges the blocks of one bucket: exact word counts, the pairs' filter, and what the pairs
    give to their histories (R, in part)."""
    some = pdf[pdf["kind"] == 1]
    keys = np.concatenate([*(np.frombuffer(x, "<u8") for x in some["heads"]), np.empty(0, np.uint64)])
    words, counts = summed(keys, np.concatenate([*map(_counts, some["small"], some["large"]), np.empty(0, np.int64)]))
    some = pdf[pdf["kind"] == 2]
    heads = np.concatenate([*(np.frombuffer(x, "<u8") for x in some["heads"]), np.empty(0, np.uint64)])
    runs = np.concatenate([*(np.frombuffer(x, "<u4") for x in some["runs"]), np.empty(0, np.uint32)])
    tails = np.concatenate([*(np.frombuffer(x, "<u4") for x in some["tails"]), np.empty(0, np.uint32)])
    known, back = np.unique(heads, return_inverse=True)
    pair = np.repeat(back.astype(np.uint64) << np.uint64(32), runs) | tails
    pair, n = summed(pair, np.concatenate([*map(_counts, some["small"], some["large"]), np.empty(0, np.int64)]))
    pair, n = pair[n > 1], n[n > 1]
    head, levels = (pair >> np.uint64(32)).astype(np.int64), levels_of(n - 1)
    bits = build_filter(entry_key(known[head], pair & np.uint64(0xFFFFFFFF)), levels, entry_bits)
    given = np.bincount(head, VALUE[levels], len(known)).astype(np.int64)
    mine = np.flatnonzero(given)
    row = {"bucket": pdf["bucket"].iloc[0], "filter": bits.astype("<u8").tobytes(), "words": words.astype("<u8").tobytes(), "counts": counts.astype("<i8").tobytes()}
    row |= {"heads": known[mine].astype("<u8").tobytes(), "given": given[mine].astype("<i8").tobytes()}
    return pd.DataFrame([row])


_MERGED = "bucket int, filter binary, words binary, counts binary, heads binary, given binary"
_SEGMENT = "bucket int, filter binary, once binary, words binary, counts binary, repeats binary, bytes long, distinct long, tokens long"


def _bucket(key: str, bits: int):
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _finish(bits: int):
    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Puts R beside the words of a bucket; words seen once have none and need no count."""
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in _SEGMENT.split(", ")])
        r = left.iloc[0]
        words, counts = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<i8")
        repeats = np.zeros(len(words), np.int64)
        if len(right):
            repeats[np.searchsorted(words, right["head"].to_numpy(np.int64).view(np.uint64))] = right["given"].to_numpy(np.int64)
        more = counts > 1
        out = {"bucket": r["bucket"], "filter": r["filter"], "once": words[~more].tobytes(), "words": words[more].tobytes(), "counts": counts[more].tobytes(), "repeats": repeats[more].tobytes()}
        return pd.DataFrame([out | {"bytes": sum(len(v) for v in out.values() if isinstance(v, bytes)), "distinct": len(words), "tokens": int(counts.sum())}])

    return finish


def train(docs: DataFrame, bits: int, entry_bits: int = BITS) -> DataFrame:
    """Segments (one row a bucket), stored, of the model of all texts of docs (column ``text``)."""

    def run(batches):
        tokens, held, size = Tokens(), [], 0

        def flush():
            t = np.concatenate(held)
            rows = [*_word_blocks(t, bits), *_pair_blocks(histories(t), t, bits)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            for a in range(0, len(rows), 4096):
                yield batch({k: ([r[i] for r in rows[a : a + 4096]], kinds[i]) for i, k in enumerate(("kind", "bucket", "heads", "runs", "tails", "small", "large"))})

        for b in batches:
            texts = texts_of(b)
            for a, z in slices(texts):
                held.append(tokens(texts[a:z])[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def unpacked():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            heads, given = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<i8") for k in range(2))
            return batch({"head": (heads, pa.int64()), "given": (given, pa.int64())})

        return run

    blocks = docs.select("text").mapInArrow(run, "kind int, bucket int, heads binary, runs binary, tails binary, small binary, large binary")
    merged = stored(blocks.groupBy("bucket").applyInPandas(lambda pdf: _merge(pdf, entry_bits), _MERGED), "lm-merged")
    given = arrow_map(merged.select("heads", "given"), unpacked, "head long, given long", rows=1).groupBy("head").agg(F.sum("given").alias("given"))
    given = given.withColumn("bucket", _bucket("head", bits))
    slim = merged.select("bucket", "filter", "words", "counts")
    return stored(slim.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInPandas(_finish(bits), _SEGMENT), "lm-segments")


class Group:
    """The segments of some buckets, laid end to end for lookups."""

    def __init__(self, rows, sizes: list[tuple[int, int, int, int]], bits: int):
        """sizes: (bucket, words of its filter, words seen once, other words), by bucket; rows in
        any order."""
        n, ends = 1 << bits, np.cumsum([[0, 0, 0], *(s[1:] for s in sizes)], axis=0)
        self.bits, self.size, self.at = bits, np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = {s[0]: e.tolist() for s, e in zip(sizes, ends)}
        for b, filter_words, *_ in sizes:
            self.at[b], self.size[b] = first[b][0], filter_words
        a, b, c = ends[-1].tolist()
        self.filter, self.once = np.empty(a, np.uint64), np.empty(b, np.uint64)
        self.words, self.counts, self.repeats = np.empty(c, np.uint64), np.empty(c, np.int64), np.empty(c, np.int64)
        for r in rows:  # one at a time: the driver holds the group once
            for at, names in zip(first[r["bucket"]], (("filter",), ("once",), ("words", "counts", "repeats"))):
                for name in names:
                    part = np.frombuffer(r[name], "<u8")
                    getattr(self, name)[at : at + len(part)] = part.view(getattr(self, name).dtype)

    def exact(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c and R of words; 0 for words that are not known."""
        c, r = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.once):
            at = np.minimum(np.searchsorted(self.once, keys), len(self.once) - 1)
            c[self.once[at] == keys] = 1
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
            hit = self.words[at] == keys
            c[hit], r[hit] = self.counts[at[hit]], self.repeats[at[hit]]
        return c, r

    def level(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Levels of pairs by repeated membership probes; 0 for buckets of other groups."""
        out = np.zeros(len(word), np.uint8)
        whole = pair_hash(history, word)
        bucket = (whole >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(whole), np.int64)
        size = self.size[bucket]
        left = np.flatnonzero(size)
        base, size, keys = self.at[bucket[left]], size[left], entry_key(history[left], word[left])
        level = 1
        while len(left):
            at, mask = place(keys, level, size)
            hit = (self.filter[base + at] & mask) == mask
            left, base, size, keys = left[hit], base[hit], size[hit], keys[hit]
            out[left] = level
            level += 1
            if level >= len(VALUE):
                break
        return out


#: What is known of a token between passes.
_STATE = np.dtype([("token", "<u8"), ("c", "<i8"), ("r", "<i8"), ("level", "u1")])


def look_up(model: Group, token: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The state of tokens after this group."""
    out = np.zeros(len(token), _STATE) if state is None else state.copy()
    words, back = np.unique(token, return_inverse=True)
    c, r = model.exact(words)
    out["token"] = token
    out["c"] += c[back]
    out["r"] += r[back]
    out["level"] = np.maximum(out["level"], model.level(histories(token), token))
    return out


def log_probability(state: np.ndarray, end: tuple[int, int], base: np.ndarray) -> np.ndarray:
    """log10 P of each token; base: log10 P1.  end: c and R of the end token."""
    c, r = np.empty(len(state)), np.empty(len(state))
    c[1:], r[1:] = state["c"][:-1], state["r"][:-1]
    c[:1], r[:1] = end
    q = VALUE[state["level"]]
    # a false positive could take the sum of a row above 1, but never a probability
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.minimum(1.0, (q + (c - r) * 10.0**base) / c)
    return np.where(c > 0, np.log10(p, where=c > 0, out=np.zeros(len(p))), base)


def score(docs: DataFrame, segments: DataFrame, bits: int, max_broadcast_mb: int = 160) -> DataFrame:
    """Scores docs (id, held_out, text) by the model in ``segments`` (a stored table)."""
    spark = docs.sparkSession
    lengths = [F.octet_length(c).alias(c) for c in ("filter", "once", "words")]
    sizes = segments.select("bucket", "bytes", "distinct", "tokens", *lengths).orderBy("bucket").toPandas()
    n, v = int(sizes["tokens"].sum()), int(sizes["distinct"].sum())
    end = _end_of(segments, bits)
    groups, room = [[]], max_broadcast_mb << 20
    for bucket, size in zip(sizes["bucket"], sizes["bytes"]):
        if groups[-1] and room < size:
            groups.append([])
            room = max_broadcast_mb << 20
        groups[-1].append(int(bucket))
        room -= size
    kind = docs.schema["id"].dataType.simpleString()
    state = docs.select("id", "held_out", "text")
    for g, buckets in enumerate(groups):
        low, high = (buckets[0], buckets[-1]) if buckets else (0, -1)
        own = sizes[sizes["bucket"].between(low, high)]
        shape = [(int(r.bucket), r.filter // 8, r.once // 8, r.words // 8) for r in own.itertuples()]
        rows = segments.where(F.col("bucket").between(low, high)).select("bucket", "filter", "once", "words", "counts", "repeats").toLocalIterator()
        shared = spark.sparkContext.broadcast(Group(rows, shape, bits))
        first, last = g == 0, g == len(groups) - 1

        def make(shared=shared, first=first, last=last):
            tokens = Tokens()
            log_base = math.log10(n + 0.5 * (v + 1))

            def hashes(b: pa.RecordBatch, texts):
                """Runs of rows: (tokens, lengths, state before)."""
                if first:
                    for a, z in slices(texts):
                        yield *tokens(texts[a:z]), None
                else:
                    for a in range(0, len(texts), 256):
                        before = np.frombuffer(b"".join(texts[a : a + 256]), _STATE)
                        yield before["token"], np.array([len(x) // _STATE.itemsize for x in texts[a : a + 256]]), before

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                model = shared.value
                cols: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "state")}
                for t, lengths, before in hashes(b, texts_of(b) if first else b.column(2).to_pylist()):
                    known = look_up(model, t, before)
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    if not last:
                        cols["state"] += [known[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist())]
                        continue
                    base = np.log10(known["c"] + 0.5) - log_base
                    cols["n_tokens"] += lengths.tolist()
                    cols["n_known"] += np.add.reduceat((known["c"] > 0).astype(np.int64), starts).tolist()
                    cols["base_score"] += np.add.reduceat(base, starts).tolist()
                    cols["score"] += np.add.reduceat(log_probability(known, end, base), starts).tolist()
                out = {"id": (b.column(0), None), "held_out": (b.column(1), None)}
                if not last:
                    return batch(out | {"state": (cols["state"], pa.binary())})
                ints = {k: (cols[k], pa.int64()) for k in ("n_tokens", "n_known")}
                return batch(out | ints | {"train_tokens": ([n] * b.num_rows, pa.int64())} | {k: (cols[k], pa.float64()) for k in ("base_score", "score")})

            return run

        schema = f"id {kind}, held_out boolean, " + ("n_tokens long, n_known long, train_tokens long, base_score double, score double" if last else "state binary")
        state = arrow_map(state, make, schema)
        if not last:
            state = stored(state, "lm-state")
    return state


def _end_of(segments: DataFrame, bits: int) -> tuple[int, int]:
    """c and R of the end token, the history of all first words."""
    bucket = END >> (64 - bits) if bits else 0
    for r in segments.where(F.col("bucket") == bucket).select("once", "words", "counts", "repeats").collect():
        if END in np.frombuffer(r["once"], "<u8"):
            return 1, 0
        at = np.flatnonzero(np.frombuffer(r["words"], "<u8") == np.uint64(END))
        if len(at):
            return tuple(int(np.frombuffer(r[k], "<i8")[at[0]]) for k in ("counts", "repeats"))
    return 0, 0


def bucket_bits(total_bytes: int, bucket_bytes: int = 8 << 20) -> int:
    """Buckets of about 8 MB of text, at least 16."""
    return max(4, math.ceil(math.log2(max(1, total_bytes / bucket_bytes))))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_mb: int = 160, entry_bits: int = BITS) -> DataFrame:
    """Trains on documents whose crc32(id) mod 5 is not 1 and scores all of them."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(crc_mod5(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(total)
    segments = train(slim.where(~F.col("held_out")), bits, entry_bits)
    return score(slim, segments, bits, max_broadcast_mb).withColumnRenamed("id", id_col)
