"""Text quality by a generalised additive model with pairwise interactions.

Features of a text (shape of words, character classes, repetition; never its id, language, source
or labels) are cut into bins.  Training goes round the features again and again; each turn fits a
shallow tree to the residuals over one feature's bins and adds a small share of it to that
feature's lookup table.  The strongest pairs, found on the residuals of a coarse grid, get tables
of their own in the same way.  A score is the logistic of an intercept plus one table entry for
each feature and pair: vectorised additions over bins.

Training takes at most ``MAX_TRAINING_ROWS`` labelled documents (those with the smallest hash of
the id; a documented bound: tables of a few hundred numbers do not need more), so the driver holds
a few MB whatever the size of the corpus.  Scoring is a narrow map over the whole text column.

Nulls and empty texts: null counts as empty; an empty text gets the score of its (zero) features.
Labels that are null or repeat: null ones are left out, of repeated ones the smallest holds.
Without any labels, or with one class, the tables stay flat.  Very long texts: memory follows the
longest text.  Repeated rows are scored by themselves.  Empty tables: an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch, crc_mod5, texts_of

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "upper", "punct", "symbol", "digit", "space", "newline", "high_byte", "stop_bang", "letters_distinct",
    "word_bytes", "distinct_words", "same_neighbour", "distinct_pairs", "word_with_symbol", "sentence_ends", "lone_symbol",
)


def _classes() -> np.ndarray:
    m = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        m[b, 0] = b < 128 and c.isupper()
        m[b, 1] = c in ".,;:'\"()-"
        m[b, 2] = b < 128 and c.isprintable() and not c.isalnum() and c not in " .,;:'\"()-!?"
        m[b, 3] = b < 128 and c.isdigit()
        m[b, 4] = c in " \t\r\x0b\x0c"
        m[b, 5] = c == "\n"
        m[b, 6] = b >= 128
        m[b, 7] = c in "!?"
    return m


_CLASSES = _classes()
_SYMBOLS = b"#$%&*|@^~_=<>{}\\/+`[]!"


def features(text: str) -> list[float]:
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (seen @ _CLASSES) / n
    words = raw.lower().split()
    k = len(words)
    after = words[1:]
    pairs = max(1, k - 1)
    marked = sum(w[-1] in _SYMBOLS for w in words)
    ends = sum(w[-1] in b".?!" for w in words)
    lone = sum(len(w) == 1 and w in _SYMBOLS for w in words)
    d = max(1, k)
    return [
        math.log1p(n), math.log1p(k), *share.tolist(), int((seen[97:123] > 0).sum()) / 26,
        (n - seen[32] - seen[9:14].sum()) / d, len(set(words)) / d, sum(map(eq, words, after)) / pairs, len(set(zip(words, after))) / pairs, marked / d, ends / d, lone / d,
    ]


# ---- model -------------------------------------------------------------------------------------


class AdditiveModel:
    """Bin edges, one table a feature, one table a pair."""

    def __init__(self, edges: list[np.ndarray], intercept: float):
        self.edges, self.intercept = edges, intercept
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[bins[:, i]]
        for i, j, t in self.pairs:
            z += t[bins[:, i], bins[:, j]]
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0, ridge: float = 1.0) -> np.ndarray:
    """A shallow regression tree over ordered bins: the Newton step of each bin's leaf."""
    out = np.zeros(len(g))

    def grow(a: int, z: int, depth: int):
        total_g, total_h = g[a:z].sum(), h[a:z].sum()
        if depth and z - a > 1:
            lg, lh = np.cumsum(g[a : z - 1]), np.cumsum(h[a : z - 1])
            gain = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge)
            gain[(lh < least / 8) | (total_h - lh < least / 8)] = -1
            cut = int(np.argmax(gain))
            if gain[cut] > total_g**2 / (total_h + ridge) + 1e-9:
                grow(a, a + cut + 1, depth - 1)
                grow(a + cut + 1, z, depth - 1)
                return
        out[a:z] = total_g / (total_h + ridge)

    grow(0, len(g), depth)
    return out


def _grid(i: np.ndarray, j: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(i * shape[1] + j, weights=v, minlength=shape[0] * shape[1]).reshape(shape)


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """One cut along each axis: the best four leaves of a pair's grid, and their gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    r_g, r_h, c_g, c_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    t_g, t_h = cg[-1, -1], ch[-1, -1]
    gain = a_g**2 / (a_h + ridge) + (r_g - a_g) ** 2 / (r_h - a_h + ridge) + (c_g - a_g) ** 2 / (c_h - a_h + ridge) + (t_g - r_g - c_g + a_g) ** 2 / (t_h - r_h - c_h + a_h + ridge)
    if not gain.size:
        return np.zeros_like(g), 0.0
    x, y = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows in (slice(0, x + 1), slice(x + 1, None)):
        for cols in (slice(0, y + 1), slice(y + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out, float(gain[x, y])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, pairs: int = 8, bins: int = 32, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting; a fifth of the rows says when to stop."""
    p = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for i in range(x.shape[1])]
    model = AdditiveModel(edges, math.log(p / (1 - p)))
    if len(y) < 20 or y.min() == y.max():
        return model
    b = model.bins(x)
    held = np.arange(len(y)) % 5 == 4
    b1, y1, b2, y2 = b[~held], y[~held], b[held], y[held]
    sizes = [len(e) + 1 for e in edges]

    def loss(z: np.ndarray, t: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - t * z))

    def state() -> tuple:
        return [t.copy() for t in model.tables], [(i, j, t.copy()) for i, j, t in model.pairs]

    z1, z2 = model.margin(b1), model.margin(b2)
    best, kept, since = loss(z2, y2), state(), 0
    for _ in range(rounds):
        for f, size in enumerate(sizes):
            q = 1 / (1 + np.exp(-z1))
            g, h = np.bincount(b1[:, f], y1 - q, size), np.bincount(b1[:, f], q * (1 - q), size)
            step = rate * np.clip(_tree(g, h, 2), -4, 4)
            model.tables[f] += step
            z1 += step[b1[:, f]]
            z2 += step[b2[:, f]]
        now = loss(z2, y2)
        best, kept, since = (now, state(), 0) if now < best - 1e-6 else (best, kept, since + 1)
        if since > 15:
            break
    model.tables, model.pairs = kept
    z1, z2 = model.margin(b1), model.margin(b2)
    q = 1 / (1 + np.exp(-z1))
    coarse = [np.minimum(b1[:, f] * 8 // s, 7) for f, s in enumerate(sizes)]
    found = []
    for i in range(len(sizes)):
        for j in range(i):
            found.append((_pair_tree(_grid(coarse[i], coarse[j], y1 - q, (8, 8)), _grid(coarse[i], coarse[j], q * (1 - q), (8, 8)))[1], i, j))
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(found, reverse=True)[:pairs]]
    kept, since = state(), 0
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            q = 1 / (1 + np.exp(-z1))
            step, _ = _pair_tree(_grid(b1[:, i], b1[:, j], y1 - q, t.shape), _grid(b1[:, i], b1[:, j], q * (1 - q), t.shape))
            step = rate * np.clip(step, -4, 4)
            t += step
            z1 += step[b1[:, i], b1[:, j]]
            z2 += step[b2[:, i], b2[:, j]]
        now = loss(z2, y2)
        best, kept, since = (now, state(), 0) if now < best - 1e-6 else (best, kept, since + 1)
        if since > 8:
            break
    model.tables, model.pairs = kept
    return model


def _featured(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Learns from labelled documents whose crc32(id) mod 5 is not 0."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    sample = known.where(crc_mod5("id") != 0).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def make():
        return lambda b: batch({"id": (b.column(0), None), "y": (b.column(2), None), "x": (_featured(texts_of(b)).tolist(), pa.list_(pa.float64()))})

    # the sample has at most ``rows`` rows, a proven bound for the broadcast
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    got = arrow_map(slim, make, f"id {slim.schema['id'].dataType.simpleString()}, y double, x array<double>")
    got = got.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return train(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(crc_mod5(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            p = shared.value.predict(_featured(texts_of(b)))
            return batch({"id": (b.column(0), None), "held_out": (b.column(1), None), "score": (p, pa.float64()), "predicted": ((p >= threshold).astype(np.int32), pa.int32())})

        return run

    return arrow_map(slim, make, f"id {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array(shared.value.predict(_featured(texts_of(part, text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
