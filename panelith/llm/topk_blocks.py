"""Exact top-k inner products by block-at-a-time pruning.

A vector is a document of 2 x dimensions terms: each component once for positive and once for
negative query weights.  Blocks are ranges of ``BLOCK`` documents in an order that puts vectors
with the same leading component together.  For each query the blocks are ordered by the sum of
its weights times the blocks' term maxima, and scored through their forward index (the vectors
themselves) in that order, until the next bound falls below the query's k-th score.  The k-th
score of a bounded sample of documents, itself a lower bound, starts every query's threshold.

All numbers are integers; products run in float32 or float64 only where every sum is exact there.

Nulls, non-finite: such vectors take no part.  Vectors of unequal length count as padded with
zeros.  Ties go to the smaller id.  A repeated id is one query (its smallest vector) and as many
candidates as rows; candidates never have the query's own id.  Empty tables: an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import PRIMING, TopLists, best, build_segments, finite_vectors, grouped, lists_of, matrix, query_chunks, rounds

BLOCK = 128
_LOWEST = np.iinfo(np.int64).min + 1  # its negative is still a number


def exact_kind(q: np.ndarray, x: np.ndarray):
    """A number type in which q @ x.T is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    kind = exact_kind(q, x)
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


def search_segment(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: TopLists) -> int:
    """Adds the segment's candidates to the lists; returns how many (query, block) it scored."""
    edges = np.arange(0, len(ids), BLOCK)
    most, least = np.maximum.reduceat(x, edges), np.minimum.reduceat(x, edges)
    bounds = products(np.maximum(q, 0), most) + products(np.maximum(-q, 0), -least)
    scored = 0
    rows, blocks = np.nonzero(bounds >= top.floor[:, None])
    # bounds are integers of any size: their places in falling order stand for them
    falling = np.unique(-bounds[rows, blocks], return_inverse=True)[1]
    for rows, block, place in rounds(rows, blocks, falling):
        open_ = bounds[rows, block] >= top.floor[rows]
        if not open_.any():
            continue
        for b, mine in grouped(rows[open_], block[open_]):
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            for at in range(0, len(mine), 4096):
                some = mine[at : at + 4096]
                s = products(q[some], x[part])
                s[query_ids[some][:, None] == ids[part][None, :]] = _LOWEST
                top.add(some, s, ids[part])
                scored += len(some)
    return scored


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query: a row whose id ``every`` divides."""
    spark = vectors.sparkSession
    whole = finite_vectors(vectors, id_col, vec_col).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    n, width = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    size = F.transform("v", lambda x: F.abs(x))
    lead = F.array_position(size, F.array_max(size))
    sign = F.try_element_at("v", F.when(lead > 0, lead.cast("int")).otherwise(1)) > 0
    segments = build_segments(whole, [lead, sign, F.col("id")], width, "int64", lambda i, x: {"ids": i.tobytes(), "x": x.tobytes()}, n, "blocks")
    prime = whole.orderBy(F.xxhash64("id"), "id").limit(PRIMING).toArrow().combine_chunks()
    prime_ids = prime.column("id").to_numpy().astype(np.int64)
    prime_x = matrix(prime.column("v").combine_chunks(), width, np.int64) if len(prime_ids) else np.zeros((0, width), np.int64)

    def chunks():
        for query_ids, q in query_chunks(whole.where(F.col("id") % every == 0), width, "int64"):
            floor = np.full(len(q), _LOWEST)
            if len(prime_ids) > k:
                for a in range(0, len(q), 1024):
                    s = products(q[a : a + 1024], prime_x)
                    s[query_ids[a : a + 1024][:, None] == prime_ids[None, :]] = _LOWEST
                    floor[a : a + 1024] = np.partition(s, -k, axis=1)[:, -k]
            yield query_ids, q, floor

    def search(chunk):
        query_ids, q, floor = chunk
        top = TopLists(len(q), k, floor, np.int64, _LOWEST)

        def take(ids, x):
            search_segment(np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(-1, width), query_ids, q, top)

        return take, top

    return best(lists_of(segments, chunks(), "long", search), k, "long")
