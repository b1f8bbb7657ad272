"""Approximate nearest neighbours from a few stable projections in a kd-tree.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |x|^2) with M the
largest norm.  A Gaussian (2-stable) projection to ``dims`` numbers turns a distance d into
d * sqrt(chi-square with dims degrees of freedom).  Each segment holds its rows' projections in a
kd-tree.  Queries go down the tree together, level by level, and leave a branch whose box lies
beyond their radius; the leaves that are left are met in order of projected distance, their rows'
exact inner products verified on the original vectors, and the search ends when the chi-square test
says that a row closer than the k-th found would, with probability ``sure``, have been met before:
projected distance^2 > quantile(sure) * (k-th distance)^2.  Rows of a met leaf that fail the same
test are skipped.  Every row is indexed; only the start of the thresholds comes from a bounded
sample.  Queries that are left with fewer than k rows by the test are searched without it.

Nulls, non-finite, zero: such vectors take no part.  Unequal lengths count as padded with zeros.
Ties go to the smaller id.  A repeated id is one query (its smallest vector) and as many
candidates as rows; candidates never have the query's own id.  Empty tables: an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .vector_search import PRIMING, TopLists, best, build_segments, finite_vectors, grouped, lists_of, matrix, query_chunks, rounds

DIMS, SURE, LEAF = 10, 0.98, 64


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the regularised lower incomplete gamma function's series."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 10.0 * k + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_tree(p: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order of a kd-tree, its nodes and their boxes; cuts at the median of the widest
    coordinate.

    Nodes in pre-order, as rows (first row, end, right child or 0 for a leaf); the left child of a
    node is the next one.  Boxes: (nodes, 2, dims), least and largest coordinates.
    """
    order, nodes, boxes = np.arange(len(p)), [], []

    def cut(a: int, z: int):
        at, part = len(nodes), p[order[a:z]]
        boxes.append((part.min(axis=0), part.max(axis=0)))
        nodes.append([a, z, 0])
        if z - a > leaf:
            axis, half = int(np.argmax(boxes[at][1] - boxes[at][0])), (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, axis], half)]
            cut(a, a + half)
            nodes[at][2] = len(nodes)
            cut(a + half, z)

    if len(p):
        cut(0, len(p))
    return order, np.array(nodes, np.int64).reshape(-1, 3), np.array(boxes, np.float64).reshape(-1, 2, p.shape[1])


def descend(nodes: np.ndarray, boxes: np.ndarray, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, leaf, squared distance to its box) of the leaves within the queries' squared radii."""
    out = []
    todo = [(0, np.arange(len(points)))] if len(nodes) else []
    while todo:
        node, rows = todo.pop()
        gap = np.maximum(np.maximum(boxes[node, 0] - points[rows], points[rows] - boxes[node, 1]), 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        near = bound <= radius[rows]
        rows = rows[near]
        if len(rows):
            right = int(nodes[node, 2])
            if right:
                todo += [(right, rows), (node + 1, rows)]
            else:
                out.append((rows, np.full(len(rows), node), bound[near]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that all norms are ``most``."""
    rest = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


#: More than the rounding of a matrix product of unit-size numbers.
SLACK = 1e-9


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def exact_dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, always added in the same order: equal vectors get equal scores wherever they
    lie, which a matrix product does not promise."""
    return np.add.reduce(q * x, axis=1)


def search_segment(ids, x, p, nodes, boxes, query_ids, q, qp, q_norm, most, top: TopLists, factor: float) -> int:
    """Adds what the segment has to the lists; returns how many inner products it verified."""
    verified = 0
    no_test = math.isinf(factor)
    radius = lambda rows: np.full(len(rows), np.inf) if no_test else factor * np.maximum(q_norm[rows] ** 2 + most * most - 2 * top.floor[rows], 0)
    p_norm, qp_norm = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", qp, qp)
    for rows, leaf, bound in rounds(*descend(nodes, boxes, qp, radius(np.arange(len(q))))):
        open_ = bound <= radius(rows)
        for b, all_rows in grouped(rows[open_], leaf[open_]):
            part = slice(int(nodes[b, 0]), int(nodes[b, 1]))
            for at in range(0, len(all_rows), 4096):
                mine = all_rows[at : at + 4096]
                apart = qp_norm[mine][:, None] + p_norm[part][None, :] - 2 * dots(qp[mine], p[part])
                near = apart <= radius(mine)[:, None] * (1 + SLACK) + SLACK * most * most
                near &= query_ids[mine][:, None] != ids[part][None, :]
                verified += int(near.sum())
                rough = dots(q[mine], x[part])
                i, j = np.nonzero(near & (rough >= (top.floor[mine] - SLACK * (1 + most * q_norm[mine]))[:, None]))
                if len(i):
                    s = np.full(rough.shape, -np.inf)
                    s[i, j] = exact_dots(q[mine][i], x[part][j])
                    top.add(mine, s, ids[part])
    return verified


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, dims: int = DIMS, sure: float = SURE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query: a row whose id ``every`` divides."""
    spark = vectors.sparkSession
    whole = finite_vectors(vectors, id_col, vec_col).select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, width, most = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    width, most, factor = max(1, width), most * (1 + 1e-9), chi_square_quantile(sure, dims)
    net = np.random.default_rng(20).normal(size=(width + 1, dims))

    def pack(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        p = lifted(x, most) @ net
        order, nodes, boxes = kd_tree(p)
        return {"ids": ids[order].tobytes(), "x": x[order].tobytes(), "p": p[order].tobytes(), "nodes": nodes.tobytes(), "boxes": boxes.tobytes()}

    along = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in net[:width, 0]]), lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0), lambda a, x: a + x)
    segments = build_segments(whole, [along, F.col("id")], width, "float64", pack, n, "projected")
    prime = whole.orderBy(F.xxhash64("id"), "id").limit(PRIMING).toArrow().combine_chunks()
    prime_ids = prime.column("id").to_numpy().astype(np.int64)
    prime_x = matrix(prime.column("v").combine_chunks(), width, np.float64) if len(prime_ids) else np.zeros((0, width))

    def chunks(queries: DataFrame, primed: bool):
        for query_ids, q in query_chunks(queries, width, "float64"):
            floor = np.full(len(q), -np.inf)
            if primed and len(prime_ids) > 4 * k:  # well below the k-th score, so that every list fills up
                for a in range(0, len(q), 1024):
                    s = dots(q[a : a + 1024], prime_x)
                    s[query_ids[a : a + 1024][:, None] == prime_ids[None, :]] = -np.inf
                    floor[a : a + 1024] = np.partition(s, -4 * k, axis=1)[:, -4 * k] - SLACK * (1 + most * np.linalg.norm(q[a : a + 1024], axis=1))
            yield query_ids, q, floor

    def search(factor: float):
        def begin(chunk):
            query_ids, q, floor = chunk
            q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))
            qp = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ net
            top = TopLists(len(q), k, floor, np.float64, -np.inf)

            def take(ids, x, p, nodes, boxes):
                i = np.frombuffer(ids, np.int64)
                tree = np.frombuffer(nodes, np.int64).reshape(-1, 3), np.frombuffer(boxes).reshape(-1, 2, dims)
                search_segment(i, np.frombuffer(x).reshape(-1, width), np.frombuffer(p).reshape(-1, dims), *tree, query_ids, q, qp, q_norm, most, top, factor)

            return take, top

        return begin

    queries = whole.where(F.col("id") % every == 0)
    found = stored(best(lists_of(segments, chunks(queries, True), "double", search(factor)), k, "double"), "nearest")
    # what the test has left short, though there are more candidates: no test for these
    rows_of = whole.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")).withColumnRenamed("query_id", "id")
    short = queries.select("id").distinct().join(rows_of, "id").join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own"))).select("id")
    short = stored(short, "short")
    if short.isEmpty():
        return found
    again = best(lists_of(segments, chunks(queries.join(short, "id", "left_semi"), False), "double", search(math.inf)), k, "double")
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(again)
