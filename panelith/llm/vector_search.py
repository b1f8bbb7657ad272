"""What the two vector searches share: packed segments, query chunks and running top-k lists.

Rows are dealt out by ranges, so that like rows meet and copies of one vector still spread, and
packed into segments of at most ``SEGMENT`` rows, which are written once to the shared folder.
Queries are broadcast in chunks of at most ``CHUNK_BYTES``, one after the other: a chunk is all that
the driver ever holds, and its lists are written before the next one is made (as many passes over
the segments as chunks).  A task keeps one top-k list a query for all its segments and emits only
what may still be among the k best, so nothing is shuffled but short lists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import batch, shared_folder, stored

SEGMENT, CHUNK_BYTES, PRIMING = 8192, 32 << 20, 1024


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id (long) and v of the rows that take part: no null id, vector or component, all finite."""
    v = F.col(vec_col)
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Lists as rows; shorter ones are padded with zeros."""
    lists = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), kind)
    if (sizes == width).all():
        out[:] = lists.reshape(-1, width)
    else:
        for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            out[i, :n] = lists[a : a + n]
    return out


def build_segments(rows: DataFrame, order: list[str | Column], width: int, kind: str, pack: Callable, n: int, what: str) -> DataFrame:
    """pack(ids, vectors) gives the binary columns of a segment."""
    parts = max(1, -(-n // SEGMENT))
    names = pack(np.empty(0, np.int64), np.empty((0, width), kind)).keys()

    def run(batches):
        ids, vectors, held = [], [], 0

        def cut(final: bool):
            nonlocal ids, vectors, held
            i, v = np.concatenate(ids), np.concatenate(vectors)
            while len(i) >= SEGMENT or final and len(i):
                yield batch({k: ([x], pa.binary()) for k, x in pack(i[:SEGMENT], v[:SEGMENT]).items()})
                i, v = i[SEGMENT:], v[SEGMENT:]
            ids, vectors, held = [i], [v], len(i)

        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            vectors.append(matrix(b.column(1), width, kind))
            held += b.num_rows
            if held >= SEGMENT:
                yield from cut(False)
        if held:
            yield from cut(True)

    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "v")
    return stored(laid.mapInArrow(run, ", ".join(f"{k} binary" for k in names)), what)


def query_chunks(queries: DataFrame, width: int, kind: str):
    """(ids, vectors) of the queries, chunk by chunk; of a repeated id the smallest vector."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n = queries.count()
    chunks = max(1, -(-n * (8 * width + 8) // CHUNK_BYTES))
    for c in range(chunks):
        part = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)
        got = part.toArrow().combine_chunks()
        if got.num_rows:
            column = got.column("v").combine_chunks()
            yield got.column("id").to_numpy().astype(np.int64), matrix(column if isinstance(column, pa.Array) else column.chunk(0), width, kind)


class TopLists:
    """The k best (score, id) of each query: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray, kind, lowest):
        self.k, self.lowest = k, lowest
        self.score = np.full((n, k), lowest, kind)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor.astype(kind)  # a score that is surely no better than the k-th

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (rows, candidates); ``lowest`` marks what doesn't count."""
        some = (scores >= self.floor[rows][:, None]).any(axis=1) & (scores.max(axis=1) > self.lowest)
        if not some.any():
            return
        rows, scores = rows[some], scores[some]
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.id[rows], np.where(scores == self.lowest, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows][:, -1])

    def rows(self, query_ids: np.ndarray, kind) -> pa.RecordBatch | None:
        good = (self.score > self.lowest) & (self.score >= self.floor[:, None])
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            return None
        offsets = pa.array(np.concatenate([[0], np.cumsum(good[some].sum(axis=1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[some][good[some]], t)) for x, t in ((self.id, pa.int64()), (self.score, kind))]
        return pa.RecordBatch.from_arrays([pa.array(query_ids[some], pa.int64()), *lists], names=["query_id", "ids", "scores"])


def rounds(rows: np.ndarray, block: np.ndarray, bound: np.ndarray):
    """(rows, blocks, bounds) of the first of each row's blocks, then of the second and so on, in
    order of rising bounds."""
    order = np.lexsort((bound, rows))
    rows, block, bound = rows[order], block[order], bound[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    by = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[by])) + 1
    for part in np.split(by, edges) if len(by) else ():
        yield rows[part], block[part], bound[part]


def grouped(rows: np.ndarray, block: np.ndarray):
    """(block, rows) for the rows that meet each block."""
    by = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[by])) + 1
    for part in np.split(by, edges):
        if len(part):
            yield int(block[part[0]]), rows[part]


def lists_of(segments: DataFrame, chunks, kind: str, search: Callable) -> DataFrame:
    """query_id, ids, scores: the lists of all tasks, for all chunks.

    chunks yields (query_ids, *more); search(chunk) gives a function from the tuples of a segment's
    columns to the chunk's TopLists, which it fills.
    """
    spark, folder = segments.sparkSession, shared_folder(segments.sparkSession, "lists")
    schema, arrow = f"query_id long, ids array<long>, scores array<{kind}>", {"long": pa.int64(), "double": pa.float64()}[kind]
    spark.createDataFrame([], schema).write.parquet(folder)
    for chunk in chunks:
        shared = spark.sparkContext.broadcast(chunk)

        def run(batches, shared=shared):
            take, top = search(shared.value)
            for b in batches:
                for segment in zip(*(c.to_pylist() for c in b.columns)):
                    take(*segment)
            if (rows := top.rows(shared.value[0], arrow)) is not None:
                yield rows

        segments.mapInArrow(run, schema).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(schema).parquet(folder)


def best(lists: DataFrame, k: int, kind: str) -> DataFrame:
    """Merges the tasks' lists: query_id, rank, vec_id, score."""
    each = lists.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").cast(kind).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
