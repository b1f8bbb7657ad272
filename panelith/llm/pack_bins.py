"""Variable-capacity best-fit packing of documents into training sequences.

Lengths come from the tokens of the word-level file; only they are shuffled, never the texts.
Documents are dealt by a hash of id and length into blocks of about ``BLOCK`` documents, so bins
depend on the rows alone and not on files, partitions or Arrow batches.  A text longer than the
largest capacity fills whole sequences of that size first; its rest is packed like any other piece.

Pieces go in order of falling length into the open bin with the least room that holds them.  If
there is none, a bin is opened.  Its size is decided then, over all permitted sizes at once: for
each, the bin is filled on trial with the largest pieces still to come and downsized to what it
then holds; the size of the least cost a token is opened (of equal ones the largest).  The cost of
a bin is its size plus ``overhead`` positions.  In the end each bin is downsized to the smallest
permitted size that holds its contents.

Nulls and empty texts: length 0 plus the end token each piece of a document's end carries, so
every document is placed.  Ties: by id, then length; equal rows (same id, same length) are counted
first, so that a hot id spreads over the blocks, and are packed each.  Very long texts: see above.
Empty tables: no bins.  Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch, stored, texts_of
from .word_ids import WordEncoder, width_of

CAPACITIES = (512, 1024, 2048, 4096)
BLOCK = 32_768


def least_cost(length: int, sizes: list[int], left: list[int], capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted size to open for a piece of ``length``.

    sizes: lengths still to come, rising; left: how many there are of each.
    """
    best = None
    for c in capacities:
        if c < length:
            continue
        room, j = c - length, len(sizes)
        while True:
            j = bisect_right(sizes, room, 0, j) - 1
            if j < 0:
                break
            room -= min(left[j], room // sizes[j]) * sizes[j]
        held = c - room
        cost = (next(x for x in capacities if x >= held) + overhead) / held
        if best is None or cost <= best[0]:
            best = (cost, c)
    return best[1]


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16) -> tuple[list[list[int]], list[int]]:
    """Members (numbers of lengths) and final sizes of the bins; lengths are positive."""
    capacities = tuple(sorted(capacities))
    known, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    sizes, left = known.tolist(), counts.tolist()
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    members: list[list[int]] = []
    size: list[int] = []
    room: list[int] = []
    for number in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[number]
        left[-1] -= 1
        if not left[-1]:
            del sizes[-1], left[-1]
        at = bisect_left(open_, (length, -1))
        if at < len(open_):
            _, k = open_.pop(at)
        else:
            k = len(members)
            members.append([])
            size.append(least_cost(length, sizes, left, capacities, overhead))
            room.append(size[k])
        members[k].append(number)
        room[k] -= length
        if room[k] > 0:
            insort(open_, (room[k], k))
    return members, [next(c for c in capacities if c >= s - r) for s, r in zip(size, room)]


def lengths_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n, the tokens of each text with its end token."""

    def make():
        # one a task: in a pipeline, the worker's memory is wanted by the stages after this one
        encoder = WordEncoder(path, width_of(path))
        return lambda b: batch({"id": (b.column(0), None), "n": ([n + 1 for n in encoder.counts(texts_of(b))], pa.int64())})

    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return arrow_map(slim, make, f"id {slim.schema['id'].dataType.simpleString()}, n long", rows=512)


def pack_documents(docs: DataFrame, path: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a piece: id, piece (from 0), start and n_tokens (within the document's ids, its end
    token included), bin_id, capacity, used (of the bin), position (of the piece in the bin)."""
    capacities = tuple(sorted(capacities))
    lengths = stored(lengths_of(docs, path, id_col, text_col), "lengths")
    blocks = max(1, -(-lengths.count() // block))
    kinds = {"piece": pa.int32(), "start": pa.int64(), "n_tokens": pa.int64(), "bin_id": pa.int64(), "capacity": pa.int32(), "used": pa.int32(), "position": pa.int32()}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("n", "ascending")]).combine_chunks()
        doc, piece, start, length, most = [], [], [], [], capacities[-1]
        for i, n in enumerate(t.column("n").to_pylist()):
            for k, at in enumerate(range(0, n, most)):
                doc.append(i)
                piece.append(k)
                start.append(at)
                length.append(min(most, n - at))
        base = t.column("block")[0].as_py() << 32
        rows: dict[str, list] = {k: [] for k in kinds}
        at_doc = []
        for k, (group, size) in enumerate(zip(*best_fit(length, capacities, overhead))):
            used, position = sum(length[i] for i in group), 0
            for i in group:
                at_doc.append(doc[i])
                for name, v in zip(kinds, (piece[i], start[i], length[i], base + k, size, used, position)):
                    rows[name].append(v)
                position += length[i]
        ids = t.column("id").take(pa.array(at_doc, pa.int64()))
        return pa.table({"id": ids} | {k: pa.array(v, kinds[k]) for k, v in rows.items()})

    schema = f"id {lengths.schema['id'].dataType.simpleString()}, piece int, start long, n_tokens long, bin_id long, capacity int, used int, position int"
    each = lengths.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c")).select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("k"))
    dealt = each.select(F.pmod(F.xxhash64("id", "n", "k"), F.lit(blocks)).alias("block"), "id", "n")
    return dealt.groupBy("block").applyInArrow(run, schema).withColumnRenamed("id", id_col)
