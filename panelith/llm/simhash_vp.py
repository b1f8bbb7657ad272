"""SimHash near-duplicates: exact Hamming links through vantage-point trees, then components.

Fingerprints.  Words are lower-cased (A-Z); every 3-word shingle, repeats included, is hashed with
XXH64 (seed 42); a bit is set where over half the hashes set it.

Links.  Only distinct fingerprints are compared, so exact copies cost nothing.  A vantage-point
tree over a bounded sample of fingerprints (``SAMPLE``) parts the space by Hamming distance to a
vantage point, inside or outside its median.  Every fingerprint lives in one leaf; it also visits
the leaves to the right of its own that its ball of radius 3 may reach, by the triangle bound on
the way down.  A leaf is worked off in tiles of at most ``TILE`` residents and ``TILE`` residents
or visitors, however many rows it has; inside a tile, rows are sorted by distance to two more
vantage points and only rings within the radius meet.  A tile emits a spanning forest of its links
and never the pairs themselves, so a group of n near copies costs n rows.

Components.  Forest edges are contracted by large-star / small-star rounds on DataFrames; each
round is written to the shared folder (a few edges, up to a fixed number, are solved in one task).
Nothing but counts comes to the driver.

The tree is exact, but random 64-bit codes lie close to 32 bits from everything, so a ball of
radius 3 crosses more than half of all medians: work grows almost with the square of the distinct
fingerprints, and the tree takes away a constant factor (see the README for figures).

Nulls and empty texts have no words: fingerprint zero, linked like any other.  A null id belongs
to its component but is never its smallest id; alone it has a null component.  Very long texts:
memory follows the longest text.  Repeated rows each get their class's component; a fingerprint
that many rows share is joined without a shuffle of these rows.  Empty tables: an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch, ensure_checkpoint_dir, join_hot, texts_of

#: Fingerprints sampled for the tree; least and most residents that a leaf aims at, and how many
#: leaves there are at least between the two.  Fewer, larger leaves have fewer visitors in all.
SAMPLE, LEAST_LEAF, MOST_LEAF, LEAVES = 20_000, 1_000, 50_000, 32
#: Most residents of a tile, and most of what they are compared with.
TILE = 65_536

_LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set.

    Eight bits are added at a time, one in each byte of a word, over runs of 255 hashes.
    """
    total = np.zeros(64, np.int64)
    pad = -len(h) % 255
    rows = np.concatenate([h, np.zeros(pad, np.uint64)]).reshape(-1, 255) if pad else h.reshape(-1, 255)
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        total[k::8] = np.ascontiguousarray(lanes.astype("<u8")).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """The hash of every n-word shingle, repeats included; a shorter text is one shingle."""
    words = text.encode().lower().split()  # ASCII case, ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    cut = [line[a:b] for a, b in zip((ends - sizes)[: 1 - n].tolist(), ends[n - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut))


def majority(hashes: np.ndarray) -> int:
    return int(_POWERS[2 * bit_counts(hashes) > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str, n: int = 3) -> int:
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long)."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64).view(np.int64)
            return batch({"id": (b.column(0), None), "fp": (fp, pa.int64())})

        return run

    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return arrow_map(slim, make, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


# ---- the tree ----------------------------------------------------------------------------------


def build_tree(sample: np.ndarray, leaves: int):
    """Nested tuples (vantage point, radius, inside, outside); a leaf is its number.

    The vantage point is the sampled one whose distances spread most, of a few candidates: the
    wider the spread, the fewer balls cross the boundary.
    """
    rng, count = np.random.default_rng(7), iter(range(1 << 40))

    def node(points: np.ndarray, want: int):
        if want <= 1 or len(points) < 16:
            return next(count)
        best = None
        for i in rng.choice(len(points), min(12, len(points)), replace=False):
            d = np.bitwise_count(points ^ points[i])
            spread = float(d.std())
            if best is None or spread > best[0]:
                best = (spread, points[i], d)
        _, point, d = best
        radius = int(np.median(d))
        inside = d <= radius
        if inside.all() or not inside.any():
            radius = int(d.max()) - 1
            inside = d <= radius
            if radius < 0 or inside.all() or not inside.any():
                return next(count)
        left = max(1, round(want * float(inside.mean())))
        return (int(point), radius, node(points[inside], left), node(points[~inside], max(1, want - left)))

    return node(sample, leaves)


def route(tree, fps: np.ndarray, reach: int, visit: bool = False):
    """(row, leaf, is home) for every leaf that each fingerprint's ball may reach and that does not
    lie to the left of its home; with ``visit`` for every leaf in reach, none of them home."""
    out = []

    def walk(node, rows: np.ndarray, home: np.ndarray):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            out.append((rows, np.full(len(rows), node), home))
            return
        point, radius, inside, outside = node
        d = np.bitwise_count(fps[rows] ^ np.uint64(point)).astype(np.int64)
        own = d <= radius
        # a pair whose homes differ is found from the left one: only rows at home go on to the right
        walk(inside, rows[np.where(home, own, d - reach <= radius)], home[np.where(home, own, d - reach <= radius)])
        right = np.where(home, ~own | (d + reach > radius), d + reach > radius)
        walk(outside, rows[right], (home & ~own)[right])

    walk(tree, np.arange(len(fps)), np.full(len(fps), not visit))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


class Forest:
    """Union-find over arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[x] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_tile(one: np.ndarray, two: np.ndarray | None, reach: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all links within ``one`` (``two`` None), or between ``one`` and ``two``, as
    positions in ``one`` followed by ``two``."""
    sides = [one] if two is None else [one, two]
    cells, orders, starts = [], [], []
    for f in sides:
        d1, d2 = (np.bitwise_count(f ^ p).astype(np.int64) for p in points[:2])
        orders.append(np.lexsort((d2, d1)))
        cells.append((d1 * 65 + d2)[orders[-1]])
        starts.append(np.searchsorted(cells[-1], np.arange(65 * 65 + 1)))
    f, g = one[orders[0]], sides[-1][orders[-1]]
    begin, base = starts[-1], len(one) if two is not None else 0
    forest = Forest(sum(map(len, sides)))
    for c in np.unique(cells[0]).tolist():
        a, z = int(starts[0][c]), int(starts[0][c + 1])
        d1, d2 = divmod(c, 65)
        # rings within the radius; among themselves only the same cell or a later one
        ranges = []
        for r in range(max(0, d1 - reach) if two is not None else d1, min(64, d1 + reach) + 1):
            low = a if two is None and r == d1 else int(begin[r * 65 + max(0, d2 - reach)])
            ranges.append((low, int(begin[r * 65 + min(64, d2 + reach) + 1])))
        other = np.concatenate([np.arange(x, y) for x, y in ranges])
        if not len(other):
            continue
        step = max(1, (1 << 21) // len(other))
        theirs = g[other]
        for s in range(a, z, step):
            e = min(z, s + step)
            i, j = np.nonzero(np.bitwise_count(f[s:e, None] ^ theirs[None, :]) <= reach)
            i, j = orders[0][i + s], base + orders[-1][other[j]]
            real = i != j
            forest.join(i[real], j[real])
    root = forest.roots(np.arange(len(forest.parent)))
    child = np.flatnonzero(root != np.arange(len(root)))
    return root[child], child


def tiles(routed: DataFrame, key: str, tile: int) -> DataFrame:
    """Deals rows (leaf, home, ...) out to tiles (leaf, i, j), with a column side; home goes.

    The residents of a leaf are cut into blocks and its visitors into slices, by a hash of ``key``.
    A tile is a block by itself (all of side 0), two blocks, or a block and a slice (sides 0, 1),
    so every resident meets all residents and visitors in tiles of bounded size.
    """
    spark = routed.sparkSession
    # a row a leaf; the tree, made of a bounded sample, has a bounded number of leaves
    sizes = routed.groupBy("leaf").agg(F.sum(F.col("home").cast("long")).alias("r"), F.sum((~F.col("home")).cast("long")).alias("v"))
    parts = sizes.selectExpr("leaf", f"greatest(1, cast(ceil(r / {tile}) as int)) as blocks", f"cast(ceil(v / {tile}) as int) as slices")
    parts = F.broadcast(spark.createDataFrame(parts.collect(), "leaf long, blocks int, slices int"))
    own = F.pmod(F.xxhash64(key, F.lit(3)), F.when(F.col("home"), F.col("blocks")).otherwise(F.col("slices"))).cast("int")
    at = routed.join(parts, "leaf").withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("own", i).alias("i"), F.greatest("own", i).alias("j"), (F.col("own") > i).cast("int").alias("side")))
    met = F.when(F.col("slices") > 0, F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.col("own").alias("i"), (F.col("blocks") + s).alias("j"), F.lit(0).alias("side"))))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), (F.col("blocks") + F.col("own")).alias("j"), F.lit(1).alias("side")))
    where = F.when(F.col("home"), F.concat(pairs, F.coalesce(met, F.expr("cast(array() as array<struct<i:int,j:int,side:int>>)")))).otherwise(visits)
    return at.withColumn("at", F.explode(where)).withColumns({"i": F.col("at.i"), "j": F.col("at.j"), "side": F.col("at.side").cast("boolean")}).drop("at", "own", "blocks", "slices", "home")


def links(classes: DataFrame, reach: int = 3, sample: int = SAMPLE, leaf: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: they span every group of linked ones."""
    n = classes.count()
    leaf = leaf or min(MOST_LEAF, max(LEAST_LEAF, n // LEAVES))
    # a bounded sample only shapes the tree; the links are exact whatever it is
    rows = classes.orderBy(F.xxhash64("fp", F.lit(11))).limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(rows, -(-n // leaf)) if n else 0
    points = rows[:2] if len(rows) >= 2 else np.array([0, 1], np.uint64)

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps), 4096):
                some = fps[k : k + 4096]
                row, at, home = route(tree, some.view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(some[row]), pa.array(home.astype(bool))], names=["leaf", "fp", "home"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, side = pdf["fp"].to_numpy(np.int64), pdf["side"].to_numpy(bool)
        both = np.concatenate([fps[~side], fps[side]])
        a, b = link_tile(fps[~side].view(np.uint64), fps[side].view(np.uint64) if side.any() else None, reach, points)
        return pd.DataFrame({"a": both[a], "b": both[b]})

    spread_out = classes.select("fp").mapInArrow(spread, "leaf long, fp long, home boolean")
    return tiles(spread_out, "fp", tile).groupBy("leaf", "i", "j").applyInPandas(run, "a long, b long")


def union_find(batches):
    """From batches of edges to (node, root)."""
    ends = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if ends:
        a, b = (np.concatenate(x) for x in zip(*ends))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(at[: len(a)], at[len(a) :])
        yield batch({"node": (nodes, pa.int64()), "root": (nodes[forest.roots(np.arange(len(nodes)))], pa.int64())})


#: Edges that one task solves at once (some 10 MB); more are contracted in rounds.
FEW_EDGES = 200_000


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for all nodes of undirected edges (a, b); root is the component's smallest node.

    Up to ``few`` edges go through union-find in one task.  More: alternating large-star and
    small-star steps; every step keeps the components and lets each node see a smaller neighbour,
    until all edges of a component point to one root.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct().checkpoint()
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(union_find, "node long, root long")
    before = None
    for _ in range(rounds):
        # large star: every neighbour larger than u, and u itself, to u's smallest neighbour
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).checkpoint()
        edges = both.join(low, "a").where("b > a and b <> m").selectExpr("b as a", "m as b").unionByName(low.where("a <> m").selectExpr("a", "m as b")).distinct().checkpoint()
        # small star: neighbours not larger than u, and u itself, to the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        edges = edges.join(low, "a").where("b <> m").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b")).distinct().checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root").distinct())


def near_duplicates(docs: DataFrame, reach: int = 3, id_col: str = "doc_id", text_col: str = "text", leaf: int | None = None, tile: int = TILE) -> DataFrame:
    """Per document: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable)."""
    ensure_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, id_col, text_col).checkpoint()
    classes = marked.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c")).checkpoint()
    roots = components(links(classes, reach, leaf=leaf, tile=tile)).checkpoint()
    lows = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("low").alias("low")).checkpoint()
    linked = roots.join(lows, "root").selectExpr("node as fp", "low as component_id")
    every = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "c").checkpoint()
    done = join_hot(marked, every, ["fp"], "c")
    return done.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
