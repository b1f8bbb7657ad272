"""Near copies by Jaccard similarity of five-word shingles, found through fingerprints.

Two texts are linked if their sets of 5-word shingles (words as in ``simhash_vp``; a text of fewer
words is one shingle) have a Jaccard similarity of 0.8 or more; groups are components of links.

Texts with equal sets are one node.  A node has two fingerprints of 64 bits, made like those of
``simhash_vp`` from two hashes of its shingles; at a similarity of 0.8 about 10 bits of 64 differ,
give or take 3.  Candidates differ in at most ``REACH`` bits of the first and ``REACH_BOTH`` of
both.  Sets whose sizes differ by more than the similarity allows never meet: nodes are parted by
bands of size, in which only neighbours meet, and then by the vantage-point tree of ``simhash_vp``
and its tiles of bounded size.  Pairs are checked by sketches of their sets first (hashes counted in
``SLOTS`` slots: the counts never differ by more than the sets do, so no pair is lost), and links on
the sets themselves, so no pair below 0.8 is ever linked.

Large groups: a tile first gives a forest of its candidates, closest first.  The links that hold
make groups, and further looks give all candidates that are not in one group yet and that their
sketches, which are dealt out with the nodes from then on, do not rule out: texts that are alike by
less than about 0.77 are compared but give none.  A tile with more such candidates than rows gives
a share of them, by a hash of the pair; the links that hold join groups before it is looked at again
for the next share, 16 times as large, until all have been given.  A random share of the links
leaves few of the others between groups, so n near copies cost some multiple of n rows.  Candidates
that are not alike after all are each checked once, unless their groups meet first.

Texts are never shuffled to be checked: the nodes that are asked for are marked in a bit table of
bounded size (``TABLE_BITS``), which is broadcast; the rows that hit it give their sets.  Where the
table fills up, more sets than needed are made, and none is lost.

What can be missed: a pair further apart than the two reaches (see the README for figures).  At
this radius the tree takes away next to nothing: work grows with the square of the texts in a band.

A row may be judged by a further text too (``others``, by id): the pipeline gives the documents as
they were before lines were removed, so that what is left of a near copy goes with it.  It counts
only for an id that both tables have once, and if the row's lines are among that text's.

Nulls and empty texts have no shingles and are alike.  Very long texts: memory follows the longest
text.  Repeated rows and ties: see ``keep_one``.  Empty tables: an empty result.  Extra columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_lm import mix
from .simhash_vp import LEAST_LEAF, MOST_LEAF, SAMPLE, TILE, Forest, build_tree, components, majority, route, shingle_hashes, tiles
from .tables import arrow_map, batch, ensure_checkpoint_dir, free_names, stored, texts_of

#: Words of a shingle; bits that fingerprints of candidates may differ in, of 64 and of 128; least
#: similarity as a fraction.
SHINGLE, REACH, REACH_BOTH, SIMILAR = 5, 20, 35, (4, 5)
#: Slots of a set's sketch, of four bits each.
SLOTS = 1024
#: Bits of the table of rows that are asked for, at most (16 MB).
TABLE_BITS = 1 << 27
#: Candidates that a tile holds before it thins them to a forest, or to a smaller share.
HELD = 1 << 21
#: Shares of a tile's candidates are counted in 1 / PARTS; each look takes STEP times what was taken
#: before; a tile of fewer than LEAST_GIVEN candidates gives all at once.
PARTS, STEP, LEAST_GIVEN = 1 << 30, 16, 4096


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def name_of(hashes: np.ndarray) -> int:
    """The node: a hash of the set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def fingerprints_of(hashes: np.ndarray) -> tuple[int, int]:
    return majority(hashes), majority(mix(hashes))


def band(size: int) -> int:
    """Sets that may be similar are in the same band or in neighbours: a band spans 4 to 5."""
    return -1 if size == 0 else int(math.floor(math.log(size) / math.log(SIMILAR[1] / SIMILAR[0]) + 1e-9))


def sketch(hashes: np.ndarray) -> bytes:
    """Hashes in each slot, 15 for all above, two slots a byte."""
    n = np.minimum(np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=SLOTS), 15).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of sketches and sizes: |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t) at a similarity t or more."""
    apart = np.abs((a & 15).astype(np.int16) - (b & 15)).sum(axis=1, dtype=np.int64) + np.abs((a >> 4).astype(np.int16) - (b >> 4)).sum(axis=1, dtype=np.int64)
    return (SIMILAR[1] + SIMILAR[0]) * apart <= (SIMILAR[1] - SIMILAR[0]) * (m + n)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return SIMILAR[1] * both >= SIMILAR[0] * either


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) span all their groups, with the least distances d.  Equal
    distances come in random order: else one node would get all links of a group."""
    order = np.random.default_rng(5).permutation(len(i))
    order = order[np.argsort(d[order], kind="stable")]
    forest, kept = Forest(n), []
    for at in range(0, len(order), 4096):
        c = order[at : at + 4096]
        a, b = forest.roots(i[c]), forest.roots(j[c])
        for e, x, y in zip(c[a != b].tolist(), a[a != b].tolist(), b[a != b].tolist()):
            x, y = (int(v[0]) for v in (forest.roots(np.array([x])), forest.roots(np.array([y]))))
            if x != y:
                forest.parent[max(x, y)] = min(x, y)
                kept.append(e)
    return np.array(kept, np.int64)


def part_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of PARTS the pairs of nodes are in, whatever their order."""
    return (mix((a ^ b).view(np.uint64)) >> np.uint64(34)).astype(np.int64)


def tile_share(node: np.ndarray, low: int, given: int, *tile) -> tuple[np.ndarray, np.ndarray, int]:
    """``tile_pairs`` without a forest, of the parts from ``low`` to below the returned number, which
    is PARTS when nothing is left.  About ``given`` pairs, or STEP times what was given before; at
    most HELD and some."""
    high, floor = [PARTS], min(PARTS, max(1, STEP * low))

    def inside(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p = part_of(node[i], node[j])
        return (p >= low) & (p < high[0])

    def fewer(held: int) -> bool:
        if held > given and high[0] > floor:
            high[0] = max(floor, low + (high[0] - low) // STEP)
        elif held > HELD and high[0] > low + 1:
            high[0] = low + (high[0] - low) // 2
        else:
            return False
        return True

    i, j = tile_pairs(*tile, share=(inside, fewer))
    return i, j, high[0]


def tile_pairs(f1: np.ndarray, f2: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray, reach: int, both: int, forest: bool, sketches: np.ndarray | None = None, share: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (positions) of different roots among rows of side 0, or between sides 0 and 1 if
    there are any of side 1: all, a forest, or a share (see ``tile_share``)."""
    by_size = np.argsort(size, kind="stable")
    mine, guests = by_size[~side[by_size]], by_size[side[by_size]]
    others, alone = (guests, False) if len(guests) else (mine, True)
    sizes = size[others]
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def thin():
        i, j, d = (np.concatenate(x) for x in zip(*found))
        if forest:
            k = nearest_forest(len(f1), i, j, d)
            i, j, d = i[k], j[k], d[k]
        found[:] = [(i, j, d)]

    for s in range(0, len(mine), 64):
        rows = mine[s : s + 64]
        low, high = int(size[rows[0]]), int(size[rows[-1]])
        a = max(s if alone else 0, int(np.searchsorted(sizes, -(-low * SIMILAR[0] // SIMILAR[1]), "left")))
        z = int(np.searchsorted(sizes, high * SIMILAR[1] // SIMILAR[0], "right"))
        for at in range(a, z, 4096):
            theirs = others[at : min(z, at + 4096)]
            d = np.bitwise_count(f1[rows][:, None] ^ f1[theirs][None, :])
            x, y = np.nonzero(d <= reach)
            if alone:
                later = at + y > s + x
                x, y = x[later], y[later]
            i, j = rows[x], theirs[y]
            d = d[x, y].astype(np.int64) + np.bitwise_count(f2[i] ^ f2[j])
            ok = (d <= both) & (root[i] != root[j])
            ok &= SIMILAR[0] * np.maximum(size[i], size[j]) <= SIMILAR[1] * np.minimum(size[i], size[j])
            i, j, d = i[ok], j[ok], d[ok]
            if share:
                ok = share[0](i, j)
                i, j, d = i[ok], j[ok], d[ok]
            if sketches is not None:
                cuts = range(0, len(i), 16_384)
                may = [may_be_similar(sketches[i[k : k + 16_384]], sketches[j[k : k + 16_384]], size[i[k : k + 16_384]], size[j[k : k + 16_384]]) for k in cuts]
                ok = np.concatenate([np.zeros(0, bool), *may])
                i, j, d = i[ok], j[ok], d[ok]
            if len(i):
                found.append((i, j, d))
                held += len(i)
            if forest and held > HELD:
                thin()
                held = len(found[0][0])
            while share and share[1](held):
                found[:] = [tuple(v[ok] for v in (x, y, z)) for x, y, z in found for ok in [share[0](x, y)]]
                held = sum(len(x[0]) for x in found)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    thin()
    return found[0][:2]


def candidates(nodes: DataFrame, forest: bool, reach: int = REACH, both: int = REACH_BOTH, leaf: int | None = None, tile: int = TILE, rest: DataFrame | None = None, least: int = LEAST_GIVEN) -> DataFrame:
    """(a, b, upto = 0) of nodes (node, f1, f2, size, root and perhaps sketch) that may be similar
    and have other roots.  Without a forest also a row (a, b, upto, leaf) for each tile (leaf, i = a,
    j = b) that has given its parts below ``upto`` only: these rows, for the same nodes, are the next
    call's ``rest``, which goes on with those tiles."""
    n, more = nodes.count(), ["sketch"] if "sketch" in nodes.columns else []
    leaf = leaf or min(MOST_LEAF, max(LEAST_LEAF, n // 4))
    rows = nodes.orderBy(F.xxhash64("node", F.lit(11))).limit(SAMPLE).select("f1").toPandas()["f1"].to_numpy(np.int64).view(np.uint64)
    leaves = -(-n // leaf)
    tree = build_tree(rows, leaves) if n else 0
    most = max(1, leaves) * 2 + 16  # more than the tree has leaves

    def spread(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                some = b.slice(k, 2048)
                own = np.array([band(x) for x in some.column(3).to_pylist()], np.int64)
                fps = some.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                # in the own band, and in the next one, where all are visitors
                for up in (0, 1):
                    row, at, home = route(tree, fps, reach, visit=bool(up))
                    cols = [*some.take(pa.array(row)).columns, pa.array((own[row] + up) * most + at), pa.array(home.astype(bool))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*some.schema.names, "leaf", "home"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = {k: pdf[k].to_numpy(np.int64) for k in ("node", "f1", "f2", "size", "root")}
        what = cols["f1"].view(np.uint64), cols["f2"].view(np.uint64), cols["size"], cols["root"], pdf["side"].to_numpy(bool), reach, both, forest, np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, SLOTS // 2) if more else None
        if forest:
            i, j = tile_pairs(*what)
            high = PARTS
        else:
            i, j, high = tile_share(cols["node"], int(pdf["low"].iloc[0]), max(least, len(pdf)), *what)
        a, b, zero = cols["node"][i], cols["node"][j], np.zeros(len(i), np.int64)
        out = pd.DataFrame({"a": a, "b": b, "upto": zero, "leaf": zero})
        if high < PARTS:
            out.loc[len(out)] = [int(pdf[k].iloc[0]) for k in ("i", "j")] + [high, int(pdf["leaf"].iloc[0])]
        return out

    slim = nodes.select("node", "f1", "f2", "size", "root", *more)
    out = slim.mapInArrow(spread, "node long, f1 long, f2 long, size int, root long, " + "sketch binary, " * len(more) + "leaf long, home boolean")
    dealt = tiles(out, "node", tile)
    if rest is None:
        dealt = dealt.withColumn("low", F.lit(0).cast("long"))
    else:
        dealt = dealt.join(F.broadcast(rest.selectExpr("leaf", "cast(a as int) as i", "cast(b as int) as j", "upto as low")), ["leaf", "i", "j"])
    return dealt.groupBy("leaf", "i", "j").applyInPandas(run, "a long, b long, upto long, leaf long")


# ---- texts ---------------------------------------------------------------------------------------


def marks(texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """key (columns but the text), node, f1, f2, size and lines (sorted hashes of its lines) of each
    row of texts (key columns, text); with ``asked`` of the rows whose ``key`` is in it (and a few
    more)."""
    keys = [c for c in texts.columns if c != "text"]
    wanted = Wanted(asked)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            b = wanted(b)
            node, one, two, size, lines = [], [], [], [], []
            for t in texts_of(b):
                h = shingle_set(t)
                node.append(name_of(h))
                f, g = fingerprints_of(h)
                one.append(f)
                two.append(g)
                size.append(len(h))
                lines.append(np.unique(np.array([xxhash.xxh32_intdigest(x) for x in t.encode().split(b"\n")], np.uint32)).tobytes())
            bits = {k: (np.array(v, np.uint64).view(np.int64), pa.int64()) for k, v in (("f1", one), ("f2", two))}
            return batch({k: (b.column(k), None) for k in keys} | {"node": (node, pa.int64())} | bits | {"size": (size, pa.int32()), "lines": (lines, pa.binary())})

        return run

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields)
    return arrow_map(texts.select(*keys, "text"), make, f"{kinds}, node long, f1 long, f2 long, size int, lines binary")


class BitTable:
    """Which hashes of keys are asked for, in a table of at most ``TABLE_BITS`` bits."""

    def __init__(self, asked: DataFrame, key: str):
        n = asked.count()
        self.bits = min(TABLE_BITS, 1 << max(10, (16 * n).bit_length()))
        at = asked.select(F.pmod(F.col(key), F.lit(self.bits)).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        if at.num_rows:
            self.words[at.column("w").to_numpy()] = at.column("b").to_numpy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        p = keys % self.bits
        return (self.words[p >> 6] >> (p & 63)) & 1 == 1


class Wanted:
    """Rows of a batch whose ``key`` is among ``asked`` (and a few more); all, if that is None."""

    def __init__(self, asked: DataFrame | None):
        self.shared = asked and asked.sparkSession.sparkContext.broadcast(BitTable(asked, "key"))

    def __call__(self, b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(self.shared.value.has(b.column("key").to_numpy(zero_copy_only=False)))) if self.shared else b


def shingle_sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """node, size, sketch and hashes (32 bits of each) of the texts (key, text) that are asked for."""
    wanted = Wanted(asked)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t) for t in texts_of(wanted(b))]
            small = [np.unique((h >> np.uint64(16)).astype(np.uint32)).tobytes() for h in sets]
            return batch({"node": ([name_of(h) for h in sets], pa.int64()), "size": ([len(h) for h in sets], pa.int32()), "sketch": ([sketch(h) for h in sets], pa.binary()), "hashes": (small, pa.binary())})

        return run

    return arrow_map(texts.select("key", "text"), make, "node long, size int, sketch binary, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, sketched: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets (node, size, sketch, hashes) are similar; ``sketched``: their
    sketches have been compared already."""

    def may():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS // 2) for k in ("x", "y"))
            m, n = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("m", "n"))
            return b.select(["a", "b"]).filter(pa.array(may_be_similar(x, y, m, n), pa.bool_()))

        return run

    def check():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (([np.frombuffer(v.as_py(), np.uint32) for v in b.column(k)]) for k in (2, 3))
            ok = [similar(p, q) for p, q in zip(x, y)]
            return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return run

    if not sketched:
        one, two = sets.selectExpr("node as a", "size as m", "sketch as x"), sets.selectExpr("node as b", "size as n", "sketch as y")
        pairs = stored(arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y"), may, "a long, b long"), "may-be")
    one, two = sets.selectExpr("node as a", "hashes as x"), sets.selectExpr("node as b", "hashes as y")
    return stored(arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), check, "a long, b long"), "similar")


def earlier_texts(own: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of other texts of the same id whose lines hold the row's: (id, th of the row, key of
    the other text, node, f1, f2, size); and (key, text) of others.

    Only texts that differ from the row's own are read closely.
    """
    theirs = others.select("id", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("th"), "text").where("id is not null")
    same = theirs.select("id", "th").distinct()
    changed = own.where("id is not null").select("id", "th", "lines").join(same, ["id", "th"], "left_anti")
    single = own.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("id")
    changed = stored(changed.join(single, "id").withColumn("key", F.xxhash64("id")), "changed")
    marked = stored(marks(theirs.select("key", "id", "text"), changed).withColumnRenamed("lines", "all"), "earlier")
    once = marked.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("id")

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = ([np.frombuffer(v.as_py(), np.uint32) for v in b.column(k)] for k in ("lines", "all"))
            return b.filter(pa.array([bool(np.isin(p, q).all()) for p, q in zip(x, y)], pa.bool_()))

        return run

    met = changed.drop("key").join(marked.join(once, "id"), "id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields)
    return stored(arrow_map(met, make, kinds).drop("lines", "all"), "derived"), theirs.select("key", "text")


def keep_one(docs: DataFrame, reach: int = REACH, both: int = REACH_BOTH, id_col: str = "doc_id", text_col: str = "text", leaf: int | None = None, tile: int = TILE, others: DataFrame | None = None, least: int = LEAST_GIVEN) -> DataFrame:
    """docs, with its columns, without all but one document of each group of near copies.

    The document with the smallest id stays; of rows with that id, or of a group without ids, the
    one with the smallest hash of the text, and of rows equal in both any one.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    id_, th = F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(id_.alias("id"), th.alias("th"), F.col(text_col).cast("string").alias("text"))
    own = stored(marks(rows).groupBy("id", "th").agg(*[F.min(c).alias(c) for c in ("node", "f1", "f2", "size", "lines")], F.count(F.lit(1)).alias("copies")), "marked")
    every, asked_of, joints = own.withColumn("key", F.xxhash64("id", "th")), [rows.select(F.xxhash64("id", "th").alias("key"), "text")], None
    slim = every.select("node", "f1", "f2", "size", F.struct(F.lit(0).alias("w"), "key").alias("at"))
    if others is not None:
        earlier, texts = earlier_texts(own, others.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
        slim = slim.unionByName(earlier.select("node", "f1", "f2", "size", F.struct(F.lit(1).alias("w"), "key").alias("at")))
        asked_of.append(texts)
        mine = own.select("id", "th", F.col("node").alias("a"))
        joints = earlier.select("id", "th", F.col("node").alias("b")).join(mine, ["id", "th"]).select("a", "b")
    nodes = stored(slim.groupBy("node").agg(*[F.min(c).alias(c) for c in ("f1", "f2", "size", "at")]).withColumn("root", F.col("node")), "nodes")

    first = stored(candidates(nodes, True, reach, both, leaf, tile).select("a", "b"), "closest")
    asked = stored(first.selectExpr("a as node").unionByName(first.selectExpr("b as node")).distinct(), "asked")
    # every node that has a candidate at all is in the forest, so nothing else is asked for later
    near = stored(nodes.join(asked, "node"), "near")
    found = [shingle_sets(t, near.where(F.col("at.w") == w).selectExpr("at.key as key")) for w, t in enumerate(asked_of)]
    sets = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    sets = stored(sets.join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = verified(first, sets)
    rest, over = None, False
    while not over:  # a tile's share grows with each look, so there are few
        roots = stored(components(links), "groups")
        grouped = near.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets.select("node", "sketch"), "node")
        found = stored(candidates(stored(grouped, "grouped"), False, reach, both, leaf, tile, rest, least), "others")
        links = links.unionByName(verified(found.where("upto = 0").select("a", "b"), sets, sketched=True))
        rest = found.where("upto > 0")
        over = rest.isEmpty()
    if joints is not None:
        links = links.unionByName(joints)
    roots = stored(components(links), "groups")
    order = F.struct(F.col("id").isNull().alias("a"), "id", "th")
    leads = own.groupBy("node").agg(F.min(order).alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = leads.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.th")
    stay = stored(stay.join(own.select(F.col("id").alias("i"), F.col("th").alias("t"), "copies"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("i", "t", "copies"), "stay")

    i, t, key, text = free_names(docs, "stay_id", "stay_text", "equal_id", "equal_text")
    kept = lambda s: docs.join(s.select(F.col("i").alias(i), F.col("t").alias(t)), id_.eqNullSafe(F.col(i)) & (th == F.col(t)), "left_semi")
    out = kept(stay.where("copies = 1"))
    if not stay.where("copies > 1").isEmpty():  # equal rows: any one of them
        again = kept(stay.where("copies > 1")).withColumns({key: id_, text: th}).dropDuplicates([key, text]).select(*docs.columns)
        out = out.unionByName(again)
    return out
