"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from panelith.llm import near_copies
from tests.llm.test_operators import some_docs


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def plain_stay(rows):
    """Smallest ids of the components of rows (id, text), all ids known."""
    sets, left, out = {i: plain_set(t) for i, t in rows}, {i for i, _ in rows}, set()
    while left:
        start = min(left)
        out.add(start)
        left.discard(start)
        todo = [start]
        while todo:
            x = todo.pop()
            near = {y for y in left if alike(sets[x], sets[y])}
            left -= near
            todo += near
    return out


def copies(seed=5):
    """Texts of 40 to 200 words with copies that lose 1 to 12 % of their words, one large family."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(900)]
    rows = [(i, t) for i, t in some_docs() if i is not None and i != 7]
    at = 1000
    for k in range(60):
        text = [r.choice(words) for _ in range(r.randrange(40, 200))]
        for _ in range(25 if k == 0 else 4):
            changed = [r.choice(words) if r.random() < (0.01 if k == 0 else 0.005 * (1 + k % 5)) else w for w in text]
            rows.append((at, " ".join(changed)))
            at += 1
    return rows


def test_stage_removes_what_brute_force_finds(spark):
    rows = copies()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(5)
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == plain_stay(rows)
    few = near_copies.keep_one(df, leaf=40, tile=16)
    assert {r.doc_id for r in few.collect()} == plain_stay(rows)
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_leftovers_go_with_their_documents(spark, tmp_path):
    """Near copies of which line removal has left a few lines: the texts before it tell."""
    rows = [(i, t.replace(" a", "\na") if t else t) for i, t in copies(7)]
    whole = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    left = [(i, "\n".join(t.split("\n")[k % 3 :: 3]) if t and i >= 1000 and i % 2 else t) for k, (i, t) in enumerate(rows)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(left, "doc_id long, text string").repartition(4), str(tmp_path)).collect()}
    before, after = {i: plain_set(t) for i, t in rows}, {i: plain_set(t) for i, t in left}
    near = {i: {j for j in before if i != j and (alike(before[i], before[j]) or alike(after[i], after[j]) or alike(before[i], after[j]) or alike(after[i], before[j]))} for i in before}
    want, seen = set(), set()
    for i in sorted(near):
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x] - seen
    assert got == want and len(got) < len(plain_stay(left))


def test_other_texts_of_the_same_id_do_not_count(spark):
    """Lines that are not in the other text, ids that repeat, null ids."""
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "m n o p q r"), (3, "s t u v w x"), (None, "y z a b c d"), (4, "k k k k k l")]
    other = [(1, "one text"), (2, "one text"), (3, "one text"), (None, "one text"), (4, "one text\nk k k k k l"), (4, "k k k k k l\none text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.keep_one(docs, others=spark.createDataFrame(other, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows)


def test_equal_rows_and_clashing_names(spark):
    names = ["stay_id_0", "equal_text_0", "node", "th", "id", "copies", "i", "t", "key"]
    rows = [(1, "a b c", *"x" * 9), (1, "a b c", *"y" * 9), (None, None, *"x" * 9), (None, None, *"x" * 9), (None, "", *"z" * 9), (2, "other words here", *"x" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]


def test_tiles_lose_no_similar_pair():
    """All pairs, with a reach of all bits: only sizes drop candidates, and none that is alike."""
    sets = [near_copies.shingle_set(t or "") for _, t in copies(6)]
    f1, f2 = (np.array(x, np.uint64) for x in zip(*map(near_copies.fingerprints_of, sets)))
    size, n = np.array([len(s) for s in sets], np.int64), len(sets)
    for side in (np.zeros(n, bool), np.arange(n) % 3 == 0):
        i, j = near_copies.tile_pairs(f1, f2, size, np.arange(n), side, 64, 128, False)
        found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
        assert len(found) == len(i)
        want = {frozenset((a, b)) for a in range(n) for b in range(a) if (side[a] != side[b] or not side.any()) and len(sets[a]) and near_copies.similar(sets[a], sets[b])}
        assert want and want <= found
        assert all(abs(near_copies.band(int(size[a])) - near_copies.band(int(size[b]))) <= 1 for a, b in map(tuple, want))


def test_sketches_lose_no_similar_pair():
    sets = [near_copies.shingle_set(t or "") for _, t in copies(8)] + [np.arange(30_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    sets.append(sets[-1][2000:])
    rows, size = np.array([np.frombuffer(near_copies.sketch(s), np.uint8) for s in sets]), np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    may = near_copies.may_be_similar(rows[i], rows[j], size[i], size[j])
    real = np.array([near_copies.similar(sets[a], sets[b]) for a, b in zip(i, j)])
    assert real.any() and not (real & ~may).any() and may.sum() < 3 * real.sum() + 60


def test_no_task_grows_with_its_leaf(spark):
    """Tiles hold a bounded number of rows, whatever the size of a leaf, and every pair meets."""
    rows = [(leaf, k, home) for leaf in (1, 2) for k, home in [(k, k % 3 > 0) for k in range(300 * leaf)]]
    from panelith.llm.simhash_vp import tiles

    dealt = tiles(spark.createDataFrame(rows, "leaf long, k long, home boolean"), "k", 50).toPandas()
    assert dealt.groupby(["leaf", "i", "j"]).size().max() <= 3 * 50
    met = set()
    for (leaf, _, _), g in dealt.groupby(["leaf", "i", "j"]):
        a, b = g.loc[~g.side, "k"], g.loc[g.side, "k"]
        pairs = [(x, y) for x in a for y in (b if len(b) else a) if x != y]
        met |= {(leaf, min(p), max(p)) for p in pairs}
    assert met == {(leaf, x, y) for leaf in (1, 2) for x in range(300 * leaf) for y in range(x + 1, 300 * leaf) if x % 3 or y % 3}


def cloud(n=300, words=400, seed=3):
    """Texts that are alike by about 0.78: some pairs are linked, most are not."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    return [(k, " ".join(f"x{r.random()}" if r.random() < 0.013 else w for w in base)) for k in range(n)]


def test_shares_of_a_tile_give_every_pair_once(monkeypatch):
    """However many candidates are not in one group: a look gives about ``given`` pairs, then STEP
    times what was given, and all of them in the end."""
    sets = [near_copies.shingle_set(t) for _, t in cloud()]
    f1, f2 = (np.array(x, np.uint64) for x in zip(*map(near_copies.fingerprints_of, sets)))
    size, n = np.array([len(s) for s in sets], np.int64), len(sets)
    node = np.array([near_copies.name_of(s) for s in sets], np.int64)
    sketches = np.array([np.frombuffer(near_copies.sketch(s), np.uint8) for s in sets])
    tile = f1, f2, size, np.arange(n), np.zeros(n, bool), near_copies.REACH, near_copies.REACH_BOTH, False, sketches
    want = set(zip(*(x.tolist() for x in near_copies.tile_pairs(*tile))))
    assert len(want) > 20 * n
    for held, looks in ((near_copies.HELD, 6), (2 * n, 200)):
        monkeypatch.setattr(near_copies, "HELD", held)
        low, met, most = 0, [], []
        while low < near_copies.PARTS:
            i, j, low = near_copies.tile_share(node, low, n, *tile)
            met += zip(i.tolist(), j.tolist())
            most.append(len(i))
        assert len(met) == len(set(met)) and set(met) == want
        assert 2 <= len(most) <= looks and most[0] <= n and max(most) <= max(held, n)


def test_groups_meet_over_several_looks(spark, monkeypatch):
    """Few pairs of a cloud are given at a time, and the groups are those of brute force."""
    rows = cloud(120) + [(1000 + i, t) for i, t in copies() if i >= 1000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    given, whole = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a, **b: given.append(pairs.count()) or whole(pairs, *a, **b))
    got = near_copies.keep_one(df, least=16)
    assert {r.doc_id for r in got.collect()} == plain_stay(rows)
    assert len(given) > 2
