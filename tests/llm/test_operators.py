"""Brute force, round trips and held-out accuracy for the operators that SQL cannot express."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from panelith.llm import ann_projection, bloom_lm, line_runs, pack_bins, quality_gam, records, simhash_vp, topk_blocks
from panelith.llm.tables import WORD_FILE, stored, tokenizer_path

WORD = tokenizer_path(WORD_FILE)


def some_docs(n=60, seed=0):
    """Invented texts with copies, near copies, empty and null ones, and repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(3, 14))) for _ in range(r.randrange(1, 9)))
        rows.append((i, text))
    for i in range(n, n + 12):
        rows.append((i, rows[i % 5][1]))
    for i in range(n + 12, n + 20):
        rows.append((i, rows[i % 5][1] + " " + r.choice(words)))
    rows += [(200, ""), (201, None), (202, "  \n\t"), (None, "lost id here"), (None, None), (7, rows[7][1]), (203, "One"), (204, rows[3][1] + "\n" + rows[4][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in some_docs()], "doc_id long, text string, score string, fp double").repartition(5)


# ---- 1 quality ---------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = docs.join(labels, "doc_id").select("doc_id", "text", "quality")
    got = quality_gam.score(part, quality_gam.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 300 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    good, bad = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97  # area under the curve


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 2")):
        model = quality_gam.fit(docs, known)
        got = quality_gam.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5} == {False}
        assert quality_gam.keep_good(docs, model).columns == docs.columns
    assert quality_gam.score(docs.limit(0), model).count() == 0


def plain_features(text):
    """The features, counted character by character and word by word."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality_gam.FEATURES)
    n, chars = len(raw), [chr(b) for b in raw]
    share = lambda f: sum(map(f, chars)) / n
    low = lambda c: ord(c) < 128
    words = [w.decode("latin-1") for w in raw.lower().split()]
    d, pairs = max(1, len(words)), list(zip(words, words[1:]))
    marks, ends = "#$%&*|@^~_=<>{}\\/+`[]!", ".?!"
    return [
        math.log1p(n), math.log1p(len(words)), share(lambda c: low(c) and c.isupper()), share(lambda c: c in ".,;:'\"()-"),
        share(lambda c: low(c) and c.isprintable() and not c.isalnum() and c not in " .,;:'\"()-!?"), share(lambda c: low(c) and c.isdigit()), share(lambda c: c in " \t\r\x0b\x0c"),
        share(lambda c: c == "\n"), share(lambda c: not low(c)), share(lambda c: c in "!?"), len({c for c in chars if "a" <= c <= "z"}) / 26,
        sum(c not in " \t\n\x0b\x0c\r" for c in chars) / d, len(set(words)) / d, sum(x == y for x, y in pairs) / max(1, len(pairs)), len(set(pairs)) / max(1, len(pairs)),
        sum(w[-1] in marks for w in words) / d, sum(w[-1] in ends for w in words) / d, sum(w in marks for w in words if len(w) == 1) / d,
    ]


def test_scores_are_sums_of_table_entries(spark, docs):
    """Every score again, by looking up one bin after the other."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(70)], "doc_id long, quality int")
    model = quality_gam.fit(docs, labels)
    assert any(t.any() for t in model.tables)

    def plain(text):
        x = plain_features(text)
        assert quality_gam.features(text or "") == pytest.approx(x)
        bins = [sum(v >= e for e in edges.tolist()) for v, edges in zip(quality_gam.features(text or ""), model.edges)]
        z = model.intercept + sum(float(t[b]) for t, b in zip(model.tables, bins)) + sum(float(t[bins[i], bins[j]]) for i, j, t in model.pairs)
        return 1 / (1 + math.exp(-z))

    want = sorted((str(i), round(plain(t), 9)) for i, t in some_docs())
    got = quality_gam.score(docs, model).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want and all(r.predicted == (r.score >= 0.3) for r in got)


def test_interactions_are_learnt():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.train(x, y)
    assert model.pairs and ((model.predict(x) > 0.5) == y).mean() > 0.9


# ---- 2, 3 vectors ------------------------------------------------------------------------------


def vector_rows(n=900, d=12, seed=3):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) * r.uniform(0.2, 2, (n, 1))
    v[50:90] = v[50]  # ties
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)]
    rows += [(2000, None), (2020, [None] * d), (2040, [float("nan")] + [0.0] * (d - 1)), (2060, [float("inf")] * d), (2080, [0.0] * d), (None, [1.0] * d), (40, rows[40][1])]
    return rows


def sound(rows, zero):
    return [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v) and (zero or any(v))]


def brute(rows, k, score):
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            out[i] = sorted(((score(q, v), j) for j, v in rows if j != i), key=lambda x: (-x[0], x[1]))[:k]
    return out


def as_lists(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_blocks, "BLOCK", 32)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    want = brute([(i, np.floor(v * 64).astype(int)) for i, v in sound(rows, True)], 20, lambda a, b: int(a @ b))
    assert as_lists(topk_blocks.top_k(df)) == want
    few = df.where("vec_id < 5")
    assert [len(x) for x in as_lists(topk_blocks.top_k(few)).values()] == [4]
    assert topk_blocks.top_k(df.limit(0)).count() == 0


def test_blocks_are_pruned():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 5, (4096, 8)), r.integers(30, 60, (64, 8))])
    q = r.integers(1, 9, (10, 8))
    top = topk_blocks.TopLists(10, 5, np.full(10, topk_blocks._LOWEST), np.int64, topk_blocks._LOWEST)
    scored = topk_blocks.search_segment(np.arange(len(x)), x, np.full(10, -1), q, top)
    assert scored < 40 and (np.sort(top.score, axis=1) == np.sort(np.sort(q @ x.T, axis=1)[:, -5:], axis=1)).all()


def test_large_numbers_stay_exact():
    q, x = np.array([[2**30, 3]]), np.array([[2**30, 1], [2**20, 7]])
    assert topk_blocks.products(q, x).tolist() == [[2**60 + 3, 2**50 + 21]]


def test_nearest_neighbours_recall(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    want = brute(sound(rows, False), 20, lambda a, b: float(a @ b))
    got = as_lists(ann_projection.nearest(df))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    vectors = dict(sound(rows, False))
    assert all(abs(s - float(vectors[q] @ vectors[j])) < 1e-9 for q in got for s, j in got[q])
    # the copies of one vector tie exactly, wherever they lie: the smallest ids come first
    copies = [x for q in got for x in [[j for _, j in got[q] if 50 <= j < 90]] if len(x) > 1]
    assert copies and all(x == sorted(x) for x in copies)
    assert ann_projection.nearest(df.limit(0)).count() == 0


def test_nearest_neighbours_recall_on_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = zip(*((r.vec_id, r.embedding) for r in df.collect()))
    want = brute([(i, np.array(x, float)) for i, x in zip(ids, v)], 20, lambda a, b: float(a @ b))
    got = as_lists(ann_projection.nearest(df))
    assert sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_chi_square_quantile():
    assert abs(ann_projection.chi_square_quantile(0.95, 10) - 18.307) < 1e-3
    assert abs(ann_projection.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9


# ---- 5 language model --------------------------------------------------------------------------


def exact_model(rows, quantised):
    """Base figures, and the log-probability of each text, by plain counting."""
    docs = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    train = [w for i, w in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs = collections.Counter(), collections.Counter()
    for w in train:
        c.update(w)
        pairs.update(zip([b"", *w], w))
    n, v = sum(c.values()), len(c)
    value = (lambda k: float(bloom_lm.VALUE[bloom_lm.levels_of(np.array([k]))[0]])) if quantised else float
    q = {x: value(k - 1) for x, k in pairs.items() if k > 1}
    repeats = collections.Counter()
    for (h, _), k in q.items():
        repeats[h] += k
    base = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda x, h: (q.get((h, x), 0) + (c[h] - repeats[h]) * base(x)) / c[h] if c[h] else base(x)

    def score(w):
        return len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), sum(math.log10(p(x, h)) for h, x in zip([b"", *w], w))

    return docs, c, p, base, score


@pytest.mark.parametrize("quantised", [False, True])
def test_rows_of_the_model_sum_to_one(quantised):
    """Over all words and the one word that is not known, for every history."""
    rows = [(i, " ".join(random.Random(i).choice("abcde") for _ in range(40))) for i in range(30)] + some_docs()
    _, c, p, base, _ = exact_model(rows, quantised)
    unknown = b"never seen"
    assert abs(sum(map(base, [*c, unknown])) - 1) < 1e-9
    for h in [*c, unknown]:
        row = [p(x, h) for x in [*c, unknown]]
        assert abs(sum(row) - 1) < 1e-9 and max(row) <= 1


@pytest.mark.parametrize("limit", [160, 0])
def test_language_model(spark, docs, limit, monkeypatch):
    """``limit`` 0: every segment is a broadcast of its own, and the passes add up to the same."""
    monkeypatch.setattr(bloom_lm, "bucket_bits", lambda n: 3)
    got = bloom_lm.score_documents(docs, max_broadcast_mb=limit, entry_bits=400).collect()  # hardly any false positives
    texts, *_, score = exact_model(some_docs(), True)
    want = collections.Counter((i, *(round(x, 5) for x in score(w))) for i, w in texts)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in some_docs() if i is not None and zlib.crc32(str(i).encode()) % 5 == 1}
    exact = exact_model(some_docs(), False)[-1]
    # quantisation takes less than BASE from a count
    assert all(abs(score(w)[4] - exact(w)[4]) <= len(w) * math.log10(2) for _, w in texts)


def test_false_positives_are_few(spark, docs):
    texts, *_, score = exact_model(some_docs(), True)
    want = sum(score(w)[4] for _, w in texts)
    assert abs(sum(r.score for r in bloom_lm.score_documents(docs).collect()) - want) < 0.03 * abs(want)


def test_text_of_a_training_document_scores_higher(spark):
    """A text that occurs twice is more probable than one like it that occurs once."""
    r = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    got = {x.doc_id: x.score / x.n_tokens for x in bloom_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    twice = [got[i] for i in range(60) if trained(i) and trained(1000 + i)]
    once = [got[i] for i in range(60, 300)]
    assert len(twice) > 20 and min(twice) > max(once)


def test_language_model_without_training_rows(spark):
    one = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = bloom_lm.score_documents(one).collect()
    assert all((r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == 0 for r in got) and got
    assert bloom_lm.score_documents(one.limit(0)).count() == 0


def test_levels_and_probes():
    counts = np.array([1, 2, 3, 5, 8, 100, 10**6])
    lv = bloom_lm.levels_of(counts)
    assert (np.diff(lv) >= 0).all() and lv[0] == 1
    assert (bloom_lm.VALUE[lv] <= counts).all() and (counts < np.maximum(bloom_lm.VALUE[lv] + 1, bloom_lm.VALUE[lv] * bloom_lm.BASE)).all()


# ---- 6 lines -----------------------------------------------------------------------------------


def brute_runs(rows, least):
    """Lines to delete: every window of lines with enough words that has an earlier copy."""
    docs, first, dead = sorted({(i is not None, i or 0, xx(t), t) for i, t in rows if t is not None}), {}, collections.defaultdict(set)
    for d, (_, _, _, t) in enumerate(docs):
        lines = t.split("\n")
        sizes = [len([w for w in x.encode().split()]) for x in lines]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(sizes[s:e]) >= least:
                    first.setdefault(tuple(lines[s:e]), (d, s))
    for d, (known, i, _, t) in enumerate(docs):
        lines = t.split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if first.get(tuple(lines[s:e]), (d, s)) != (d, s):
                    dead[(i if known else None, t)].update(range(s, e))
    return {k: "\n".join(x for n, x in enumerate(k[1].split("\n")) if n not in v) for k, v in dead.items()}


def xx(t):
    x = xxhash.xxh64_intdigest(t.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("least", [1, 4, 10])
def test_line_runs(spark, docs, least):
    r = random.Random(least)
    lines = ["a b c", "d", "", "e f g h", "i j", "k l m n o p q r s t u v"]
    rows = some_docs() + [(300 + i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 12)))) for i in range(25)] + [(400, "\n" * 40 + "a b c\nd"), (401, "\n" * 40 + "a b c\nd")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, th int").repartition(3)
    want = brute_runs(rows, least)
    got = line_runs.delete_runs(df, least).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in got) == sorted((str(i), str(want.get((i, t), t))) for i, t in rows)
    assert all(x.lines_deleted == 0 or x.ranges_deleted for x in got)


def test_suffix_array_and_common_prefixes(spark):
    """Against plain sorting of all suffixes: long copies, periodic runs, runs that end early."""
    r = random.Random(6)
    texts = ["\n".join(r.choice("abc") for _ in range(n)) for n in (1, 5, 40, 40)] + ["\n".join("ab" * 30), "\n".join("a" * 50), "\n".join("ab" * 30), "once\na\nb\nnever\na\nb\na"]
    texts += ["\n".join(str(k) for k in range(90))] * 2 + ["\n".join(str(k) for k in range(70))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    at = line_runs.positions(df, "doc_id", "text")
    rows = {x.p: x for x in at.collect()}
    runs = collections.defaultdict(list)
    for p in sorted(rows):
        runs[rows[p].run].append(p)
        assert runs[rows[p].run] == list(range(rows[p].run, p + 1))
    suffix = {p: tuple(rows[q].head[0] for q in run[k:]) for run in runs.values() for k, p in enumerate(run)}
    assert all(len(s) == rows[p].left and s[: line_runs.HEAD] == tuple(rows[p].head) for p, s in suffix.items())
    paths = line_runs.suffix_paths(at)
    array = stored(line_runs.suffix_array(paths), "test-array")
    got = sorted(array.collect(), key=lambda x: x["at"])
    want = sorted(set(suffix.values()))
    assert [suffix[x.p] for x in got] == want
    count = collections.Counter(suffix.values())
    assert [x.n for x in got] == [count[s] for s in want] and [x.before for x in got] == [None, *(x.p for x in got[:-1])]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = {x.p: x.lcp for x in line_runs.common_prefixes(array, paths).collect()}
    assert lcp == {x.p: common(suffix[x.p], suffix[x.before]) for x in got[1:]}


@pytest.mark.parametrize("least", [3, 30])
def test_long_and_periodic_runs(spark, least):
    lines = ["a b", "c", "", "d e f"]
    r = random.Random(least)
    long = "\n".join(r.choice(lines) + str(k) for k in range(150))
    rows = [(1, long), (2, "own\n" + long + "\nlines"), (3, "\n".join(["a b", "c"] * 40)), (4, "\n".join(["a b", "c"] * 25 + ["x y z"])), (5, long[:400]), (None, "c\na b\nc\na b\nc"), (6, "\n" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_runs(rows, least)
    assert sorted((str(x.doc_id), x.text) for x in line_runs.delete_runs(df, least).collect()) == sorted((str(i), want.get((i, t), t)) for i, t in rows)


def test_line_runs_keep_columns_of_like_names(spark):
    names = ["lines_before", "lines_deleted", "RANGES_DELETED", "run_id_0", "run_text_0", "id", "th", "ranges"]
    rows = [(i, "one two three four\nfive six seven eight\nnine ten eleven", *"x" * len(names)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_runs.delete_runs(df)
    assert got.columns == [*df.columns, "lines_before_0", "lines_deleted_0", "ranges_deleted_0"]
    assert sorted((x.doc_id, x.text != "", x.lines_deleted, x.lines_deleted_0) for x in got.collect()) == [(0, True, "x", 0), (1, False, "x", 3), (2, False, "x", 3)]


def test_hot_line(spark):
    """A third of all lines is one line."""
    r = random.Random(1)
    rows = [(i, "\n".join("hot line with words" if r.random() < 0.4 else f"{r.randrange(3000)} some words here" for _ in range(8))) for i in range(400)]
    want = brute_runs(rows, 10)
    got = line_runs.delete_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted((i, want.get((i, t), t)) for i, t in rows)


def test_line_runs_without_rows(spark, docs):
    assert line_runs.delete_runs(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert line_runs.delete_runs(one).first()["text"] is None


# ---- 7 records ---------------------------------------------------------------------------------


def test_crc32c():
    crc = records.Crc32c()
    assert crc.small(b"123456789") == 0xE3069283
    r = random.Random(0)
    items = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 255, 256, 257, 1000)]
    assert crc.many(items) == [crc.small(x) for x in items]


def test_records_round_trip(spark, docs, tmp_path):
    lib, folder = Tokenizer.from_file(WORD), str(tmp_path / "rec")
    index = records.write_records(docs, folder, WORD, 2, file_bytes=2000)
    got = records.with_starts(records.read_records(spark, folder, with_ids=True), index).orderBy("start").collect()
    assert len({r["shard"] for r in got}) > 3
    rows = some_docs()
    assert [r["id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = sorted((str(i), [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((str(r["id"]), r["ids"]) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    # the index alone finds a record in its file
    row = index.where("id = 9").first()
    path = next(p for p in (tmp_path / "rec" / "records").iterdir() if p.name.startswith(f"part-{row['shard']:05d}"))
    data = path.read_bytes()[row["offset"] : row["offset"] + row["length"]]
    assert struct.unpack_from("<Q", data)[0] == len(data) - 16 and records.unpack_payload(next(records.Framer().read(data))[1])[0] == 9
    broken = bytearray(path.read_bytes())
    broken[row["offset"] + 40] ^= 1
    with pytest.raises(ValueError, match="broken"):
        list(records.Framer().read(bytes(broken)))


def test_records_without_rows(spark, docs):
    assert records.record_digest(docs.limit(0), WORD).count() == 0


# ---- 9 packing ---------------------------------------------------------------------------------


def test_packing_keeps_everything(spark, docs):
    long = spark.createDataFrame([(900, "word " * 9000)], "doc_id long, text string")
    lib = Tokenizer.from_file(WORD)
    got = pack_bins.pack_documents(docs.select("doc_id", "text").union(long), WORD, capacities=(64, 128, 512)).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for members in bins.values():
        used, size = sum(r.n_tokens for r in members), members[0].capacity
        assert used == members[0].used <= size and size in (64, 128, 512)
        assert size == min(c for c in (64, 128, 512) if c >= used)  # downsized
        at = 0
        for r in sorted(members, key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for i, t in [*some_docs(), (900, "word " * 9000)]:
        want[i] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    assert tokens == want
    assert pack_bins.pack_documents(docs.limit(0), WORD).count() == 0


def test_bins_do_not_depend_on_the_layout(spark, docs):
    """The same bins for three sizes of batches and two layouts."""
    found = set()
    slim = docs.select("doc_id", "text")
    for rows, parts in ((10_000, 1), (7, 3), (50, 9)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = pack_bins.pack_documents(slim.repartition(parts), WORD, capacities=(64, 128, 512), block=40).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found.add(tuple(sorted(tuple(str(v) for v in r) for r in got)))
    assert len(found) == 1 and len({r[4] for r in next(iter(found))}) > 3


def plain_best_fit(lengths, capacities, overhead):
    """The rule in its plainest form."""
    bins = []
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for at, number in enumerate(order):
        n = lengths[number]
        fit = [b for b in bins if b[0] - sum(lengths[i] for i in b[1]) >= n]
        if fit:
            room = min(b[0] - sum(lengths[i] for i in b[1]) for b in fit)
            next(b for b in bins if b in fit and b[0] - sum(lengths[i] for i in b[1]) == room)[1].append(number)
            continue
        costs = []
        for c in sorted(capacities):
            if c >= n:
                held = n
                for later in order[at + 1 :]:
                    held += lengths[later] if held + lengths[later] <= c else 0
                costs.append(((min(x for x in capacities if x >= held) + overhead) / held, -c))
        bins.append([-min(costs)[1], [number]])
    return [b[1] for b in bins], [min(c for c in capacities if c >= sum(lengths[i] for i in b[1])) for b in bins]


def cheapest(lengths, capacities, overhead):
    """The least cost of any packing."""
    best = math.inf

    def place(i, bins, used):
        nonlocal best
        cost = sum(min(c for c in capacities if c >= b) + overhead for b in bins)
        if i == len(lengths):
            best = min(best, cost)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(capacities):
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]], used)
        place(i + 1, [*bins, lengths[i]], used)

    place(0, [], 0)
    return best


def test_best_fit_against_brute_force():
    r = random.Random(11)
    for case in range(60):
        capacities, overhead = ((8, 16), (5, 9, 20), (4, 8, 16, 32))[case % 3], case % 4
        lengths = [r.randrange(1, max(capacities) + 1) for _ in range(r.randrange(0, 8))]
        members, sizes = pack_bins.best_fit(lengths, capacities, overhead)
        assert (members, sizes) == plain_best_fit(lengths, capacities, overhead)
        if lengths:
            assert cheapest(lengths, capacities, overhead) <= sum(sizes) + overhead * len(sizes) <= 1.6 * cheapest(lengths, capacities, overhead)


def test_best_fit_is_tight():
    r = random.Random(4)
    lengths = [r.randrange(1, 900) for _ in range(3000)]
    members, sizes = pack_bins.best_fit(lengths, (256, 512, 1024), overhead=0)
    assert sorted(i for m in members for i in m) == list(range(3000))
    assert sum(lengths) <= sum(sizes) <= 1.03 * sum(lengths)
    assert pack_bins.best_fit([]) == ([], [])


# ---- 10 near duplicates ------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys):
    """keys: {class: fingerprint}; class -> smallest class linked to it."""
    left, out = dict(keys), {}
    for start in sorted(keys):
        if start in left:
            del left[start]
            todo = [start]
            while todo:
                x = todo.pop()
                out[x] = start
                near = [y for y, fp in left.items() if (fp ^ keys[x]).bit_count() <= 3]
                for y in near:
                    del left[y]
                todo += near
    return out


@pytest.mark.parametrize("leaf, tile", [(8, 10**6), (10**6, 10**6), (40, 7)])
def test_near_duplicates(spark, docs, leaf, tile):
    rows = some_docs()
    got = simhash_vp.near_duplicates(docs, leaf=leaf, tile=tile).collect()
    known = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(known)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (known[r.doc_id], want[r.doc_id])
    assert len(got) == len(rows)
    lost = {r.fingerprint: r.component_id for r in got if r.doc_id is None}
    assert lost["0" * 16] == 200 and None in lost.values()


def test_hot_fingerprint(spark):
    """Most rows share a fingerprint: they stay where they are."""
    rows = [(i, "same words in every row" if i % 3 else f"text number {i} of many") for i in range(3000)]
    got = {r.doc_id: r for r in simhash_vp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    known = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(known)
    assert len(got) == 3000 and all((int(r.fingerprint, 16), r.component_id) == (known[i], want[i]) for i, r in got.items())


def test_links_in_a_cloud(spark):
    """Many fingerprints within a few bits of each other, over many leaves."""
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(600)}
    for centre in list(fps)[:12]:
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 4))))
    keys = {fp - (1 << 64) if fp >> 63 else fp: fp for fp in fps}
    classes = spark.createDataFrame([(k,) for k in keys], "fp long")
    got = {x.node: x.root for x in simhash_vp.components(simhash_vp.links(classes, leaf=60, sample=500, tile=50)).collect()}
    want = plain_components(keys)
    assert {k: v for k, v in want.items() if v != k}.items() <= got.items()
    assert all(want[k] == v for k, v in got.items())


@pytest.mark.parametrize("few", [0, 10**6])
def test_long_chain_of_links(spark, few):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000), (2001, 2000)], "a long, b long").repartition(4)
    got = {x.node: x.root for x in simhash_vp.components(chain, few=few).collect()}
    assert got == {**{i: 0 for i in range(401)}, 2000: 2000, 2001: 2000}


def test_near_duplicates_without_rows(spark, docs):
    assert simhash_vp.near_duplicates(docs.limit(0)).count() == 0


# ---- odd rows ----------------------------------------------------------------------------------


def test_very_long_texts(spark):
    """A text of 60,000 words beside short ones, in every operator on documents."""
    from panelith.llm import stream_bpe, token_counts
    from panelith.llm.tables import BYTE_FILE

    r = random.Random(12)
    long = "\n".join(" ".join(r.choice(["alpha", "beta", "gamma,", "delta", "it's", "12", "é"]) for _ in range(12)) for _ in range(5000))
    rows = [(1, long), (2, "x" * 200_000), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert quality_gam.score(df, quality_gam.fit(df, labels)).count() == 4
    lib, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(tokenizer_path(BYTE_FILE))
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df, WORD).collect()} == {i: len(v) for i, v in ids.items()}
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in records.record_digest(df, WORD).collect()}
    assert got == {i: (len(v) + 1, zlib.crc32(np.array([*v, 2], "<u4").tobytes())) for i, v in ids.items()}
    assert {x.doc_id: x.n_tokens for x in stream_bpe.encode_documents(df, tokenizer_path(BYTE_FILE)).collect()} == {i: len(byte.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    packed = collections.Counter()
    for x in pack_bins.pack_documents(df, WORD).collect():
        packed[x.doc_id] += x.n_tokens
    assert packed == {i: len(v) + 1 for i, v in ids.items()}
    scored = {x.doc_id: x.n_tokens for x in bloom_lm.score_documents(df).collect()}
    assert scored == {1: 60_001, 2: 2, 3: 2, 4: 1}
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {x.doc_id: int(x.fingerprint, 16) for x in simhash_vp.near_duplicates(df).collect()} == want
    twice = line_runs.delete_runs(df.unionAll(spark.createDataFrame([(5, long + "\nend")], "doc_id long, text string")))
    assert {x.doc_id: x.text for x in twice.collect()} == {**dict(rows), 5: "end"}


def test_records_are_read_in_splits(spark, tmp_path):
    """Files of many blocks, cut anywhere by the reader."""
    r = random.Random(13)
    rows = [(i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(9000))) for i in range(90)]
    df, folder = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "rec")
    index = records.write_records(df, folder, WORD, 2, file_bytes=3 << 20)
    shards = {x["shard"] for x in index.collect()}
    assert 1 < len(shards) < 20 and max(p.stat().st_size for p in (tmp_path / "rec" / "records").glob("part*")) > 1.5 * records.BLOCK_BYTES
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_003)
    try:
        got = records.with_starts(records.read_records(spark, folder), index).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x["id"] for x in got] == list(range(90))
    start = 0
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
        path = next(p for p in (tmp_path / "rec" / "records").iterdir() if p.name.startswith(f"part-{x['shard']:05d}"))
        data = path.read_bytes()[x["offset"] : x["offset"] + x["length"]]
        doc, ids = records.unpack_payload(next(records.Framer().read(data))[1])
        assert (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (x["id"], x["n_tokens"], x["ids_crc32"])


def test_ids_that_look_like_a_closing_frame():
    blocks = records.Blocks()
    raw = b"\0" * 3 + records.closing() + b"\0" * 5
    assert len(raw) % 2 == 0
    frame = blocks.framer.frames([records.payload(7, 2, raw)])[0]
    assert blocks.end in frame and blocks.add(7, 2, raw, frame) is None
    block = blocks.cut()
    assert blocks.end not in block
    (_, opening), (_, record) = blocks.framer.read(block)
    doc, ids = records.unpack_payload(record)
    assert records.unpack_opening(opening) == (0, 0) and doc == 7 and ids.astype("<u2").tobytes() == raw


def test_packing_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7), (None, None, 5, 6, 7)], "doc_id long, text string, n long, id long, block long")
    assert sorted((str(x.doc_id), x.n_tokens) for x in pack_bins.pack_documents(df, WORD).collect()) == [("1", 3), ("None", 1)]
