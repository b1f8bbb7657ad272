"""run() against a plain version of its stages, on a small fixture; odd tables."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelith.llm import quality_gam
from panelith.llm.pack_bins import CAPACITIES
from panelith.llm.tables import WORD_FILE, stored, tokenizer_path
from tests.llm.test_near_copies import alike, plain_set
from tests.llm.test_operators import brute_runs, plain_best_fit, some_docs

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(seed=3):
    """Good and bad texts, shared passages, near copies, copies, empty and odd ones, a long one."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(700)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    passage = "\n".join(line(14) for _ in range(4))
    rows, labels = [], []
    for i in range(90):
        if i % 4 == 3:
            text = " ".join(r.choice(["$$", "!!!", "BUY", "99", "#x"]) for _ in range(60))
        else:
            text = "\n".join(line(r.randrange(6, 16)) for _ in range(r.randrange(2, 9))) + (f"\n{passage}" if i % 9 == 0 else "")
        rows.append((i, text))
        labels.append((i, int(i % 4 != 3), 0))
    for i in range(90, 110):
        lines = rows[(i - 90) * 4][1].split("\n")
        lines[0] = line(9) if i % 2 else lines[0]
        rows.append((i, "\n".join(lines)))
    rows += [(200, ""), (201, None), (202, " \n "), (203, "\n".join(line(12) for _ in range(1500)))]
    return rows, labels


def plain_run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    model = quality_gam.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good = [(i, t) for i, t in rows if model.predict(np.array([quality_gam.features(t or "")]))[0] >= quality_gam.THRESHOLD]
    assert 60 < len(good) < len(rows)
    left = brute_runs(good, 10)
    lines = lambda t: 0 if t is None else t.count("\n") + 1
    kept = [(i, left.get((i, t), t)) for i, t in good if not ((i, t) in left and left[i, t] == "" and plain_gone(t, left[i, t], lines))]
    before, now = {i: plain_set(t) for i, t in rows}, {i: plain_set(t) for i, t in kept}
    stay, seen = [], set()
    ids = sorted(now)
    close = lambda a, b: any(alike(x, y) for x in (before[a], now[a]) for y in (before[b], now[b]))
    for i in ids:
        if i in seen:
            continue
        stay.append(i)
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in ids if y not in seen and close(x, y)]
    lib, texts, pieces = Tokenizer.from_file(tokenizer_path(WORD_FILE)), dict(kept), []
    for i in sorted(stay):
        n = len(lib.encode(texts[i] or "", add_special_tokens=False).ids) + 1
        pieces += [(i, k, at, min(CAPACITIES[-1], n - at)) for k, at in enumerate(range(0, n, CAPACITIES[-1]))]
    out = []
    for b, (members, size) in enumerate(zip(*plain_best_fit([p[3] for p in pieces], CAPACITIES, 16))):
        used, position = sum(pieces[m][3] for m in members), 0
        for m in members:
            out.append((*pieces[m], b, size, used, position))
            position += pieces[m][3]
    return sorted(out)


def plain_gone(text, left, lines):
    """All its lines went (a text of one empty line that stays is no such case)."""
    return lines(text) > 1 or text != left


def write(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_rows_equal_plain_version(spark, tmp_path):
    rows, labels = fixture()
    write(spark, str(tmp_path), rows, labels)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "n_tokens", "bin_id", "capacity", "used", "position").collect())
    assert got == plain_run(spark, rows, labels)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, labels = fixture(4)
    write(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    assert all(r.n_chars == len(r.text or "") for r in at.collect())


@pytest.mark.parametrize("some", [True, False])
def test_empty_tables(spark, tmp_path, some):
    """No documents; no documents and no labels."""
    write(spark, str(tmp_path), [], [(1, 1, 0)] if some else [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["score", "lines_deleted", "node", "th", "p", "n", "id", "key", "bin_id"]
    rows = [(i, t, "en", "s", len(t or ""), *"x" * len(names)) for i, t in some_docs()]
    spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("n_tokens > 0").count() > 20
