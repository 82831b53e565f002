import re
from collections import defaultdict

import pytest

from quarry.llm import mixing as M


def size(t):
    return len(re.findall(M.WORD, t or ""))


def targets(sizes):
    """Water filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= level * w[s]]
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size long, key string")
    got = M.mixture(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, M.mixture(df.repartition(3)).collect()))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    want = targets(total)
    taken, partial = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert r.taken >= epochs * r.size
        partial[r.source] += epochs * r.size < r.taken < (epochs + 1) * r.size
        taken[r.source] += r.taken
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, size(t)) for d, t, _ in rows if d is not None)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in total) and all(n <= 1 for n in partial.values())


def test_edges(spark):
    check(spark, [(i, "w " * (i % 17), ["a", "b", "é", None, "Z"][i % 5]) for i in range(200)] + [(7, None, "a"), (8, "", "empty"), (None, "x y", "b"),
                  (None, "x y", "b"), (500, "one " * 40000, "b"), (501, "p q", "only"), (501, "p q", "only")])
    check(spark, [(1, "", "a"), (2, None, None)])
    check(spark, [])


def test_documents(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()])


def test_mix_takes_what_mixture_says(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.taken for r in M.mixture(docs).collect()}
    out = M.mix(docs)
    assert out.columns == docs.columns
    got, texts = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] += size(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) or r.text == texts[r.doc_id]
    assert got == {d: n for d, n in want.items() if n}


def test_weights_favour_quality(spark):
    rows = [(i, f"good words number {i} here" if i % 2 else f"### $$$ %%% {i} ***", "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = {r.doc_id: r.taken - r.size for r in M.mixture(df).collect()}
    assert sum(v > 0 for d, v in t.items() if d % 2) > 1.5 * sum(v > 0 for d, v in t.items() if d % 2 == 0)
