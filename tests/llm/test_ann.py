import math

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann as A
from quarry.llm.queries import QUERIES


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and math.isfinite(x) for x in v) and any(v)}]
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q)
            out[q] = d[:k]
    return out


def check(got, want, least):
    by_q = {}
    for r in got:
        by_q.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by_q) == {q for q, d in want.items() if d}
    hits = total = 0
    for q, d in want.items():
        mine = sorted(by_q.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(d) + 1))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hits += len({i for *_, i in mine} & {i for _, i in d})
        total += len(d)
    assert hits >= least * total
    return hits / max(1, total)


def test_edges(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(0, 260)] + [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]),
            (700, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (800, [1.0, 2.0]), (900, []), (100, [2.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = A.search(df, F.col("vec_id") % 100 == 0).collect()
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 3])
    assert check(got, want, 1.0) == 1.0
    for n in (0, 1, 4):
        few = df.limit(n)
        assert len(A.search(few, F.col("vec_id") % 100 == 0).collect()) == max(0, n - 1)


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.5, 0.25] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    check(A.search(df, F.col("vec_id") % 100 == 0).collect(), brute(rows), 0.95)


def test_recall_on_embeddings(spark):
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        print(sf, check(QUERIES["op4_balanced_posting_lists"](spark, d).collect(), brute(rows), 0.9))


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(700, 16)), rng.normal(size=(60, 16))
    g = A.CentroidGraph(c)
    ids, d = g.search(q, 64)
    full = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    assert np.mean(ids[:, 0] == full.argmin(1)) > 0.9 and np.allclose(d[:, 0], full[np.arange(60), ids[:, 0]])
    ids, _ = g.search(q[:3], 700)
    assert all(sorted(r.tolist()) == list(range(700)) for r in ids)


def test_halving_is_balanced():
    x = np.random.default_rng(4).normal(size=(1000, 8))
    x[:300] = 1.0
    assert len(A.halve(x, 16)) == 16
