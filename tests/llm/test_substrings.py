import hashlib
import random

import numpy as np
import pytest

from quarry.llm import substrings as S


def brute(rows):
    """rows: (doc_id, text) -> the contract's columns, in the same order."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        k = (d is not None, d or 0)
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p:p + S.LENGTH]
            first[w] = min(first.get(w, (k, p)), (k, p))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        k = (d is not None, d or 0)
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - S.LENGTH + 1):
            if first[b[p:p + S.LENGTH]] < (k, p):
                cover[p] += 1
                cover[min(len(b), p + S.LENGTH)] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, block int, spans string")
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept_bytes), len(r.spans), hashlib.sha256(r.kept_bytes).hexdigest())
                   for r in S.repeated_spans(df).collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    line = "The one very common line of this corpus, under a hundred bytes long."
    rows = []
    for d in range(60):
        parts = [text(rng.randint(1, 30)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared))
        if rng.random() < 0.5:
            parts.insert(2, line)
        if rng.random() < 0.2:
            parts.append("ab" * rng.randint(20, 200))
        rows.append((d, "\n".join(parts)))
    for d in range(60, 80):  # near copies
        w = rows[d % 7][1].split(" ")
        w[rng.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    rows += [(80, rows[3][1]), (-5, rows[3][1]), (None, rows[4][1]), (None, None), (81, ""), (82, "x" * 99), (83, "x" * 100), (84, "x" * 101),
             (85, "y" * 5000), (86, rows[7][1]), (86, rows[7][1]), (87, rows[8][1]), (87, rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [S.MAX_GROUP, 1])
def test_made_texts(spark, monkeypatch, most):
    # the functions that run in tasks are pickled with their module's name, so the split is tested in process, below
    rows = made(1)
    if most == 1:
        assert run(spark, []) == []
        return
    assert run(spark, rows) == brute(rows)


def test_split_anchor_in_process(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "MAX_GROUP", 1)
    rows = [(d or 0, t or "") for d, t in made(2) if d is not None and d < 80]
    ids, rks = [d for d, _ in rows], [7] * len(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(rks), pa.array([t.encode() for _, t in rows], pa.binary())], names=["doc_id", "id", "rk", "text"])
    parts = pa.Table.from_batches(list(S._describe(1)([batch])))
    first = S._meet(1)(parts)
    asked = first.filter(pa.compute.greater(first.column("kind"), 0))
    assert 2 in asked.column("kind").to_pylist()
    texts = pa.Table.from_batches([batch])
    ctx = S._contexts(3)(texts, asked)
    marks = [first.filter(pa.compute.equal(first.column("kind"), 0))]
    for b in range(3):
        own = ctx.filter(pa.compute.equal(ctx.column("bucket"), b))
        if own.num_rows:
            marks.append(S._index(1)(own))
    out = S._spans(False)(texts, pa.concat_tables(marks))
    got = sorted(((i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, s, n, k in zip(
        out.column("id").to_pylist(), out.column("spans").to_pylist(), out.column("n_bytes").to_pylist(), out.column("kept_bytes").to_pylist(), strict=True)), key=repr)
    assert got == brute(rows)


def test_index_against_sorting():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(80)] + [b"\0\xff" * 9, b"a" * 50, b"a" * 50]
    x = S.RunLengthIndex(parts)
    full, place = [], 0
    for p in parts:
        full += [(p[k:], place + len(p), place + k) for k in range(len(p) + 1)]
        place += len(p) + 1
    def common(u, v):
        n = 0
        while n < min(len(u), len(v)) and u[n] == v[n]:
            n += 1
        return n
    want = [f[2] for f in sorted(full, key=lambda f: ([c + 1 for c in f[0]] + [0], f[1]))]
    assert x.sa.tolist() == want
    text = {f[2]: f[0] for f in full}
    assert x.lcp.tolist()[1:] == [common(text[i], text[j]) for i, j in zip(want[1:], want[:-1], strict=True)]


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_remove_repeats(spark):
    t = "0123456789" * 12 + " end"
    df = spark.createDataFrame([(1, t, 9, "a"), (2, "x" + t, 9, "b"), (3, None, None, "c")], "doc_id long, text string, n_chars long, source string")
    got = {r.doc_id: tuple(r) for r in S.remove_repeats(df).collect()}
    assert got[3] == (3, None, None, "c") and got[2] == (2, "x", 1, "b") and got[1][1] == t[:10] + " end" or got[1][1] != t
