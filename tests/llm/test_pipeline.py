"""Each stage on what its predecessor kept, against brute-force versions."""

import re
from collections import Counter

import pytest
import test_mixing
import test_neardup
import test_quality
import test_substrings

import corpus_pipeline as C
from quarry.llm import mixing, quality
from quarry.llm.scratch import save
from quarry.llm.substrings import LENGTH

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def cut_repeats(rows):
    """(doc_id, text) -> text without the bytes of earlier strings of LENGTH bytes."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = t.encode()
        for p in range(len(b) - LENGTH + 1):
            first.setdefault(b[p:p + LENGTH], (d, p))
    out = {}
    for d, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - LENGTH + 1):
            if first[b[p:p + LENGTH]] < (d, p):
                gone.update(range(p, p + LENGTH))
        out[d] = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["quality", "near_dedup", "repeats", "mixture", "tokens"]
    tables = [docs]
    for _, f in C.STAGES:
        tables.append(save(f(spark, tables[-1], sf_dir)))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])

    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert sorted(map(repr, rows[1])) == sorted(repr(r) for r in rows[0] if verdict[r.doc_id])
    assert not any(test_quality.base(r.text)[-1] for r in rows[1])

    kept = {d for d, _, _, k in test_neardup.brute([(r.doc_id, r.text) for r in rows[1]], 5, 80) if k}
    assert sorted(map(repr, rows[2])) == sorted(repr(r) for r in rows[1] if r.doc_id in kept)

    want = cut_repeats([(r.doc_id, r.text) for r in rows[2]])
    assert {r.doc_id: r.text for r in rows[3]} == want and len(rows[3]) == len(rows[2])
    assert all(r.n_chars == len(r.text) for r in rows[3] if r.text != next(x.text for x in rows[2] if x.doc_id == r.doc_id))

    sizes = Counter()
    for r in rows[3]:
        sizes[r.source] += test_mixing.size(r.text)
    targets, taken = test_mixing.targets(sizes), Counter()
    for r in rows[4]:
        taken[r.source] += test_mixing.size(r.text)
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    texts = {r.doc_id: r.text for r in rows[3]}
    assert all(texts[r.doc_id].startswith(r.text) for r in rows[4])

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        from quarry.llm.bpe import read_ranks
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    assert (Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in rows[5])
            == Counter((r.doc_id, len(i), tuple(i)) for r in rows[4] for i in [enc.encode_ordinary(r.text)]))


def test_edges(spark):
    good = "The quick brown fox jumps over a lazy dog near the old river bank. " * 1
    words = re.findall(r"\w+", good)
    text = lambda k: " ".join(words[(i * (k + 1) + i // 7) % len(words)] + str((i * k) % 13) for i in range(80))
    rows = [(1, text(1), "en", "a", 5, "x"), (1, text(1), "en", "a", 5, "x"), (2, text(2), "en", None, None, "x"), (None, text(3), None, "b", 1, None), (3, None, "en", "a", 0, ""),
            (4, "", "en", "a", 0, ""), (5, text(5) + " " + "long" * 50000, "en", "b", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for data in (df, df.limit(0)):
        t = data
        for _, f in C.STAGES[:-1]:
            t = save(f(spark, t, ""))
            assert t.columns == df.columns
        out = C.STAGES[-1][1](spark, t, "").collect()
        assert bool(out) == (data is df)
    assert mixing.mix(df).columns == df.columns


def test_substring_brute_agrees():
    rows = [(d, t or "") for d, t in test_substrings.made(5) if d is not None and 0 <= d < 60]
    cut = cut_repeats(rows)
    assert {d: len(cut[d].encode()) <= n - gone for d, n, gone, *_ in test_substrings.brute(rows)} == dict.fromkeys(cut, True)
