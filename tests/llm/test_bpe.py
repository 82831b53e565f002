import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quarry.llm import bpe  # noqa: E402
from quarry.llm.queries import QUERIES  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.TreeEncoder(ranks)


def texts():
    rng = random.Random(4)
    out = ["", " ", "\n\n  x", "a" * 3000, "ab" * 2000, "é" * 999, "\U0001F600" * 300, "\0\x01", "thequickbrownfox" * 200, "0123456789" * 300, "!?" * 500]
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeiounst ", "üößäéè", "01", "日本語テキスト", "\r\n\t "):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 5, 24, 25, 49, 200, 1500)]
    return out


def test_tree_against_library(known):
    enc, tree = known
    import regex
    for t in texts():
        ids = [i for p in regex.findall(P.PATTERN, t) for i in tree.encode(p.encode())]
        assert ids == enc.encode_ordinary(t)
        assert tree.decode_tree(np.array([0, len(ids), len(ids)]), np.array(ids, np.int32)) == [t.encode(), b""]


def test_leaves_side_by_side_against_one_by_one(known):
    _, tree = known
    import regex
    found = [regex.findall(P.PATTERN, t) for t in texts()]
    tree.remember(found)
    assert all(np.frombuffer(tree.memo[p], np.int32).tolist() == tree.encode(p.encode()) for x in found for p in x)
    for size in (1, 2, 3, 7, 24):
        rng = random.Random(size)
        leaves = [bytes(rng.choice(b"abcdeinst \xc3\xa9\xff") for _ in range(size)) for _ in range(300)]
        assert [np.frombuffer(x, np.int32).tolist() for x in tree.pairs.merge(leaves)] == [tree.direct(x) for x in leaves]


def test_joins_against_direct(known):
    _, tree = known
    for t in texts():
        b = t.encode()[:600]
        for cut in (1, 7, len(b) // 2):
            assert tree.join(tree.direct(b[:cut]), tree.direct(b[cut:])) == tree.direct(b)


def test_query_and_edges(spark, known, sf_dir):
    enc, _ = known
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe_round_trip"](spark, sf_dir).collect()}
    assert got == want
    rows = [(i, t, i) for i, t in enumerate([*texts(), None])] + [(None, "x", 1)] * 2
    df = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, P.PATTERN)
    out = df.select("*", bpe.decoder(df, PATH)("ids").alias("back")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert bpe.encode(df.limit(0).drop("ids"), PATH, P.PATTERN).collect() == []
