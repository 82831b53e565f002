"""Operator 13: chunks give back the texts, and counts and scores equal brute force."""

import random
import re
from collections import Counter

import numpy as np

from quarry.llm.collocations import chunks, collocations, phrase_counts
from quarry.llm.textkit import LOWER

KIND = "doc_id long, text string, lang string"


def pieces(text):
    s = (text or "").encode().translate(LOWER).decode()
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", s) if (w := re.findall("[^\x20\x09]+", p))]


def brute(rows, least, top, absorbed=50):
    counts = {}
    for _, text, lang in rows:
        c = counts.setdefault(lang or "und", [Counter() for _ in range(4)])
        for w in pieces(text):
            for n in (1, 2, 3):
                c[n].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {g: a for n in (2, 3) for g, a in c[n].items() if a >= least}
        longer = Counter()
        for g, a in found.items():
            if len(g) == 3:
                for s in (g[:2], g[1:]):
                    longer[s] = max(longer[s], a)
        ranked = []
        for g, a in found.items():
            if len(g) == 3 or 100 * longer[g] < absorbed * a:
                score, k = min((1000000 * a * a // (c[k][g[:k]] * c[len(g) - k][g[k:]]), k) for k in range(1, len(g)))
                ranked.append((-score, -a, " ".join(g).encode(), c[k][g[:k]], c[len(g) - k][g[k:]]))
        for rank, (s, a, p, lf, rf) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, lf, rf, sum(c[1].values()), -s))
    return sorted(out)


def sample():
    rnd = random.Random(11)
    words = ["The", "of", "new", "york", "été", "a\x00b", "city", "straße", "\U0001F600", "x-y"]
    rows = []
    for i in range(400):
        n = rnd.choice([0, 1, 2, 5, 30, 200])
        text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\r\n", ""]) for _ in range(n))
        rows.append((i, text, rnd.choice(["en", "en", None, "und", "fr"])))
    passage = " ".join(rnd.choice(words) for _ in range(300))
    return rows + [(1, None, "en"), (None, passage, "de"), (3, "   ", None)] + [(9, passage + f" {i % 3} york", "en") for i in range(60)]


def test_chunks_give_back_the_words_each_owned_once():
    texts = [(r[1] or "").encode() for r in sample()]
    for mean in (1, 3, 16):
        for text, own in zip(texts, chunks(texts, 2, mean), strict=True):
            words = []
            for c in own:
                last = c.endswith(b"\n")
                w = re.split(b"[ \n]", c.rstrip(b"\n"))
                words += w if last else w[:-2]
            assert words == [x.encode() for p in pieces(text.decode()) for x in p]
            assert sum(c.endswith(b"\n") for c in own) == (len(own) > 0)


def test_equal_passages_share_chunks():
    rnd = np.random.default_rng(1)
    passage = " ".join(map(str, rnd.integers(0, 500, 2000))).encode()
    a, b = chunks([b"here stands " + passage, b"something else altogether, " + passage + b" end"], 2, 16)
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_counts_and_scores_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, KIND).selectExpr("doc_id", "text", "lang", "1 as phrase", "2 as f", "3 as words")
    for least, top, mean in ((10, 2000, 8), (3, 25, 64)):
        got = sorted(tuple(r) for r in collocations(df, least=least, top=top, mean=mean).collect())
        assert got == brute(rows, least, top)
    assert collocations(df.limit(0)).collect() == []


def test_longer_phrases_and_the_filter(spark):
    rows = sample()
    df = spark.createDataFrame(rows, KIND)
    want = Counter()
    for _, text, lang in rows:
        for w in pieces(text):
            for n in range(1, 6):
                want.update((lang or "und", " ".join(w[i:i + n]), n) for i in range(len(w) - n + 1))
    got = {(r.lang, r.phrase, r.words): r.f for r in phrase_counts(df, longest=5, least=12, mean=4).collect() if r.words}
    assert got == {k: v for k, v in want.items() if v >= 12}
