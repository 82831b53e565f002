import re
from collections import Counter

import pytest

from quarry.llm import quality as Q

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_base_counts_and_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b", None), (4, "a b c a b c\nx\nx\n \n x", "en"), (5, "é ü# | |", "fr"),
            (6, "w " * 300, "en"), (6, "w " * 300, "en"), (7, "long " * 60000, None), (None, "one two", "de"), (8, "\U0001F600 \0 x", "zz")]
    df = spark.createDataFrame([(*r, True, 1.0) for r in rows], "doc_id long, text string, lang string, kept boolean, surprise double")
    got = sorted(((r.doc_id, *(r[c] for c in COLS)) for r in Q.quality(df).collect()), key=repr)
    assert got == sorted(((d, *base(t)) for d, t, _ in rows), key=repr)
    assert Q.quality(df.limit(0)).collect() == [] and Q.filter_quality(df.limit(0)).columns == df.columns


def test_kneser_ney_sums_to_one(spark):
    """Over the characters of the alphabet, the probabilities after a context add up to 1 less the unseen symbol's share."""
    text = "abracadabra cabra barca abraca " * 3
    df = spark.createDataFrame([(text, "en"), ("cab", "en")], "text string, lang string")
    counts = df.mapInArrow(Q._count, "lang string, k long, c long")
    top = {(r.k): 2 ** r.logp for r in Q.kneser_ney(counts).collect()}
    by_ctx = Counter()
    for k, p in top.items():
        by_ctx[k >> 16] += p
    assert all(0 < s <= 1 + 1e-9 for s in by_ctx.values()) and max(by_ctx.values()) > 0.6
    pads = Counter()
    for t in (text, "cab"):
        ints = [0, 0, 0, *map(ord, t)]
        pads.update({a << 48 | b << 32 | c << 16 | d for a, b, c, d in zip(ints, ints[1:], ints[2:], ints[3:])})
    assert {r.k: r.c for r in counts.collect()} == dict(pads)


def test_documents(spark):
    """Base columns of every document; junk is rejected and labelled good documents stay."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in Q.quality(docs).collect()}
    for r in docs.collect():
        assert tuple(rows[r.doc_id][c] for c in COLS) == base(r.text)
    good = bad = n_good = n_bad = 0
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        x = rows[r.doc_id]
        if not x.base_failed:
            n_good, good = n_good + r.quality, good + (r.quality and x.kept)
            n_bad, bad = n_bad + 1 - r.quality, bad + (not r.quality and not x.kept)
    assert good >= 0.99 * n_good and bad >= 0.3 * n_bad
    kept = Q.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in rows.values())


def test_junk_by_kind(spark):
    """Labelled junk that passes the base rules is rejected, whatever its pattern."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    junk = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").collect()}
    seen, gone = Counter(), Counter()
    for r in Q.quality(docs).where("not base_failed").collect():
        if r.doc_id in junk:
            kind = "word ends" if re.search(r"(\*{3}|\${3}|%{3}|&{3}|#{3})(\s|$)", text[r.doc_id]) else "bars" if " | " in text[r.doc_id] else "other"
            seen[kind] += 1
            gone[kind] += not r.kept
    assert seen["word ends"] > 10 and seen["bars"] > 10 and all(gone[k] >= 0.9 * n for k, n in seen.items())


def test_learned_documents(spark):
    """Documents full of symbols aren't learned, unless that is how their language is mostly written."""
    plain, heavy = "some plain words " * 9, "<b>#x</b> $y " * 9
    rows = [(plain, "en"), (plain, "en"), (heavy, "en"), (heavy, "code"), (heavy, "code"), (plain, "code"), (heavy, None), (None, None), ("", None)]
    got = Counter((r.lang, r.text) for r in Q.learned(spark.createDataFrame(rows, "text string, lang string")).collect() if r.text)
    assert got == {("en", plain): 2, ("code", heavy): 2, ("code", plain): 1, (None, heavy): 1}


def test_every_document_is_counted(spark):
    """The model has every n-gram of every document, those that only documents full of symbols have too, each with the
    probability that two brute-force models give it: one of the plain documents, one of all."""
    import numpy as np
    rows = [("the plain words of a text", "en"), ("a plain text # of words and more of the words", "en"), ("other words that are plain", "en"), ("a &|& b ### the $plain$", "en"),
            ("### $$$ ###", None), ("plain words", None), ("words", None), ("<b>#x</b>", "code"), ("", "en"), (None, "en")]
    df = spark.createDataFrame([r for r in rows for _ in range(2)], "text string, lang string")
    heavy = lambda t: 100 * sum(t.count(x) for x in "#*$%&|<>") >= 2 * len(t)
    grams = lambda t: {("\0" * 3 + t)[i:i + 4] for i in range(len(t))}

    def model(texts):
        levels = {4: Counter(g for t in texts for g in grams(t))}
        for n in (3, 2, 1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])

        def p(g):
            if not g:
                return 1 / (len(levels[1]) + 1)
            lv, low = levels[len(g)], p(g[1:])
            ctx = [c for x, c in lv.items() if x[:-1] == g[:-1]]
            if not ctx:
                return low
            n = Counter(lv.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = [0, *(max(0.05, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] else 0.5 * i for i in (1, 2, 3))]
            return max(0, lv[g] - d[min(lv[g], 3) or 3]) / sum(ctx) + sum(d[min(c, 3)] for c in ctx) / sum(ctx) * low
        return p

    fitted = Q.fit(df)
    for lang in ("en", None, "code"):
        own = [t for t, x in rows if x == lang and t for _ in range(2)]
        plain = [t for t in own if not heavy(t)] if lang != "code" else own  # all of its documents are full of symbols
        few, every = model(plain), model(own)
        names = sorted({g for t in own for g in grams(t)})
        h = Q._hashes(np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in names], np.uint64), lang)
        got = np.full(len(h), np.nan)
        for _, places, at, shard in fitted.find([h]):
            got[places] = shard.columns["logp"][shard.off[at]]
        assert np.allclose(got, np.log2([Q.PLAIN * few(g) + (1 - Q.PLAIN) * every(g) for g in names]), rtol=1e-5)
    fitted.free()
    counts = {(r.lang, r.k): (r.c, r.plain) for r in Q.ngram_counts(df).collect()}
    hashes = ord("#") << 32 | ord("#") << 16 | ord("#")
    assert counts["en", hashes | ord(" ") << 48] == (2, 0) and counts["en", ord("t") << 32 | ord("h") << 16 | ord("e")] == (2, 2)


def test_every_ngram_keeps_its_probability(spark, monkeypatch):
    """Each n-gram of each language is found in the model with its own value, also when it takes many shards."""
    import numpy as np

    from quarry.llm import shards
    rows = [(t, lang) for lang, a in (("zh", 0x4E00), ("ko", 0xAC00), (None, 0x41)) for t in ("".join(chr(a + i * i % 9973) for i in range(lo, lo + 4000)) for lo in (1, 5000))]
    rows += [("一踀丁츁" * 20, "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    counts = df.mapInArrow(Q._count, "lang string, k long, c long").groupBy("lang", "k").sum("c").withColumnRenamed("sum(c)", "c")
    want = {(r.lang, r.k): r.logp for r in Q.kneser_ney(counts).collect()}
    assert sum(lang == "x" for lang, _ in want) == 7  # no two characters are taken for one
    for rows_of in (500, 1 << 21):
        monkeypatch.setattr(shards, "SHARD_ROWS", rows_of)
        model = Q.fit(df)
        assert len(model.parts) == (1 if rows_of > len(want) else 1 << (-(-len(want) // rows_of) - 1).bit_length())
        names = list(want)
        h = np.concatenate([Q._hashes(np.array([k], np.int64).view(np.uint64), lang) for lang, k in names])
        got = np.full(len(h), np.nan)
        for _, places, at, shard in model.find([h]):
            got[places] = shard.columns["logp"][shard.off[at]]
        assert np.allclose(got, list(want.values()), rtol=1e-6)
        hidden = [x.surprise for x in Q.quality(df.selectExpr("1 doc_id", "*")).collect()]
        if rows_of > 500:
            assert sorted(hidden) == sorted(few)
        few = hidden


def test_shards_find():
    import numpy as np

    from quarry.llm.shards import Shard
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        key = rng.integers(0, 2**64, n, np.uint64)
        key = np.concatenate([key, key[: n // 2], np.array([0, 2**64 - 1], np.uint64)[: n]])
        s = Shard(key, {"v": key.copy()}, 0, 0)
        ask = np.concatenate([key, rng.integers(0, 2**64, 50, np.uint64)])
        hit, at = s.find(ask)
        assert hit.tolist() == list(range(len(key))) and (s.keys[at] == ask[hit]).all()
        for i, x in zip(at, ask[hit]):
            own = s.columns["v"][s.off[i]:s.off[i + 1]]
            assert (own == x).all() and len(own) == (key == x).sum()
