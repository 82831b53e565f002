import random
import re

from quarry.llm import license as L


def base(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, lab) for p, lab in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))


def edits(a, b):
    """Least edits that turn the whole of a into some part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Under the MIT License, under  the\nmit license"), (4, "cc-by-nc CC BY NC"), (5, "Licensed under the Apache Lisense, Version 2.0."),
            (5, "Licensed under the Apache Lisense, Version 2.0."), (6, "word " * 50000 + "apache license version 2"), (None, "é cc by nc ü"), (7, "undr the mit license")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, n_words int")
    out = L.scan(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert got == sorted(((d, *base(t)) for d, t in rows), key=repr)
    fuzzy = {r.doc_id: r for r in out}
    assert fuzzy[5].labels == "apache-2" and fuzzy[5].base_labels == "" and 0.8 < fuzzy[5].score < 1
    assert fuzzy[1].score == 0 and fuzzy[3].score == 1
    assert L.scan(df.limit(0)).collect() == []


def test_fuzzy_against_edit_distance():
    """A notice within its edits is always found (pigeonhole), and what is found is within its edits."""
    rng = random.Random(2)
    finder = L.Finder()
    for _ in range(150):
        notice, label, k = rng.choice(L.NOTICES)
        t = list(notice)
        for _ in range(rng.randint(0, k + 2)):
            i = rng.randrange(len(t))
            t[i:i + 1] = rng.choice([[], [rng.choice("abcdefghij ")], [t[i], rng.choice("klmno ")]])
            if not t:
                t = ["x"]
        text = L.normalise("some words before " + "".join(t) + " and after")
        found = finder.spans(text)
        if edits(notice, text) <= k:
            assert label in {x[2] for x in found}
        for s, e, _, n, _ in found:
            assert any(edits(nt, text[s:e]) <= n for nt, lab, kk in L.NOTICES if n <= kk)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    finder = L.Finder()
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base(r.text)
        text = L.normalise(r.text)
        if len(text) < 1500:
            want = {lab for nt, lab, k in L.NOTICES if edits(nt, text) <= k} | set(filter(None, x.base_labels.split(",")))
            assert x.labels == ",".join(sorted(want))


def test_weaker_find_ahead_of_a_better_one():
    """In one stretch, an inexact notice before an exact one has its own span."""
    from quarry.llm.license import Finder
    text = "xx licensed under the mitt license and also licensed under the mit license yy"
    found = Finder([("licensed under the mit license", "mit", 3)]).spans(text)
    assert [(text[s:e].strip(), label, edits) for s, e, label, edits, _ in found] == [
        ("licensed under the mitt license", "mit", 1), ("licensed under the mit license", "mit", 0)]
