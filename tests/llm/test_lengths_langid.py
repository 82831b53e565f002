from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from quarry.llm import langid, lengths  # noqa: E402
from quarry.llm.bpe import read_ranks  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


def test_limits_against_counting(spark, sf_dir):
    with open(PATH, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "n_chars").union(
        spark.createDataFrame([(None, 1), ("", 2), (" x" * 30000, 3), (" x" * 30000, 3)], "text string, n_chars long"))
    docs = docs.withColumnRenamed("n_chars", "n_tokens")
    n = [len(enc.encode_ordinary(r.text or "")) for r in docs.collect()]
    c = Counter(n)
    want = sorted((x, c[x], sum(y <= x for y in n), sum(y for y in n if y <= x), sum(y > x for y in n), sum(min(x, y) for y in n), sum(n) - sum(min(x, y) for y in n)) for x in c)
    got = sorted(tuple(r)[:7] for r in lengths.limits(lengths.histogram(docs, PATH, P.PATTERN)).collect())
    assert got == want
    assert lengths.limits(lengths.histogram(docs.limit(0), PATH, P.PATTERN)).collect() == []


def test_any_limit_and_share(spark):
    n = [0, 0, 3, 3, 3, 10, 700, 5000]
    hist = spark.createDataFrame([(x, c) for x, c in Counter(n).items()], "n_tokens long, n_docs long")
    got = {r.limit: tuple(r)[1:6] for r in lengths.at_limits(hist, [0, 2, 3, 512, 1024, 4096, 9999]).collect()}
    for x, row in got.items():
        cut = sum(min(x, y) for y in n)
        assert row == (sum(y <= x for y in n), sum(y for y in n if y <= x), sum(y > x for y in n), cut, sum(n) - cut)
    assert len(got) == 7 and lengths.at_limits(hist.limit(0), [5]).collect() == []
    want = {q: sorted(n)[max(0, -(-int(q * 1000) * len(n) // 1000) - 1)] for q in (0.1, 0.25, 0.5, 0.75, 1.0)}
    assert {r.share: r.n_tokens for r in lengths.quantiles(hist, list(want)).collect()} == want


def test_page_languages(spark):
    d = "/root/testdata/sf0.01"
    pages, docs = spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    rows = langid.identify(pages, docs).collect()
    path = {r.page_id: r.url.split("://")[1].split("/")[1] for r in pages.collect()}
    assert len(rows) == pages.count() and all(0 < r.confidence <= 1 for r in rows)
    assert sum(r.lang == path[r.page_id] for r in rows) >= 0.97 * len(rows)
    assert all(r.declared == path[r.page_id] for r in rows)


def test_evidence_and_edges(spark):
    docs = spark.createDataFrame([("the cat and the dog of the house " * 5, "en"), ("der hund und die katze im haus " * 5, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    page = lambda t, lang="": f"<html{lang}><body><p>{t}</p><script>der die das</script></body></html>"
    rows = [(i, f"http://a.example.de/{i}", page("der hund und die katze", ' lang="de"')) for i in range(20)]
    rows += [(100 + i, f"http://b.example.com/{i}", page("the cat and the dog", ' lang="en"')) for i in range(20)]
    rows += [(200, "http://a.example.de/x", page("")), (201, "http://b.example.com/x", page("")), (202, None, None), (203, "", ""), (204, "http://c.org/", page("the dog of the house")),
             (None, "http://c.org/", page("der hund")), (0, *rows[0][1:]), (205, "http://a.example.de/y", page("日本語"))]
    pages = spark.createDataFrame([(*r, "zz") for r in rows], "page_id long, url string, html string, lang string")
    out = langid.identify(pages, docs).collect()
    got = {r.page_id: r.lang for r in out}
    assert len(out) == len(rows)
    assert got[0] == "de" and got[100] == "en" and got[200] == "de" and got[201] == "en" and got[204] == "en" and got[None] == "de" and got[202] in ("de", "en")
    assert langid.identify(pages.limit(0), docs).collect() == []
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_every_language_has_a_model(spark):
    """More languages than 64, the rare ones too, and scripts with many characters."""
    words = lambda k: " ".join("".join(chr(0x4E00 + (k * 211 + w * 17 + j * 5) % 20000) for j in range(4)) for w in range(12))
    docs = spark.createDataFrame([(words(k), f"l{k:03d}") for k in range(90) for _ in range(1 + (k < 70))] + [("1 2", "zz")], "text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", f"<p>{words(k)}</p>") for k in range(90)], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert all(got[k].lang == got[k].text_lang == f"l{k:03d}" and 0 < got[k].confidence <= 1 for k in range(90))
