"""Language of web pages by Bayesian evidence fusion (operator 9).

For each page and language four kinds of evidence are added up as log
probabilities: the text's likelihood under character-pair models of the
languages (counted from labelled documents by grouped aggregation), the language
that the markup declares, the address suffix, and a prior for the host.  How far
declarations and suffixes are to be believed is counted from the pages themselves, against the
languages that their texts alone suggest.  Host priors are smoothed hierarchically:
a host's counts towards its domain's, those towards all pages'; a page's own
vote is taken out of its host's counts.

Every language of the documents has a model of all its grams; what is shared with the tasks is cut into shards whose
number grows with them (``shards.py``).  A page's evidence is kept for the languages whose text likelihood is within
REACH of its best one: the others' other evidence can't make up for that, and their part of the confidence is below a
double's precision.

Defined results: a page without text, or of a script that no language has, rests on its other evidence;
null html and url count as empty; without labelled documents the language is null; repeated rows are treated alike;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkit as K
from quarry.llm.scratch import save
from quarry.llm.shards import Shards, share

GRAM = 3
#: Natural log units; all other evidence together spans less than 5 log(pages) or so.
REACH = 200.0
#: Scores (pages times languages) that are worked on at a time.
CELLS = 1 << 21
#: Text evidence for each gram (neighbouring grams aren't independent); strength of the smoothing.
TEMPER, HOST_STRENGTH, DOMAIN_STRENGTH, CONFUSION_STRENGTH = 0.25, 5.0, 20.0, 1.0

_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|footer|title)\b.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_HTML_LANG = r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def visible(page: str | None) -> str:
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def gram_keys(text: str) -> np.ndarray:
    """Keys of the text's character triples (lower case, other characters than letters as one blank); no two triples share one."""
    t = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    if len(t) < GRAM:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return K.mix(a[:-2] << np.uint64(42) | a[1:-1] << np.uint64(21) | a[2:])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(lang, parts):
        k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "c"])

    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            parts = []
            for lo, hi in K.pieces([len(t) for t in texts]):
                parts.append(np.unique(np.concatenate([gram_keys(t) for t in texts[lo:hi]]), return_counts=True))
            yield rows(lang, parts)


def fit(docs: DataFrame) -> tuple[list[str], Shards | None, np.ndarray]:
    """Languages, the weights of their grams, and what a gram that a language doesn't have adds to its log likelihood."""
    docs = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = save(docs.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    total = {r.lang: r.n for r in docs.select("lang").distinct().join(counts.groupBy("lang").agg(F.sum("c").alias("n")), "lang", "left").collect()}  # a row a language
    langs = sorted(total)
    if not langs:
        return [], None, np.zeros(0)
    kinds = counts.select("gram").distinct().count() + 1
    places = docs.sparkSession.createDataFrame(list(enumerate(langs)), "at int, lang string")
    weights = counts.join(places, "lang").select("gram", "at", F.log(2.0 * F.col("c") + 1).cast("float").alias("w"))
    return langs, share(weights, "gram"), np.log(0.5) - np.log([(total[x] or 0) + 0.5 * kinds for x in langs])


def _likelihood(model: Shards, unseen: np.ndarray):
    """Languages (places) and tempered log likelihoods of each page, for those within REACH of the best."""
    n = len(unseen)

    def run(html: pa.Array) -> pa.Array:
        at: list[np.ndarray] = []
        ll: list[np.ndarray] = []
        size: list[int] = []
        pages = html.to_pylist()
        step = max(1, min(256, CELLS // n))
        for lo in range(0, len(pages), step):
            grams = [gram_keys(visible(p)) for p in pages[lo:lo + step]]
            page = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            score = np.array([len(g) for g in grams], float)[:, None] * unseen
            for _, places, found, shard in model.find([np.concatenate(grams)]):
                many = (shard.off[found + 1] - shard.off[found]).astype(np.int64)
                row = np.arange(many.sum()) + np.repeat(shard.off[found] - np.concatenate(([0], np.cumsum(many)[:-1]))[:len(many)], many)
                cell = np.repeat(page[places], many) * n + shard.columns["at"][row]
                score += np.bincount(cell, shard.columns["w"][row], score.size).reshape(score.shape)
            score *= TEMPER
            near = score >= score.max(axis=1, keepdims=True) - REACH
            size += near.sum(axis=1).tolist()
            at.append(np.nonzero(near)[1])
            ll.append(score[near])
        off = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        join = lambda x, kind: pa.ListArray.from_arrays(off, pa.array(np.concatenate(x) if x else [], kind))
        return pa.StructArray.from_arrays([join(at, pa.int32()), join(ll, pa.float64())], names=["at", "ll"])

    return F.arrow_udf(run, "at array<int>, ll array<double>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of a column of lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), lists.flatten()


def _fuse(langs: list[str], overall: np.ndarray, n_pages: float, kinds_declared: int, kinds_suffix: int):
    n = len(langs)
    g = (overall + 1) / (n_pages + n)

    def run(at: pa.Array, ll: pa.Array, p: pa.Array, nh: pa.Array, nd: pa.Array, nc: pa.Array, ns: pa.Array) -> pa.Array:
        row, i = _flat(at)
        i, x, own = (v.to_numpy(zero_copy_only=False) for v in (i, _flat(ll)[1], _flat(p)[1]))

        def rest(votes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The key's votes for each entry's language and in all, without the page's own."""
            vrow, v = _flat(votes)
            key, s = vrow * n + v.field("i").to_numpy(zero_copy_only=False), v.field("s").to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(key, row * n + i), len(key) - 1)
            got = np.where(key[place] == row * n + i, s[place], 0.0)
            return np.maximum(0.0, got - own), np.maximum(0.0, np.bincount(vrow, s, len(votes)) - 1)[row]

        def best(v: np.ndarray) -> tuple[np.ndarray, list[str]]:
            most = np.full(len(at), -np.inf)
            np.maximum.at(most, row, v)
            hit = np.flatnonzero(v == most[row])[::-1]
            first = np.zeros(len(at), np.int64)
            first[row[hit]] = i[hit]
            return most, [langs[k] for k in first.tolist()]

        if not len(at):
            return pa.array([], pa.struct([("text_lang", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())]))
        (dv, dn), (hv, hn) = rest(nd), rest(nh)
        domain = (dv + DOMAIN_STRENGTH * g[i]) / (dn + DOMAIN_STRENGTH)
        prior = (hv + HOST_STRENGTH * domain) / (hn + HOST_STRENGTH)
        said = (rest(nc)[0] + CONFUSION_STRENGTH) / (overall[i] + CONFUSION_STRENGTH * kinds_declared)
        tld = (rest(ns)[0] + CONFUSION_STRENGTH) / (overall[i] + CONFUSION_STRENGTH * kinds_suffix)
        score = x + np.log(prior) + np.log(said) + np.log(tld)
        most, lang = best(score)
        sure = 1 / np.bincount(row, np.exp(score - most[row]), len(at))
        return pa.StructArray.from_arrays([pa.array(best(x)[1], pa.string()), pa.array(lang, pa.string()), pa.array(sure)], names=["text_lang", "lang", "confidence"])

    return F.arrow_udf(run, "text_lang string, lang string, confidence double")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence for every row of ``pages`` (page_id, url, html)."""
    langs, model, unseen = fit(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    declared = F.lower(F.coalesce(F.regexp_extract("html", _HTML_LANG, 1), F.lit("")))
    base = pages.select("page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
                        declared.alias("declared"), _likelihood(model, unseen)("html").alias("t"))
    top = F.array_max("t.ll")
    soft = F.transform("t.ll", lambda x: F.exp(x - top))
    soft = F.transform(soft, lambda x: x / F.aggregate(soft, F.lit(0.0), lambda s, y: s + y))
    base = save(base.withColumn("p", soft).select("*", "t.at", "t.ll").drop("t"))
    each = base.select("host", "domain", "declared", "suffix", F.explode(F.arrays_zip("at", "p")).alias("v")).select("*", F.col("v.at").alias("i"), "v.p").where("p > 0")

    def votes(keys: list[str], name: str) -> DataFrame:
        """Summed text-only posteriors by ``keys``: one row a key with a list of (language, sum)."""
        return (each.groupBy(*keys, "i").agg(F.sum("p").alias("s"))
                .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias(name)))  # at most a language each

    hosts, domains = votes(["host", "domain"], "nh"), votes(["domain"], "nd")
    declared_, suffixes = votes(["declared"], "nc"), votes(["suffix"], "ns")
    overall = np.zeros(len(langs))
    for r in each.groupBy("i").agg(F.sum("p").alias("s")).collect():  # a row a language
        overall[r.i] = r.s
    full = base.join(hosts, ["host", "domain"]).join(domains, "domain").join(declared_, "declared").join(suffixes, "suffix")
    fuse = _fuse(langs, overall, float(overall.sum()), max(1, declared_.count()), max(1, suffixes.count()))
    return full.withColumn("r", fuse("at", "ll", "p", "nh", "nd", "nc", "ns")).select("page_id", "host", "declared", "r.*")
