"""Quality rules with an n-gram language model (operator 8).

The model is a modified Kneser-Ney model over characters, one for each value of
``lang``, of order 4.  Spark counts the n-grams of every whole text, each once for
a document (so that a text's own repetitions don't make it likely); the lower
orders' continuation counts, the discounts and the context weights are grouped
aggregates of those counts, and each order's probabilities interpolate the next
lower one's by an equi-join.  Every document is counted, and every n-gram of every
document has its own probability: PLAIN of it by the counts of the language's plain documents, the
rest by those of all its documents.  Plain are those in which symbols (``#*$%&|<>``) are
less than SYMBOL_PERCENT of the characters, so that a pattern of junk that many documents
share costs what it costs among plain text, by its shorter contexts there, and not what it
has made likely by itself.  In a language that has more than half of its documents
above that share all of them are plain.  The finished log probabilities of all n-grams
are looked up in shards (``shards.py``) whose number grows with the n-grams.  Two n-grams of one
language never share an entry; two of different languages do with probability 2**-64.
Characters beyond U+FFFF are told apart by their lowest 11 bits.

A document's surprise is its mean negative log2 probability per character (the
log of its perplexity).  For each language, the median and the median absolute
deviation over all documents of MIN_WORDS words or more give a lower and an
upper bound; documents outside are rejected, as are those that fail the base
rules (fewer than MIN_WORDS words, or over half of the words in repeated
three-word windows).

Defined results: a null text counts as empty (0 words, base_failed); a null
language is a language of its own; repeated rows are judged alike; extra columns
are ignored by ``quality`` and returned untouched by ``filter_quality``; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import textkit as K
from quarry.llm.scratch import save
from quarry.llm.shards import Shards, share

ORDER = 4
MIN_WORDS = 50
#: Share of symbols from which a document isn't plain; weight of the plain documents' counts.
SYMBOL_PERCENT = 2
PLAIN = 15 / 16
#: Width of the accepted band in robust standard deviations, and the least deviation (bits a character).
LOWER_Z, UPPER_Z, LEAST_DEV = 7.0, 8.0, 0.02

U = np.uint64
_WS = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
#: For n-grams that no counted document has (log2).
UNSEEN = -20.0
#: Characters of text that are looked up at a time.
LOOKUP = 4 << 20


def _lang_seed(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"?" if lang is None else b"=" + lang.encode(), digest_size=8).digest(), "big")


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys (16 bits a character; those beyond U+FFFF take the surrogates' places) of every character of the texts, and offsets."""
    pad = "\0" * (ORDER - 1)
    a = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    a = np.where(a > U(0xFFFF), (a & U(0x7FF)) | U(0xD800), a)
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n + ORDER - 1) - n  # where each text's own characters begin
    key = a[:len(a) - ORDER + 1] << U(16 * (ORDER - 1))
    for k in range(1, ORDER):
        key = key | a[k:len(a) - ORDER + 1 + k] << U(16 * (ORDER - 1 - k))
    own = np.ones(len(key), bool)
    for s, m in zip(first[1:] - (ORDER - 1), n[1:], strict=True):  # windows that end in the padding
        own[s - (ORDER - 1):s] = False
    return key[own], np.concatenate(([0], np.cumsum(n)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, k, c): a task's counts; combined again by Spark."""
    tables: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        k = np.concatenate([p[0] for p in parts])
        c = np.concatenate([p[1] for p in parts])
        order = np.argsort(k)
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[at], np.add.reduceat(c, at)

    def rows(lang, parts):
        k, c = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "k", "c"])

    for b in batches:
        by_lang: dict[str | None, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for lo, hi in K.pieces([len(t) for t in texts]):
                parts = tables.setdefault(lang, [])
                key, off = _keys(texts[lo:hi])
                own = [np.unique(key[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                parts.append(np.unique(np.concatenate(own), return_counts=True))
                if len(parts) > 8:
                    tables[lang] = [merged(parts)]
        for lang in [x for x, parts in tables.items() if sum(len(p[0]) for p in parts) > 4_000_000]:
            yield rows(lang, tables.pop(lang))
    for lang, parts in tables.items():
        yield rows(lang, parts)
    tables.clear()
    K.release()


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, c, logp): interpolated modified Kneser-Ney log2 probability of the last
    character of each n-gram, from the counts of the highest order.

    Where ``counts`` has ``plain``, the part of c that plain documents have, two models are counted side by side,
    both for every n-gram (one that no plain document has gets its probability there by its shorter contexts), and the
    probability is PLAIN of the plain one and the rest of the one of all documents."""
    most = counts.count()  # lower orders have no more n-grams
    models = ["c", "plain"] if "plain" in counts.columns else ["c"]
    counts = counts.withColumn("lang", F.struct("lang"))  # null is a language too
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = save(tables[n + 1].groupBy("lang", F.col("k").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("k"))
                         .agg(*(F.count_if(F.col(m) > 0).alias(m) for m in models)), most)
    n_of = lambda m, i: F.count_if(F.col(m) == i)
    p: DataFrame | None = None
    for n in range(1, ORDER + 1):
        t = tables[n]
        d = t.groupBy("lang").agg(*(x for m in models for x in (
            *(n_of(m, i).cast("double").alias(f"{m}_n{i}") for i in (1, 2, 3, 4)), F.count_if(F.col(m) > 0).alias(f"{m}_v"))))

        def left(m, i, a, b):
            n1, a, b = (F.col(f"{m}_n{j}") for j in (1, a, b))
            return F.when((a > 0) & (n1 > 0), F.greatest(F.lit(0.05), i - (i + 1) * (n1 / (n1 + 2 * F.col(f"{m}_n2"))) * b / a)).otherwise(0.5 * i)

        d = d.select("lang", *(x for m in models for x in (f"{m}_v", *(left(m, i, i, i + 1).alias(f"{m}_d{i}") for i in (1, 2, 3)))))
        h = F.shiftrightunsigned("k", 16)
        ctx = t.groupBy("lang", h.alias("h")).agg(*(x for m in models for x in (
            F.sum(m).alias(f"{m}_total"), n_of(m, 1).alias(f"{m}_m1"), n_of(m, 2).alias(f"{m}_m2"), F.count_if(F.col(m) > 2).alias(f"{m}_m3"))))
        t = t.withColumn("h", h).join(ctx, ["lang", "h"]).join(d, "lang")

        def prob(m, low):
            met, of = F.col(f"{m}_total") > 0, lambda x: F.col(f"{m}_{x}")
            total = F.greatest(of("total"), F.lit(1))
            disc = F.when(F.col(m) == 1, of("d1")).when(F.col(m) == 2, of("d2")).otherwise(of("d3"))
            gamma = (of("d1") * of("m1") + of("d2") * of("m2") + of("d3") * of("m3")) / total
            own = F.greatest(F.lit(0.0), F.col(m) - disc) / total
            return F.when(met, own + gamma * low).otherwise(low)  # a context that the model never met says nothing

        if p is None:
            p = save(t.select("lang", "k", *models, *(prob(m, 1 / (F.col(f"{m}_v") + 1)).alias(f"{m}_p") for m in models)), most)
        else:
            low = p.select("lang", F.col("k").alias("low"), *(F.col(f"{m}_p").alias(f"{m}_q") for m in models))
            t = t.withColumn("low", F.col("k").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1)))
            p = save(t.join(low, ["lang", "low"]).select("lang", "k", *models, *(prob(m, F.col(f"{m}_q")).alias(f"{m}_p") for m in models)), most)
    both = F.col("c_p") if len(models) == 1 else PLAIN * F.col("plain_p") + (1 - PLAIN) * F.col("c_p")
    return p.select("lang.lang", "k", "c", F.log2(both).alias("logp"))


def _hashes(key: np.ndarray, lang: str | None) -> np.ndarray:
    """64 bits; no two keys of a language have the same."""
    return K.mix(key ^ U(_lang_seed(lang)))


def _to_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, k = b.column("lang").dictionary_encode(null_encoding="encode"), b.column("k").to_numpy().view(U)
        of, h = langs.indices.to_numpy(), np.zeros(len(k), U)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            h[of == i] = _hashes(k[of == i], lang)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("logp").cast(pa.float32())], names=["h", "logp"])


def _marked(docs: DataFrame) -> DataFrame:
    """(lang, text, heavy): whether SYMBOL_PERCENT or more of a document's characters are symbols."""
    symbols = F.length("text") - F.length(F.translate("text", _SYMBOLS.decode(), ""))
    heavy = F.coalesce(100 * symbols >= SYMBOL_PERCENT * F.greatest(F.length("text"), F.lit(1)), F.lit(False))
    return docs.select("lang", "text", heavy.alias("heavy"))


def _usual(marked: DataFrame) -> DataFrame:
    """The languages (``__lang``) most of whose documents are full of symbols."""
    return (marked.where(F.length("text") > 0).groupBy("lang").agg((2 * F.count_if("heavy") > F.count("*")).alias("usual"))
            .where("usual").select(F.col("lang").alias("__lang")))


def learned(docs: DataFrame) -> DataFrame:
    """(lang, text) of the plain documents."""
    docs = _marked(docs)
    return (docs.where("not heavy").select("lang", "text")
            .unionByName(docs.where("heavy").join(_usual(docs), F.col("lang").eqNullSafe(F.col("__lang")), "left_semi").select("lang", "text")))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, k, c, plain): in how many documents and in how many plain ones each n-gram of every document comes."""
    docs = _marked(docs)
    # the mark goes through the count in front of the language, a null one without its sign
    kind = F.concat(F.when(F.col("heavy"), "h").otherwise("p"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    counts = docs.select(kind.alias("lang"), "text").mapInArrow(_count, "lang string, k long, c long")
    own = F.when(F.substring("lang", 2, 1) == "=", F.expr("substring(lang, 3)"))
    counts = counts.groupBy(own.alias("lang"), "k").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("lang").startswith("p"), F.col("c")).otherwise(0)).alias("plain"))
    usual = _usual(docs).withColumn("usual", F.lit(True))
    return (counts.join(usual, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .select("lang", "k", "c", F.when(F.col("usual"), F.col("c")).otherwise(F.col("plain")).alias("plain")))


def fit(docs: DataFrame) -> Shards:
    """The model: log2 probabilities of all n-grams by their hashes."""
    return share(kneser_ney(save(ngram_counts(docs))).mapInArrow(_to_hashes, "h long, logp float"), "h")


def _repeated(w: list[bytes]) -> int:
    tri = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(tri)) == len(tri):
        return 0
    seen = Counter(tri)
    n, upto = 0, 0
    for i, x in enumerate(tri):
        if seen[x] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def _base(text: str) -> tuple[int, int, int, int, int]:
    b = text.encode()
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(_WS)]
    return (len(w), len(text) - (len(b) - len(b.translate(None, _WS))), len(b) - len(b.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(w))


_FACTS = pa.struct([(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("surprise", pa.float64())])


def scorer(model: Shards):
    """A function of (text, lang) columns: the base counts and the surprise (null without characters)."""
    def score(texts: pa.Array, langs: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in _FACTS]
        lang, text = langs.to_pylist(), [t or "" for t in texts.to_pylist()]
        surprise = np.full(len(text), np.nan)
        groups: dict[str | None, list[int]] = {}
        for i, t in enumerate(text):
            for col, v in zip(out, _base(t), strict=False):
                col.append(v)
            if t:
                groups.setdefault(lang[i], []).append(i)
        pieces = [(name, rows[lo:hi]) for name, rows in groups.items() for lo, hi in K.pieces([len(text[i]) for i in rows])]
        for lo, hi in K.pieces([sum(len(text[i]) for i in rows) for _, rows in pieces], LOOKUP):
            h, offs = [], []
            for name, rows in pieces[lo:hi]:
                key, off = _keys([text[i] for i in rows])
                h.append(_hashes(key, name))
                offs.append(off)
            logp = [np.full(len(x), UNSEEN, np.float32) for x in h]
            for i, places, at, shard in model.find(h):
                logp[i][places] = shard.columns["logp"][shard.off[at]]
            for (_, rows), off, x in zip(pieces[lo:hi], offs, logp, strict=True):
                surprise[rows] = -np.add.reduceat(x.astype(np.float64), off[:-1]) / np.diff(off)
        del text
        K.release()
        arrays = [pa.array(col, pa.int64()) for col in out[:-1]] + [pa.array(surprise, mask=np.isnan(surprise))]
        return pa.StructArray.from_arrays(arrays, names=[f.name for f in _FACTS])

    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double"
    return F.arrow_udf(score, kind)


def bands(facts: DataFrame, lower_z: float = LOWER_Z, upper_z: float = UPPER_Z) -> DataFrame:
    """(lang, lower, upper) from (lang, n_words, surprise), by exact weighted medians over
    values rounded to a thousandth of a bit: a grouped count, so one language may hold most rows."""
    def median(df: DataFrame, value: Column, name: str) -> DataFrame:
        h = df.groupBy("lang", value.alias("x")).agg(F.sum("n").alias("n"))
        total = h.groupBy("lang").agg(F.sum("n").alias("total"))
        # distinct thousandths of a bit: at most 20,000 or so for each language
        run = h.withColumn("run", F.sum("n").over(W.partitionBy("lang").orderBy("x")))
        return (run.join(total.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")))
                .where("2 * run >= total").groupBy("lang").agg(F.min("x").alias(name)))

    base = (facts.where((F.col("n_words") >= MIN_WORDS) & F.col("surprise").isNotNull())
            .groupBy("lang", F.round("surprise", 3).alias("v")).agg(F.count("*").alias("n")))
    mid = median(base, F.col("v"), "mid")
    base = base.join(mid.withColumnRenamed("lang", "l3"), F.col("lang").eqNullSafe(F.col("l3")))
    dev = median(base, F.round(F.abs(F.col("v") - F.col("mid")), 3), "dev")
    width = F.greatest(1.4826 * F.col("dev"), F.lit(LEAST_DEV))
    return (mid.join(dev.withColumnRenamed("lang", "l4"), F.col("lang").eqNullSafe(F.col("l4")))
            .select("lang", (F.col("mid") - lower_z * width).alias("lower"), (F.col("mid") + upper_z * width).alias("upper")))


def _judged(facts: DataFrame, **z: float) -> DataFrame:
    """Adds base_failed and kept to rows with lang, the counts and surprise."""
    band = bands(facts, **z).withColumnRenamed("lang", "__lang")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = F.col("surprise").isNotNull() & F.col("lower").isNotNull() & ~F.col("surprise").between(F.col("lower"), F.col("upper"))
    return (facts.join(band, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .withColumn("base_failed", failed).withColumn("kept", ~failed & ~out).drop("__lang", "lower", "upper"))


def quality(docs: DataFrame, **z: float) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, surprise, base_failed, kept for every row."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs)
    facts = save(docs.select("doc_id", "lang", scorer(model)("text", "lang").alias("f")).select("doc_id", "lang", "f.*"))
    model.free()
    return _judged(facts, **z)


def filter_quality(docs: DataFrame, **z: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    model = fit(docs)
    facts = save(docs.select(F.struct("*").alias("row"), "lang", scorer(model)("text", "lang").alias("f")).select("row", "lang", "f.*"))
    model.free()
    verdict = _judged(facts.select("row", "lang", "n_words", "n_repeat_words", "surprise"), **z)
    return verdict.where("kept").select("row.*")
