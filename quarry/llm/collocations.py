"""Phrase collocations by prefix-free parsing (operator 13).

A text's words are parsed into chunks: a window of words whose hash falls on a
residue is a trigger, and a chunk runs from one trigger to the end of the next, so
neighbours overlap by one window and equal passages are cut alike wherever they
stand.  The distinct chunks with their frequencies are the dictionary, which
Spark counts (a passage that half the documents share is one chunk row).  Every word
belongs to one chunk, the one in whose last window it is not (the last chunk of a
text owns all of its words); n-grams are counted inside distinct chunks, from words that
the chunk owns, times the chunk's frequency: each occurrence counts once.

Words and pairs are counted first.  A longer n-gram can only be frequent if both of its
parts that lack one end are, so tasks drop the others by a bit filter of the frequent shorter
ones before anything is shuffled.  The filter has 16 bits for each of them, up to 2**FILTER_BITS
(128 MB); beyond, it lets more through, and the result stays the same, since Spark's sums
decide.  Tasks count exactly (dictionary codes of words, no hashes) and Spark adds up by the phrase itself.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count as often
as they stand; the doc_id is not used; extra columns are ignored; ties of rank are
settled by phrase; an empty table gives no rows, and so does a language without candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textkit as K
from quarry.llm.scratch import save

U = np.uint64
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Mean number of words from a trigger to the next; words that a task counts together; widest bit filter.
MEAN_CHUNK, COUNTED, FILTER_BITS = 64, 3 << 19, 30
#: Parts in which a language's best phrases are sought before they are ranked together.
PARTS = 8
SPACE, BREAK = 0x20, 0x0A


def _bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a lower-cased buffer that ends with a break."""
    other = np.concatenate(([True], KIND[a] > 0))
    edge = np.flatnonzero(other[1:] != other[:-1])
    return edge[0::2], edge[1::2]


def chunks(raws: list[bytes], window: int, mean: int = MEAN_CHUNK) -> list[list[bytes]]:
    """Every text's chunks: words joined by a space, or a line feed where a piece ends.  A text's last chunk ends with a line feed."""
    a = np.frombuffer(b"\n".join(raws).translate(K.LOWER) + b"\n", np.uint8)
    start, end = _bounds(a)
    if not len(start):
        return [[] for _ in raws]
    breaks = np.cumsum(KIND[a] == 2)
    same = np.append(breaks[start[1:]] == breaks[start[:-1]], False)
    keep = KIND[a] == 0
    keep[end] = True
    b = a.copy()
    b[end] = np.where(same, SPACE, BREAK)
    clean = b[keep].tobytes()
    to = np.cumsum(end - start + 1)  # where each word's separator ends in ``clean``
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    word = np.searchsorted(start, first)  # a text's first word
    h = K.span_hash(K.prefix_hash(a), start, end)
    n = len(h) - window + 1
    out: list[list[bytes]] = []
    trigger = np.zeros(len(h), bool)
    if n > 0:
        w = h[:n].copy()
        for k in range(1, window):
            w = K.mix(w * U(0x9FB21C651E98DF25) + h[k:n + k])
        trigger[:n] = K.mix(w) % U(mean) == 0
    hits = np.flatnonzero(trigger)
    cut = np.searchsorted(hits, word)
    begin = np.concatenate(([0], to))  # where each word starts in ``clean``
    for i in range(len(raws)):
        lo, hi = int(word[i]), int(word[i + 1])
        own, at = [], lo
        if hi > lo:
            for t in hits[cut[i]:cut[i + 1]].tolist():
                if t > at and t + window < hi:  # the trigger's window lies in this text, with words behind it
                    own.append(clean[begin[at]:to[t + window - 1] - 1])
                    at = t
            own.append(clean[begin[at]:to[hi - 1] - 1] + b"\n")
        out.append(own)
    return out


def _parse(window: int, mean: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in K.pieces(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
                part = b.slice(lo, hi - lo)
                found = chunks([(t or "").encode() for t in part.column("text").to_pylist()], window, mean)
                take = pa.array(np.repeat(np.arange(hi - lo), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column("lang").take(take), pa.array([c.decode() for x in found for c in x], pa.string())], names=["lang", "chunk"])
        K.release()
    return run


class _Words:
    """The words of a run of chunks as exact codes, with what an n-gram needs to know of each."""

    def __init__(self, langs: list[int], marks: list[int], texts: list[bytes], freq: np.ndarray, window: int):
        a = np.frombuffer(b"\n".join(t.rstrip(b"\n") for t in texts) + b"\n", np.uint8)
        start, end = _bounds(a)
        size = np.array([len(t.rstrip(b"\n")) + 1 for t in texts])
        first = np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))
        chunk = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        letters = a[KIND[a] == 0]
        off = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(letters)).dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy()
        del coded, letters, off
        self.chunk, self.freq, self.lang = chunk, freq, np.array(langs, np.int32)[chunk]
        self.mark = np.array(marks, np.int64)
        #: words of the same piece and chunk that follow
        ends = np.append(np.flatnonzero(a[end[:-1]] == BREAK), len(start) - 1) if len(start) else np.zeros(0, np.int64)
        place = np.arange(len(start), dtype=np.int32)
        ends = ends.astype(np.int32)
        self.follow = (np.repeat(ends, np.diff(ends, prepend=-1)) - place).astype(np.int32)
        whole = np.array([t.endswith(b"\n") for t in texts], bool)[chunk]
        self.owned = whole | (first[1:][chunk] - place > window)
        raw, o = self.names.buffers()[2], np.frombuffer(self.names.buffers()[1], np.int32)[:len(self.names) + 1].astype(np.int64)
        self.hash = np.concatenate([K.span_hash(K.prefix_hash(np.frombuffer(raw, np.uint8)[o[i]:o[j]]), o[i:j] - o[i], o[i + 1:j + 1] - o[i])
                                    for i, j in K.pieces(np.diff(o).tolist())]) if len(self.names) else np.zeros(0, U)


def _grams(words: _Words, n: int, filtered: tuple[np.ndarray, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lang, codes, count) of the distinct n-grams owned."""
    at = np.flatnonzero(words.owned & (words.follow >= n - 1))
    codes, names = words.code, len(words.names) + 1
    if filtered is not None:
        table, bits = filtered
        h = words.hash[codes]
        for i in range(2):  # without the last word, without the first
            at = at[_has(table, bits, _join(h, at + i, n - 1), words.mark[words.lang[at]])]
    ids = words.lang[at].astype(np.int64)
    top = len(words.mark)
    for k in range(n):  # exact: pairs of (what came so far, next word), renumbered before they pass 62 bits
        if top * names >= 1 << 62:
            _, ids = np.unique(ids, return_inverse=True)
            top = len(ids)
        ids, top = ids * names + codes[at + k], top * names
    order = np.argsort(ids)
    ids = ids[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1])))
    count = np.add.reduceat(words.freq[words.chunk[at[order]]], start) if len(start) else np.zeros(0, np.int64)
    rows = at[order[start]]
    return words.lang[rows], np.stack([codes[rows + k] for k in range(n)], axis=1), count


def _join(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    x = h[at]
    for k in range(1, n):
        x = K.mix(x * U(0x9FB21C651E98DF25) + h[at + k])
    return x


def _slots(x: np.ndarray, lang: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    y = K.mix(x + lang.astype(U) * U(0xA0761D6478BD642F))
    return y >> U(64 - bits), K.mix(y + U(1)) >> U(64 - bits)


def _has(table: np.ndarray, bits: int, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s in _slots(x, lang, bits):
        out &= (table[(s >> U(6)).astype(np.int64)] >> (s & U(63))) & U(1) == 1
    return out


def _mark(lang: str) -> int:
    """A number for a language, the same in every task."""
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:7], "big")


def _count(sizes: tuple[int, ...], window: int, shared=None):
    """Rows (lang, phrase, words, f) of the n-grams in a run of chunks; ``words`` 0 has the number of all words."""
    def flush(held: list[tuple[str, bytes, int]]) -> Iterator[pa.RecordBatch]:
        names = sorted({x[0] for x in held})
        index = {x: i for i, x in enumerate(names)}
        w = _Words([index[x[0]] for x in held], [_mark(x) for x in names], [x[1] for x in held], np.array([x[2] for x in held], np.int64), window)
        columns = ["lang", "phrase", "words", "f"]
        if 1 in sizes:
            total = np.zeros(len(names), np.int64)
            np.add.at(total, w.lang[w.owned], w.freq[w.chunk[w.owned]])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([""] * len(names)), pa.array(np.zeros(len(names), np.int32)), pa.array(total)], names=columns)
        for n in sizes:
            lang, codes, count = _grams(w, n, shared.value if shared is not None else None)
            for lo in range(0, len(count), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                phrase = [w.names.take(pa.array(codes[part, k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*phrase, " ") if n > 1 else phrase[0]
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang[part])), phrase, pa.array(np.full(len(phrase), n, np.int32)), pa.array(count[part])], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lang, chunk, f in zip(b.column("lang").to_pylist(), b.column("chunk").to_pylist(), b.column("freq").to_pylist(), strict=True):
                raw = chunk.encode()
                held.append((lang, raw, f))
                size += len(raw)
                if size >= 6 * COUNTED:
                    yield from flush(held)
                    held, size = [], 0
                    K.release()
        if held:
            yield from flush(held)
        held = []
        K.release()
    return run


def _filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bit filter of the phrases of ``frequent`` (lang, phrase): each task fills its own, the bits are joined by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), U)
        for b in batches:
            phrases = [p.encode() for p in b.column("phrase").to_pylist()]
            langs = np.array([_mark(x) for x in b.column("lang").to_pylist()], np.int64)
            for lo, hi in K.pieces([len(p) for p in phrases]):
                a = np.frombuffer(b"\n".join(phrases[lo:hi]) + b"\n", np.uint8)
                start, end = _bounds(a)
                h = K.span_hash(K.prefix_hash(a), start, end)
                size = np.array([len(p) + 1 for p in phrases[lo:hi]])
                first = np.searchsorted(start, np.concatenate(([0], np.cumsum(size)[:-1])))
                n = int(len(start) / max(1, hi - lo))
                for s in _slots(_join(h, first, n), langs[lo:hi], bits):
                    np.bitwise_or.at(table, (s >> U(6)).astype(np.int64), U(1) << (s & U(63)))
        at = np.flatnonzero(table)
        for lo in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo:lo + (1 << 18)]), pa.array(table[at[lo:lo + (1 << 18)]].view(np.int64))], names=["slot", "bits"])

    got = frequent.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(bits - 6) rows
    table = np.zeros(1 << (bits - 6), U)
    table[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(U)
    return table


def phrase_counts(docs: DataFrame, *, longest: int = 3, least: int = 10, mean: int = MEAN_CHUNK) -> DataFrame:
    """lang, phrase, words, f of every phrase of 1 to ``longest`` words that occurs ``least`` times in its language;
    the empty phrase (0 words) has the number of all word occurrences of each language."""
    window = longest - 1
    parsed = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_parse(window, mean), "lang string, chunk string")
    dictionary = save(parsed.groupBy("lang", "chunk").agg(F.count("*").alias("freq")))
    kind = "lang string, phrase string, words int, f long"

    def counted(sizes: tuple[int, ...], shared=None) -> DataFrame:
        rows = dictionary.mapInArrow(_count(sizes, window, shared), kind)
        return save(rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0)))

    out = level = counted((1, 2) if longest > 1 else (1,))
    for n in range(3, longest + 1):
        shorter = level.where(F.col("words") == n - 1)
        bits = min(FILTER_BITS, max(16, (16 * shorter.count()).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast((_filter(shorter.select("lang", "phrase"), bits), bits))
        level = counted((n,), shared)
        shared.destroy()
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, absorbed: int = 50, top: int = 2000, mean: int = MEAN_CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words."""
    counts = phrase_counts(docs, longest=longest, least=least, mean=mean)
    f = counts.where("words > 0")
    candidates = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    halves = f.select("lang", F.col("phrase").alias("half"), F.col("f").alias("fh"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = [F.array_join(F.slice("w", 1, F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")]
    cuts = cuts.select("lang", "phrase", "a", "k", part[0].alias("head"), part[1].alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(halves.select("lang", F.col("half").alias(side), F.col("fh").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", F.expr("(1000000 * (cast(a as decimal(18,0)) * cast(a as decimal(18,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.*")

    # the words of a candidate inside a longer one
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(absorbed) * F.col("a").cast("decimal(20,0)")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))  # so that the last ranking has at most PARTS * top rows of a language
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
