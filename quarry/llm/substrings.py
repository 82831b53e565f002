"""Exact removal of long repeated byte strings with a run-length index (operator 7).

A byte goes if it is covered by a string of LENGTH bytes that also starts
earlier: in a document with a smaller doc_id, or in the same document further
ahead.  Strings never cross documents and are judged on the input.

Repeats are brought together by content-defined anchors, so that no task sees
the corpus: a LENGTH-byte window's anchor is its K-byte string of least hash
(the leftmost, if several are equal).  Equal windows have equal anchors at equal
places, and the windows of one anchor are consecutive, so a document is
described by one short context for each anchor.

1. Contexts meet by anchor as hashes.  A context equal to an earlier one marks
   all its windows; the first of each class is asked for if its anchor has
   other contexts too.
2. Those texts go to buckets by anchor.  Each bucket builds a run-length index:
   the Burrows-Wheeler transform of its contexts as runs, with the suffix array
   sampled at the runs' ends.  Longest-common-prefix values are computed at the
   run heads only and streamed through the text from there (a position that is
   no run head has its left neighbour's value less one).  They cut the suffix
   order into intervals of equal windows, in which every window but the earliest
   is marked.  An anchor with very many different contexts is split: its windows
   go in four runs by their place, each keyed by the bytes that all windows of
   the run have in common, so equal windows still meet.
3. The marks are brought back to their documents.

Defined results: a null text counts as empty; a null doc_id sorts before all
others, and rows that share a doc_id count as one document whose starts are
compared (an exactly repeated row is no earlier than itself, so both keep the
same bytes); texts under LENGTH bytes are untouched; extra columns are ignored,
and ``remove_repeats`` returns them as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkit as T
from quarry.llm.scratch import save

LENGTH, K = 100, 24
WINDOWS = LENGTH - K + 1
#: Different contexts of one anchor above which they are split by place, and windows in each of those runs.
MAX_GROUP, PLACE = 8192, 20
#: Bytes of text for each bucket of anchors and each block of documents, of contexts for each index, and of text described at a time.
BUCKET_BYTES, BLOCK_BYTES, INDEX_BYTES, MAP_BYTES = 16 << 20, 4 << 20, 1 << 20, 8 << 20

U = np.uint64
_POS_BITS = U(28)
_NULL_ID = -(1 << 63)


# ---- anchors -----------------------------------------------------------------------------

def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    s = 1
    while 2 * s <= width:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[:-(width - s)], x[width - s:]) if width > s else x


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, place, lo, hi, a, c) for each run of windows with one anchor: the anchor's place in
    its text, the first and last window start as distances ahead of it, and the hashes of
    the anchor and of the whole context."""
    buf = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    first = np.cumsum(size) - size
    if len(buf) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = T.prefix_hash(buf)
    at = np.arange(len(buf) - K + 1)
    g = T.span_hash(h, at, at + K)
    low = _slide((g & ~((U(1) << _POS_BITS) - U(1))) | at.astype(U), WINDOWS)
    where = (low & ((U(1) << _POS_BITS) - U(1))).astype(np.int64)
    row = np.repeat(np.arange(len(raws)), np.maximum(size - LENGTH + 1, 0))
    if not len(row):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0), np.maximum(size - LENGTH + 1, 0)) + first[row]
    p = where[start]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((new[1:], [len(row)])) - 1
    s, e, p, row = start[new], start[last], p[new], row[new]
    c = T.span_hash(h, s, e + LENGTH) + T.mix((p - s).astype(U) + U(77))
    return row, p - first[row], p - s, p - e, g[p], c


# ---- step 1: contexts meet as hashes -----------------------------------------------------

def _sorted_classes(a, c, doc, pos):
    """Order by class and then by (doc, pos), starts of classes, and rows later than their class's first."""
    order = np.lexsort((pos, doc, c, a))
    a, c, doc, pos = a[order], c[order], doc[order], pos[order]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, bool)
    which = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    later = (doc != doc[at][which]) | (pos != pos[at][which]) if len(a) else head
    return order, at, which, later


_PART = "bucket int, kind int, ids binary, rks binary, di binary, pos binary, lo binary, hi binary, a binary, c binary"


def _describe(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text"), b.column("id").to_numpy()
            rks = b.column("rk").to_numpy()
            sizes = pc.binary_length(texts).to_numpy()
            for from_, to in T.pieces(sizes.tolist(), MAP_BYTES):
                yield from described(texts.slice(from_, to - from_), ids[from_:to], rks[from_:to], sizes[from_:to])
            T.release()

    def described(texts, ids, rks, sizes):
        found = []
        for lo, hi in T.pieces(sizes.tolist()):
            x = anchors([t.as_py() for t in texts.slice(lo, hi - lo)])
            found.append((x[0] + lo, *x[1:]))
        row, pos, lo_, hi_, a, c = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(row):
            return
        order, _, _, later = _sorted_classes(a, c, ids[row], pos)
        kind = np.zeros(len(row), np.int64)
        kind[order] = later  # 1: an earlier copy is in this very batch
        bucket = (a % U(buckets)).astype(np.int64)
        group = bucket * 2 + kind
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True])))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            i = order[s:e]
            used, di = np.unique(row[i], return_inverse=True)
            cols = [ids[used], rks[used], di.astype(np.uint32), pos[i].astype(np.uint32), lo_[i].astype(np.uint8), hi_[i].astype(np.uint8)]
            first = kind[i[0]] == 0
            cols += [(a[i] >> U(32)).astype(np.uint32), c[i].astype(U)] if first else [np.zeros(0), np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[i[0]])], pa.int32()), pa.array([int(kind[i[0]])], pa.int32()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in cols)],
                names=["bucket", "kind", "ids", "rks", "di", "pos", "lo", "hi", "a", "c"])
    return run


_OUT = "block int, kind int, ids binary, rks binary, s binary, e binary, pos binary, a binary"


def _emit(kind: int, blocks: int, ids, rks, s, e, pos=None, a=None) -> pa.Table:
    """Rows of _OUT: one for each block of documents."""
    block = (T.mix(ids.view(U) ^ T.mix(rks.view(U))) % U(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True]))) if len(order) else []
    out: list[list] = [[] for _ in range(8)]
    zero = np.zeros(len(ids), np.uint32)
    cols = [ids, rks, s.astype(np.uint32), e.astype(np.uint32), zero if pos is None else pos.astype(np.uint32), zero if a is None else a.astype(U)]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        i = order[x:y]
        out[0].append(int(block[i[0]]))
        out[1].append(kind)
        for col, v in zip(out[2:], cols, strict=True):
            col.append(v[i].tobytes())
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["block", "kind", "ids", "rks", "s", "e", "pos", "a"])


def _cat(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _meet(blocks: int):
    def run(t: pa.Table) -> pa.Table:
        tables = []
        for kind in (1, 0):
            own = t.filter(pc.equal(t.column("kind"), kind))
            if not own.num_rows:
                continue
            counts = [len(x) // 8 for x in own.column("ids").to_pylist()]
            di = [np.frombuffer(x, np.uint32).astype(np.int64) for x in own.column("di").to_pylist()]
            base = np.cumsum(counts) - counts
            at = np.concatenate([d + o for d, o in zip(di, base, strict=True)])
            ids, rks = _cat(own.column("ids"), np.int64)[at], _cat(own.column("rks"), np.int64)[at]
            pos = _cat(own.column("pos"), np.uint32).astype(np.int64)
            lo, hi = (_cat(own.column(x), np.uint8).astype(np.int64) for x in ("lo", "hi"))
            if kind:
                tables.append(_emit(0, blocks, ids, rks, pos - lo, pos - hi + LENGTH))
                continue
            a, c = _cat(own.column("a"), np.uint32), _cat(own.column("c"), U)
            order, at, which, later = _sorted_classes(a, c, ids, pos)
            i = order[later]
            tables.append(_emit(0, blocks, ids[i], rks[i], pos[i] - lo[i], pos[i] - hi[i] + LENGTH))
            group = a[order][at]  # a class each
            new = np.concatenate(([True], group[1:] != group[:-1]))
            size = np.diff(np.concatenate((np.flatnonzero(new), [len(group)])))[np.cumsum(new) - 1]
            asked = ~later & (size[which] > 1)
            i = order[asked]
            big = (size[which] > MAX_GROUP)[asked]
            key = T.mix(a[i].astype(U) + U(int(t.column("bucket")[0].as_py()) << 32))
            for kind_, own_ in ((1, ~big), (2, big)):
                j = i[own_]
                tables.append(_emit(kind_, blocks, ids[j], rks[j], pos[j] - lo[j], pos[j] - hi[j] + LENGTH, pos[j], key[own_]))
        T.release()
        return pa.concat_tables(tables)
    return run


# ---- step 2: the run-length index --------------------------------------------------------

class RunLengthIndex:
    """Burrows-Wheeler runs over short byte strings, each ended by a terminator of its own.

    ``sa``: the suffix order; ``heads``: where runs of equal preceding characters begin in it;
    ``samples``: the suffix positions there; ``lcp``: by place in the suffix order, streamed from
    the values at the run heads.
    """

    def __init__(self, parts: list[bytes]):
        size = np.array([len(p) for p in parts], np.int64)
        n = int(size.sum() + len(parts))
        self.text = np.zeros(n, np.uint16)
        ends = np.cumsum(size + 1) - 1  # the terminators
        own = np.ones(n, bool)
        own[ends] = False
        self.text[own] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
        self.left = np.repeat(ends, size + 1) - np.arange(n)  # characters up to the terminator
        self.first = ends - size
        self._sort()
        before = np.where(self.sa > 0, self.text[self.sa - 1], 0)
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.samples = self.sa[self.heads]
        self._stream_lcp()

    def _sort(self) -> None:
        n, step = len(self.text), 7
        text = np.concatenate((self.text, np.zeros(step, np.uint16))).astype(U)
        key = np.zeros(n, U)
        for k in range(step):  # what follows the terminator doesn't count
            key = key << U(9) | np.where(self.left >= k, text[k:n + k], U(0))
        self.word = key
        sa = np.argsort(key, kind="stable")
        sorted_key = key[sa]
        new = np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | (self.left[sa[1:]] < step)))
        rank = np.empty(n, np.int64)
        start = np.flatnonzero(new)
        rank[sa] = start[np.cumsum(new) - 1]
        while True:
            alone = new & np.concatenate((new[1:], [True]))
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            i = sa[open_]
            key = rank[i].astype(U) << U(32) | rank[i + step].astype(U)
            order = np.argsort(key)
            i, key = i[order], key[order]
            sa[open_] = i
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            new[open_] |= fresh
            rank[i] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            step *= 2
        self.sa = sa

    def _stream_lcp(self) -> None:
        x, y = self.samples[1:], self.sa[self.heads[1:] - 1]
        most = np.minimum(self.left[x], self.left[y])
        got = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        word = self.word
        while len(live):
            i, j = x[live] + got[live], y[live] + got[live]
            diff = word[i] ^ word[j]
            same = diff == 0
            part = live[~same]
            d = diff[~same]
            agree = np.zeros(len(part), np.int64)
            for k in range(6, 0, -1):
                agree += d < (U(1) << U(9 * k))
            got[part] += agree
            live = live[same]
            got[live] += 7
            live = live[got[live] < most[live]]
        got = np.minimum(got, most)
        n = len(self.text)
        at = np.full(n, -1, np.int64)
        value = np.zeros(n, np.int64)
        at[self.samples] = self.samples
        value[self.samples[1:]] = got
        at = np.maximum.accumulate(at)
        place = np.arange(n)
        streamed = np.where(at >= 0, value[at] - (place - at), 0)
        self.lcp = np.maximum(streamed, 0)[self.sa]

    def repeated(self, rank: np.ndarray, length: int) -> np.ndarray:
        """Positions whose next ``length`` characters also begin at a position of smaller rank."""
        new = self.lcp < length
        new[0] = True
        which = np.cumsum(new) - 1
        size = np.bincount(which)
        several = size[which] > 1
        i = self.sa[several]
        if not len(i):
            return i
        group = which[several]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        low = np.minimum.reduceat(rank[i], head)
        return np.sort(i[rank[i] > low[np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1]])


_CTX = "bucket long, ids binary, rks binary, s binary, sizes binary, body binary"


def _contexts(buckets: int):
    """Texts and requests of one block -> contexts by index bucket."""
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if texts.num_rows and asked.num_rows:
            kind = np.repeat(asked.column("kind").to_numpy(), [len(x) // 8 for x in asked.column("ids").to_pylist()])
            ids, rks, a = (_cat(asked.column(x), np.int64) for x in ("ids", "rks", "a"))
            s, e, pos = (_cat(asked.column(x), np.uint32).astype(np.int64) for x in ("s", "e", "pos"))
            rows = {(i, r): t for i, r, t in zip(texts.column("id").to_pylist(), texts.column("rk").to_pylist(), texts.column("text").to_pylist(), strict=True)}
            by_bucket: dict[int, list] = {}
            for k, i, r, x, y, p, h in zip(kind.tolist(), ids.tolist(), rks.tolist(), s.tolist(), e.tolist(), pos.tolist(), a.tolist(), strict=True):
                t = rows[i, r]
                if k == 1:
                    by_bucket.setdefault(h % buckets, []).append((i, r, x, t[x:y]))
                    continue
                for q in range((p - (y - LENGTH)) // PLACE, (p - x) // PLACE + 1):
                    core = t[p - PLACE * q:p - PLACE * q - PLACE + 1 + LENGTH]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=7, salt=bytes([q])).digest(), "little")
                    u, v = max(x, p - PLACE * q - PLACE + 1), min(y, p - PLACE * q + LENGTH)
                    by_bucket.setdefault((h + key) % buckets, []).append((i, r, u, t[u:v]))
            for bucket, items in by_bucket.items():
                out[0].append(bucket)
                for col, v in zip(out[1:4], zip(*(x[:3] for x in items), strict=True), strict=False):
                    col.append(np.array(v, np.int64).tobytes())
                out[4].append(np.array([len(x[3]) for x in items], np.int64).tobytes())
                out[5].append(b"".join(x[3] for x in items))
        types = [pa.int64()] + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["bucket", "ids", "rks", "s", "sizes", "body"])
    return run


def _index(blocks: int):
    def run(t: pa.Table) -> pa.Table:
        ids, rks, s, sizes = (_cat(t.column(x), np.int64) for x in ("ids", "rks", "s", "sizes"))
        body = b"".join(t.column("body").to_pylist())
        cut = np.concatenate(([0], np.cumsum(sizes)))
        index = RunLengthIndex([body[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
        doc = np.unique(ids, return_inverse=True)[1]
        part = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = s[part] + np.arange(len(part)) - index.first[part]
        hit = index.repeated(doc[part] << 32 | place, LENGTH)
        if not len(hit):
            return _emit(0, blocks, ids[:0], rks[:0], s[:0], s[:0])
        del index
        T.release()
        new = np.concatenate(([True], np.diff(hit) != 1))  # places of one context that follow each other
        head = np.flatnonzero(new)
        last = np.concatenate((head[1:], [len(hit)])) - 1
        x = part[hit[head]]
        return _emit(0, blocks, ids[x], rks[x], place[hit[head]], place[hit[last]] + LENGTH)
    return run


# ---- step 3: back to the documents -------------------------------------------------------

def _spans(changed_only: bool, as_text: bool = False):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        spans: dict[tuple, list] = {}
        if marks.num_rows:
            ids, rks = (_cat(marks.column(x), np.int64).tolist() for x in ("ids", "rks"))
            s, e = (_cat(marks.column(x), np.uint32).tolist() for x in ("s", "e"))
            for i, r, x, y in zip(ids, rks, s, e, strict=True):
                spans.setdefault((i, r), []).append((x, y))
        out: list[list] = [[] for _ in range(3)]
        rows = []
        text = texts.column("text")
        for at_row, (i, r) in enumerate(zip(texts.column("id").to_pylist(), texts.column("rk").to_pylist(), strict=True)):
            if changed_only and (i, r) not in spans:
                continue
            t = text[at_row].as_py()
            runs: list[list[int]] = []
            for x, y in sorted(spans.get((i, r), ())):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(y, runs[-1][1])
                else:
                    runs.append([x, y])
            at, kept = 0, []
            for x, y in runs:
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            rows.append(at_row)
            out[0].append([{"start": x, "end": y} for x, y in runs])
            out[1].append(len(t))
            out[2].append(b"".join(kept))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kept = pa.array([x.decode("utf-8", "ignore") for x in out[2]], pa.string()) if as_text else pa.array(out[2], pa.binary())
        more = [pa.array(out[0], kind), pa.array(out[1], pa.int64()), kept]
        take = pa.array(rows, pa.int64())
        return pa.Table.from_arrays([*(texts.column(c).take(take) for c in ("doc_id", "id", "rk")), *more],
                                    names=["doc_id", "id", "rk", "spans", "n_bytes", "kept_text" if as_text else "kept_bytes"])
    return run


def _key(id_: str = "doc_id", text: str = "text") -> list:
    """What tells a row apart: its doc_id (null: the least) and its text's hash."""
    return [F.coalesce(F.col(id_).cast("long"), F.lit(_NULL_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def repeated_spans(docs: DataFrame, changed_only: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, id and rk (the row's key), spans (maximal removed runs), n_bytes and kept_bytes for
    each row of ``docs`` (doc_id, text), or only for those that lose bytes.  ``as_text``: with kept_text,
    their whole characters, in place of kept_bytes."""
    id_, rk = _key()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), id_.alias("id"), rk.alias("rk"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = 1 + total // BUCKET_BYTES, 1 + total // BLOCK_BYTES

    parts = base.where(F.octet_length("text") >= LENGTH).select("id", "rk", "text").mapInArrow(_describe(buckets), _PART)
    first = save(parts.groupBy("bucket").applyInArrow(_meet(blocks), _OUT))

    @F.arrow_udf("int")
    def block_of(ids: pa.Array, rks: pa.Array) -> pa.Array:
        x = T.mix(ids.to_numpy().view(U) ^ T.mix(rks.to_numpy().view(U))) % U(blocks)
        return pa.array(x.astype(np.int32))

    placed = base.withColumn("block", block_of("id", "rk"))
    asked = first.where("kind > 0")
    ctx_bytes = asked.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    indexes = 1 + (ctx_bytes // 8) * (LENGTH + WINDOWS // 2) // INDEX_BYTES
    need = placed.select("block", "id", "rk", "text").where(F.octet_length("text") >= LENGTH)
    ctx = need.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_contexts(indexes), _CTX)
    second = ctx.groupBy("bucket").applyInArrow(_index(blocks), _OUT)
    marks = save(first.where("kind = 0").unionByName(second))

    schema = "doc_id long, id long, rk long, spans array<struct<start: long, end: long>>, n_bytes long, " + ("kept_text string" if as_text else "kept_bytes binary")
    return (placed.select("block", "text", "doc_id", "id", "rk").groupBy("block").cogroup(marks.groupBy("block"))
            .applyInArrow(_spans(changed_only, as_text), schema))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (and ``n_chars``, where there is one, counted anew
    for the texts that change).

    A cut within a character leaves some of its bytes; those are dropped.  A null text stays null.
    """
    changed = (repeated_spans(docs.select("doc_id", "text"), changed_only=True, as_text=True)
               .select(F.col("id").alias("__i"), F.col("rk").alias("__r"), F.col("kept_text").alias("__text")).dropDuplicates(["__i", "__r"]))
    id_, rk = _key()
    out = docs.withColumn("__id", id_).withColumn("__rk", rk)
    out = out.join(changed, (F.col("__id") == F.col("__i")) & (F.col("__rk") == F.col("__r")), "left")
    new = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
