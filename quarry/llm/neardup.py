"""Near-duplicate documents by fast similarity sketching, banding and exact
verification (operator 3).

A document is the set of its distinct word shingles.  Its sketch has T
coordinates that are filled in rounds: in round i every element is thrown into
one hashed bin with value (i, hash), and a bin keeps its smallest value.  After
T such rounds, round T + j throws every element into bin j, so each coordinate
is certain to fill; the chance that two sketches agree in a coordinate is the
Jaccard similarity, with the concentration of independent samples.  The sketch
is cut into bands; documents that agree in a band are candidates.

Candidates are confirmed on the full shingle sets.  To avoid all pairs within a
bucket, each bucket is first compared with two of its members (the one that
shares most buckets with others, and the smallest), and links give components.
Buckets that still hold several components are settled by an exact prefix filter:
a document outside its bucket's largest component is compared with every one
it can be similar enough to.  So no pair that shares a band goes unexamined unless its
two ends are already connected by confirmed links or too far apart by count.

With 42 bands of 6 rows a pair of similarity 0.8 shares no band with
probability 3e-6.

A node is a set, not a doc_id: rows of equal sets are one node, and two texts under one
doc_id are two nodes, which are linked only if their sets are.

Defined results: null or blank texts have an empty set and link with nothing;
rows that repeat a document link with each other; a row whose doc_id is null
takes part, and ``component_id`` is the smallest doc_id that is not null (null
if there is none).  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkit as K
from quarry.llm.scratch import components, save

BANDS, ROWS = 42, 6
#: Partners that a node's text meets in one part of a join.
HUB = 256
U = np.uint64


def sketch(elements: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """(documents, t) coordinates; documents without elements get zeros."""
    n = len(off) - 1
    size = np.diff(off)
    value = np.zeros((n, t), U)
    filled = np.zeros((n, t), bool)
    filled[size == 0] = True
    for r in range(2 * t):
        open_docs = np.flatnonzero(~filled.all(axis=1))
        if not len(open_docs):
            break
        doc = np.repeat(open_docs, size[open_docs])
        at = np.arange(len(doc)) + np.repeat(off[open_docs] - np.concatenate(([0], np.cumsum(size[open_docs])[:-1])), size[open_docs])
        e = K.mix(elements[at] + U((r * 0xA0761D6478BD642F + 0xE7037ED1) & (2**64 - 1)))
        bins = ((e >> U(32)) * U(t) >> U(32)).astype(np.int64) if r < t else np.full(len(e), r - t)
        low = np.full(n * t, 2**64 - 1, U)
        np.minimum.at(low, doc * t + bins, K.mix(e))
        low = low.reshape(n, t)
        new = ~filled & (low != U(2**64 - 1))
        value[new] = K.mix(low[new] + U(r))
        filled |= new
    return value


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in K.pieces(sizes):
                raws = [(x or "").encode().translate(K.LOWER) for x in texts.slice(lo, hi - lo).to_pylist()]
                e, off = K.shingle_sets(raws, width)
                n = np.diff(off)
                c1, c2 = (np.concatenate((np.zeros(1, U), np.cumsum(K.mix(e + U(s))))) for s in (0x1234567, 0x89ABCDE))
                v = sketch(e, off, bands * rows).reshape(-1, bands, rows)
                key = np.full(v.shape[:2], 0x2545F491, U) + np.arange(bands, dtype=U)
                for k in range(rows):
                    key = K.mix(key * U(0x9FB21C651E98DF25) + v[:, :, k])
                flat = pa.array(key.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "t1", "t2")), pa.array(n),
                    pa.array((c1[off[1:]] - c1[off[:-1]]).view(np.int64)), pa.array((c2[off[1:]] - c2[off[:-1]]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)],
                    names=["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "bands"])
            K.release()
    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ta, tb = b.column("ta"), b.column("tb")
            sets: dict[int, np.ndarray] = {}
            keep = []
            for i, (x, y) in enumerate(zip(a, c, strict=True)):
                todo = [(k, col[i].as_py()) for k, col in ((x, ta), (y, tb)) if k not in sets]
                if todo:
                    if len(sets) > 2000:
                        sets = {k: v for k, v in sets.items() if k in (x, y)}
                    e, off = K.shingle_sets([(t or "").encode().translate(K.LOWER) for _, t in todo], width)
                    for j, (k, _) in enumerate(todo):
                        sets[k] = e[off[j]:off[j + 1]]
                p, q = sets[x], sets[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep))], names=["a", "b"])
            del ta, tb, sets
            K.release()
    return run


#: Relative width of the size classes that the prefix filter tells apart.
CLASS_WIDTH = 1.05


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, node = b.column("text").to_pylist(), b.column("node").to_numpy()
            for lo, hi in K.pieces([len(t) for t in texts]):
                e, off = K.shingle_sets([t.encode().translate(K.LOWER) for t in texts[lo:hi]], width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[lo:hi], np.diff(off))), pa.array(e.view(np.int64))], names=["node", "token"])
    return run


def _prefix_keys(percent: int, probing: bool):
    """A row for each token of a node's prefix and each size class of possible partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [1]
        for b in batches:
            out: list[np.ndarray] = []
            at: list[np.ndarray] = []
            rest: list[np.ndarray] = []
            for i, (n, tokens) in enumerate(zip(b.column("n").to_pylist(), b.column("tokens"), strict=True)):
                least, most = -(-percent * n // 100), 100 * n // percent
                while low[-1] <= most:
                    low.append(max(low[-1] + 1, int(low[-1] * CLASS_WIDTH)))
                tok = np.asarray(tokens.values).view(U)
                own = int(np.searchsorted(low, n, side="right")) - 1
                for other in range(int(np.searchsorted(low, least, side="right")) - 1, int(np.searchsorted(low, most, side="right"))):
                    need = -(-percent * (n + max(low[other], least)) // (100 + percent))
                    length = n - need + 1 - (n - len(tok))  # tokens that no other node has come first and can't match
                    if length > 0:
                        x, y = (own, other) if probing else (other, own)
                        out.append(K.mix(tok[:length] + U((x << 20 | y) * 0x9E3779B97F4A7C15 & (2**64 - 1))))
                        at.append(np.full(length, i))
                        rest.append(len(tok) - np.arange(length))
            if out:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(b.column(c).take(take) for c in ("node", "root", "probe", "n")), pa.array(np.concatenate(rest))],
                                                 names=["token", "node", "root", "probe", "n", "rest"])
    return run


def _prefix_pairs(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the pairs of a probing node and any other node of another root that the prefix filter leaves.

    ``nodes``: node, root, probe, n, text.  Tokens are sorted by the number of nodes that have them, rarest
    first.  Two sets that are similar enough must share one of their first n - need + 1 tokens, where need
    is the least overlap for a partner of that size class.  In a group of near copies that differ from one
    text in places of their own, the first tokens of a far copy are its own changes, so it meets few others.
    """
    tokens = save(nodes.select("node", "text").mapInArrow(_tokens(width), "node long, token long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    sorted_ = (tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
               .select("node", F.col("t.token").alias("tokens")))
    sorted_ = save(sorted_.join(nodes.select("node", "root", "probe", "n"), "node"))
    kind = "token long, node long, root long, probe int, n long, rest long"
    x = sorted_.where("probe = 1").mapInArrow(_prefix_keys(percent, True), kind).alias("x")
    y = sorted_.mapInArrow(_prefix_keys(percent, False), kind).alias("y")
    once = (F.col("x.root") != F.col("y.root")) & ((F.col("y.probe") == 0) | (F.col("x.node") < F.col("y.node")))
    # if this is the first token they share, they share no more than what follows in either
    once &= (100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.n") + F.col("y.n"))
    return (x.join(y, (F.col("x.token") == F.col("y.token")) & once)
            .select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct())


def _named() -> list:
    """A row's text by 128 bits: rows with these and the doc_id in common are repeated rows."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]


def _linked(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles and ``top``, the component's node (null for an empty set), for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *_named())
    sig = save(docs.mapInArrow(_signatures(width, bands, rows),
                               "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>"))

    # equal sets are one node, numbered once; one of its rows stands for its text
    nodes = sig.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(
        F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.first("bands").alias("bands"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = nodes.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    placed = save(placed.join(shared, "key"))
    mass = placed.groupBy("node").agg(F.sum("c").alias("mass"))
    middle = (placed.join(mass, "node").groupBy("key")
              .agg(F.max_by("node", "mass").alias("m1"), F.min("node").alias("m2")))
    star = (placed.join(middle, "key").select("node", F.explode(F.array("m1", "m2")).alias("m"))
            .where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct())

    size = nodes.select("node", F.col("n_shingles").alias("n"))
    wanted = size.join(placed.select("node").distinct(), "node", "left_semi")
    wanted = wanted.join(nodes.select("node", "row.*"), "node").withColumnRenamed("doc_id", "d").select("node", "n", "d", "t1", "t2")
    of = docs.withColumnsRenamed({"t1": "u1", "t2": "u2"})
    texts = save(of.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")))
                 .select("node", "n", "text").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are similar enough.  A node with many partners meets them in parts of about
        HUB, and its text travels once for each part."""
        pairs = save(pairs)
        hubs = save(pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HUB).select("b", F.ceil(F.col("c") / HUB).cast("int").alias("parts")))
        p = pairs.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        p = p.join(texts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("text").alias("ta")), "a")
        q = texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("text").alias("tb")).join(hubs, "b", "left")
        q = q.select("b", "nb", "tb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        close = p.join(q, ["b", "part"]).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return close.select("a", "b", "ta", "tb").mapInArrow(_confirm(width, percent), "a long, b long")

    roots = components(confirmed(star))

    # what is left: buckets that still hold several components, other than the largest in each
    tagged = placed.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    tagged = save(tagged.join(split, "key"))
    main = (tagged.groupBy("key", "root").agg(F.count("*").alias("c"))
            .groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main")))
    open_nodes = (tagged.join(main, "key").groupBy("node", "root").agg(F.max((F.col("root") != F.col("main")).cast("int")).alias("probe")))
    cross = _prefix_pairs(open_nodes.join(texts, "node"), width, percent)
    more = confirmed(cross)
    tag = tagged.select("node", "root").distinct()
    more = (more.join(tag.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(tag.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    higher = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))

    final = (nodes.select("s1", "s2", "n_shingles", "node").join(roots, "node", "left")
             .select("s1", "s2", "n_shingles", F.coalesce("root", "node").alias("root"))
             .join(higher, "root", "left").select("s1", "s2", "n_shingles", F.coalesce("top", "root").alias("top")))
    return sig.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(final, ["s1", "s2", "n_shingles"], "left").drop("s1", "s2")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept.  Links need 100 * intersection >= percent * union."""
    rows_ = _linked(docs, width, percent, bands, rows)
    low = rows_.where("top is not null").groupBy("top").agg(F.min("doc_id").alias("low"))
    out = rows_.join(low, "top", "left")
    comp = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``: the one with the smallest doc_id
    (null last), then by its text's hash.  Rows without words stay; of exactly repeated rows one stays."""
    linked = save(_linked(docs, width, percent, bands, rows))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t1"), F.col("t2"))
    first = linked.where("top is not null").groupBy("top").agg(F.min(order).alias("k")).select(F.expr("k.doc_id"), F.expr("k.t1"), F.expr("k.t2"))
    stay = first.unionByName(linked.where("top is null").select("doc_id", "t1", "t2"))
    # rows that repeat each other are told by key alone; only their texts are moved once more
    several = linked.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("c"))
    stay = save(stay.distinct().alias("a").join(several.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.t1 = b.t1 AND a.t2 = b.t2")).select("a.*", "c"))
    marked = docs.select("*", F.col("doc_id").cast("long").alias("__id"), *(c.alias(f"__{i}") for i, c in enumerate(_named(), 1)))

    def those(keys: DataFrame) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("__k"), F.col("t1").alias("__k1"), F.col("t2").alias("__k2"))
        return marked.join(k, F.expr("__id <=> __k AND __1 = __k1 AND __2 = __k2"), "left_semi")

    out = those(stay)
    repeated = stay.where("c > 1")
    if not repeated.isEmpty():
        out = those(stay.where("c = 1")).unionByName(those(repeated).dropDuplicates(["__id", "__1", "__2"]))
    return out.select(docs.columns)
