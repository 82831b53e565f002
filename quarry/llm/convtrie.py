"""Conversation prefix trie by a splitter skeleton (operator 11).

A conversation is a path of turns, each named by 128 bits of SHA-256 over role and
text; a node is a distinct beginning of paths.  The paths are range-partitioned at
splitter paths taken from a sample.  Members of a node lie side by side in
path order, so a node that spans shards begins one of the splitter paths: the
trie of the splitters is the skeleton, and a shard's own two splitters tell which of
its nodes belong to it.  A shard walks its sorted paths with a stack of open nodes and
finishes all others by itself; skeleton nodes give one partial row per shard, which Spark
adds up, and the skeleton (at most a path for each shard) is closed from its leaves to the root.
Splitters hold the conversation's id too, so copies of one path are spread as well.

A path row holds at most ``segment`` turns.  Longer conversations go on in a level of their own:
its paths start with a hash of all turns before, its tries are finished first and what
their roots hold is added once to the node they hang from.  So a conversation's number of turns bounds
the number of levels, not the size of a row.

``rebuild`` makes conversations that share beginnings: each starts with the first turns of
another one.  Its numbering of turns is a range partitioning over (conversation, turn), so one
conversation may hold any part of the rows.

Defined results: rows without a conv_id belong to no conversation and are left out; null role or
text is empty; turns that tie are ordered by their hash, repeated rows are repeated turns; an
empty text has 0 words; a conversation without turns is a member of the root; for a negative c, c % 20 has c's sign;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import numbered, save

#: Bytes of a turn's name; turns of a path row; path rows that a shard should have at most; sampled paths for each shard.
NAME, SEGMENT, SHARD_PATHS, SAMPLED = 16, 256, 1 << 18, 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: Bytes of a skeleton node's list of ids that travel in one row.
ENDS = 1 << 16


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, words = [], []
        for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            r, t = (role or "").encode(), (text or "").encode()
            keys.append(hashlib.sha256(len(r).to_bytes(8, "big") + r + t).digest()[:NAME])
            words.append(len(t.split()))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(keys, pa.binary()), pa.array(words, pa.int64())],
                                         names=["conv_id", "turn", "key", "words"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key, words of every turn, by ``turn`` (null first)."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    kind = f"conv_id long, turn {dict(rows.dtypes)['turn']}, key binary, words long"
    named = save(rows.mapInArrow(_names, kind)).withColumn("any", F.monotonically_increasing_id())
    return save(numbered(named, "conv_id", ["turn", "key", "any"], "pos").select("conv_id", "pos", "key", "words"))


def rebuild(placed: DataFrame, every: int = 20, head: int = 4) -> DataFrame:
    """conv_id, pos, key, words of the rebuilt conversations: the first h turns of conversation c - c % every, then c's own
    after its first h, with h = crc32(c) % head.  A conversation without turns is a row with nulls."""
    c = F.col("conv_id")
    convs = placed.where("pos = 0").select(c, (F.crc32(c.cast("string").cast("binary")) % head).cast("int").alias("h"), (c - c % every).alias("base"))
    heads = (placed.where((F.col("pos") < head - 1) & (c % every == 0)).groupBy(c.alias("base"))  # at most head - 1 turns each
             .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("lead")))
    lead = F.slice(F.coalesce("lead", F.expr("array()").cast("array<struct<pos: long, key: binary, words: long>>")), F.lit(1), F.col("h"))
    convs = save(convs.join(heads, "base", "left").select("conv_id", "h", lead.alias("lead")))
    own = placed.join(convs.select("conv_id", "h", F.size("lead").alias("k")), "conv_id").where("pos >= h")
    first = convs.select("conv_id", F.posexplode_outer("lead")).select("conv_id", F.col("pos").cast("long"), "col.key", "col.words")
    return own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "words").unionByName(first)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        path, words = [], []
        for row in b.column("turns"):
            key, n = row.values.field("key"), row.values.field("words")
            path.append(b"".join(key.to_pylist()))
            words.append(n.to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(path, pa.binary()), pa.array(words, pa.binary())], names=["conv_id", "seg", "path", "words"])


def _common(a: bytes, b: bytes) -> int:
    """Names that two keys begin with together."""
    n, m = 0, min(len(a), len(b)) // NAME
    if a[:m * NAME] == b[:m * NAME]:
        return m
    while a[n * NAME:(n + 1) * NAME] == b[n * NAME:(n + 1) * NAME]:
        n += 1
    return n


class _Node:
    __slots__ = ("key", "words", "convs", "low", "children", "leaves", "saved", "ends", "text", "first", "below", "skeleton", "pending", "next")

    def __init__(self, key: bytes, words: int, skeleton: bool):
        self.key, self.words, self.skeleton = key, words, skeleton
        self.convs = self.children = self.leaves = self.saved = 0
        self.low = self.ends = self.first = self.below = self.next = None
        self.text: list[str] = []
        self.pending: list[dict] = []


#: kind: 0 a finished node, 1 a shard's part of a skeleton node, 2 a run of a skeleton node's ids, 3 a level's finished root.
_OUT = {"kind": pa.int32(), "key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent": pa.int64(), "above": pa.binary(), "next": pa.binary(),
        "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(),
        "words": pa.int64(), "b_children": pa.int64(), "b_leaves": pa.int64(), "b_saved": pa.int64()}
_SCHEMA = ("kind int, key binary, conv_id long, depth long, parent long, above binary, next binary, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends string, words long, b_children long, b_leaves long, b_saved long")


class _Walk:
    """One shard's sorted paths.  ``level`` 0 has the root; in others a path's first name stands for all turns before."""

    def __init__(self, level: int, segment: int):
        self.level, self.stack, self.out, self.ahead = level, [], [], level * segment
        self.before, self.shard, self.edges = b"", None, (b"", b"")

    def close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up.convs += node.convs
            up.low = node.low if up.low is None else min(up.low, node.low)
        if node.skeleton:  # its ancestors are skeleton nodes too
            self.run(node)
            b = node.below or (None, None, None)
            self.out.append({"kind": 1, "key": node.key, "conv_id": node.low, "next": node.next, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves,
                             "saved_tokens": node.saved, "words": node.words, "b_children": b[0], "b_leaves": b[1], "b_saved": b[2]})
            return
        b = node.below or (0, 0, 0)
        children, leaves = node.children + b[0], node.leaves + b[1]
        saved = node.saved + b[2] + (node.convs - 1) * node.words
        depth = len(node.key) // NAME - 1
        top = depth == 0 and self.level > 0  # stands for a node of the level before
        row = {"kind": 3 if top else 0, "key": node.key if top else None, "conv_id": node.low, "depth": depth + self.ahead, "next": node.next, "n_convs": node.convs,
               "n_children": children, "n_leaves": leaves if children else 1, "saved_tokens": saved - (0 if not top else (node.convs - 1) * node.words),
               "ends": node.ends.hexdigest() if node.ends is not None else EMPTY}
        for child in node.pending:
            child["above" if top else "parent"] = node.key if top else node.low
        self.out += node.pending
        if up is None:
            self.out.append(row)
        else:
            up.children += 1
            up.leaves += row["n_leaves"]
            up.saved += saved
            if up.skeleton:
                row["above"] = up.key
                self.out.append(row)
            else:
                up.pending.append(row)

    def run(self, node: _Node) -> None:
        if node.text:
            self.out.append({"kind": 2, "key": node.key, "conv_id": node.first, "ends": ",".join(node.text)})
            node.text, node.first = [], None

    def step(self, shard: int, edges: tuple[bytes, bytes], key: bytes, words: bytes, conv: int, ends: bool, following: bytes | None, below: tuple) -> None:
        if shard != self.shard:
            self.finish()
            self.shard, self.edges, self.before = shard, edges, b""
        same = _common(key, self.before) if self.stack else 0
        while len(self.stack) > same:
            self.close()
        if len(key) // NAME > same:
            skeleton = max(_common(key, e) for e in self.edges)
            n = np.frombuffer(words, np.int64)
            for t in range(same, len(key) // NAME):
                self.stack.append(_Node(key[:(t + 1) * NAME], int(n[t - 1]) if t else 0, t < skeleton))
        self.before = key
        node = self.stack[-1]
        node.convs += 1
        node.low = conv if node.low is None else min(node.low, conv)
        if not ends:
            node.next, node.below = following, below
        elif node.skeleton:
            node.first = conv if not node.text else node.first
            node.text.append(str(conv))
            if len(node.text) >= ENDS >> 4:
                self.run(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(b",%d" % conv)

    def finish(self) -> None:
        while self.stack:
            self.close()


def _shards(level: int, segment: int, splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [k for k, _ in splitters.value]
        walk = _Walk(level, segment)

        def rows() -> pa.RecordBatch:
            out, walk.out = walk.out, []
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in _OUT.items()], names=list(_OUT))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("shard", "key", "words", "conv_id", "ends", "next", "b_children", "b_leaves", "b_saved")]
            for shard, key, words, conv, ends, following, *below in zip(*columns, strict=True):
                edges = (keys[shard - 1] if shard else b"", keys[shard] if shard < len(keys) else b"")
                walk.step(shard, edges, key, words, conv, ends, following, tuple(below))
                if len(walk.out) >= 1 << 14:
                    yield rows()
        walk.finish()
        if walk.out:
            yield rows()
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids, sorted by node and first id, to one hash for each node."""
    key, h = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "digest"])


def _close_skeleton(rows: list, level: int, segment: int) -> list[tuple]:
    """Skeleton nodes with all their shards' parts added up, to whole nodes: children before parents."""
    nodes = {bytes(r["key"]): r.asDict() for r in rows}
    for key in sorted(nodes, key=len, reverse=True):
        n = nodes[key]
        n["n_children"] += n["b_children"] or 0
        n["n_leaves"] = n["n_leaves"] + (n["b_leaves"] or 0) if n["n_children"] else 1
        n["saved_tokens"] += (n["b_saved"] or 0) + (n["n_convs"] - 1) * n["words"]
        up = nodes.get(key[:-NAME])
        if up is not None:
            up["n_children"] += 1
            up["n_leaves"] += n["n_leaves"]
            up["saved_tokens"] += n["saved_tokens"]
    out = []
    for key, n in nodes.items():
        depth = len(key) // NAME - 1
        up = nodes.get(key[:-NAME])
        top = level > 0 and depth == 0
        above = key[:-NAME] if level > 0 and depth == 1 else None
        out.append((3 if top else 0, bytearray(key), n["conv_id"], depth + level * segment, None if up is None or above else up["conv_id"], bytearray(above) if above else None,
                    n["next"], n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"]))
    return out


_NODE = ["kind", "key", "conv_id", "depth", "parent", "above", "next", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _level(rows: DataFrame, level: int, segment: int) -> DataFrame:
    """The nodes (kind 0) and roots (kind 3) of one level's paths; ``above`` is left where the parent is in the level before."""
    spark = rows.sparkSession
    total = rows.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_PATHS))
    share = min(1 << 30, SAMPLED * shards * (1 << 30) // max(1, total))
    sample = sorted((bytes(r["key"]), r["conv_id"]) for r in  # about SAMPLED paths for each shard
                    rows.where(F.pmod(F.xxhash64("conv_id", "key"), F.lit(1 << 30)) < share).select("key", "conv_id").collect())
    splitters = sorted({sample[i * len(sample) // shards] for i in range(1, shards)}) if sample else []
    shared = spark.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def shard_of(key: pa.Array, conv: pa.Array) -> pa.Array:
        cuts = shared.value
        return pa.array([bisect_right(cuts, x) for x in zip(key.to_pylist(), conv.to_pylist(), strict=True)], pa.int32())

    dealt = rows.withColumn("shard", shard_of("key", "conv_id")).repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "conv_id")
    out = save(dealt.mapInArrow(_shards(level, segment, shared), _SCHEMA))
    parts = out.where("kind = 1").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("next").alias("next"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        *(F.max(c).alias(c) for c in ("words", "b_children", "b_leaves", "b_saved")))
    skeleton = spark.createDataFrame(_close_skeleton(parts.collect(), level, segment),  # at most a path for each splitter
                                     "kind int, key binary, conv_id long, depth long, parent long, above binary, next binary, n_convs long, n_children long, n_leaves long, saved_tokens long")
    runs = out.where("kind = 2").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, digest string")
    skeleton = save(skeleton.join(runs, "key", "left").select(*_NODE, F.coalesce("digest", F.lit(EMPTY)).alias("ends")))
    local = out.where("kind in (0, 3)").select(*_NODE, "ends")
    upper = skeleton.where("kind = 0").select(F.col("key").alias("above"), F.col("conv_id").alias("up"))
    local = local.join(F.broadcast(upper), "above", "left")  # the skeleton again
    local = local.select(*(c if c != "parent" else F.coalesce("parent", "up").alias("parent") for c in _NODE if c != "above"),
                         F.when(F.col("up").isNull(), F.col("above")).alias("above"), "ends")
    return save(local.unionByName(skeleton))


def _following(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, NAME)


def trie(rebuilt: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the paths in
    ``rebuilt`` (conv_id, pos from 0 without gaps, key, words; a row with nulls for a conversation without turns)."""
    grouped = rebuilt.groupBy("conv_id", F.coalesce(F.expr(f"pos div {segment}"), F.lit(0)).cast("int").alias("seg"))
    # a bounded number of turns in each group
    listed = grouped.agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "words")))).alias("turns"))
    segments = save(listed.mapInArrow(_paths, "conv_id long, seg int, path binary, words binary"))
    top = segments.agg(F.max("seg")).first()[0] or 0
    levels, before = [], None
    for s in range(top + 1):
        own = segments.where(F.col("seg") == s)
        if before is None:
            own = own.withColumn("key", F.concat(F.lit(bytes(NAME)), "path"))
        else:
            own = own.join(before.where("next is not null").select("conv_id", "next"), "conv_id").withColumn("key", F.concat("next", "path")).drop("next")
        on = segments.where(F.col("seg") == s + 1).select("conv_id", F.lit(True).alias("more"))
        own = own.join(on, "conv_id", "left") if s < top else own.withColumn("more", F.lit(None).cast("boolean"))
        before = save(own.select("conv_id", "key", "words", F.col("more").isNull().alias("ends"), F.when(F.col("more"), _following(F.col("key"))).alias("next")))
        levels.append(before)
    out, hanging, below = [], None, None
    for s in range(top, -1, -1):
        rows = levels[s]
        kinds = [F.lit(None).cast("long").alias(c) for c in ("b_children", "b_leaves", "b_saved")]
        rows = rows.select("*", *kinds) if below is None else rows.join(below, "next", "left")
        made = _level(rows, s, segment)
        if hanging is not None:  # the level below: its first nodes' parents are here
            hung = made.where("next is not null").select(F.col("next").alias("above"), F.col("conv_id").alias("up"))
            out.append(hanging.join(hung, "above", "left").withColumn("parent", F.coalesce("parent", "up")))
        below = made.where("kind = 3").select(F.col("key").alias("next"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
        hanging = made.where("kind = 0")
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in [*out, hanging]])
