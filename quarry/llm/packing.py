"""Sharding by best-fit-decreasing bin packing (operator 12).

Documents of equal texts are a group that stays together.  Groups are taken by
falling size, and each enters the shard with the least room that still holds it;
a new shard is opened only if none does.  The rooms are kept in a balanced tree.

Groups of one size are alike, so the packing is worked out on the histogram of group
sizes, which Spark counts: a run of equal groups fills the tightest shard as far as it
goes, then the next (the same result as one group at a time).  Sizes are whole
bytes, so D different sizes need D * (D + 1) / 2 bytes: the histogram that reaches the driver
has at most sqrt(2 * all bytes) rows (14 million for 100 TB), and the packing's
runs are no more than that and a logarithm's multiple of the shards.  Spark ranks the
groups by size and looks every group's shard up by its rank.

With a number of shards instead of a capacity, the smallest capacity is searched for
which the packing needs no more shards: sizes come out near equal.

Defined results: a null text is an empty one (size 1); a null doc_id is a row like
others; groups are named by SHA-256, rows of equal texts are alike and take the slots
in doc_id order (null first), repeated rows in any; a group larger than the capacity
can't stay whole and is cut into the fewest parts that fit; a single row larger than a
given capacity raises the capacity to its size; extra columns are ignored by ``assign``
and kept by ``write``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import numbered, running_total, save


class Rooms:
    """The shards' rooms as a treap: pairs (room, shard), balanced by hashed priorities."""

    def __init__(self):
        self.root = None  # node: [pair, priority, left, right]

    def _split(self, t, pair):
        if t is None:
            return None, None
        if t[0] < pair:
            t[3], right = self._split(t[3], pair)
            return t, right
        left, t[2] = self._split(t[2], pair)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        left, right = self._split(self.root, (room, shard))
        node = [(room, shard), (room * 0x9E3779B97F4A7C15 ^ shard * 0xBF58476D1CE4E5B9) * 0x94D049BB133111EB % (1 << 64), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (room, shard) that holds ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        up, t = None, right
        while t[2] is not None:
            up, t = t, t[2]
        if up is None:
            right = t[3]
        else:
            up[2] = t[3]
        self.root = self._merge(left, right)
        return t[0]


def best_fit(items: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count) of ``items``, sizes falling: the (count, shard) runs its groups go to.
    None if more than ``most`` shards are needed."""
    rooms, opened, out = Rooms(), 0, []
    for size, count in items:
        runs = []
        while count:
            found = rooms.take(size)
            if found is None:
                if opened == most:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            n = min(count, room // size)
            runs.append((n, shard))
            count -= n
            rooms.add(room - n * size, shard)
        out.append(runs)
    return out


@dataclass
class Plan:
    """Runs of groups in rank order (from where, which shard), and for the rows of cut groups
    {key: [(first row, shard)]}."""
    capacity: int
    starts: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)
    cut: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    shards: int = 0


def plan(sizes: list[tuple[int, int]], named: list[tuple[bytes, int, int, int]], capacity: int, most: int | None = None) -> Plan | None:
    """``sizes``: (size, groups) of the groups within the capacity, falling; ``named``: (key, rows, row size, rows that
    have a shard of their own) of the groups that are cut."""
    out, rank, row = Plan(capacity), 0, {}
    items = [(size, n, None) for size, n in sizes]
    for key, rows, each, alone in named:
        out.cut[key] = [(i, out.shards + i) for i in range(alone)]
        out.shards, row[key], rows = out.shards + alone, alone, rows - alone
        per = capacity // each
        if rows:
            items += [(per * each, rows // per, (key, per))] * (rows >= per) + [(rows % per * each, 1, (key, rows % per))] * (rows % per > 0)
    items.sort(key=lambda x: -x[0])  # stable: a cut group's whole parts stay ahead of its rest
    packed, alone = best_fit([x[:2] for x in items], capacity, None if most is None else most - out.shards), out.shards
    if packed is None:
        return None
    for (_, _, part), runs in zip(items, packed, strict=True):
        for n, shard in runs:
            shard += alone
            if part is None:
                out.starts.append(rank)
                out.shard.append(shard)
                rank += n
            else:
                key, per = part
                out.cut[key].append((row[key], shard))
                row[key] += n * per
            out.shards = max(out.shards, shard + 1)
    return out


def assign(docs: DataFrame, *, shards: int | None = 8, capacity: int | None = None, extra: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text): as few shards of ``capacity``
    bytes as the packing finds or, without a capacity, ``shards`` near equal ones.  ``extra`` names a column that is passed through."""
    text = F.coalesce("text", F.lit(""))
    base = save(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                            F.unhex(F.sha2(text, 256)).alias("key"), *([extra] if extra else [])))
    groups = save(base.groupBy("key", "size").agg(F.count("*").alias("n")).select("key", "n", F.col("size").alias("each"), (F.col("n") * F.col("size")).alias("size")))
    hist = groups.groupBy("size").agg(F.count("*").alias("n")).toArrow()  # at most sqrt(2 * all bytes) rows
    by_size = sorted(zip(hist.column("size").to_pylist(), hist.column("n").to_pylist(), strict=True), reverse=True)
    total = sum(s * n for s, n in by_size)
    wide: dict[bytes, list[int]] = {}  # key: rows, row size, rows alone

    def attempt(room: int, most: int | None) -> Plan | None:
        named = {bytes(r["key"]): [r["n"], r["each"], 0] for r in  # fewer than all bytes / room
                 groups.where(F.col("size") > room).select("key", "n", "each").collect()} if by_size and by_size[0][0] > room else {}
        named |= wide
        out = {}
        for n, each, _ in named.values():
            out[n * each] = out.get(n * each, 0) + 1
        sizes = [(s, n - out.get(s, 0)) for s, n in by_size if n > out.get(s, 0)]
        return plan(sizes, sorted((k, *v) for k, v in named.items()), room, most)

    if capacity is not None:
        best = attempt(max(capacity, groups.agg(F.max("each")).first()[0] or 1), None)
    else:
        # a row above an equal share has a shard of its own, and the others share the rest
        found = groups.where(F.col("each") > total / shards).select("key", "n", "each").collect()  # fewer rows than shards
        rest, free = total, shards
        for each, key, n in sorted(((r["each"], bytes(r["key"]), r["n"]) for r in found), reverse=True):
            alone = 0
            while alone < n and each * free > rest:
                rest, free, alone = rest - each, free - 1, alone + 1
            if alone:
                wide[key] = [n, each, alone]
        low = max(1, -(-rest // free))
        step, best = 1, attempt(low, shards)
        if best is None:
            while (best := attempt(low + step, shards)) is None:
                low, step = low + step, step * 2
            high = low + step
            while high - low > 1:
                mid = (low + high) // 2
                tried = attempt(mid, shards)
                low, high, best = (low, mid, tried) if tried else (mid, high, best)

    spark = docs.sparkSession
    runs = spark.sparkContext.broadcast((np.array(best.starts, np.int64), np.array(best.shard, np.int32)))  # bounded as the histogram

    @F.arrow_udf("int")
    def shard_of(rank: pa.Array) -> pa.Array:
        starts, shard = runs.value
        return pa.array(shard[np.searchsorted(starts, rank.to_numpy(), side="right") - 1])

    whole = (groups.where(~F.col("key").isin(*(bytearray(k) for k in best.cut))) if best.cut else groups).withColumn("one", F.lit(1).cast("long"))
    ranked = save(running_total(whole.select("key", "size", "one"), [F.col("size").desc(), "key"], "one", "rank").select("key", shard_of("rank").alias("shard")))
    columns = ["doc_id", "size", "text_crc32", *([extra] if extra else []), "shard"]
    placed = base.join(ranked, "key").select(*columns)
    if best.cut:
        keys = [bytearray(k) for k in best.cut]
        parts = spark.createDataFrame([(bytearray(k), [x[0] for x in v], [x[1] for x in v]) for k, v in best.cut.items()], "key binary, starts array<long>, shards array<int>")
        rows = numbered(base.where(F.col("key").isin(*keys)).withColumn("any", F.monotonically_increasing_id()), "key", ["doc_id", "any"], "row")
        rows = rows.join(F.broadcast(parts), "key")  # at most some rows for each shard
        at = F.size(F.filter("starts", lambda s: s <= F.col("row")))
        placed = placed.unionByName(rows.select(*columns[:-1], F.element_at("shards", at.cast("int")).alias("shard")))
    placed = placed.withColumn("any", F.monotonically_increasing_id())
    return numbered(placed, "shard", ["doc_id", "any"], "slot").drop("any")


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes the rows of ``docs``, all columns, as Parquet below ``path/shard=N``, in slot order."""
    rows = assign(docs.select("doc_id", "text", F.struct("*").alias("__row")), extra="__row", **options)
    (rows.select("__row.*", F.col("shard").alias("shard"), "slot") if "shard" not in docs.columns and "slot" not in docs.columns
     else rows.select("__row", "shard", "slot")).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
