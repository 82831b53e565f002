"""Tables that tasks look hashed keys up in, of any size: sorted arrays, cut by
key range into shards of about SHARD_ROWS rows that are gathered and broadcast one
by one.  The number of shards grows with the table, and no row is left out; the driver
and a task hold KEPT shards at a time at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import save

SHARD_ROWS, KEPT = 1 << 21, 2
U = np.uint64


class Shard:
    """Rows of the keys from ``first`` on; those of key ``keys[i]`` are rows off[i] to off[i + 1] of every column."""

    def __init__(self, key: np.ndarray, columns: dict[str, np.ndarray], first: int, bits: int):
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.columns = {name: c[order] for name, c in columns.items()}
        self.off = np.append(new, len(key)).astype(np.int32)
        self.keys = np.append(key[new], U(2**64 - 1))
        self.first, grain = U(first), min(64 - bits, max(1, int(len(new)).bit_length()))
        self.shift = U(64 - bits - grain)
        self.start = np.searchsorted(self.keys[:-1], self.first + (np.arange(1 << grain, dtype=U) << self.shift)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``wanted`` (keys of this shard's range) that have rows, and their places in ``keys``."""
        at = self.start[((wanted - self.first) >> self.shift).astype(np.int64)]
        less = np.flatnonzero(self.keys[at] < wanted)
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < wanted[less]]
        hit = np.flatnonzero((self.keys[at] == wanted) & (at < len(self.keys) - 1))
        return hit, at[hit]


class Shards:
    def __init__(self, parts: list, bits: int):
        self.parts, self.bits = parts, bits

    def find(self, wanted: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Shard]]:
        """(i, places in wanted[i], places in the shard's keys, shard) for every shard and array."""
        for part in self.parts:
            shard = part.value
            for i, w in enumerate(wanted):
                own = None if not self.bits else np.flatnonzero(w >> U(64 - self.bits) == shard.first >> U(64 - self.bits))
                hit, at = shard.find(w if own is None else w[own])
                yield i, hit if own is None else own[hit], at, shard
            if len(self.parts) > KEPT:
                part.__dict__.pop("_value", None)  # the worker's copy; it is read again from the executor's file

    def free(self) -> None:
        """Takes the shards off the executors, once all lookups are done."""
        for part in self.parts:
            part.destroy()


def share(table: DataFrame, key: str, rows: int | None = None) -> Shards:
    """``table``, by its evenly hashed long column ``key``, for lookups inside tasks."""
    rows = rows or SHARD_ROWS
    sc, table = table.sparkSession.sparkContext, save(table)
    bits = max(0, -(-table.count() // rows) - 1).bit_length()
    if bits:  # sorted, so that a shard is read from its own files
        table = save(table.repartitionByRange(1 << bits, key).sortWithinPartitions(key))
    parts = []
    for i in range(1 << bits):
        first = i << (64 - bits) if bits else 0
        low = first - (1 << 64) if first >> 63 else first
        own = table.where(F.col(key).between(low, low + (1 << (64 - bits)) - 1)) if bits else table
        t = own.toArrow()  # about ``rows`` rows
        columns = {c: t.column(c).to_numpy() for c in t.column_names if c != key}
        parts.append(sc.broadcast(Shard(t.column(key).to_numpy().view(U), columns, first, bits)))
    return Shards(parts, bits)
