"""Byte-level BPE encoding and decoding by tree reduction (operator 10).

A text is cut into pieces by the vocabulary's pattern, and each piece is encoded
on its own.  A piece's encoding is reduced up a tree: its halves are encoded
recursively (its leaves, short runs of bytes, directly by merging the pair of least rank; the leaves of
many pieces are merged side by side as rows of a matrix), and neighbours are joined by encoding anew a window of tokens around the seam.
If the window's outermost tokens come out as they were, everything outside is
final: a sequence of tokens is the encoding exactly if every two neighbours are
the encoding of their own bytes, and all pairs outside the window, and those at its
ends, are unchanged.  Otherwise the window grows.  Decoding joins the tokens'
bytes up the same tree.

The vocabulary is read by the driver and broadcast (its size is fixed).
Encodings of short pieces are remembered, up to a fixed number of entries, until a worker turns to another operator.

Defined results: a null or empty text has no tokens; extra columns are passed
through by ``encode``; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textkit import held, pieces, release

#: Bytes encoded directly; number of pieces that are remembered.
LEAF, MEMO = 24, 1 << 18
#: Leaves merged side by side.
SIDE_BY_SIDE = 1 << 13
#: Up to so many bytes every merge looks through all pairs; beyond, a heap holds them.
SHORT, NONE = 32, 1 << 60


class PairTable:
    """Which token two neighbouring tokens make: every split of a token into two others, in an open-addressed table."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(x << 32 | y, r) for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None]
        self.bits = max(4, (4 * len(found)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        key, rank = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
        at, todo = self._place(key), np.arange(len(found))
        while len(todo):  # of the pairs that want a place the first free one gets it, the others go on
            free = self.key[at[todo]] == -1
            self.key[at[todo[free]]] = key[todo[free]]
            mine = self.key[at[todo]] == key[todo]
            self.rank[at[todo[mine]]] = rank[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that left and right make, or NONE."""
        key = left << 32 | right
        at = self._place(key)
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            have = self.key[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (have != -1)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, leaves: list[bytes]) -> list[bytes]:
        """The tokens (32 bits each) of every leaf, all as long as the first: the leftmost pair of least rank is
        merged in all of them at once, until none has a pair, so open rows always have equally many tokens."""
        n, width = len(leaves), len(leaves[0])
        token = self.byte[np.frombuffer(b"".join(leaves), np.uint8)].reshape(n, width)
        done, row = [b""] * n, np.arange(n)
        pair = np.full((n, width), NONE, np.int64)  # the last column never has a pair
        pair[:, :-1] = self.find(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            j = pair.argmin(axis=1)
            low = pair[np.arange(len(row)), j]
            stop = low == NONE
            if stop.any():
                raw, each = token[stop].astype(np.int32).tobytes(), 4 * width
                for k, i in enumerate(row[stop].tolist()):
                    done[i] = raw[k * each:(k + 1) * each]
                row, token, pair, j, low = (x[~stop] for x in (row, token, pair, j, low))
            if not len(row):
                return done
            n, width = np.arange(len(row)), width - 1
            keep = np.ones(token.shape, bool)
            keep[n, j + 1] = False
            token, pair = token[keep].reshape(-1, width), pair[keep].reshape(-1, width)
            token[n, j] = low
            pair[n, j] = NONE
            for side in (j - 1, j):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                at = side[ok]
                pair[ok, at] = self.find(token[ok, at], token[ok, at + 1])


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs = PairTable(ranks)
        self.memo: dict[str, bytes] = {}
        order = sorted(self.bytes_of)
        #: token bytes by id, for gathering; ids without a token are empty
        self.tokens = pa.array([self.bytes_of.get(i, b"") for i in range(order[-1] + 1)] if order else [], pa.binary())
        self.lengths = np.array([len(x) for x in self.tokens.to_pylist()], np.int64)

    def short(self, b: bytes) -> list[int]:
        """``direct`` for few bytes: looks through all pairs for each merge."""
        get = self.ranks.get
        parts = [b[i:i + 1] for i in range(len(b))]
        pairs = [get(b[i:i + 2], NONE) for i in range(len(b) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
        return [self.ranks[p] for p in parts]

    def direct(self, b: bytes) -> list[int]:
        """Merges the leftmost pair of least rank until none is left."""
        ranks, n = self.ranks, len(b)
        if n <= SHORT:
            return self.short(b)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(b[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if after[i] != j or j >= n or after[j] != k:
                continue
            after[i] = k
            after[j] = n + 1  # gone
            if k < n:
                before[k] = i
                m = after[k]
                if (r := ranks.get(b[i:m])) is not None:
                    heapq.heappush(heap, (r, i, k, m))
            h = before[i]
            if h >= 0 and (r := ranks.get(b[h:k])) is not None:
                heapq.heappush(heap, (r, h, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[b[i:after[i]]])
            i = after[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 1
        while left and right:
            i, j = min(width, len(left)), min(width, len(right))
            window = self.direct(self.decode(left[-i:] + right[:j]))
            if (i == len(left) or window[0] == left[-i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:-i] + window + right[j:]
            width *= 2
        return left or right

    def encode(self, b: bytes) -> list[int]:
        if len(b) <= LEAF:
            return self.direct(b)
        return self.up([self.direct(b[i:i + LEAF]) for i in range(0, len(b), LEAF)])

    def remember(self, found: list[list[str]]) -> None:
        """Encodes the pieces that are not remembered yet: their leaves together, then each piece's up its tree."""
        new = set().union(*found).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*found)
        short: dict[int, list[str]] = {}
        for p in new:
            short.setdefault(len(p.encode()), []).append(p)
        for size, names in short.items():
            if size <= LEAF:
                for lo in range(0, len(names), SIDE_BY_SIDE):
                    part = names[lo:lo + SIDE_BY_SIDE]
                    self.memo.update(zip(part, self.pairs.merge([p.encode() for p in part]), strict=True))
            else:
                for p in names:
                    b = p.encode()
                    whole = self.pairs.merge([b[i:i + LEAF] for i in range(0, size - size % LEAF, LEAF)])
                    whole += self.pairs.merge([b[size - size % LEAF:]]) if size % LEAF else []
                    self.memo[p] = np.array(self.up([np.frombuffer(x, np.int32).tolist() for x in whole]), np.int32).tobytes()

    def up(self, level: list[list[int]]) -> list[int]:
        """The leaves' tokens joined up the tree: a very long piece needs no deep recursion."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_tree(self, off: np.ndarray, ids: np.ndarray, leaf: int = 4096) -> list[bytes]:
        """The bytes of each text, ids[off[i]:off[i + 1]]: leaves of tokens are gathered, and joined two by two."""
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        whole = self.tokens.take(pa.array(ids)).buffers()[2] if len(ids) else None
        raw = whole.to_pybytes() if whole is not None else b""
        out = []
        for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            level = [raw[ends[i]:ends[min(y, i + leaf)]] for i in range(x, y, leaf)] or [b""]
            while len(level) > 1:
                level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
            out.append(level[0])
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _key(raw: bytes) -> tuple[str, int]:
    return "bpe", hash(raw)


def _encoder(raw: bytes) -> TreeEncoder:
    return held(_key(raw), lambda: TreeEncoder(read_ranks(raw)))


def encode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the encoding of ``text``."""
    with open(rank_file, "rb") as f:  # on the driver: a vocabulary that is part of the installation
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()), False)])
    names = [f.name for f in schema.fields]
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, find = _encoder(shared.value), regex.compile(pattern).findall
        for b in batches:
            for lo, hi in pieces(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_pylist()):
                part = b.slice(lo, hi - lo)
                found = [find(t) if t else [] for t in part.column(text_at).to_pylist()]
                encoder.remember(found)
                get = encoder.memo.__getitem__
                packed = [b"".join(map(get, x)) for x in found]
                off = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off), flat)], names=names)
            release(_key(shared.value))

    return docs.mapInArrow(run, schema)


def decoder(docs: DataFrame, rank_file: str):
    """A function of an array<int> column: the bytes of its tokens."""
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        encoder = _encoder(shared.value)
        off = ids.offsets.to_numpy()
        return pa.array(encoder.decode_tree(off - off[0], ids.values.to_numpy()[off[0]:off[-1]]), pa.binary())

    return decode
