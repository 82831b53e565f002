"""Vectorised text helpers that run inside tasks: words, hashes and shingle
sets of a batch of texts as flat numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z to a-z, every other byte as it is; ``bytes.split()`` then cuts at [\x20\x09-\x0D]+.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one numpy step works on.
STEP = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task: one thing, until another operator's task releases memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release(keep=None) -> None:
    """Give freed memory back to the system: workers are used again by later stages, beside the JVM.
    Only what is ``held`` under the key ``keep`` stays."""
    for key in [k for k in _held if k != keep]:
        del _held[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Running polynomial hash h with h[0] = 0; ``span_hash`` reads any slice's hash from it."""
    up, _ = powers(len(a))
    h = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * up[:len(a)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def pieces(sizes: list[int], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Cuts a batch of rows into runs of about ``step`` bytes (one long text may be more)."""
    lo = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > step:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts, in order."""
    buf = b"\n".join(raws) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    sp = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sp))))
    start, end = edge[0::2], edge[1::2]
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    row = np.searchsorted(first, start, side="right") - 1
    return span_hash(prefix_hash(a), start, end), row


def shingle_sets(raws: list[bytes], width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, and offsets (one
    more than texts).  A text with fewer words than ``width`` has its whole
    sequence as one shingle; one without words has none."""
    h, row = words(raws)
    n = np.bincount(row, minlength=len(raws))
    first = np.concatenate(([0], np.cumsum(n)))
    out: list[np.ndarray] = []
    if len(h) >= width:
        m = len(h) - width + 1
        s = h[:m].copy()
        for k in range(1, width):
            s = mix(s * U(0x9FB21C651E98DF25) + h[k:m + k])
        own = row[:m] == row[width - 1:]
        s, srow = s[own], row[:m][own]
    else:
        s, srow = np.zeros(0, U), np.zeros(0, row.dtype)
    short = np.flatnonzero((n > 0) & (n < width))
    cuts = np.searchsorted(srow, np.arange(len(raws) + 1))
    shorts = set(short.tolist())
    for i in range(len(raws)):
        if i in shorts:
            x = np.zeros(1, U)
            for v in h[first[i]:first[i + 1]]:
                x = mix(x * U(0x9FB21C651E98DF25) + v + U(0x51))
        else:
            x = np.sort(s[cuts[i]:cuts[i + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        out.append(x)
    off = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U)), off
