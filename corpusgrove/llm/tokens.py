"""Byte-level text kernels over Arrow string columns (NumPy, no per-word Python).

All word and line rules of the operators use ASCII separators only, so they can
be applied to the UTF-8 bytes directly: a multi-byte character never contains
an ASCII byte. Texts are handled in slices of a few megabytes (one long text
may exceed a slice by itself), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n."""
    got = _powers.get((which, inverse))
    if got is None or len(got) < n:
        base = _BASES[which]
        if inverse:
            base = pow(base, -1, 1 << 64)
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 2 * SLICE_BYTES:  # longer ones (one very long text) are not kept
            _powers[which, inverse] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True bytes that do not cross a row: (starts, ends, first
    run of each row and one past the last)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    prev[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~prev)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row."""
    return runs(~SPACE[buf], off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial over the bytes, then mixed with
    the length. ``which`` picks one of two independent bases."""
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), which), out=c[1:])
    h = c[ends] - c[starts]
    if len(starts):
        h *= powers(int(starts[-1]) + 1, which, True)[starts] if np.all(starts[1:] >= starts[:-1]) else powers(int(starts.max()) + 1, which, True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(x: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of every k consecutive items of x (rows are not told apart)."""
    n = len(x)
    if n < k:
        return np.zeros(0, np.uint64)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(x * powers(n, which), out=c[1:])
    return mix((c[k:] - c[:-k]) * powers(n - k + 1, which, True))


def owner(first: np.ndarray) -> np.ndarray:
    """Row of each item, from the row boundaries."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_mask(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k consecutive items lie within one row."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    row = owner(first)
    return row[: n - k + 1] == row[k - 1:]


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    x = LOWER[buf]
    if len(x) > 1:
        after = np.flatnonzero(x[:-1] == 0xC3) + 1
        v = x[after]
        x[after] = np.where((v >= 0x80) & (v <= 0x9E) & (v != 0x97), v + 0x20, v)
    return x


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def squeeze(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize * n
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype)
