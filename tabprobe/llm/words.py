"""Words of a text column as 64-bit hashes, computed on Arrow's UTF-8 buffers.

A word is a run of bytes of a class (``word_table``); every non-ASCII byte
belongs to the class, so byte classes and character classes agree. A-Z count
as a-z. The hash of a word is a polynomial over its bytes (one random 64-bit
value per byte, modulo 2**64), taken from prefix sums, so a whole chunk of
texts costs a few NumPy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts hashed at once: bounds the temporary arrays, drops nothing
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)


def _byte_values() -> np.ndarray:
    v = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v[65:91] = v[97:123]
    return v


_VALUES = _byte_values()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h = h ^ (h >> np.uint64(33))
    h = h * _C2
    return h ^ (h >> np.uint64(33))


def word_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words; ``separators`` lists the others."""
    t = np.ones(256, dtype=bool)
    t[np.frombuffer(separators, dtype=np.uint8)] = False
    return t


#: words are runs of anything but space, tab, line feed, VT, FF, CR
SPACE_WORDS = word_table(bytes([0x20, *range(0x09, 0x0E)]))
#: words are runs of 0-9, a-z, A-Z and non-ASCII characters
ALNUM_WORDS = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
ALNUM_WORDS[65:91] = True  # A-Z are lower-cased before the class applies


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of len + 1) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=n + 1 + arr.offset)[arr.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if n and arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    base = int(off[0])
    return data[base:int(off[-1])], off - base


def slices(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes (one row at least)."""
    _, off = text_buffers(arr)
    n, lo = len(arr), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def find_words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """(start byte, end byte, words before each row) of the words in ``data``."""
    n = len(data)
    rows = len(off) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    m = table[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    cuts = off[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = m[cuts]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = m[inner]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off, side="left")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; spans are in order and disjoint.

    Long data is taken in pieces that end at a span's end."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + CHUNK_BYTES, side="right")))
        piece = data[at:ends[hi - 1]]
        up, down = _powers(len(piece) + 1)
        s = np.empty(len(piece) + 1, dtype=np.uint64)
        s[0] = 0
        np.cumsum(_VALUES[piece] * up[:len(piece)], out=s[1:])
        b, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((s[e] - s[b]) * down[b] + (e - b).astype(np.uint64))
        lo = hi
    return out


def hashed_words(arr: pa.Array, table: np.ndarray):
    """(data, starts, ends, row bounds, hashes) of the words of a string array."""
    data, off = text_buffers(arr)
    starts, ends, bounds = find_words(data, off, table)
    return data, starts, ends, bounds, hash_spans(data, starts, ends)


_ORDER = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (len(h) - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, dtype=np.uint64) * _C2
    for j in range(k):
        acc = acc * _ORDER + h[j:j + n]
    return mix(acc)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int):
    """(shingle hashes, row of each): every k consecutive words of a row; a row
    of fewer words, but some, gives its whole sequence once."""
    counts = np.diff(bounds)
    g = gram_hashes(h, k)
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(h)) - bounds[:-1][row]
    ok = np.flatnonzero(pos + k <= counts[row])
    vals, rows = [g[ok]], [row[ok]]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for n in np.unique(counts[short]):
        r = short[counts[short] == n]
        acc = np.full(len(r), n, dtype=np.uint64) * _C2
        for j in range(int(n)):
            acc = acc * _ORDER + h[bounds[r] + j]
        vals.append(mix(acc))
        rows.append(r)
    v, r = np.concatenate(vals), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return v[order], r[order]


def lowered(data: np.ndarray, start: int, end: int) -> str:
    """The text of a span with A-Z lower-cased."""
    b = data[start:end]
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8).tobytes().decode("utf-8", "replace")
