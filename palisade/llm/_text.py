"""Vectorised words, hashes and byte views over Arrow string arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once; keeps the working arrays in cache.
CHUNK = 1 << 19
_K = U64(0x9E3779B97F4A7C15)
_K_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = U64(0xBF58476D1CE4E5B9)

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no part of a word: white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no part of a word of letters, digits and non-ASCII characters.
NO_LETTER = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U64(32))
    h = h * _MIX
    return h ^ (h >> U64(29))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.full(n, _K, np.uint64)
    inv = np.full(n, _K_INV, np.uint64)
    one[:1] = inv[:1] = 1
    return np.cumprod(one), np.cumprod(inv)


def view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is empty. Offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    if arr.null_count:
        arr = arr.fill_null("" if "string" in str(arr.type) else b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(b: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """Stretches of at most about CHUNK bytes that end between documents or, in long ones, after a separator."""
    p, n = 0, len(b)
    while p < n:
        end = n
        if n - p > CHUNK:
            at = int(offsets[np.searchsorted(offsets, p + CHUNK, "right") - 1])
            if at > p:
                end = at
            else:
                size = CHUNK
                stop = int(offsets[np.searchsorted(offsets, p, "right")])
                while True:
                    q = min(p + size, stop)
                    found = np.flatnonzero(sep[b[p:q]])
                    if q == stop:
                        end = q
                        break
                    if len(found):
                        end = p + int(found[-1]) + 1
                        break
                    size *= 2
        yield p, end
        p = end


def words(arr: pa.Array, sep: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, with A-Z lower-cased; each word's last byte; words per text.

    Words are maximal runs of bytes outside sep. Equal words have equal hashes in every process. With prefixes the hashes are
    a matrix, which has a row more for each length, of the hash of each word's first bytes up to that length.
    """
    b, offsets = view(arr)
    hashes, last, counts = [], [], np.zeros(len(offsets) - 1, np.int64)
    for p, end in _cuts(b, offsets, sep):
        c = b[p:end]
        non = ~sep[c]
        lo, hi = np.searchsorted(offsets, p, "left"), np.searchsorted(offsets, end, "left")
        inner = offsets[lo:hi] - p
        inner = inner[inner < len(c)]
        start = non.copy()
        start[1:] &= ~non[:-1]
        start[inner] = non[inner]
        stop = non.copy()
        stop[:-1] &= ~non[1:]
        before = inner[inner > 0] - 1
        stop[before] = non[before]
        s, e = np.flatnonzero(start), np.flatnonzero(stop)
        if not len(s):
            continue
        up, down = powers(max(CHUNK, len(c)))
        total = np.cumsum(_BYTE[c] * up[: len(c)])
        h = total[e] - np.where(s > 0, total[s - 1], U64(0))
        h = [mix(h * down[s])]
        for k, length in enumerate(prefixes, 1):
            short = total[np.minimum(e, s + length - 1)] - np.where(s > 0, total[s - 1], U64(0))
            h.append(mix(short * down[s] + U64(k)))
        hashes.append(np.stack(h) if prefixes else h[0])
        last.append(LOWER[c[e]])
        first = np.searchsorted(offsets, p, "right") - 1
        row = np.searchsorted(offsets, s + p, "right") - 1
        counts[first : int(row[-1]) + 1] += np.bincount(row - first, minlength=int(row[-1]) + 1 - first)
    if not hashes:
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64), np.zeros(0, np.uint8), counts
    return np.concatenate(hashes, axis=-1), np.concatenate(last), counts


def shingle_sets(arr: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles; a shorter text's whole sequence is one."""
    h, _, counts = words(arr)
    ends = np.cumsum(counts)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    if n >= k:
        part = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            part = part * _K + h[j : n - k + 1 + j]
        rolled[: n - k + 1] = mix(part)
    out = []
    for c, e in zip(counts.tolist(), ends.tolist()):
        s = e - c
        if c >= k:
            out.append(np.unique(rolled[s : e - k + 1]))
        elif c:
            x = U64(c)
            with np.errstate(over="ignore"):
                for v in h[s:e]:
                    x = x * _K + v
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
