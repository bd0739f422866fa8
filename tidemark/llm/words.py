"""Words of whole Arrow text batches as 64-bit hashes, with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased first. The hash of a word sums its bytes
times a fixed random number for each place in the word, taken from prefix sums, and is mixed with its length. Equal words have
equal hashes everywhere; two given words share one with a probability of at most 2**-57 over the choice of the numbers, whatever
regularity they have, and some two of ten million with one of about 1e-3 at that worst (4e-6 where bytes differ by odd numbers).
Where a collision would matter the caller looks for one and takes the numbers of the next seed.
Work goes in segments of about 256 kilobytes, cut at white space, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_places: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _factors(seed: int, n: int) -> np.ndarray:
    """The random number of each of n places in a word."""
    have = _places.get(seed)
    if have is None or len(have) < n:
        at = np.arange(max(n, SEGMENT + 4096), dtype=np.uint64)
        have = _places[seed] = mix(mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1)) + _M1)
    return have[:n]


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each text in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def _segments(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts that no word crosses."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        if hi < n:
            text_end = int(offsets[np.searchsorted(offsets, hi, side="left")])
            step = 4096
            while hi < text_end:
                gap = np.flatnonzero(_SPACE[raw[hi : min(text_end, hi + step)]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(text_end, hi + step)
                step *= 2
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words in order, and for each text the number of words before it (and their total)."""
    starts, ends, hashes = [], [], []
    for lo, hi in _segments(raw, offsets):
        b = raw[lo:hi]
        n = hi - lo
        cuts = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
        solid = ~_SPACE[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        v = (_LOWER[b] if lower else b).astype(np.uint64)
        v += np.uint64(1)
        index = np.arange(n)
        v *= _factors(seed, n)[index - np.maximum.accumulate(np.where(first, index, 0))]
        np.cumsum(v, out=sums[1:])
        h = sums[e] - sums[s]
        h += (e - s).astype(np.uint64) * _M2
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h))
    empty = np.zeros(0, dtype=np.int64)
    s = np.concatenate(starts) if starts else empty
    e = np.concatenate(ends) if ends else empty
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return s, e, h, np.searchsorted(s, offsets, side="left")


def text_groups(raw: np.ndarray, offsets: np.ndarray, most: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
