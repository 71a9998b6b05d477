"""Sets of hashed word shingles of whole texts, vectorized over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(2024)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(1, 1 << 62)) * 2 + 1)
_PLACE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[9:14] = _GAP[32] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (null: none), A-Z in lower case, and the words of each text."""
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    data, gap = _LOWER[raw], _GAP[raw]
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    first = np.flatnonzero(~gap & (edge | np.concatenate([[True], gap[:-1]])))
    last = np.flatnonzero(~gap & np.concatenate([gap[1:] | edge[1:], [True]])) + 1
    size = last - first
    inside = np.flatnonzero(~gap)
    begin = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(begin, size)
    power = np.full(int(size.max(initial=1)), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    words = mix(np.add.reduceat(_LETTER[data[inside]] * power[place], begin)) if len(size) else np.zeros(0, np.uint64)
    return words, np.diff(np.searchsorted(first, offsets))


#: Bytes of text that are hashed at once; a working set of about 60 times as many.
BYTES_AT_ONCE = 1 << 19


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // BYTES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) for s in _sets(texts.slice(a, b - a), width)]


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, n = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    out, at = [], 0
    for count in n.tolist():
        if count >= width:
            own = np.sort(rolled[at : at + count - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif count:
            out.append(mix((words[at : at + count] * _PLACE[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(rolled[:0])
        at += count
    return out
