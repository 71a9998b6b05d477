"""Bit strings in numpy: scattered writes, and checksums of many byte ranges side by side."""

from __future__ import annotations

import numpy as np


def scatter_bits(out: np.ndarray, at: np.ndarray, size: np.ndarray, value: np.ndarray) -> None:
    """Writes ``value``, ``size`` bits each (17 at most), at bit offsets ``at`` of zeroed bytes ``out``."""
    window = value.astype(np.int64) << (24 - (at & 7) - size)
    first = at >> 3
    for k in range(3):
        part = np.bincount(first, weights=(window >> (16 - 8 * k)) & 255)
        part = part[: len(out) - k].astype(np.uint8)
        out[k : k + len(part)] += part


def crc_table(poly: int, width: int, index_bits: int) -> np.ndarray:
    """Remainders of all ``index_bits``-bit values followed by ``width`` zero bits (width <= index_bits)."""
    mask, reg = (1 << width) - 1, np.arange(1 << index_bits, dtype=np.uint32)
    top = 1 << (index_bits - 1)
    shifted = poly << (index_bits - width)
    for _ in range(index_bits):
        reg = np.where(reg & top, (reg << 1) ^ shifted, reg << 1) & ((1 << index_bits) - 1)
    return (reg >> (index_bits - width) & mask).astype(np.uint16 if width > 8 else np.uint8)


CRC8 = crc_table(0x07, 8, 8)
CRC16 = crc_table(0x8005, 16, 16)


def crc16_ranges(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, initial 0) of each data[begin:stop], two bytes at a step for all ranges at once."""
    size = stop - begin
    odd = size & 1
    by = np.argsort(-(size >> 1), kind="stable")
    at, words = (begin + odd)[by], (size >> 1)[by]
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint16)
    pairs = padded[:-1] << 8 | padded[1:]
    crc = np.where(odd[by] == 1, CRC16[padded[begin[by]]], 0).astype(np.uint16)
    active = np.searchsorted(-words, -np.arange(int(words.max(initial=0))), side="left")
    for step, n in enumerate(active.tolist()):
        crc[:n] = CRC16[crc[:n] ^ pairs[at[:n] + 2 * step]]
    out = np.empty_like(crc)
    out[by] = crc
    return out


class BitWindows:
    """Reads of up to 25 bits at many bit offsets of one byte string."""

    def __init__(self, data: np.ndarray) -> None:
        raw = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]

    def top(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each offset on, of which the first 25 are valid."""
        return self.word[np.minimum(at >> 3, len(self.word) - 1)] << (at & 7).astype(np.uint32)

    def read(self, at: np.ndarray, size) -> np.ndarray:
        size = np.asarray(size, np.uint32)
        return ((self.top(at) >> np.uint32(1)) >> (np.uint32(31) - size)).astype(np.int64)

    def signed(self, at: np.ndarray, size) -> np.ndarray:
        size = np.asarray(size, np.int64)
        value = self.read(at, size)
        return value - ((value >> np.maximum(size - 1, 0)) & 1) * (np.int64(1) << size)
