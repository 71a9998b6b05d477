"""Media columns in FLAC: encoder, decoder, seekable PCM blocks.

Streams are plain FLAC (RFC 9639): STREAMINFO with MD5, a seek table, frames with constant, verbatim,
fixed-predictor or LPC subframes and Rice-coded residuals. Decoding finds frames by sync code and
header CRC-8, verifies each frame's CRC-16, decodes the residuals of many frames side by side, undoes
the predictors and checks the MD5. Frames are cut by samples, so a document of any length takes bounded
memory beyond its own bytes.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal bytes; repeated rows
give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import CRC8, BitWindows, crc16_ranges, scatter_bits
from .common import documents, lean, materialize, slices

BLOCK = 512
RATE = 8000
SEEK_EVERY = 16  # frames
PAD = 64
#: Samples that are encoded, or frames that are decoded, at once.
SAMPLES_AT_ONCE, FRAMES_AT_ONCE = 1 << 20, 2048
LPC_BITS, LPC_SHIFT = 8, 6
#: Sample rates and sample sizes of the header codes, and the fixed predictors (RFC 9639).
RATE_EXTRA = {12: 1, 13: 2, 14: 2}
SAMPLE_BITS = (0, 8, 12, -1, 16, 20, 24, 32)
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CONSTANT, VERBATIM = 100, 101
LEADING_ZEROS = np.array([16, *(16 - int(i).bit_length() for i in range(1, 1 << 16))], np.uint8)


class FlacError(ValueError):
    pass


def _number_bytes(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code of up to 36 bits: bytes (rows of 7) and how many count."""
    n = number.astype(np.int64)
    if len(n) and int(n.max()) >> 36:
        raise FlacError("a stream has 2 ** 36 frames at most")
    size = 1 + (n >= 1 << 7) + sum((n >= 1 << bits).astype(np.int64) for bits in (11, 16, 21, 26, 31))
    out = np.zeros((len(n), 7), np.int64)
    for width in np.unique(size).tolist():
        rows = size == width
        if width == 1:
            out[rows, 0] = n[rows]
            continue
        out[rows, 0] = (0xFF << (8 - width) & 0xFF) | n[rows] >> 6 * (width - 1)
        for k in range(1, width):
            out[rows, k] = 0x80 | n[rows] >> 6 * (width - 1 - k) & 0x3F
    return out, size


def _frames(samples: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodes the frames samples[start:start+size] (8-bit, mono): all bytes, and the bytes of each frame."""
    x = samples.astype(np.int32)
    frames, total = len(start), len(x)
    spread = lambda of_frame: np.repeat(of_frame, size)  # noqa: E731  a frame's value for each of its samples
    inside = np.arange(total, dtype=np.int32) - spread(start.astype(np.int32))
    zigzag = lambda r: (r << 1) ^ (r >> 31)

    back1 = np.concatenate([[0], x[:-1]]).astype(np.int32)
    back2 = np.concatenate([[0, 0], x[:-2]])[:total].astype(np.int32)
    fx = x.astype(np.float32)
    r0 = np.add.reduceat(fx * fx, start) + 1
    r1 = np.add.reduceat(np.where(inside >= 1, fx * back1, 0), start)
    r2 = np.add.reduceat(np.where(inside >= 2, fx * back2, 0), start)
    det = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    bound = (1 << LPC_BITS - 1) - 1
    c1 = np.clip(np.rint((r1 * (r0 - r2) / det) * (1 << LPC_SHIFT)), -bound, bound).astype(np.int32)
    c2 = np.clip(np.rint((r0 * r2 - r1 * r1) / det * (1 << LPC_SHIFT)), -bound, bound).astype(np.int32)

    candidates = [(0, zigzag(x)), (1, zigzag(x - back1)), (2, zigzag(x - 2 * back1 + back2)), (2, zigzag(x - ((spread(c1) * back1 + spread(c2) * back2) >> LPC_SHIFT)))]
    cost, param = [], []
    for which, (order, u) in enumerate(candidates):
        u[inside < order] = 0
        sums = np.add.reduceat(u, start).astype(np.int64)
        n = np.maximum(size - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(sums / n * 0.69, 1))), 0, 14).astype(np.int64)
        cost.append(n * (k + 1) + (sums >> k) + 8 * order + 10 + (9 + 2 * LPC_BITS) * (which == 3))
        param.append(k)
    cost.append(8 * size)
    flat = np.maximum.reduceat(x, start) == np.minimum.reduceat(x, start)
    cost.append(np.where(flat, 8, 1 << 40))
    best = np.argmin(np.stack(cost), axis=0)
    kind_bits = np.array([0b001000, 0b001001, 0b001010, 0b100001, 0b000001, 0b000000])[best]
    order = np.array([0, 1, 2, 2, 0, 0])[best]
    coded = best < 4
    k = np.where(coded, np.take_along_axis(np.stack(param), np.minimum(best, 3)[None], 0)[0], 0)

    u = candidates[0][1]
    of = spread(best.astype(np.int8))
    for which in (1, 2, 3):
        u = np.where(of == which, candidates[which][1], u)
    kk = spread(k.astype(np.int32))
    is_code = spread(coded) & (inside >= spread(order.astype(np.int32)))
    span = np.where(is_code, (u >> kk) + 1 + kk, np.where((of == 5) & (inside > 0), 0, 8))
    width = np.where(is_code, kk + 1, np.minimum(span, 8))
    value = np.where(is_code, 1 << kk | u & (1 << kk) - 1, np.where(span > 0, x & 255, 0))

    numbers, n_number = _number_bytes(number)
    longest = int(n_number.max(initial=1))
    header = np.zeros((frames, 6 + longest), np.int64)
    code = np.where(size == BLOCK, 8 + int(np.log2(BLOCK // 256)), np.where(size <= 256, 6, 7))
    header[:, 0], header[:, 1], header[:, 2], header[:, 3] = 0xFF, 0xF8, code << 4 | 4, 0x02
    at, rows = np.full(frames, 4), np.arange(frames)
    for j in range(longest):
        use = n_number > j
        header[rows[use], at[use]] = numbers[use, j]
        at += use
    for use, shift in ((code == 7, 8), ((code == 6) | (code == 7), 0)):
        header[rows[use], at[use]] = (size[use] - 1) >> shift & 255
        at += use
    crc = np.zeros(frames, np.uint8)
    for j in range(6 + longest):
        crc = np.where(j < at, CRC8[crc ^ header[:, j].astype(np.uint8)], crc)

    extra = np.where(coded, 10 + np.where(best == 3, 9 + 2 * LPC_BITS, 0), 0)
    body = np.add.reduceat(span, start)
    n_bytes = at + 1 + -(-(8 + body + extra) // 8) + 2
    stop = np.cumsum(n_bytes)
    first = stop - n_bytes
    out = np.zeros(int(stop[-1]), np.uint8)
    for j in range(6 + longest):
        use = at > j
        out[first[use] + j] = header[use, j]
    out[first + at] = crc
    sub = (first + at + 1) * 8
    done = np.cumsum(span) - span
    offset = sub + 8 - done[start]
    place = spread(offset) + done + np.where(is_code, spread(extra), 0) + span - width
    write = slice(None) if width.all() else width > 0
    scatter_bits(out, place[write], width[write], value[write])
    scatter_bits(out, sub, np.full(frames, 8), kind_bits << 1)
    after = sub + 8 + 8 * order
    lpc = best == 3
    for bits, v in ((4, np.full(frames, LPC_BITS - 1)), (5, np.full(frames, LPC_SHIFT)), (LPC_BITS, c1 & 255), (LPC_BITS, c2 & 255)):
        scatter_bits(out, after[lpc], np.full(int(lpc.sum()), bits), v[lpc])
        after = after + bits * lpc
    scatter_bits(out, after[coded] + 6, np.full(int(coded.sum()), 4), k[coded])
    check = crc16_ranges(out, first, stop - 2)
    out[stop - 2], out[stop - 1] = check >> 8, check & 255
    return out, n_bytes


def encode_streams(payloads: Sequence[bytes]) -> list[bytes]:
    """A FLAC stream of each byte string: one 8-bit sample per byte, byte - 128."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    signed = (joined.astype(np.int16) - 128).astype(np.int8)
    lens = np.array([len(p) for p in payloads], np.int64)
    per = -(-lens // BLOCK)
    doc_of = np.repeat(np.arange(len(lens)), per)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    ends = np.cumsum(lens)
    start = (ends - lens)[doc_of] + number * BLOCK
    size = np.minimum(BLOCK, ends[doc_of] - start)
    chunks, sizes = [], []
    step = SAMPLES_AT_ONCE // BLOCK
    for a in range(0, len(start), step):
        b = min(a + step, len(start))
        data, n = _frames(signed[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], size[a:b], number[a:b])
        chunks.append(data)
        sizes.append(n)
    frames = np.concatenate(chunks).tobytes() if chunks else b""
    frame_size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    frame_at = np.concatenate([[0], np.cumsum(frame_size)])
    first = np.concatenate([[0], np.cumsum(per)])
    out = []
    for d in range(len(lens)):
        a, b = int(first[d]), int(first[d + 1])
        points = b"".join(
            (int(number[f]) * BLOCK).to_bytes(8, "big") + int(frame_at[f] - frame_at[a]).to_bytes(8, "big") + int(size[f]).to_bytes(2, "big") for f in range(a, b, SEEK_EVERY)
        )
        low = max(16, min(BLOCK, int(lens[d])))
        packed = RATE << 44 | 0 << 41 | 7 << 36 | int(lens[d])
        info = low.to_bytes(2, "big") + low.to_bytes(2, "big") + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(signed[ends[d] - lens[d] : ends[d]].tobytes()).digest()
        meta = b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(meta + frames[frame_at[a] : frame_at[b]])
    return out


@dataclass
class Stream:
    """A decoded stream: samples (frames x channels), where each frame begins in samples and in bytes after the metadata."""

    samples: np.ndarray
    sample_bits: int
    frame_sample: np.ndarray
    frame_byte: np.ndarray


def _metadata(stream: bytes) -> tuple[int, int, int, int, bytes]:
    """Where frames begin, channels, bits, samples in all (0: unknown), MD5."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info = 4, None
    while True:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut short")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if last:
            break
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    return at, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34]


def _headers(data: np.ndarray) -> dict[str, np.ndarray]:
    """All places in ``data`` where a frame header with the right CRC-8 stands."""
    padded = np.concatenate([data, np.zeros(20, np.uint8)]).astype(np.int64)
    at = np.flatnonzero((data[:-1] == 0xFF) & ((data[1:] & 0xFE) == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    block, rate = padded[at + 2] >> 4, padded[at + 2] & 15
    channel, bits = padded[at + 3] >> 4, padded[at + 3] >> 1 & 7
    lead = padded[at + 4]
    width = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead == 0xFE], [1, 0, 2, 3, 4, 5, 6, 7], 0)
    good = (block > 0) & (rate < 15) & (channel < 11) & (bits != 3) & (padded[at + 3] & 1 == 0) & (width > 0)
    at, block, rate, channel, bits, width, lead = (v[good] for v in (at, block, rate, channel, bits, width, lead))
    number = np.where(width == 1, lead, lead & np.maximum((1 << np.maximum(7 - width, 0)) - 1, 0))
    for k in range(1, 7):
        number = np.where(k < width, number << 6 | padded[at + 4 + k] & 0x3F, number)
    p = at + 4 + width
    size = np.select([block == 1, block <= 5, block == 6, block == 7], [192, 576 << np.maximum(block - 2, 0), padded[p] + 1, (padded[p] << 8 | padded[p + 1]) + 1], 256 << np.maximum(block - 8, 0))
    p = p + (block == 6) + 2 * (block == 7) + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    crc = np.zeros(len(at), np.uint8)
    for j in range(int((p - at).max(initial=0))):
        crc = np.where(at + j < p, CRC8[crc ^ data[np.minimum(at + j, len(data) - 1)]], crc)
    good = (crc == padded[p]) & (p < len(data))
    found = {"at": at, "number": number, "size": size, "body": p + 1, "channel": channel, "bits": np.array(SAMPLE_BITS)[bits], "variable": data[at + 1] & 1}
    return {k: v[good] for k, v in found.items()}


def _chain(data: np.ndarray, found: dict[str, np.ndarray], rows: np.ndarray, stop: int) -> list[int]:
    """The rows among ``rows`` that are frames: numbers follow on and each stretch has the right CRC-16."""
    kept, samples, begin = [], 0, 0
    for i, row in enumerate(rows):
        if i < begin or found["number"][row] != (samples if found["variable"][row] else len(kept)):
            continue
        for j in range(i + 1, len(rows) + 1):
            end = int(found["at"][rows[j]]) if j < len(rows) else stop
            a = found["at"][row]
            if crc16_ranges(data, np.array([a]), np.array([end - 2]))[0] == int(data[end - 2]) << 8 | int(data[end - 1]):
                kept.append(int(row))
                samples, begin = samples + int(found["size"][row]), j
                break
        else:
            raise FlacError("a frame checksum is wrong")
    return kept


def _residuals(win: BitWindows, at: np.ndarray, size: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice residuals of many subframes side by side: a row per step, a column per subframe; and the next bit offsets."""
    method, parts = win.read(at, 2), win.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    at = at + 6
    by = np.argsort(-size, kind="stable")
    at, size, per, bits = at[by], size[by], (size >> parts)[by], (4 + method)[by]
    n = size - order
    steps = int(n.max(initial=0))
    out = np.zeros((steps, len(at)), np.int64 if (bits == 5).any() else np.int32)
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    turn = np.zeros(len(at), np.int64)  # the step at which a subframe's next partition begins
    due_size = per - order
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    for i, a in enumerate(active.tolist()):
        while len(due := np.flatnonzero(turn[:a] == i)):
            k[due] = win.read(at[due], bits[due])
            at[due] += bits[due]
            escaped = due[k[due] == (1 << bits[due]) - 1]
            raw[due] = -1
            raw[escaped] = win.read(at[escaped], 5)
            at[escaped] += 5
            k[escaped] = 0
            turn[due] += due_size[due]  # 0 if the first partition held the warm-up samples alone
            due_size[due] = per[due]
        p = at[:a]
        w = win.top(p)
        q = LEADING_ZEROS[w >> np.uint32(16)].astype(np.int64)
        ka = k[:a]
        rest = ((w << (q + 1).astype(np.uint32)) >> np.uint32(1)) >> (31 - ka).astype(np.uint32)
        u = q << ka | rest
        used = q + 1 + ka
        if used.max() > 25 or q.max() > 15:
            for c in np.flatnonzero((used > 25) | (q > 15)):
                place, zeros = int(p[c]), 0
                while not win.read(np.array([place + zeros]), 1)[0]:
                    zeros += 1
                low = int(win.read(np.array([place + zeros + 1]), int(ka[c]))[0]) if ka[c] else 0
                u[c], used[c] = zeros << int(ka[c]) | low, zeros + 1 + int(ka[c])
        r = (u >> 1) ^ -(u & 1)
        if (raw[:a] >= 0).any():
            rows = np.flatnonzero(raw[:a] >= 0)
            r[rows], used[rows] = np.where(raw[rows] > 0, win.signed(p[rows], raw[rows]), 0), raw[rows]
        out[i, :a] = r
        at[:a] = p + used
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return out[:, back], at[back]


def _subframes(win: BitWindows, at: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of each frame: samples (a column per frame, rows beyond its size undefined) and the next bit offsets."""
    kind, wasted = win.read(at + 1, 6), win.read(at + 7, 1)
    at = at + 8
    waste = np.zeros(len(at), np.int64)
    for c in np.flatnonzero(wasted):
        zeros = 0
        while not win.read(at[c : c + 1] + zeros, 1)[0]:
            zeros += 1
        waste[c], at[c] = zeros + 1, at[c] + zeros + 1
    bits = bits - waste
    out = np.zeros((int(size.max()), len(at)), np.int64 if bits.max() > 12 else np.int32)
    group = np.select([kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32], [CONSTANT, VERBATIM, kind, kind], -1)
    if (group < 0).any():
        raise FlacError("reserved subframe type")
    at = at.copy()
    for g in np.unique(group):
        c = np.flatnonzero(group == g)
        if g == CONSTANT:
            out[:, c] = win.signed(at[c], bits[c])
            at[c] += bits[c]
            continue
        order = int(size[c].max()) if g == VERBATIM else int(g - 8 if g < 32 else g - 31)
        for i in range(order):
            use = c[size[c] > i]
            out[i, use] = win.signed(at[use], bits[use])
            at[use] += bits[use]
        if g == VERBATIM:
            continue
        if g >= 32:
            precision, shift = win.read(at[c], 4) + 1, win.signed(at[c] + 4, 5)
            at[c] += 9
            coefficient = []
            for _ in range(order):
                coefficient.append(win.signed(at[c], precision))
                at[c] += precision
        r, at[c] = _residuals(win, at[c], size[c], order)
        x = np.zeros((order + len(r), len(c)), out.dtype)
        x[:order] = out[:order, c]
        x[order:] = r
        if g < 32:
            history = x[:order].copy()
            for level in range(order, 0, -1):
                seed = np.diff(history, n=level - 1, axis=0)[-1] if order else 0
                x[order - 1] = seed
                x[order - 1 :] = np.cumsum(x[order - 1 :], axis=0)
            x[:order] = history
        else:
            shift = np.maximum(shift, 0).astype(x.dtype)
            coefficient = [v.astype(x.dtype) for v in coefficient]
            for i in range(order, len(x)):
                total = coefficient[0] * x[i - 1]
                for j in range(1, order):
                    total += coefficient[j] * x[i - 1 - j]
                x[i] += total >> shift
        out[: len(x), c] = x
    return out << waste.astype(out.dtype), at


def _frame_samples(data: np.ndarray, frames: dict[str, np.ndarray], stop: np.ndarray) -> Iterator[np.ndarray]:
    """Samples (size x channels) of each frame, after its CRC-16."""
    expected = data[stop - 2].astype(np.uint16) << 8 | data[stop - 1]
    if not np.array_equal(crc16_ranges(data, frames["at"], stop - 2), expected):
        raise FlacError("a frame checksum is wrong")
    win = BitWindows(data)
    at, size, mode = frames["body"] * 8, frames["size"], frames["channel"]
    channels = np.where(mode < 8, mode + 1, 2)
    found: list[np.ndarray] = []
    for c in range(int(channels.max())):
        use = np.flatnonzero(channels > c)
        side = ((mode[use] == 8) & (c == 1)) | ((mode[use] == 9) & (c == 0)) | ((mode[use] == 10) & (c == 1))
        x, at[use] = _subframes(win, at[use], size[use], frames["bits"][use] + side)
        whole = np.zeros((len(x), len(at)), x.dtype)
        whole[:, use] = x
        found.append(whole)
    if (-(-at // 8) + 2 != stop).any():
        raise FlacError("a frame does not end where the next begins")
    for i, n in enumerate(size.tolist()):
        own = [found[c][:n, i] for c in range(channels[i])]
        if mode[i] == 8:
            own[1] = own[0] - own[1]
        elif mode[i] == 9:
            own[0] = own[0] + own[1]
        elif mode[i] == 10:
            middle = own[0] << 1 | own[1] & 1
            own = [(middle + own[1]) >> 1, (middle - own[1]) >> 1]
        yield np.stack(own, axis=1)


def decode_streams(streams: Sequence[bytes]) -> list[Stream]:
    """Decodes FLAC streams together; raises FlacError where a checksum does not hold."""
    meta = [_metadata(s) for s in streams]
    data = np.frombuffer(b"".join(memoryview(s)[m[0] :] for s, m in zip(streams, meta, strict=True)), np.uint8)
    lens = np.array([len(s) - m[0] for s, m in zip(streams, meta, strict=True)], np.int64)
    ends = np.cumsum(lens)
    found = _headers(data)
    doc = np.searchsorted(ends, found["at"], side="right")
    cuts = np.searchsorted(doc, np.arange(len(lens) + 1))
    rank = np.arange(len(doc)) - cuts[doc]
    before = np.concatenate([[0], np.cumsum(found["size"])])
    expected = np.where(found["variable"] == 1, before[:-1] - before[cuts[doc]], rank)
    odd = np.unique(doc[found["number"] != expected])
    if len(odd):
        keep = np.ones(len(doc), bool)
        for d in odd.tolist():
            rows = np.arange(cuts[d], cuts[d + 1])
            keep[rows] = np.isin(rows, _chain(data, found, rows, int(ends[d])))
        found = {k: v[keep] for k, v in found.items()}
        doc = doc[keep]
        cuts = np.searchsorted(doc, np.arange(len(lens) + 1))
    bits = np.array([m[2] for m in meta])
    found["bits"] = np.where(found["bits"] == 0, bits[doc], found["bits"])
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    stop = np.where(last, ends[doc], np.concatenate([found["at"][1:], [0]])) if len(doc) else np.zeros(0, np.int64)
    pieces: list[np.ndarray] = []
    for a in range(0, len(doc), FRAMES_AT_ONCE):
        b = min(a + FRAMES_AT_ONCE, len(doc))
        low = int(found["at"][a])
        some = {k: v[a:b] - low if k in ("at", "body") else v[a:b] for k, v in found.items()}
        pieces += _frame_samples(data[low : int(stop[b - 1])], some, stop[a:b] - low)
    out = []
    for d, (_, channels, width, total, md5) in enumerate(meta):
        own = pieces[cuts[d] : cuts[d + 1]]
        samples = np.concatenate(own) if own else np.zeros((0, channels), np.int32)
        if total and len(samples) != total:
            raise FlacError("samples are missing")
        size = -(-width // 8)
        raw = samples.astype(np.int8).tobytes() if size == 1 else samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        if any(md5) and hashlib.md5(raw).digest() != md5:
            raise FlacError("the MD5 of the samples is wrong")
        n = found["size"][cuts[d] : cuts[d + 1]]
        out.append(Stream(samples, width, np.cumsum(n) - n, found["at"][cuts[d] : cuts[d + 1]] - (ends[d] - lens[d])))
    return out


def payload_of(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream) of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SAMPLES_AT_ONCE):
                texts = part.column(1).to_pylist()
                n = [len((t or "").encode()) for t in texts]
                media = encode_streams([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encode), "doc_id long, n_bytes long, media binary")


BLOCKS = pa.list_(pa.struct([("block", pa.int32()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("byte_offset", pa.int64()), ("frames", pa.int32()), ("pcm", pa.binary())]))


def pcm_column(media: DataFrame, frames_per_block: int = SEEK_EVERY) -> DataFrame:
    """All columns of ``media`` but media, and blocks: the PCM of each stream, checked, in blocks that can be sought.

    A block has block (its number), sample_offset, n_samples, byte_offset (where its first frame begins after the
    metadata), frames, and pcm: signed, little-endian, channels interleaved. A null stream has no blocks.
    """
    rest = [c for c in media.columns if c != "media"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(rest), SAMPLES_AT_ONCE):
                streams = part.column(len(rest)).to_pylist()
                found = iter(decode_streams([m for m in streams if m is not None]))
                columns: list[list] = [[] for _ in BLOCKS.value_type]
                ends = [0]
                for m in streams:
                    if m is not None:
                        s = next(found)
                        kind = np.int8 if s.sample_bits <= 8 else "<i2" if s.sample_bits <= 16 else "<i4"
                        samples, frames = s.samples.astype(kind), len(s.frame_sample)
                        for block, f in enumerate(range(0, frames, frames_per_block)):
                            last = f + frames_per_block >= frames
                            a, b = int(s.frame_sample[f]), len(samples) if last else int(s.frame_sample[f + frames_per_block])
                            for c, v in zip(columns, (block, a, b - a, int(s.frame_byte[f]), min(frames_per_block, frames - f), samples[a:b].tobytes()), strict=True):
                                c.append(v)
                    ends.append(len(columns[0]))
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCKS.value_type, strict=True)], fields=list(BLOCKS.value_type))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], [*rest, "blocks"])

    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest)
    blocks = "array<struct<block:int,sample_offset:bigint,n_samples:bigint,byte_offset:bigint,frames:int,pcm:binary>>"
    return media.select(*rest, "media").mapInArrow(lean(decode), f"{fields}, blocks {blocks}")


def pcm_blocks(media: DataFrame, frames_per_block: int = SEEK_EVERY) -> DataFrame:
    """The blocks of (doc_id, media) as rows: doc_id, block, sample_offset, n_samples, byte_offset, frames, pcm."""
    return pcm_column(media.select("doc_id", "media"), frames_per_block).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def feature_of(samples: np.ndarray, frames: int) -> str:
    """Frames, loudness, zero crossings and peak of decoded samples."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={frames};rms={np.sqrt(float(x @ x) / max(1, len(x))):.4f};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def described(pcm: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of rows with 8-bit mono blocks."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(4)
                held = lists.flatten()
                offset, n, frames = (held.field(k).to_numpy() for k in ("sample_offset", "n_samples", "frames"))
                pcm_of = held.field("pcm").to_pylist()
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                columns: list[list] = [[], [], [], []]
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if not np.array_equal(offset[i:j], np.cumsum(n[i:j]) - n[i:j]):
                        raise FlacError("PCM blocks do not follow on")
                    samples = np.frombuffer(b"".join(pcm_of[i:j]), np.int8)
                    payload = (samples.astype(np.int16) + 128).astype(np.uint8).tobytes()
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), feature_of(samples, int(frames[i:j].sum())))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                size, sha, crc, feature = (pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, sha, crc, part.column(2), part.column(3), feature], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(lean(read_back), schema)


def flac_media(docs: DataFrame) -> DataFrame:
    """Codes every text as FLAC, writes the PCM blocks decoded from the streams, and describes what is read back from those.

    The streams themselves are not kept: of 8-bit text they are as large as the text, and the blocks, which zstd
    compresses, hold the same samples.
    """
    media = media_column(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return described(materialize(pcm_column(media), "flac-pcm", compression="zstd"))


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_flac_media": op1_flac_media}
