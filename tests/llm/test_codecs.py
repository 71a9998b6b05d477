import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amalgam.llm import bits, flac, huffman
from amalgam.llm.tokens import ChunkEncoder


def crc(data, poly, width):
    reg = 0
    for b in data:
        reg ^= b << (width - 8)
        for _ in range(8):
            reg = ((reg << 1) ^ poly if reg >> (width - 1) else reg << 1) & ((1 << width) - 1)
    return reg


def test_crc16():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    begin, stop = np.array([0, 3, 10, 77]), np.array([7, 3, 400, 500])
    assert bits.crc16_ranges(data, begin, stop).tolist() == [crc(data[a:b].tolist(), 0x8005, 16) for a, b in zip(begin, stop)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=1500), st.binary(min_size=1, max_size=3).map(lambda b: b * 700)), min_size=1, max_size=4))
def test_flac_round_trip(payloads):
    for p, s in zip(payloads, flac.decode_streams(flac.encode_streams(payloads)), strict=True):
        assert (s.samples[:, 0] + 128).astype(np.uint8).tobytes() == p
        assert s.frame_sample.tolist() == list(range(0, len(p), flac.BLOCK))


def test_flac_finds_damage():
    stream = bytearray(flac.encode_streams([b"some text that is long enough " * 60])[0])
    stream[-100] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(stream)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([b"RIFF"])


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def rice(self, r, k):
        u = r << 1 if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8)).tobytes()


def test_flac_stereo_partitions_and_escape():
    """A 16-bit stream made by hand: mid and side, order 3 LPC with wasted bits in one, two partitions, one escaped."""
    rng = np.random.default_rng(3)
    left = np.cumsum(rng.integers(-30, 31, 64)).astype(np.int64)
    right = left + rng.integers(-3, 4, 64)
    mid, side = (left + right) >> 1, left - right
    w = Writer()
    w.put(0x3FFE, 14), w.put(0, 2), w.put(6, 4), w.put(9, 4), w.put(10, 4), w.put(4, 3), w.put(0, 1), w.put(0, 8), w.put(63, 8)
    w.put(crc(w.bytes(), 0x07, 8), 8)
    w.put(0, 1), w.put(32 + 2, 6), w.put(0, 1)
    for v in mid[:3]:
        w.put(int(v) & 0xFFFF, 16)
    coefficient, shift = (20, -7, 3), 4
    w.put(7, 4), w.put(shift, 5)
    for c in coefficient:
        w.put(c & 255, 8)
    res = [int(mid[i]) - (sum(c * int(mid[i - 1 - j]) for j, c in enumerate(coefficient)) >> shift) for i in range(3, 64)]
    w.put(0, 2), w.put(1, 4), w.put(6, 4)
    for r in res[:29]:
        w.rice(r, 6)
    w.put(15, 4), w.put(12, 5)
    for r in res[29:]:
        w.put(r & 0xFFF, 12)
    w.put(0, 1), w.put(8 + 1, 6), w.put(0, 1), w.put(int(side[0]) & 0x1FFFF, 17)
    w.put(1, 2), w.put(0, 4), w.put(2, 5)
    for r in np.diff(side):
        w.rice(int(r), 2)
    frame = w.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | 64).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    s = flac.decode_streams([b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame])[0]
    assert np.array_equal(s.samples, np.stack([left, right], 1))


@pytest.mark.parametrize("number", [0, 127, 128, 2**11, 2**16 - 1, 2**16, 2**21 - 1, 2**21, 2**26, 2**31, 2**36 - 1])
def test_frame_numbers(number):
    raw, size = flac._number_bytes(np.array([number]))
    own = raw[0, : size[0]].tolist()
    lead = own[0]
    ones = 8 - (~lead & 0xFF).bit_length()
    got = lead if ones == 0 else lead & ((1 << max(0, 7 - ones)) - 1)
    for b in own[1:]:
        assert b >> 6 == 2
        got = got << 6 | b & 63
    assert got == number and (ones or 1) == size[0]
    with pytest.raises(flac.FlacError):
        flac._number_bytes(np.array([2**36]))


def test_op1_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (5, "é" * 5000), (5, "é" * 5000), (None, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    media = flac.media_column(docs)
    for r in media.collect():
        s = flac.decode_streams([bytes(r.media)])[0]
        text = dict(rows).get(r.doc_id)
        assert (s.samples[:, 0] + 128).astype(np.uint8).tobytes() == flac.payload_of(text) and r.n_bytes == len((text or "").encode())
    blocks = flac.pcm_blocks(media, 4).where("doc_id = 5").dropDuplicates(["block"]).orderBy("block").collect()
    whole = np.frombuffer(flac.payload_of("é" * 5000), np.uint8)
    for b in blocks:
        assert np.array_equal(np.frombuffer(b.pcm, np.int8).astype(int) + 128, whole[b.sample_offset : b.sample_offset + b.n_samples])
    assert sum(b.n_samples for b in blocks) == len(whole) and sum(b.frames for b in blocks) == -(-len(whole) // flac.BLOCK)
    got = flac.flac_media(docs).collect()
    assert len(got) == len(rows) and len({tuple(r)[1:] for r in got}) == 4  # equal texts, equal values
    for r in got:
        text = dict(rows).get(r.doc_id)
        payload = flac.payload_of(text)
        stored = flac.encode_streams([payload])[0]
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        feature = f"frames={-(-len(x) // flac.BLOCK)};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};peak={abs(x).max()}"
        assert tuple(r)[1:] == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
    assert flac.media_column(docs.limit(0)).count() == 0 and flac.flac_media(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.pcm_blocks(null).count() == 0 and flac.pcm_column(null).first().blocks == []


def brute_lengths(counts, limit):
    """Package-merge with explicit sets."""
    leaves = sorted((c, (i,)) for i, c in enumerate(counts))
    row = leaves
    for _ in range(limit - 1):
        row = sorted(leaves + [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)])
    out = [0] * len(counts)
    for _, symbols in row[: 2 * len(counts) - 2]:
        for s in symbols:
            out[s] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=14), st.integers(4, 8))
def test_length_limited_codes(counts, limit):
    got = huffman.code_lengths(np.array(counts), limit)
    want = brute_lengths(counts, limit)
    assert max(got) <= limit and sum(2.0 ** -int(x) for x in got) <= 1
    assert sum(c * int(x) for c, x in zip(counts, got)) == sum(c * x for c, x in zip(counts, want))
    codes = huffman.canonical_codes(got)
    words = sorted(format(int(c), f"0{int(n)}b") for c, n in zip(codes, got))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_code_round_trip():
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 256, 257, 3000])
    ids = np.minimum(rng.geometric(0.01, int(n.sum())), 900).astype(np.uint32)
    counts = np.bincount(ids, minlength=901)
    lengths = np.zeros(901, np.uint8)
    lengths[counts > 0] = huffman.code_lengths(counts[counts > 0])
    data, n_bytes, at = huffman.encode_ids(ids, n, huffman.canonical_codes(lengths), lengths)
    start, stop, size = [], [], []
    for e, c in zip(np.cumsum(n).tolist(), n.tolist()):
        for a in range(e - c, e, huffman.STRIDE):
            b = min(a + huffman.STRIDE, e)
            start.append(at[a]), stop.append(at[b - 1] + lengths[ids[b - 1]]), size.append(b - a)
    got = huffman.decode_ids(data.tobytes(), np.array(start), np.array(stop), np.array(size), huffman.decoding_table(lengths))
    assert np.array_equal(got, ids) and len(n_bytes) == 5
    with pytest.raises(ValueError):
        huffman.decode_ids(data.tobytes(), np.array(start), np.array(stop) + 1, np.array(size), huffman.decoding_table(lengths))


TEXTS = ["Don't STOP <|ENDOFTEXT|> <|endoftext|>x ΑΣ.Α ΑΣ, É́a,b..c d1e2 ½x İ.", "áb ,́x  z", None, "", " \t\n", "ＡＢ c d", "it's we'll I'M '", "日本語、テスト。", "a" * 300]


def test_chunks_equal_whole_texts():
    e = ChunkEncoder(huffman.TOKENIZER)
    ids, n = e.encode(pa.array(TEXTS, pa.string()))
    ends = np.cumsum(n)
    for t, a, b in zip(TEXTS, ends - n, ends):
        assert ids[a:b].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_chunks_equal_any_text(text):
    e = _shared()
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


_held = []


def _shared():
    if not _held:
        _held.append(ChunkEncoder(huffman.TOKENIZER))
    return _held[0]


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    from amalgam.llm.tokens import tokenizer_path

    texts = ["A  b\nc", " x", None, "Tab\tHere  ", "Ünï 12"]
    own = ChunkEncoder("byte_bpe_50k.json")
    assert not own.by_chunk and ChunkEncoder(huffman.TOKENIZER).by_chunk
    ids, n = own.encode(pa.array(texts))
    want = [Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_files_round_trip(spark, tmp_path):
    rows = [(7, "b b b"), (3, None), (None, "x"), (9, "longer text " * 400), (3, None), (1, "")]
    path = str(tmp_path / "ids")
    huffman.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, ids_per_file=300)
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r.start)
    e, at = _shared(), 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = str(tmp_path / "none")
    huffman.write_ids(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert huffman.read_ids(spark, empty).count() == 0
