"""Token-id output: canonical length-limited Huffman codes from global id counts.

The files are two Parquet tables in one folder. ``codes`` (id, bits) holds the code lengths, from
which the canonical codes follow. ``blocks`` holds, in ascending doc_id order, runs of whole documents
coded on their own: doc_ids and their lengths, the bit string (each document from a byte on), and the
bit offsets of every ``STRIDE``-th id of a document and of its end: decoding can begin at any of them.

Defined results: a null or empty text is the end id alone; documents with null doc_id come first;
repeated rows are written each, next to each other; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import scatter_bits
from .common import documents, lean, materialize, slices, work_base
from .tokens import encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LIMIT = 16
STRIDE = 256
BLOCK_IDS = 1 << 18
#: Bytes of text whose chunks are looked up together: the more, the more of them are alike.
SLICE = 8 << 20
#: The driver knows how many ids each file has.
MOST_FILES = 1 << 14


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``limit``, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.uint8)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([leaves, row[0:even:2] + row[1:even:2]])
        by = np.argsort(both, kind="stable")
        row = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol); a length of 0 marks an absent symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        size = int(lengths[symbol])
        if size:
            code <<= size - last
            codes[symbol] = code
            code, last = code + 1, size
    return codes


def encode_ids(ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit strings of runs of ``n`` ids, each from a byte on: all bytes, the bytes of each run, and the bit
    offset of each id."""
    size = lengths[ids].astype(np.int64)
    stop = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(n)
    bits = stop[ends] - stop[ends - n]
    n_bytes = -(-bits // 8)
    shift = (np.cumsum(n_bytes) - n_bytes) * 8 - stop[ends - n]
    at = stop[:-1] + np.repeat(shift, n)
    out = np.zeros(int(n_bytes.sum()), np.uint8)
    if len(ids):
        scatter_bits(out, at, size, codes[ids])
    return out, n_bytes, at


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next LIMIT bits."""
    codes, present = canonical_codes(lengths), np.flatnonzero(lengths)
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    by = present[np.lexsort((present, lengths[present]))]
    span = (1 << (LIMIT - lengths[by].astype(np.int64))).astype(np.int64)
    filled = int(span.sum())
    symbol[:filled], size[:filled] = np.repeat(by, span), np.repeat(lengths[by], span)
    assert not len(by) or codes[by[-1]] == (filled >> (LIMIT - int(lengths[by[-1]]))) - 1
    return symbol, size


def decode_ids(bits: bytes, start: np.ndarray, stop: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of runs of ``n`` ids (STRIDE at most) between bit offsets, side by side; each must end at its ``stop``."""
    symbol, size = table
    raw = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    by = np.argsort(-n, kind="stable")
    at = start[by].astype(np.int64)
    out = np.zeros((STRIDE, len(at)), np.uint32)
    steps = int(n.max(initial=0))
    for k, a in enumerate(np.searchsorted(-n[by], -np.arange(steps), side="left").tolist()):
        p = at[:a]
        key = (window[np.minimum(p >> 3, len(window) - 1)] >> (24 - LIMIT - (p & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[k, :a] = symbol[key]
        at[:a] = p + size[key]
    if not np.array_equal(at, stop[by].astype(np.int64)):
        raise ValueError("a run of codes does not end at the next checkpoint")
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return out.T[back][np.arange(STRIDE) < n[:, None]]


def id_type(tokenizer: str, end_id: int) -> str:
    """16-bit ids where the vocabulary allows, else 32-bit."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, kind: str = "<u4") -> DataFrame:
    """doc_id, ids (unsigned, of ``kind``) of every row of ``docs``, with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, n = own.encode(part.column(1))
                ends = np.cumsum(n)
                whole = np.insert(ids, ends, end_id).astype(kind)
                offsets = np.concatenate([[0], ends + np.arange(1, len(n) + 1)]) * whole.itemsize
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([part.column(0), column.cast(pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encode), "doc_id long, ids binary")


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents; at most a row per id of the vocabulary leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 32 << 20):
                own = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind))
                size = max(len(total), len(own))
                total = np.pad(total, (0, size - len(total))) + np.pad(own, (0, size - len(own)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    return ids.select("ids").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "part int, seq int, start_in_part long, doc_ids array<long>, doc_lens array<int>, n_ids long, bits binary, checkpoints binary"
_BLOCK_TYPES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("bits", pa.binary()), ("checkpoints", pa.binary())])


def coded(batches: Iterator[pa.RecordBatch], kind: str, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int | None, int, bytes, np.ndarray]]:
    """doc_id, number of ids, bit string, and bit offsets at every STRIDE-th id and at the end, of each row (doc_id, ids)."""
    for batch in batches:
        for part in slices(batch, 1, 4 << 20):
            raw = part.column(1).to_pylist()
            flat = np.frombuffer(b"".join(raw), kind)
            n = np.array([len(r) for r in raw], np.int64) // flat.itemsize
            data, n_bytes, at = encode_ids(flat, n, codes, lengths)
            data = data.tobytes()
            for doc, e, k, s, c in zip(part.column(0).to_pylist(), np.cumsum(n_bytes).tolist(), n_bytes.tolist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
                last = at[s - 1] + lengths[flat[s - 1]] if c else (e - k) * 8
                yield doc, c, data[e - k : e], np.append(at[s - c : s : STRIDE], last) - (e - k) * 8


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, ids_per_file: int = 4_000_000) -> None:
    """Writes the ids of all documents to a new folder ``path``, in ascending doc_id order, in ``MOST_FILES`` files at most."""
    spark = docs.sparkSession
    kind = id_type(tokenizer, end_id)
    ids = materialize(token_ids(docs, tokenizer, end_id, kind), "token-ids", compression="zstd")
    counts = sorted((r.id, r.n) for r in id_counts(ids, kind).collect())  # a row per id of the vocabulary at most
    symbols, n = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    lengths = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.uint8)
    lengths[symbols] = code_lengths(n)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in symbols], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")

    codes = canonical_codes(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal seq, done, size
            begin, marks = 0, []
            for _, _, bits, own in held:
                marks.append(own + 8 * begin)
                begin += len(bits)
            row = {"part": [part], "seq": [seq], "start_in_part": [done], "doc_ids": [[h[0] for h in held]], "doc_lens": [[h[1] for h in held]], "n_ids": [size], "bits": [b"".join(h[2] for h in held)], "checkpoints": [np.concatenate(marks).astype("<u8").tobytes()]}
            seq, done, size = seq + 1, done + size, 0
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=_BLOCK_TYPES)

        for row in coded(batches, kind, codes, lengths):
            if held and size + row[1] > BLOCK_IDS:
                yield block()
            held.append(row)
            size += row[1]
        if held:
            yield block()

    files = min(MOST_FILES, max(1, int(n.sum()) // ids_per_file))
    # null and repeated doc_ids are many ranges too; the last key parts rows that are alike
    keyed = ids.withColumns({"by": F.xxhash64("ids"), "turn": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(files, "doc_id", "by", "turn") if files > 1 else keyed.coalesce(1)
    ranged.sortWithinPartitions("doc_id", "by", "turn").select("doc_id", "ids").mapInArrow(lean(blocks), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``, and its ids (array of int)."""
    found = spark.read.schema("id long, bits int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r.id for r in found), default=0) + 1, np.uint8)
    for r in found:
        lengths[r.id] = r.bits
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    per_part = dict(stored.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per file
    begin = np.zeros(max(per_part, default=0) + 2, np.int64)
    for part, n in per_part.items():
        begin[part + 1] = n
    begin = np.cumsum(begin)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                part, _, start, doc_ids, doc_lens, _, bits, checkpoints = (c[row].as_py() for c in batch.columns)
                size = np.array(doc_lens, np.int64)
                runs = -(-size // STRIDE)
                marks = np.frombuffer(checkpoints, "<u8")
                first = np.ones(len(marks), bool)
                last = np.cumsum(runs + 1) - 1
                first[last] = False
                n = np.full(int(runs.sum()), STRIDE)
                n[np.cumsum(runs)[size > 0] - 1] = (size - (runs - 1) * STRIDE)[size > 0]
                from_ = np.flatnonzero(first)
                ids = decode_ids(bits, marks[from_], marks[from_ + 1], n, table).astype("<u4")
                stop = np.cumsum(size)
                raw = memoryview(ids.tobytes())
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begin[part] + start + stop - size, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), doc_lens, strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return stored.mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_base(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir, 2 * SLICE), path)
    return read_ids(spark, path, with_ids=False)


ORACLE: dict[str, str] = {}
QUERIES = {"op3_huffman_ids": op3_huffman_ids}
