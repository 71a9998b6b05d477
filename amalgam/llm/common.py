"""Helpers that the operators share: input, shared work folder, word counts, gapless numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize, work_base

__all__ = ["WORD", "all_of", "chunks_for", "documents", "gapless_index", "lean", "materialize", "release", "slices", "small_batches", "split_by_bitmap", "text_hash", "text_of", "unused", "utf8_bytes", "word_count", "work_base"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BATCH = 4 << 20


def small_batches(spark: SparkSession, most_bytes: int = ARROW_BATCH) -> None:
    """Arrow batches to Python hold 4 MB at most: ten thousand long texts in one would fill an executor outside its heap."""
    spark.conf.set(ARROW_BYTES, str(most_bytes))


def documents(spark: SparkSession, sf_dir: str, most_bytes: int = ARROW_BATCH) -> DataFrame:
    small_batches(spark, most_bytes)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Gives the memory that Python and Arrow hold free back to the system; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, with its memory given back at its end."""

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, also those whose names hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of 64 bits that a bitmap has at most: some 4 MB when broadcast.
BITMAP_ROWS = 1 << 16


def split_by_bitmap(df: DataFrame, key: Column, marked: DataFrame, marked_key: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` is surely not one of ``marked``, and the others, which hold all that are.

    A bitmap of hashed keys, ``BITMAP_ROWS`` rows at most whatever the input, is broadcast, so only the others need a
    join with ``marked`` and its shuffle; the more ``rows`` ``marked`` has, the more of ``df`` is among them.
    """
    words = 1 << min(BITMAP_ROWS.bit_length() - 1, max(10, rows.bit_length() - 2))
    slot = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    at, bits = unused(df, "__slot", "__bits")
    own = F.xxhash64(marked_key)
    table = marked.select(slot(own).alias(at), bit(own).alias("bit")).groupBy(at).agg(F.bit_or("bit").alias(bits))
    hashed = F.xxhash64(key)
    wide = df.withColumn(at, slot(hashed)).join(F.broadcast(table), at, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(bit(hashed)) != 0, F.lit(False))
    return wide.where(~maybe).select(all_of(df)), wide.where(maybe).select(all_of(df))


def text_of(column: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_hash(column: str = "text") -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text_of(column))


def word_count(column: str = "text") -> Column:
    """Number of words of a text, null as none."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def utf8_bytes(column: str = "text") -> Column:
    return F.octet_length(text_of(column)).cast("long")


def chunks_for(rows: int, rows_per_chunk: int = 20_000, most: int = 1 << 16) -> int:
    return max(1, min(most, -(-rows // rows_per_chunk)))


def gapless_index(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``keys``, without gaps.

    A key may hold most rows, so each is cut into hashed chunks: rows are numbered within a chunk and
    the chunks' counts give where each begins. ``df`` must be materialized; ``order`` should tell rows
    apart (rows that tie on all of it are interchangeable).
    """
    chunk = f"__chunk_{out}"
    parts = chunks_for(rows)
    df = df.withColumn(chunk, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    begin = f"__begin_{out}"
    starts = (
        df.groupBy(*keys, chunk)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(begin, F.sum("__n").over(Window.partitionBy(*keys).orderBy(chunk)) - F.col("__n"))
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(*order)).cast("long") - 1
    return (
        df.withColumn(out, local)
        .join(starts, [*keys, chunk])
        .withColumn(out, F.col(out) + F.col(begin))
        .drop(chunk, begin)
    )


def slices(batch, column: int, most_bytes: int = 2 << 20):
    """Consecutive row slices of an Arrow batch whose text column holds about ``most_bytes`` at most, one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
