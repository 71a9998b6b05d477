"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket boundaries with the least
padding; inside a bucket, batches form by a budget of padded tokens.

Defined results: a null or empty text has length 0; a document longer than the budget is a batch of
its own; repeated rows take a place each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless_index, materialize, word_count


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most ``buckets`` buckets with the least total padding.

    cost(i, j) = L[j] * (documents in i..j) - tokens in i..j satisfies the quadrangle inequality, so the
    best split moves monotonically and each layer takes D log D steps by divide and conquer.
    """
    order = np.argsort(lengths)
    length, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(length)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * length)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of one bucket over the lengths i..j."""
        return length[j] * (docs[j + 1] - docs[i]) - (tokens[j + 1] - tokens[i])

    best = np.array([cost(np.int64(0), j) for j in range(n)], np.int64)
    splits: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        nxt, split = best.copy(), np.zeros(n, np.int64)
        work = [(0, n - 1, 0, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(max(first, 0), min(mid, last) + 1)
            before = np.where(i > 0, best[np.maximum(i - 1, 0)], 0)
            total = before + cost(i, mid)
            k = int(np.argmin(total))
            nxt[mid], split[mid] = total[k], i[k]
            work.append((lo, mid - 1, first, int(i[k])))
            work.append((mid + 1, hi, int(i[k]), last))
        best = nxt
        splits.append(split)
    bounds, j = [], n - 1
    for split in reversed(splits):
        bounds.append(int(length[j]))
        j = int(split[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(length[j]))
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot of every row of ``docs`` (doc_id, text).

    ``n_tokens`` counts words. The driver holds the histogram of exact lengths: a row per distinct length,
    of which t tokens in all have about the square root of 2 t at most.
    """
    spark = docs.sparkSession
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_tokens")), "pack-lengths")
    histogram = base.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = (histogram.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "n"))
    bounds = optimal_buckets(lengths, counts, buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, bucket_len long, batch long, slot int")
    bucket = sum((F.col("n_tokens") > F.lit(b)).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    per_batch = [max(1, budget // max(1, b)) for b in bounds]
    sizes = np.zeros(len(bounds), np.int64)
    np.add.at(sizes, np.searchsorted(bounds, lengths), counts)
    first = np.concatenate([[0], np.cumsum([-(-n // p) for n, p in zip(sizes.tolist(), per_batch, strict=True)])])
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    numbered = gapless_index(base.withColumn("bucket", bucket.cast("int")), ["bucket"], ["doc_id", "n_tokens"], "__at", int(counts.sum()))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        pick(bounds).alias("bucket_len"),
        (pick(first[:-1]) + F.floor(F.col("__at") / pick(per_batch))).cast("long").alias("batch"),
        F.pmod(F.col("__at"), pick(per_batch)).cast("int").alias("slot"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_packing": op4_packing}
