"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the digests find the texts with very many copies. Their exact winners, at
most ``counters`` rows, are broadcast and settle those rows where they are read; all other digests,
each with under ``rows / counters`` rows, take the ordinary shuffle.

Defined results: a null text is the empty text; of equal texts the row with the largest doc_id stays
(null is the smallest); of repeated rows with that doc_id one stays; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, materialize, text_of


def merge_summary(counts: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries: the sum of two summaries, cut back to ``counters`` entries by a common decrement."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {k: n - cut for k, n in counts.items() if n > cut}
    return counts


def frequent_candidates(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """At most ``counters`` values of a binary column, among them all with over rows / (counters + 1) rows."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            more = dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True))
            counts = merge_summary(counts, more, counters)
        yield pa.RecordBatch.from_pydict(
            {"value": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
        )

    partial = digests.select(column).mapInArrow(lean(summarize), "value binary, n long")
    merged = partial.groupBy("value").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "value").limit(counters).select(F.col("value").alias(column))


def exact_dedup(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text), and row,
    a number of the input row that is stable within the returned frame."""
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-digests",
    )
    winner = [F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size")]
    candidates = frequent_candidates(rows, "digest", counters)
    heavy = materialize(
        rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*winner).where("group_size > 1"),
        "dedup-winners",
    )
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = light.join(light.groupBy("digest").agg(*winner), "digest")
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = {
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
