"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are a group that no shard splits. Groups sorted by size enter the bin with the
tightest remaining capacity that still holds them, found in a balanced tree. Two uses: the fewest shards
of a fixed capacity, or a fixed number of shards, for which the least capacity that needs no more bins is
searched for.

The driver packs the histogram of group sizes, not the groups: of the groups of one size, the tightest bin
takes as many in a row as it holds, since it stays the tightest, so the packing is that of best fit over all
groups. There are about the square root of 2 b distinct sizes at most in b bytes. Within a size, groups are
numbered in order of a hash and take the bins in turn.

Defined results: a null text has size 1 and is a copy of the empty text; repeated rows count each and
go to one shard; groups of one size are interchangeable and dealt by hash; a group that exceeds a fixed
capacity is a shard of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless_index, materialize, text_of, utf8_bytes


class Treap:
    """A balanced search tree of distinct keys; priorities come from a hash, so its shape is repeatable."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _merge(a: list | None, b: list | None) -> list | None:
        """The tree of both; all keys of ``a`` are below those of ``b``."""
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            a[3] = Treap._merge(a[3], b)
            return a
        b[2] = Treap._merge(a, b[2])
        return b

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Keys below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = Treap._split(node[3], key)
            return node, rest
        rest, node[2] = Treap._split(node[2], key)
        return rest, node

    def add(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        node = [key, hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def pop_at_least(self, key: tuple) -> tuple | None:
        """Removes and returns the least key that is not below ``key``."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        found = high
        while found[2] is not None:
            found = found[2]
        rest = self._split(high, (found[0][0], found[0][1] + 1))[1]
        self.root = self._merge(low, rest)
        return found[0]


#: Groups of one size from ``first`` on (and before ``stop``) that are in one bin.
Run = tuple[int, int, int, int]


def best_fit_decreasing(sizes: Sequence[int], counts: Sequence[int], capacity: int, most: int | None = None) -> tuple[list[Run], int] | None:
    """Runs (size, first, stop, bin) of ``counts`` items of distinct ``sizes``, and the number of bins; None if that exceeds
    ``most``. An item over ``capacity`` has a bin of its own, unless ``most`` is given: then there is no packing."""
    free, bins, runs = Treap(), 0, []
    for size, count in sorted(zip(sizes, counts, strict=True), reverse=True):
        if size > capacity:
            if most is not None:
                return None
            runs += [(size, k, k + 1, bins + k) for k in range(count)]
            bins += count
            continue
        done = 0
        while done < count:
            found = free.pop_at_least((size, 0))
            if found is None:
                if most is not None and bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            some = min(count - done, found[0] // size)
            runs.append((size, done, done + some, found[1]))
            done += some
            free.add((found[0] - some * size, found[1]))
    return runs, bins


def balanced_bins(sizes: Sequence[int], counts: Sequence[int], shards: int, tries: int = 14) -> list[Run]:
    """The runs of a best-fit-decreasing packing into ``shards`` bins of the least capacity found by bisection."""
    if not sizes:
        return []
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    low = max(-(-total // shards), max(sizes))
    best = best_fit_decreasing(sizes, counts, low, shards)
    high = low
    while best is None:
        high += max(1, low // 64)
        best = best_fit_decreasing(sizes, counts, high, shards)
    floor = max(low, high - max(1, low // 64))
    for _ in range(tries):
        if high - floor <= 1:
            break
        mid = (floor + high) // 2
        found = best_fit_decreasing(sizes, counts, mid, shards)
        floor, high, best = (mid, high, best) if found is None else (floor, mid, found)
    return best[0]


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text): in ``shards``
    shards of about equal bytes or, with ``capacity``, in the fewest shards that best fit finds of that many bytes each."""
    spark = docs.sparkSession
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (utf8_bytes() + 1).alias("size"),
            F.crc32(text_of().cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"),
        ),
        "shard-sizes",
    )
    groups = materialize(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")).toArrow()
    sizes, counts = (histogram.column(c).to_pylist() for c in ("bytes", "groups"))
    runs = balanced_bins(sizes, counts, shards) if capacity is None else best_fit_decreasing(sizes, counts, capacity)[0]
    columns = [np.array([r[k] for r in runs], np.int64) for k in range(4)]
    plan = spark.createDataFrame(pa.table(columns, ["run_bytes", "first", "stop", "shard"])) if runs else spark.createDataFrame([], "run_bytes long, first long, stop long, shard long")
    plan = materialize(plan.groupBy("run_bytes").agg(F.array_sort(F.collect_list(F.struct("stop", "shard"))).alias("runs")), "shard-plan")
    ranked = gapless_index(groups.withColumn("by", F.xxhash64("digest")), ["bytes"], ["by", "digest"], "turn", sum(counts))
    own = F.filter("runs", lambda r: r["stop"] > F.col("turn"))[0]["shard"].cast("int")
    placed_groups = materialize(ranked.join(plan, F.col("bytes") == F.col("run_bytes")).select("digest", own.alias("shard")), "shard-places")
    placed = base.join(placed_groups, "digest").select("doc_id", "size", "text_crc32", "shard")
    numbered = gapless_index(materialize(placed, "shard-placed"), ["shard"], ["doc_id", "size", "text_crc32"], "slot", sum(histogram.column("rows").to_pylist()))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_sharding": op10_sharding}
