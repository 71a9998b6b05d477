"""The pairs with the least md5, of blocks whose pairs are too many to make: a pair is hashed where its block's record ids
meet, and only those below a bound become rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.md5 import Joined
from ..functions.text import pair_key
from ..ranking import top_per_group
from ..storage import materialize
from .blocking import PAIR, or_join, tasks

Sets = Sequence[Sequence[str]]
#: Blocks are cut into chunks of about so many records; two chunks that meet are a unit of work.
CHUNK = 2048
#: A task's call gets units of about so many pairs, and of about so many rows.
PAIRS, ROWS = 1 << 24, 200_000
BATCH = 1 << 16


def pair_hash() -> Column:
    return F.md5(pair_key(F.col(PAIR[0]), F.col(PAIR[1])))


def _rows(ids: pa.Array, size: int) -> np.ndarray:
    """Texts of ``size`` bytes each as rows of bytes."""
    flat = np.frombuffer(b"".join(ids.to_pylist()), np.uint8)
    return flat.reshape(len(ids), size)


def below(unit: np.ndarray, side: np.ndarray, across: np.ndarray, ids: pa.Array, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of the pairs whose md5 begins with at most ``bound``, as 32 bits. The rows of a unit meet those of its
    other side if they are ``across``, else each other; the lesser id is left, and equal ids do not meet."""
    ids = ids.cast(pa.binary())
    size = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    order = pc.sort_indices(pc.unique(ids)).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    coded = ids.dictionary_encode()
    rank, n = rank[coded.indices.to_numpy()], len(order)
    _, unit = np.unique(unit, return_inverse=True)
    place = (unit * 2 + side) * (n + 1) + rank
    facing = (unit * 2 + np.where(across, 1 - side, side)) * (n + 1)
    lengths = np.unique(size)
    of = {}
    for k in lengths:
        rows = np.flatnonzero(size == k)
        rows = rows[np.argsort(place[rows], kind="stable")]
        of[k] = rows, _rows(ids.take(pa.array(rows)), int(k))
    sep = np.frombuffer(b"__", np.uint8)
    for a in lengths:
        left, texts = of[a]
        before = np.concatenate([texts, np.broadcast_to(sep, (len(left), 2))], axis=1)
        for b in lengths:
            right, after = of[b]
            begin = np.searchsorted(place[right], facing[left] + rank[left] + 1)
            count = np.searchsorted(place[right], facing[left] + n) - begin
            some = np.flatnonzero(count > 0)
            if not len(some):
                continue
            begin, count = begin[some], count[some]
            stop, joined = np.cumsum(count), Joined(before, after)
            for p in range(0, int(stop[-1]), BATCH):
                q = min(p + BATCH, int(stop[-1]))
                first, last = np.searchsorted(stop, p, "right"), np.searchsorted(stop, q - 1, "right") + 1
                from_ = np.maximum(stop[first:last] - count[first:last], p)
                times = np.minimum(stop[first:last], q) - from_
                i = np.repeat(np.arange(first, last), times)
                j = np.arange(p, q) + np.repeat(begin[first:last] - (stop[first:last] - count[first:last]), times)
                hit = np.flatnonzero(joined.first_word(some[i], j) <= bound)
                if len(hit):
                    yield left[some[i[hit]]], right[j[hit]]


def _blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """__key, record_id of the records that have all of ``columns``."""
    known = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*columns, "record_id"]]))
    return known.select(F.xxhash64(F.lit(" ".join(columns)), *[F.col(c) for c in columns]).alias("__key"), "record_id")


def made(df: DataFrame, sets: Sets) -> int:
    """How many pairs the blocks of ``sets`` make, a pair once for each set."""
    blocks = reduce(DataFrame.unionByName, [_blocks(df, s) for s in sets]).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    return blocks.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]


def pairs_below(df: DataFrame, sets: Sets, share: float) -> DataFrame:
    """record_id_l, record_id_r: pairs that agree on all columns of one of ``sets`` and whose md5 is in the least ``share`` of all
    values, each once; all such pairs if ``share`` is 1."""
    if share >= 1:
        return or_join(df, [("_".join(s), s) for s in sets]).select(*PAIR).distinct()
    bound = min(math.ceil(share * 2**32), 2**32 - 1)
    members = reduce(DataFrame.unionByName, [_blocks(df, s) for s in sets])
    sizes = members.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    pairs, rows = sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0))).first()
    calls = max(1, pairs // PAIRS, rows // ROWS)
    own = F.pmod(F.xxhash64("record_id"), F.col("chunks"))
    dealt = members.join(sizes, "__key").select("__key", "record_id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    unit = F.xxhash64("__key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(unit.alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("across"), "record_id")
    dealt = dealt.withColumn("call", F.pmod("unit", F.lit(calls))).repartition(max(tasks(df), calls), "call")
    schema = pa.schema([(c, pa.string()) for c in PAIR])

    def hash_units(table: pa.Table) -> pa.Table:
        ids = table.column("record_id").combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        found = list(below(column("unit"), column("side").astype(np.int64), column("across"), ids, bound))
        return pa.concat_tables([schema.empty_table(), *(pa.Table.from_arrays([ids.take(pa.array(rows)).cast(pa.string()) for rows in f], schema=schema) for f in found)])

    hits = dealt.groupBy("call").applyInArrow(hash_units, "record_id_l string, record_id_r string").distinct()
    keys = list(dict.fromkeys(c for s in sets for c in s))
    sides = [df.select(*[F.col(c).alias(f"{c}_{s}") for c in ["record_id", *keys]]) for s in "lr"]
    wide = hits.join(sides[0], "record_id_l").join(sides[1], "record_id_r")  # keys whose hashes are alike by chance leave here
    agree = [reduce(lambda a, b: a & b, [F.col(f"{c}_l") == F.col(f"{c}_r") for c in s]) for s in sets]
    return wide.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in agree])).select(*PAIR).distinct()


def least_pairs(df: DataFrame, sets: Sets, n: int, first: int, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ``n`` pairs with the least md5 that agree on one of ``sets`` and that ``wanted`` keeps, or all if they are fewer.

    Some ``first`` pairs with the least md5 are looked at, then more until they are enough or all have been.
    """
    share = first / max(1, made(df, sets)) if sets else 1
    if not sets:
        return df.select(*[F.col("record_id").alias(c) for c in PAIR]).where(F.lit(False))
    while True:
        some = wanted(pairs_below(df, sets, share)).select(*PAIR).withColumn("__all", F.lit(1))
        found = materialize(top_per_group(some, ["__all"], [pair_hash()], n).select(*PAIR), "least-pairs")
        if share >= 1 or found.count() >= n:
            return found
        share *= 32
