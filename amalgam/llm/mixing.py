"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal blocks of words are given to sources by highest quotients (target / (2 * blocks + 1)), then each
source's blocks to its shards in the same way, through a tree of ``FAN`` branches where there are many
shards. Within a source and shard, documents stand end to end in a seeded order; a seeded run of that
many blocks is taken, all of them again where the quota exceeds what there is.

Sources may be any number: up to ``on_driver`` of them are apportioned in numpy, more by the same steps
as aggregates over the table of sources. Shards grow with the rows of their source and blocks with the
shards, so no task gets more than some thousand documents of one source.

Defined results: a null text has size 0; a null source is a source of its own, last; documents of size
0 take 0; repeated rows count each; of quotients that tie the earlier source's or shard's goes first; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranking import global_row_number
from .common import documents, materialize, text_hash, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Documents of a shard, and branches of the tree from a source to its shards.
ROWS_PER_SHARD, FAN = 1_000, 1024
#: Quotients that one aggregate tries.
TRIES = 64


def capped_targets(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds ``repeats`` times a size is shared again by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > repeats * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = float(repeats * sizes[i])
        left = total - sum(targets)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * own seats + 1); ties go to the earlier party; ``most`` bounds each.

    The quotient of the last seat is found by bisection, so the cost does not depend on ``seats``.
    """
    v = np.asarray(votes, float)
    cap = np.asarray(most if most is not None else [seats] * len(v), np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if not seats:
        return [0] * len(v)

    def held(q: float) -> np.ndarray:
        """Seats whose quotient is at least q."""
        return np.minimum(cap, np.floor((v / q + 1) / 2).astype(np.int64))
    low, high = v[v > 0].min() / (4.0 * seats + 4), v.max() * 2.0
    while held(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if held(mid).sum() >= seats else (low, mid)
    out = held(high)
    while (missing := seats - int(out.sum())) > 0:  # the seats that tie at the last quotient
        quotient = np.where(out < cap, v / (2 * out + 1), -1.0)
        for i in np.lexsort((np.arange(len(v)), -quotient))[:missing]:
            if quotient[i] < quotient.max() * (1 - 1e-12):
                break
            out[i] += 1
    return [int(x) for x in out]


def water_level(sources: DataFrame, total: int, repeats: int) -> float:
    """The words per weight at which the sources' targets, each ``repeats`` times its size at most, add up to ``total``."""
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > repeats * F.col("source_size")
        held, whole = sources.agg(F.coalesce(F.sum(F.when(over, repeats * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        now = (total - held) / whole if whole else float("inf")
        if now <= level * (1 + 1e-12) or not whole:
            return level if whole else float("inf")
        level = now


def quotas_of(sources: DataFrame, seats: int) -> DataFrame:
    """``sources`` (no, target, most) with quota: :func:`sainte_lague` as aggregates over a table of any length."""
    cap = F.when(F.col("target") > 0, F.col("most")).otherwise(0)
    held = lambda q: F.least(cap, F.floor((F.col("target") / F.lit(float(q)) + 1) / 2))
    top, least, room = sources.agg(F.max("target"), F.min(F.when(F.col("target") > 0, F.col("target"))), F.coalesce(F.sum(cap), F.lit(0))).first()
    seats = min(seats, int(room))
    if not seats:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    low, high = least / (4.0 * seats + 4), top * 2.0
    while sources.agg(F.sum(held(low))).first()[0] < seats:
        low /= 2
    while True:
        tries = [low + (high - low) * k / TRIES for k in range(1, TRIES)]
        tries = sorted({q for q in tries if low < q < high})
        if not tries:
            break
        sums = sources.agg(*[F.sum(held(q)).alias(f"s{k}") for k, q in enumerate(tries)]).first()
        enough = [k for k in range(len(tries)) if sums[k] >= seats]
        low, high = (tries[enough[-1]] if enough else low), (tries[enough[-1] + 1] if enough and enough[-1] + 1 < len(tries) else high if enough else tries[0])
    out = materialize(sources.withColumn("quota", held(high).cast("long")), "mix-quotas")
    missing = seats - out.agg(F.sum("quota")).first()[0]
    while missing:  # the seats that tie at the last quotient
        open_ = out.where(F.col("quota") < cap).withColumn("quotient", F.col("target") / (2 * F.col("quota") + 1))
        best = open_.agg(F.max("quotient")).first()[0]
        tied = global_row_number(materialize(open_.where(F.col("quotient") >= best * (1 - 1e-12)).select("no"), "mix-ties"), ["no"], "turn")
        more = tied.where(F.col("turn") <= missing).select("no", F.lit(1).cast("long").alias("more"))
        out = materialize(out.join(more, "no", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more"), "mix-quotas")
        missing = seats - out.agg(F.sum("quota")).first()[0]
    return out


def source_quotas(sources: DataFrame, n: int, total: int, block: int, repeats: int, on_driver: int) -> DataFrame:
    """no, target, quota of ``sources`` (no, weight, source_size), ``n`` rows."""
    seats = round(total / block)
    if n <= on_driver:
        rows = sorted(sources.select("no", "weight", "source_size").collect())
        sizes = [r.source_size for r in rows]
        targets = capped_targets(sizes, [r.weight for r in rows], repeats)
        quotas = sainte_lague(targets, seats, [-(-repeats * z // block) for z in sizes])
        return sources.sparkSession.createDataFrame([(r.no, float(t), q) for r, t, q in zip(rows, targets, quotas, strict=True)], "no long, target double, quota long")
    level = water_level(sources, total, repeats)
    limit = (repeats * F.col("source_size")).cast("double")
    target = limit if level == float("inf") else F.least(limit, F.col("weight") * F.lit(level))
    held = materialize(sources.select("no", target.alias("target"), F.ceil(repeats * F.col("source_size") / F.lit(block)).cast("long").alias("most")), "mix-targets")
    return quotas_of(held, seats).select("no", "target", "quota")


def shard_quotas(cells: DataFrame, quotas: DataFrame, block: int, repeats: int, deepest: int) -> DataFrame:
    """no, shard, quota: each source's blocks dealt down a tree whose nodes have ``FAN`` branches at most."""
    most = F.ceil(repeats * F.col("words") / F.lit(block)).cast("long")

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        held = sainte_lague(group["words"].tolist(), int(group["parent_quota"].iloc[0]), group["most"].tolist())
        return pd.DataFrame({"no": group["no"], "node": group["node"], "quota": held})

    levels = 1
    while FAN**levels < deepest:
        levels += 1
    found = quotas.select("no", F.lit(0).cast("long").alias("parent"), F.col("quota").alias("parent_quota"))
    for level in range(levels - 1, -1, -1):
        at = F.floor(F.col("shard") / F.lit(FAN**level)).cast("long")
        nodes = cells.groupBy("no", at.alias("node")).agg(F.sum("words").alias("words"), F.sum(most).alias("most")).withColumn("parent", F.floor(F.col("node") / F.lit(FAN)).cast("long"))
        held = nodes.join(found, ["no", "parent"]).groupBy("no", "parent").applyInPandas(apportion, "no long, node long, quota long")
        found = held.select("no", F.col("node").alias("parent"), F.col("quota").alias("parent_quota"))
    return held.select("no", F.col("node").alias("shard"), "quota")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, blocks: int = 1 << 20, on_driver: int = 10_000, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, text_hash of every row of ``docs`` (doc_id, text, source).

    ``blocks``: the least number of equal blocks the mix is cut into; there are 256 at least for each shard on
    average, and a block has one word at least. ``on_driver``: see the module's text.
    """
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), text_hash().alias("text_hash")), "mix-sizes")
    per_source = materialize(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    shards = F.ceil(F.col("rows") / F.lit(ROWS_PER_SHARD)).cast("long")
    n, total, all_shards, deepest = per_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(shards), F.lit(0)), F.coalesce(F.max(shards), F.lit(1))).first()
    block = max(1, total // max(blocks, 256 * all_shards))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    numbered = global_row_number(per_source, [F.asc_nulls_last("source")], "turn").withColumn("no", F.col("turn") - 1)
    sources = materialize(numbered.select("no", "source", "source_size", shards.alias("shards"), weight.alias("weight")), "mix-sources")
    quotas = materialize(source_quotas(sources, n, total, block, repeats, on_driver), "mix-quotas")
    known = sources.join(quotas.select("no", "target"), "no").select("no", F.col("source").alias("known"), "source_size", "shards", "target")
    known = materialize(known, "mix-known")
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("shards")).cast("long")
    dealt = base.join(known, F.col("source").eqNullSafe(F.col("known"))).withColumn("shard", shard).drop("known", "shards")
    cells = materialize(dealt.groupBy("no", "shard").agg(F.sum("size").alias("words")), "mix-cells")
    parts = materialize(shard_quotas(cells, quotas, block, repeats, deepest), "mix-shards")
    take = F.least(F.col("quota") * F.lit(block), repeats * F.col("words"))
    starts = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(block)))
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "no", "shard"), starts) * F.lit(block)
    some = F.col("words") > 0
    plan = cells.join(parts, ["no", "shard"]).select("no", "shard", "words", begin.alias("begin"), F.when(some, F.floor(take / F.col("words"))).otherwise(0).cast("long").alias("rounds"), F.when(some, take % F.col("words")).otherwise(0).cast("long").alias("more"))
    stream = Window.partitionBy("no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text_hash")), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(stream)).withColumn("start", F.col("stop") - F.col("size")).join(plan, ["no", "shard"])

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("stop"), high) - F.greatest(F.col("start"), low))

    end = F.col("begin") + F.col("more")
    taken = F.col("rounds") * F.col("size") + overlap(F.col("begin"), F.least(end, F.col("words"))) + overlap(F.lit(0), F.greatest(F.lit(0), end - F.col("words")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "text_hash")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_mixing": op8_mixing}
