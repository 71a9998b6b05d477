"""Numbering and ranking without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order: list[str | Column], out: str, parts: int | None = None) -> DataFrame:
    """1, 2, 3, ... in ``order`` over all rows: ranges are numbered on their own and begin after the ranges before them."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    starts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return ranged.join(F.broadcast(starts), "__part").withColumn(out, F.col("__at") - F.col("__low") + F.col("__before") + 1).drop("__part", "__at", "__low", "__before")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest ``seq`` of each key; partial maxima meet, so no key's rows gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``. Spark keeps ``n`` rows a key before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def order_statistics(df: DataFrame, column: str, quantiles: list[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbours, of a column: counts per value, summed up by ranges, and only the values
    around the wanted places reach the driver."""
    from .storage import materialize

    values = materialize(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return [None] * len(quantiles)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(values.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    starts = ranged.groupBy("part").agg(F.sum("n").alias("sum")).withColumn("before", F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).drop("sum")  # a row per range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = ranged.withColumn("stop", inside).join(F.broadcast(starts), "part").withColumn("stop", F.col("stop") + F.col("before"))
    places = [q * (total - 1) for q in quantiles]
    ranks = sorted({int(p) for p in places} | {min(total - 1, int(p) + 1) for p in places})
    wanted = F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("stop")) & (r >= F.col("stop") - F.col("n")))
    found = placed.where(wanted).select("v", "n", "stop").collect()
    at = lambda r: next(x.v for x in found if x.stop - x.n <= r < x.stop)
    return [at(int(p)) + (p - int(p)) * (at(min(total - 1, int(p) + 1)) - at(int(p))) for p in places]
