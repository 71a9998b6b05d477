"""Golden records: surviving values, lineage, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MASTER_FIELDS
from ..functions.text import corruption_score


def _long(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    return frame.select("entity_id", *fields).unpivot("entity_id", list(fields), "field", "value").where("value is not null")


def field_values(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """entity_id, field, value, n, corruption: how often each value of each field occurs in an entity."""
    return _long(frame, fields).groupBy("entity_id", "field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("corruption", corruption_score(F.col("value"), F.col("field")))


def master_values(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """entity_id and master_<field>: the most frequent value, on a tie the least corrupt, then the least.

    A minimum over (-n, corruption, value) meets map-side; no window sorts an entity's values.
    """
    best = field_values(frame, fields).groupBy("entity_id", "field").agg(F.min(F.struct((-F.col("n")).alias("k"), "corruption", "value")).alias("best"))
    wide = best.groupBy("entity_id").pivot("field", list(fields)).agg(F.first("best.value"))
    return frame.select("entity_id").distinct().join(wide, "entity_id", "left").select("entity_id", *[F.col(f).alias(f"master_{f}") for f in fields])


def lineage(frame: DataFrame) -> DataFrame:
    return frame.groupBy("entity_id").agg(
        F.countDistinct("record_id").alias("record_count"),
        F.array_sort(F.collect_list("record_id")).alias("record_ids"),
        F.array_sort(F.collect_set("customer_id")).alias("customer_ids"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def conflicts(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """entity_id, conflicted_fields: sorted names of the fields with more than one value; empty where none."""
    differ = frame.groupBy("entity_id").agg(*[(F.min(f) != F.max(f)).alias(f) for f in fields])
    names = F.array(*[F.when(F.col(f), F.lit(f)) for f in sorted(fields)])
    return differ.select("entity_id", F.filter(names, lambda x: x.isNotNull()).alias("conflicted_fields"))


def conflict_values(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """entity_id, field, value, records, distinct_values of every conflicting field."""
    values = _long(frame, fields).groupBy("entity_id", "field", "value").agg(F.count(F.lit(1)).alias("records"))
    return values.withColumn("distinct_values", F.count(F.lit(1)).over(Window.partitionBy("entity_id", "field"))).where("distinct_values > 1")


def master(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """One row per entity: values, lineage, conflicts, status."""
    out = master_values(frame, fields).join(lineage(frame), "entity_id").join(conflicts(frame, fields), "entity_id")
    return out.withColumn("status", F.when(F.size("conflicted_fields") > 0, "CONFLICTED").otherwise("CONFIRMED"))


def recompute(frame: DataFrame, entity_ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Golden records of some entities made anew, the others as stored; entities without records go."""
    live = frame.join(entity_ids, "entity_id", "left_semi")
    rest = stored.join(entity_ids, "entity_id", "left_anti").join(frame.select("entity_id").distinct(), "entity_id", "left_semi")
    return rest.unionByName(master(live), allowMissingColumns=True)


def plain(master_rows: DataFrame) -> DataFrame:
    """master_<field>_std as <field>."""
    names = {c: c.removeprefix("master_").removesuffix("_std") for c in master_rows.columns if c.startswith("master_")}
    return master_rows.withColumnsRenamed(names)


def most_complete(frame: DataFrame, fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """The other golden record: fields of the most complete record, gaps filled from the next ones, column by column."""
    complete = sum(F.col(f).isNotNull().cast("int") for f in fields)
    order = F.struct((-complete).alias("k"), "record_id")
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return frame.groupBy("entity_id").agg(*first, F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_list("record_id")).alias("record_ids"))
