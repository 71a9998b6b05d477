"""Reads for reports: stored tables with a fallback, joined views, queues and pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..config import MATCH_THRESHOLD
from ..operators.blocking import PAIR
from ..operators.model import Model, predict
from ..storage import materialize


class TtlCache:
    """Values by key for ``seconds``."""

    def __init__(self, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key, compute: Callable):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            value = compute()
            self.held[key] = (self.clock(), value)
        return value

    def clear(self) -> None:
        self.held.clear()


def first_that_reads(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read and has rows; the last one in any case."""
    for read in readers[:-1]:
        try:
            df = read()
            if df.limit(1).count():
                return df
        except Exception:  # a source that is down; the next one is asked
            continue
    return readers[-1]()


def master_view(master: DataFrame, membership: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Golden records with their records, sources and open conflicts, the largest first."""
    members = membership.groupBy("entity_id").agg(F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_list("record_id")).alias("record_ids"), F.array_sort(F.collect_set("source")).alias("sources"))
    open_ = conflicts.where("status = 'OPEN'").groupBy("entity_id").agg(F.array_sort(F.collect_set("field")).alias("conflicted_fields"))
    empty = F.array().cast("array<string>")
    wide = master.join(members, "entity_id", "left").join(open_, "entity_id", "left")
    filled = {"record_count": F.coalesce("record_count", F.lit(0)), **{c: F.coalesce(c, empty) for c in ("record_ids", "sources", "conflicted_fields")}}
    return wide.withColumns(filled).orderBy(F.desc("record_count"), "entity_id")


def open_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("status = 'OPEN'").agg(F.count_distinct("entity_id").alias("entities"))


def load_queue(queue: DataFrame, fields: list[str]) -> DataFrame:
    """Review rows with their JSON evidence as columns, the last row of each pair, most likely first."""
    from ..ranking import keep_last

    last = keep_last(queue, ["record_id_l", "record_id_r"], "review_id")
    wide = last.withColumn("__e", F.from_json("evidence", MapType(StringType(), StringType())))
    return wide.select(*last.columns, *[F.col("__e")[f].alias(f) for f in fields]).drop("evidence").orderBy(F.desc_nulls_last("match_probability"), "record_id_l", "record_id_r")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def search(df: DataFrame, text: str, columns: list[str], n: int = 20) -> DataFrame:
    """Rows that contain ``text`` in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(hit).orderBy("record_id").limit(n)


def band(pairs: DataFrame, decision: str | None = None) -> DataFrame:
    return pairs if decision is None else pairs.where(F.col("decision") == decision)


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("match_probability"), "record_id_l", "record_id_r").limit(n)


def top_of_model(records: DataFrame, model: Model, n: int, steps: Sequence[float] = (0.9999, MATCH_THRESHOLD)) -> DataFrame:
    """:func:`top_pairs` of all pairs of ``model``: if as many as ``n`` reach a step, no pair below it is among the first,
    so the pairs of each step are made until they are enough, and all pairs only then."""
    for p in steps:
        top = materialize(top_pairs(predict(records, model, at_least=p).select(*PAIR, "match_probability"), n), "top-pairs")
        if top.count() == n:
            return top_pairs(top, n)
    return top_pairs(predict(records, model), n)


def candidates_of(pairs: DataFrame, record_id: str, n: int = 50) -> DataFrame:
    """other, match_probability of the pairs of one record."""
    other = F.when(F.col("record_id_l") == record_id, F.col("record_id_r")).otherwise(F.col("record_id_l"))
    return pairs.where((F.col("record_id_l") == record_id) | (F.col("record_id_r") == record_id)).select(other.alias("other"), "match_probability").orderBy(F.desc("match_probability"), "other").limit(n)
