"""New and changed records against stored entities, as micro-batches.

State lives in versioned tables (:class:`amalgam.sinks.Staging`); a batch commits all of them or none,
with its id, in one move of one file, so a batch that Spark delivers again changes nothing. A batch adds its
records, its pairs and the rows of the entity map that it changes; what was there is not written again.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import decide, entities as E
from ..operators.blocking import PAIR, new_pairs, touching_old_rows
from ..operators.model import Model, score_pairs
from ..ranking import keep_last
from ..sinks import Staging, append_new, atomic_json, one_per_key, replace_rows
from ..sources.registry import Registry
from ..storage import create_text, materialize, move_away, read_text


class ReplayError(ValueError):
    """Records of a batch are stored already."""


def check_replay(new: DataFrame, stored: DataFrame) -> None:
    if n := new.select("record_id").join(stored.select("record_id"), "record_id", "left_semi").count():
        raise ReplayError(f"{n} records are stored already")


def score_new(new: DataFrame, stored: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Scored pairs with at least one new record, with decisions and business rules. Only old rows that share a key are read."""
    from ..config import BUSINESS_RULE_KEYS, EVIDENCE_FIELDS

    old = touching_old_rows(new, stored, model.rules)
    every = old.unionByName(new, allowMissingColumns=True)
    pairs = new_pairs(new, every, model.rules).select(*PAIR)
    keep = list(dict.fromkeys([*BUSINESS_RULE_KEYS, *EVIDENCE_FIELDS]))
    scored = score_pairs(pairs, every, model, keep=keep)
    scored = scored.withColumn("decision", decide.decision(F.col("match_probability"), settings.match_threshold, settings.review_threshold))
    return decide.apply_business_rules(scored)


def link_batch(new: DataFrame, stored: DataFrame, entity_map: DataFrame, model: Model, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The batch's pairs and the entity map with it."""
    check_replay(new, stored)
    pairs = materialize(score_new(new, stored, model, settings), "new-pairs")
    edges = pairs.where("decision = 'MATCH'").select(*PAIR)
    return pairs, E.incremental_cluster(entity_map, new.select("record_id"), edges)


def staging_rows(new: DataFrame, pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What is proposed for each new record: its entity, match or new, its best matching partner, approval open."""
    m = pairs.where("decision = 'MATCH'")
    both = m.select(F.explode(F.array(F.struct(F.col(PAIR[0]).alias("record_id"), F.col(PAIR[1]).alias("other"), "match_probability"), F.struct(F.col(PAIR[1]).alias("record_id"), F.col(PAIR[0]).alias("other"), "match_probability"))).alias("x")).select("x.*")
    best = both.groupBy("record_id").agg(F.max(F.struct("match_probability", "other")).alias("b")).select("record_id", F.col("b.other").alias("matched_to"), F.col("b.match_probability").alias("match_probability"))
    known = before.select("entity_id").distinct().withColumn("old", F.lit(True))
    out = new.select("record_id").join(after, "record_id").join(known, "entity_id", "left").join(best, "record_id", "left")
    action = F.when(F.col("old").isNotNull() | F.col("matched_to").isNotNull(), "match").otherwise("new")
    return out.select("record_id", F.col("entity_id").alias("proposed_entity_id"), action.alias("action"), "matched_to", "match_probability", F.lit(True).alias("approved"))


def apply_staged(before: DataFrame, staging: DataFrame) -> DataFrame:
    """The entity map after review: approved records join their proposed entity, others get a new one each."""
    taken = staging.where("approved").select("record_id", F.col("proposed_entity_id").alias("entity_id"))
    base = before.unionByName(taken)
    return base.unionByName(E.next_ids(base, staging.where("not approved").select("record_id"), "record_id", "record_id"))


def split_updates(batch: DataFrame, key_map: DataFrame, pk: str = "customer_pk") -> tuple[DataFrame, DataFrame]:
    """Rows with a known key (with their record_id), and the others."""
    known = batch.join(key_map.select(pk, "record_id"), pk)
    return known, batch.join(key_map.select(pk), pk, "left_anti")


def update_records(stored: DataFrame, updates: DataFrame, entity_map: DataFrame, old_edges: DataFrame, model: Model, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed records in place: the stored table, the edges and the entity map afterwards."""
    after = replace_rows(stored, updates)
    pairs = score_new(updates, stored.join(updates.select("record_id"), "record_id", "left_anti"), model, settings)
    own = pairs.where("decision = 'MATCH'").select(*PAIR)
    ids = updates.select("record_id")
    rest = old_edges.join(ids.withColumnRenamed("record_id", PAIR[0]), PAIR[0], "left_anti").join(ids.withColumnRenamed("record_id", PAIR[1]), PAIR[1], "left_anti").select(*PAIR)
    edges = materialize(rest.unionByName(own), "edges")
    return after, edges, E.recompute_touched(entity_map, ids, edges)


def touching_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``: two semi-joins, no OR."""
    hit = [edges.join(ids.select(F.col("record_id").alias(c)), c, "left_semi").select(*PAIR) for c in PAIR]
    return hit[0].union(hit[1]).distinct()


def current_entities(state: Staging) -> DataFrame | None:
    """record_id, entity_id as the last batch that touched each record left them."""
    stored = state.read("entities")
    return None if stored is None else keep_last(stored, ["record_id"], "batch").select("record_id", "entity_id")


class Linker:
    """State and the ``foreachBatch`` function of a linking stream."""

    def __init__(self, spark: SparkSession, root: str, model: Model, prepare: Callable[[DataFrame], DataFrame], settings: Settings = Settings()) -> None:
        self.spark, self.root, self.model, self.prepare, self.settings = spark, root, model, prepare, settings

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state = Staging(self.spark, self.root, f"batch-{batch_id}")
        done = state.manifest()["batch"]
        if done is not None and batch_id <= done:
            return
        new = materialize(self.prepare(batch), "batch")
        records, entity_map = state.read("records"), current_entities(state)
        if records is None:
            records, entity_map = new.limit(0), self.spark.createDataFrame([], "record_id string, entity_id string")
        found, after = link_batch(new, records, entity_map, self.model, self.settings)
        before = entity_map.select("record_id", F.col("entity_id").alias("__was"))
        changed = after.join(before, "record_id", "left").where("not entity_id <=> __was").drop("__was")
        state.append(changed.withColumn("batch", F.lit(batch_id).cast("long")), "entities")
        state.append(new, "records")
        state.append(found, "pairs")
        state.commit(batch_id)

    def start(self, source: DataFrame, checkpoint: str, every: str | None = None):
        """Runs the stream: until all there is has been read, or periodically."""
        writer = source.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Watermarks:
    """Positions by source and table. ``advance`` is called after a batch has been applied, never before."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _all(self) -> dict:
        return json.loads(read_text(self.path) or "{}")

    def read(self, source: str, table: str) -> dict | None:
        return self._all().get(f"{source}::{table}")

    def advance(self, source: str, table: str, position: dict) -> None:
        atomic_json({**self._all(), f"{source}::{table}": position}, self.path)


def ingest(df: DataFrame, marks: Watermarks, source: str, table: str, apply: Callable[[DataFrame], None], column: str = "updated_at", pk: str | None = None) -> int:
    """Fetches what is new, applies it, and only then moves the watermark. The batch is read from the source once and written to
    the shared folder, so a row that arrives meanwhile is in the next one."""
    from ..sources.database import fetch, latest_watermark

    at = marks.read(source, table) or {}
    batch = materialize(fetch(df, column, at.get("value"), pk, at.get("last_pk")), "ingested")
    n = batch.count()
    if n:
        apply(batch)
        position = latest_watermark(batch, column, pk)
        marks.advance(source, table, {k: str(v) if k == "value" else v for k, v in position.items()})
    return n


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)), *[F.sum(part(k)) for k in range(4)]).first()
    return hashlib.sha256("|".join(map(str, [*sorted(df.columns), *sums])).encode()).hexdigest()


def export_batch(df: DataFrame, registry: Registry, folder: str) -> dict:
    """A batch as CSV (;) in the registry; rows that are registered already are neither written nor numbered again."""
    digest = content_digest(df)
    known = next((b for b in registry.batches if b.sha256 == digest), None)
    if known:
        return {"status": "already_registered", "rows": known.rows, "batch_id": known.batch_id, "file": known.file}
    rows = df.count()
    if not rows:
        return {"status": "noop", "rows": 0}
    path = f"{folder.rstrip('/')}/{digest[:16]}"
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    batch = registry.register(path, rows, digest)
    return {"status": "exported", "rows": rows, "batch_id": batch.batch_id, "file": path}


class RunLock:
    """One run at a time; a lock of a dead or overdue run is taken over."""

    def __init__(self, path: str, stale_seconds: float = 7200) -> None:
        self.path, self.stale = path, stale_seconds

    def acquire(self, note: str = "", now: float | None = None) -> bool:
        """Creates the lock, which one of several runs can; an overdue lock is first moved away, which again one can."""
        now = time.time() if now is None else now
        text = json.dumps({"start": now, "note": note})
        if create_text(self.path, text):
            return True
        held = read_text(self.path)
        if held and now - json.loads(held)["start"] <= self.stale:
            return False
        return move_away(self.path) and create_text(self.path, text)

    def release(self) -> None:
        move_away(self.path)


class AlertGate:
    """Lets an alert through once per cooldown."""

    def __init__(self, cooldown: float = 3600) -> None:
        self.cooldown, self.sent = cooldown, {}

    def should_send(self, alert: dict, now: float) -> bool:
        key = hashlib.sha256("|".join(str(alert.get(k)) for k in ("level", "source", "message")).encode()).hexdigest()
        if now - self.sent.get(key, float("-inf")) < self.cooldown:
            return False
        self.sent[key] = now
        return True


def metric_windows(history: DataFrame, metrics: Sequence[str], width: str = "1 hour") -> DataFrame:
    """Means of logged health metrics by time window."""
    return history.groupBy(F.window("timestamp", width)).agg(*[F.avg(m).alias(m) for m in metrics])


def append_stale(log: DataFrame, stale: DataFrame) -> DataFrame:
    """The log with each stale record once."""
    return append_new(log, one_per_key(stale, ["record_id"], None), ["record_id"])
