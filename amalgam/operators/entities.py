"""Entities: clusters of matching records, kept up to date as records come and edits are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATCH_THRESHOLD
from ..graph import component_ids, connected_components
from ..ranking import global_row_number
from ..storage import materialize
from .blocking import PAIR, any_rule, rule_keys, rule_pairs
from .comparison import needed_columns, static_comparisons
from .decide import decision
from .model import Model, predict, score_wide


class GuardError(ValueError):
    """An edit or a run would break what holds for entities."""


def cluster(records: DataFrame, edges: DataFrame) -> DataFrame:
    """record_id, entity_id: every record once; entities are numbered by their least record."""
    return component_ids(records, edges, "record_id", a="record_id_l", b="record_id_r")


def entity_sizes(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(entities: DataFrame) -> DataFrame:
    return entity_sizes(entities).groupBy("size").agg(F.count(F.lit(1)).alias("entities"))


def summary(entities: DataFrame) -> DataFrame:
    """One row: records, entities, largest, singletons, merged, entities_ge2, records_in_multi."""
    s = F.col("size")
    return entity_sizes(entities).agg(
        F.sum(s).alias("records"),
        F.count(F.lit(1)).alias("entities"),
        F.max(s).alias("largest"),
        F.count_if(s == 1).alias("singletons"),
        (F.sum(s) - F.count(F.lit(1))).alias("merged"),
        F.count_if(s >= 2).alias("entities_ge2"),
        F.coalesce(F.sum(F.when(s >= 2, s)), F.lit(0)).alias("records_in_multi"),
    )


def guarded_cluster(records: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """record_id, entity_id, cluster_status: components that are too large or hold a NON_MATCH pair are taken apart for review."""
    base = cluster(records, pairs.where("decision = 'MATCH'"))
    return _taken_apart(base, _inside(pairs.where("decision = 'NON_MATCH'"), base), most)


def guarded_cluster_of(records: DataFrame, model: Model, most: int = 5) -> DataFrame:
    """:func:`guarded_cluster` of the pairs of ``model``, of which only the matches and those inside a component are made.

    A component of more than ``most`` is for review whatever its pairs are, so theirs are not looked at.
    """
    base = materialize(cluster(records, predict(records, model, at_least=MATCH_THRESHOLD).select(*PAIR)), "guarded-base")
    small = base.join(entity_sizes(base).where((F.col("size") > 1) & (F.col("size") <= most)).select("entity_id"), "entity_id", "left_semi")
    need = list(dict.fromkeys([*rule_keys(model.rules), *needed_columns(static_comparisons())]))
    members = records.select("record_id", *need).join(small, "record_id")
    inside = rule_pairs(members, ["entity_id"], need).where(any_rule(model.rules))
    against = score_wide(inside, model).withColumn("decision", decision(F.col("match_probability"))).where("decision = 'NON_MATCH'")
    return _taken_apart(base, _inside(against, base), most)


def _inside(against: DataFrame, base: DataFrame) -> DataFrame:
    """entity_id, contradictions: the pairs ``against`` a merge whose sides are in one entity."""
    left, right = (base.select(F.col("record_id").alias(f"record_id_{s}"), F.col("entity_id").alias(f"e_{s}")) for s in "lr")
    met = against.select(*PAIR).join(left, "record_id_l").join(right, "record_id_r").where("e_l = e_r")
    return met.groupBy(F.col("e_l").alias("entity_id")).agg(F.count(F.lit(1)).alias("contradictions"))


def _taken_apart(base: DataFrame, against: DataFrame, most: int) -> DataFrame:
    sizes = entity_sizes(base).join(against, "entity_id", "left")
    review = (F.col("size") > 1) & ((F.col("size") > most) | (F.coalesce("contradictions", F.lit(0)) > 0))
    status = F.when(review, "REVIEW").when(F.col("size") > 1, "MATCHED").otherwise("SINGLETON")
    return base.join(sizes, "entity_id").select("record_id", F.when(review, F.concat(F.lit("ent_"), "record_id")).otherwise(F.col("entity_id")).alias("entity_id"), status.alias("cluster_status"))


def next_ids(entities: DataFrame, groups: DataFrame, group: str, order: str) -> DataFrame:
    """``groups`` with new entity ids after the largest there is, in ``order``."""
    last = entities.agg(F.coalesce(F.max(F.split_part("entity_id", F.lit("_"), F.lit(2)).try_cast("long")), F.lit(0))).first()[0]
    return global_row_number(groups, [order], "__k").select(group, F.format_string("ent_%06d", F.col("__k") + F.lit(last)).alias("entity_id"))


def incremental_cluster(entities: DataFrame, new_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """record_id, entity_id after new records join: groups with old members take their least entity id, also for
    records of other entities that they bring together; groups of new records alone get new ids by least member.

    Components run over entities and new records as nodes, so old records that nothing touches never move.
    """
    node = entities.select("record_id", F.concat(F.lit("e:"), "entity_id").alias("node")).unionByName(new_ids.select("record_id", F.concat(F.lit("r:"), "record_id").alias("node")))
    ends = [node.select(F.col("record_id").alias(f"record_id_{s}"), F.col("node").alias(s)) for s in "lr"]
    links = edges.join(ends[0], "record_id_l").join(ends[1], "record_id_r").select("l", "r")
    parts = connected_components(links, "l", "r")
    # "e:" sorts before "r:", so the least node of a component with an old entity is its least entity id
    root = node.join(parts.select(F.col("node"), "component"), "node", "left").select("record_id", "node", F.coalesce("component", "node").alias("root"))
    fresh = root.where("root like 'r:%'").groupBy("root").agg(F.min("record_id").alias("first"))
    named = next_ids(entities, fresh, "root", "first")
    return root.join(named, "root", "left").select("record_id", F.coalesce("entity_id", F.expr("substring(root, 3)")).alias("entity_id"))


def merge_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """into, entities: where more than one old entity became one."""
    moved = before.join(after.select("record_id", F.col("entity_id").alias("into")), "record_id")
    return moved.groupBy("into").agg(F.array_sort(F.collect_set("entity_id")).alias("entities")).where(F.size("entities") > 1)


def split_entity(entities: DataFrame, edges: DataFrame, entity_id: str, records: Sequence[str], force: bool = False) -> DataFrame:
    """Moves ``records`` out of an entity into a new one; not across a MATCH edge unless forced, and not all of them."""
    inside = entities.where(F.col("entity_id") == entity_id)
    members = inside.select("record_id")
    leaving = list(records)
    known, total = inside.agg(F.count_if(F.col("record_id").isin(leaving)), F.count(F.lit(1))).first()
    if known < len(set(leaving)):
        raise GuardError(f"a record is not in {entity_id}")
    if known == total:
        raise GuardError(f"{entity_id} would be empty")
    own = edges.join(members.withColumnRenamed("record_id", "record_id_l"), "record_id_l", "left_semi").join(members.withColumnRenamed("record_id", "record_id_r"), "record_id_r", "left_semi")
    crossing = own.where(F.col("record_id_l").isin(leaving) != F.col("record_id_r").isin(leaving)).count()
    if crossing and not force:
        raise GuardError(f"{crossing} matching pairs would be split")
    last = entities.agg(F.max(F.split_part("entity_id", F.lit("_"), F.lit(2)).try_cast("long"))).first()[0]
    moved = (F.col("entity_id") == entity_id) & F.col("record_id").isin(leaving)
    return entities.withColumn("entity_id", F.when(moved, f"ent_{last + 1:06d}").otherwise(F.col("entity_id")))


def merge_entities(entities: DataFrame, devices: DataFrame, a: str, b: str, force: bool = False) -> DataFrame:
    """Joins two entities under the lower id; not if both have devices and these differ, unless forced."""
    if a == b:
        raise GuardError("one entity, not two")
    low, high = sorted((a, b))
    own = entities.where(F.col("entity_id").isin(a, b)).join(devices, "record_id", "left")
    sets = {r.entity_id: r.d for r in own.groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("device_ids_std", F.array().cast("array<string>")))))).alias("d")).collect()}
    if set(sets) != {a, b}:
        raise GuardError("an entity is unknown")
    if sets[a] and sets[b] and sets[a] != sets[b] and not force:
        raise GuardError("the entities have different devices")
    return entities.withColumn("entity_id", F.when(F.col("entity_id") == high, low).otherwise(F.col("entity_id")))


def recompute_touched(entities: DataFrame, touched: DataFrame, edges: DataFrame) -> DataFrame:
    """record_id, entity_id after the edges of some records have changed: only their entities are clustered anew.

    A part keeps its entity's id if it holds the entity's least record; other parts get new ids.
    """
    hit = entities.join(touched.select("record_id"), "record_id", "left_semi").select("entity_id").distinct()
    both = edges.join(touched.withColumnRenamed("record_id", "record_id_l"), "record_id_l", "left_semi").union(edges.join(touched.withColumnRenamed("record_id", "record_id_r"), "record_id_r", "left_semi").select("record_id_l", "record_id_r"))
    far = both.select(F.col("record_id_l").alias("record_id")).union(both.select("record_id_r")).distinct()
    hit = hit.union(entities.join(far, "record_id", "left_semi").select("entity_id")).distinct()
    scope = entities.join(hit, "entity_id", "left_semi")
    inside = scope.select("record_id")
    links = edges.join(inside.withColumnRenamed("record_id", "record_id_l"), "record_id_l", "left_semi").join(inside.withColumnRenamed("record_id", "record_id_r"), "record_id_r", "left_semi")
    parts = scope.join(connected_components(links, "record_id_l", "record_id_r"), F.col("record_id") == F.col("node"), "left").select("record_id", "entity_id", F.coalesce("component", "record_id").alias("root"))
    kept = parts.groupBy("root").agg(F.min("entity_id").alias("wanted"), F.min("record_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy("first"))
    kept = kept.withColumn("turn", rank)
    fresh = next_ids(entities, kept.where("turn > 1"), "root", "first")
    named = kept.join(fresh, "root", "left").select("root", F.coalesce("entity_id", "wanted").alias("entity_id"))
    done = parts.select("record_id", "root").join(named, "root").select("record_id", "entity_id")
    return entities.join(hit, "entity_id", "left_anti").select("record_id", "entity_id").unionByName(done)


def stale_records(old_edges: DataFrame, new_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """record_id, entity_id of the records whose matching partners changed."""
    pair = ["record_id_l", "record_id_r"]
    changed = old_edges.select(pair).exceptAll(new_edges.select(pair)).union(new_edges.select(pair).exceptAll(old_edges.select(pair)))
    ids = changed.select(F.explode(F.array(*pair)).alias("record_id")).distinct()
    return ids.join(entities, "record_id", "left").select("record_id", "entity_id")


def check_scope(current: dict, full: bool, force: bool = False) -> None:
    """A run over a sample may not replace a map over everything."""
    if current.get("scope") == "full" and not full and not force:
        raise GuardError("a sample would replace the full entity map")
