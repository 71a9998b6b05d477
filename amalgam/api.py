"""The engine as functions: a full run, an ad-hoc run over chosen columns, and look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import BUSINESS_RULE_KEYS, EVIDENCE_FIELDS, MASTER_FIELDS, Settings
from .operators import comparison, decide, entities, model, survivorship
from .operators.standardize import assert_blocking_columns, standardize
from .storage import materialize


@dataclass
class Run:
    records: DataFrame
    pairs: DataFrame
    entities: DataFrame
    master: DataFrame
    model: model.Model


def run_pipeline(raw: DataFrame, settings: Settings = Settings(), columns: Sequence[str] | None = None, trained: model.Model | None = None, order: list[str] | None = None) -> Run:
    """Raw rows to golden records. ``columns`` choose comparisons with fixed m; ``trained`` skips training.

    Records, pairs and entities are written to the shared folder, so no stage is computed twice.
    """
    clean = standardize(raw, settings, order)
    levels = comparison.dynamic_comparisons(columns) if columns else comparison.static_comparisons()
    rules = comparison.dynamic_rules(columns, settings.rules) if columns else settings.rules
    assert_blocking_columns(clean, rules)
    # what the input does not have is null in golden records and stored tables
    absent = [c for c in dict.fromkeys([*MASTER_FIELDS, *comparison.needed_columns(levels), "customer_id", "source"]) if c not in clean.columns]
    records = materialize(clean.withColumns({c: F.lit(None).cast("string") for c in absent}), "records")
    fitted = trained or model.train(records, levels, rules, max_pairs=100_000, fixed_m=bool(columns))
    keep = [c for c in dict.fromkeys([*BUSINESS_RULE_KEYS, *EVIDENCE_FIELDS]) if c in records.columns]
    scored = model.predict(records, fitted, levels, keep).withColumn("decision", decide.decision(F.col("match_probability"), settings.match_threshold, settings.review_threshold))
    pairs = materialize(decide.apply_business_rules(scored), "pairs")
    mapped = materialize(entities.cluster(records, pairs.where("decision = 'MATCH'")), "entities")
    return Run(records, pairs, mapped, survivorship.master(records.join(mapped, "record_id")), fitted)


def entity_of(run: Run, record_id: str) -> DataFrame:
    """The golden record of a record, by the entity map."""
    hit = run.entities.where(F.col("record_id") == record_id).select("entity_id")
    return run.master.join(hit, "entity_id", "left_semi")


def pair_detail(run: Run, a: str, b: str) -> DataFrame:
    low, high = sorted((a, b))
    return run.pairs.where((F.col("record_id_l") == low) & (F.col("record_id_r") == high))


def stats(run: Run) -> DataFrame:
    return run.pairs.groupBy("decision").agg(F.count(F.lit(1)).alias("pairs"), F.avg("match_probability").alias("mean_probability"))
