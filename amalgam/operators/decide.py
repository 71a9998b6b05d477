"""Decisions from probabilities, and business rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUSINESS_RULE_KEYS, EVIDENCE_FIELDS, MATCH_THRESHOLD, REVIEW_THRESHOLD
from ..storage import materialize
from .blocking import PAIR, Rules, count_pairs, or_join
from .comparison import needed_columns, static_comparisons
from .model import Model, may_reach, predict, score_wide


def decision(p: Column, match: float = MATCH_THRESHOLD, review: float = REVIEW_THRESHOLD) -> Column:
    """Lower bounds are inclusive."""
    return F.when(p >= match, "MATCH").when(p >= review, "REVIEW").otherwise("NON_MATCH")


def decided(records: DataFrame, model: Model, keep: Sequence[str] = (), review: float = REVIEW_THRESHOLD) -> DataFrame:
    """Every pair of the model's rules with its decision and the columns ``keep`` of both sides.

    Only pairs that may reach ``review`` are scored; the others are NON_MATCH as they are made.
    """
    need = list(dict.fromkeys([*needed_columns(static_comparisons()), *keep]))
    columns = [*PAIR, "decision", *[f"{c}_{s}" for c in keep for s in "lr"]]
    pairs = or_join(records, model.rules, need)
    open_ = may_reach(model, review)
    scored = score_wide(pairs.where(open_), model, keep=keep).withColumn("decision", decision(F.col("match_probability"), review=review))
    return scored.select(*columns).unionByName(pairs.where(~open_).withColumn("decision", F.lit("NON_MATCH")).select(*columns))


def decision_counts(records: DataFrame, model: Model, review: float = REVIEW_THRESHOLD) -> DataFrame:
    """decision, pairs. All pairs are counted from block sizes, those that reach ``review`` one by one; the rest are NON_MATCH."""
    some = predict(records, model, at_least=review).groupBy(decision(F.col("match_probability"), review=review).alias("decision")).agg(F.count(F.lit(1)).alias("pairs"))
    some = materialize(some, "decisions")
    made = count_pairs(records, {"made": model.rules})
    rest = made.crossJoin(some.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("some")))  # one row by one row
    return some.unionByName(rest.select(F.lit("NON_MATCH").alias("decision"), (F.col("pairs") - F.col("some")).alias("pairs")).where("pairs > 0"))


def agree(column: str) -> Column:
    """1 where both sides have the same value, else 0."""
    return F.coalesce(F.col(f"{column}_l") == F.col(f"{column}_r"), F.lit(False)).cast("int")


def apply_business_rules(pairs: DataFrame) -> DataFrame:
    """Adds business_rule; a pair that agrees on all keys without an equal date of birth goes to REVIEW.

    Without the key columns the rule is null and the decision stays.
    """
    have = set(pairs.columns)
    if any(f"{c}_{s}" not in have for c in BUSINESS_RULE_KEYS for s in "lr"):
        return pairs.withColumn("business_rule", F.lit(None).cast("string"))
    both = lambda c: F.coalesce(F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False))
    differs = lambda c: ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))
    keys = reduce(lambda a, b: a & b, [both(c) for c in BUSINESS_RULE_KEYS])
    dob = both("dob_std") if {"dob_std_l", "dob_std_r"} <= have else F.lit(False)
    any_agree = reduce(lambda a, b: a | b, [both(c) for c in EVIDENCE_FIELDS if {f"{c}_l", f"{c}_r"} <= have])
    conflict = differs("email_std") & differs("first_name_std") & differs("last_name_std")
    unverified = keys & ~dob
    rule = (
        F.when(conflict, "conflicting_email_fullname")
        .when(~any_agree & ~unverified, "no_field_agreement")
        .when(unverified, "unverified_dob")
        .when(keys & dob, "strong_agreement_email_name_address")
    )
    return pairs.withColumn("business_rule", rule).withColumn("decision", F.when(unverified, "REVIEW").otherwise(F.col("decision")))


STRONG = ("email_std", "phone_std", "dob_std")


def any_strong() -> Column:
    """E-mail, phone or date of birth equal."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False)) for c in STRONG])


def any_strong_counts(records: DataFrame, rules: Rules) -> DataFrame:
    """One row: pairs that the rules make, and how many of them have a strong agreement; both from block sizes.

    A pair is made by a rule, or agrees strongly, or both: those with both are the sum of the two less those with either.
    """
    strong = [(c, (c,)) for c in STRONG]
    counts = count_pairs(records, {"made": rules, "strong": strong, "either": [*rules, *strong]})
    of = lambda name: F.sum(F.when(F.col("name") == name, F.col("pairs")))
    return counts.agg(of("made").alias("pairs"), (of("made") + of("strong") - of("either")).alias("any_strong"))


def match_edges(pairs: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    return pairs.where(F.col("match_probability") >= threshold).select("record_id_l", "record_id_r")
