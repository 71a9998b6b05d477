"""Labels: silver from rules, review queue, gold from people, feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MATCH_THRESHOLD, QUEUE_CAP, QUEUE_CAP_LOW, REVIEW_FIELDS
from ..functions.text import label_of, pair_key
from ..ranking import keep_last, top_per_group
from ..storage import materialize
from .blocking import PAIR, Rules, any_rule, attach, finest, or_join, rule_keys, rule_pairs, same
from .least import least_pairs
from .model import Model, reaching, score_pairs

FLAGS = {"agree_email": ("email_std",), "agree_phone": ("phone_std",), "agree_dob": ("dob_std",), "agree_name": ("first_name_std", "last_name_std"), "agree_city": ("city_std",)}
FLAG_COLUMNS = sorted({c for columns in FLAGS.values() for c in columns})


#: From here on a probability is high; and how many pairs that may have one are looked at first for the review queue.
HIGH, LOOKED_AT = 0.5, 400_000


def silver(df: DataFrame) -> DataFrame:
    """record ids, label, evidence. Positive: phone and date of birth, or e-mail and phone agree. Negative: e-mail
    agrees while phone, date of birth and first name all differ, or phone agrees while date of birth and first name
    differ; a null differs from a value. A pair may be on both sides."""
    positive = [(("phone_std", "dob_std"), "phone+dob"), (("email_std", "phone_std"), "email+phone")]
    negative = [(("email_std",), ("phone_std", "dob_std", "first_name_std"), "email_only"), (("phone_std",), ("dob_std", "first_name_std"), "phone_only")]
    differ = lambda columns: reduce(lambda a, b: a & b, [~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")) for c in columns])
    out = [rule_pairs(df, c).select(*PAIR, F.lit(1).alias("label"), F.lit(e).alias("evidence")) for c, e in positive]
    out += [rule_pairs(df, c, d).where(differ(d)).select(*PAIR, F.lit(0).alias("label"), F.lit(e).alias("evidence")) for c, d, e in negative]
    return reduce(DataFrame.unionByName, out).groupBy(*PAIR, "label").agg(F.min("evidence").alias("evidence"))


def agreement_flags(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Three-valued agreement per field: null where a side is missing."""
    wide = attach(pairs.select(*PAIR), records, FLAG_COLUMNS)
    return wide.select(*PAIR, *flags())


def flags() -> list[Column]:
    """The flags of pairs with both sides' columns."""
    return [same(columns).alias(n) for n, columns in FLAGS.items()]


def agree_count():
    return sum(F.coalesce(F.col(f), F.lit(False)).cast("int") for f in FLAGS)


def review_strata(scored: DataFrame, silver_pairs: DataFrame, records: DataFrame) -> DataFrame:
    """stratum and pair, a row for each stratum a pair is in; null flags are in neither a flag's stratum nor its opposite."""
    wide = scored.select(*PAIR, "match_probability").join(silver_pairs.select(*PAIR, "label"), PAIR, "left").join(agreement_flags(scored, records), PAIR, "left")
    p, unlabelled = F.col("match_probability"), F.col("label").isNull()
    strata = [
        ("silver_positive_low_probability", (F.col("label") == 1) & (p < HIGH)),
        ("silver_negative_high_probability", (F.col("label") == 0) & (p >= HIGH)),
        ("unlabelled_high_probability", unlabelled & (p >= HIGH)),
        ("unlabelled_same_name", unlabelled & F.col("agree_name")),
        ("unlabelled_same_phone", unlabelled & ~F.col("agree_name") & F.col("agree_phone")),
        ("unlabelled_same_email", unlabelled & F.col("agree_email") & ~F.col("agree_phone")),
    ]
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in strata]), lambda x: x.isNotNull())
    return wide.withColumn("agree_count", agree_count()).withColumn("stratum", F.explode(names))


def review_queue(scored: DataFrame, silver_pairs: DataFrame, records: DataFrame, cap: int = QUEUE_CAP, low: int = QUEUE_CAP_LOW) -> DataFrame:
    """Of each stratum the pairs with the least md5, up to its cap, with both sides' fields and empty label columns."""
    strata = review_strata(scored, silver_pairs, records)
    by_hash = [F.md5(pair_key(F.col(PAIR[0]), F.col(PAIR[1])))]
    is_low = F.col("stratum") == "unlabelled_same_email"
    # a fixed limit per stratum lets Spark cut each stratum before the shuffle
    some = top_per_group(strata.where(~is_low), ["stratum"], by_hash, cap).unionByName(top_per_group(strata.where(is_low), ["stratum"], by_hash, low)).drop("label")
    full = attach(some, records, REVIEW_FIELDS)
    return full.withColumns({"label": F.lit(None).cast("string"), "review_status": F.lit("pending"), "reviewer": F.lit(None).cast("string"), "reviewer_note": F.lit(None).cast("string")})


def review_queue_of(records: DataFrame, model: Model, cap: int = QUEUE_CAP, low: int = QUEUE_CAP_LOW) -> DataFrame:
    """:func:`review_queue` of all pairs of ``model``, of which it scores those that may be in it.

    Pairs with a label, and those of the strata of equal phones and e-mails, agree on phone or e-mail and are all made. Of the
    other two strata the pairs with the least md5 are looked for until they are as many as the cap.
    """
    keys, names = rule_keys(model.rules), FLAGS["agree_name"]
    labelled = materialize(silver(records), "silver")
    scored_of = lambda pairs, p=None: score_pairs(pairs, records, model, keep=keys, at_least=p).where(any_rule(model.rules))
    unlabelled = lambda pairs: pairs.join(labelled.select(*PAIR), PAIR, "left_anti")
    likely = least_pairs(records, reaching(model, HIGH), cap, LOOKED_AT, lambda pairs: scored_of(unlabelled(pairs), HIGH))
    named = least_pairs(records, finest({*names, *columns} for _, columns in model.rules), cap, 16 * cap, lambda pairs: scored_of(unlabelled(pairs)))
    marked = or_join(records, [(c, (c,)) for c in ("phone_std", "email_std")]).select(*PAIR)
    scored = scored_of(marked.unionByName(likely).unionByName(named).distinct())
    return review_queue(materialize(scored.select(*PAIR, "match_probability"), "review-pairs"), labelled, records, cap, low)


def sorted_queue(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.desc("agree_count"), F.desc_nulls_last("match_probability"), *PAIR)


def keyed(df: DataFrame, out: str = "pair_id") -> DataFrame:
    return df.withColumn(out, pair_key(F.col(PAIR[0]), F.col(PAIR[1])))


def exclude_gold(queue: DataFrame, gold: DataFrame) -> DataFrame:
    """Queue rows whose pair, in either order, is not in gold."""
    return keyed(queue, "__pair").join(keyed(gold, "__pair").select("__pair"), "__pair", "left_anti").drop("__pair")


def carry_over(queue: DataFrame, before: DataFrame, columns=("label", "review_status", "reviewer", "reviewer_note")) -> DataFrame:
    """Earlier human answers win over the new queue's empty ones."""
    old = keyed(before.where(F.col("label").isNotNull()), "__pair").select("__pair", *[F.col(c).alias(f"__{c}") for c in columns])
    best = old.groupBy("__pair").agg(F.max(F.struct(*old.columns[1:])).alias("__row"))
    old = best.select("__pair", *[F.col("__row")[c].alias(c) for c in old.columns[1:]])
    wide = keyed(queue, "__pair").join(old, "__pair", "left")
    return wide.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).select(queue.columns)


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs with the lesser id left; every _l/_r column changes sides with it."""
    swap = F.col("record_id_l") > F.col("record_id_r")
    out = {}
    for c in pairs.columns:
        if c.endswith("_l") and f"{c[:-2]}_r" in pairs.columns:
            r = f"{c[:-2]}_r"
            out[c] = F.when(swap, F.col(r)).otherwise(F.col(c))
            out[r] = F.when(swap, F.col(c)).otherwise(F.col(r))
    return pairs.withColumns(out)


def load_labels(df: DataFrame, strict: bool = True) -> DataFrame:
    """record ids, is_positive from a table with one of the label columns; unknown words are refused in gold."""
    name = next(c for c in ("label", "is_match", "match", "is_positive") if c in df.columns)
    out = canonical(df.select(*PAIR, F.col(name).alias("__raw"))).withColumn("__label", label_of(F.col("__raw")))
    if strict and out.where("__raw is not null and trim(cast(__raw as string)) <> '' and __label is null").limit(1).count():
        raise ValueError("a label is in neither vocabulary")
    return out.where("__label is not null").select(*PAIR, (F.col("__label") == "match").alias("is_positive")).distinct()


def validate_gold(gold: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: gold_rows, matched_in_preds, missing_pairs (distinct pairs that are not scored), bad_labels."""
    lab = canonical(gold).withColumn("__label", label_of(F.col("label")))
    missing = lab.select(*PAIR).distinct().join(canonical(scored).select(*PAIR), PAIR, "left_anti").agg(F.count(F.lit(1)).alias("missing_pairs"))
    rows = lab.agg(F.count(F.lit(1)).alias("gold_rows"), F.count_if(F.col("__label").isNull()).alias("bad_labels"))
    return rows.crossJoin(missing).select("gold_rows", (F.col("gold_rows") - F.col("missing_pairs")).alias("matched_in_preds"), "missing_pairs", "bad_labels")  # one row by one row


def promote(sources: DataFrame, seq: str = "seq") -> DataFrame:
    """Reviewed rows as gold: ids in order, known labels only, the last answer of each pair."""
    known = canonical(sources).withColumn("label", label_of(F.col("label"))).where("label is not null")
    return keep_last(known, PAIR, seq)


def feedback(gold: DataFrame, scored: DataFrame, model_version: str) -> DataFrame:
    """Human labels with the model's score and decision at that time."""
    s = keyed(scored).select("pair_id", F.col("match_probability").alias("score"), "decision")
    return keyed(gold).join(s, "pair_id", "left").select("pair_id", *PAIR, "score", "decision", F.col("label").alias("human_label"), F.lit(model_version).alias("model_version"))


def merge_feedback(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    return keep_last(existing.unionByName(incoming, allowMissingColumns=True), ["pair_id", "model_version"], seq)


def plan_overrides(labels: DataFrame, scored: DataFrame, devices: DataFrame, overrides: DataFrame | None = None, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """What gold labels would change: pair, decision_now, decision_after, match_probability, exists, blocked, blocked_reason."""
    known = devices.select("record_id")
    lab = labels.join(known.withColumnRenamed("record_id", PAIR[0]), PAIR[0], "left_semi").join(known.withColumnRenamed("record_id", PAIR[1]), PAIR[1], "left_semi")
    s = keyed(scored, "__pair").groupBy("__pair").agg(F.min(F.struct(*PAIR, "match_probability", "decision")).alias("s"))
    sets = devices.select("record_id", F.array_sort(F.array_distinct("device_ids_std")).alias("set"))
    wide = keyed(lab, "__pair").join(s, "__pair", "left").withColumn("exists", F.col("s").isNotNull())
    wide = wide.join(sets.select(F.col("record_id").alias(PAIR[0]), F.col("set").alias("dl")), PAIR[0], "left").join(sets.select(F.col("record_id").alias(PAIR[1]), F.col("set").alias("dr")), PAIR[1], "left")
    forced = F.lit(None).cast("string")
    if overrides is not None:
        o = overrides.select(*PAIR, F.upper(F.trim("decision")).alias("__forced"))
        wide, forced = wide.join(o, PAIR, "left"), F.col("__forced")
    want = F.when(F.col("is_positive"), "MATCH").otherwise("NON_MATCH")
    now = F.coalesce("s.decision", F.lit("ABSENT"))
    p_conflict = F.col("exists") & ~F.col("is_positive") & (F.col("s.match_probability") >= threshold)
    d_conflict = F.col("is_positive") & (F.size(F.coalesce("dl", F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce("dr", F.array().cast("array<string>"))) > 0) & ~F.col("dl").eqNullSafe(F.col("dr"))
    todo = wide.where((now != want) & ~(~F.col("exists") & (want == "NON_MATCH")))
    reason = F.when(forced.isNull() & p_conflict, "probability above the threshold").when(forced.isNull() & d_conflict, "devices differ")
    return todo.select(*PAIR, now.alias("decision_now"), F.coalesce(forced, want).alias("decision_after"), F.col("s.match_probability").alias("match_probability"), "exists", reason.isNotNull().alias("blocked"), reason.alias("blocked_reason"))


def apply_overrides(scored: DataFrame, plan: DataFrame) -> DataFrame:
    """Decisions of the plan's open rows; absent pairs join with probability 1 or 0."""
    todo = keyed(plan.where("not blocked"), "__pair").select("__pair", *[F.col(c).alias(f"__{c}") for c in PAIR], "decision_after")
    wide = keyed(scored, "__pair").join(todo.select("__pair", "decision_after"), "__pair", "left")
    changed = wide.withColumn("decision", F.coalesce("decision_after", "decision")).select(scored.columns)
    fresh = todo.join(keyed(scored, "__pair").select("__pair"), "__pair", "left_anti").select(*[F.col(f"__{c}").alias(c) for c in PAIR], F.col("decision_after").alias("decision"), (F.col("decision_after") == "MATCH").cast("double").alias("match_probability"))
    return changed.unionByName(fresh, allowMissingColumns=True)


def outside_blocking(records: DataFrame, scored: DataFrame | None, gold: DataFrame, rules, per_rule: int, blocked_by: Rules = ()) -> DataFrame:
    """Pairs of alternative keys that are neither scored nor in gold: of each rule those with the least md5.

    Where all pairs of the rules ``blocked_by`` are scored, the pair's own keys tell, and ``scored`` need not be there.
    """
    out = []
    for name, columns in rules:
        free = rule_pairs(records, columns, rule_keys(blocked_by))
        free = (free.where(~any_rule(blocked_by)) if blocked_by else free).select(*PAIR)
        free = (free if scored is None else free.join(scored.select(*PAIR), PAIR, "left_anti")).join(gold.select(*PAIR), PAIR, "left_anti")
        out.append(free.orderBy(F.md5(pair_key(F.col(PAIR[0]), F.col(PAIR[1]))), *PAIR).limit(per_rule).withColumn("stratum", F.lit(f"outside_blocking_{name}")))
    return reduce(DataFrame.unionByName, out).groupBy(*PAIR).agg(F.min("stratum").alias("stratum"))


def md5_sample(df: DataFrame, key, n: int) -> DataFrame:
    """A repeatable sample: the rows with the least md5 of ``key``."""
    return df.orderBy(F.md5(key), key).limit(n)


def customer_id_agreement(records: DataFrame, silver_pairs: DataFrame) -> DataFrame:
    """label, pairs, same_customer: how far the silver labels go with the source's own ids."""
    wide = attach(silver_pairs.select(*PAIR, "label"), records, ["customer_id"])
    return wide.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("customer_id_l") == F.col("customer_id_r")).alias("same_customer"))
