"""Evaluation against device truth, labels and whole entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MATCH_THRESHOLD, REVIEW_THRESHOLD, SWEEP
from ..ranking import order_statistics
from .blocking import PAIR


def _devices(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.explode("device_ids_std").alias("device")).where(F.length("device") > 0)


def device_truth(records: DataFrame) -> DataFrame:
    """Pairs of records that share any device id."""
    d = _devices(records).distinct()
    left, right = d.select(F.col("record_id").alias("record_id_l"), "device"), d.select(F.col("record_id").alias("record_id_r"), "device")
    return left.join(right, "device").where("record_id_l < record_id_r").select(*PAIR).distinct()


def records_with_device(records: DataFrame) -> DataFrame:
    return _devices(records).select("record_id").distinct()


def device_sets(records: DataFrame) -> DataFrame:
    return _devices(records).groupBy("record_id").agg(F.array_sort(F.collect_set("device")).alias("devices"))


def truth_scoring(truth: DataFrame, edges: DataFrame, with_device: DataFrame) -> DataFrame:
    """One row. An edge outside truth is a false merge only if both records have devices, else it can't be verified."""
    hit = edges.select(*PAIR).join(truth.select(*PAIR, F.lit(True).alias("true")), PAIR, "left")
    d = with_device.select("record_id")
    hit = hit.join(d.select(F.col("record_id").alias(PAIR[0]), F.lit(True).alias("dl")), PAIR[0], "left").join(d.select(F.col("record_id").alias(PAIR[1]), F.lit(True).alias("dr")), PAIR[1], "left")
    both = F.col("dl").isNotNull() & F.col("dr").isNotNull()
    wrong = F.col("true").isNull()
    a = hit.agg(F.count(F.lit(1)).alias("match_edges"), F.count("true").alias("matched_truth_pairs"), F.count_if(wrong & both).alias("false_merges"), F.count_if(wrong & ~both).alias("unverifiable_edges"))
    t = truth.agg(F.count(F.lit(1)).alias("truth_pairs"))
    one = a.crossJoin(t)  # one row by one row
    ratio = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 4))
    return one.select("truth_pairs", "matched_truth_pairs", (F.col("truth_pairs") - F.col("matched_truth_pairs")).alias("missed_truth_pairs"), "match_edges", "false_merges", "unverifiable_edges", ratio("matched_truth_pairs", "truth_pairs").alias("recall"), ratio("matched_truth_pairs", "match_edges").alias("precision"))


def confusion(pairs: DataFrame, label: Column, score: Column, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1: all thresholds from one pass over the pairs."""
    base = pairs.where(label.isNotNull() & score.isNotNull()).select(label.cast("boolean").alias("y"), score.alias("s"))
    spread = base.select("y", "s", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    y, hit = F.col("y"), F.col("s") >= F.col("threshold")
    c = spread.groupBy("threshold").agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_sweep(pairs: DataFrame, label: str = "is_positive", score: str = "match_probability", active: float = MATCH_THRESHOLD) -> DataFrame:
    """The fixed thresholds and the active one."""
    return confusion(pairs, F.col(label), F.col(score), [*SWEEP, active])


def score_support(pairs: DataFrame, label: str = "is_positive", score: str = "match_probability", match: float = MATCH_THRESHOLD, review: float = REVIEW_THRESHOLD) -> DataFrame:
    """region, positives, negatives of the three score regions."""
    s = F.col(score)
    region = F.when(s >= match, "match").when(s >= review, "review").otherwise("non_match")
    return pairs.where(s.isNotNull() & F.col(label).isNotNull()).groupBy(region.alias("region")).agg(F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives"))


def score_distribution(pairs: DataFrame, score: str = "match_probability") -> DataFrame:
    names, places = ("0", "1", "2_5", "5", "10", "50", "90", "100"), [0.0, 0.01, 0.025, 0.05, 0.1, 0.5, 0.9, 1.0]
    found = order_statistics(pairs, score, places)
    summary = pairs.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev(score).alias("std"))
    return summary.select("n", "mean", "std", *[F.lit(v).cast("double").alias(f"q{n}") for n, v in zip(names, found, strict=True)])


def b_cubed(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: records, clusters, b3_precision, b3_recall, b3_f1. Records without a prediction are their own cluster.

    Clusters can be large, so overlaps come from counts per (prediction, truth), not from windows over records.
    """
    both = truth.select("record_id", F.col("entity_id").alias("t")).join(predicted.select("record_id", F.col("entity_id").alias("p")), "record_id", "left").withColumn("p", F.coalesce("p", "record_id"))
    cell = both.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    by_p, by_t = cell.groupBy("p").agg(F.sum("n").alias("np")), cell.groupBy("t").agg(F.sum("n").alias("nt"))
    full = cell.join(by_p, "p").join(by_t, "t")
    n2 = F.col("n") * F.col("n")
    total = full.agg(F.sum("n").alias("records"), F.count_distinct("p").alias("clusters"), F.sum(n2 / F.col("np")).alias("a"), F.sum(n2 / F.col("nt")).alias("b"))
    p, r = F.col("a") / F.col("records"), F.col("b") / F.col("records")
    return total.select("records", "clusters", F.round(p, 6).alias("b3_precision"), F.round(r, 6).alias("b3_recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("b3_f1"))


def bin_label(p: Column) -> Column:
    """0.05-wide bins between the thresholds, and the two ends."""
    low = F.greatest(F.floor(p / 0.05) * 0.05, F.lit(REVIEW_THRESHOLD))
    return F.when(p < REVIEW_THRESHOLD, "<0.35").when(p >= MATCH_THRESHOLD, ">=0.84").otherwise(F.format_string("%.2f-%.2f", low, low + 0.05))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, denom = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return F.round(F.greatest(F.lit(0.0), centre - half), 4), F.round(F.least(F.lit(1.0), centre + half), 4)


def calibration(pairs: DataFrame, label: str = "is_positive", score: str = "match_probability") -> DataFrame:
    """bin, n, matches, rate, mean_p, gap, low, high, and whether the rate is not below the bin before."""
    base = pairs.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("bin", bin_label(F.col(score)))
    c = base.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("matches"), F.round(F.avg(score), 4).alias("mean_p"), F.min(score).alias("__low"))
    low, high = wilson(F.col("matches"), F.col("n"))
    rate = F.round(F.col("matches") / F.col("n"), 4)
    c = c.select("*", rate.alias("rate"), low.alias("low"), high.alias("high")).withColumn("gap", F.round(F.col("rate") - F.col("mean_p"), 4))
    before = F.lag("rate").over(Window.orderBy("__low"))  # a row per bin
    return c.withColumn("monotonic", F.coalesce(F.col("rate") >= before, F.lit(True))).drop("__low")


def label_audit(labels: DataFrame, records: DataFrame) -> DataFrame:
    """record ids, is_positive, verdict: labels held against equality of device sets."""
    sets = device_sets(records)
    wide = labels.join(sets.select(F.col("record_id").alias(PAIR[0]), F.col("devices").alias("dl")), PAIR[0], "left").join(sets.select(F.col("record_id").alias(PAIR[1]), F.col("devices").alias("dr")), PAIR[1], "left")
    verdict = F.when(F.col("dl").isNull() | F.col("dr").isNull(), "unverifiable").when(F.col("is_positive") == (F.col("dl") == F.col("dr")), "agrees").otherwise("contradicted")
    return wide.select(*PAIR, "is_positive", verdict.alias("verdict"))


def audit_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("is_positive").pivot("verdict", ["agrees", "contradicted", "unverifiable"]).count().na.fill(0)


def reviewed_violations(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: what reviewed pairs say about entities."""
    look = lambda s: entities.select(F.col("record_id").alias(f"record_id_{s}"), F.col("entity_id").alias(f"e_{s}"))
    j = labels.join(look("l"), "record_id_l", "left").join(look("r"), "record_id_r", "left")
    have = F.col("e_l").isNotNull() & F.col("e_r").isNotNull()
    pos, same = F.col("is_positive"), F.col("e_l") == F.col("e_r")
    bad = j.where(have & ~pos & same).select(F.col("e_l").alias("entity_id")).distinct()
    sizes = entities.join(bad, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    counts = j.agg(F.count(F.lit(1)).alias("reviewed_pairs"), F.count_if(~have).alias("missing"), F.count_if(have & pos).alias("positives"), F.count_if(have & pos & ~same).alias("positives_split"), F.count_if(have & ~pos).alias("negatives"), F.count_if(have & ~pos & same).alias("negatives_merged"))
    implicated = sizes.agg(F.count(F.lit(1)).alias("implicated_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("implicated_records"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_implicated"))
    return counts.crossJoin(implicated)  # one row by one row


def device_reference(entities: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: reference_pairs, reference_pairs_split, mixed_entities, records_without_device."""
    look = lambda s: entities.select(F.col("record_id").alias(f"record_id_{s}"), F.col("entity_id").alias(f"e_{s}"))
    pairs = truth.join(look("l"), "record_id_l").join(look("r"), "record_id_r")
    split = pairs.agg(F.count(F.lit(1)).alias("reference_pairs"), F.count_if(F.col("e_l") != F.col("e_r")).alias("reference_pairs_split"))
    per = _devices(records).join(entities, "record_id").groupBy("entity_id").agg(F.count_distinct("device").alias("n"))
    mixed = per.agg(F.count_if(F.col("n") > 1).alias("mixed_entities"))
    bare = records.select("record_id").join(records_with_device(records), "record_id", "left_anti").agg(F.count(F.lit(1)).alias("records_without_device"))
    return split.crossJoin(mixed).crossJoin(bare)  # single rows


def truth_independence(records: DataFrame) -> DataFrame:
    """One row: most devices of a customer, most customers of a device, one_to_one."""
    ids = records.select("customer_id", F.explode("device_ids_std").alias("device")).where("customer_id is not null and length(device) > 0").distinct()
    per_customer = ids.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("devices_per_customer"))
    per_device = ids.groupBy("device").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("customers_per_device"))
    return per_customer.crossJoin(per_device).withColumn("one_to_one", (F.col("devices_per_customer") == 1) & (F.col("customers_per_device") == 1))  # single rows


def decision_counts(pairs: DataFrame, *by: str, n: Column | None = None) -> DataFrame:
    """Pairs per decision; ``n`` tells how many a row stands for."""
    d, n = F.col("decision"), F.lit(1).cast("long") if n is None else n
    return pairs.groupBy(*by).agg(F.sum(n).alias("pairs"), *[F.sum(F.when(d == v, n).otherwise(0)).alias(v.lower()) for v in ("MATCH", "REVIEW", "NON_MATCH")])


def scenarios(scored: DataFrame, flags: DataFrame) -> DataFrame:
    """Decisions of telling groups of pairs: same e-mail but another name, same name but another date of birth, all agree."""
    return flagged_scenarios(scored.join(flags, PAIR))


def flagged_scenarios(j: DataFrame, n: Column | None = None) -> DataFrame:
    """:func:`scenarios` of pairs that have their decision and their flags; ``n`` tells how many a row stands for."""
    named = F.filter(
        F.array(
            F.when(F.col("agree_email") & ~F.col("agree_name"), "same_email_other_name"),
            F.when(F.col("agree_name") & ~F.col("agree_dob"), "same_name_other_dob"),
            F.when(F.col("agree_email") & F.col("agree_phone") & F.col("agree_dob") & F.col("agree_name"), "all_agree"),
        ),
        lambda x: x.isNotNull(),
    )
    return decision_counts(j.withColumn("scenario", F.explode(named)), "scenario", n=n)


def no_contact(records: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: records without e-mail and phone, and how many of them stand alone."""
    sizes = entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("size"))
    j = records.where("email_std is null and phone_std is null").join(entities, "record_id").join(sizes, "entity_id")
    return j.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("size") == 1).alias("singletons"))


def cross_batch(edges: DataFrame, truth: DataFrame, boundary: str) -> DataFrame:
    """kind, edges, wrong: edges within old records, within new ones, and across (ids from ``boundary`` on are new)."""
    new_l, new_r = F.col("record_id_l") >= boundary, F.col("record_id_r") >= boundary
    kind = F.when(new_l != new_r, "cross").when(new_l, "new_internal").otherwise("old_internal")
    j = edges.select(*PAIR).join(truth.select(*PAIR, F.lit(1).alias("true")), PAIR, "left").withColumn("kind", kind)
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("true").isNull()).alias("wrong"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records in both maps, and how many changed entity."""
    j = before.join(after.select("record_id", F.col("entity_id").alias("now")), "record_id")
    return j.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("entity_id") != F.col("now")).alias("changed"))


def recovery(pairs: DataFrame, edges: DataFrame, ops: str = "ops") -> DataFrame:
    """op, pairs, found: damaged copies that were matched again, per damage."""
    j = pairs.join(edges.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left")
    return j.select("hit", F.explode(F.split(ops, ";")).alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))


def recovery_by_count(pairs: DataFrame, scored: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """damaged, pairs, recovered, never_scored: damaged copies per number of damaged fields."""
    j = pairs.join(scored.select(*PAIR, "match_probability"), PAIR, "left")
    p = F.col("match_probability")
    return j.groupBy("damaged").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(p >= threshold).alias("recovered"), F.count_if(p.isNull()).alias("never_scored"))


def arm(e: DataFrame, name: str) -> DataFrame:
    n = F.col("n")
    return e.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(name).alias("arm"), F.count(F.lit(1)).alias("entities"), F.max("n").alias("largest_entity"), F.count_if(n >= 2).alias("entities_size_ge2"), F.coalesce(F.sum(F.when(n >= 2, n)), F.lit(0)).alias("records_in_multi"))


def canary(entities_a: DataFrame, entities_b: DataFrame) -> DataFrame:
    """arm, entities, largest_entity, entities_size_ge2, records_in_multi of two arms."""
    return arm(entities_a, "a").unionByName(arm(entities_b, "b"))


def threshold_canary(base: DataFrame, lowered: DataFrame, band: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: whether a lower threshold is safe. ``base`` and ``lowered`` are the entity maps of the same scored pairs at both
    thresholds, ``band`` the pairs between them, ``labels`` (record ids, is_positive) what people say.

    The gate: every pair of the band has become one entity; none of them is labelled different; the largest entity has not
    grown; as many entities have gone as the band has pairs; every pair of the band is labelled, and as a match.
    """
    look = lambda s: lowered.select(F.col("record_id").alias(f"record_id_{s}"), F.col("entity_id").alias(f"e_{s}"))
    j = band.select(*PAIR).join(look("l"), PAIR[0], "left").join(look("r"), PAIR[1], "left").join(labels.select(*PAIR, "is_positive"), PAIR, "left")
    seen = j.agg(F.count(F.lit(1)).alias("review_pairs"), F.count_if(F.col("e_l") == F.col("e_r")).alias("merged"), F.count("is_positive").alias("labelled"), F.count_if(~F.col("is_positive")).alias("false_merges"))
    side = lambda e, s: arm(e, s).select(F.col("entities").alias(f"entities_{s}"), F.col("largest_entity").alias(f"largest_{s}"), F.col("records_in_multi").alias(f"in_multi_{s}"))
    one = seen.crossJoin(side(base, "base")).crossJoin(side(lowered, "lowered"))  # single rows
    gate = {
        "review_pairs_merged": F.col("merged") == F.col("review_pairs"),
        "no_false_merge": F.col("false_merges") == 0,
        "largest_entity_not_increased": F.col("largest_lowered") <= F.col("largest_base"),
        "entity_delta_equals_review_pairs": F.col("entities_base") - F.col("entities_lowered") == F.col("review_pairs"),
        "band_all_labelled_match": (F.col("labelled") == F.col("review_pairs")) & (F.col("false_merges") == 0),
    }
    out = one.withColumns(gate)
    whole = F.lit(True)
    for name in gate:
        whole = whole & F.col(name)
    return out.withColumn("verdict", F.when(whole, "PASS").otherwise("FAIL"))


def layers(records: DataFrame, pairs: DataFrame, entities: DataFrame, labels: DataFrame | None = None, threshold: float = MATCH_THRESHOLD, review: float = REVIEW_THRESHOLD) -> DataFrame:
    """layer, metric, value: blocking, linkage, decision and entity, each by what it alone can show. ``pairs`` are all
    candidates, scored; a slice of the records gives the evaluation of that scope."""
    ids = records.select("record_id")
    inside = lambda df: df.join(ids.withColumnRenamed("record_id", PAIR[0]), PAIR[0], "left_semi").join(ids.withColumnRenamed("record_id", PAIR[1]), PAIR[1], "left_semi")
    pairs, truth = inside(pairs), device_truth(records)
    mapped = entities.join(ids, "record_id", "left_semi")
    p = F.col("match_probability")

    def rows(layer: str, one: DataFrame) -> DataFrame:
        metrics = F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
        return one.select(F.explode(metrics).alias("m")).select("m.*")

    hit = truth.join(pairs.select(*PAIR, F.lit(1).alias("hit")).distinct(), PAIR, "left")
    blocking = hit.agg(F.count(F.lit(1)).alias("reference_pairs"), F.count("hit").alias("generated"), F.count_if(F.col("hit").isNull()).alias("never_generated"), F.round(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("recall_ceiling"))
    linkage = truth_scoring(truth, pairs.where(p >= threshold), records_with_device(records))
    decision = pairs.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(p >= threshold).alias("match"), F.count_if((p >= review) & (p < threshold)).alias("review"), F.count_if(p < review).alias("non_match"), F.count_if(p >= 1.0).alias("at_one"))
    sizes = mapped.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") > 1).alias("multi_record_entities"), F.max("n").alias("largest_entity"))
    out = rows("blocking", blocking).unionByName(rows("linkage", linkage)).unionByName(rows("decision", decision)).unionByName(rows("entity", sizes)).unionByName(rows("entity", device_reference(mapped, records, truth)))
    if labels is not None:
        gold = confusion(inside(labels).join(pairs, PAIR).select("is_positive", "match_probability"), F.col("is_positive"), p, [threshold])
        out = out.unionByName(rows("decision", gold.select("tp", "fp", "fn", "tn")))
    return out


def recovered_entities(before: DataFrame, after: DataFrame, records: DataFrame) -> DataFrame:
    """One row: new records whose customer is known from before, and how many are in that customer's entity (of its first old record) now."""
    named = lambda e: e.join(records.select("record_id", "customer_id"), "record_id")
    wanted = named(before).groupBy("customer_id").agg(F.min_by("entity_id", "record_id").alias("wanted"))
    fresh = named(after).join(before.select("record_id"), "record_id", "left_anti").join(wanted, "customer_id")
    return fresh.agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("entity_id") == F.col("wanted")).alias("recovered"))
