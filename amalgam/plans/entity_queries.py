"""Entities, golden records, evaluation, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..config import BLOCKING_RULES, MASTER_FIELDS, MATCH_THRESHOLD, SWEEP
from ..crm import standardized
from ..functions import text as T
from ..graph import connected_components
from ..operators import blocking, codes, comparison, entities, evaluate, labels, model, stress, survivorship
from ..operators.standardize import blocking_keys
from ..ranking import keep_last
from ..sources import database, serving
from ..storage import materialize
from ..streaming import incremental
from .pair_queries import DECISION_SQL, FIXED, FLAGS_SQL, SCORED_CTE, SILVER_CTE, TRUTH_CTE, scored_pairs, written
from .registry import components_cte, pairs_cte, query, rule_sql, std, table

PAIR = blocking.PAIR

#: Pairs with two or more agreements are matches: an entity map that needs no trained model.
SIMPLE_RULES = (("email", ("email_std",)), ("phone", ("phone_std",)))
_EDGES = f"""{pairs_cte(SIMPLE_RULES, "cand")}, edges AS (SELECT record_id_l AS a, record_id_r AS b FROM cand JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r
    WHERE coalesce(l.email_std = r.email_std, false)::INT + coalesce(l.phone_std = r.phone_std, false)::INT + coalesce(l.dob_std = r.dob_std, false)::INT + coalesce(l.last_name_std = r.last_name_std, false)::INT >= 2)"""
_MAP = f"{_EDGES}, {components_cte('edges', 'std')}, emap AS (SELECT record_id, 'ent_' || printf('%06d', dense_rank() OVER (ORDER BY root)) AS entity_id FROM comp)"
_FRAME = f"{_MAP}, frame AS (SELECT s.*, entity_id FROM std s JOIN emap USING (record_id))"


def simple_edges(records):
    pairs = blocking.attach(blocking.or_join(records, SIMPLE_RULES).select(*PAIR), records, ["email_std", "phone_std", "dob_std", "last_name_std"])
    agree = lambda c: F.coalesce(F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False)).cast("int")
    return pairs.where(agree("email_std") + agree("phone_std") + agree("dob_std") + agree("last_name_std") >= 2).select(*PAIR)


def simple_map(spark, d):
    """Records, their edges and their entity map, each written once."""
    records = materialize(standardized(spark, d), "q-records")
    edges = materialize(simple_edges(records), "q-edges")
    return records, edges, materialize(entities.cluster(records, edges), "q-entities")


def frame_of(spark, d):
    records, _, mapped = simple_map(spark, d)
    return records.join(mapped, "record_id")


@query(std(f"{_MAP} SELECT record_id, entity_id FROM emap"))
def entity_map(spark, d):
    return simple_map(spark, d)[2]


@query(std(f'{_MAP}, s AS (SELECT count(*) AS n FROM emap GROUP BY entity_id) SELECT n AS "size", count(*) AS entities FROM s GROUP BY 1'))
def entity_sizes(spark, d):
    return entities.size_histogram(simple_map(spark, d)[2])


@query(std(f"{_MAP}, s AS (SELECT count(*) AS n FROM emap GROUP BY entity_id) SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS entities, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, CAST(sum(n) - count(*) AS BIGINT) AS merged, count(*) FILTER (n >= 2) AS entities_ge2, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS records_in_multi FROM s"))
def entity_summary(spark, d):
    return entities.summary(simple_map(spark, d)[2])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CAST(user_id + (event_id % 7) * 13 AS BIGINT) AS b FROM events), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    n AS (SELECT DISTINCT a FROM w), reach AS (SELECT a AS node, a AS r FROM n UNION SELECT node, b FROM reach JOIN w ON a = r) SELECT node, min(r) AS component FROM reach GROUP BY 1""")
def graph_components(spark, d):
    """Components over the edges of all events."""
    return connected_components(table(spark, d, "events").select(F.col("user_id").alias("a"), (F.col("user_id") + F.col("event_id") % 7 * 13).alias("b")))


_GUARD = f"""{SCORED_CTE}, dec AS (SELECT record_id_l, record_id_r, {DECISION_SQL} AS decision FROM scored), edges AS (SELECT record_id_l AS a, record_id_r AS b FROM dec WHERE decision = 'MATCH'), {components_cte("edges", "std")},
    emap AS (SELECT record_id, root, 'ent_' || printf('%06d', dense_rank() OVER (ORDER BY root)) AS entity_id FROM comp), s AS (SELECT root, count(*) AS n FROM emap GROUP BY 1),
    bad AS (SELECT DISTINCT a.root FROM dec JOIN emap a ON a.record_id = record_id_l JOIN emap b ON b.record_id = record_id_r WHERE decision = 'NON_MATCH' AND a.root = b.root)
    SELECT record_id, CASE WHEN n > 1 AND (n > 5 OR bad.root IS NOT NULL) THEN 'ent_' || record_id ELSE entity_id END AS entity_id, CASE WHEN n > 1 AND (n > 5 OR bad.root IS NOT NULL) THEN 'REVIEW' WHEN n > 1 THEN 'MATCHED' ELSE 'SINGLETON' END AS cluster_status
    FROM emap JOIN s USING (root) LEFT JOIN bad USING (root)"""


@query(std(_GUARD))
def guarded_clusters(spark, d):
    return entities.guarded_cluster_of(written(spark, d), FIXED)


_SCORE = "length(regexp_replace(value, '[^0-9]', '', 'g')) * CASE WHEN field IN ('dob_std', 'phone_std', 'email_std', 'address_std') THEN 0 ELSE 1 END + length(regexp_replace(value, '[a-z\\s''’-]', '', 'g')) * CASE WHEN field IN ('dob_std', 'phone_std', 'email_std') THEN 0 ELSE 1 END"
_LONG = f"{_FRAME}, long AS (" + " UNION ALL ".join(f"SELECT entity_id, '{f}' AS field, {f} AS value FROM frame WHERE {f} IS NOT NULL" for f in MASTER_FIELDS) + f"), vals AS (SELECT entity_id, field, value, count(*) AS n, CAST({_SCORE} AS INTEGER) AS corruption FROM long GROUP BY ALL)"


@query(std(f"{_LONG}, top AS (SELECT entity_id, field, value FROM vals QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY n DESC, corruption, value) = 1) SELECT e.entity_id, " + ", ".join(f"max(value) FILTER (field = '{f}') AS master_{f}" for f in MASTER_FIELDS) + " FROM (SELECT DISTINCT entity_id FROM emap) e LEFT JOIN top USING (entity_id) GROUP BY 1"))
def master_values(spark, d):
    return survivorship.master_values(frame_of(spark, d))


@query(std(f"{_LONG} SELECT entity_id, field, value, n, corruption FROM vals"))
def field_values(spark, d):
    return survivorship.field_values(frame_of(spark, d))


@query(std(f"{_FRAME} SELECT entity_id, count(DISTINCT record_id) AS record_count, array_to_string(list_sort(list(record_id)), ',') AS record_ids, array_to_string(list_sort(list(DISTINCT customer_id)), ',') AS customer_ids, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM frame GROUP BY 1"))
def master_lineage(spark, d):
    j = lambda c: F.array_join(c, ",").alias(c)
    return survivorship.lineage(frame_of(spark, d)).select("entity_id", "record_count", j("record_ids"), j("customer_ids"), j("sources"))


@query(std(f"{_LONG}, c AS (SELECT entity_id, field FROM vals GROUP BY 1, 2 HAVING count(*) > 1) SELECT e.entity_id, coalesce(string_agg(field, ',' ORDER BY field), '') AS conflicted_fields FROM (SELECT DISTINCT entity_id FROM emap) e LEFT JOIN c USING (entity_id) GROUP BY 1"))
def master_conflicts(spark, d):
    return survivorship.conflicts(frame_of(spark, d)).select("entity_id", F.array_join("conflicted_fields", ",").alias("conflicted_fields"))


@query(std(f"{_LONG} SELECT entity_id, field, value, n AS records, count(*) OVER (PARTITION BY entity_id, field) AS distinct_values FROM vals QUALIFY count(*) OVER (PARTITION BY entity_id, field) > 1"))
def conflict_values(spark, d):
    return survivorship.conflict_values(frame_of(spark, d))


_NN = " + ".join(f"({f} IS NOT NULL)::INT" for f in MASTER_FIELDS)


@query(std(f"{_FRAME}, o AS (SELECT *, {_NN} AS k FROM frame) SELECT entity_id, " + ", ".join(f"arg_min({f}, (-k, record_id)) FILTER ({f} IS NOT NULL) AS {f}" for f in MASTER_FIELDS) + ", count(*) AS record_count FROM o GROUP BY 1"))
def master_most_complete(spark, d):
    return survivorship.most_complete(frame_of(spark, d)).drop("record_ids")


@query(std(f"{_LONG}, c AS (SELECT entity_id, count(*) > 0 AS bad FROM (SELECT entity_id, field FROM vals GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) SELECT coalesce(CASE WHEN bad THEN 'CONFLICTED' END, 'CONFIRMED') AS status, count(*) AS entities FROM (SELECT DISTINCT entity_id FROM emap) LEFT JOIN c USING (entity_id) GROUP BY 1"))
def master_status(spark, d):
    return survivorship.master(frame_of(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("entities"))


# Evaluation.
_LAB = "(SELECT doc_id, quality = 1 AS y, CAST((doc_id * 37 + quality * 400) % 1000 AS DOUBLE) / 1000 AS s FROM labels)"


def scored_labels(spark, d):
    """Labels with a made-up score that goes with them."""
    score = ((F.col("doc_id") * 37 + F.col("quality") * 400) % 1000).cast("double") / 1000
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_positive"), score.alias("match_probability"))


def _sweep_sql(thresholds):
    rows = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in thresholds)
    return f"""WITH c AS (SELECT threshold, count(*) FILTER (y AND s >= threshold) AS tp, count(*) FILTER (NOT y AND s >= threshold) AS fp, count(*) FILTER (y AND s < threshold) AS fn, count(*) FILTER (NOT y AND s < threshold) AS tn
        FROM {_LAB}, (VALUES {rows}) t(threshold) GROUP BY 1) SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0.0 END AS f1 FROM c"""


@query(_sweep_sql([*SWEEP, 0.84]))
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(scored_labels(spark, d))


@query(f"SELECT CASE WHEN s >= 0.84 THEN 'match' WHEN s >= 0.35 THEN 'review' ELSE 'non_match' END AS region, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives FROM {_LAB} GROUP BY 1")
def score_support(spark, d):
    return evaluate.score_support(scored_labels(spark, d))


@query(f"SELECT count(s) AS n, round(avg(s), 9) AS mean, round(stddev_samp(s), 9) AS std, " + ", ".join(f"round(quantile_cont(s, {q}), 9) AS q{n}" for q, n in ((0, "0"), (0.01, "1"), (0.025, "2_5"), (0.05, "5"), (0.1, "10"), (0.5, "50"), (0.9, "90"), (1, "100"))) + f" FROM {_LAB}")
def score_distribution(spark, d):
    out = evaluate.score_distribution(scored_labels(spark, d))
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(f"""WITH b AS (SELECT *, CASE WHEN s < 0.35 THEN '<0.35' WHEN s >= 0.84 THEN '>=0.84' ELSE printf('%.2f-%.2f', greatest(floor(s / 0.05::DOUBLE) * 0.05::DOUBLE, 0.35), greatest(floor(s / 0.05::DOUBLE) * 0.05::DOUBLE, 0.35) + 0.05) END AS bin FROM {_LAB})
    SELECT bin, count(*) AS n, count(*) FILTER (y) AS matches, round(avg(s), 4) AS mean_p, round(count(*) FILTER (y) / count(*), 4) AS rate FROM b GROUP BY 1""")
def calibration_bins(spark, d):
    return evaluate.calibration(scored_labels(spark, d)).select("bin", "n", "matches", "mean_p", "rate")


@query(std(f"{SCORED_CTE}, {TRUTH_CTE}, e AS (SELECT record_id_l, record_id_r FROM scored WHERE match_probability >= 0.84), c AS (SELECT count(*) AS match_edges, count(t.record_id_l) AS hit FROM e LEFT JOIN truth t USING (record_id_l, record_id_r)), n AS (SELECT count(*) AS truth_pairs FROM truth) SELECT truth_pairs, hit AS matched_truth_pairs, truth_pairs - hit AS missed_truth_pairs, match_edges, match_edges - hit AS false_merges, CAST(0 AS BIGINT) AS unverifiable_edges, CASE WHEN truth_pairs > 0 THEN round(hit / truth_pairs, 4) END AS recall, CASE WHEN match_edges > 0 THEN round(hit / match_edges, 4) END AS \"precision\" FROM c, n"))
def truth_scoring(spark, d):
    records, edges = scored_pairs(spark, d, at_least=MATCH_THRESHOLD)
    return evaluate.truth_scoring(evaluate.device_truth(records), materialize(edges.select(*PAIR), "q-edges"), evaluate.records_with_device(records))


@query(std(f"{_MAP}, x AS (SELECT entity_id AS p, device_ids AS t, count(*) AS n FROM emap JOIN std USING (record_id) GROUP BY 1, 2), y AS (SELECT n, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY t) AS nt, p FROM x), z AS (SELECT sum(n) AS records, count(DISTINCT p) AS clusters, sum(n * n / np) / sum(n) AS bp, sum(n * n / nt) / sum(n) AS br FROM y) SELECT CAST(records AS BIGINT) AS records, clusters, round(bp, 6) AS b3_precision, round(br, 6) AS b3_recall, round(2 * bp * br / (bp + br), 6) AS b3_f1 FROM z"))
def b_cubed(spark, d):
    records, _, mapped = simple_map(spark, d)
    return evaluate.b_cubed(mapped, records.select("record_id", F.element_at("device_ids_std", 1).alias("entity_id")))


@query(std(f"{SILVER_CTE} SELECT record_id_l, record_id_r, label = 1 AS is_positive, CASE WHEN (label = 1) = (l.device_ids = r.device_ids) THEN 'agrees' ELSE 'contradicted' END AS verdict FROM silver JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r"))
def label_audit(spark, d):
    records = standardized(spark, d)
    return evaluate.label_audit(labels.silver(records).select(*PAIR, (F.col("label") == 1).alias("is_positive")), records)


@query(std(f"{_MAP}, {SILVER_CTE}, j AS (SELECT label = 1 AS pos, a.entity_id AS ea, b.entity_id AS eb FROM silver JOIN emap a ON a.record_id = record_id_l JOIN emap b ON b.record_id = record_id_r), bad AS (SELECT DISTINCT ea FROM j WHERE NOT pos AND ea = eb), s AS (SELECT entity_id, count(*) AS n FROM emap WHERE entity_id IN (SELECT ea FROM bad) GROUP BY 1) SELECT * FROM (SELECT count(*) AS reviewed_pairs, CAST(0 AS BIGINT) AS missing, count(*) FILTER (pos) AS positives, count(*) FILTER (pos AND ea <> eb) AS positives_split, count(*) FILTER (NOT pos) AS negatives, count(*) FILTER (NOT pos AND ea = eb) AS negatives_merged FROM j), (SELECT count(*) AS implicated_entities, CAST(coalesce(sum(n), 0) AS BIGINT) AS implicated_records, coalesce(max(n), 0) AS largest_implicated FROM s)"))
def reviewed_violations(spark, d):
    records, _, mapped = simple_map(spark, d)
    return evaluate.reviewed_violations(mapped, labels.silver(records).select(*PAIR, (F.col("label") == 1).alias("is_positive")))


@query(std(f"{_MAP}, {TRUTH_CTE} SELECT * FROM (SELECT count(*) AS reference_pairs, count(*) FILTER (a.entity_id <> b.entity_id) AS reference_pairs_split FROM truth JOIN emap a ON a.record_id = record_id_l JOIN emap b ON b.record_id = record_id_r), (SELECT count(*) FILTER (n > 1) AS mixed_entities FROM (SELECT count(DISTINCT device_ids) AS n FROM emap JOIN std USING (record_id) GROUP BY entity_id)), (SELECT CAST(0 AS BIGINT) AS records_without_device)"))
def device_reference(spark, d):
    records, _, mapped = simple_map(spark, d)
    return evaluate.device_reference(mapped, records, evaluate.device_truth(records))


@query(std("SELECT (SELECT max(n) FROM (SELECT count(DISTINCT device_ids) AS n FROM std GROUP BY customer_id)) AS devices_per_customer, (SELECT max(n) FROM (SELECT count(DISTINCT customer_id) AS n FROM std GROUP BY device_ids)) AS customers_per_device, true AS one_to_one"))
def truth_independence(spark, d):
    return evaluate.truth_independence(standardized(spark, d))


@query(std(f"{SCORED_CTE}, j AS (SELECT {DECISION_SQL} AS decision, {FLAGS_SQL} FROM scored JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r), n AS (SELECT decision, unnest(list_filter([CASE WHEN agree_email AND NOT agree_name THEN 'same_email_other_name' END, CASE WHEN agree_name AND NOT agree_dob THEN 'same_name_other_dob' END, CASE WHEN agree_email AND agree_phone AND agree_dob AND agree_name THEN 'all_agree' END], lambda x: x IS NOT NULL)) AS scenario FROM j) SELECT scenario, count(*) AS pairs, count(*) FILTER (decision = 'MATCH') AS match, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'NON_MATCH') AS non_match FROM n GROUP BY 1"))
def scenario_decisions(spark, d):
    return evaluate.flagged_scenarios(codes.decided_flags(written(spark, d), FIXED), F.col("n"))


@query(std(f"{_MAP}, s AS (SELECT entity_id, count(*) AS n FROM emap GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (n = 1) AS singletons FROM std JOIN emap USING (record_id) JOIN s USING (entity_id) WHERE email_std IS NULL AND phone_std IS NULL"))
def no_contact(spark, d):
    records, _, mapped = simple_map(spark, d)
    return evaluate.no_contact(records, mapped)


@query(std(f"{_EDGES}, {TRUTH_CTE}, k AS (SELECT a, b, (a >= 'rec_001000') AS na, (b >= 'rec_001000') AS nb FROM edges) SELECT CASE WHEN na <> nb THEN 'cross' WHEN na THEN 'new_internal' ELSE 'old_internal' END AS kind, count(*) AS edges, count(*) FILTER (t.record_id_l IS NULL) AS wrong FROM k LEFT JOIN truth t ON a = record_id_l AND b = record_id_r GROUP BY 1"))
def cross_batch(spark, d):
    records = standardized(spark, d)
    return evaluate.cross_batch(simple_edges(records), evaluate.device_truth(records), "rec_001000")


def _damaged(spark, d):
    """Damaged copies with their originals, and those of these pairs that the blocking rules make, scored."""
    records = materialize(standardized(spark, d), "q-records")
    copies = materialize(stress.damaged_copies(records), "q-copies")
    both = materialize(blocking_keys(records.unionByName(copies.select(records.columns))), "q-both")
    made = copies.select(F.least("record_id", "copy_of").alias(PAIR[0]), F.greatest("record_id", "copy_of").alias(PAIR[1]), "ops", "damaged")
    # whether a rule makes such a pair is told by the pair's own keys
    need = [*blocking.rule_keys(BLOCKING_RULES), *comparison.needed_columns(comparison.static_comparisons())]
    wanted = blocking.attach(made.select(*PAIR), both, need).where(blocking.any_rule(BLOCKING_RULES))
    return made, materialize(model.score_wide(wanted, FIXED).select(*PAIR, "match_probability"), "q-damaged")


@query(None)
def recovery_by_corruption(spark, d):
    """How many damaged copies match their original by the model, per damage."""
    made, scored = _damaged(spark, d)
    return evaluate.recovery(made.where("ops <> 'none'"), scored.where(F.col("match_probability") >= MATCH_THRESHOLD))


@query(None)
def recovery_by_damaged_fields(spark, d):
    """The same per number of damaged fields."""
    return evaluate.recovery_by_count(*_damaged(spark, d))


# Incremental runs: records of the last tenth of the ids are new.
_NEW = "record_id > (SELECT 'rec_' || printf('%06d', count(*) * 9 // 10) FROM customer)"


def _is_new(records):
    cut = records.count() * 9 // 10
    return F.col("record_id") > f"rec_{cut:06d}"


@query(std(f"new AS (SELECT * FROM std WHERE {_NEW}), old AS (SELECT * FROM std WHERE NOT {_NEW}) SELECT DISTINCT o.record_id FROM old o JOIN new n ON o.email_std = n.email_std UNION SELECT DISTINCT o.record_id FROM old o JOIN new n ON o.phone_std = n.phone_std"))
def incremental_candidates(spark, d):
    records = standardized(spark, d)
    new = _is_new(records)
    return blocking.touching_old_rows(records.where(new), records.where(~new), SIMPLE_RULES).select("record_id")


_INC = f"""{_EDGES}, oldr AS (SELECT record_id FROM std WHERE NOT {_NEW}), olde AS (SELECT a, b FROM edges WHERE a IN (FROM oldr) AND b IN (FROM oldr)),
    ow AS (SELECT a, b FROM olde UNION SELECT b, a FROM olde), oreach AS (SELECT record_id, record_id AS r FROM oldr UNION SELECT record_id, b FROM oreach JOIN ow ON a = r), oroot AS (SELECT record_id, min(r) AS root FROM oreach GROUP BY 1),
    omap AS (SELECT record_id, 'ent_' || printf('%06d', dense_rank() OVER (ORDER BY root)) AS entity_id FROM oroot),
    inew AS (SELECT record_id FROM std WHERE {_NEW}), ie AS (SELECT a, b FROM edges WHERE a IN (FROM inew) OR b IN (FROM inew)),
    node AS (SELECT record_id, 'e:' || entity_id AS node FROM omap UNION ALL SELECT record_id, 'r:' || record_id FROM inew),
    nl AS (SELECT x.node AS a, y.node AS b FROM ie JOIN node x ON x.record_id = a JOIN node y ON y.record_id = b), nw AS (SELECT a, b FROM nl UNION SELECT b, a FROM nl),
    nreach AS (SELECT node, node AS r FROM (SELECT DISTINCT node FROM node) UNION SELECT nreach.node, b FROM nreach JOIN nw ON a = r), nroot AS (SELECT node, min(r) AS root FROM nreach GROUP BY 1),
    fresh AS (SELECT root, row_number() OVER (ORDER BY min(record_id)) AS k FROM node JOIN nroot USING (node) WHERE root LIKE 'r:%' GROUP BY 1)"""
_INC_MAP = f"{_INC}, imap AS (SELECT record_id, CASE WHEN root LIKE 'e:%' THEN substr(root, 3) ELSE 'ent_' || printf('%06d', k + (SELECT count(DISTINCT entity_id) FROM omap)) END AS entity_id FROM node JOIN nroot USING (node) LEFT JOIN fresh USING (root))"


def _incremental(spark, d):
    records = materialize(standardized(spark, d), "q-records")
    new = _is_new(records)
    old_records, new_records = records.where(~new), records.where(new)
    before = materialize(entities.cluster(old_records, simple_edges(old_records)), "q-before")
    edges = simple_edges(records)
    ids = new_records.select("record_id")
    touched = materialize(incremental.touching_edges(edges, ids), "q-touched")
    return before, new_records, touched, materialize(entities.incremental_cluster(before, ids, touched), "q-after")


@query(std(f"{_INC_MAP} SELECT record_id, entity_id FROM imap"))
def incremental_entity_map(spark, d):
    return _incremental(spark, d)[3]


@query(std(f"{_INC_MAP} SELECT i.entity_id AS into_entity, string_agg(DISTINCT o.entity_id, ',' ORDER BY o.entity_id) AS entities FROM omap o JOIN imap i USING (record_id) GROUP BY 1 HAVING count(DISTINCT o.entity_id) > 1"))
def merge_events(spark, d):
    before, _, _, after = _incremental(spark, d)
    return entities.merge_events(before, after).select(F.col("into").alias("into_entity"), F.array_join("entities", ",").alias("entities"))


@query(std(f"{_INC_MAP} SELECT count(*) AS records, count(*) FILTER (o.entity_id <> i.entity_id) AS changed FROM omap o JOIN imap i USING (record_id)"))
def entity_drift(spark, d):
    before, _, _, after = _incremental(spark, d)
    return evaluate.drift(before, after)


@query("SELECT event_id, ts, user_id FROM events WHERE ts > (SELECT quantile_disc(ts, 0.5) FROM events)")
def watermark_fetch(spark, d):
    e = table(spark, d, "events")
    middle = e.orderBy("ts").offset((e.count() + 1) // 2 - 1).limit(1).first().ts
    return database.fetch(e, "ts", middle).select("event_id", "ts", "user_id")


@query("SELECT max(ts) AS latest, arg_max(event_id, (ts, event_id)) AS last_pk FROM events")
def latest_watermark(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_pk"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 0")
def append_dedup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.append_new(o.where("o_orderkey % 3 <> 0"), o.withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.replace_rows(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("R")), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'U', NULL FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 8 = 1")
def upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 4 = 0 or o_orderkey % 8 = 1").select("o_orderkey", F.lit("U").alias("o_orderstatus"))
    return sinks.upsert(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 4 = 0 THEN 'o_orderpriority' END) AS changed FROM orders")
def changed_fields(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("o_orderstatus_old"), F.col("o_orderpriority").alias("o_orderpriority_old"))
    o = o.withColumn("o_orderstatus_new", F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.upper("o_orderstatus_old"))).withColumn("o_orderpriority_new", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "o_orderpriority_old")))
    return o.select("o_orderkey", F.array_join(T.changed_fields(["o_orderstatus", "o_orderpriority"]), ",").alias("changed"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_last_feedback(spark, d):
    return keep_last(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R') g WHERE g.a = least(l.l_partkey, l.l_suppkey) AND g.b = greatest(l.l_partkey, l.l_suppkey))")
def pair_anti_join(spark, d):
    li = table(spark, d, "lineitem")
    q = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias(PAIR[0]), F.col("l_suppkey").alias(PAIR[1]))
    gold = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias(PAIR[0]), F.col("l_partkey").alias(PAIR[1]))
    return labels.exclude_gold(q, gold).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def exists_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query(std(f"{_EDGES}, n AS (SELECT l.record_id AS a, r.record_id AS b FROM std l JOIN std r ON l.phone_std = r.phone_std WHERE l.record_id < r.record_id), c AS ((SELECT a, b FROM edges EXCEPT SELECT a, b FROM n) UNION ALL (SELECT a, b FROM n EXCEPT SELECT a, b FROM edges)), {components_cte('edges', 'std').replace('comp AS', 'comp AS')}, emap AS (SELECT record_id, 'ent_' || printf('%06d', dense_rank() OVER (ORDER BY root)) AS entity_id FROM comp) SELECT DISTINCT record_id, entity_id FROM (SELECT a AS record_id FROM c UNION SELECT b FROM c) JOIN emap USING (record_id)"))
def lost_gained_edges(spark, d):
    records, edges, mapped = simple_map(spark, d)
    return entities.stale_records(edges, blocking.rule_pairs(records, ("phone_std",)).select(*PAIR), mapped)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def evidence_json_roundtrip(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    q = e.select(F.col("event_id").cast("string").alias(PAIR[0]), F.lit("~").alias(PAIR[1]), F.col("event_id").alias("review_id"), F.col("value").alias("match_probability"), F.to_json(F.struct("k")).alias("evidence"))
    return serving.load_queue(q, ["k"]).select(F.col("review_id").alias("event_id"), F.col("k").cast("long").alias("k"))


@query("SELECT CASE WHEN event_id % 7 > event_id % 5 THEN event_id % 5 ELSE event_id % 7 END AS record_id_l, CASE WHEN event_id % 7 > event_id % 5 THEN event_id % 7 ELSE event_id % 5 END AS record_id_r, CASE WHEN event_id % 7 > event_id % 5 THEN 'r' ELSE 'l' END AS side_l, event_id FROM events")
def canonical_pairs(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 7).alias("record_id_l"), (F.col("event_id") % 5).alias("record_id_r"), F.lit("l").alias("side_l"), F.lit("r").alias("side_r"), "event_id")
    return labels.canonical(e).drop("side_r")


@query(std(f"{_MAP} SELECT record_id, entity_id, customer_id, source FROM emap JOIN std USING (record_id)"))
def membership(spark, d):
    records, _, mapped = simple_map(spark, d)
    return sinks.membership_rows(mapped, records)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_rows(spark, d):
    return serving.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 20)


@query(std("SELECT record_id, first_name, last_name FROM std WHERE contains(lower(first_name), 'bl') OR contains(lower(last_name), 'bl') ORDER BY record_id LIMIT 20"))
def search_records(spark, d):
    return serving.search(standardized(spark, d), "BL", ["first_name", "last_name"]).select("record_id", "first_name", "last_name")


@query(std(f"{SCORED_CTE}, c AS (SELECT CASE WHEN record_id_l = 'rec_000010' THEN record_id_r ELSE record_id_l END AS other, match_probability AS p FROM scored WHERE record_id_l = 'rec_000010' OR record_id_r = 'rec_000010') SELECT other, round(p, 6) AS match_probability FROM c ORDER BY p DESC, other LIMIT 50"))
def candidates_of_record(spark, d):
    need = comparison.needed_columns(comparison.static_comparisons())
    pairs = model.score_wide(blocking.pairs_of(written(spark, d), "rec_000010", FIXED.rules, need), FIXED)
    return serving.candidates_of(pairs, "rec_000010").select("other", F.round("match_probability", 6).alias("match_probability"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, round(avg(value), 6) AS value FROM events GROUP BY 1")
def metric_windows(spark, d):
    e = table(spark, d, "events").withColumn("timestamp", F.col("ts"))
    return incremental.metric_windows(e, ["value"]).select(F.col("window.start").alias("window_start"), F.round("value", 6).alias("value"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    from ..operators.profile import status_counts as count

    return count(table(spark, d, "events"), "event_type")


@query(std(f"{_INC_MAP}, e1 AS (SELECT 'a' AS arm, entity_id, count(*) AS n FROM omap GROUP BY 2), e2 AS (SELECT 'b' AS arm, entity_id, count(*) AS n FROM imap GROUP BY 2), u AS (FROM e1 UNION ALL FROM e2) SELECT arm, count(*) AS entities, max(n) AS largest_entity, count(*) FILTER (n >= 2) AS entities_size_ge2, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS records_in_multi FROM u GROUP BY 1"))
def canary_arms(spark, d):
    before, _, _, after = _incremental(spark, d)
    return evaluate.canary(before, after)


_ALT = rule_sql(("last_name_std", "city_std"))


@query(std(f"{SCORED_CTE}, alt AS ({_ALT}) SELECT record_id_l, record_id_r, 'outside_blocking_last_city' AS stratum FROM alt a WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.record_id_l = a.record_id_l AND s.record_id_r = a.record_id_r) AND record_id_l <> 'rec_000001' ORDER BY md5(record_id_l || '__' || record_id_r), 1, 2 LIMIT 40"))
def outside_blocking_sample(spark, d):
    records = written(spark, d)
    gold = materialize(blocking.rule_pairs(records, ("last_name_std", "city_std")).where("record_id_l = 'rec_000001'").select(*PAIR), "q-gold")
    return labels.outside_blocking(records, None, gold, (("last_city", ("last_name_std", "city_std")),), 40, FIXED.rules)
