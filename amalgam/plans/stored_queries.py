"""Labels, queues, stored tables, edits of entities, diagnostics and sources."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .. import sinks
from ..config import BLOCKING_RULES, DB_COLUMN_MAP, MASTER_FIELDS, MATCH_THRESHOLD, load_rules
from ..crm import soundex_sql, standardized
from ..functions import text as T
from ..operators import blocking, comparison, decide, entities, evaluate, labels, model, profile, standardize, stress, survivorship
from ..ranking import keep_last
from ..sources import database, files, serving
from ..sources.registry import Registry
from ..storage import materialize, work_base
from ..streaming import incremental
from .entity_queries import _EDGES, _FRAME, _INC, _INC_MAP, _LONG, _MAP, _NEW, SIMPLE_RULES, _incremental, frame_of, simple_edges, simple_map
from .pair_queries import DECISION_SQL, FIXED, GAMMA_SQL, SCORED_CTE, SILVER_CTE, TRUTH_CTE, gamma_cte, indel_sql, scored_pairs, weight_sql, written
from .registry import components_cte, pairs_cte, query, rule_sql, std, table

PAIR = blocking.PAIR

#: Candidates of two rules with a made-up score and made-up answers of people.
_MADE = f"""{pairs_cte(SIMPLE_RULES, "cand")}, num AS (SELECT record_id_l, record_id_r, CAST(substr(record_id_l, 5) AS BIGINT) AS nl, CAST(substr(record_id_r, 5) AS BIGINT) AS nr FROM cand),
    made AS (SELECT *, CAST((nl * 37 + nr * 11) % 1000 AS DOUBLE) / 1000 AS match_probability FROM num), dec AS (SELECT *, {DECISION_SQL} AS decision FROM made),
    gold AS (SELECT *, CASE (nl + nr) % 4 WHEN 0 THEN 'Match' WHEN 1 THEN 'Beda-Orang' WHEN 2 THEN 'yes' ELSE 'no' END AS raw, (nl + nr) % 4 IN (0, 2) AS is_positive FROM dec WHERE nl % 3 <> 0)"""


def number(c):
    return F.substring(c, 5, 20).try_cast("long")


def made_pairs(records):
    nl, nr = number(PAIR[0]), number(PAIR[1])
    pairs = blocking.or_join(records, SIMPLE_RULES).select(*PAIR, nl.alias("nl"), nr.alias("nr"))
    pairs = pairs.withColumn("match_probability", ((F.col("nl") * 37 + F.col("nr") * 11) % 1000).cast("double") / 1000)
    return pairs.withColumn("decision", decide.decision(F.col("match_probability")))


def made_gold(pairs):
    """Answers with words of either vocabulary, the sides of every second pair changed."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("Match", "Beda-Orang", "yes", "no")]), ((F.col("nl") + F.col("nr")) % 4 + 1).cast("int"))
    swap = F.col("nl") % 2 == 0
    l, r = F.when(swap, F.col(PAIR[1])).otherwise(F.col(PAIR[0])), F.when(swap, F.col(PAIR[0])).otherwise(F.col(PAIR[1]))
    return pairs.where("nl % 3 <> 0").select(l.alias(PAIR[0]), r.alias(PAIR[1]), word.alias("label"), "nl", "nr", F.col("nl").alias("seq"), F.lit("ann").alias("reviewer"), F.lit("reviewed").alias("review_status"))


def made(spark, d):
    records = written(spark, d)
    pairs = materialize(made_pairs(records), "q-made")
    return records, pairs, made_gold(pairs)


# Labels.
@query(std(f"{_MADE} SELECT record_id_l, record_id_r, is_positive FROM gold"))
def gold_labels(spark, d):
    return labels.load_labels(made(spark, d)[2])


@query(std(f"{_MADE} SELECT count(*) AS gold_rows, count(*) FILTER (nl % 2 = 0) AS matched_in_preds, count(*) FILTER (nl % 2 <> 0) AS missing_pairs, count(*) FILTER (nl % 10 = 1) AS bad_labels FROM gold"))
def gold_validation(spark, d):
    _, pairs, gold = made(spark, d)
    gold = gold.withColumn("label", F.when(F.col("nl") % 10 == 1, "who knows").otherwise(F.col("label")))
    return labels.validate_gold(gold, pairs.where("nl % 2 = 0"))


def _answers(gold):
    """Every fifth answer taken back later."""
    later = gold.where("nl % 5 = 0").withColumns({"label": F.when(T.label_of(F.col("label")) == "match", "no").otherwise("yes"), "seq": F.col("seq") + 1_000_000})
    return gold.unionByName(later)


_PROMOTED = std(f"{_MADE} SELECT record_id_l, record_id_r, CASE WHEN is_positive <> (nl % 5 = 0) THEN 'match' ELSE 'no_match' END AS label FROM gold")


@query(_PROMOTED)
def promoted_gold(spark, d):
    return labels.promote(_answers(made(spark, d)[2])).select(*PAIR, "label")


@query(_PROMOTED)
def stored_gold(spark, d):
    return sinks.gold_rows(_answers(made(spark, d)[2]), "seq").select(*PAIR, "label")


@query(std(f"{_MADE} SELECT d.record_id_l, d.record_id_r, raw AS label, CASE WHEN raw IS NULL THEN 'pending' ELSE 'reviewed' END AS review_status, CASE WHEN raw IS NULL THEN NULL ELSE 'ann' END AS reviewer FROM dec d LEFT JOIN gold g USING (record_id_l, record_id_r)"))
def carried_labels(spark, d):
    _, pairs, gold = made(spark, d)
    none = F.lit(None).cast("string")
    queue = pairs.select(*PAIR, none.alias("label"), F.lit("pending").alias("review_status"), none.alias("reviewer"))
    return labels.carry_over(queue, gold, ("label", "review_status", "reviewer"))


_FEEDBACK = "fb AS (SELECT record_id_l || '__' || record_id_r AS pair_id, match_probability AS score, decision, raw AS human_label, 'v1' AS model_version, nl FROM gold)"


@query(std(f"{_MADE}, {_FEEDBACK} SELECT pair_id, score, decision, human_label, model_version FROM fb"))
def feedback_scores(spark, d):
    _, pairs, gold = made(spark, d)
    return labels.feedback(gold, pairs, "v1").drop(*PAIR)


@query(std(f"{_MADE}, {_FEEDBACK} SELECT pair_id, score, CASE WHEN nl % 4 = 1 THEN 'changed' ELSE human_label END AS human_label, model_version FROM fb UNION ALL SELECT pair_id, score, 'changed', 'v2' FROM fb WHERE nl % 4 = 2"))
def merged_feedback(spark, d):
    _, pairs, gold = made(spark, d)
    first = labels.feedback(gold, pairs, "v1").withColumn("seq", F.lit(1))
    later = first.where(number(F.least(*PAIR)) % 4 == 1).unionByName(first.where(number(F.least(*PAIR)) % 4 == 2).withColumn("model_version", F.lit("v2")))
    return labels.merge_feedback(first, later.withColumns({"human_label": F.lit("changed"), "seq": F.lit(2)})).select("pair_id", "score", "human_label", "model_version")


_PLAN = f"""{_MADE}, seen AS (SELECT * FROM dec WHERE nl % 7 <> 0),
    j AS (SELECT g.record_id_l, g.record_id_r, g.is_positive, coalesce(s.decision, 'ABSENT') AS decision_now, CASE WHEN g.is_positive THEN 'MATCH' ELSE 'NON_MATCH' END AS want, s.match_probability, s.decision IS NOT NULL AS there, l.device_ids <> r.device_ids AS differ
        FROM gold g LEFT JOIN seen s USING (record_id_l, record_id_r) JOIN std l ON l.record_id = g.record_id_l JOIN std r ON r.record_id = g.record_id_r),
    plan AS (SELECT record_id_l, record_id_r, decision_now, want AS decision_after, match_probability, there AS "exists",
        CASE WHEN there AND NOT is_positive AND match_probability >= 0.84 THEN 'probability above the threshold' WHEN is_positive AND differ THEN 'devices differ' END AS blocked_reason
        FROM j WHERE decision_now <> want AND NOT (NOT there AND want = 'NON_MATCH'))"""


def _planned(spark, d):
    records, pairs, gold = made(spark, d)
    seen = pairs.where("nl % 7 <> 0").select(*PAIR, "match_probability", "decision")
    return seen, materialize(labels.plan_overrides(labels.load_labels(gold), seen, records), "q-plan")


@query(std(f"{_PLAN} SELECT *, blocked_reason IS NOT NULL AS blocked FROM plan"))
def override_plan(spark, d):
    return _planned(spark, d)[1]


@query(std(f"""{_PLAN}, todo AS (SELECT * FROM plan WHERE blocked_reason IS NULL)
    SELECT s.record_id_l, s.record_id_r, s.match_probability, coalesce(t.decision_after, s.decision) AS decision FROM seen s LEFT JOIN todo t USING (record_id_l, record_id_r)
    UNION ALL SELECT record_id_l, record_id_r, CASE WHEN decision_after = 'MATCH' THEN 1.0 ELSE 0.0 END, decision_after FROM todo WHERE NOT "exists" """))
def overridden_pairs(spark, d):
    return labels.apply_overrides(*_planned(spark, d))


# Queues.
@query(std(f"{_MADE} SELECT record_id_l, record_id_r, nl % 4 AS agree_count, match_probability FROM dec ORDER BY nl % 4 DESC, match_probability DESC NULLS LAST, record_id_l, record_id_r LIMIT 30"))
def sorted_queue(spark, d):
    return labels.sorted_queue(made(spark, d)[1].withColumn("agree_count", F.col("nl") % 4)).select(*PAIR, "agree_count", "match_probability").limit(30)


_QUEUE = f"{_MADE}, q AS (SELECT record_id_l, record_id_r, nl, json_object('city', l.city_std, 'state', r.state_std)::VARCHAR AS evidence, CASE WHEN nl % 5 = 0 THEN 'match' END AS label, CASE WHEN nl % 5 = 0 THEN 'reviewed' ELSE 'pending' END AS review_status FROM dec JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r)"


def _queue(spark, d):
    records, pairs, _ = made(spark, d)
    wide = blocking.attach(pairs.select(*PAIR, "nl"), records, ["city_std", "state_std"])
    none = F.lit(None).cast("string")
    fresh = wide.select(*PAIR, "nl", F.col("city_std_l").alias("city"), F.col("state_std_r").alias("state"), none.alias("label"), F.lit("pending").alias("review_status"), none.alias("reviewer"))
    before = fresh.where("nl % 5 = 0").withColumns({"label": F.lit("match"), "review_status": F.lit("reviewed"), "reviewer": F.lit("ann")})
    return sinks.queue_rows(fresh, ["city", "state"], before)


@query(std(f"{_QUEUE} SELECT record_id_l, record_id_r, evidence, label, review_status FROM q"))
def stored_queue(spark, d):
    return _queue(spark, d).select(*PAIR, "evidence", "label", "review_status")


@query(std(f"{_QUEUE} SELECT record_id_l, record_id_r, CASE WHEN nl % 3 <> 0 THEN CASE (nl + CAST(substr(record_id_r, 5) AS BIGINT)) % 4 WHEN 0 THEN 'Match' WHEN 1 THEN 'Beda-Orang' WHEN 2 THEN 'yes' ELSE 'no' END ELSE label END AS label, CASE WHEN nl % 3 <> 0 THEN 'reviewed' ELSE review_status END AS review_status FROM q"))
def decided_queue(spark, d):
    stored = materialize(_queue(spark, d), "q-queue")
    return sinks.update_decisions(stored, made(spark, d)[2]).select(*PAIR, "label", "review_status")


@query(std(f"""{_MADE} SELECT record_id_l || '__' || record_id_r AS pair_id, nl % 3 AS cmp_name, l.device_ids AS devices_l, r.device_ids AS devices_r, l.customer_id AS customer_id_l, r.customer_id AS customer_id_r, l.device_ids = r.device_ids AS device_match
    FROM dec JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r WHERE match_probability >= 0.35 AND match_probability < 0.84"""))
def evidence_export(spark, d):
    records, pairs, _ = made(spark, d)
    mapped = records.select("record_id", F.concat(F.lit("e"), "record_id").alias("entity_id"))
    out = sinks.linkage_evidence(pairs.withColumn("gamma_name", F.col("nl") % 3), records, mapped, 0.35, MATCH_THRESHOLD)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("pair_id", "cmp_name", text("devices_l"), text("devices_r"), "customer_id_l", "customer_id_r", "device_match")


@query(std(f"{_MAP} SELECT a.record_id AS record_id_l, b.record_id AS record_id_r, a.entity_id AS entity_id_l, a.entity_id = b.entity_id AS same_entity FROM emap a JOIN emap b ON CAST(substr(b.record_id, 5) AS BIGINT) = CAST(substr(a.record_id, 5) AS BIGINT) + 1"))
def evidence_entities(spark, d):
    records, _, mapped = simple_map(spark, d)
    n = number("record_id")
    next_ = records.select(F.col("record_id").alias(PAIR[0]), (n + 1).alias("n")).join(records.select(F.col("record_id").alias(PAIR[1]), n.alias("n")), "n")
    out = sinks.linkage_evidence(next_.withColumn("match_probability", F.lit(0.5)), records, mapped, 0.35)
    return out.select(*PAIR, "entity_id_l", "same_entity")


# Stored tables.
_N = "CAST(substr(record_id, 5) AS BIGINT)"
_E = "CAST(substr(entity_id, 5) AS BIGINT)"


@query(std(f"{_MAP} SELECT record_id, entity_id FROM emap WHERE {_N} % 7 <> 0"))
def synced_membership(spark, d):
    mapped = simple_map(spark, d)[2]
    n = number("record_id")
    return sinks.sync_membership(mapped.where(n % 5 != 0).withColumn("entity_id", F.lit("ent_old")), mapped.where(n % 7 != 0))


def _golden(spark, d):
    """Records, their map, and the golden records, written."""
    records, _, mapped = simple_map(spark, d)
    return records, mapped, materialize(survivorship.master(records.join(mapped, "record_id")), "q-master")


_CONFLICTS = f"{_LONG}, cf AS (SELECT entity_id, field FROM vals GROUP BY 1, 2 HAVING count(*) > 1)"


@query(std(f"""{_CONFLICTS}, ml AS (SELECT entity_id, count(*) AS record_count, string_agg(record_id, ',' ORDER BY record_id) AS record_ids, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM frame GROUP BY 1), oc AS (SELECT entity_id, string_agg(field, ',' ORDER BY field) AS fields FROM cf GROUP BY 1)
    SELECT entity_id, record_count, record_ids, sources, coalesce(fields, '') AS conflicted_fields FROM ml LEFT JOIN oc USING (entity_id)"""))
def serving_master(spark, d):
    records, mapped, master = _golden(spark, d)
    view = serving.master_view(master.select("entity_id"), sinks.membership_rows(mapped, records), sinks.conflict_rows(master))
    text = lambda c: F.array_join(c, ",").alias(c)
    return view.select("entity_id", "record_count", text("record_ids"), text("sources"), text("conflicted_fields"))


@query(std(f"{_CONFLICTS} SELECT count(DISTINCT entity_id) AS entities FROM cf"))
def open_conflicts(spark, d):
    return serving.open_conflicts(sinks.conflict_rows(_golden(spark, d)[2]))


@query(std(f"{_CONFLICTS}, st AS (SELECT entity_id, field, CASE WHEN {_E} % 2 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM cf UNION ALL SELECT 'ent_gone', 'email_std', 'OPEN') SELECT * FROM st WHERE NOT (status = 'OPEN' AND TRY_CAST(substr(entity_id, 5) AS BIGINT) % 3 = 0 AND entity_id <> 'ent_gone') OR entity_id = 'ent_gone' UNION ALL SELECT entity_id, field, 'OPEN' FROM cf WHERE {_E} % 3 = 0"))
def stored_conflicts(spark, d):
    master = _golden(spark, d)[2]
    e = number("entity_id")
    stored = sinks.conflict_rows(master).withColumn("status", F.when(e % 2 == 0, "RESOLVED").otherwise("OPEN"))
    stored = stored.unionByName(spark.createDataFrame([("ent_gone", "email_std", "OPEN")], stored.schema))
    return sinks.conflict_rows(master.where(e % 3 == 0), stored)


@query(std("SELECT record_id, customer_id, first_name_std AS first_name, last_name_std AS last_name, email_std AS email, phone_std AS phone, address_std AS address, city_std AS city, state_std AS state, country_std AS country, CAST(dob_std AS DATE) AS dob, 'r1' AS run_id FROM std"))
def stored_records(spark, d):
    return sinks.processed_rows(standardized(spark, d), "r1")


@query(std(f"{_MAP} SELECT DISTINCT entity_id, 'r1' AS run_id FROM emap UNION ALL SELECT DISTINCT entity_id, 'r2' FROM emap"))
def snapshots(spark, d):
    master = _golden(spark, d)[2].select("entity_id")
    once = sinks.snapshot_rows(master, "r1")
    twice = materialize(sinks.snapshot_rows(master, "r2", once), "q-snapshots")
    again = sinks.snapshot_rows(master, "r2", twice)  # a run that has a snapshot adds nothing
    return again.select("entity_id", "run_id")


@query(std(f"{_CONFLICTS}, e AS (SELECT DISTINCT entity_id FROM emap) SELECT entity_id, CASE WHEN {_E} % 3 <> 0 THEN 'STORED' WHEN entity_id IN (SELECT entity_id FROM cf) THEN 'CONFLICTED' ELSE 'CONFIRMED' END AS status FROM e"))
def recomputed_master(spark, d):
    records, mapped, master = _golden(spark, d)
    stored = master.withColumn("status", F.lit("STORED")).unionByName(master.limit(1).withColumns({"entity_id": F.lit("ent_without_records"), "status": F.lit("STORED")}))
    touched = mapped.select("entity_id").distinct().where(number("entity_id") % 3 == 0)
    return survivorship.recompute(records.join(mapped, "record_id"), touched, stored).select("entity_id", "status")


@query(std(f"{_FRAME}, m AS (SELECT entity_id, min(city_std) AS city FROM frame GROUP BY 1) SELECT entity_id, CASE WHEN entity_id = 'ent_000002' THEN 'elsewhere' ELSE city END AS city FROM m"))
def edited_master(spark, d):
    plain = frame_of(spark, d).groupBy("entity_id").agg(F.min("city_std").alias("city"))
    return sinks.update_master_row(plain, "ent_000002", {"city": "elsewhere"})


_PERSISTED = ("processed_customers", "dedup_outputs", "entity_map", "entity_membership", "entity_conflict", "master_customer_current", "master_customer_snapshot")


@query(std(f"""{_CONFLICTS}, n AS (SELECT count(*) AS r FROM std), e AS (SELECT count(DISTINCT entity_id) AS e FROM emap), p AS (SELECT count(*) AS p FROM cand), c AS (SELECT count(*) AS c FROM cf)
    SELECT unnest([{", ".join(f"'{t}'" for t in _PERSISTED)}]) AS "table", unnest([r, p, r, r, c, e, e]) AS rows FROM n, e, p, c"""))
def persisted_tables(spark, d):
    """Rows of all tables after the same run has been persisted twice."""
    records, mapped, master = _golden(spark, d)
    pairs, root = made_pairs(records), f"{work_base(spark)}/persist-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.persist_run(spark, root, "r1", records, pairs, mapped, master)
    state = sinks.Staging(spark, root)
    return spark.createDataFrame([(t, state.read(t).count()) for t in _PERSISTED], "`table` string, rows long")


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT -1, 'X'")
def staged_tables(spark, d):
    """A table that is committed in two parts; what is rolled back, or not committed, isn't there."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")
    root = f"{work_base(spark)}/staged-{uuid.uuid4().hex}"
    first, extra = sinks.Staging(spark, root, "a"), spark.createDataFrame([(-1, "X")], o.schema)
    first.write(o, "orders")
    first.commit()
    second = sinks.Staging(spark, root, "b")
    second.append(extra, "orders")
    second.commit(1)
    third = sinks.Staging(spark, root, "c")
    third.write(extra, "orders")
    third.rollback()
    return sinks.Staging(spark, root).read("orders")


# Evaluation.
@query(std(f"{SILVER_CTE}, a AS (SELECT label = 1 AS is_positive, (label = 1) = (l.device_ids = r.device_ids) AS good FROM silver JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r) SELECT is_positive, count(*) FILTER (good) AS agrees, count(*) FILTER (NOT good) AS contradicted, CAST(0 AS BIGINT) AS unverifiable FROM a GROUP BY 1"))
def audit_matrix(spark, d):
    records = written(spark, d)
    return evaluate.audit_report(evaluate.label_audit(labels.silver(records).select(*PAIR, (F.col("label") == 1).alias("is_positive")), records))


def _layers_sql(scope: str) -> str:
    return std(f"""{_MAP}, num AS{_MADE.split("num AS", 1)[1]}, sc AS (SELECT * FROM std WHERE {scope}), t AS (SELECT l.record_id AS record_id_l, r.record_id AS record_id_r FROM sc l JOIN sc r ON l.device_ids = r.device_ids WHERE l.record_id < r.record_id),
    p AS (SELECT * FROM dec WHERE record_id_l IN (SELECT record_id FROM sc) AND record_id_r IN (SELECT record_id FROM sc)), em AS (SELECT * FROM emap WHERE record_id IN (SELECT record_id FROM sc)),
    b AS (SELECT count(*) AS n, count(p.record_id_l) AS hit FROM t LEFT JOIN p USING (record_id_l, record_id_r)), k AS (SELECT count(*) AS edges, count(t.record_id_l) AS hit FROM (SELECT * FROM p WHERE match_probability >= 0.84) e LEFT JOIN t USING (record_id_l, record_id_r)),
    z AS (SELECT count(*) AS n FROM em GROUP BY entity_id), s AS (SELECT count(*) FILTER (a.entity_id <> b.entity_id) AS split FROM t JOIN em a ON a.record_id = record_id_l JOIN em b ON b.record_id = record_id_r),
    mx AS (SELECT count(*) FILTER (n > 1) AS mixed FROM (SELECT count(DISTINCT device_ids) AS n FROM em JOIN std USING (record_id) GROUP BY entity_id)), gl AS (SELECT g.is_positive, g.match_probability >= 0.84 AS hit FROM gold g JOIN p USING (record_id_l, record_id_r)),
    m AS (SELECT 'blocking' AS layer, unnest(['reference_pairs', 'generated', 'never_generated', 'recall_ceiling']) AS metric, unnest([n, hit, n - hit, round(hit / nullif(n, 0), 6)]::DOUBLE[]) AS value FROM b
    UNION ALL SELECT 'linkage', unnest(['truth_pairs', 'matched_truth_pairs', 'missed_truth_pairs', 'match_edges', 'false_merges', 'unverifiable_edges', 'recall', 'precision']), unnest([n, k.hit, n - k.hit, edges, edges - k.hit, 0, round(k.hit / nullif(n, 0), 4), round(k.hit / nullif(edges, 0), 4)]::DOUBLE[]) FROM b, k
    UNION ALL SELECT 'decision', unnest(['candidates', 'match', 'review', 'non_match', 'at_one']), unnest([count(*), count(*) FILTER (decision = 'MATCH'), count(*) FILTER (decision = 'REVIEW'), count(*) FILTER (decision = 'NON_MATCH'), 0]::DOUBLE[]) FROM p
    UNION ALL SELECT 'entity', unnest(['records', 'entities', 'multi_record_entities', 'largest_entity']), unnest([sum(n), count(*), count(*) FILTER (n > 1), max(n)]::DOUBLE[]) FROM z
    UNION ALL SELECT 'entity', unnest(['reference_pairs', 'reference_pairs_split', 'mixed_entities', 'records_without_device']), unnest([b.n, split, mixed, 0]::DOUBLE[]) FROM b, s, mx
    UNION ALL SELECT 'decision', unnest(['tp', 'fp', 'fn', 'tn']), unnest([count(*) FILTER (is_positive AND hit), count(*) FILTER (NOT is_positive AND hit), count(*) FILTER (is_positive AND NOT hit), count(*) FILTER (NOT is_positive AND NOT hit)]::DOUBLE[]) FROM gl) SELECT layer, metric, value FROM m""")


def _layers(spark, d, scope):
    records, _, mapped = simple_map(spark, d)
    pairs = materialize(made_pairs(records), "q-made")
    return evaluate.layers(records.where(scope), pairs, mapped, labels.load_labels(made_gold(pairs)))


@query(_layers_sql("true"))
def evaluation_layers(spark, d):
    return _layers(spark, d, "true")


@query(_layers_sql(f"{_N} % 2 = 1 OR {_N} % 3 = 0"))
def evaluation_scope(spark, d):
    return _layers(spark, d, "substring(record_id, 5) % 2 = 1 or substring(record_id, 5) % 3 = 0")


def _arm_sql(name: str, threshold: float) -> str:
    own = components_cte(f"edges_{name}", "std", f"comp_{name}").replace("both_ways", f"both_{name}").replace("reach", f"reach_{name}")
    return f"edges_{name} AS (SELECT record_id_l AS a, record_id_r AS b FROM dec WHERE match_probability >= {threshold}), {own}, size_{name} AS (SELECT count(*) AS n FROM comp_{name} GROUP BY root), arm_{name} AS (SELECT count(*) AS entities, max(n) AS largest, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS in_multi FROM size_{name})"


@query(std(f"""{_MADE}, {_arm_sql("base", 0.84)}, {_arm_sql("low", 0.35)}, band AS (SELECT * FROM dec WHERE decision = 'REVIEW'),
    j AS (SELECT count(*) AS review_pairs, count(*) FILTER (a.root = b.root) AS merged, count(g.is_positive) AS labelled, count(*) FILTER (NOT g.is_positive) AS false_merges FROM band JOIN comp_low a ON a.record_id = band.record_id_l JOIN comp_low b ON b.record_id = band.record_id_r LEFT JOIN gold g ON g.record_id_l = band.record_id_l AND g.record_id_r = band.record_id_r),
    o AS (SELECT j.*, x.entities AS entities_base, x.largest AS largest_base, x.in_multi AS in_multi_base, y.entities AS entities_lowered, y.largest AS largest_lowered, y.in_multi AS in_multi_lowered FROM j, arm_base x, arm_low y),
    g AS (SELECT *, merged = review_pairs AS review_pairs_merged, false_merges = 0 AS no_false_merge, largest_lowered <= largest_base AS largest_entity_not_increased, entities_base - entities_lowered = review_pairs AS entity_delta_equals_review_pairs, labelled = review_pairs AND false_merges = 0 AS band_all_labelled_match FROM o)
    SELECT *, CASE WHEN review_pairs_merged AND no_false_merge AND largest_entity_not_increased AND entity_delta_equals_review_pairs AND band_all_labelled_match THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g"""))
def threshold_canary(spark, d):
    records, pairs, gold = made(spark, d)
    base, low = (materialize(entities.cluster(records, pairs.where(F.col("match_probability") >= t)), "q-arm") for t in (0.84, 0.35))
    return evaluate.threshold_canary(base, low, pairs.where("decision = 'REVIEW'"), labels.load_labels(gold))


@query(std(f"{_MAP}, s AS (SELECT count(*) AS n FROM emap GROUP BY entity_id), h AS (SELECT (SELECT count(*) FROM std) AS pending, max(n) AS largest FROM s), a AS (SELECT 'critical' AS level, 'pipeline' AS source, 'last job: failed' AS message UNION ALL SELECT 'warning', 'review_queue', 'review_pending is ' || pending || ', the limit 100' FROM h WHERE pending > 100 UNION ALL SELECT 'warning', 'entity', 'largest_entity is ' || largest || ', the limit 100' FROM h WHERE largest > 100 UNION ALL SELECT 'warning', 'db_ingestion', '3 stale entities') SELECT *, 'critical' AS overall FROM a"))
def health_alerts(spark, d):
    records, _, mapped = simple_map(spark, d)
    row = entities.summary(mapped).first()
    found = profile.alerts({"job_status": "failed", "review_pending": records.count(), "largest_entity": row.largest, "stale_entities": 3})
    return spark.createDataFrame([(a["level"], a["source"], a["message"], profile.overall(found)) for a in found], "level string, source string, message string, overall string")


@query(std(f"{_INC_MAP}, old AS (SELECT customer_id, arg_min(entity_id, record_id) AS wanted FROM omap JOIN std USING (record_id) GROUP BY 1) SELECT count(*) AS known, count(*) FILTER (entity_id = wanted) AS recovered FROM imap JOIN std USING (record_id) JOIN old USING (customer_id) WHERE record_id IN (FROM inew)"))
def recovered_entities(spark, d):
    before, _, _, after = _incremental(spark, d)
    return evaluate.recovered_entities(before, after, standardized(spark, d))


# Damage and diagnostics.
def drawn_sql(*key: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(f'CAST({k} AS VARCHAR)' for k in key)}), 1, 8))::BIGINT"


def corrupt_sql(v: str, kind: str, key: str) -> str:
    n = f"length({v})"
    at = lambda low, high: f"({low} + {drawn_sql(key)} % greatest({high} - {low}, 1))"
    i = at(1, n)
    if kind == "double_letter":
        return f"CASE WHEN {n} > 1 THEN substr({v}, 1, {i}) || substr({v}, {i}, 1) || substr({v}, {i} + 1) ELSE {v} END"
    if kind == "drop_letter":
        return f"CASE WHEN {n} >= 3 THEN substr({v}, 1, {i}) || substr({v}, {i} + 2) ELSE {v} END"
    if kind == "swap_letters":
        i = at(1, f"{n} - 1")
        return f"CASE WHEN {n} >= 3 THEN substr({v}, 1, {i}) || substr({v}, {i} + 2, 1) || substr({v}, {i} + 1, 1) || substr({v}, {i} + 3) ELSE {v} END"
    if kind == "uppercase":
        return f"upper({v})"
    if kind == "phone_drop_digit":
        i = at(0, n)
        return f"CASE WHEN {n} >= 7 THEN substr({v}, 1, {i}) || substr({v}, {i} + 2) ELSE {v} END"
    year, month, day = (f"CAST(split_part({v}, '-', {k}) AS INT)" for k in (1, 2, 3))
    if kind == "dob_year_shift":
        return f"lpad(CAST({year} + CASE WHEN {drawn_sql(key)} % 2 = 0 THEN 1 ELSE -1 END AS VARCHAR), 4, '0') || substr({v}, 5, 6)"
    return f"CASE WHEN {month} <= 12 AND {day} <= 12 THEN printf('%04d-%02d-%02d', {year}, {day}, {month}) ELSE {v} END"


_DAMAGE = {f"{f}_{k}": (f, k) for f, (kinds, _) in stress.KINDS.items() for k in kinds}


@query(std("SELECT record_id, " + ", ".join(f"{corrupt_sql(f, k, 'record_id')} AS {n}" for n, (f, k) in _DAMAGE.items()) + " FROM std"))
def corruptions(spark, d):
    return standardized(spark, d).select("record_id", *[stress.corrupt(F.col(f), k, F.col("record_id")).alias(n) for n, (f, k) in _DAMAGE.items()])


_AT = f"({drawn_sql('record_id')} % greatest(length(first_name_std), 1))"


@query(std(f"SELECT record_id, substr(first_name_std, 1, {_AT}) || translate(substr(first_name_std, {_AT} + 1, 1), 'oieastb', '0134578') || substr(first_name_std, {_AT} + 2) AS name FROM std"))
def look_alikes(spark, d):
    return standardized(spark, d).select("record_id", stress.look_alike(F.col("first_name_std"), F.col("record_id")).alias("name"))


def _damaged_sql() -> str:
    """``dmg``: the damaged fields of every record, what changed, and how many."""
    cols, ops, count = [], [], []
    for field, (kinds, share) in stress.KINDS.items():
        pick = f"({drawn_sql(repr(field), 'record_id')} % {len(kinds)})"
        chosen = f"({drawn_sql(repr('share'), repr(field), 'record_id')} % 1000 < {round(share * 1000)})"
        value = f"CASE {' '.join(f'WHEN {chosen} AND {pick} = {k} THEN {corrupt_sql(field, kind, 'record_id')}' for k, kind in enumerate(kinds))} ELSE {field} END"
        name = f"CASE {' '.join(f'WHEN {chosen} AND {pick} = {k} THEN {kind!r}' for k, kind in enumerate(kinds))} END"
        cols.append(f"{value} AS v_{field}, {name} AS k_{field}")
        changed = f"coalesce(v_{field} <> {field} AND v_{field} <> '', false)"
        ops.append(f"CASE WHEN {changed} THEN '{field}:' || k_{field} WHEN k_{field} = 'dob_swap_day_month' THEN '{field}:swap_skipped_unambiguous' END")
        count.append(f"{changed}::INT")
    new = ", ".join(f"CASE WHEN coalesce(v_{f} <> {f} AND v_{f} <> '', false) THEN v_{f} ELSE {f} END AS n_{f}" for f in stress.KINDS)
    return f"dv AS (SELECT *, {', '.join(cols)} FROM std), dmg AS (SELECT *, coalesce(nullif(concat_ws(';', {', '.join(ops)}), ''), 'none') AS ops, CAST({' + '.join(count)} AS INTEGER) AS damaged, {new} FROM dv)"


@query(std(f"{_damaged_sql()} SELECT 'dmg_' || record_id AS record_id, record_id AS copy_of, ops, damaged, {', '.join(f'n_{f} AS {f}' for f in stress.KINDS)} FROM dmg"))
def damaged_copies(spark, d):
    return stress.damaged_copies(standardized(spark, d)).select("record_id", "copy_of", "ops", "damaged", *stress.KINDS)


def _rescored_sql() -> str:
    """``sd``: the damaged copies that the rules pair with their originals, with their probability."""
    derived = {"first_name_std_pre3": "substr(first_name_std, 1, 3)", "last_name_std_pre3": "substr(last_name_std, 1, 3)", "phone_pre7": "substr(phone_std, 1, 7)", "phone_last4": "right(phone_std, 4)", "dob_year_std": "substr(dob_std, 1, 4)", "phonetic_first_name": soundex_sql("first_name_std"), "phonetic_last_name": soundex_sql("last_name_std")}
    hurt = f"h0 AS (SELECT record_id, ops, damaged, city_std, state_std, {', '.join(f'n_{f} AS {f}' for f in stress.KINDS)} FROM dmg), hurt AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in derived.items())} FROM h0)"
    met = " OR ".join("(" + " AND ".join(f"l.{c} = r.{c}" for c in columns) + ")" for _, columns in BLOCKING_RULES)
    return f"{_damaged_sql()}, {hurt}, gd AS (SELECT l.record_id, {GAMMA_SQL} FROM hurt l JOIN std r ON l.record_id = r.record_id WHERE {met}), wd AS (SELECT *, {weight_sql()} AS match_weight FROM gd), sd AS (SELECT record_id, 1 / (1 + pow(2, -match_weight)) AS p FROM wd)"


RECOVERY_SQL = std(f"{_rescored_sql()}, o AS (SELECT record_id, unnest(string_split(ops, ';')) AS op FROM dmg WHERE ops <> 'none') SELECT op, count(*) AS pairs, count(sd.p) FILTER (sd.p >= 0.84) AS found FROM o LEFT JOIN sd USING (record_id) GROUP BY 1")
RECOVERY_COUNT_SQL = std(f"{_rescored_sql()} SELECT damaged, count(*) AS pairs, count(*) FILTER (p >= 0.84) AS recovered, count(*) FILTER (p IS NULL) AS never_scored FROM dmg LEFT JOIN sd USING (record_id) GROUP BY 1")


def _pick_sql(words, salt) -> str:
    return f"[{', '.join(map(repr, words))}][({drawn_sql(str(salt), 'base')} % {len(words)}) + 1]"


_FIRST, _LAST = ("anna", "bima", "citra", "dewi", "eka", "fajar", "gita", "hadi"), ("santoso", "wijaya", "putri", "halim", "lestari", "nugroho")


@query(f"""WITH b AS (SELECT k AS i, k - CASE WHEN k % 10 = 9 OR k % 25 = 24 THEN 1 ELSE 0 END AS base FROM range(500) t(k)), n AS (SELECT *, {_pick_sql(_FIRST, 1)} AS first, {_pick_sql(_LAST, 2)} AS last FROM b)
    SELECT i AS customer_pk, CASE WHEN i % 25 = 24 AND i % 10 <> 9 THEN {corrupt_sql("first", "drop_letter", "i")} ELSE first END AS first_name, last AS last_name, first || '.' || last || base || '@example.com' AS email, '08' || printf('%010d', {drawn_sql("3", "base")}) AS phone_number,
    strftime(DATE '1950-01-01' + CAST({drawn_sql("4", "base")} % 20000 AS INTEGER), '%d/%m/%Y') AS dob, 'Jl. Merdeka No. ' || ({drawn_sql("5", "base")} % 500) AS address, {_pick_sql(("jakarta", "bandung", "medan", "surabaya"), 6)} AS city FROM n""")
def synthetic_rows(spark, d):
    return stress.synthetic_crm(spark, 500).select("customer_pk", "first_name", "last_name", "email", "phone_number", "dob", "address", "city")


_VARIANT_FIELDS = ("first_name_std", "phone_std", "email_std", "address_std", "dob_std")
_MUTATED = {
    "first_name_std": "CASE WHEN length({v}) < 2 THEN {v} || 'x' ELSE substr({v}, 1, 1) || substr({v}, 3, 1) || substr({v}, 2, 1) || substr({v}, 4) END",
    "phone_std": "substr({v}, 1, length({v}) - 1) || (CAST(right({v}, 1) AS INT) + 1) % 10",
    "email_std": "CASE WHEN contains({v}, '@') THEN split_part({v}, '@', 1) || '@elsewhere.example' ELSE {v} END",
    "address_std": "regexp_extract({v}, '^([^0-9]*)', 1) || (CAST(regexp_extract({v}, '[0-9]+') AS INT) + 1) || regexp_extract({v}, '^[^0-9]*[0-9]+(.*)$', 1)",
    "dob_std": "(CAST(substr({v}, 1, 4) AS INT) + 1) || substr({v}, 5)",
}
_COMPARED = ("first_name_std", "last_name_std", "email_std", "phone_std", "dob_std", "address_std", "city_std", "state_std", "phonetic_first_name", "phonetic_last_name")


def _variants_sql() -> str:
    both = lambda l, r: ", ".join([f"{l}.{c} AS {c}_l" for c in _COMPARED] + [f"{r}.{c} AS {c}_r" for c in _COMPARED])
    base = f"pv AS (SELECT record_id_l AS a, record_id_r AS b, {both('l', 'r')} FROM cand JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r)"
    rows = ["SELECT 'base' AS variant, * FROM pv", f"SELECT 'swapped' AS variant, a, b, {', '.join([f'{c}_r' for c in _COMPARED] + [f'{c}_l' for c in _COMPARED])} FROM pv"]
    for f in _VARIANT_FIELDS:
        for name, value in ((f"null:{f}", "NULL"), (f"mutated:{f}", _MUTATED[f].format(v=f"{f}_r"))):
            rows.append(f"SELECT '{name}' AS variant, a, b, {', '.join([f'{c}_l' for c in _COMPARED] + [value if c == f else f'{c}_r' for c in _COMPARED])} FROM pv")
    gamma = re.sub(r"\b([lr])\.(\w+)", lambda m: f"{m[2]}_{m[1]}", GAMMA_SQL.replace("l.dob_year_std", "substr(dob_std_l, 1, 4)").replace("r.dob_year_std", "substr(dob_std_r, 1, 4)"))
    return f"{base}, vv AS ({' UNION ALL '.join(rows)}), gv AS (SELECT variant, a, b, {gamma} FROM vv), wv AS (SELECT *, {weight_sql()} AS match_weight FROM gv), sv AS (SELECT *, 1 / (1 + pow(2, -match_weight)) AS p FROM wv)"


@query(std(f"{pairs_cte(SIMPLE_RULES, 'cand')}, {_variants_sql()} SELECT v.variant, count(*) AS pairs, round(avg(v.p - b.p), 6) AS mean_change, round(max(abs(v.p - b.p)), 6) AS largest_change FROM sv v JOIN sv b ON v.a = b.a AND v.b = b.b AND b.variant = 'base' GROUP BY 1"))
def model_diagnostics(spark, d):
    """How much each change of a pair moves its probability: sides swapped, a field missing, a field mutated."""
    records = written(spark, d)
    levels = comparison.static_comparisons()
    need = comparison.needed_columns(levels)
    pairs = blocking.attach(blocking.or_join(records, SIMPLE_RULES).select(*PAIR), records, need).withColumnsRenamed({PAIR[0]: "a", PAIR[1]: "b"})
    scored = comparison.gammas(stress.variants(pairs, _VARIANT_FIELDS), levels).withColumn("p", model.probability(model.weight_column(FIXED)))
    scored = materialize(scored.select("variant", "a", "b", "p"), "q-variants")
    change = scored.join(scored.where("variant = 'base'").select("a", "b", F.col("p").alias("was")), ["a", "b"]).withColumn("change", F.col("p") - F.col("was"))
    return change.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("change"), 6).alias("mean_change"), F.round(F.max(F.abs("change")), 6).alias("largest_change"))


@query(std(f"{pairs_cte(SIMPLE_RULES, 'cand')} SELECT record_id_l, record_id_r, CAST(CASE WHEN (l.phonetic_first_name IS NULL OR l.phonetic_last_name IS NULL) OR (r.phonetic_first_name IS NULL OR r.phonetic_last_name IS NULL) THEN -1 WHEN l.phonetic_first_name = r.phonetic_first_name AND l.phonetic_last_name = r.phonetic_last_name THEN 1 ELSE 0 END AS INTEGER) AS gamma_identity FROM cand JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r"))
def phonetic_identity(spark, d):
    records = written(spark, d)
    levels = [comparison.identity_comparison()]
    return comparison.gammas(blocking.attach(blocking.or_join(records, SIMPLE_RULES).select(*PAIR), records, comparison.needed_columns(levels)), levels).select(*PAIR, "gamma_identity")


_FIXED_M = {"name": (0.7, 0.35, 0.05), "email": (0.7, 0.45, 0.3, 0.05), "phone": (0.7, 0.45, 0.3, 0.05), "location": (0.6, 0.35, 0.2, 0.05), "dob": (0.7, 0.4, 0.25, 0.05)}
_FLOORS = {"name": 0.01, "contact": 0.005, "location": 0.02, "dob": 0.001}


@query("SELECT kind, comparison, CAST(gamma AS INTEGER) AS gamma, round(m, 9) AS m FROM (VALUES " + ", ".join([f"('scaled', '{n}', {len(ms) - 1 - k}, {x}::DOUBLE / {sum(ms)!r}::DOUBLE)" for n, ms in _FIXED_M.items() for k, x in enumerate(ms)] + [f"('floor', '{n}', 0, {x}::DOUBLE)" for n, x in _FLOORS.items()]) + ") t(kind, comparison, gamma, m)")
def fixed_m(spark, d):
    """The m of levels that training leaves alone: scaled ones of chosen columns, and the floors of last levels."""
    scaled = comparison.dynamic_comparisons(["first_name", "email", "phone", "city", "dob"])
    rows = [("scaled", c.name, x.gamma, x.m) for c in scaled for x in c.levels if x.fixed]
    rows += [("floor", c.name, x.gamma, x.m) for c in comparison.static_comparisons() for x in c.levels if x.fixed]
    return spark.createDataFrame(rows, "kind string, comparison string, gamma int, m double").withColumn("m", F.round("m", 9))


@query(std(f"""{_MADE}, tf AS (SELECT city_std AS value, count(*) / sum(count(*)) OVER () AS tf FROM std WHERE city_std IS NOT NULL GROUP BY 1)
    SELECT record_id_l, record_id_r, round(match_probability * 10 + CASE WHEN l.city_std = r.city_std THEN log2(0.05 / tf) ELSE 0 END, 6) AS match_weight FROM dec JOIN std l ON l.record_id = record_id_l JOIN std r ON r.record_id = record_id_r LEFT JOIN tf ON tf.value = l.city_std"""))
def tf_adjusted(spark, d):
    records, pairs, _ = made(spark, d)
    wide = blocking.attach(pairs, records, ["city_std"]).withColumn("match_weight", F.col("match_probability") * 10)
    return model.adjust_for_frequency(wide, model.term_frequencies(records, "city_std"), "city_std", 0.05).select(*PAIR, F.round("match_weight", 6).alias("match_weight"))


_OTHER = model.Model(0.01, FIXED.m, FIXED.u)


@query(std(f"{pairs_cte(SIMPLE_RULES, 'cand')}, {gamma_cte('cand')}, w AS (SELECT 'v1' AS version, *, {weight_sql(FIXED)} AS match_weight FROM g UNION ALL SELECT 'v2', *, {weight_sql(_OTHER)} FROM g) SELECT version, record_id_l, record_id_r, round(1 / (1 + pow(2, -match_weight)), 6) AS match_probability FROM w"))
def version_scores(spark, d):
    records = written(spark, d)
    pairs = blocking.or_join(records, SIMPLE_RULES).select(*PAIR)
    return model.compare_versions(records, pairs, {"v1": FIXED, "v2": _OTHER}).select("version", *PAIR, F.round("match_probability", 6).alias("match_probability"))


# Edits of entities.
_PICKED = "two AS (SELECT entity_id, count(*) AS n, max(record_id) AS last FROM emap GROUP BY 1 HAVING count(*) > 1), first AS (SELECT entity_id, last FROM two ORDER BY entity_id LIMIT 1), most AS (SELECT max(CAST(substr(entity_id, 5) AS BIGINT)) AS k FROM emap)"


def _first_pair(mapped):
    return mapped.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("record_id").alias("last")).where("n > 1").orderBy("entity_id").first()


@query(std(f"{_MAP}, {_PICKED} SELECT record_id, CASE WHEN record_id = (SELECT last FROM first) THEN 'ent_' || printf('%06d', (SELECT k + 1 FROM most)) ELSE entity_id END AS entity_id FROM emap"))
def entity_split(spark, d):
    _, edges, mapped = simple_map(spark, d)
    picked = _first_pair(mapped)
    return entities.split_entity(mapped, edges, picked.entity_id, [picked["last"]], force=True)


@query(std(f"{_MAP}, {_PICKED} SELECT record_id, CASE WHEN entity_id = (SELECT entity_id FROM first) THEN 'ent_000001' ELSE entity_id END AS entity_id FROM emap"))
def entity_merge(spark, d):
    records, _, mapped = simple_map(spark, d)
    picked = _first_pair(mapped)
    other = "ent_000001" if picked.entity_id != "ent_000001" else "ent_000002"
    return entities.merge_entities(mapped, records.select("record_id", "device_ids_std"), picked.entity_id, other, force=True)


_KEPT = "kept AS (SELECT * FROM edges WHERE CAST(substr(a, 5) AS BIGINT) % 4 <> 0 AND CAST(substr(b, 5) AS BIGINT) % 4 <> 0)"


@query(std(f"""{_MAP}, {_KEPT}, {components_cte("kept", "std", "ncomp").replace("both_ways", "nboth").replace("reach", "nreach")},
    part AS (SELECT entity_id, n.root, min(record_id) AS first FROM emap JOIN ncomp n USING (record_id) GROUP BY 1, 2), turn AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY first) AS t FROM part),
    fresh AS (SELECT root, row_number() OVER (ORDER BY first) AS k FROM turn WHERE t > 1) SELECT record_id, CASE WHEN k IS NULL THEN entity_id ELSE 'ent_' || printf('%06d', k + (SELECT count(DISTINCT entity_id) FROM emap)) END AS entity_id FROM emap JOIN ncomp n USING (record_id) LEFT JOIN fresh USING (root)"""))
def recomputed_entities(spark, d):
    """The map after every fourth record has lost its edges."""
    records, edges, mapped = simple_map(spark, d)
    touched = records.select("record_id").where(number("record_id") % 4 == 0)
    kept = edges.where((number(PAIR[0]) % 4 != 0) & (number(PAIR[1]) % 4 != 0))
    return entities.recompute_touched(mapped, touched, kept)


_PROPOSED = f"{_INC_MAP}, m AS (SELECT a AS record_id, b AS other FROM ie UNION ALL SELECT b, a FROM ie), best AS (SELECT record_id, max(other) AS matched_to FROM m GROUP BY 1), prop AS (SELECT i.record_id, i.entity_id AS proposed_entity_id, CASE WHEN matched_to IS NOT NULL OR i.entity_id IN (SELECT entity_id FROM omap) THEN 'match' ELSE 'new' END AS action, matched_to FROM imap i LEFT JOIN best USING (record_id) WHERE i.record_id IN (FROM inew))"


def _proposed(spark, d):
    before, new_records, touched, after = _incremental(spark, d)
    pairs = touched.withColumns({"decision": F.lit("MATCH"), "match_probability": F.lit(0.9)})
    return before, incremental.staging_rows(new_records, pairs, before, after)


@query(std(f"{_PROPOSED} SELECT record_id, proposed_entity_id, action, matched_to FROM prop"))
def proposals(spark, d):
    return _proposed(spark, d)[1].select("record_id", "proposed_entity_id", "action", "matched_to")


@query(std(f"{_PROPOSED}, ok AS (SELECT record_id, proposed_entity_id AS entity_id FROM prop WHERE {_N} % 3 <> 0), base AS (FROM omap UNION ALL FROM ok), no AS (SELECT record_id, row_number() OVER (ORDER BY record_id) AS k FROM prop WHERE {_N} % 3 = 0) FROM base UNION ALL SELECT record_id, 'ent_' || printf('%06d', k + (SELECT max({_E}) FROM base)) FROM no"))
def applied_proposals(spark, d):
    before, staging = _proposed(spark, d)
    return incremental.apply_staged(before, materialize(staging.withColumn("approved", number("record_id") % 3 != 0), "q-staging"))


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AS known, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'rec_' || o_custkey END AS record_id FROM orders")
def split_updates(spark, d):
    key_map = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pk"), F.concat(F.lit("rec_"), F.col("c_custkey").cast("string")).alias("record_id"))
    known, fresh = incremental.split_updates(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("pk")), key_map, "pk")
    return known.select("o_orderkey", F.lit(True).alias("known"), "record_id").unionByName(fresh.select("o_orderkey", F.lit(False).alias("known"), F.lit(None).cast("string").alias("record_id")))


@query(std(f"{_EDGES} SELECT a AS record_id_l, b AS record_id_r FROM edges WHERE CAST(substr(a, 5) AS BIGINT) % 10 = 0 OR CAST(substr(b, 5) AS BIGINT) % 10 = 0"))
def touching_edges(spark, d):
    records = written(spark, d)
    return incremental.touching_edges(simple_edges(records), records.select("record_id").where(number("record_id") % 10 == 0))


@query("SELECT DISTINCT user_id AS record_id FROM events")
def stale_log(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("record_id"))
    return incremental.append_stale(ids.where("record_id % 2 = 0").distinct(), ids)


@query(std(f"SELECT count(*) AS replayed FROM std WHERE {_N} % 6 = 0"))
def replayed_records(spark, d):
    records = standardized(spark, d)
    n = number("record_id")
    return files.rows_by_id(records.where(n % 2 == 0), records.where(n % 3 == 0)).agg(F.count(F.lit(1)).alias("replayed"))


@query(std("SELECT record_id FROM std WHERE device_ids IS NOT NULL"))
def device_records(spark, d):
    return evaluate.records_with_device(standardized(spark, d))


@query(std(f"{_MADE} SELECT record_id_l, record_id_r FROM dec WHERE match_probability >= 0.84"))
def match_edges(spark, d):
    return decide.match_edges(made(spark, d)[1])


@query(std(f"{_MADE}, {TRUTH_CTE} SELECT record_id_l, record_id_r FROM dec INTERSECT SELECT record_id_l, record_id_r FROM truth"))
def truth_among_candidates(spark, d):
    records, pairs, _ = made(spark, d)
    return pairs.select(*PAIR).intersect(evaluate.device_truth(records))


_VALUES = "(SELECT record_id, first_name_std AS a, CASE {_N} % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE last_name_std END AS b, CASE WHEN {_N} % 5 = 0 THEN NULL ELSE first_name_std END AS c FROM std)".replace("{_N}", _N)


@query(std(f"SELECT record_id, CASE WHEN coalesce(trim(c), '') = '' AND coalesce(trim(b), '') = '' THEN 'both blank' WHEN coalesce(trim(c), '') = '' OR coalesce(trim(b), '') = '' THEN 'one blank' WHEN c = b THEN 'same' ELSE 'different' END AS c_b, CASE WHEN coalesce(trim(c), '') = '' THEN 'one blank' ELSE 'same' END AS a_c FROM {_VALUES}"))
def agreement_labels(spark, d):
    n, a = number("record_id"), F.col("first_name_std")
    b = F.when(n % 4 == 1, " ").when(n % 4 != 0, F.col("last_name_std"))
    c = F.when(n % 5 != 0, a)
    return standardized(spark, d).select("record_id", T.agreement_label(c, b).alias("c_b"), T.agreement_label(a, c).alias("a_c"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '-' ELSE printf('%.1f%%', (event_id % 1000) / 1000 * 100) END AS p, CASE WHEN event_id % 8 = 0 THEN '-' ELSE printf('%d / %d (%.1f%%)', 1, event_id % 8, 100.0 / (event_id % 8)) END AS rate FROM events WHERE event_id >= 0")
def display_texts(spark, d):
    k = F.col("event_id")
    p = F.when(k % 9 != 0, (k % 1000) / 1000)
    return table(spark, d, "events").select("event_id", T.probability_text(p).alias("p"), T.rate_text(F.lit(1).cast("long"), (k % 8).cast("long")).alias("rate"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS whole, CASE WHEN event_id % 2 = 0 THEN 'k' || event_id END AS other FROM events")
def key_texts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.key_text(F.col("event_id").cast("double")).alias("whole"), T.key_text(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k"), F.col("event_id").cast("string")))).alias("other"))


# Sources.
@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def iso_dates(spark, d):
    return database.dates_as_text(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))


@query("SELECT c_custkey AS source_id, c_name AS first_name FROM customer")
def renamed_columns(spark, d):
    alias = {v: k for k, v in DB_COLUMN_MAP.items()}
    c = table(spark, d, "customer").select(F.col("c_custkey").alias(alias["source_id"]), F.col("c_name").alias(alias["first_name"]))
    return database.rename_columns(c)


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def parquet_columns(spark, d):
    return files.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def wanted_rows(spark, d):
    wanted = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return files.rows_by_id(table(spark, d, "orders"), wanted, "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT (SELECT count(*) FROM orders) AS orders, CAST(0 AS BIGINT) AS absent")
def row_counts(spark, d):
    return spark.createDataFrame([(files.count_rows(spark, f"{d}/orders.parquet"), files.count_rows(spark, f"{d}/absent.parquet"))], "orders long, absent long")


@query(std("SELECT record_id, first_name FROM std ORDER BY record_id LIMIT 100"))
def first_records(spark, d):
    return files.load_records(standardized(spark, d), rows=100).select("record_id", "first_name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'Café; ' || c_name AS name, c_mktsegment AS segment FROM customer")
def csv_round_trip(spark, d):
    """A table that is exported as CSV, found again in an unknown separator and encoding, in two batches."""
    base = f"{work_base(spark)}/csv-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Café; "), "c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    odd = F.col("id").cast("long") % 2 == 1
    sinks.export_csv(c.where(odd), f"{base}/a")
    c.where(~odd).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{base}/b")
    return files.read_dataset(spark, [("a", f"{base}/a"), ("b", f"{base}/b")]).select("id", "name", "segment")


@query("SELECT * FROM (VALUES ('1', 'Ana', NULL), ('2', 'B;o', 'x')) t(id, name, note)")
def payload_rows(spark, d):
    return files.parse_payload(spark, '﻿id;name;note\n1;Ana\n2;"B;o";x\n'.encode()).select("id", "name", F.col("note"))


@query("SELECT event_id FROM events WHERE user_id = 7 OR user_id + 1 = 7 OR event_id % 100 = 7")
def entity_history(spark, d):
    path = f"{work_base(spark)}/history-{uuid.uuid4().hex}"
    text = lambda c: F.concat(F.lit("e"), c.cast("string"))
    e = table(spark, d, "events").select("event_id", text(F.col("user_id")).alias("from_entity"), text(F.col("user_id") + 1).alias("to_entity"), F.array(text(F.col("event_id") % 100)).alias("records"))
    sinks.export_json(e, path)
    return files.read_history(spark, path, "e7").select("event_id")


@query("SELECT r_regionkey, r_name FROM region")
def serving_fallback(spark, d):
    """The first of three sources that can be read and has rows."""
    r = lambda: table(spark, d, "region").select("r_regionkey", "r_name")
    return serving.first_that_reads(lambda: table(spark, d, "absent"), lambda: r().limit(0), r)


_CHECKS = (
    ("contract", "missing for blocking: address_std"),
    ("inferred", "email,first_name"),
    ("missing", "b,c"),
    ("order", "True"),
    ("registry", "gap before batch_0003|4 rows are registered, 5 stored"),
    ("rules", "e"),
    ("scope", "a sample would replace the full entity map"),
    ("untrained", "levels without m or u: name=2"),
    ("validation", "rejected"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CHECKS) + ") t(name, result)")
def guards(spark, d):
    """What the guards of a run say."""

    def said(f) -> str:
        try:
            return str(f())
        except Exception as e:  # a guard's word is the result here
            return str(e)

    records = standardized(spark, d)
    registry = Registry(f"{work_base(spark)}/registry-{uuid.uuid4().hex}.json")
    for k, rows in enumerate((1, 2, 3)):
        registry.register(f"f{k}", rows, str(k))
    registry.unregister("f1")
    untrained = model.Model(0.1, {"name": {2: 0.5, 0: 0.5}}, {"name": {2: 0.0, 0: 1.0}})
    rows = {
        "contract": said(lambda: standardize.assert_blocking_columns(records.drop("address_std"), (("x", ("address_std", "city_std")),))),
        "inferred": ",".join(comparison.infer_columns(["first_name", "email", "shoe_size"], ["email"])),
        "missing": ",".join(profile.missing_columns(["a"], ["c", "a", "b"])),
        "order": said(lambda: standardize.resolve_dayfirst(spark.createDataFrame([("31/01/2020",), ("01/02/2020",)], "d string"), "d")),
        "registry": "|".join(registry.problems(5)),
        "rules": ",".join(n for n, _ in load_rules('[{"name": "e", "columns": ["email_std"]}, {"name": "again", "columns": ["email_std"]}]')),
        "scope": said(lambda: entities.check_scope({"scope": "full"}, full=False)),
        "untrained": said(untrained.check),
        "validation": profile.validate(spark.createDataFrame([], "first_name string, email string"))["status"],
    }
    return spark.createDataFrame(list(rows.items()), "name string, result string")


@query("SELECT * FROM (VALUES ('exported', (SELECT count(*) FROM nation)), ('already_registered', (SELECT count(*) FROM nation)), ('noop', 0)) t(status, rows)")
def exported_batches(spark, d):
    """A batch that is exported and registered, the same rows again, and no rows."""
    base = f"{work_base(spark)}/export-{uuid.uuid4().hex}"
    n = table(spark, d, "nation")
    registry = Registry(f"{base}/registry.json")
    found = [incremental.export_batch(df, registry, base) for df in (n, n.orderBy(F.desc("n_nationkey")), n.limit(0))]
    return spark.createDataFrame([(f["status"], f["rows"]) for f in found], "status string, rows long")


def _close_sql(c: str) -> str:
    return f"SELECT o.record_id FROM std o WHERE NOT {_NEW} AND o.{c} IN (SELECT ov FROM (SELECT DISTINCT {c} AS ov FROM std WHERE NOT {_NEW} AND length({c}) > 1) x, (SELECT DISTINCT {c} AS nv FROM std WHERE {_NEW} AND length({c}) > 1) y WHERE {indel_sql('nv', 'ov')} >= 80)"


@query(std("u AS (" + " UNION ".join([f"SELECT o.record_id FROM std o WHERE NOT {_NEW} AND o.{c} IN (SELECT {c} FROM std WHERE {_NEW} AND length({c}) > 0)" for c in ("email_std", "phone_std")] + [_close_sql(c) for c in ("last_name_std", "city_std")]) + ") SELECT record_id FROM u"))
def fuzzy_candidates(spark, d):
    records = written(spark, d)
    cut = records.count() * 9 // 10
    new = F.col("record_id") > f"rec_{cut:06d}"
    return blocking.fuzzy_old_rows(records.where(new), records.where(~new), fuzzy=("last_name_std", "city_std")).select("record_id")
