import pytest
from pyspark.sql import functions as F

from amalgam import sinks
from amalgam.config import BLOCKING_RULES, Settings, load_rules, load_settings, training_rules
from amalgam.graph import connected_components
from amalgam.operators import decide, entities, evaluate, labels, model, stress, survivorship
from amalgam.operators.blocking import PAIR, fuzzy_old_rows, or_join, rule_coverage, rule_pairs, touching_old_rows
from amalgam.operators.standardize import ContractError, resolve_dayfirst, standardize
from amalgam.ranking import global_row_number

PAIRS = "record_id_l string, record_id_r string"


def test_rule_config():
    assert load_rules(None) == BLOCKING_RULES and load_rules("not json") == BLOCKING_RULES
    assert load_rules('[{"name": "email_local_name", "columns": ["a"]}, {"name": "x", "columns": ["b"]}, {"name": "y", "columns": ["b"]}]') == (("x", ("b",)),)
    assert [n for n, _ in training_rules()] == ["phone_prefix", "name_prefix", "phone_last4", "name_fuzzy_last4"]
    assert load_settings('{"match_threshold": 0.9}').match_threshold == 0.9 and load_settings("[]").match_threshold == 0.84


def test_decision_bounds(spark):
    df = spark.createDataFrame([(1.0,), (0.84,), (0.839,), (0.35,), (0.349,)], "p double")
    assert [r.d for r in df.select(decide.decision(F.col("p")).alias("d")).collect()] == ["MATCH", "MATCH", "REVIEW", "REVIEW", "NON_MATCH"]


def test_business_rules(spark):
    rows = [("e", "f", "l", a, d0, "e", "f", "l", b, d1, dec) for a, b, d0, d1, dec in [("x", "x", "1988-04-11", "1988-04-11", "MATCH"), ("x", "x", "1988-04-11", "1988-04-11", "MATCH"), ("x", "x", "1988-04-11", "1999-12-31", "MATCH"), ("x", "x", "1988-04-11", None, "NON_MATCH"), ("x", "y", "1988-04-11", "1988-04-11", "MATCH")]]
    names = [f"{c}_std_{s}" for s in "lr" for c in ("email", "first_name", "last_name", "address", "dob")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", decision string")
    out = decide.apply_business_rules(df).collect()
    assert [r.decision for r in out] == ["MATCH", "MATCH", "REVIEW", "REVIEW", "MATCH"]
    assert [r.business_rule for r in out] == ["strong_agreement_email_name_address"] * 2 + ["unverified_dob"] * 2 + [None]
    assert decide.apply_business_rules(df.select("decision")).first().business_rule is None


def test_pairs(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", None, "x"), ("d", "2", None)], "record_id string, k string, j string")
    got = {(r[0], r[1], r.rule) for r in or_join(df, (("k", ("k",)), ("j", ("j",)))).collect()}
    assert got == {("a", "b", "k"), ("a", "c", "j"), ("b", "c", "j")}
    truth = spark.createDataFrame([("a", "b"), ("b", "c")], PAIRS)
    cover = {r.rule: (r.pairs, r.covered) for r in rule_coverage(df, truth, (("k", ("k",)), ("j", ("j",)))).collect()}
    assert cover == {"k": (1, 1), "j": (3, 2), "__union__": (3, 2)}
    assert rule_pairs(df, ("k",)).count() == 1
    new = spark.createDataFrame([("n", "2", "q")], "record_id string, k string, j string")
    assert [r.record_id for r in touching_old_rows(new, df, (("k", ("k",)), ("j", ("j",)))).collect()] == ["d"]


def test_fuzzy_candidates(spark):
    new = spark.createDataFrame([("n1", "jonathan", "e1")], "record_id string, first_name_std string, email_std string")
    old = spark.createDataFrame([("o1", "jonathon", None), ("o2", "maria", "e1"), ("o3", "peter", None)], new.schema)
    assert {r.record_id for r in fuzzy_old_rows(new, old).collect()} == {"o1", "o2"}


def test_unordered_anti_join_and_canonical(spark):
    queue = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], PAIRS)
    gold = spark.createDataFrame([("b", "a")], PAIRS)
    assert [tuple(r) for r in labels.exclude_gold(queue, gold).collect()] == [("c", "d")]
    swapped = labels.canonical(spark.createDataFrame([("b", "a", 1, 2)], PAIRS + ", x_l int, x_r int")).first()
    assert tuple(swapped) == ("a", "b", 2, 1)


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("d", "e")], [], [("a", "a")], [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: root(x) for x in parent}


def test_entities(spark):
    records = spark.createDataFrame([(x,) for x in "abcde"], "record_id string")
    edges = spark.createDataFrame([("b", "d"), ("a", "zz")], PAIRS)
    mapped = entities.cluster(records, edges)
    assert {r.record_id: r.entity_id for r in mapped.collect()} == {"a": "ent_000001", "b": "ent_000002", "c": "ent_000003", "d": "ent_000002", "e": "ent_000004"}
    grown = entities.incremental_cluster(mapped, spark.createDataFrame([("n1",), ("n2",), ("n3",)], "record_id string"), spark.createDataFrame([("a", "n1"), ("c", "n1"), ("n2", "n3")], PAIRS))
    got = {r.record_id: r.entity_id for r in grown.collect()}
    assert got["a"] == got["c"] == got["n1"] == "ent_000001" and got["n2"] == got["n3"] == "ent_000005" and got["b"] == "ent_000002"
    assert [r.entities for r in entities.merge_events(mapped, grown).collect()] == [["ent_000001", "ent_000003"]]
    with pytest.raises(entities.GuardError):
        entities.split_entity(mapped, edges, "ent_000002", ["d"])
    assert {r.record_id: r.entity_id for r in entities.split_entity(mapped, edges, "ent_000002", ["d"], force=True).collect()}["d"] == "ent_000005"
    devices = spark.createDataFrame([("a", ["x"]), ("c", ["y"])], "record_id string, device_ids_std array<string>")
    with pytest.raises(entities.GuardError):
        entities.merge_entities(mapped, devices, "ent_000001", "ent_000003")
    redone = entities.recompute_touched(mapped, spark.createDataFrame([("d",)], "record_id string"), spark.createDataFrame([("c", "d")], PAIRS))
    got = {r.record_id: r.entity_id for r in redone.collect()}
    assert got["c"] == got["d"] and got["b"] != got["d"] and len(got) == 5


def test_guarded(spark):
    records = spark.createDataFrame([(x,) for x in "abcd"], "record_id string")
    pairs = spark.createDataFrame([("a", "b", "MATCH"), ("b", "c", "MATCH"), ("a", "c", "NON_MATCH")], PAIRS + ", decision string")
    got = {r.record_id: r.cluster_status for r in entities.guarded_cluster(records, pairs).collect()}
    assert got == {"a": "REVIEW", "b": "REVIEW", "c": "REVIEW", "d": "SINGLETON"}


def test_violations_and_devices(spark):
    mapped = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "one"), ("d", "two")], "record_id string, entity_id string")
    lab = spark.createDataFrame([("a", "b", True), ("a", "c", False), ("a", "d", True), ("a", "missing", True)], PAIRS + ", is_positive boolean")
    r = evaluate.reviewed_violations(mapped, lab).first()
    assert (r.missing, r.positives_split, r.negatives_merged, r.implicated_entities, r.implicated_records, r.largest_implicated) == (1, 1, 1, 1, 3, 3)
    recs = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["x"]), ("d", None)], "record_id string, device_ids_std array<string>")
    two = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", "two")], mapped.schema)
    r = evaluate.device_reference(two, recs, evaluate.device_truth(recs)).first()
    assert (r.reference_pairs_split, r.mixed_entities, r.records_without_device) == (1, 1, 1)


def test_outside_blocking(spark):
    recs = spark.createDataFrame([("a", "green"), ("b", "green"), ("c", "green"), ("d", "blue")], "record_id string, k string")
    out = labels.outside_blocking(recs, spark.createDataFrame([("a", "b")], PAIRS), spark.createDataFrame([("a", "c")], PAIRS), (("k", ("k",)),), 10)
    assert [tuple(r)[:2] for r in out.collect()] == [("b", "c")]


def test_master(spark):
    rows = [("e1", "r1", "anna", "x", "s1"), ("e1", "r2", "anna", "y", "s2"), ("e1", "r3", "an1na", None, "s1"), ("e2", "r4", None, "z", "s1")]
    df = spark.createDataFrame(rows, "entity_id string, record_id string, first_name_std string, city_std string, source string").withColumn("customer_id", F.col("record_id"))
    m = {r.entity_id: r for r in survivorship.master(df, ["first_name_std", "city_std"]).collect()}
    assert m["e1"].master_first_name_std == "anna" and m["e1"].master_city_std == "x" and m["e1"].conflicted_fields == ["city_std", "first_name_std"] and m["e1"].status == "CONFLICTED"
    assert m["e2"].master_first_name_std is None and m["e2"].conflicted_fields == [] and m["e1"].record_ids == ["r1", "r2", "r3"]


def test_model(spark):
    raw = stress.synthetic_crm(spark, 300)
    records = standardize(raw, Settings(nfkc=False), ["customer_pk"], dayfirst={"dob": True}).cache()
    fitted = model.train(records, max_pairs=5_000)
    again = model.Model.from_json(fitted.to_json())
    assert again.fingerprint() == fitted.fingerprint()
    scored = model.predict(records, fitted).cache()
    truth = evaluate.device_truth(records)
    hit = scored.join(truth, PAIR, "left_semi").agg(F.avg("match_probability")).first()[0]
    miss = scored.join(truth, PAIR, "left_anti").agg(F.avg("match_probability")).first()[0]
    assert hit > 0.9 > 0.5 > miss
    swapped = scored.select(F.col(PAIR[1]).alias(PAIR[0]), F.col(PAIR[0]).alias(PAIR[1]))
    back = model.score_pairs(swapped, records, fitted).agg(F.sum("match_weight")).first()[0]
    assert back == pytest.approx(scored.agg(F.sum("match_weight")).first()[0], rel=1e-6)
    with pytest.raises(model.UntrainedError):
        model.Model(0.1, {"name": {1: 0.0}}, {"name": {1: 0.1}}).check()
    assert model.freshness({"gold": "1", "model": "2"}, {"gold": "9", "model": "8"}) == {"missing": [], "changed": ["gold", "model"]}


def test_em_recovers_known_parameters():
    class C:
        def __init__(self, name):
            from amalgam.operators.comparison import Level

            self.name, self.levels = name, [Level(1, None, 0.5), Level(0, None, 0.5)]

    m, u, prior = {"a": 0.9, "b": 0.8, "c": 0.95}, {"a": 0.1, "b": 0.05, "c": 0.2}, 0.2
    vectors = []
    for k in range(8):
        bits = {n: k >> i & 1 for i, n in enumerate("abc")}
        like = lambda t: 1.0 if not t else 1.0
        pm = pu = like(None)
        for n, g in bits.items():
            pm *= m[n] if g else 1 - m[n]
            pu *= u[n] if g else 1 - u[n]
        vectors.append((bits, 1e6 * (prior * pm + (1 - prior) * pu)))
    got, _ = model.em(vectors, 0.1, {n: {1: 0.7, 0: 0.3} for n in "abc"}, {n: {1: u[n], 0: 1 - u[n]} for n in "abc"}, [C(n) for n in "abc"], stop=1e-9, rounds=500)
    assert all(got[n][1] == pytest.approx(m[n], abs=0.01) for n in "abc")


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["id"]).collect())) == [(1, "a", "k"), (2, "B", "k"), (3, "C", None)]
    assert sinks.upsert(old, new, ["id"], update=False).count() == 3
    with pytest.raises(ValueError):
        sinks.update_master_row(old, "e", {"nope": "x"})


def test_order_and_numbers(spark):
    df = spark.createDataFrame([("13/01/2000",), ("01/02/2000",)], "dob string")
    assert resolve_dayfirst(df, "dob") is True
    with pytest.raises(ContractError):
        resolve_dayfirst(spark.createDataFrame([("01/02/2000",)], "dob string"), "dob")
    got = global_row_number(spark.range(1000).select((F.lit(1000) - F.col("id")).alias("v")), ["v"], "n").orderBy("v").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_graph_components_take_all_events(spark, tmp_path):
    from amalgam.plans.queries import QUERIES

    events = [(i, i * 7919 % 900) for i in range(1, 400)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for event, user in events:
        a, b = sorted((find(user), find(user + event % 7 * 13)))
        root[b] = a
    got = {r.node: r.component for r in QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root} and len(set(got.values())) < len(got) / 2


def test_shadow_threshold_and_features(spark):
    import random

    from amalgam.operators import shadow

    rng = random.Random(3)
    for top in (1.0, 0.02):
        rows = [(float(rng.random() < s / top), s) for s in (round(rng.random() ** 0.05 * top, 3) for _ in range(300))]
        f1 = lambda t: 2 * sum(y for y, s in rows if s >= t) / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows))
        want = max(sorted({s for _, s in rows}), key=f1)
        assert shadow.best_threshold(spark.createDataFrame(rows, "y double, s double"), "s") == want
    assert shadow.best_threshold(spark.createDataFrame([(0.0, 0.991), (1.0, 0.999)], "y double, s double"), "s") == 0.999
    records = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("c", "y", "1")], "record_id string, email_std string, phone_std string")
    for c in sorted({c for columns in labels.FLAGS.values() for c in columns} - {"email_std", "phone_std"}):
        records = records.withColumn(c, F.lit("same"))
    got = {r.record_id_r: (r.agree_email, r.agree_phone, r.agree_name) for r in shadow.with_agreements(spark.createDataFrame([("a", "b"), ("a", "c")], PAIRS), records).collect()}
    assert got == {"b": (1, 0, 1), "c": (0, 0, 1)}


def test_recovery_of_damaged_copies(spark):
    names = list(stress.KINDS)
    rows = [(f"r{i:03d}", "santoso", "anna", f"anna{i}@example.com", f"0812345{i:04d}", "merdeka 12", "1988-04-25") for i in range(200)]
    rows.append(("none", None, None, None, None, None, None))
    df = spark.createDataFrame(rows, "record_id string, " + ", ".join(f"{c} string" for c in names))
    old = {r[0]: r[1:] for r in rows}
    copies = stress.damaged_copies(df).collect()
    assert len(copies) == len(rows)
    for r in copies:
        changed = [c for c, v in zip(names, old[r.copy_of]) if r[c] != v]
        assert r.damaged == len(changed) and [o.split(":")[0] for o in r.ops.split(";") if "skipped" not in o and o != "none"] == changed
    assert {o.split(":")[0] for r in copies for o in r.ops.split(";")} >= set(names)
    assert sum(r.email_std != old[r.copy_of][2] for r in copies) > 150
    made = spark.createDataFrame([("a", "b", 1), ("c", "d", 2), ("e", "f", 2)], PAIRS + ", damaged int")
    scored = spark.createDataFrame([("a", "b", 0.84), ("c", "d", 0.3)], PAIRS + ", match_probability double")
    assert {tuple(r) for r in evaluate.recovery_by_count(made, scored).collect()} == {(1, 1, 1, 0), (2, 2, 0, 1)}


def some_records(spark, n=60):
    import random

    rng = random.Random(4)
    rows = [(f"r{i:03d}", *(rng.choice([None, "aaab", "aaac", "bbbb", "cccc"]) for _ in range(2)), rng.choice([None, "x", "y", "z"])) for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, first_name_std string, last_name_std string, city_std string")
    return df.withColumns({f"{c}_pre3": F.substring(c, 1, 3) for c in ("first_name_std", "last_name_std")})


SOME_RULES = (("name", ("first_name_std", "last_name_std")), ("city", ("city_std",)), ("prefix", ("last_name_std_pre3", "first_name_std_pre3")), ("both", ("city_std", "first_name_std")))


def brute_pairs(rows, rules):
    agree = lambda a, b, columns: all(a[c] is not None and a[c] == b[c] for c in columns)
    return {(a.record_id, b.record_id): next(n for n, c in rules if agree(a, b, c)) for a in rows for b in rows if a.record_id < b.record_id and any(agree(a, b, c) for _, c in rules)}


def test_pairs_bring_their_columns_and_keep_their_rule(spark):
    df = some_records(spark)
    rows = df.collect()
    of, want = {r.record_id: r for r in rows}, brute_pairs(rows, SOME_RULES)
    got = or_join(df, SOME_RULES, ["last_name_std"]).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r.rule for r in got} == want and "prefix" in want.values()
    assert all((r.last_name_std_l, r.last_name_std_r) == (of[r[0]].last_name_std, of[r[1]].last_name_std) for r in got)


def test_pairs_are_counted_from_blocks(spark):
    from amalgam.operators.blocking import count_pairs, pairs_of

    df = some_records(spark)
    want = brute_pairs(df.collect(), SOME_RULES)
    groups = {n: [(n, c)] for n, c in SOME_RULES} | {"all": SOME_RULES}
    got = {r.name: r.pairs for r in count_pairs(df, groups).collect()}
    assert got == {n: len(brute_pairs(df.collect(), g)) for n, g in groups.items()} and got["all"] == len(want)
    assert {(r[0], r[1]) for r in pairs_of(df, "r007", SOME_RULES).collect()} == {p for p in want if "r007" in p}
