import pytest
from pyspark.sql import functions as F

from amalgam.config import Settings
from amalgam.operators import decide, entities, model, stress
from amalgam.operators.blocking import PAIR
from amalgam.operators.standardize import standardize
from amalgam.plans.pair_queries import FIXED as STATED
from amalgam.sinks import Staging
from amalgam.sources.database import fetch, inspect, latest_watermark, quoted, rename_columns
from amalgam.sources.files import parse_payload, read_csv_any, read_dataset, sniff_separator
from amalgam.sources.registry import Registry
from amalgam.streaming.incremental import AlertGate, Linker, ReplayError, RunLock, Watermarks, apply_staged, check_replay, current_entities, export_batch, ingest, link_batch, staging_rows, update_records

FIXED = model.Model(STATED.prior, STATED.m, STATED.u, (("email_exact", ("email_std",)), ("phone_exact", ("phone_std",)), ("name_dob", ("last_name_std", "dob_std"))))
CONF = Settings(nfkc=False, date_order="dmy")


@pytest.fixture(scope="module")
def records(spark):
    return standardize(stress.synthetic_crm(spark, 120), CONF, ["customer_pk"]).cache()


def full_map(records):
    pairs = model.predict(records, FIXED, keep=["email_std", "first_name_std", "last_name_std", "address_std", "phone_std", "dob_std", "city_std"]).withColumn("decision", decide.decision(F.col("match_probability")))
    edges = decide.apply_business_rules(pairs).where("decision = 'MATCH'").select(*PAIR)
    return entities.cluster(records, edges), edges


def groups(mapped):
    out = {}
    for r in mapped.collect():
        out.setdefault(r.entity_id, set()).add(r.record_id)
    return sorted(map(sorted, out.values()))


def test_incremental_equals_full(spark, records):
    old, new = records.where("record_id <= 'rec_000080'"), records.where("record_id > 'rec_000080'")
    before, _ = full_map(old)
    pairs, after = link_batch(new, old, before, FIXED, CONF)
    assert groups(after) == groups(full_map(records)[0])
    with pytest.raises(ReplayError):
        check_replay(new, records)
    staged = staging_rows(new, pairs, before, after)
    assert staged.count() == 40 and staged.where("action = 'match'").count() > 0
    kept = apply_staged(before, staged.withColumn("approved", F.lit(False)))
    assert kept.join(new, "record_id").select("entity_id").distinct().count() == 40


def test_update(spark, records):
    mapped, edges = full_map(records)
    pair = edges.first()
    changed = records.where(F.col("record_id") == pair[1]).withColumns({c: F.lit(f"zz{c}") for c in ("email_std", "phone_std", "first_name_std", "last_name_std", "address_std", "city_std", "phone_pre7", "phone_last4", "dob_std", "dob_year_std", "first_name_std_pre3", "last_name_std_pre3")})
    stored, new_edges, redone = update_records(records, changed, mapped, edges, FIXED, CONF)
    got = {r.record_id: r.entity_id for r in redone.collect()}
    assert stored.count() == 120 and len(got) == 120 and got[pair[0]] != got[pair[1]]


def test_stream(spark, tmp_path):
    raw = stress.synthetic_crm(spark, 90)
    for k in range(3):
        raw.where((F.col("customer_pk") >= 30 * k) & (F.col("customer_pk") < 30 * k + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    prepare = lambda b: standardize(b, Settings(nfkc=False, date_order="dmy", record_id_column="customer_pk"))
    linker = Linker(spark, str(tmp_path / "state"), FIXED, prepare, CONF)
    q = linker.start(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    q.awaitTermination(240)
    assert q.exception() is None
    state = Staging(spark, str(tmp_path / "state"))
    assert state.read("records").count() == 90 and current_entities(state).count() == 90
    assert groups(current_entities(state)) == groups(full_map(prepare(raw))[0])
    assert len(state.paths("records")) == 3  # a batch adds a part, what was there is not written again
    assert state.read("entities").groupBy("batch").count().count() == 3
    linker(raw.limit(1), state.manifest()["batch"])  # delivered again
    assert Staging(spark, str(tmp_path / "state")).read("records").count() == 90


def test_a_batch_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    raw = stress.synthetic_crm(spark, 40)
    prepare = lambda b: standardize(b, Settings(nfkc=False, date_order="dmy", record_id_column="customer_pk"))
    linker = Linker(spark, str(tmp_path / "state"), FIXED, prepare, CONF)
    linker(raw.where("customer_pk < 20"), 0)
    with monkeypatch.context() as m:
        m.setattr(Staging, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            linker(raw.where("customer_pk >= 20"), 1)
    assert Staging(spark, str(tmp_path / "state")).read("records").count() == 20
    linker(raw.where("customer_pk >= 20"), 1)  # delivered again
    state = Staging(spark, str(tmp_path / "state"))
    assert state.read("records").count() == 40 and groups(current_entities(state)) == groups(full_map(prepare(raw))[0])


def test_staging(spark, tmp_path):
    one = Staging(spark, str(tmp_path))
    one.write(spark.range(3), "t")
    assert one.read("t").count() == 3 and Staging(spark, str(tmp_path)).read("t") is None and one.pending()
    assert one.commit() == ["t"] and Staging(spark, str(tmp_path)).read("t").count() == 3
    two = Staging(spark, str(tmp_path))
    two.write(spark.range(9), "t")
    two.rollback()
    assert two.read("t").count() == 3


def test_watermarks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02"), (4, "2024-01-03")], "pk int, updated_at string")
    assert [r.pk for r in fetch(df, watermark="2024-01-02").collect()] == [4]
    assert sorted(r.pk for r in fetch(df, watermark="2024-01-02", pk="pk", last_pk=2).collect()) == [3, 4]
    assert latest_watermark(df, pk="pk") == {"value": "2024-01-03", "last_pk": 4} and latest_watermark(df, "nope") is None
    marks, seen = Watermarks(str(tmp_path / "w.json")), []
    assert ingest(df, marks, "s", "t", lambda b: seen.append(b.count()), pk="pk") == 4 and ingest(df, marks, "s", "t", seen.append, pk="pk") == 0
    with pytest.raises(RuntimeError):
        ingest(df.union(spark.createDataFrame([(5, "2025-01-01")], df.schema)), marks, "s", "t", lambda b: (_ for _ in ()).throw(RuntimeError()), pk="pk")
    assert marks.read("s", "t")["last_pk"] == 4


def test_rows_that_arrive_while_a_batch_is_applied_are_in_the_next(spark, tmp_path):
    path, marks = str(tmp_path / "source"), Watermarks(str(tmp_path / "w.json"))
    add = lambda *rows: spark.createDataFrame(rows, "pk int, updated_at string").coalesce(1).write.mode("append").parquet(path)
    add((1, "2024-01-01"), (2, "2024-01-02"))
    seen = []

    def apply(batch):
        add((3, "2024-01-03"))
        seen.extend(r.pk for r in batch.collect())

    assert ingest(spark.read.parquet(path), marks, "s", "t", apply, pk="pk") == 2
    assert ingest(spark.read.parquet(path), marks, "s", "t", lambda b: seen.extend(r.pk for r in b.collect()), pk="pk") == 1
    assert sorted(seen) == [1, 2, 3]


def test_export_registers_content_once(spark, tmp_path):
    registry, df = Registry(str(tmp_path / "r.json")), spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    first = export_batch(df, registry, str(tmp_path))
    assert first["status"] == "exported" and read_csv_any(spark, first["file"]).count() == 2
    assert export_batch(df.orderBy(F.desc("a")), registry, str(tmp_path))["status"] == "already_registered"
    other = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert export_batch(other, registry, str(tmp_path))["status"] == "exported" and len(Registry(str(tmp_path / "r.json")).batches) == 2


def test_parts_are_written_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Staging, "MOST_PARTS", 2)
    for k in range(5):
        s = Staging(spark, str(tmp_path), f"r{k}")
        s.append(spark.range(k, k + 1), "t")
        s.commit(k)
    state = Staging(spark, str(tmp_path))
    assert sorted(r.id for r in state.read("t").collect()) == [0, 1, 2, 3, 4] and len(state.paths("t")) <= 2 and state.manifest()["batch"] == 4


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;phone\n1;0811\n2;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,name\n3,Jos\xe9\n".encode("latin-1"))
    a, b = read_csv_any(spark, str(tmp_path / "a.csv")), read_csv_any(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in a.collect()] == [("1", "0811"), ("2", None)] and b.first().name == "José"
    rows = read_dataset(spark, [("b1", str(tmp_path / "a.csv")), ("b2", str(tmp_path / "b.csv"))]).orderBy("batch_no", "row_no").collect()
    assert [(r.batch_id, r.row_no, r.id) for r in rows] == [("b1", 1, "1"), ("b1", 2, "2"), ("b2", 1, "3")]
    assert [tuple(r) for r in parse_payload(spark, b"x;y\n1;2\n").collect()] == [("1", "2")]
    assert sniff_separator("a:b:c") == ":" and sniff_separator("a,b") == "," and quoted("t") == '"linkage_data"."t"'
    with pytest.raises(ValueError):
        rename_columns(spark.createDataFrame([("1", "2")], "telp string, no_telp string"))
    assert inspect(["first_name", "x"])["unmapped"] == ["x"]


def test_registry_lock_gate(tmp_path):
    r = Registry(str(tmp_path / "r.json"))
    r.register("f1", 10, "h1")
    r.register("f2", 5, "h2")
    with pytest.raises(ValueError):
        r.register("f3", 1, "h1")
    r.unregister("f1")
    assert r.next_start() == 15 and Registry(str(tmp_path / "r.json")).problems(5) == []
    lock = RunLock(str(tmp_path / "lock"))
    assert lock.acquire(now=0) and not lock.acquire(now=10) and lock.acquire(now=8000) and not lock.acquire(now=8001)
    lock.release()
    assert lock.acquire(now=8002)
    gate, alert = AlertGate(100), {"level": "w", "source": "s", "message": "m"}
    assert gate.should_send(alert, 0) and not gate.should_send(alert, 50) and gate.should_send(alert, 150)
