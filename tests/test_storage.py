import io
import json
import uuid

import pytest
from pyspark.sql import functions as F

from amalgam import cli, storage
from amalgam.functions.similarity import jaro_winkler, jaro_winkler_many
from amalgam.operators import stress
from amalgam.ranking import order_statistics
from amalgam.service import Service
from amalgam.sinks import Staging, merge_statement, run_sql, save_to_table, upsert, upsert_jdbc
from amalgam.sources.database import list_tables, read_table

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(params=["local", "hadoop"])
def folder(request, spark, tmp_path, monkeypatch):
    """A folder by plain paths, and the same through Spark's file systems."""
    if request.param == "hadoop":
        monkeypatch.setattr(storage, "_remote", lambda path: True)
    return f"file://{tmp_path}"


def test_text_files(folder):
    path = f"{folder}/a/b.txt"
    assert storage.read_text(path) is None and not storage.move_away(path)
    storage.write_text(path, "één")
    storage.write_text(path, "twee")
    assert storage.read_text(path) == "twee"
    assert not storage.create_text(path, "x") and storage.create_text(f"{path}2", "x") and storage.read_text(f"{path}2") == "x"
    assert storage.move_away(path) and storage.read_text(path) is None


def test_staging_on_any_file_system(spark, folder):
    s = Staging(spark, folder, "a")
    s.write(spark.range(3), "t")
    s.commit(7)
    assert Staging(spark, folder).read("t").count() == 3 and Staging(spark, folder).manifest()["batch"] == 7


def test_scratch_cleans_up(spark, tmp_path):
    with storage.scratch(spark):
        df = storage.materialize(spark.range(5), "gone")
        path = df.inputFiles()[0]
        assert df.count() == 5
    assert storage.read_text(path) is None


def test_upsert_takes_the_last_row(spark):
    old = spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "n", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, upsert(old, new, ["k"], seq="seq").collect())) == [(1, "a", "z"), (2, "y", "z"), (3, "n", None)]
    assert sorted(map(tuple, upsert(old, new, ["k"], False, "seq").collect())) == [(1, "a", "z"), (2, "b", "z"), (3, "n", None)]


def test_database_upsert(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    run_sql(spark, url, 'CREATE TABLE "entities" ("entity_id" VARCHAR(20) PRIMARY KEY, "city" VARCHAR(20), "note" VARCHAR(20))', 'CREATE TABLE "pairs" ("record_id_l" VARCHAR(20), "record_id_r" VARCHAR(20), "p" DOUBLE)', 'CREATE TABLE "other" ("x" INT)', **DERBY)
    rows = spark.createDataFrame([("e1", "a", 1, "?"), ("e1", "b", 2, "?"), ("e2", "c", 1, "?")], "entity_id string, city string, seq int, unknown string")
    for _ in range(2):  # a run that is repeated changes nothing
        upsert_jdbc(rows, url, "entities", ["entity_id"], seq="seq", **DERBY)
    read = lambda t: read_table(spark, url, t, schema=None, **DERBY)
    assert sorted(map(tuple, read("entities").collect())) == [("e1", "b", None), ("e2", "c", None)]
    upsert_jdbc(rows.limit(1).withColumn("city", F.lit("z")), url, "entities", ["entity_id"], update=False, **DERBY)
    assert read("entities").where("city = 'z'").count() == 0
    save_to_table(rows.withColumn("city", F.lit("new")), url, "entities", "seq", **DERBY)
    assert {r.city for r in read("entities").collect()} == {"new"}
    pairs = spark.createDataFrame([("a", "b", 0.5)], "record_id_l string, record_id_r string, p double")
    for p in (0.5, 0.7):  # pairs stay as they were first
        save_to_table(pairs.withColumn("p", F.lit(p)), url, "pairs", **DERBY)
    assert [r.p for r in read("pairs").collect()] == [0.5]
    with pytest.raises(ValueError):
        save_to_table(spark.createDataFrame([(1,)], "x int"), url, "other", **DERBY)
    with pytest.raises(ValueError):
        upsert_jdbc(pairs, url, "entities", ["entity_id"], **DERBY)
    assert {r.table_name for r in list_tables(spark, url, **DERBY).collect()} == {"entities", "pairs", "other"}
    parted = read_table(spark, url, "pairs", partition=("p", 0, 1, 2), schema=None, **DERBY)
    assert parted.rdd.getNumPartitions() >= 1 and parted.count() == 1


def test_merge_statements():
    assert merge_statement('"t"', '"s"', ["k", "v"], ["k"], True, "postgresql") == 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "s" ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"'
    assert merge_statement('"t"', '"s"', ["k", "v"], ["k"], False, "postgresql").endswith("DO NOTHING")


def test_many_similarities():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé@.1") for _ in range(rng.randint(0, 20)))
    a = [word() for _ in range(600)] + ["x" * 70, "", "same"]
    b = [w if rng.random() < 0.1 else w[: len(w) // 2] + word() for w in a[:600]] + ["x" * 69 + "y", "a", "same"]
    assert [round(x, 12) for x in jaro_winkler_many(a, b)] == [round(jaro_winkler(x, y), 12) for x, y in zip(a, b)]
    wide = ["".join(map(chr, range(300, 360))), "".join(map(chr, range(400, 460)))]
    assert jaro_winkler_many(wide, wide[::-1]).tolist() == [0.0, 0.0]


@pytest.mark.parametrize("values", [[3.0, 1.0, 2.0, 2.0, None], [5.0], list(map(float, range(101))), []])
def test_order_statistics(spark, values):
    import numpy as np

    got = order_statistics(spark.createDataFrame([(v,) for v in values], "s double"), "s", [0.0, 0.025, 0.5, 0.9, 1.0])
    known = [v for v in values if v is not None]
    assert got == [None] * 5 if not known else got == pytest.approx(np.quantile(known, [0.0, 0.025, 0.5, 0.9, 1.0]).tolist())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A run from the command line over a CSV file."""
    base = tmp_path_factory.mktemp("run")
    stress.synthetic_crm(spark, 60).drop("updated_at", "signup_date").coalesce(1).write.option("header", True).csv(str(base / "in.csv"))
    out = cli.run(spark, cli.arguments(["run", str(base / "in.csv"), "--out", str(base / "out"), "--order", "customer_pk", "--columns", "first_name", "email", "phone", "dob", "--date-order", "dmy"]))
    return str(base), out


def test_command_line(spark, stored):
    base, out = stored
    assert out["rows"]["processed_customers"] == 60 and out["entities"]["records"] == 60 and out["scope"] == "full"
    assert cli.entity(spark, f"{base}/out", "rec_000001")["entity_id"] == "ent_000001" and cli.entity(spark, f"{base}/out", "rec_999999") is None
    assert cli.main(["run", f"{base}/in.csv", "--out", f"{base}/out", "--sample"]) == 1  # a sample may not replace the full map


def asked(service, method, path, body=b"", query=""):
    said = []
    out = b"".join(service({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda status, _: said.append(status)))
    try:
        return int(said[0][:3]), json.loads(out)
    except ValueError:
        return int(said[0][:3]), out.decode()


def test_service(spark, stored):
    s = Service(spark, f"{stored[0]}/out")
    assert asked(s, "GET", "/health")[1]["records"] == 60 and "linkage_entities" in asked(s, "GET", "/metrics")[1]
    assert {r["decision"] for r in asked(s, "GET", "/stats")[1]} >= {"MATCH"}
    code, pairs = asked(s, "GET", "/pairs", query="size=3&decision=MATCH")
    assert code == 200 and 0 < len(pairs) <= 3
    assert asked(s, "GET", "/entity/ent_000001")[1]["records"][0] == "rec_000001" and asked(s, "GET", "/entity/none")[0] == 404
    assert asked(s, "GET", "/record/rec_000010")[1]["record_id"] == "rec_000010" and asked(s, "GET", "/nowhere")[0] == 404
    assert asked(s, "GET", "/search", query="q=ANNA")[0] == 200 and "record_id_l" in asked(s, "GET", "/download/pairs.csv")[1].split("\n")[0]
    queue = asked(s, "GET", "/review-queue")[1]
    if queue:
        answer = {k: queue[0][k] for k in ("record_id_l", "record_id_r")} | {"label": "match", "reviewer": "ann"}
        assert asked(s, "POST", "/review-queue", json.dumps(answer).encode())[0] == 200
        assert any(r["label"] == "match" for r in asked(s, "GET", "/review-queue")[1])
    assert asked(s, "POST", "/review-queue", json.dumps({"record_id_l": "x", "record_id_r": "y", "label": "match"}).encode())[0] == 404
    assert asked(s, "POST", "/review-queue", json.dumps({"record_id_l": "x", "record_id_r": "y", "label": "who knows"}).encode())[0] == 422
    assert asked(s, "POST", "/run", b"first_name;email\n")[0] == 422
    assert asked(Service(spark, f"{stored[0]}/nothing"), "GET", "/stats")[0] == 404
