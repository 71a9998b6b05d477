"""Writers: staged and atomic files, keyed merges, normalized outputs, exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import label_of
from .operators.labels import canonical, keyed
from .operators.survivorship import plain
from .ranking import keep_last
from .storage import read_text, write_text


def atomic_text(text: str, path: str) -> None:
    """A file that is whole or as it was."""
    write_text(path, text)


def atomic_json(value, path: str) -> None:
    """A JSON file that is whole or as it was."""
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str))


def append_jsonl(row: dict, path: str) -> None:
    """One more JSON line; a file on the driver, as logs are."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, sort_keys=True, default=str) + "\n")


def write_meta(artifact: str, **values) -> None:
    atomic_json(values, f"{artifact}.meta.json")


class Staging:
    """Versioned tables below one folder: writes go to a run's own folders, and one file, the manifest, says which folders
    make up each table. Commit replaces the manifest in one move, with the id of the batch that was applied: all or nothing.

    Readers of the same run see staged tables; others see what was committed last.
    """

    MOST_PARTS = 32

    def __init__(self, spark: SparkSession, root: str, run: str | None = None) -> None:
        self.spark, self.root, self.run, self.staged = spark, root.rstrip("/"), run or uuid.uuid4().hex, {}

    def manifest(self) -> dict:
        return json.loads(read_text(f"{self.root}/manifest.json") or '{"tables": {}, "batch": null}')

    def paths(self, name: str) -> list[str]:
        return self.staged.get(name) or self.manifest()["tables"].get(name, [])

    def write(self, df: DataFrame, name: str) -> None:
        """The whole table anew."""
        path = f"{self.root}/{name}/run_id={self.run}"
        df.write.mode("overwrite").parquet(path)
        self.staged[name] = [path]

    def append(self, df: DataFrame, name: str) -> None:
        """More rows of the table; its other parts stay, until there are so many that they are written as one."""
        before = self.paths(name)
        if len(before) >= self.MOST_PARTS:
            self.write(self.spark.read.parquet(*before).unionByName(df, allowMissingColumns=True), name)
            return
        path = f"{self.root}/{name}/run_id={self.run}"
        df.write.mode("overwrite").parquet(path)
        self.staged[name] = [*before, path]

    def read(self, name: str) -> DataFrame | None:
        paths = self.paths(name)
        return self.spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths) if paths else None

    def commit(self, batch: int | None = None) -> list[str]:
        now = self.manifest()
        names = sorted(self.staged)
        atomic_json({"tables": now["tables"] | self.staged, "batch": now["batch"] if batch is None else batch}, f"{self.root}/manifest.json")
        self.staged = {}
        return names

    def rollback(self) -> None:
        self.staged = {}

    def pending(self) -> bool:
        return bool(self.staged)


def one_per_key(df: DataFrame, key: Sequence[str], seq: str | None) -> DataFrame:
    """The last row of each key by ``seq``; without one, the greatest row, so that reruns agree."""
    key = list(key)
    if seq:
        return keep_last(df, key, seq)
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__row"))
    return best.select(*key, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def append_new(old: DataFrame, extra: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Old rows and, by name, extra ones whose key is not there yet."""
    fresh = extra.join(old.select(*key), list(key), "left_anti") if key else extra
    return old.unionByName(fresh, allowMissingColumns=True)


def replace_rows(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], update: bool = True, seq: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE or NOTHING; only columns of the target are written, others keep their value. Of
    rows with one key the last by ``seq`` counts."""
    key = list(key)
    new = one_per_key(new.select(*[c for c in new.columns if c in old.columns or c == seq]), key, seq)
    new = new.select(*[c for c in new.columns if c in old.columns])
    if not update:
        return append_new(old, new, key)
    marked = new.select(*key, *[F.col(c).alias(f"__new_{c}") for c in new.columns if c not in key], F.lit(True).alias("__hit"))
    both = old.join(marked, key, "full")
    value = lambda c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in key or c not in new.columns else value(c) for c in old.columns])


def merge_statement(target: str, source: str, columns: Sequence[str], key: Sequence[str], update: bool, dialect: str) -> str:
    """One statement that moves rows of ``source`` into ``target``: INSERT ... ON CONFLICT for PostgreSQL, MERGE for others."""
    name = lambda c: '"' + c.replace('"', '""') + '"'
    rest, listed = [c for c in columns if c not in key], ", ".join(map(name, columns))
    if dialect == "postgresql":
        what = "UPDATE SET " + ", ".join(f"{name(c)} = EXCLUDED.{name(c)}" for c in rest) if update and rest else "NOTHING"
        return f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {source} ON CONFLICT ({', '.join(map(name, key))}) DO {what}"
    on = " AND ".join(f"t.{name(c)} = s.{name(c)}" for c in key)
    hit = " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{name(c)} = s.{name(c)}" for c in rest) if update and rest else ""
    return f"MERGE INTO {target} t USING {source} s ON {on}{hit} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{name(c)}' for c in columns)})"


def run_sql(spark: SparkSession, url: str, *statements: str, user: str | None = None, password: str | None = None, driver: str | None = None, **_: str) -> None:
    """Statements in one transaction of a database, from the driver."""
    jvm = spark._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url, *([user, password or ""] if user else []))
    try:
        connection.setAutoCommit(False)
        for text in statements:
            statement = connection.createStatement()
            statement.execute(text)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def upsert_jdbc(df: DataFrame, url: str, table: str, key: Sequence[str], update: bool = True, seq: str | None = None, dialect: str | None = None, **options: str) -> None:
    """Upserts ``df`` into a database table that is there: rows go to a staging table, in parallel from the executors, and from
    it in one statement to ``table``, so a run that is repeated changes nothing. Only the table's own columns are written."""
    from .sources.database import quoted

    spark, key = df.sparkSession, list(key)
    target = quoted(table, None)
    have = spark.read.format("jdbc").options(url=url, dbtable=target, **options).load().columns
    columns = [c for c in df.columns if c in have]
    if not set(key) <= set(columns):
        raise ValueError(f"{table} or the rows lack a key column of {key}")
    last = one_per_key(df.select(*columns, *([seq] if seq and seq not in columns else [])), key, seq).select(columns)
    stage, listed = quoted(f"stage_{uuid.uuid4().hex[:12]}", None), ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    kind = dialect or ("postgresql" if url.startswith("jdbc:postgresql") else "merge")
    run_sql(spark, url, f"CREATE TABLE {stage} AS SELECT {listed} FROM {target} WITH NO DATA", **options)  # the target's own types
    try:
        last.write.format("jdbc").options(url=url, dbtable=stage, **options).mode("append").save()
        run_sql(spark, url, merge_statement(target, stage, columns, key, update, kind), **options)
    finally:
        run_sql(spark, url, f"DROP TABLE {stage}", **options)


def save_to_table(df: DataFrame, url: str, table: str, seq: str | None = None, **options: str) -> None:
    """Rows to a table by the rule that its columns imply; tables without one are refused."""
    from .sources.database import quoted

    rule = conflict_policy(df.sparkSession.read.format("jdbc").options(url=url, dbtable=quoted(table, None), **options).load().columns)
    if rule is None:
        raise ValueError(f"no rule tells how rows of {table} meet")
    upsert_jdbc(df, url, table, rule[0], rule[1], seq, **options)


def conflict_policy(columns: Sequence[str]) -> tuple[list[str], bool] | None:
    """Key and whether to update, by the columns a table has: entities update, pairs stay, others have no rule."""
    if "entity_id" in columns and "record_id" not in columns:
        return ["entity_id"], True
    if {"record_id_l", "record_id_r"} <= set(columns):
        return ["record_id_l", "record_id_r"], False
    return None


def processed_rows(records: DataFrame, run_id: str) -> DataFrame:
    """Standardized records as stored; dob_std is ISO text and is read as that."""
    names = ("first_name", "last_name", "email", "phone", "address", "city", "state", "country")
    return records.select("record_id", "customer_id", *[F.col(f"{n}_std").alias(n) for n in names], F.try_to_date("dob_std", "yyyy-MM-dd").alias("dob"), F.lit(run_id).alias("run_id"))


def pair_rows(pairs: DataFrame, run_id: str, scope: str, seq: str | None = None) -> DataFrame:
    """Pairs with ids in order, the last of each."""
    out = canonical(pairs)
    return one_per_key(out, ["record_id_l", "record_id_r"], seq).withColumns({"run_id": F.lit(run_id), "scope": F.lit(scope)})


def membership_rows(entities: DataFrame, records: DataFrame) -> DataFrame:
    return entities.join(records.select("record_id", "customer_id", "source"), "record_id", "left")


def conflict_rows(master: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """entity_id, field, status: open conflicts of these entities made anew; settled ones and other entities stay."""
    fresh = master.select("entity_id", F.explode("conflicted_fields").alias("field"), F.lit("OPEN").alias("status"))
    if stored is None:
        return fresh
    gone = stored.join(master.select("entity_id"), "entity_id", "left_semi").where("status = 'OPEN'").select("entity_id", "field", "status")
    return stored.join(gone, ["entity_id", "field", "status"], "left_anti").unionByName(fresh)


def master_rows(master: DataFrame, run_id: str, scope: str, version: str) -> DataFrame:
    """Golden records with plain names: master_<field>_std is stored as <field>."""
    return plain(master).withColumns({"run_id": F.lit(run_id), "scope": F.lit(scope), "model_version": F.lit(version)})


def snapshot_rows(master: DataFrame, run_id: str, stored: DataFrame | None = None) -> DataFrame:
    """A snapshot of a run with an id per row; a run that has one already adds nothing."""
    if stored is not None and stored.where(F.col("run_id") == run_id).limit(1).count():
        return stored
    fresh = master.withColumns({"snapshot_id": F.expr("uuid()"), "run_id": F.lit(run_id)})
    return fresh if stored is None else stored.unionByName(fresh, allowMissingColumns=True)


def gold_rows(gold: DataFrame, seq: str) -> DataFrame:
    known = canonical(gold).withColumn("label", label_of(F.col("label"))).where("label is not null")
    return keep_last(known, ["record_id_l", "record_id_r"], seq)


def update_master_row(master: DataFrame, entity_id: str, values: dict[str, str | None]) -> DataFrame:
    """Manual values of an entity; only the nine fields may be set."""
    allowed = {"first_name", "last_name", "email", "phone", "dob", "address", "city", "state", "country"}
    if wrong := sorted(set(values) - allowed):
        raise ValueError("not editable: " + ", ".join(wrong))
    hit = F.col("entity_id") == entity_id
    return master.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def queue_rows(queue: DataFrame, evidence: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """Review rows with ids in order and their evidence as JSON; stored human answers stay."""
    out = canonical(queue)
    rest = [c for c in out.columns if c not in evidence]
    out = out.select(*rest, F.to_json(F.struct(*evidence)).alias("evidence"))
    if stored is None:
        return out
    from .operators.labels import carry_over

    return carry_over(out, stored, tuple(c for c in ("label", "reviewer", "review_status") if c in out.columns))


def update_decisions(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of reviewers: label, reviewer, and the status reviewed."""
    a = keyed(answers, "__pair").select("__pair", F.col("label").alias("__label"), F.col("reviewer").alias("__reviewer"))
    wide = keyed(stored, "__pair").join(a, "__pair", "left")
    hit = F.col("__label").isNotNull()
    return wide.withColumns({"label": F.coalesce("__label", "label"), "reviewer": F.coalesce("__reviewer", "reviewer"), "review_status": F.when(hit, "reviewed").otherwise(F.col("review_status"))}).select(stored.columns)


def linkage_evidence(scored: DataFrame, records: DataFrame, entities: DataFrame, low: float, high: float = 1.1) -> DataFrame:
    """Pairs of a score band with cmp_* levels, device sets, customers and entities of both sides."""
    from .operators.evaluate import device_sets

    out = keyed(scored.where((F.col("match_probability") >= low) & (F.col("match_probability") < high)))
    out = out.withColumnsRenamed({c: "cmp_" + c.removeprefix("gamma_") for c in scored.columns if c.startswith("gamma_")})
    side = records.select("record_id", "customer_id").join(device_sets(records), "record_id", "left").join(entities, "record_id", "left")
    for s in "lr":
        out = out.join(side.select(*[F.col(c).alias(f"{c}_{s}") for c in ("record_id", "customer_id", "devices", "entity_id")]), f"record_id_{s}", "left")
    known = F.col("devices_l").isNotNull() & F.col("devices_r").isNotNull()
    return out.withColumns({"device_match": F.when(known, F.col("devices_l") == F.col("devices_r")), "same_entity": F.col("entity_id_l") == F.col("entity_id_r")})


def sync_membership(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The stored membership as it must be: current rows, without records that are gone."""
    return upsert(stored.join(current.select("record_id"), "record_id", "left_semi"), current, ["record_id"])


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def persist_run(spark: SparkSession, root: str, run_id: str, records: DataFrame, pairs: DataFrame, entities: DataFrame, master: DataFrame, gold: DataFrame | None = None, scope: str = "full", version: str = "", snapshot: bool = True) -> dict[str, int]:
    """All tables of a run, committed together: rows by table. A run that is repeated replaces its own rows and adds nothing."""
    state = Staging(spark, root, run_id)
    old = {n: state.read(n) for n in ("entity_conflict", "master_customer_snapshot")}
    tables = {
        "processed_customers": processed_rows(records, run_id),
        "dedup_outputs": pair_rows(pairs, run_id, scope),
        "entity_map": entities.withColumn("run_id", F.lit(run_id)),
        "entity_membership": membership_rows(entities, records),
        "entity_conflict": conflict_rows(master, old["entity_conflict"]),
        "master_customer_current": master_rows(master, run_id, scope, version),
    }
    if gold is not None:
        tables["gold_labels"] = gold
    if snapshot:
        tables["master_customer_snapshot"] = snapshot_rows(master, run_id, old["master_customer_snapshot"])
    for name, df in tables.items():
        committed = state.manifest()["tables"].get(name, [])
        if f"{state.root}/{name}/run_id={run_id}" in committed:
            # the folder is being read: the same rows again take the place of those there in a folder of their own
            again = Staging(spark, root, f"{run_id}-{uuid.uuid4().hex[:8]}")
            again.write(df, name)
            state.staged |= again.staged
        else:
            state.write(df, name)
    counts = {name: state.read(name).count() for name in tables}
    state.commit()
    return counts
