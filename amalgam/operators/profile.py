"""Profiles, validation and health of inputs and runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from ..config import ALERTS, BLOCKING_RULES, COLUMN_MAP
from ..functions.text import NUMERIC_DATE, shape_ok


def _blank(c: Column) -> Column:
    return F.trim(c.cast("string")) == ""


def profile_columns(df: DataFrame) -> DataFrame:
    """column, rows, nulls, null_pct, distinct_values, blank_strings: one pass over all columns."""
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType))]
    one = df.agg(*[F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values"), F.count_if(F.coalesce(_blank(F.col(c)), F.lit(False))).alias("blank_strings")).alias(c) for c in scalar])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in scalar])).alias("x")).select("x.column", "x.s.*")
    return rows.withColumn("null_pct", F.when(F.col("rows") > 0, F.round(100.0 * F.col("nulls") / F.col("rows"), 3)).otherwise(0.0))


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """One row: unique_ids, duplicated_values, rows_in_groups."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return sizes.agg(F.count(F.col(column)).alias("unique_ids"), F.count_if(n > 1).alias("duplicated_values"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_groups"))


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("ids"))


def name_anomalies(df: DataFrame, column: str) -> DataFrame:
    s = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.agg(F.count_if(s != F.lower(s)).alias("mixed_case_or_upper"), F.count_if(s.rlike(r"\d")).alias("digits"), F.count_if(s.rlike(r"[^A-Za-z\s'’-]")).alias("symbols"), F.count_if(s.rlike(r"(.)\1")).alias("repeated_character"))


def phone_anomalies(df: DataFrame, column: str) -> DataFrame:
    s = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.agg(F.count_if(s.rlike("[A-Za-z]")).alias("letters"), F.count_if(s.rlike(r"[^0-9+()\-\s]")).alias("punctuation"))


def phone_lengths(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    digits = F.length(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"\D", ""))
    return df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).orderBy("digits").limit(n)


def identifier_coverage(df: DataFrame, email: str = "email", phone: str = "phone_number", dob: str = "dob") -> DataFrame:
    e, p, d = (F.col(c).isNull() for c in (email, phone, dob))
    out = df.agg(F.count(F.lit(1)).alias("records"), F.count_if(e).alias("missing_email"), F.count_if(p).alias("missing_phone"), F.count_if(d).alias("missing_dob"), F.count_if(e & p).alias("missing_both"))
    return out.withColumn("unlinkable_pct", F.when(F.col("records") > 0, F.round(100.0 * F.col("missing_both") / F.col("records"), 4)))


def missing_columns(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    return sorted(set(wanted) - set(columns))


def blocking_sources(rules=BLOCKING_RULES) -> set[str]:
    """Raw columns that the rules are built from."""
    keys = {c for _, columns in rules for c in columns}
    derived = {k[:-4] for k in keys if k.endswith("_std")} | {k.split("_std_")[0] for k in keys if "_std_" in k}
    return {COLUMN_MAP[c] for c in COLUMN_MAP if c in derived}


def shape_report(df: DataFrame) -> DataFrame:
    """field, non_blank, blank, unshaped of e-mail, phone and date of birth."""
    out = []
    for field, source in (("email", "email"), ("phone", "phone" if "phone" in df.columns else "phone_number"), ("dob", "dob")):
        if source not in df.columns:
            continue
        c = F.col(source)
        blank = c.isNull() | _blank(c)
        bad = ~blank & ~F.coalesce(shape_ok(c, field), F.lit(False))
        agg = [F.lit(field).alias("field"), F.count_if(~blank).alias("non_blank"), F.count_if(blank).alias("blank"), F.count_if(bad).alias("unshaped")]
        out.append(df.agg(*agg))
    return reduce(DataFrame.unionByName, out)


def shape_samples(df: DataFrame, source: str, field: str, n: int = 5) -> DataFrame:
    c = F.col(source)
    return df.where(c.isNotNull() & ~_blank(c) & ~F.coalesce(shape_ok(c, field), F.lit(False))).select(c.cast("string").alias("value")).orderBy("value").limit(n)


def shape_findings(rows: Sequence[dict], duplicate_pk: int = 0) -> tuple[list[str], list[str]]:
    """What blocks an upload and what only warns."""
    blocking = [f"{r['field']}: no value has its shape" for r in rows if r["unshaped"] and r["unshaped"] == r["non_blank"]]
    warnings = [f"{r['field']}: some values do not have its shape" for r in rows if r["unshaped"] and r["unshaped"] < r["non_blank"]]
    return blocking + ["customer_pk: duplicated values"] * bool(duplicate_pk), warnings


def validate(df: DataFrame, rules=BLOCKING_RULES) -> dict:
    """status, blocking, warnings, null counts and exact duplicates of an upload, from one aggregation and one distinct."""
    have, blocking, warnings = set(df.columns), [], []
    need = [COLUMN_MAP[c] for c in ("first_name", "last_name")]
    contact = [COLUMN_MAP[c] for c in ("email", "phone")]
    if missing := [c for c in need if c not in have]:
        warnings.append("identity columns absent: " + ", ".join(missing))
    if not have & set(contact):
        warnings.append("neither e-mail nor phone")
    if missing := sorted(blocking_sources(rules) - have):
        blocking.append("columns of blocking rules absent: " + ", ".join(missing))
    watched = [c for c in need + contact if c in have]
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType))]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull() | _blank(F.col(c))).alias(c) for c in watched]).first()
    rows = row["__rows"]
    if not rows:
        blocking.append("no rows")
    blocking += [f"{c} is empty in every row" for c in watched if rows and row[c] == rows]
    duplicates = rows - df.select(*[F.col(f"`{c}`") for c in scalar]).distinct().count() if rows and scalar else 0
    return {"status": "rejected" if blocking else "accepted", "rows": rows, "blocking": blocking, "warnings": warnings, "nulls": {c: row[c] for c in watched}, "exact_duplicate_rows": duplicates}


def date_evidence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from .standardize import date_order_evidence

    return reduce(DataFrame.unionByName, [date_order_evidence(df, c).withColumn("column", F.lit(c)) for c in columns])


def cast_baseline(df: DataFrame) -> DataFrame:
    """One row: shares of e-mails, phones and dates that parse."""
    rate = lambda c, good: F.round(F.avg(F.when(F.col(c).isNotNull(), F.coalesce(good, F.lit(False)).cast("double"))), 6)
    return df.agg(rate("email", shape_ok(F.col("email"), "email")).alias("email"), rate("phone_number", shape_ok(F.col("phone_number"), "phone")).alias("phone"), rate("dob", F.col("dob").rlike(NUMERIC_DATE)).alias("dob"))


def status_counts(df: DataFrame, column: str = "decision") -> DataFrame:
    return df.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def match_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("decision") == "MATCH").cast("double")), 6).alias("match_rate"))


def alerts(health: dict, limits: dict = ALERTS) -> list[dict]:
    """What a health snapshot gives reason to report."""
    out = []

    def add(level: str, source: str, message: str) -> None:
        out.append({"level": level, "source": source, "message": message})

    get = health.get
    if get("job_status") not in (None, "succeeded", "noop"):
        add("critical", "pipeline", f"last job: {health['job_status']}")
    for key, limit, source, over in (
        ("review_pending", "review_pending_max", "review_queue", True),
        ("largest_entity", "largest_entity_max", "entity", True),
        ("precision", "precision_min", "evaluation", False),
        ("recall", "recall_min", "evaluation", False),
        ("auto_match_rate", "auto_match_rate_max", "model_output", True),
        ("blocking_recall_ceiling", "blocking_recall_ceiling_min", "blocking", False),
        ("watermark_age_hours", "watermark_age_max_hours", "db_ingestion", True),
    ):
        value = get(key)
        if value is not None and (value > limits[limit] if over else value < limits[limit]):
            add("warning", source, f"{key} is {value}, the limit {limits[limit]}")
    if get("stale_entities", 0) > 0:
        add("warning", "db_ingestion", f"{health['stale_entities']} stale entities")
    return out


def overall(found: Sequence[dict]) -> str:
    return "critical" if any(a["level"] == "critical" for a in found) else "degraded" if found else "healthy"


def prometheus_text(values: dict[str, float], prefix: str = "linkage_") -> str:
    return "".join(f"# TYPE {prefix}{k} gauge\n{prefix}{k} {v}\n" for k, v in sorted(values.items()) if v is not None)
