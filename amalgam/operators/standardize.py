"""Raw customer rows to standardized records with blocking keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEVICE_ALIASES, PHONE_ALIASES, Settings
from ..functions import text as T


class ContractError(ValueError):
    """Input lacks columns that the blocking rules are built from, or its dates can't be read safely."""


def date_order_evidence(df: DataFrame, column: str) -> DataFrame:
    """One row: year_first_rows, day_gt_12, month_gt_12, ambiguous_rows, detected_order."""
    first = F.regexp_extract(column, T.NUMERIC_DATE, 1).try_cast("int")
    second = F.regexp_extract(column, T.NUMERIC_DATE, 3).try_cast("int")
    counts = df.agg(
        F.count_if(first >= 1000).alias("year_first_rows"),
        F.count_if((first < 1000) & (first > 12)).alias("day_gt_12"),
        F.count_if((first < 1000) & (second > 12)).alias("month_gt_12"),
        F.count_if((first <= 12) & (second <= 12)).alias("ambiguous_rows"),
    )
    order = (
        F.when((F.col("day_gt_12") > 0) & (F.col("month_gt_12") == 0), "dmy")
        .when((F.col("month_gt_12") > 0) & (F.col("day_gt_12") == 0), "mdy")
        .when((F.col("year_first_rows") > 0) & (F.col("day_gt_12") == 0) & (F.col("month_gt_12") == 0), "iso")
    )
    return counts.withColumn("detected_order", order)


def resolve_dayfirst(df: DataFrame, column: str, explicit: str | None = None) -> bool:
    """The stated order, else the one the data show; never a guess."""
    order = explicit or date_order_evidence(df, column).first().detected_order
    if order is None:
        raise ContractError(f"the order of day and month in {column} is not clear; state it")
    return order != "mdy"


def add_record_id(df: DataFrame, order: list[str], start: int = 0, unique: str | None = None) -> DataFrame:
    """rec_000001 and so on in ``order``, after ``start``; or src_<id> of a unique column.

    Row numbers come from per-range counts, so no single task sees all rows.
    """
    if unique:
        return df.withColumn("record_id", F.concat(F.lit("src_"), F.col(unique).cast("string")))
    from ..ranking import global_row_number

    return global_row_number(df, order, "__n").withColumn("record_id", F.format_string("rec_%06d", F.col("__n") + F.lit(start))).drop("__n")


def blocking_keys(df: DataFrame) -> DataFrame:
    """The derived keys of whatever standardized columns there are."""
    new: dict[str, Column] = {}
    for name in ("first_name_std", "last_name_std"):
        if name in df.columns:
            new[f"{name}_pre3"] = F.substring(name, 1, 3)
            new[f"phonetic_{name.removesuffix('_std')}"] = T.soundex(F.col(name))
    if "email_std" in df.columns:
        new["email_domain_pre4"] = F.substring(F.substring_index("email_std", "@", -1), 1, 4)
    if "phone_std" in df.columns:
        new["phone_pre7"] = F.substring("phone_std", 1, 7)
        new["phone_last4"] = F.right("phone_std", F.lit(4))
    if "dob_std" in df.columns:
        new["dob_year_std"] = F.substring("dob_std", 1, 4)
    return df.withColumns(new)


def assert_blocking_columns(df: DataFrame, rules) -> None:
    missing = sorted({c for _, columns in rules for c in columns} - set(df.columns))
    if missing:
        raise ContractError("missing for blocking: " + ", ".join(missing))


def standardize(df: DataFrame, settings: Settings = Settings(), order: list[str] | None = None, start: int = 0, dayfirst: dict[str, bool] | None = None) -> DataFrame:
    """Adds record_id (unless there), the *_std columns that the input allows, and the blocking keys."""
    columns, names = set(df.columns), settings.column_map
    new: dict[str, Column] = {}
    for field in ("first_name", "last_name", "address", "city", "state", "country"):
        if names[field] in columns:
            clean = T.normalize_person_name if field in ("first_name", "last_name") else T.normalize_text
            new[f"{field}_std"] = clean(F.col(names[field]), settings.nfkc)
    if names["email"] in columns:
        new["email_std"] = T.normalize_email(F.col(names["email"]))
    phone = next((c for c in (names["phone"], *PHONE_ALIASES) if c in columns), None)
    new["phone_std"] = T.normalize_phone(F.col(phone)) if phone else F.lit(None).cast("string")
    for field in ("dob", "signup_date"):
        if names[field] in columns:
            first = (dayfirst or {}).get(field)
            first = resolve_dayfirst(df, names[field], settings.date_order) if first is None else first
            new[f"{field}_std"] = T.normalize_date(F.col(names[field]), first)
    device = next((c for c in (names["device_ids"], *DEVICE_ALIASES) if c in columns), None)
    if device:
        new["device_ids_std"] = T.normalize_device_ids(F.col(f"`{device}`"))
    if "record_id" not in columns:
        df = add_record_id(df, order or df.columns[:1], start, settings.record_id_column)
    return blocking_keys(df.withColumns(new))


def add_sequence(df: DataFrame, order: list[str], out: str = "seq") -> DataFrame:
    """A sequence number for keep-last rules, explicit as tables have no order."""
    from ..ranking import global_row_number

    return global_row_number(df, order, out)
