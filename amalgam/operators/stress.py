"""Planted damage: corruptions and mutations as column expressions, chosen by a hash of the id, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(*key: Column) -> Column:
    """A number below 2 ** 32 that follows from the key's text, in Spark as in any SQL with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def _at(key: Column, low: int, high: Column) -> Column:
    """A 0-based place in low..high-1 drawn by ``key``; low where there is none."""
    return (F.lit(low) + drawn(key) % F.greatest(high - low, F.lit(1))).cast("int")


def corrupt(value: Column, kind: str, key: Column) -> Column:
    """One kind of damage; values that are too short stay."""
    n = F.length(value)
    head = lambda i: F.substring(value, F.lit(1), i)
    tail = lambda i: F.substring(value, i + 1, F.lit(1_000_000))
    if kind == "double_letter":
        i = _at(key, 1, n)
        return F.when(n > 1, F.concat(head(i), F.substring(value, i, F.lit(1)), tail(i))).otherwise(value)
    if kind == "drop_letter":
        i = _at(key, 1, n)
        return F.when(n >= 3, F.concat(head(i), tail(i + 1))).otherwise(value)
    if kind == "swap_letters":
        i = _at(key, 1, n - 1)
        return F.when(n >= 3, F.concat(head(i), F.substring(value, i + 2, F.lit(1)), F.substring(value, i + 1, F.lit(1)), tail(i + 2))).otherwise(value)
    if kind == "uppercase":
        return F.upper(value)
    if kind == "phone_drop_digit":
        i = _at(key, 0, n)
        return F.when(n >= 7, F.concat(head(i), tail(i + 1))).otherwise(value)
    year, month, day = (F.split_part(value, F.lit("-"), F.lit(k)).try_cast("int") for k in (1, 2, 3))
    if kind == "dob_year_shift":
        shifted = year + F.when(drawn(key) % 2 == 0, 1).otherwise(-1)
        return F.coalesce(F.when(day.isNotNull() & month.isNotNull(), F.concat(F.lpad(shifted.cast("string"), 4, "0"), F.substring(value, 5, 6))), value)
    if kind == "dob_swap_day_month":
        return F.when((month <= 12) & (day <= 12), F.format_string("%04d-%02d-%02d", year, day, month)).otherwise(value)
    raise ValueError(f"no damage named {kind}")


#: Per field the kinds of damage and the share of copies that get one.
KINDS = {
    "last_name_std": (("double_letter", "drop_letter", "swap_letters"), 1.0),
    "first_name_std": (("uppercase", "drop_letter"), 1.0),
    "email_std": (("drop_letter", "swap_letters"), 1.0),
    "phone_std": (("phone_drop_digit",), 1.0),
    "address_std": (("drop_letter", "swap_letters"), 0.75),
    "dob_std": (("dob_year_shift", "dob_swap_day_month"), 0.5),
}


def damaged_copies(records: DataFrame, fields: dict = KINDS, prefix: str = "dmg_") -> DataFrame:
    """A copy of every record with damage in ``fields``; copy_of, ops ("field:kind;..." of what changed, or "none") and damaged (their number)."""
    out = records.withColumn("copy_of", F.col("record_id")).withColumn("record_id", F.concat(F.lit(prefix), "record_id"))
    ops, changes = [], []
    for field, (kinds, share) in fields.items():
        pick = drawn(F.lit(field), F.col("copy_of")) % len(kinds)
        chosen = drawn(F.lit("share"), F.lit(field), F.col("copy_of")) % 1000 < round(share * 1000)
        value, name = F.col(field), F.lit(None).cast("string")
        for k, kind in enumerate(kinds):
            value = F.when(chosen & (pick == k), corrupt(F.col(field), kind, F.col("copy_of"))).otherwise(value)
            name = F.when(chosen & (pick == k), F.lit(kind)).otherwise(name)
        changed = F.coalesce((value != F.col(field)) & (value != ""), F.lit(False))
        out = out.withColumn(f"__new_{field}", F.when(changed, value).otherwise(F.col(field)))
        skipped = F.when(name == "dob_swap_day_month", F.lit(f"{field}:swap_skipped_unambiguous"))
        ops.append(F.when(changed, F.concat(F.lit(f"{field}:"), name)).otherwise(skipped))
        changes.append(changed.cast("int"))
    out = out.withColumn("ops", F.concat_ws(";", *ops)).withColumn("ops", F.when(F.col("ops") == "", "none").otherwise(F.col("ops"))).withColumn("damaged", sum(changes))
    return out.withColumns({f: F.col(f"__new_{f}") for f in fields}).drop(*[f"__new_{f}" for f in fields])


# Mutations of one value, for diagnostics of the model.
def second_and_third_swapped(v: Column) -> Column:
    return F.when(F.length(v) < 2, F.concat(v, F.lit("x"))).otherwise(F.concat(F.substring(v, 1, 1), F.substring(v, 3, 1), F.substring(v, 2, 1), F.substring(v, 4, 1_000_000)))


def next_last_digit(v: Column) -> Column:
    last = F.right(v, F.lit(1)).try_cast("int")
    return F.when(last.isNull(), F.concat(v, F.lit("1"))).otherwise(F.concat(F.substring(v, F.lit(1), F.length(v) - 1), ((last + 1) % 10).cast("string")))


def at_another_domain(v: Column, domain: str = "elsewhere.example") -> Column:
    return F.when(v.contains("@"), F.concat(F.substring_index(v, "@", 1), F.lit("@" + domain))).otherwise(v)


def next_house_number(v: Column) -> Column:
    number = F.regexp_extract(v, r"\d+", 0)
    bumped = F.concat(F.regexp_extract(v, r"^(\D*)", 1), (number.try_cast("bigint") + 1).cast("string"), F.regexp_extract(v, r"^\D*\d+(.*)$", 1))
    return F.when(number == "", F.concat(v, F.lit(" 1"))).otherwise(bumped)


def a_year_later(v: Column) -> Column:
    year = F.regexp_extract(v, r"^(\d{4})", 1)
    return F.when(year == "", v).otherwise(F.concat((year.try_cast("int") + 1).cast("string"), F.substring(v, 5, 1_000_000)))


def look_alike(v: Column, key: Column) -> Column:
    """One letter replaced by the digit that looks like it."""
    i = _at(key, 0, F.length(v))
    letter = F.substring(v, i + 1, F.lit(1))
    return F.concat(F.substring(v, F.lit(1), i), F.translate(letter, "oieastb", "0134578"), F.substring(v, i + 2, F.lit(1_000_000)))


MUTATIONS = {"first_name_std": second_and_third_swapped, "phone_std": next_last_digit, "email_std": at_another_domain, "address_std": next_house_number, "dob_std": a_year_later}


def variants(pairs: DataFrame, fields=tuple(MUTATIONS)) -> DataFrame:
    """variant and the pair's columns: as it is, sides swapped, each field null on the right, each field mutated on the right."""
    cols = [c for c in pairs.columns if c.endswith(("_l", "_r"))]
    other = lambda c: c[:-1] + ("r" if c.endswith("l") else "l")
    make = [F.struct(F.lit("base").alias("variant"), *[F.col(c) for c in cols]), F.struct(F.lit("swapped").alias("variant"), *[F.col(other(c)).alias(c) for c in cols])]
    for f in fields:
        for name, value in ((f"null:{f}", F.lit(None).cast("string")), (f"mutated:{f}", MUTATIONS[f](F.col(f"{f}_r")))):
            make.append(F.struct(F.lit(name).alias("variant"), *[value.alias(c) if c == f"{f}_r" else F.col(c) for c in cols]))
    rest = [c for c in pairs.columns if c not in cols]
    return pairs.select(*rest, F.explode(F.array(*make)).alias("v")).select(*rest, "v.*")


def synthetic_crm(spark, n: int, dup_every: int = 10, near_every: int = 25) -> DataFrame:
    """``n`` generated customers: every ``dup_every``-th is an exact copy of the row before, every ``near_every``-th a near one."""
    i = F.col("id")
    base = i - F.when((i % dup_every == dup_every - 1) | (i % near_every == near_every - 1), 1).otherwise(0)
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), (drawn(F.lit(salt), base) % len(words) + 1).cast("int"))
    first = pick(("anna", "bima", "citra", "dewi", "eka", "fajar", "gita", "hadi"), 1)
    last = pick(("santoso", "wijaya", "putri", "halim", "lestari", "nugroho"), 2)
    near = (i % near_every == near_every - 1) & (i % dup_every != dup_every - 1)
    return spark.range(n).select(
        i.alias("customer_pk"),
        F.format_string("C%08d", i).alias("customer_id"),
        F.when(near, corrupt(first, "drop_letter", i.cast("string"))).otherwise(first).alias("first_name"),
        last.alias("last_name"),
        F.concat(first, F.lit("."), last, base.cast("string"), F.lit("@example.com")).alias("email"),
        F.format_string("08%010d", drawn(F.lit(3), base)).alias("phone_number"),
        F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (drawn(F.lit(4), base) % 20_000).cast("int")), "dd/MM/yyyy").alias("dob"),
        F.format_string("Jl. Merdeka No. %d", drawn(F.lit(5), base) % 500).alias("address"),
        pick(("jakarta", "bandung", "medan", "surabaya"), 6).alias("city"),
        pick(("jawa", "sumatra"), 7).alias("state"),
        F.lit("indonesia").alias("country"),
        F.concat(F.lit("dev_"), base.cast("string")).alias("device_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + i * 60).alias("updated_at"),
    )
