"""Standardization of names, contacts, addresses and dates as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A date of three numbers with the same sign between them.
NUMERIC_DATE = r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})$"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Look-alike signs in person names, and the letters they stand for.
LEET, PLAIN = "0134578@$!", "oieastbasi"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column, compat: bool = True) -> Column:
    """Lower case, single spaces, letters, digits and ' ’ - only; null if nothing is left.

    ``compat`` first maps compatibility characters (NFKC), the one step that needs Python.
    """
    text = nfkc(c.cast("string")) if compat else c.cast("string")
    text = F.regexp_replace(F.lower(text), r"(?U)[^\w\s'’-]", " ")
    return blank_to_null(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def normalize_person_name(c: Column, compat: bool = True) -> Column:
    return normalize_text(F.translate(c.cast("string"), LEET, PLAIN), compat)


def normalize_email(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")))


def normalize_phone(c: Column) -> Column:
    """Digits without an extension (x and what follows), an international 00 and then one 0."""
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?s)[xX]\s*\d.*$", ""), r"\D", "")
    return blank_to_null(F.regexp_replace(F.regexp_replace(digits, "^00", ""), "^0", ""))


def normalize_date(c: Column, dayfirst: bool) -> Column:
    """ISO text of a date in numbers or with an English month; ambiguous day and month by ``dayfirst``; else null."""
    text = F.trim(F.regexp_replace(F.trim(c.cast("string")), r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$", ""))
    part = [F.regexp_extract(text, NUMERIC_DATE, k) for k in (1, 3, 4)]
    a, b = (p.try_cast("int") for p in part[:2])
    day, month = (a, b) if dayfirst else (b, a)
    day = F.when(a > 12, a).when(b > 12, b).otherwise(day)
    month = F.when(a > 12, b).when(b > 12, a).otherwise(month)
    iso = F.format_string("%04d-%02d-%02d", part[2].try_cast("int"), month, day)
    year_first = F.format_string("%04d-%02d-%02d", a, b, part[2].try_cast("int"))
    numeric = F.when(F.length(part[0]) == 4, year_first).otherwise(iso)
    checked = lambda text, form: F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM-dd")
    forms = ((r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", 1, 2), (r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4})$", 1, 2), (r"^([A-Za-z]{3}) (\d{1,2}) (\d{4})$", 2, 1))
    named = F.lit(None).cast("string")
    for shape, d, m in forms:
        at = F.instr(F.lit(MONTHS), F.lower(F.regexp_extract(text, shape, m)))
        spelled = F.format_string("%04d-%02d-%02d", F.regexp_extract(text, shape, 3).try_cast("int"), F.floor((at + 2) / 3).cast("int"), F.regexp_extract(text, shape, d).try_cast("int"))
        named = F.when(text.rlike(shape) & (at % 3 == 1), checked(spelled, "yyyy-MM-dd")).otherwise(named)
    return F.when(text.rlike(NUMERIC_DATE), checked(numeric, "yyyy-MM-dd")).otherwise(named)


def normalize_device_ids(c: Column) -> Column:
    """A list cut at ; , or |, in lower case without spaces; null if empty."""
    items = F.transform(F.split(c.cast("string"), r"[;,|]"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", ""))
    kept = F.filter(items, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def soundex(c: Column) -> Column:
    """Soundex in which vowels, H, W and Y go before equal codes collapse, and the first letter's own code stays out."""
    name = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    rest = F.translate(F.substring(name, 2, 1_000_000), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "111122222222334556")
    code = F.concat(F.substring(name, 1, 1), F.regexp_replace(rest, r"(\d)\1+", "$1"))
    return F.when(F.length(name) > 0, F.rpad(F.substring(code, 1, 4), 4, "0"))


def label_of(c: Column) -> Column:
    """match, no_match or, for what is in neither vocabulary, null."""
    from ..config import FALSY, TRUTHY

    key = F.translate(F.lower(F.trim(c.cast("string"))), "- ", "__")
    return F.when(key.isin(*TRUTHY), "match").when(key.isin(*FALSY), "no_match")


def pair_key(left: Column, right: Column, sep: str = "__") -> Column:
    """A name of an unordered pair."""
    return F.concat_ws(sep, F.least(left, right), F.greatest(left, right))


def key_text(c: Column) -> Column:
    """A primary key as text, without a decimal part."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("bigint").cast("string"), c.cast("string"))


def compare_text(c: Column) -> Column:
    """What counts when two versions of a value are compared."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def changed_fields(columns: list[str], old: str = "_old", new: str = "_new") -> Column:
    """Names of the columns whose old and new values differ."""
    marks = [F.when(compare_text(F.col(c + old)) != compare_text(F.col(c + new)), F.lit(c)) for c in columns]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def shape_ok(c: Column, field: str) -> Column:
    """Whether a value that is not blank looks like its field."""
    text = F.trim(c.cast("string"))
    if field == "email":
        return text.rlike(EMAIL_SHAPE)
    if field == "phone":
        return text.rlike(r"\d")
    if field == "dob":
        dated = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))).isNotNull() for shape, form in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))]
        return dated[0] | dated[1] | dated[2]
    return F.lit(True)


def corruption_score(value: Column, name: str | Column) -> Column:
    """Digits and signs where the field has no use for them."""
    name = F.lit(name) if isinstance(name, str) else name
    name = F.regexp_replace(F.regexp_replace(name, "^master_", ""), "_std$", "")
    digits = F.when(name.isin("dob", "phone", "signup_date", "email", "address"), 0).otherwise(F.regexp_count(value, F.lit(r"\d")))
    signs = F.when(name.isin("dob", "email", "phone"), 0).otherwise(F.regexp_count(value, F.lit(r"[^a-z\s'’-]")))
    return (digits + signs).cast("int")


# The second, older standard of the serving layer: title case, blanks for nulls.
def _old(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def old_standard(columns: dict[str, Column]) -> dict[str, Column]:
    """Names and city in title case, state in upper case, e-mail in lower case with its domain, phone digits with
    the last four, date of birth in ISO form; blank where nothing fits."""
    c = {k: _old(v) for k, v in columns.items()}
    digits = F.regexp_replace(c["phone"], r"\D", "")
    email = F.lower(c["email"])
    dob = [F.date_format(F.try_to_timestamp(c["dob"], F.lit(form)), "yyyy-MM-dd") for form in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy")]
    return {
        "first_name": F.initcap(c["first_name"]),
        "last_name": F.initcap(c["last_name"]),
        "email": email,
        "email_domain": F.when(F.instr(email, "@") > 0, F.substring_index(email, "@", -1)).otherwise(""),
        "phone": digits,
        "phone_last4": F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(""),
        "address": F.initcap(c["address"]),
        "city": F.initcap(c["city"]),
        "state": F.upper(c["state"]),
        "dob": F.coalesce(*dob, F.lit("")),
    }


def probability_text(p: Column) -> Column:
    return F.when(p.isNull(), "-").otherwise(F.format_string("%.1f%%", p * 100))


def rate_text(count: Column, total: Column) -> Column:
    return F.when(total == 0, "-").otherwise(F.format_string("%d / %d (%.1f%%)", count, total, 100.0 * count / total))


def agreement_label(left: Column, right: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(blank(left) & blank(right), "both blank").when(blank(left) | blank(right), "one blank").when(left == right, "same").otherwise("different")
