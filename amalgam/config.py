"""Settings of record linkage: rules, thresholds, floors, column names."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

# Results depend on these names, orders and numbers.
COLUMN_MAP = {
    "customer_id": "customer_id",
    "first_name": "first_name",
    "last_name": "last_name",
    "email": "email",
    "phone": "phone_number",
    "gender": "gender",
    "dob": "dob",
    "signup_date": "signup_date",
    "address": "address",
    "city": "city",
    "state": "state",
    "country": "country",
    "device_ids": "device_id(s)",
    "source": "source",
}
PHONE_ALIASES = ("phone_number", "phone")
DEVICE_ALIASES = ("device_id(s)", "device_ids", "device_id")
#: Column names of source databases, by the name they take here.
DB_COLUMN_MAP = {
    "cust_id": "source_id",
    "client_id": "client_id",
    "nama_depan": "first_name",
    "nama_belakang": "last_name",
    "e_mail": "email",
    "email_address": "email",
    "telp": "phone_number",
    "no_telp": "phone_number",
    "telepon": "phone_number",
    "alamat_lengkap": "address",
    "kota": "city",
    "provinsi": "state",
    "negara": "country",
    "tanggal_lahir": "dob",
    "tgl_lahir": "dob",
    "tanggal_daftar": "signup_date",
    "jenis_kelamin": "gender",
}
BLOCKING_RULES = (
    ("email_exact", ("email_std",)),
    ("phone_exact", ("phone_std",)),
    ("name_exact", ("first_name_std", "last_name_std")),
    ("city_dob", ("city_std", "dob_std")),
    ("dob_exact", ("dob_std",)),
    ("address_city", ("address_std", "city_std")),
    ("phone_prefix", ("phone_pre7",)),
    ("name_prefix", ("last_name_std_pre3", "first_name_std_pre3")),
    ("city_state_dob_year", ("city_std", "state_std", "dob_year_std")),
    ("city_state_dob", ("city_std", "state_std", "dob_std")),
    ("phone_last4", ("phone_last4", "dob_year_std")),
    ("name_fuzzy_last4", ("last_name_std_pre3", "phone_last4")),
)
RETIRED_RULES = ("email_local_name",)
CORE_FIELDS = ("first_name_std", "last_name_std", "email_std", "phone_std", "dob_std", "address_std", "city_std", "state_std", "country_std")
DETERMINISTIC_RULES = (("email_std",), ("phone_pre7",))
DETERMINISTIC_RECALL = 1.0
ELSE_FLOORS = {"name": 0.01, "contact": 0.005, "location": 0.02, "dob": 0.001}
MATCH_THRESHOLD, REVIEW_THRESHOLD = 0.84, 0.35
SWEEP = (0.5, 0.9, 0.95, 0.99, 0.995, 0.999, 0.9995, 0.9999)
MASTER_FIELDS = ("first_name_std", "last_name_std", "email_std", "phone_std", "dob_std", "address_std", "city_std", "state_std", "country_std")
BUSINESS_RULE_KEYS = ("email_std", "first_name_std", "last_name_std", "address_std")
EVIDENCE_FIELDS = ("email_std", "first_name_std", "last_name_std", "address_std", "phone_std", "dob_std", "city_std")
REVIEW_FIELDS = ("first_name_std", "last_name_std", "email_std", "phone_std", "dob_std", "city_std", "state_std", "address_std")
TRUTHY = ("1", "true", "t", "yes", "y", "match", "positive", "duplicate", "dup")
FALSY = ("0", "false", "f", "no", "n", "no_match", "non_match", "not_match", "different", "beda", "beda_orang", "negative", "reject", "tidak_cocok")
QUEUE_CAP, QUEUE_CAP_LOW = 200, 50
SAMPLE_ROWS = 10_000
ALERTS = {
    "review_pending_max": 100,
    "largest_entity_max": 100,
    "precision_min": 0.95,
    "recall_min": 0.95,
    "watermark_age_max_hours": 24,
    "auto_match_rate_max": 0.05,
    "blocking_recall_ceiling_min": 0.99,
}


def load_rules(text: str | None = None) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Blocking rules from a JSON list of {name, columns}; the defaults where it can't be read."""
    try:
        found: dict[tuple[str, ...], str] = {}
        for r in json.loads(text or ""):
            if r["name"] not in RETIRED_RULES:
                found.setdefault(tuple(r["columns"]), r["name"])
        return tuple((name, columns) for columns, name in found.items()) or BLOCKING_RULES
    except (ValueError, TypeError, KeyError):
        return BLOCKING_RULES


def training_rules(rules=BLOCKING_RULES) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The rules that use no core identity field; the others would fix what they are to teach."""
    return tuple(r for r in rules if not set(r[1]) & set(CORE_FIELDS))


@dataclass(frozen=True)
class Settings:
    rules: tuple = BLOCKING_RULES
    match_threshold: float = MATCH_THRESHOLD
    review_threshold: float = REVIEW_THRESHOLD
    column_map: dict = field(default_factory=lambda: dict(COLUMN_MAP))
    record_id_column: str | None = None
    date_order: str | None = None
    nfkc: bool = True


def resolve(option, env: str | None = None, file_value=None, default=None):
    """Command line over environment over file over default."""
    return next((v for v in (option, env, file_value) if v is not None), default)


def load_settings(thresholds: str | None = None, rules: str | None = None) -> Settings:
    """Settings with optional overrides from JSON text; unreadable overrides are ignored."""
    out = Settings(rules=load_rules(rules))
    try:
        over = json.loads(thresholds or "")
        return replace(out, match_threshold=float(over.get("match_threshold", out.match_threshold)), review_threshold=float(over.get("review_threshold", out.review_threshold)))
    except (ValueError, TypeError, AttributeError):
        return out


def read_text(path: str) -> str | None:
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.exists() else None
