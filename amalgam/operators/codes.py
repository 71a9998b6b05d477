"""What the comparisons, flags, decisions and business rules say of pairs, as numbers for :mod:`units`; the same as their columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BUSINESS_RULE_KEYS, EVIDENCE_FIELDS, REVIEW_THRESHOLD
from ..storage import materialize
from . import decide
from .blocking import PAIR, Rules
from .comparison import dynamic_comparisons, needed_columns, static_comparisons
from .labels import FLAG_COLUMNS, FLAGS
from .model import Model, probability, weight_column
from .units import Code, Met, code_counts, decoded, own_counts, pair_codes

#: Columns that are made from others before pairs meet.
MADE = {
    "__full": (("first_name_std", "last_name_std"), lambda: F.concat("first_name_std", F.lit(" "), "last_name_std")),
    "__year": (("dob_std",), lambda: F.substring("dob_std", 1, 4).try_cast("int").cast("string")),
    "__month": (("dob_std",), lambda: F.substring("dob_std", 1, 7)),
}


def _levels(shape: tuple, *levels: tuple[np.ndarray, int]) -> np.ndarray:
    """The number of the first condition that holds, else 0."""
    out = np.zeros(shape, np.int8)
    for condition, gamma in reversed(levels):
        out = np.where(condition, np.int8(gamma), out)
    return out


def _year_near(m: Met) -> np.ndarray:
    codes, texts = m.rows.column("__year")
    years = np.array([*map(float, texts.to_pylist()), np.nan])
    return np.abs(years[codes[m.left]] - years[codes[m.right]]) <= 1


def _both(m: Met, *columns: str) -> np.ndarray:
    l, r = m.missing(*columns)
    return l & r


def _either(m: Met, *columns: str) -> np.ndarray:
    l, r = m.missing(*columns)
    return l | r


def name(m: Met) -> np.ndarray:
    phonetic = m.same("phonetic_first_name", "phonetic_last_name")
    return _levels(m.shape, (_both(m, "first_name_std", "last_name_std"), -1), (m.same("first_name_std", "last_name_std"), 3), (m.near("__full", 0.85), 2), (phonetic, 1))


def contact(m: Met) -> np.ndarray:
    emails, phones = m.contacts()
    e, p = m.same("email_std"), m.same("phone_std")
    of = lambda side: (side("email_std") < 0) & (side("phone_std") < 0)
    return _levels(m.shape, (of(m.l) | of(m.r), -1), (e & p, 4), (e | p, 3), (emails, 2), (phones, 1))


def location(m: Met) -> np.ndarray:
    a, c, s = m.same("address_std"), m.same("city_std"), m.same("state_std")
    return _levels(m.shape, (_either(m, "address_std", "city_std"), -1), (a & c & s, 5), (a, 4), (c, 3), (s, 2))


def dob(m: Met) -> np.ndarray:
    return _levels(m.shape, (_either(m, "dob_std"), -1), (m.same("dob_std"), 2), (_year_near(m), 1))


def dynamic_name(m: Met) -> np.ndarray:
    return _levels(m.shape, (_both(m, "first_name_std", "last_name_std"), -1), (m.same("first_name_std", "last_name_std"), 2), (m.near("__full", 0.85), 1))


def dynamic_dob(m: Met) -> np.ndarray:
    return _levels(m.shape, (_either(m, "dob_std"), -1), (m.same("dob_std"), 3), (m.same("__month"), 2), (_year_near(m), 1))


def dynamic_location(m: Met) -> np.ndarray:
    a, c, s = m.same("address_std"), m.same("city_std"), m.same("state_std")
    return _levels(m.shape, (_either(m, "address_std", "city_std"), -1), (c & s & a, 3), (c & s & ~a, 2), (c & ~s, 1))


#: name -> its gammas of pairs, and how many there are with -1.
STATIC: dict[str, tuple[Callable[[Met], np.ndarray], int]] = {"name": (name, 5), "contact": (contact, 6), "location": (location, 7), "dob": (dob, 4)}
DYNAMIC: dict[str, tuple[Callable[[Met], np.ndarray], int]] = {"name": (dynamic_name, 4), "location": (dynamic_location, 5), "dob": (dynamic_dob, 5)}


def gamma_code(of=STATIC) -> Code:
    """The vector of gammas as one number."""

    def code(m: Met) -> np.ndarray:
        out = np.zeros((), np.int16)
        for gamma, size in of.values():
            out = out * np.int16(size) + (gamma(m) + np.int8(1))
        return out

    return code


def vectors(of=STATIC) -> list[tuple[int, ...]]:
    """The gammas of each code."""
    sizes = [n for _, n in of.values()]
    return [tuple(int(g) - 1 for g in np.unravel_index(k, sizes)) for k in range(int(np.prod(sizes)))]


def _around(records: DataFrame, rules: Rules, columns: Sequence[str]) -> tuple[DataFrame, Rules, list[str]]:
    """Records with the columns of MADE that ``columns`` allow."""
    some = {n: made for n, (base, made) in MADE.items() if set(base) <= set(columns)}
    return records.withColumns({n: made() for n, made in some.items()}), rules, [*dict.fromkeys(columns), *some]


def _static_columns() -> list[str]:
    return needed_columns(static_comparisons())


def gamma_pairs(records: DataFrame, rules: Rules, of=STATIC) -> DataFrame:
    """Pairs with their code of gammas."""
    columns = _static_columns() if of is STATIC else needed_columns(dynamic_comparisons(["first_name", "dob", "city"]))
    return pair_codes(*_around(records, rules, columns), gamma_code(of))


def with_gammas(coded: DataFrame, of=STATIC) -> DataFrame:
    every = vectors(of)
    return coded.select(*PAIR, *[decoded("code", [v[k] for v in every], "int").alias(f"gamma_{n}") for k, n in enumerate(of)])


def gamma_counts(records: DataFrame, rules: Rules, once: bool = True) -> DataFrame:
    """gamma_<name>, n of the pairs that rules make, each once; without ``once`` by rule_no, each rule for itself."""
    counts, every = code_counts(*_around(records, rules, _static_columns()), gamma_code(), once), vectors()
    gammas = [decoded("code", [v[k] for v in every], "int").alias(f"gamma_{n}") for k, n in enumerate(STATIC)]
    if not once:
        return counts.select("rule_no", *gammas, "n")
    return counts.groupBy("code").agg(F.sum("n").alias("n")).select(*gammas, "n")


def level_counts(records: DataFrame) -> DataFrame:
    """comparison, gamma, n of the static comparisons over all pairs of records, with -1; equal values meet as one row."""
    out = []
    for c in static_comparisons():
        gamma = STATIC[c.name][0]
        code = lambda m, gamma=gamma: gamma(m) + np.int16(1)
        values = records.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("times")).withColumn("record_id", F.monotonically_increasing_id().cast("string"))
        values, rules, columns = _around(materialize(values, "values"), [("all", ())], c.columns)
        made = code_counts(values, rules, columns, code, times="times").select("code", "n").unionByName(own_counts(values, code, "times"))
        out.append(made.groupBy((F.col("code") - 1).alias("gamma")).agg(F.sum("n").alias("n")).select(F.lit(c.name).alias("comparison"), "gamma", "n"))
    return reduce(DataFrame.unionByName, out)


def scores(spark, model: Model) -> list[tuple[float, float]]:
    """match_weight and match_probability of each code of gammas, in its place."""
    rows = [(k, *v) for k, v in enumerate(vectors())]
    df = spark.createDataFrame(rows, "code int, " + ", ".join(f"gamma_{n} int" for n in STATIC)).coalesce(1)
    found = df.withColumn("w", weight_column(model)).select("code", "w", probability(F.col("w")).alias("p")).collect()
    return [(r.w, r.p) for r in sorted(found, key=lambda r: r.code)]


def scored_pairs(records: DataFrame, model: Model, digits: int) -> DataFrame:
    """Every pair of the model's rules with match_weight and match_probability, rounded."""
    every = [(k, *map(float, v)) for k, v in enumerate(scores(records.sparkSession, model))]
    df = records.sparkSession.createDataFrame(every, "code int, w double, p double").coalesce(1)
    rounded = sorted(df.select("code", F.round("w", digits).alias("w"), F.round("p", digits).alias("p")).collect())
    column = lambda c: decoded("code", [r[c] for r in rounded], "double")
    return gamma_pairs(records, model.rules).select(*PAIR, column("w").alias("match_weight"), column("p").alias("match_probability"))


def evidence_rows(records: DataFrame, model: Model, digits: int) -> DataFrame:
    """record_id_l, record_id_r, comparison, gamma, weight, rounded, of every pair of the model's rules and every comparison."""
    known = [(n, g, model.weight(n, g)) for n, levels in model.m.items() for g in levels]
    df = records.sparkSession.createDataFrame(known, "comparison string, gamma int, weight double").coalesce(1)
    weight = {(r.comparison, r.gamma): r.weight for r in df.withColumn("weight", F.round("weight", digits)).collect()}
    names = list(STATIC)
    every, n = [(c, g) for v in vectors() for c, g in zip(names, v, strict=True)], len(names)
    each = gamma_pairs(records, model.rules).select(*PAIR, "code", F.explode(F.expr(f"sequence(0, {n - 1})")).alias("of"))
    at = f"code * {n} + of"
    return each.select(*PAIR, decoded("of", names, "string").alias("comparison"), decoded(at, [g for _, g in every], "int").alias("gamma"), decoded(at, [weight.get(x, 0.0) for x in every], "double").alias("weight"))


DECISIONS = ("NON_MATCH", "REVIEW", "MATCH")


def decision_of(spark, model: Model, review: float = REVIEW_THRESHOLD) -> np.ndarray:
    """The place in DECISIONS of each code of gammas."""
    df = spark.createDataFrame([(k, float(p)) for k, (_, p) in enumerate(scores(spark, model))], "code int, p double").coalesce(1)
    found = df.select("code", decide.decision(F.col("p"), review=review).alias("d")).collect()
    out = np.zeros(len(found), np.int16)
    for r in found:
        out[r.code] = DECISIONS.index(r.d)
    return out


def flag_code(m: Met) -> np.ndarray:
    """Each flag as 0 unknown, 1 no, 2 yes, in the order of FLAGS."""
    return reduce(lambda a, b: a * np.int16(3) + b, [m.known_states(columns) for columns in FLAGS.values()])


def flag_states() -> list[tuple[bool | None, ...]]:
    return [tuple((None, False, True)[int(s)] for s in np.unravel_index(k, [3] * len(FLAGS))) for k in range(3 ** len(FLAGS))]


def flag_columns(code: str) -> list:
    every = flag_states()
    return [decoded(code, [v[k] for v in every], "boolean").alias(n) for k, n in enumerate(FLAGS)]


def flag_pairs(records: DataFrame, rules: Rules) -> DataFrame:
    coded = pair_codes(records, rules, FLAG_COLUMNS, flag_code)
    return coded.select(*PAIR, *flag_columns("code"))


def decided_flags(records: DataFrame, model: Model) -> DataFrame:
    """decision, the flags and n: how many pairs have them."""
    decision, gamma, size = decision_of(records.sparkSession, model), gamma_code(), 3 ** len(FLAGS)
    code = lambda m: decision[gamma(m)] * np.int16(size) + flag_code(m)
    counts = code_counts(*_around(records, model.rules, [*_static_columns(), *FLAG_COLUMNS]), code).groupBy("code").agg(F.sum("n").alias("n"))
    named = counts.select(decoded(f"int(code div {size})", list(DECISIONS), "string").alias("decision"), F.expr(f"code % {size}").alias("code"), "n")
    return named.select("decision", *flag_columns("code"), "n")


BUSINESS_RULES = (None, "conflicting_email_fullname", "no_field_agreement", "unverified_dob", "strong_agreement_email_name_address")


def business_rule(m: Met) -> tuple[np.ndarray, np.ndarray]:
    """The place in BUSINESS_RULES, and whether the pair goes to REVIEW; as :func:`decide.apply_business_rules`."""
    keys, born = m.same(*BUSINESS_RULE_KEYS), m.same("dob_std")
    unverified = keys & ~born
    conflict = m.differ("email_std") & m.differ("first_name_std") & m.differ("last_name_std")
    none = ~reduce(np.logical_or, [m.same(c) for c in EVIDENCE_FIELDS])
    return _levels(m.shape, (conflict, 1), (none & ~unverified, 2), (unverified, 3), (keys & born, 4)), unverified


def business_rule_pairs(records: DataFrame, model: Model) -> DataFrame:
    """Every pair of the model's rules with decision and business_rule."""
    decision, gamma, review = decision_of(records.sparkSession, model), gamma_code(), np.int16(DECISIONS.index("REVIEW"))

    def code(m: Met) -> np.ndarray:
        rule, unverified = business_rule(m)
        return np.where(unverified, review, decision[gamma(m)]) * np.int16(len(BUSINESS_RULES)) + rule

    columns = [*_static_columns(), *BUSINESS_RULE_KEYS, *EVIDENCE_FIELDS]
    coded = pair_codes(*_around(records, model.rules, columns), code)
    return coded.select(*PAIR, decoded("code", [d for d in DECISIONS for _ in BUSINESS_RULES], "string").alias("decision"), decoded("code", [r for _ in DECISIONS for r in BUSINESS_RULES], "string").alias("business_rule"))
