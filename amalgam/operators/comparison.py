"""Comparison levels compiled to one CASE per comparison; gamma -1 is the null level, 0 the last one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ELSE_FLOORS
from ..functions.similarity import jaro_winkler_col


@dataclass(frozen=True)
class Level:
    gamma: int
    condition: Column | None
    m: float
    fixed: bool = False
    #: sets of columns: a pair of this level agrees on all columns of one of them
    agree: Sequence[Sequence[str]] = ((),)
    #: whether the condition reads a similarity
    similar: bool = False


@dataclass(frozen=True)
class Comparison:
    name: str
    null: Column
    levels: Sequence[Level]
    columns: Sequence[str]
    similarities: dict = field(default_factory=dict)

    def gamma(self) -> Column:
        out = F.when(F.coalesce(self.null, F.lit(False)), -1)
        for level in self.levels:
            if level.condition is not None:
                out = out.when(F.coalesce(level.condition, F.lit(False)), level.gamma)
        return out.otherwise(0).cast("int")

    def most(self, weights: Mapping[int, float], known: bool = False) -> Column:
        """The largest of ``weights``, by gamma, that a pair can get before its similarities are known, or its own once they are."""
        out, best = F.when(F.coalesce(self.null, F.lit(False)), 0.0), None
        for level in self.levels:
            weight = weights.get(level.gamma, 0.0)
            if level.condition is None or level.similar and not known:
                best = weight if best is None else max(best, weight)
            else:
                out = out.when(F.coalesce(level.condition, F.lit(False)), weight if best is None else max(best, weight))
        return out.otherwise(weights.get(0, 0.0) if best is None else best)


def _l(c: str) -> Column:
    return F.col(f"{c}_l")


def _r(c: str) -> Column:
    return F.col(f"{c}_r")


def equal(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [_l(c) == _r(c) for c in columns])


def _missing(side, columns: Sequence[str], how) -> Column:
    return reduce(how, [side(c).isNull() for c in columns])


def _ors(a: Column, b: Column) -> Column:
    return a | b


def _ands(a: Column, b: Column) -> Column:
    return a & b


_FULL = lambda side: F.concat(side("first_name_std"), F.lit(" "), side("last_name_std"))


def _unless(settled: Column, value: Column) -> Column:
    """``value`` where no earlier level has settled the pair; Python does not score nulls."""
    return F.when(~F.coalesce(settled, F.lit(False)), value)


def _year_near() -> Column:
    return F.abs(F.substring("dob_std_l", 1, 4).try_cast("int") - F.substring("dob_std_r", 1, 4).try_cast("int")) <= 1


# The m of every level.
def name_comparison() -> Comparison:
    null = _missing(_l, ("first_name_std", "last_name_std"), _ors) & _missing(_r, ("first_name_std", "last_name_std"), _ors)
    levels = [
        Level(3, equal("first_name_std", "last_name_std"), 0.70, agree=[("first_name_std", "last_name_std")]),
        Level(2, F.col("jw_name") >= 0.85, 0.50, similar=True),
        Level(1, equal("phonetic_first_name", "phonetic_last_name"), 0.30, agree=[("phonetic_first_name", "phonetic_last_name")]),
        Level(0, None, ELSE_FLOORS["name"], True),
    ]
    return Comparison("name", null, levels, ("first_name_std", "last_name_std", "phonetic_first_name", "phonetic_last_name"), {"jw_name": (_unless(equal("first_name_std", "last_name_std"), _FULL(_l)), _FULL(_r))})


def contact_comparison() -> Comparison:
    null = _missing(_l, ("email_std", "phone_std"), _ands) | _missing(_r, ("email_std", "phone_std"), _ands)
    either = F.coalesce(equal("email_std"), F.lit(False)) | F.coalesce(equal("phone_std"), F.lit(False))
    levels = [
        Level(4, equal("email_std", "phone_std"), 0.70, agree=[("email_std", "phone_std")]),
        Level(3, either, 0.75, agree=[("email_std",), ("phone_std",)]),
        Level(2, (_l("email_std") != _r("email_std")) & (F.col("jw_email") >= 0.85), 0.45, similar=True),
        Level(1, (_l("phone_std") != _r("phone_std")) & (F.col("jw_phone") >= 0.90), 0.40, similar=True),
        Level(0, None, ELSE_FLOORS["contact"], True),
    ]
    return Comparison("contact", null, levels, ("email_std", "phone_std"), {"jw_email": (_unless(either, _l("email_std")), _r("email_std")), "jw_phone": (_unless(either | F.coalesce(F.col("jw_email") >= 0.85, F.lit(False)), _l("phone_std")), _r("phone_std"))})


def location_comparison() -> Comparison:
    null = _missing(_l, ("address_std", "city_std"), _ors) | _missing(_r, ("address_std", "city_std"), _ors)
    two = (equal("address_std") & equal("city_std")) | (equal("address_std") & equal("state_std")) | (equal("city_std") & equal("state_std"))
    levels = [
        Level(5, equal("address_std", "city_std", "state_std"), 0.40, agree=[("address_std", "city_std", "state_std")]),
        Level(4, equal("address_std"), 0.20, agree=[("address_std",)]),
        Level(3, equal("city_std"), 0.25, agree=[("city_std",)]),
        Level(2, equal("state_std"), 0.30, agree=[("state_std",)]),
        Level(1, two, 0.15, agree=[("address_std", "city_std"), ("address_std", "state_std"), ("city_std", "state_std")]),
        Level(0, None, ELSE_FLOORS["location"], True),
    ]
    return Comparison("location", null, levels, ("address_std", "city_std", "state_std"))


def dob_comparison() -> Comparison:
    levels = [Level(2, equal("dob_std"), 0.30, agree=[("dob_std",)]), Level(1, _year_near(), 0.25), Level(0, None, ELSE_FLOORS["dob"], True)]
    return Comparison("dob", _l("dob_std").isNull() | _r("dob_std").isNull(), levels, ("dob_std",))


def identity_comparison() -> Comparison:
    """Both phonetic names or nothing."""
    null = _missing(_l, ("phonetic_first_name", "phonetic_last_name"), _ors) | _missing(_r, ("phonetic_first_name", "phonetic_last_name"), _ors)
    return Comparison("identity", null, [Level(1, equal("phonetic_first_name", "phonetic_last_name"), 0.9), Level(0, None, 0.1)], ("phonetic_first_name", "phonetic_last_name"))


def static_comparisons() -> list[Comparison]:
    return [name_comparison(), contact_comparison(), location_comparison(), dob_comparison()]


def _share(levels: list[tuple[int, Column | None, float]], similar: Sequence[int] = ()) -> list[Level]:
    """Levels whose m are divided by their sum and fixed; ``similar`` are the gammas that read a similarity."""
    total = sum(m for _, _, m in levels)
    return [Level(g, c, m / total, True, similar=g in similar) for g, c, m in levels]


VALID_COLUMNS = ("first_name", "last_name", "email", "phone", "dob", "dob_year", "address", "city", "state", "country")


def infer_columns(columns: Sequence[str], preferred: Sequence[str] = (), most: int = 10) -> list[str]:
    """The comparison columns a table has, preferred ones first."""
    have = [c for c in VALID_COLUMNS if c in columns or f"{c}_std" in columns]
    return [*[c for c in preferred if c in have], *[c for c in have if c not in preferred]][:most]


def dynamic_comparisons(selected: Sequence[str]) -> list[Comparison]:
    """Comparisons of the chosen columns, with fixed m."""
    s, out = set(selected), []
    if s & {"first_name", "last_name"}:
        null = _missing(_l, ("first_name_std", "last_name_std"), _ors) & _missing(_r, ("first_name_std", "last_name_std"), _ors)
        out.append(Comparison("name", null, _share([(2, equal("first_name_std", "last_name_std"), 0.70), (1, F.col("jw_name") >= 0.85, 0.35), (0, None, 0.05)], [1]), ("first_name_std", "last_name_std"), {"jw_name": (_FULL(_l), _FULL(_r))}))
    if "email" in s:
        local = F.substring_index(_l("email_std"), "@", 1) == F.substring_index(_r("email_std"), "@", 1)
        out.append(Comparison("email", _l("email_std").isNull() & _r("email_std").isNull(), _share([(3, equal("email_std"), 0.70), (2, F.col("jw_email") >= 0.85, 0.45), (1, local, 0.30), (0, None, 0.05)], [2]), ("email_std",), {"jw_email": (_l("email_std"), _r("email_std"))}))
    if "phone" in s:
        near = F.substring(_l("phone_std"), 1, 7) == F.substring(_r("phone_std"), 1, 7)
        out.append(Comparison("phone", _l("phone_std").isNull() & _r("phone_std").isNull(), _share([(3, equal("phone_std"), 0.70), (2, F.col("jw_phone") >= 0.90, 0.45), (1, near, 0.30), (0, None, 0.05)], [2]), ("phone_std",), {"jw_phone": (_l("phone_std"), _r("phone_std"))}))
    if s & {"address", "city", "state", "country"}:
        null = _missing(_l, ("address_std", "city_std"), _ors) | _missing(_r, ("address_std", "city_std"), _ors)
        differs = lambda c: ~F.coalesce(equal(c), F.lit(False))
        out.append(Comparison("location", null, _share([(3, equal("address_std", "city_std", "state_std"), 0.60), (2, equal("city_std", "state_std") & differs("address_std"), 0.35), (1, equal("city_std") & differs("state_std"), 0.20), (0, None, 0.05)]), ("address_std", "city_std", "state_std")))
    if s & {"dob", "dob_year"}:
        month = F.substring(_l("dob_std"), 1, 7) == F.substring(_r("dob_std"), 1, 7)
        out.append(Comparison("dob", _l("dob_std").isNull() | _r("dob_std").isNull(), _share([(3, equal("dob_std"), 0.70), (2, month, 0.40), (1, _year_near(), 0.25), (0, None, 0.05)]), ("dob_std",)))
    return out


def dynamic_rules(selected: Sequence[str], rules) -> list[tuple[str, tuple[str, ...]]]:
    """The rules whose columns are all chosen, else fallbacks from what is chosen."""
    s = set(selected)
    source = {"first_name_std": "first_name", "last_name_std": "last_name", "first_name_std_pre3": "first_name", "last_name_std_pre3": "last_name", "phone_pre7": "phone", "phone_last4": "phone", "email_domain_pre4": "email", "dob_year_std": "dob"}
    needs = lambda columns: {source.get(c, c.removesuffix("_std")) for c in columns}
    found = [(n, tuple(c)) for n, c in rules if needs(c) <= s]
    if found:
        return found
    spare = [("email_std",), ("phone_std",), ("city_std",), ("dob_std",), ("last_name_std", "dob_year_std"), ("first_name_std", "city_std"), ("last_name_std",), ("city_std",), ("dob_year_std",), ("dob_std",)]
    out = list(dict.fromkeys(c for c in spare if needs(c) <= s))
    return [("_".join(c), c) for c in out] or [("last_name_std", ("last_name_std",))]


def needed_columns(comparisons: Sequence[Comparison]) -> list[str]:
    return list(dict.fromkeys(c for x in comparisons for c in x.columns))


def gammas(pairs: DataFrame, comparisons: Sequence[Comparison], able: Callable[[int], Column] | None = None) -> DataFrame:
    """``pairs`` with both sides' columns -> gamma_<name> of every comparison; pairs that are not ``able``, given the number of
    comparisons whose similarities are there, leave."""
    for k, c in enumerate(comparisons, 1):
        for name, (left, right) in c.similarities.items():
            pairs = pairs.withColumn(name, jaro_winkler_col(left, right))
        if able and c.similarities and any(x.similarities for x in comparisons[k:]):
            pairs = pairs.where(able(k))
    out = pairs.withColumns({f"gamma_{c.name}": c.gamma() for c in comparisons})
    return out.drop(*[name for c in comparisons for name in c.similarities])
