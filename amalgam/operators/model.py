"""Fellegi-Sunter parameters and scores.

All estimation works on counts per vector of gammas, a table of a few hundred rows whatever the data,
so the driver's arithmetic does not grow with the input.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BLOCKING_RULES, CORE_FIELDS, DETERMINISTIC_RECALL, DETERMINISTIC_RULES, RETIRED_RULES, training_rules
from .blocking import PAIR, attach, finest, first_rule, or_join, rule_keys, rule_pairs
from .comparison import Comparison, gammas, needed_columns, static_comparisons

MAX_FULL_U_PAIRS = 5_000_000
TINY = 1e-6
#: Columns that are made from names.
NAMES = frozenset(["first_name_std", "last_name_std", "first_name_std_pre3", "last_name_std_pre3", "phonetic_first_name", "phonetic_last_name"])


class UntrainedError(ValueError):
    """A level has no m or u."""


@dataclass
class Model:
    """lambda, and m and u by comparison and gamma (null level left out)."""

    prior: float
    m: dict[str, dict[int, float]]
    u: dict[str, dict[int, float]]
    rules: Sequence = BLOCKING_RULES
    meta: dict = field(default_factory=dict)

    def weight(self, name: str, gamma: int) -> float:
        return math.log2(self.m[name][gamma] / self.u[name][gamma])

    def check(self) -> Model:
        """Every level but the last must have m and u."""
        bad = [f"{n}={g}" for n, levels in self.m.items() for g in levels if g > 0 and (not levels[g] or not self.u.get(n, {}).get(g))]
        if bad:
            raise UntrainedError("levels without m or u: " + ", ".join(bad))
        return self

    def to_json(self) -> str:
        keyed = lambda t: {n: {str(g): v for g, v in levels.items()} for n, levels in t.items()}
        return json.dumps({"prior": self.prior, "m": keyed(self.m), "u": keyed(self.u), "rules": [{"name": n, "columns": list(c)} for n, c in self.rules], "meta": self.meta}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        keyed = lambda t: {n: {int(g): v for g, v in levels.items()} for n, levels in t.items()}
        rules = tuple((r["name"], tuple(r["columns"])) for r in d["rules"] if r["name"] not in RETIRED_RULES)
        return Model(d["prior"], keyed(d["m"]), keyed(d["u"]), rules, d.get("meta", {}))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def estimate_prior(df: DataFrame, rules=DETERMINISTIC_RULES, recall: float = DETERMINISTIC_RECALL) -> DataFrame:
    """One row: records, pairs (distinct pairs of the deterministic rules), prior."""
    pairs = or_join(df, [("_".join(c), c) for c in rules]).agg(F.count(F.lit(1)).alias("pairs"))
    n = df.agg(F.count(F.lit(1)).alias("records"))
    prior = F.col("pairs") / (F.lit(recall) * F.col("records") * (F.col("records") - 1) / 2)
    return n.crossJoin(pairs).select("records", "pairs", prior.alias("prior"))  # one row by one row


def gamma_counts(pairs: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """Rows per vector of gammas."""
    names = [f"gamma_{c.name}" for c in comparisons]
    return gammas(pairs, comparisons).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def level_shares(counts: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """comparison, gamma, n, share among the pairs where the comparison is not null."""
    stack = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c.name).alias("comparison"), F.col(f"gamma_{c.name}").alias("gamma")) for c in comparisons])).alias("x")).select("n", "x.*")
    return shares_of(stack.groupBy("comparison", "gamma").agg(F.sum("n").alias("n")))


def shares_of(counts: DataFrame) -> DataFrame:
    """comparison, gamma, n -> with the share among the pairs where the comparison is not null."""
    per = counts.where("gamma >= 0")
    total = per.groupBy("comparison").agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total), "comparison").select("comparison", "gamma", "n", (F.col("n") / F.col("total")).alias("share"))


def u_pairs(df: DataFrame, max_pairs: int = MAX_FULL_U_PAIRS, full: bool = False) -> DataFrame:
    """Pairs for u: all of them up to ``max_pairs``; beyond, those of the records with the least hashes.

    The records that meet are at most sqrt(2 * max_pairs) in number, a bound that does not depend on the data.
    """
    n = df.count()
    most = int((1 + math.sqrt(1 + 8 * max_pairs)) // 2)
    if full and n > most:
        raise ValueError(f"{n} records make more than {max_pairs} pairs")
    some = df if n <= most else df.orderBy(F.md5("record_id"), "record_id").limit(most)
    left, right = some.select(F.col("record_id").alias("record_id_l")), some.select(F.col("record_id").alias("record_id_r"))
    return left.join(F.broadcast(right), F.col("record_id_l") < F.col("record_id_r"))


def u_counts(df: DataFrame, comparisons: Sequence[Comparison], max_pairs: int = MAX_FULL_U_PAIRS) -> DataFrame:
    return gamma_counts(attach(u_pairs(df, max_pairs), df, needed_columns(comparisons)), comparisons)


def _levels(rows, comparisons: Sequence[Comparison]) -> dict[str, dict[int, float]]:
    found = {c.name: {x.gamma: TINY for x in c.levels} for c in comparisons}
    for r in rows:
        found[r["comparison"]][r["gamma"]] = max(r["share"], TINY)
    return found


def start_m(comparisons: Sequence[Comparison]) -> dict[str, dict[int, float]]:
    """The stated m, scaled to sum 1 with fixed levels held."""
    out = {}
    for c in comparisons:
        fixed = sum(x.m for x in c.levels if x.fixed)
        free = sum(x.m for x in c.levels if not x.fixed)
        out[c.name] = {x.gamma: x.m if x.fixed else x.m * (1 - fixed) / free for x in c.levels}
    return out


def em_step(vectors: Sequence[tuple[dict[str, int], int]], prior: float, m: Mapping, u: Mapping, comparisons: Sequence[Comparison]) -> tuple[float, dict[str, dict[int, float]], float]:
    """One expectation and maximization over vector counts: the new prior and m, and the largest change."""
    total = matched = 0.0
    sums: dict[str, dict[int, float]] = {c.name: {} for c in comparisons}
    for vector, n in vectors:
        log_odds = math.log2(prior / (1 - prior)) + sum(math.log2(m[k][g] / u[k][g]) for k, g in vector.items() if g >= 0)
        p = 1 / (1 + 2**-max(-500.0, min(500.0, log_odds)))
        total, matched = total + n, matched + n * p
        for k, g in vector.items():
            if g >= 0:
                sums[k][g] = sums[k].get(g, 0.0) + n * p
    new, change = {}, 0.0
    for c in comparisons:
        fixed = {x.gamma for x in c.levels if x.fixed}
        held = sum(m[c.name][g] for g in fixed)
        free = {x.gamma: sums[c.name].get(x.gamma, 0.0) for x in c.levels if x.gamma not in fixed}
        mass = sum(free.values())
        new[c.name] = {x.gamma: m[c.name][x.gamma] if x.gamma in fixed or mass <= 0 else max(TINY, free[x.gamma] / mass * (1 - held)) for x in c.levels}
        change = max([change, *(abs(new[c.name][g] - m[c.name][g]) for g in new[c.name])])
    return min(1 - 1e-9, max(1e-9, matched / max(total, 1e-9))), new, change


def em(vectors: Sequence[tuple[dict[str, int], int]], prior: float, m: Mapping, u: Mapping, comparisons: Sequence[Comparison], stop: float = 1e-4, rounds: int = 25) -> tuple[dict[str, dict[int, float]], int]:
    """m after EM, and the rounds it took. The block's own prior is estimated and not kept."""
    m = {k: dict(v) for k, v in m.items()}
    for t in range(1, rounds + 1):
        prior, m, change = em_step(vectors, prior, m, u, comparisons)
        if change < stop:
            return m, t
    return m, rounds


def train(df: DataFrame, comparisons: Sequence[Comparison] | None = None, rules=BLOCKING_RULES, max_pairs: int | None = None, fixed_m: bool = False) -> Model:
    """Prior from deterministic rules, u from all pairs of records, m from one EM per training rule, averaged.

    A training rule does not teach a comparison that uses one of its columns. With ``max_pairs`` u comes from so many pairs.
    """
    from . import codes

    static = comparisons is None
    comparisons = comparisons or static_comparisons()
    found = estimate_prior(df).first()
    prior = min(0.5, max(1e-9, found.prior or 1e-9))
    if max_pairs is None and static:
        shares = shares_of(codes.level_counts(df))
    else:
        shares = level_shares(u_counts(df, comparisons, found.records**2 if max_pairs is None else max_pairs), comparisons)
    u = _levels(shares.collect(), comparisons)
    m, taught = start_m(comparisons), []
    base = {"first_name_std_pre3": "first_name_std", "last_name_std_pre3": "last_name_std", "phone_pre7": "phone_std", "phone_last4": "phone_std", "dob_year_std": "dob_std", "email_domain_pre4": "email_std"}
    if not fixed_m:
        teaching = training_rules(rules)
        counted = codes.gamma_counts(df, teaching, once=False).collect() if static and teaching else []
        for k, (_, columns) in enumerate(teaching):
            counts = [r for r in counted if r.rule_no == k] if static else gamma_counts(rule_pairs(df, columns, needed_columns(comparisons)), comparisons).collect()
            vectors = [({c.name: r[f"gamma_{c.name}"] for c in comparisons}, r.n) for r in counts]
            if not vectors:
                continue
            own, rounds = em(vectors, 0.1, m, u, comparisons)
            bound = {base.get(c, c) for c in columns}
            taught.append(({c.name: own[c.name] for c in comparisons if not bound & set(c.columns)}, rounds))
        for c in comparisons:
            seen = [t[c.name] for t, _ in taught if c.name in t]
            if seen:
                m[c.name] = {g: sum(s[g] for s in seen) / len(seen) for g in m[c.name]}
    return Model(prior, m, u, rules, {"records": found.records, "em_rounds": [r for _, r in taught]}).check()


def probability(weight: Column) -> Column:
    """2^w / (1 + 2^w) without overflow."""
    return F.when(weight < 0, F.pow(F.lit(2.0), weight) / (1 + F.pow(F.lit(2.0), weight))).otherwise(1 / (1 + F.pow(F.lit(2.0), -weight)))


def weight_column(model: Model) -> Column:
    """The match weight of a row with gamma_* columns."""
    total = F.lit(math.log2(model.prior / (1 - model.prior)))
    for name, levels in model.m.items():
        gamma, part = F.col(f"gamma_{name}"), None
        for g in levels:
            w = F.lit(model.weight(name, g))
            part = F.when(gamma == g, w) if part is None else part.when(gamma == g, w)
        total = total + part.otherwise(0.0)
    return total


def term_frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, tf: the share of each value among those not null."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(per.agg(F.sum("n").alias("total"))).select("value", (F.col("n") / F.col("total")).alias("tf"))  # by one row


def adjust_for_frequency(scored: DataFrame, tf: DataFrame, column: str, u: float) -> DataFrame:
    """Adds log2(u / tf) of the shared value to match_weight where both sides agree on ``column``."""
    shared = F.when(F.col(f"{column}_l") == F.col(f"{column}_r"), F.col(f"{column}_l"))
    out = scored.withColumn("__v", shared).join(tf, F.col("__v") == F.col("value"), "left")
    out = out.withColumn("match_weight", F.col("match_weight") + F.coalesce(F.log2(F.lit(u) / F.col("tf")), F.lit(0.0)))
    return out.withColumn("match_probability", probability(F.col("match_weight"))).drop("__v", "value", "tf")


def score_wide(wide: DataFrame, model: Model, comparisons: Sequence[Comparison] | None = None, keep: Sequence[str] = (), at_least: float | None = None) -> DataFrame:
    """Pairs with both sides' columns -> gammas, match_weight and match_probability, and the columns ``keep`` of both sides.

    With ``at_least`` only the pairs of such a probability: a pair leaves at the first comparison after which it can't reach it.
    """
    comparisons = comparisons or static_comparisons()
    if at_least is not None:
        able = lambda known: may_reach(model, at_least, comparisons, known)
        return score_wide(gammas(wide.where(able(0)), comparisons, able), model, comparisons, keep).where(F.col("match_probability") >= at_least)
    scored = (wide if {f"gamma_{c.name}" for c in comparisons} <= set(wide.columns) else gammas(wide, comparisons)).withColumn("match_weight", weight_column(model))
    drop = [f"{c}_{s}" for c in needed_columns(comparisons) if c not in keep for s in "lr"]
    return scored.withColumn("match_probability", probability(F.col("match_weight"))).drop(*drop)


def score_pairs(pairs: DataFrame, records: DataFrame, model: Model, comparisons: Sequence[Comparison] | None = None, keep: Sequence[str] = (), at_least: float | None = None) -> DataFrame:
    """A given pair list with gammas, match_weight and match_probability, and the columns ``keep`` of both sides; with ``at_least``
    only those of such a probability."""
    comparisons = comparisons or static_comparisons()
    return score_wide(attach(pairs, records, list(dict.fromkeys([*needed_columns(comparisons), *keep]))), model, comparisons, keep, at_least)


def candidates(records: DataFrame, model: Model, comparisons: Sequence[Comparison] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of the model's rules with the columns that their comparisons read, and ``keep``."""
    need = list(dict.fromkeys([*needed_columns(comparisons or static_comparisons()), *keep]))
    return or_join(records, model.rules, need).drop("rule_no")  # not coalesced: that would put the parts of one rule, the largest too, into one task


def _floor(probability: float) -> float:
    """A weight that pairs of ``probability`` reach whatever the rounding."""
    p = min(max(probability, 1e-12), 1 - 1e-12)
    return math.log2(p / (1 - p)) - 1e-6


def _weights(model: Model, name: str) -> dict[int, float]:
    return {g: model.weight(name, g) for g in model.m.get(name, {})}


def reaching(model: Model, at_least: float, comparisons: Sequence[Comparison] | None = None) -> list[tuple[str, ...]]:
    """Sets of columns: a pair of the model's rules whose probability is ``at_least`` agrees on all columns of one of them.

    A rule on names alone, whose blocks grow with the data, is split by the columns, names apart, of the levels that together
    weigh enough; the other rules stay as they are. No set is coarser than a rule.
    """
    sums = {frozenset(): math.log2(model.prior / (1 - model.prior))}  # set of columns -> the most that its pairs can weigh
    for c in comparisons or static_comparisons():
        weights = _weights(model, c.name)
        parts = [(frozenset(), 0.0), *((frozenset(a) - NAMES, weights.get(x.gamma, 0.0)) for x in c.levels for a in x.agree)]
        more: dict[frozenset[str], float] = {}
        for s, weight in sums.items():
            for a, w in parts:
                more[s | a] = max(more.get(s | a, -math.inf), weight + w)
        sums = more
    enough = finest(s for s, weight in sums.items() if weight >= _floor(at_least))
    return finest({*columns, *s} for _, columns in model.rules for s in (enough if NAMES.issuperset(columns) else [()] if enough else []))


def may_reach(model: Model, at_least: float, comparisons: Sequence[Comparison] | None = None, known: int = 0) -> Column:
    """Whether a pair with both sides' columns may have a probability of ``at_least``, when the similarities of the first
    ``known`` comparisons are there."""
    most = F.lit(math.log2(model.prior / (1 - model.prior)))
    for k, c in enumerate(comparisons or static_comparisons()):
        most = most + c.most(_weights(model, c.name), k < known)
    return most >= _floor(at_least)


def reachable(records: DataFrame, model: Model, at_least: float, comparisons: Sequence[Comparison] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Those of :func:`candidates` that agree on what a probability of ``at_least`` takes; all that have it are among them."""
    comparisons = comparisons or static_comparisons()
    need = list(dict.fromkeys([*needed_columns(comparisons), *keep]))
    keys = [c for c in rule_keys(model.rules) if c not in need]
    sets = [("_".join(s), s) for s in reaching(model, at_least, comparisons)]
    if not sets:
        return candidates(records, model, comparisons, keep).where(F.lit(False))
    pairs = or_join(records, sets, [*need, *keys]).withColumn("rule", first_rule(model.rules)).where("rule is not null")
    return pairs.drop("rule_no", *[f"{c}_{s}" for c in keys for s in "lr"])


def predict(records: DataFrame, model: Model, comparisons: Sequence[Comparison] | None = None, keep: Sequence[str] = (), at_least: float | None = None) -> DataFrame:
    """Candidates of the model's rules, scored; with ``at_least`` only those of such a probability."""
    if at_least is None:
        return score_wide(candidates(records, model, comparisons, keep), model, comparisons, keep)
    return score_wide(reachable(records, model, at_least, comparisons, keep), model, comparisons, keep, at_least)


def evidence_rows(scored: DataFrame, model: Model) -> DataFrame:
    """record_id_l, record_id_r, comparison, gamma, weight: what each comparison adds to each pair."""
    parts = [F.struct(F.lit(n).alias("comparison"), F.col(f"gamma_{n}").alias("gamma"), F.coalesce(*[F.when(F.col(f"gamma_{n}") == g, F.lit(model.weight(n, g))) for g in levels], F.lit(0.0)).alias("weight")) for n, levels in model.m.items()]
    return scored.select(*PAIR, F.explode(F.array(*parts)).alias("e")).select(*PAIR, "e.*")


def compare_versions(records: DataFrame, pairs: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """version, record ids, match_probability of the same pairs under each model."""
    from functools import reduce

    scored = [score_pairs(pairs, records, m).select(F.lit(v).alias("version"), *PAIR, "match_probability") for v, m in models.items()]
    return reduce(DataFrame.unionByName, scored)


def freshness(saved: Mapping[str, str], current: Mapping[str, str]) -> dict[str, list[str]]:
    """Which fingerprints of a saved evaluation are missing or have changed."""
    return {"missing": sorted(k for k in current if not saved.get(k)), "changed": sorted(k for k in current if saved.get(k) and saved[k] != current[k])}


def teaches_nothing(columns: Sequence[str]) -> bool:
    """A rule on a core field can't train."""
    return bool(set(columns) & set(CORE_FIELDS))
