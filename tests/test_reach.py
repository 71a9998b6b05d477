"""Pairs that may reach a probability: all that do are made, and nothing else decides what is returned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.functions import similarity
from amalgam.operators import decide, entities, model
from amalgam.plans.pair_queries import FIXED, written
from amalgam.sources import serving
from amalgam.storage import materialize

PAIR = ["record_id_l", "record_id_r"]
KEEP = ["email_std", "first_name_std", "last_name_std", "address_std", "dob_std"]


@pytest.fixture(scope="module")
def both(spark):
    records = written(spark, "/root/testdata/sf0.001")
    return records, materialize(model.predict(records, FIXED).withColumn("decision", decide.decision(F.col("match_probability"))), "reach")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_side_against_many_scores_as_pair_by_pair():
    a, b = ["anna.berg1@mail.com", "x" * 70, "", "aab"], [f"anna.berg{k}@mail{k % 5}.com" for k in range(60)] + ["", "y" * 70, "baa", "ab"]
    left, right = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    got = similarity.jaro_winkler_coded(a, b, left, right)
    assert got.tolist() == [similarity.jaro_winkler(a[i], b[j]) for i, j in zip(left, right, strict=True)]


def test_a_name_alone_does_not_reach_a_match(spark):
    sets = [set(s) for s in model.reaching(FIXED, 0.84)]
    assert {"dob_std"} in sets and not any(s <= {"first_name_std_pre3", "last_name_std_pre3"} for s in sets)


def test_all_pairs_that_reach_are_made(both):
    records, every = both
    for p in (0.35, 0.84):
        assert rows(model.predict(records, FIXED, at_least=p).select(*PAIR, "match_probability", "rule")) == rows(every.where(F.col("match_probability") >= p).select(*PAIR, "match_probability", "rule"))


def test_decisions_and_their_counts(both):
    records, every = both
    assert rows(decide.decided(records, FIXED, KEEP).select(*PAIR, "decision")) == rows(every.select(*PAIR, "decision"))
    assert rows(decide.decision_counts(records, FIXED)) == rows(every.groupBy("decision").count())


def test_guarded_clusters_and_first_pairs(both):
    records, every = both
    assert rows(entities.guarded_cluster_of(records, FIXED)) == rows(entities.guarded_cluster(records, every))
    for n in (3, 10_000):
        assert serving.top_of_model(records, FIXED, n).select(*PAIR).collect() == serving.top_pairs(every, n).select(*PAIR).collect()


def test_folds_are_known_without_pairs(spark):
    from amalgam.operators.shadow import one_fold

    chain = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 3, 2), ("d", None, 9)], "record_id string, x int, y int")
    apart = spark.createDataFrame([(f"r{k:02d}", k // 2, None) for k in range(40)], "record_id string, x int, y int")
    rules = (("x", ("x",)), ("y", ("y",)))
    assert one_fold(chain, rules) and not one_fold(apart, rules)
