"""Pairs with the least md5: hashed side by side as one by one, and the same with and without making all pairs."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from amalgam.functions.md5 import Joined
from amalgam.operators import blocking, labels, least, model
from amalgam.plans.pair_queries import FIXED, written
from amalgam.storage import materialize

PAIR = ["record_id_l", "record_id_r"]


def digest(a: bytes, b: bytes) -> int:
    return int.from_bytes(hashlib.md5(a + b"__" + b).digest()[:4], "big")


def test_first_words_of_messages_of_any_length():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (1, 5), (10, 13), (12, 41), (31, 24), (55, 0), (64, 64), (70, 66)):
        left, right = rng.integers(0, 256, (3, n)).astype(np.uint8), rng.integers(0, 256, (4, m)).astype(np.uint8)
        i, j = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
        want = [int.from_bytes(hashlib.md5(left[a].tobytes() + right[b].tobytes()).digest()[:4], "big") for a, b in zip(i, j, strict=True)]
        assert Joined(left, right).first_word(i, j).tolist() == want


def test_units_meet_each_pair_once(monkeypatch):
    monkeypatch.setattr(least, "BATCH", 7)
    ids = [f"r{k * 37 % 211}".encode() for k in range(60)] + ["é".encode(), b"", b"x" * 70, b"r0"]
    unit, side = np.array([k % 3 for k in range(64)]), np.array([k // 3 % 2 for k in range(64)])
    across = unit != 1
    side[~across] = 0
    bound = 1 << 31
    got = sorted((ids[a], ids[b]) for left, right in least.below(unit, side, across, pa.array(ids), bound) for a, b in zip(left, right, strict=True))
    met = lambda x, y: unit[x] == unit[y] and (side[x] != side[y] or not across[x])
    assert got == sorted((ids[x], ids[y]) for x in range(64) for y in range(64) if ids[x] < ids[y] and met(x, y) and digest(ids[x], ids[y]) <= bound)


def test_pairs_below_a_share(spark, monkeypatch):
    monkeypatch.setattr(least, "CHUNK", 8)
    rows = [(None if k == 5 else f"r{k}", k % 3, None if k % 7 == 0 else k % 4) for k in range(120)]
    df = materialize(spark.createDataFrame(rows, "record_id string, x int, y int"), "least")
    sets = [("x",), ("y",)]
    every = blocking.or_join(df, [("x", ("x",)), ("y", ("y",))]).select(*PAIR).collect()
    want = sorted((a, b) for a, b in every if digest(a.encode(), b.encode()) <= 2**30)
    assert 0 < len(want) < len(every) and sorted(map(tuple, least.pairs_below(df, sets, 0.25).collect())) == want
    assert sorted(map(tuple, least.pairs_below(df, sets, 1).collect())) == sorted(map(tuple, every))
    odd = least.least_pairs(df, sets, 30, 8, lambda p: p.where(F.col("record_id_r").endswith("1"))).collect()
    assert sorted(map(tuple, odd)) == sorted(sorted(((a, b) for a, b in every if b.endswith("1")), key=lambda p: hashlib.md5(f"{p[0]}__{p[1]}".encode()).hexdigest())[:30])


def test_review_queue_does_not_make_all_pairs(spark, monkeypatch):
    records = written(spark, "/root/testdata/sf0.001")
    every = materialize(model.predict(records, FIXED), "every")
    monkeypatch.setattr(labels, "LOOKED_AT", 20)
    monkeypatch.setattr(labels, "HIGH", 0.01)  # more than a few pairs
    columns = [*PAIR, "stratum", "agree_count", "match_probability"]
    want = labels.review_queue(every, labels.silver(records), records, 5, 3)
    got = labels.review_queue_of(records, FIXED, 5, 3).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))
