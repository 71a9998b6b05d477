"""Paths through the top nodes and below, words counted in parts, and very unlikely branches."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from amalgam.llm import pseudo_lm as L


def some_network(rng):
    counts = np.concatenate([[90_000, 60_000, 40_000], np.sort(1 + rng.integers(1, 4000, 197) ** 2 // 4000)[::-1]])
    net = L.Network(L.Tree.over(counts))
    net.weights += rng.standard_normal(net.weights.shape).astype("f4") * 0.2
    return net, rng.integers(0, 9, (700, 4)).astype(np.int32), rng.integers(0, 200, 700) ** 2 // 200


def steps(net, window, leaf):
    x = window + np.arange(4) * (L.PAD + 1)
    h = np.append(np.tanh((net.weights[x].astype(float).sum(axis=0) + net.weights[L.CONTEXT])[: L.HIDDEN]), 1.0)
    _, node, second = net.tree.paths(np.array([leaf]))
    return [*x, L.CONTEXT], h, node + L.CONTEXT + 1, np.where(second, 1, -1)


def test_an_unlikely_branch_has_a_finite_score():
    net = L.Network(L.Tree.over(np.array([5, 3, 2, 1, 1])))
    for z in (20, -20, 35, -35):
        net.weights[L.CONTEXT + 1 :] = 0
        net.weights[L.CONTEXT + 1 :, L.HIDDEN] = z
        got = net.log_prob(np.full((5, 4), L.PAD, np.int32), np.arange(5))
        for leaf in range(5):
            sign = np.where(net.tree.paths(np.array([leaf]))[2], 1, -1)
            assert np.isclose(got[leaf], -np.log1p(np.exp(-sign * np.clip(z, -30, 30))).sum(), rtol=1e-5, atol=1e-6)


def test_deep_paths_are_those_of_a_sum_over_steps():
    net, windows, leaves = some_network(np.random.default_rng(4))
    assert len(net.tree.prior) > L.TOP and net.tree.low.max() > 2 and 0 < (net.tree.low == 0).sum() < 200
    want, score = np.zeros(net.weights.shape), np.zeros(len(leaves))
    times = np.zeros(len(net.weights))
    for at, (window, leaf) in enumerate(zip(windows, leaves, strict=True)):
        inputs, h, rows, sign = steps(net, window, leaf)
        z = net.weights[rows].astype(float) @ h
        score[at] = -np.log1p(np.exp(-sign * z)).sum()
        g = -sign / (1 + np.exp(sign * z)) / len(leaves)
        np.add.at(want, rows, g[:, None] * h)
        np.add.at(want, inputs, (g @ net.weights[rows]) * (1 - h * h))
        np.add.at(times, [*inputs, *rows], 1)
    assert np.abs(net.log_prob(windows, leaves) - score).max() < 1e-4
    rows, slope, touched = net.slopes(windows, leaves)
    got, n = np.zeros(net.weights.shape), np.zeros(len(net.weights))
    got[rows], n[rows] = slope, touched
    assert len(set(rows.tolist())) == len(rows) and np.array_equal(n, times)
    assert np.abs(got - want).max() < 1e-5


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 3)
    texts = ["a b c a", None, "", "d e f g h i a b", "A  b\tj k", "é é l"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    got = {r.word: r.n for r in L.word_counts(docs.select(F.col("text"))).collect()}
    assert got == Counter(w for t in texts for w in (t or "").lower().split())
