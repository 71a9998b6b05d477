"""The network's slopes, summed as products of paths of one length, are those of a plain sum over steps."""

import numpy as np

from amalgam.llm.pseudo_lm import CONTEXT, HIDDEN, OFFSETS, PAD, Network, Tree, rows_of


def test_slopes_are_those_of_a_sum_over_steps():
    rng = np.random.default_rng(2)
    net = Network(Tree.over(np.array([50, 20, 9, 4, 2, 1, 1])))
    net.weights[:, :HIDDEN] = rng.standard_normal((len(net.weights), HIDDEN)).astype(np.float32) * 0.3
    windows, leaves = rng.integers(0, PAD + 1, (40, len(OFFSETS))).astype(np.int32), rng.integers(0, 7, 40).astype(np.int32)
    want = np.zeros(net.weights.shape)
    for x, leaf in zip(rows_of(windows), leaves, strict=True):
        h = np.append(np.tanh((net.weights[x].sum(axis=0) + net.weights[CONTEXT])[:HIDDEN]), 1.0)
        _, node, second = net.tree.paths(np.array([leaf]))
        down = np.zeros(HIDDEN + 1)
        for k, branch in zip(node + CONTEXT + 1, second, strict=True):
            g = (1 / (1 + np.exp(-h @ net.weights[k])) - branch) / len(leaves)
            want[k] += g * h
            down += g * net.weights[k]
        for k in [*x, CONTEXT]:
            want[k] += down * (1 - h * h)
    rows, slope, _ = net.slopes(windows, leaves)
    got = np.zeros(net.weights.shape)
    got[rows] = slope
    assert np.abs(got - want).max() < 1e-5
