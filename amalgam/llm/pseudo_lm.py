"""LM scoring by masked pseudo-likelihood.

A network with one hidden layer sees two words on either side of a masked word and predicts it: the words are the
leaves of a Huffman tree over their counts, and at each node on a word's path a logistic unit on the hidden layer says
which branch it takes, so the words' probabilities given their neighbours add up to one. A document's score is the sum
of the conditional log-probabilities of all its words.

Counts are over all documents. Training passes over all of them too: in each round every task goes
through its part of that round's documents, predicting every word, from the common weights, and the tasks' weights are averaged row by row,
each by how many words moved that row, in a tree of 64 parts at a time.

The ``vocabulary`` most frequent words have leaves of their own; the others share one. Which of them it is, is told by
what is gathered from the corpus and grows with it: a word's share of all such words, and how often it stands between
the same two neighbours elsewhere. With n(l) of these words after l, n(r) before r and c(l, w, r) occurrences of w
between them, its probability there is (1 - MEMORY) * share + MEMORY * (c - 1) / (min(n(l), n(r)) - 1): the occurrence
that is scored is left out, and the last part adds up to MEMORY at most over all words. So texts that occur again, and
passages that many texts share, are likelier than others. Neighbours beyond the vocabulary count by ``SYMBOLS`` hashes.

The network is of one size: as context, all but ``KNOWN`` words are hashed into ``BUCKETS``.

Defined results: a null or empty text has no words, a score of 0 and a null mean; a null doc_id is
scored like any other; repeated rows are scored each; an empty table gives an empty result; other
columns are not read. A word that was not counted, which only other texts can hold, scores like one counted once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, materialize, slices

OFFSETS = (-2, -1, 1, 2)
#: With the bias a row of weights is 64 bytes.
HIDDEN = 15
KNOWN, BUCKETS = 4096, 512
PAD = KNOWN + BUCKETS
#: Rows of weights that context words have: a row per place in the window and input word. The hidden layer's bias comes after them, then the tree's nodes.
CONTEXT = len(OFFSETS) * (PAD + 1)
#: Words that go through the network at once: few enough that what is gathered for them stays in a core's cache.
BATCH = 2048
#: When they are only scored, less is gathered.
SCORED = 2 * BATCH
#: Nodes nearest to the root, by mass: most words pass several of them, so a batch meets them all at once, in products of matrices.
TOP = 31
#: A product of matrices with more multiplications goes to several threads of the library, which wait for each other; runs of more rows than ``LONG`` are summed one by one.
ONE_THREAD, LONG = 1 << 18, 8
SPREAD = np.random.default_rng(6).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)
CHUNKS = 16
SLICE = 2 << 20
#: Of a word beyond the vocabulary: the weight of its neighbours, and how many hashes such neighbours have.
MEMORY, SYMBOLS = 0.3, 1 << 16


@dataclass
class Tree:
    """The paths to the leaves of a Huffman tree: inner nodes, and whether the path takes the second branch there."""

    begin: np.ndarray
    length: np.ndarray
    node: np.ndarray
    second: np.ndarray
    #: log odds of the second branch at each inner node
    prior: np.ndarray
    #: 1 for the second branch, -1 for the first one
    sign: np.ndarray = field(init=False, repr=False)
    #: How many steps of each path lead through nodes before the last ``TOP``. Nodes are in ascending order of mass, and paths begin at their leaves, so these come first.
    low: np.ndarray = field(init=False, repr=False)
    #: Where each path leaves the ``TOP`` nodes; for each such exit the signs of its branches at these nodes, 0 off the path.
    exit: np.ndarray = field(init=False, repr=False)
    signs: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.sign = np.where(self.second, 1, -1).astype(np.float32)
        before = np.concatenate([[0], np.cumsum(self.node < self.first_top)])
        self.low = before[self.begin + self.length] - before[self.begin]
        if not len(self.node):
            return
        last = self.begin + self.low  # in the ``TOP`` nodes
        _, one, self.exit = np.unique(self.node[last] * 2 + self.second[last], return_index=True, return_inverse=True)
        self.signs = np.zeros((len(one), len(self.prior) - self.first_top), np.float32)
        for k, leaf in enumerate(one):
            at = slice(last[leaf], self.begin[leaf] + self.length[leaf])
            self.signs[k, self.node[at] - self.first_top] = self.sign[at]

    @property
    def first_top(self) -> int:
        return max(0, len(self.prior) - TOP)

    @staticmethod
    def over(counts: np.ndarray) -> Tree:
        n = len(counts)
        parent, second = np.full(max(1, 2 * n - 1), -1), np.zeros(max(1, 2 * n - 1), bool)
        mass = np.concatenate([np.asarray(counts, float), np.zeros(max(0, n - 1))])
        heap = [(float(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        odds = np.zeros(max(0, n - 1))
        for inner in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = inner
            second[j], mass[inner], odds[inner - n] = True, a + b, np.log(b / a)
            heapq.heappush(heap, (a + b, inner))
        leaf, at, found = np.arange(n), np.arange(n), []
        while len(at := at[up := parent[at] >= 0]):
            leaf = leaf[up]
            found.append((leaf, parent[at] - n, second[at]))
            at = parent[at]
        if not found:
            return Tree(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), odds)
        of, node, branch = (np.concatenate([f[k] for f in found]) for k in range(3))
        by = np.argsort(of, kind="stable")
        length = np.bincount(of, minlength=n)
        return Tree(np.cumsum(length) - length, length, node[by].astype(np.int32), branch[by], odds)

    def paths(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``leaves`` each step belongs to, its node, and the branch taken."""
        n = self.length.take(leaves)
        total = np.cumsum(n)
        at = np.repeat(self.begin.take(leaves) - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
        return np.repeat(np.arange(len(leaves)), n), self.node.take(at), self.second.take(at)

    def low_steps(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Word, node and sign of the steps outside the ``TOP`` nodes, of leaves that come with most such steps first: the first
        steps of all that have one, then the second ones, and so on, and how many there are of each."""
        n = np.bincount(self.low.take(leaves))
        alive = len(leaves) - np.cumsum(n)[:-1]
        ends = np.cumsum(alive)
        of = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - alive, alive)
        at = self.begin.take(leaves).take(of) + np.repeat(np.arange(len(alive)), alive)
        return of, self.node.take(at), self.sign.take(at), alive.tolist()


@dataclass
class Vocabulary:
    """The most frequent words in descending order, the tree over them and, as its last leaf, all others; those with their counts (word, n), ``left`` in all."""

    words: list[str]
    tree: Tree
    left: int
    rare: DataFrame | None = None
    column: pa.Array | None = field(default=None, repr=False)

    def frequent(self) -> Vocabulary:
        """What tasks hold."""
        return replace(self, rare=None)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input ids, leaves and symbols (as neighbours of a rare word) of distinct words."""
        if self.column is None:
            self.column = pa.array(self.words, words.type)
        at = pc.fill_null(pc.index_in(words, value_set=self.column), -1).to_numpy().astype(np.int64)
        hashed, size = word_hash(words), len(self.words)
        return np.where((at >= 0) & (at < KNOWN), at, KNOWN + hashed % BUCKETS), np.where(at >= 0, at, size), np.where(at >= 0, at, size + 1 + hashed % SYMBOLS)


def word_hash(words: pa.Array) -> np.ndarray:
    """A hash of each word, from which its bucket as context follows."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    place = np.arange(len(data))
    place -= np.repeat(offsets[:-1] - offsets[0], size)
    place &= 63
    data += np.uint64(1)
    data *= SPREAD.take(place)
    mixed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data, out=mixed[1:])
    ends = offsets - offsets[0] if len(words) else np.zeros(1, np.int64)
    at_ends = mixed.take(ends)
    return ((at_ends[1:] - at_ends[:-1]) >> np.uint64(40)).astype(np.int64)


@dataclass
class Encoded:
    ids: np.ndarray
    leaves: np.ndarray
    symbols: np.ndarray
    per_text: np.ndarray
    words: pa.Array
    code: np.ndarray
    #: The leaf of rare words, and the symbol beyond the ends of a text.
    last: int

    def rare(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Text, word, and the symbols before and after it, of each occurrence of a word that is not among the most frequent."""
        at = np.flatnonzero(self.leaves == self.last)
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        padded = np.concatenate([self.symbols, [self.last]])
        inside = lambda to: np.where((to >= 0) & (to < len(text)) & (text[np.clip(to, 0, max(0, len(text) - 1))] == text[at]), to, len(text)) if len(at) else at
        return text[at], self.words.take(pa.array(self.code[at])), padded[inside(at - 1)], padded[inside(at + 1)]

    def windows(self, first: int = 0, stride: int = 1) -> np.ndarray:
        """Input ids around each word, or around every ``stride``-th, PAD beyond the ends of its text."""
        text = np.repeat(np.arange(len(self.per_text), dtype=np.int32), self.per_text)
        out = np.full((len(self.ids), len(OFFSETS)), PAD, np.int32)
        for k, step in enumerate(OFFSETS):
            a, b = slice(max(0, -step), max(0, len(text) - max(0, step))), slice(max(0, step), max(0, len(text) - max(0, -step)))
            out[a, k] = np.where(text[a] == text[b], self.ids[b], PAD)
        return out[first::stride]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of all texts (null: none), the place of each word among them, and the words per text."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return coded.dictionary, code[real], np.diff(ends)


def encode(texts: pa.Array, vocabulary: Vocabulary) -> Encoded:
    distinct, code, per_text = split_words(texts)
    ids, leaves, symbols = vocabulary.look_up(distinct)
    ids, leaves, symbols = (x.astype(np.int32).take(code) for x in (ids, leaves, symbols))
    return Encoded(ids, leaves, symbols, per_text, distinct, code, len(vocabulary.words))


#: Distinct words that a task holds before it passes their counts on.
HELD = 500_000


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; tasks add up their own words first, as codes of Arrow dictionaries."""

    def add_up(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in held]), len(coded.dictionary))  # exact up to 2^53
        return coded.dictionary, n.astype(np.int64)

    def emit(words: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(words), HELD):
            yield pa.RecordBatch.from_pydict({"word": words[a : a + HELD].cast(pa.string()), "n": pa.array(n[a : a + HELD], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, 0):
                distinct, code, _ = split_words(part.column(0))
                n = np.bincount(code, minlength=len(distinct))
                some = np.flatnonzero(n)
                held.append((distinct.take(pa.array(some)), n[some]))
                if sum(len(n) for _, n in held) > 2 * HELD:
                    held = [add_up(held)]
                    if len(held[0][1]) > HELD:
                        yield from emit(*held.pop())
        if held:
            yield from emit(*add_up(held))

    return docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocabulary(docs: DataFrame, vocabulary: int = 32_768) -> Vocabulary:
    """Counts all words and builds the tree over the most frequent ones, by count and then by word, and all others."""
    counts = materialize(word_counts(docs), "lm-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = max(1, total - sum(r.n for r in top))
    rare = counts
    if top:  # what comes after the last of the most frequent, in their order
        last = top[-1]
        rare = counts.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word)))
    return Vocabulary([r.word for r in top], Tree.over(np.array([*(r.n for r in top), left])), left, rare)


def rows_of(windows: np.ndarray) -> np.ndarray:
    """Rows of weights of the words in ``windows``."""
    return windows + np.arange(len(OFFSETS), dtype=np.int32) * (PAD + 1)


def starts(sorted_rows: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))


def ranked(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts whole numbers from 0 to ``most``, equal ones as they come, and the sorted numbers: each is sorted
    with its place in one word, which numpy does several times as fast as an argsort."""
    kind, bits = (np.uint32, 16) if max(most, len(values)) < 1 << 16 else (np.uint64, 32)
    both = values.astype(kind) << kind(bits)
    both |= np.arange(len(values), dtype=kind)
    both.sort()
    return (both & kind((1 << bits) - 1)).astype(np.int64), both >> kind(bits)


def grouped(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``rows``, ``most`` at most; the distinct ones, those that occur most first, where each begins, and how often it occurs."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    by, in_order = ranked(rows, most)
    first = starts(in_order)
    n = np.diff(first, append=len(rows))
    longest = int(n.max())
    order, _ = ranked(longest - n, longest)
    first = first.take(order)
    return by, in_order.take(first).astype(np.int64), first, n.take(order)


def add_runs(values: np.ndarray, first: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """Sums of runs of rows, the longest first. Of short runs all first rows are taken, all second ones added to them, and so on."""
    values.take(first, axis=0, out=out, mode="clip")
    more = len(n) - np.cumsum(np.bincount(np.minimum(n, LONG + 1), minlength=LONG + 2))  # runs of more than so many rows
    long = int(more[LONG])
    if long:
        ends = np.cumsum(n[:long])
        rows = values.take(np.arange(ends[-1]) + np.repeat(first[:long] - (ends - n[:long]), n[:long]), axis=0)
        # complex numbers take two columns at a step, as the width is even
        out[:long] = np.add.reduceat(rows.view(np.complex64), ends - n[:long], axis=0).view(np.float32)
    for k in range(1, LONG):
        if (m := int(more[k])) > long:
            out[long:m] += values.take(first[long:m] + k, axis=0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` by blocks of rows of ``a``, which has many: each block on this thread."""
    out, rows = np.empty((len(a), b.shape[1]), np.float32), max(1, ONE_THREAD // b.size)
    for k in range(0, len(a), rows):
        np.matmul(a[k : k + rows], b, out=out[k : k + rows])
    return out


def one_plus_exp(x: np.ndarray) -> np.ndarray:
    """1 + exp(x), in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return x


class Network:
    """tanh(sum of the context words' vectors + bias), then a logistic unit at each node of the tree. Trained by AdaGrad.

    ``weights`` has a row per context word and place, one of the bias, and one per node, with the node's own bias last.
    """

    def __init__(self, tree: Tree, weights: np.ndarray | None = None) -> None:
        if weights is None:
            weights = np.zeros((CONTEXT + 1 + len(tree.prior), HIDDEN + 1), np.float32)
            weights[:CONTEXT, :HIDDEN] = np.random.default_rng(5).standard_normal((CONTEXT, HIDDEN)) * 0.1
            weights[CONTEXT + 1 :, HIDDEN] = tree.prior  # so far every word has its share of all words
        self.tree, self.weights = tree, weights.astype(np.float32)
        self.moved, self.squares = np.zeros(len(weights), np.float32), np.zeros(len(weights), np.float32)

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        """The hidden layer with a 1 at its end, which meets the nodes' own biases."""
        rows = rows_of(windows)
        h = self.weights.take(rows[:, 0], axis=0)  # take is several times as fast as an index
        for k in range(1, len(OFFSETS)):
            h += self.weights.take(rows[:, k], axis=0)
        h += self.weights[CONTEXT]
        np.tanh(h, out=h)
        h[:, HIDDEN] = 1
        return h

    def top(self) -> np.ndarray:
        """The weights of the tree's ``TOP`` nodes."""
        return self.weights[CONTEXT + 1 + self.tree.first_top :]

    def order(self, leaves: np.ndarray) -> np.ndarray:
        """Words with most steps outside the ``TOP`` nodes first."""
        low = self.tree.low.take(leaves)
        longest = low.max(initial=0)
        return ranked(longest - low, int(longest))[0]

    def log_prob(self, windows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Of each word, the sum of -log(1 + exp(-z)) over its path, z being signed by the branch."""
        out = np.zeros(len(leaves))
        if len(self.tree.length) < 2:
            return out
        top = np.ascontiguousarray(self.top().T)
        for a in range(0, len(leaves), SCORED):
            order = self.order(leaves[a : a + SCORED])
            mine = leaves[a : a + SCORED].take(order)
            h = self.hidden(windows[a : a + SCORED].take(order, axis=0))
            sign = self.tree.signs.take(self.tree.exit.take(mine), axis=0)
            z = product(h, top)
            z *= sign
            z = np.log(one_plus_exp(np.negative(z, out=z)), out=z)
            whole = np.einsum("ij,ij->i", z, np.abs(sign, out=sign)).astype(np.float64)
            of, node, sign, alive = self.tree.low_steps(mine)
            z = np.einsum("ij,ij->i", h.take(of, axis=0), self.weights.take(node + (CONTEXT + 1), axis=0))
            z *= sign
            z, at = np.log(one_plus_exp(np.negative(z, out=z)), out=z), 0
            for m in alive:
                whole[:m] += z[at : at + m]
                at += m
            out[a + order] = -whole
        return out

    def slopes(self, windows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of weights that a batch touches, and all of ``TOP`` nodes, the slopes of its mean negative log-probability there, and how often each is touched.

        At a node the slope is that of log(1 + exp(-sign * z)): -sign / (1 + exp(sign * z)).
        """
        order, tree = self.order(leaves), self.tree
        windows, leaves = windows.take(order, axis=0), leaves.take(order)
        h, scale = self.hidden(windows), np.float32(-1 / len(leaves))
        top, exits = self.top(), tree.exit.take(leaves)
        sign, g = tree.signs.take(exits, axis=0), product(h, np.ascontiguousarray(top.T))
        g *= sign
        sign *= scale
        np.divide(sign, one_plus_exp(g), out=g)
        down = product(g, top)
        of, node, sign, alive = tree.low_steps(leaves)
        by, found_n, first_n, times_n = grouped(node, len(tree.prior))
        inputs, found_i, first_i, times_i = grouped(rows_of(windows).ravel(order="F"), CONTEXT)
        i, n = len(found_i), len(found_i) + len(found_n)
        slope = np.zeros((n + len(top) + 1, HIDDEN + 1), np.float32)
        for k in range(0, len(h), some := max(1, ONE_THREAD // top.size)):
            slope[n:-1] += g[k : k + some].T @ h[k : k + some]
        w = self.weights.take(node + (CONTEXT + 1), axis=0)
        g = np.einsum("ij,ij->i", h.take(of, axis=0), w)
        g *= sign
        sign *= scale
        np.divide(sign, one_plus_exp(g), out=g)
        w *= g[:, None]
        at = 0
        for m in alive:
            down[:m] += w[at : at + m]
            at += m
        down *= 1 - h * h  # nothing for the last column, which is 1
        w = h.take(of.take(by), axis=0)
        w *= g.take(by)[:, None]
        if len(found_n):
            add_runs(w, first_n, times_n, slope[i:n])
        add_runs(down.take(np.tile(np.arange(len(down)), len(OFFSETS)).take(inputs), axis=0), first_i, times_i, slope[:i])
        slope[-1] = down.view(np.complex64).sum(axis=0).view(np.float32)
        times_t = np.bincount(exits, minlength=len(tree.signs)) @ np.abs(tree.signs)
        rows = [found_i, found_n + (CONTEXT + 1), np.arange(len(self.weights) - len(top), len(self.weights)), [CONTEXT]]
        return np.concatenate(rows), slope, np.concatenate([times_i, times_n, times_t, [len(leaves)]])

    def train(self, windows: np.ndarray, leaves: np.ndarray, rate: float = 0.15) -> None:
        """One pass."""
        if len(self.tree.length) < 2:
            return
        whole = self.weights.view(f"V{self.weights[0].nbytes}")[:, 0]  # rows as single values are written at twice the speed
        for a in range(0, len(leaves), BATCH):
            rows, slope, times = self.slopes(windows[a : a + BATCH], leaves[a : a + BATCH])
            squares = self.squares.take(rows) + np.einsum("ij,ij->i", slope, slope) / np.float32(slope.shape[1])
            self.squares[rows] = squares
            slope *= (np.float32(rate) / np.sqrt(squares + 1e-8))[:, None]
            np.subtract(self.weights.take(rows, axis=0), slope, out=slope)
            whole[rows] = slope.view(whole.dtype)[:, 0]
            self.moved[rows] += times


def mean_rows(group: pd.DataFrame) -> pd.DataFrame:
    """The mean of a chunk's rows of weights over tasks, each by how often the task moved it; rows that none moved are alike in all."""
    group = group.sort_values("task")
    total = moved = 0
    for part, times in zip(group["part"], group["moved"], strict=True):
        own = np.frombuffer(times, "<f4").astype(np.float64)
        total = total + np.frombuffer(part, "<f4").reshape(len(own), -1) * (own + 1e-6)[:, None]
        moved = moved + own
    mean = total / (moved + 1e-6 * len(group))[:, None]
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "task": [int(group["task"].iloc[0]) // FAN_IN], "part": [mean.astype("<f4").tobytes()], "moved": [moved.astype("<f4").tobytes()]})


WEIGHTS = "chunk int, task long, part binary, moved binary"
FAN_IN, LEVELS = 64, 3


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 2) -> Network:
    """A pass over all words of all documents, a ``rounds``-th of the documents in each round."""
    spark = docs.sparkSession
    network = Network(vocabulary.tree)
    words = spark.sparkContext.broadcast(vocabulary.frequent())
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(network.weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, seen = None, False
            for batch in batches:
                for part in slices(batch, 0, SLICE):
                    e = encode(part.column(0), words.value)
                    own = own or Network(words.value.tree, start.value)
                    own.train(e.windows(), e.leaves)
                    seen = seen or len(e.ids) > 0
            if seen:
                task = TaskContext.get().partitionId()
                cuts = [(p.astype("<f4").tobytes(), m.astype("<f4").tobytes()) for p, m in zip(np.array_split(own.weights, CHUNKS), np.array_split(own.moved, CHUNKS), strict=True)]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "task": pa.array([task] * CHUNKS, pa.int64()), "part": pa.array([c[0] for c in cuts], pa.binary()), "moved": pa.array([c[1] for c in cuts], pa.binary())})

        mine = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        some = mine.mapInArrow(lean(learn), WEIGHTS)
        for _ in range(LEVELS - 1):
            some = some.groupBy("chunk", F.floor(F.col("task") / FAN_IN).alias("lane")).applyInPandas(mean_rows, WEIGHTS)
        found = sorted(some.groupBy("chunk").applyInPandas(mean_rows, WEIGHTS).collect(), key=lambda r: r.chunk)
        if found:
            network = Network(vocabulary.tree, np.concatenate([np.frombuffer(r.part, "<f4").reshape(-1, HIDDEN + 1) for r in found]))
    return network


PARTS = "at long, doc_id long, n_tokens long, log_prob double, word string, before int, after int"


def rare_log_probs(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """at, log_prob, again: the log-probabilities of rare words among rare words, summed by document, and how many stand
    between the same neighbours elsewhere. ``tokens``: at, word, before, after.

    All is counted within a word, and a rare word has fewer occurrences than each word of the vocabulary, so no task
    gets more than its share. Rows are dealt by word and sorted once, by word and neighbours, which serves the counting
    and the join. Only words that stand between the same neighbours elsewhere look up how many rare words do.
    """
    counts = vocabulary.rare.select(F.xxhash64("word").alias("key"), "n")
    both = F.shiftleft(F.col("before").cast("long"), 32).bitwiseOR(F.col("after").cast("long"))
    own = tokens.select("at", F.xxhash64("word").alias("key"), both.alias("both")).repartition("key")
    same = F.count(F.lit(1)).over(Window.partitionBy("key", "both")) - 1
    wide = own.withColumn("again", same).join(counts, "key", "left")
    again = F.col("again") > 0
    for c, symbol in (("before", F.shiftright("both", 32)), ("after", F.col("both").bitwiseAND(F.lit((1 << 32) - 1)))):
        # a row per symbol: the vocabulary, SYMBOLS hashes and the edge of a text at most
        near = tokens.groupBy(F.col(c).cast("long").alias(c)).agg(F.count(F.lit(1)).alias(f"n_{c}"))
        wide = wide.join(F.broadcast(near), F.when(again, symbol) == F.col(c), "left")
    share = F.coalesce("n", F.lit(1)) / F.lit(vocabulary.left)
    room = F.least("n_before", "n_after") - 1  # 1 at least where there is another one
    p = (1 - MEMORY) * share + F.when(again, MEMORY * F.col("again") / room).otherwise(0.0)
    return wide.groupBy("at").agg(F.sum(F.log(p)).alias("log_prob"), F.count_if(again).alias("again"))


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, seen_again of every row of ``docs`` (doc_id, text).

    Tasks write a row per document with all but the rare words' parts, and a row per rare word in it, whose
    log-probability among rare words comes from all documents. ``seen_again`` is the share of a document's words
    that are rare and stand between the same neighbours elsewhere.
    """
    context = docs.sparkSession.sparkContext
    words, weights = context.broadcast(vocabulary.frequent()), context.broadcast(network.weights)
    schema = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("word", pa.string()), ("before", pa.int32()), ("after", pa.int32())])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = Network(words.value.tree, weights.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                e = encode(part.column(1), words.value)
                sums = np.concatenate([[0.0], np.cumsum(own.log_prob(e.windows(), e.leaves))])
                ends = np.cumsum(e.per_text)
                total = np.where(e.per_text > 0, sums[ends] - sums[ends - e.per_text], 0.0)
                yield rows(part.num_rows, at=pa.array(np.arange(part.num_rows) + at), doc_id=part.column(0), n_tokens=pa.array(e.per_text), log_prob=pa.array(total))
                text, word, before, after = e.rare()
                for a in range(0, len(text), 100_000):
                    some = slice(a, a + 100_000)
                    yield rows(len(text[some]), at=pa.array(text[some] + at), word=word[some], before=pa.array(before[some]), after=pa.array(after[some]))
                at += part.num_rows

    parts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), PARTS), "lm-parts", compression="zstd")
    tokens = parts.where("before is not null").select("at", "word", "before", "after")
    whole = parts.where("before is null").select("at", "doc_id", "n_tokens", "log_prob").unionByName(rare_log_probs(tokens, vocabulary), allowMissingColumns=True)
    whole = whole.groupBy("at").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob"), F.coalesce(F.sum("again"), F.lit(0)).alias("again"))
    some = F.col("n_tokens") > 0
    return whole.select("doc_id", "n_tokens", "log_prob", F.when(some, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"), F.when(some, F.col("again") / F.col("n_tokens")).alias("seen_again"))


def op2_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vocabulary = build_vocabulary(docs)
    return score(docs, vocabulary, train(docs, vocabulary))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_pseudo_lm": op2_pseudo_lm}
