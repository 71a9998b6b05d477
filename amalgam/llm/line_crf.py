"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad, from features of the line and of its neighbours and from the label of the
line before; forward-backward gives each line's marginal, and their mean weighted by line length is the
document's score. It is fitted by maximum likelihood, each line of a labelled document bearing the
document's label. Scoring takes one pass over whole texts.

The fit uses at most ``max_docs`` labelled documents (those with the least hashes of doc_id) and
``max_lines`` of their lines; both bounds are parameters. Everything else covers all rows.

Defined results: a null or empty text is one empty line; a null doc_id is never a training row and
not held out; null labels are ignored; repeated rows are scored each; without any usable label every
score is 0.5; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, materialize, slices

_KINDS = np.zeros((8, 256), np.uint8)
for _c in range(256):
    _KINDS[:, _c] = (
        65 <= _c <= 90,
        97 <= _c <= 122,
        48 <= _c <= 57,
        _c in b" \t\n\v\f\r",
        _c >= 128,
        _c == 33,
        _c in b".,;:?'\"-()",
        32 < _c < 127 and not chr(_c).isalnum() and _c not in b".,;:?!'\"-()",
    )
_SPREAD = np.random.default_rng(11).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)
_LETTER = np.random.default_rng(12).integers(1, 1 << 62, 256).astype(np.uint64)
OWN = 16
#: Bytes of text whose lines are described at once, in a working set of some 60 times as many.
SLICE = 1 << 19
#: Own features that are also taken from the line before and the line after.
NEAR = (2, 3, 4, 5, 6, 9, 13, 14)
FEATURES = OWN + 2 * len(NEAR) + 2


def _hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:stop]; the ranges are ascending and not empty."""
    size = stop - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    inside = at - np.repeat(begin, size)
    mixed = _LETTER[data[at]] * _SPREAD[inside & 63] + (inside >> 6).astype(np.uint64)
    return np.add.reduceat(mixed, np.cumsum(size) - size)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (a row each), the lines of each text, and the bytes of each line (1 at least)."""
    if not texts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    newline = np.flatnonzero(data == 10)
    start = np.concatenate([[0], newline[:-1] + 1])
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    per_doc = np.diff(np.concatenate([[0], np.searchsorted(newline, ends) + 1]))
    doc_of = np.repeat(np.arange(len(texts)), per_doc)
    upper, lower, digit, space, high, bang, usual, odd = (np.add.reduceat(_KINDS[k][data], start, dtype=np.int32).astype(np.float32) for k in range(8))
    size = (newline - start).astype(np.float32)
    space -= 1
    gap = _KINDS[3][data].astype(bool)
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    line_of = np.searchsorted(newline, first)
    lines = len(newline)
    words = np.bincount(line_of, minlength=lines).astype(np.float32)
    if len(first):
        word = _hashes(data, first, last)
        same_line = line_of[1:] == line_of[:-1]
        again = np.bincount(line_of[1:][same_line & (word[1:] == word[:-1])], minlength=lines)
        key = word ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        distinct = np.bincount(line_of[order[fresh]], minlength=lines)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(words.astype(np.int64)) - words.astype(np.int64), words.astype(np.int64))
        sums = np.zeros(lines, np.uint64)
        filled = np.unique(line_of)
        sums[filled] = np.add.reduceat(word * _SPREAD[turn & 63], np.searchsorted(line_of, filled))
    else:
        again, distinct, sums = np.zeros(lines), np.zeros(lines), np.zeros(lines, np.uint64)
    pair = sums ^ (doc_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, back, copies = np.unique(pair, return_inverse=True, return_counts=True)
    repeated = (copies[back] > 1) & (words > 0)
    letters = np.maximum(upper + lower, 1)
    length, count = np.maximum(size, 1), np.maximum(words, 1)
    tail = data[np.maximum(newline - 1, 0)]
    own = np.stack(
        [
            np.ones(lines),
            np.log1p(size) / 8,
            upper / letters,
            digit / length,
            usual / length,
            np.minimum(bang / count, 3),
            again / count,
            np.minimum((size - space) / count, 30) / 10,
            high / length,
            repeated,
            np.isin(tail, np.frombuffer(b".?!", np.uint8)) & (size > 0),
            _KINDS[0][data[start]],
            np.log1p(words) / 6,
            distinct / count,
            odd / length,
            (words == 0),
        ],
        axis=1,
    ).astype(np.float32)
    edge = np.concatenate([[True], doc_of[1:] != doc_of[:-1]])
    final = np.concatenate([edge[1:], [True]])
    near = own[:, NEAR]
    before = np.where(edge[:, None], near, np.concatenate([near[:1], near[:-1]]))
    after = np.where(final[:, None], near, np.concatenate([near[1:], near[-1:]]))
    return np.concatenate([own, before, after, edge[:, None], final[:, None]], axis=1).astype(np.float32), per_doc, np.maximum(size, 1).astype(np.int64)


def forward_backward(score: np.ndarray, per_doc: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the good label of every line, and for each line but a document's last one the marginals of
    its label with the next one's (4 columns). ``score`` is the log-odds of a line on its own; ``transition``
    2 x 2 log weights. All documents advance side by side, a line at a step."""
    lines = len(score)
    half = np.clip(score, -60, 60)[:, None] * np.array([-0.5, 0.5])
    node, move = np.exp(half), np.exp(transition)
    first = np.cumsum(per_doc) - per_doc
    by = np.argsort(-per_doc, kind="stable")
    at, n = first[by], per_doc[by]
    steps = int(n.max(initial=0))
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    forward, backward = np.zeros((lines, 2)), np.ones((lines, 2))
    for t, a in enumerate(active.tolist()):
        i = at[:a] + t
        f = node[i] if t == 0 else (forward[i - 1] @ move) * node[i]
        forward[i] = f / f.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        i = at[: active[t + 1]] + t
        b = (node[i + 1] * backward[i + 1]) @ move.T
        backward[i] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    inner = np.ones(lines, bool)
    inner[first + per_doc - 1] = False
    i = np.flatnonzero(inner)
    pair = (forward[i][:, :, None] * move[None] * (node[i + 1] * backward[i + 1])[:, None, :]).reshape(-1, 4)
    return both[:, 1] / both.sum(axis=1), pair / pair.sum(axis=1, keepdims=True)


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    transition: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Quality of each text: line marginals weighted by line length."""
        x, per_doc, size = line_features(texts)
        if not len(per_doc):
            return np.zeros(0)
        good, _ = forward_backward(((x - self.mean) / self.scale) @ self.weight, per_doc, self.transition)
        begin = np.cumsum(per_doc) - per_doc
        return np.clip(np.add.reduceat(good * size, begin) / np.add.reduceat(size, begin), 0, 1)


def fit(x: np.ndarray, per_doc: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> LineCrf:
    """Maximum likelihood with a ridge, by Adam over all lines; a document weighs 1 / sqrt(its lines) per line."""
    if not len(label) or label.min() == label.max():
        return LineCrf(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)))
    mean, scale = x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64)
    mean[0], scale[scale < 1e-6] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(label, per_doc)
    importance = np.repeat(1 / np.sqrt(per_doc), per_doc)
    importance /= importance.sum()
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_doc) - 1] = False
    seen = np.zeros((int(inner.sum()), 4))
    seen[np.arange(len(seen)), 3 * y[inner]] = 1
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for t in range(1, rounds + 1):
        good, pair = forward_backward(z @ theta[:FEATURES], per_doc, theta[FEATURES:].reshape(2, 2))
        slope = np.concatenate([z.T @ ((y - good) * importance), (seen - pair).T @ importance[inner]])
        slope -= ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return LineCrf(mean, scale, theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, max_lines: int = 150_000) -> LineCrf:
    """Fits on at most ``max_docs`` labelled rows of ``docs`` that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    chosen = materialize(chosen, "crf-labels")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                x, n, _ = line_features([t or "" for t in part.column(2).to_pylist()])
                begin = np.cumsum(n) - n
                rows = [x[a : a + k].astype("<f4").tobytes() for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "quality", "n", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = materialize(own.mapInArrow(lean(featurize), "doc_id long, quality int, n long, x binary"), "crf-features")
    rows, lines = [], 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "x").limit(max_docs).toLocalIterator():
        if rows and lines + r.n > max_lines:
            continue
        rows.append(r)
        lines += r.n
    x = np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    return fit(x, np.array([r.n for r in rows], np.int64), np.array([r.quality for r in rows], np.int64))


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    return quality_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_of(docs: DataFrame, model: LineCrf, out: str = "score") -> DataFrame:
    """All columns of ``docs``, among them text, with their quality as the last column, ``out``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SLICE):
                scores = model.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    # by number: Spark's call takes no names with dots
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(lean(run), f"{fields}, score double").toDF(*docs.columns, out)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels.select("doc_id", "quality")))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


ORACLE: dict[str, str] = {}
QUERIES = {"op5_line_crf": op5_line_crf}
