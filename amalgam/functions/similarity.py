"""String similarities that Spark has no function for, on Arrow batches; each distinct pair of a batch is scored once."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; above 0.7 raised by a tenth of what is missing for each common leading letter, four at most."""
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(la, lb) // 2 - 1)
    where: dict[str, int] = {}
    for j, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << j
    free, mine = (1 << lb) - 1, []
    for i, ch in enumerate(a):
        near = where.get(ch, 0) & free & ((1 << i + reach + 1) - 1)
        if i > reach:
            near = near >> i - reach << i - reach
        if near:
            free ^= near & -near  # the first place that is left
            mine.append(ch)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for j, ch in enumerate(b) if not free >> j & 1]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / la + m / lb + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Strings that one batch takes side by side, the longest of them, and the distinct letters that a batch may have.
MANY, LONGEST, LETTERS = 8_192, 63, 64


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points per text, 0 beyond its end, and the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), int(size.max(initial=1)) or 1), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """:func:`jaro_winkler` of many pairs side by side, a letter of the left sides at a step; long or odd texts one by one."""
    out = np.empty(len(left))
    for at in range(0, len(left), MANY):
        a, b = left[at : at + MANY], right[at : at + MANY]
        short = [k for k in range(len(a)) if 0 < len(a[k]) <= LONGEST and 0 < len(b[k]) <= LONGEST]
        x, la = _letters([a[k] for k in short])
        y, lb = _letters([b[k] for k in short])
        letters = np.unique(np.concatenate([x.ravel(), y.ravel()])) if short else np.zeros(0, np.uint32)
        if not short or len(letters) > LETTERS:
            short = []
        else:
            out[np.array(short) + at] = _side_by_side(np.searchsorted(letters, x), la, np.searchsorted(letters, y), lb, len(letters), x, y)
        one_by_one = set(range(len(a))) - set(short)
        for k in one_by_one:
            out[at + k] = jaro_winkler(a[k], b[k])
    return out


def _side_by_side(x: np.ndarray, la: np.ndarray, y: np.ndarray, lb: np.ndarray, letters: int, raw_x: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    n, one, rows = len(la), np.uint64(1), np.arange(len(la))
    where = np.zeros((n, letters), np.uint64)  # the places of each letter on the right, as bits
    for j in range(y.shape[1]):
        on = rows[lb > j]
        where[on, y[on, j]] |= one << np.uint64(j)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free = (one << lb.astype(np.uint64)) - one
    mine = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        on = rows[la > i]
        high = np.minimum(i + reach[on] + 1, 63).astype(np.uint64)
        low = np.maximum(i - reach[on], 0).astype(np.uint64)
        near = where[on, x[on, i]] & free[on] & ((one << high) - one)
        near = near >> low << low
        mine[on, i] = near > 0
        free[on] ^= near & (~near + one)  # the first place that is left
    return _finish(mine, free, la, lb, raw_x, raw_y)


def _finish(mine: np.ndarray, free: np.ndarray, la: np.ndarray, lb: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    """Scores from the matched letters of the left sides, the places left free on the right, and the letters of both."""
    n, one, rows = len(mine), np.uint64(1), np.arange(len(mine))
    theirs = (np.arange(raw_y.shape[1]) < lb[:, None]) & ((free[:, None] >> np.arange(raw_y.shape[1]).astype(np.uint64)) & one == 0)
    m = mine.sum(axis=1)
    # matched letters of both sides in order: as many on either side, row by row
    swapped = np.bincount(np.repeat(rows, m), raw_x[mine] != raw_y[theirs], n) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - swapped) / some) / 3, 0.0)
    width = min(4, raw_x.shape[1], raw_y.shape[1])
    same = (raw_x[:, :width] == raw_y[:, :width]) & (raw_x[:, :width] > 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


#: Bits of the places that a letter at place i may match, by i and by reach.
_WINDOW = np.array([[((1 << min(i + r + 1, 63)) - 1) >> max(i - r, 0) << max(i - r, 0) for r in range(64)] for i in range(64)], np.uint64)
#: Rows of a batch that a left side must have to be scored against its right sides on its own.
MIN_ROWS = 48


class _Rights:
    """The right sides of a batch, with the places of each letter in them as bits."""

    def __init__(self, texts: list[str]):
        self.letters, self.size = _letters(texts)
        self.where: dict[int, np.ndarray] = {}
        for j in range(min(LONGEST, self.letters.shape[1])):
            for ch in np.unique(self.letters[:, j]).tolist():
                bits = self.where.setdefault(ch, np.zeros(len(texts), np.uint64))
                bits[(self.letters[:, j] == ch) & (self.size > j)] |= np.uint64(1 << j)

    def against(self, a: str, of: np.ndarray) -> np.ndarray:
        """:func:`jaro_winkler` of ``a`` and the right sides ``of``, none of which is empty or longer than LONGEST."""
        lb, one = self.size[of], np.uint64(1)
        reach = np.maximum(0, np.maximum(len(a), lb) // 2 - 1)
        free = (one << lb.astype(np.uint64)) - one
        mine = np.zeros((len(of), len(a)), bool)
        for i, ch in enumerate(a):
            bits = self.where.get(ord(ch))
            if bits is not None:
                near = bits[of] & free & _WINDOW[i][reach]
                mine[:, i] = near > 0
                free ^= near & (~near + one)  # the first place that is left
        raw = np.broadcast_to(np.array([ord(ch) for ch in a], np.uint32), mine.shape)
        return _finish(mine, free, np.full(len(of), len(a)), lb, raw, self.letters[of])


def jaro_winkler_coded(a: list[str], b: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """:func:`jaro_winkler` of the pairs a[left], b[right]: a left side with many rows is scored against all of its right sides
    at once, as a join leaves them side by side; the rest pair by pair, each distinct pair once."""
    out, per = np.empty(len(left)), np.bincount(left, minlength=len(a))
    short = np.fromiter((0 < len(t) <= LONGEST for t in b), bool, len(b))
    many = np.fromiter((0 < len(t) <= LONGEST for t in a), bool, len(a)) & (per >= MIN_ROWS)
    # pairs that come again and again, as of names, are few when taken once
    alone = many[left] & short[right] if len(a) * len(b) > len(left) // 4 else np.zeros(len(left), bool)
    if alone.any():
        rights = _Rights(b)
        at = np.flatnonzero(alone)
        at = at[np.argsort(left[at], kind="stable")]
        for rows in np.split(at, np.flatnonzero(np.diff(left[at])) + 1):
            out[rows] = rights.against(a[left[rows[0]]], right[rows])
    rest = np.flatnonzero(~alone)
    distinct, back = np.unique(left[rest] * len(b) + right[rest], return_inverse=True)
    if len(distinct):
        out[rest] = jaro_winkler_many([a[k] for k in (distinct // len(b)).tolist()], [b[k] for k in (distinct % len(b)).tolist()])[back]
    return out


class Wall:
    """Texts that others are held against: the places of each letter in them as bits. A text that is null, empty or too long has none."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        self.letters, self.size = _letters([t or "" for t in texts])
        self.odd = np.flatnonzero(self.size > LONGEST)
        self.fit = (self.size > 0) & (self.size <= LONGEST)
        width = min(LONGEST, self.letters.shape[1])
        alphabet, coded = np.unique(self.letters[:, :width], return_inverse=True)
        self.coded = coded.reshape(len(texts), width)
        self.code = {int(ch): k for k, ch in enumerate(alphabet) if ch}

    @functools.cached_property
    def where(self) -> np.ndarray:
        bits, rows = np.zeros((max(self.code.values(), default=0) + 1, len(self.texts)), np.uint64), np.arange(len(self.texts))
        for j in range(self.coded.shape[1]):
            on = rows[self.fit & (self.size > j)]
            bits[self.coded[on, j], on] |= np.uint64(1 << j)
        return bits


def _verdicts(la: int, least: float, shared: int) -> np.ndarray:
    """By length of the other text, matched letters and equal leading letters: 0 below ``least``, 1 not below, 2 the order of the
    letters decides. Equal leading letters, ``shared`` at least, match each other, so that many are in order."""
    lb, m, lead = np.arange(LONGEST + 1)[:, None, None], np.arange(LONGEST + 2)[None, :, None], np.arange(5)[None, None, :]

    def score(swapped):
        jaro = np.where(m > 0, (m / la + m / np.maximum(lb, 1) + (m - swapped) / np.maximum(m, 1)) / 3, 0.0)
        return np.where(jaro > 0.7, jaro + lead * 0.1 * (1 - jaro), jaro)

    low = score(np.maximum(0, m - np.maximum(lead, shared)) // 2)
    return np.where(score(np.zeros_like(m)) < least - 1e-9, 0, np.where(low >= least + 1e-9, 1, 2)).astype(np.int8)


class _Against:
    """Left texts, one after another, against all of a wall or its end. A text that begins as the one before, and is as long, goes on
    from the letters that they share."""

    def __init__(self, wall: Wall, least: float, shared: int):
        self.wall, self.least, self.shared = wall, least, shared
        self.windows: dict[tuple[int, int], np.ndarray] = {}
        self.tables: dict[int, np.ndarray] = {}
        n = len(wall.texts)
        self.base = np.minimum(wall.size, LONGEST) * ((LONGEST + 2) * 5)
        self.full = np.where(wall.fit, (np.uint64(1) << np.minimum(wall.size, LONGEST).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        self.buffers = [np.empty(n, np.uint64) for _ in range(LONGEST)]
        self.t, self.u = np.empty(n, np.uint64), np.empty(n, np.uint64)
        self.before, self.start, self.states = "", -1, []

    def window(self, la: int, i: int) -> np.ndarray:
        if (la, i) not in self.windows:
            reach = np.maximum(0, np.maximum(la, np.minimum(self.wall.size, LONGEST)) // 2 - 1)
            self.windows[la, i] = _WINDOW[i][reach]
        return self.windows[la, i]

    def __call__(self, a: str, start: int = 0) -> np.ndarray:
        """Whether each text of the wall from ``start`` on is as near to ``a``, which is neither empty nor too long."""
        w, la, n = self.wall, len(a), len(self.wall.texts) - start
        known = 0
        if start == self.start and len(self.before) == la:
            while known < la and a[known] == self.before[known]:
                known += 1
        else:
            self.states = [self.full[start:]]
        del self.states[known + 1 :]
        t, u = self.t[:n], self.u[:n]
        for i in range(known, la):
            k, free = w.code.get(ord(a[i])), self.states[i]
            if k is None:
                self.states.append(free)
                continue
            np.bitwise_and(w.where[k, start:], free, out=t)
            np.bitwise_and(t, self.window(la, i)[start:], out=t)
            np.negative(t, out=u)
            np.bitwise_and(t, u, out=t)
            self.states.append(np.bitwise_xor(free, t, out=self.buffers[i][:n]))  # without the first place that is left
        self.before, self.start = a, start
        matched = np.bitwise_count(self.full[start:] ^ self.states[la])
        lead = np.int64(4)
        if self.shared < 4:
            lead, equal = np.zeros(n, np.int64), np.ones(n, bool)
            for j in range(min(4, la, w.letters.shape[1])):
                equal = equal & (w.letters[start:, j] == ord(a[j]))
                lead += equal
        if la not in self.tables:
            self.tables[la] = _verdicts(la, self.least, self.shared).ravel()
        verdict = self.tables[la][self.base[start:] + matched.astype(np.int64) * 5 + lead]
        verdict[~w.fit[start:]] = 0
        out = verdict == 1
        open_ = np.flatnonzero(verdict == 2)
        if len(open_):
            states = np.array([s[open_] for s in self.states])
            raw = np.broadcast_to(np.array([ord(ch) for ch in a], np.uint32), (len(open_), la))
            of = open_ + start
            mine = np.ascontiguousarray((states[1:] != states[:-1]).T)
            out[open_] = _finish(mine, states[-1], np.full(len(of), la), w.size[of], raw, w.letters[of]) >= self.least
        for k in w.odd[w.odd >= start]:
            out[k - start] = jaro_winkler(a, w.texts[k]) >= self.least
        return out


def near_matrix(a: Wall, b: Wall, least: float, wanted: np.ndarray | None = None, upper: bool = False) -> np.ndarray:
    """Whether the :func:`jaro_winkler` of each text of ``a`` and each of ``b`` is ``least``; a null is near nothing. Where not
    ``wanted``, or left of the diagonal with ``upper``, nothing is said. The similarity is the same both ways round."""
    out = np.zeros((len(a.texts), len(b.texts)), bool)
    shared, width = 0, min(a.letters.shape[1], b.letters.shape[1])
    both = np.concatenate([a.letters[a.size > 0, :width], b.letters[b.size > 0, :width]])
    while len(both) and shared < width and both[0, shared] and (both[:, shared] == both[0, shared]).all():
        shared += 1
    by_row = np.ones(len(a.texts), bool)
    if wanted is not None:
        # rows of which much is wanted, then columns of the rest, then what is left pair by pair
        by_row = wanted.mean(axis=1) > 0.1
        left = wanted & ~by_row[:, None]
        by_column = left.mean(axis=0) > 0.1
        against = _Against(a, least, shared)
        for j in np.flatnonzero(by_column):
            out[:, j] = _of(against, b.texts[j], 0)
        i, j = np.nonzero(left & ~by_column)
        if len(i):
            out[i, j] = jaro_winkler_coded([t or "" for t in a.texts], [t or "" for t in b.texts], i, j) >= least
    against, step = _Against(b, least, shared), 64
    for i in np.flatnonzero(by_row):
        start = i - i % step if upper else 0
        out[i, start:] = _of(against, a.texts[i], start)
    return out if wanted is None else out & wanted


def _of(against: _Against, text: str | None, start: int) -> np.ndarray:
    if text and len(text) <= LONGEST:
        return against(text, start)
    texts = against.wall.texts[start:]
    return np.array([bool(text and t) and jaro_winkler(text, t) >= against.least for t in texts], bool)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _by_pair(score: Callable[[list[str], list[str], np.ndarray, np.ndarray], np.ndarray]):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(left), pc.is_valid(right))
        l, r = (c.filter(known).dictionary_encode() for c in (left, right))
        out = np.full(len(left), np.nan)
        if len(l):
            codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (l, r)]
            out[known.to_numpy(zero_copy_only=False)] = score(l.dictionary.to_pylist(), r.dictionary.to_pylist(), *codes)
        return pa.array(out, pa.float64(), mask=~known.to_numpy(zero_copy_only=False))

    return run


def _indel_coded(a: list[str], b: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(left * len(b) + right, return_inverse=True)
    return np.array([indel_ratio(a[k // len(b)], b[k % len(b)]) for k in distinct.tolist()], np.float64)[back]


# called nondeterministic, else a filter on what is derived from a score holds a copy of the call for each time the score is read
_jaro_winkler = F.arrow_udf(_by_pair(jaro_winkler_coded), DoubleType()).asNondeterministic()
_indel_ratio = F.arrow_udf(_by_pair(_indel_coded), DoubleType())


def jaro_winkler_col(left: Column, right: Column) -> Column:
    return _jaro_winkler(left, right)


def indel_ratio_col(left: Column, right: Column) -> Column:
    return _indel_ratio(left, right)
