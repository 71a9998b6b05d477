import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import exact_dedup as D
from amalgam.llm import line_crf as C
from amalgam.llm import mixing as M
from amalgam.llm import packing as P
from amalgam.llm import pseudo_lm as L
from amalgam.llm import set_join as J
from amalgam.llm import sharding as S
from amalgam.llm import warc as W
from amalgam.llm.common import gapless_index, materialize, split_by_bitmap, unused

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, a repeated row."""
    rng, out = random.Random(11), []
    base = [prose(rng.randint(20, 120), rng) for _ in range(25)]
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.2:
            words = words + base[0].split()
        out.append((i, " ".join(words), "en", rng.choice(["a", "b", "b", "b", "c", None]), 1))
    out += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \t\n", "en", "a", 3), (203, "one", "en", "a", 3), (204, "ONE", "en", "b", 3), (205, prose(30_000, rng), "de", "c", 9)]
    out += [out[3], out[3], (None, out[4][1], "en", "a", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"score": F.lit("x"), "digest": F.lit(1), "shard": F.lit(2), "node": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_exact_dedup(docs, empty, rows):
    got = D.exact_dedup(docs, counters=4).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    by_sha = {}
    for g in got:
        by_sha.setdefault(g.text_sha256, []).append(g)
    assert len(got) == len(rows) and len(by_sha) == len(groups)
    for text, ids in groups.items():
        own = by_sha[__import__("hashlib").sha256(text.encode()).hexdigest()]
        assert {g.group_size for g in own} == {len(ids)} and sum(g.kept for g in own) == 1
        best = max((i for i in ids if i is not None), default=None)
        assert {g.keep_id for g in own} == {best} and next(g for g in own if g.kept).doc_id == best
    assert D.exact_dedup(empty).count() == 0


def test_misra_gries_keeps_frequent():
    counts, items = {}, [b"x"] * 30 + [str(i).encode() for i in range(60)]
    random.Random(1).shuffle(items)
    for i in items:
        counts = D.merge_summary(counts, {i: 1}, 3)
    assert b"x" in counts and len(counts) <= 3


@pytest.mark.parametrize(("votes", "seats"), [([5, 2, 1], 17), ([1, 1, 1], 2), ([100, 0, 3], 50), ([7.5, 7.5], 1), ([10], 0)])
def test_sainte_lague(votes, seats):
    want = [0] * len(votes)
    for _ in range(seats):
        i = max((k for k in range(len(votes)) if votes[k]), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))
        want[i] += 1
    assert M.sainte_lague(votes, seats) == want
    assert M.sainte_lague([5, 1], 10, [3, 4]) == [3, 4]


def test_targets():
    t = M.capped_targets([100, 100, 10], [5, 2, 1])
    assert sum(t) == pytest.approx(210) and t[2] <= 30 and t[0] == pytest.approx(210 * 5 / 8)
    assert M.capped_targets([10, 1000], [5, 1]) == [30, 980] and M.capped_targets([], []) == []


def brute_taken(rows, block, shard_of, order_of, begin_of, quotas):
    """Words taken of each row: its source's and shard's documents end to end, a run of blocks, again from the front."""
    out = {}
    for (no, shard), quota in quotas.items():
        own = sorted((r for r in rows if shard_of[r] == (no, shard)), key=lambda r: order_of[r])
        line = [r for r in own for _ in range(r[1])]
        take = min(quota * block, M.REPEATS * len(line))
        for k in range(take):
            r = line[(begin_of[no, shard] * block + k) % len(line)]
            out[r] = out.get(r, 0) + 1
    return out


@pytest.mark.parametrize("on_driver", [10_000, 0])
def test_mixing(docs, empty, rows, on_driver, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_SHARD", 20)
    monkeypatch.setattr(M, "FAN", 3)  # a tree of two levels
    got = M.mix(docs, on_driver=on_driver).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.taken)
    if on_driver:
        again = M.mix(docs.repartition(3)).collect()
        assert sorted(map(str, sorted(got, key=key))) == sorted(map(str, sorted(again, key=key)))
        assert M.mix(empty).count() == 0
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    want = M.capped_targets(sizes, [M.WEIGHTS[i % 3] for i in range(len(names))])
    for s, z, t in zip(names, sizes, want, strict=True):
        if z:
            own = [r for r in got if r.source == s]
            assert own and all(r.target == pytest.approx(t) and r.source_size == z for r in own)
            assert sum(r.taken for r in own) == pytest.approx(t, abs=20)
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows)


def test_mixing_takes_runs_of_blocks(spark):
    rng = random.Random(9)
    rows = [(i, "a " * rng.randint(0, 9), rng.choice("xxxxy")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in M.mix(df, blocks=40).collect()}
    hashed = {r.doc_id: r for r in df.select("doc_id", F.xxhash64(F.lit(18), "doc_id", F.xxhash64("text")).alias("turn")).collect()}
    n, total = [[size(t) for _, t, s in rows if s == name] for name in "xy"], sum(size(t) for _, t, _ in rows)
    block = max(1, total // max(40, 256 * 2))
    targets = M.capped_targets([sum(x) for x in n], [5, 2])
    quotas = M.sainte_lague(targets, round(total / block), [-(-3 * sum(x) // block) for x in n])
    begin = {(r.no, 0): r.b for r in spark.createDataFrame([(k, 0, max(1, -(-sum(x) // block))) for k, x in enumerate(n)], "no long, shard long, starts long").select("no", F.expr("pmod(xxhash64(19, no, shard), starts)").alias("b")).collect()}
    small = [(i, size(t), s) for i, t, s in rows]
    want = brute_taken(small, block, {r: ("xy".index(r[2]), 0) for r in small}, {r: (hashed[r[0]].turn, r[0]) for r in small}, begin, {(k, 0): q for k, q in enumerate(quotas)})
    assert got == {r[0]: want.get(r, 0) for r in small}


def test_many_sources_alike_on_driver_and_executors(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 5, 5, rng.randint(1, 4000)]) for _ in range(300)]
    weights = [M.WEIGHTS[k % 3] for k in range(300)]
    sources = materialize(spark.createDataFrame([(k, float(w), z) for k, (w, z) in enumerate(zip(weights, sizes))], "no long, weight double, source_size long"), "t")
    for block in (1, 7):
        here, there = ({r.no: r for r in M.source_quotas(sources, 300, sum(sizes), block, 3, n).collect()} for n in (300, 0))
        assert {k: r.quota for k, r in here.items()} == {k: r.quota for k, r in there.items()}
        assert [here[k].target for k in range(300)] == pytest.approx([there[k].target for k in range(300)])


def brute_best_fit(sizes, capacity):
    """Bins by best fit over all items, one by one, largest first; the free capacity of each bin in the end."""
    free, place = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(f, k) for k, f in enumerate(free) if f >= sizes[i]]
        k = min(fit)[1] if fit else len(free)
        if not fit:
            free.append(capacity)
        free[k] -= sizes[i]
        place.setdefault(sizes[i], []).append(k)
    return free, place


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(200)]
    counts = {z: sizes.count(z) for z in set(sizes)}
    runs, bins = S.best_fit_decreasing(list(counts), list(counts.values()), 50)
    free, want = brute_best_fit(sizes, 50)
    place = {}
    for z, first, stop, b in runs:
        assert len(place.setdefault(z, [])) == first
        place[z] += [b] * (stop - first)
    assert place == want and bins == len(free)
    assert S.best_fit_decreasing([60], [1], 50, 3) is None and S.balanced_bins([], [], 4) == []
    assert S.best_fit_decreasing([60, 50], [2, 1], 50) == ([(60, 0, 1, 0), (60, 1, 2, 1), (50, 0, 1, 2)], 3)
    load = [0] * 5
    for z, first, stop, b in S.balanced_bins(list(counts), list(counts.values()), 5):
        load[b] += z * (stop - first)
    assert sum(load) == sum(sizes) and max(load) - sum(sizes) / 5 < 20


def test_sharding(docs, empty, rows):
    got = S.shard(docs, 4).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(zlib.crc32((r[1] or "").encode()), (r[1] or ""))
    for crc in {r.text_crc32 for r in got}:
        assert len({r.shard for r in got if r.text_crc32 == crc}) == 1
    load = [0] * 4
    for r in got:
        load[r.shard] += r.size
    assert max(load) <= max(sum(load) / 4 * 1.01, 1.01 * max(sum(r.size for r in got if r.text_crc32 == c) for c in texts))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.size == len(texts[r.text_crc32].encode()) + 1 and r.grown_shard is None for r in got)
    assert S.shard(empty).count() == 0


def test_sharding_balances_many_groups(spark):
    """More groups than the crates that small groups were once put into."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), (F.col("id") * 7 % 90).cast("int"))).alias("text"))
    got = S.shard(df, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    load = [r.b for r in got]
    assert len(load) == 16 and max(load) - min(load) <= 200
    few = S.shard(df, capacity=50_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in few) <= 50_000 and len(few) == -(-sum(load) // 50_000)


def brute_padding(lengths, counts, k):
    """Least padding over all choices of bounds."""
    from itertools import combinations

    n, best = len(lengths), None
    for cut in combinations(range(n - 1), min(k, n) - 1):
        bounds = [*cut, n - 1]
        pad = sum(c * (lengths[next(b for b in bounds if b >= i)] - x) for i, (x, c) in enumerate(zip(lengths, counts)))
        best = pad if best is None else min(best, pad)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_optimal_buckets(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 200), rng.randint(1, 9)))
    counts = [rng.randint(1, 30) for _ in lengths]
    for k in (1, 2, 3, 4):
        bounds = P.optimal_buckets(np.array(lengths), np.array(counts), k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        pad = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        assert pad == brute_padding(lengths, counts, k)


def test_packing(docs, empty, rows):
    got = P.pack(docs, buckets=4, budget=2_000).collect()
    assert sorted(r.n_tokens for r in got) == sorted(size(r[1]) for r in rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bucket_len <= 2_000
    assert P.pack(empty).count() == 0


def test_packing_beside_a_very_long_text(spark):
    lengths = [1, 1, 2, 3, 3, 5, 8, 9, 600_001]
    df = spark.createDataFrame(list(enumerate("a " * n for n in lengths)), "doc_id long, text string")
    got = P.pack(df, buckets=4).collect()
    exact = sorted(set(lengths))
    assert sum(r.bucket_len - r.n_tokens for r in got) == brute_padding(exact, [lengths.count(x) for x in exact], 4)
    assert sorted(r.n_tokens for r in got) == lengths


def test_gapless(spark):
    df = materialize(spark.range(5000).select((F.col("id") % 3).alias("k"), "id"), "t")
    got = gapless_index(df, ["k"], ["id"], "n", 500_000).groupBy("k").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.count("n")).collect()
    assert all(r[1] == 0 and r[2] == r[3] - 1 == r[4] - 1 for r in got)


def brute_components(rows, width, percent):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        if doc is not None:
            sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_set_join(docs, rows, width, percent, monkeypatch):
    monkeypatch.setattr(J, "SHINGLES_PER_CHUNK", 300)  # many groups
    monkeypatch.setattr(J, "SHINGLES_PER_LANE", 300)
    monkeypatch.setattr(J, "HOT_IN_SLICE", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width, percent).where("doc_id is not null").collect()}
    assert got == brute_components(rows, width, percent)


def test_set_join_edges(docs, empty):
    nulls = J.jaccard_components(docs.where("doc_id is null or doc_id = 4")).collect()
    assert {(r.doc_id, r.component_id) for r in nulls if r.n_shingles} == {(4, 4), (None, 4)} and len(nulls) == 3
    assert J.jaccard_components(empty).count() == 0


def test_set_join_tells_texts_of_one_doc_id_apart(spark, monkeypatch):
    rng = random.Random(2)
    a, b = prose(40, rng), prose(40, rng)
    near = " ".join([*a.split()[:-1], "zzz"])
    df = spark.createDataFrame([(5, a), (5, b), (5, b), (3, near), (2, b), (9, near)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == [(2, 2), (3, 3), (5, 2), (5, 2), (5, 3), (9, 3)]


def test_split_by_bitmap(spark):
    df = spark.range(3000).withColumn("__slot", F.lit(7))
    marked = spark.range(0, 3000, 100).withColumnRenamed("id", "k")
    sure, maybe = split_by_bitmap(df, F.col("id"), marked, F.col("k"), 30)
    assert sure.columns == df.columns and sure.count() + maybe.count() == 3000
    assert maybe.join(marked, F.col("id") == F.col("k")).count() == 30 and maybe.count() < 200
    assert unused(df, "id", "ID", "x") == ["_id", "_ID", "x"] or unused(df, "id", "ID", "x") == ["_id", "__ID", "x"]


def brute_marginals(score, transition):
    from itertools import product

    n, total, good = len(score), 0.0, np.zeros(len(score))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(score[i] * (y[i] - 0.5) for i in range(n)) + sum(transition[a][b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(0)
    per_doc, score, transition = np.array([1, 5, 3]), rng.normal(size=9), rng.normal(size=(2, 2))
    got, pair = C.forward_backward(score, per_doc, transition)
    want = np.concatenate([brute_marginals(score[a : a + n], transition) for a, n in zip((0, 1, 6), per_doc)])
    assert np.allclose(got, want) and np.allclose(pair.sum(axis=1), 1) and len(pair) == 6


def test_crf_learns(spark, docs, empty):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        lines = [" ".join(w.upper() + "!!" if bad else w for w in prose(12, rng).split()) + "." for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int"))
    model = C.train(df, labels, max_docs=100)
    got = C.score(df, model).join(df.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == C.is_held_out(r.doc_id) for r in got) and np.mean([r.predicted == r.quality for r in held]) > 0.95
    odd = C.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert C.score(empty, model).count() == 0
    untrained = C.train(empty, labels)
    assert {r.score for r in C.score(docs.limit(5), untrained).collect()} == {0.5}


def test_lm(spark, docs, empty):
    rng, rows = random.Random(5), []
    for i in range(150):  # every word is fixed by its neighbours
        k = rng.randrange(50)
        rows.append((i, " ".join(f"w{(k + j) % 50}" for j in range(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = L.build_vocabulary(df)
    plain = L.score(df, vocabulary, L.Network(vocabulary.tree)).agg(F.avg("mean_log_prob")).first()[0]
    model = L.train(df, vocabulary)
    learned = L.score(df, vocabulary, model).agg(F.avg("mean_log_prob")).first()[0]
    assert learned > plain + 1
    got = {r.doc_id: r for r in L.score(docs.where("doc_id >= 200"), vocabulary, model).collect()}
    assert got[200].n_tokens == 0 and got[200].log_prob == 0 and got[200].mean_log_prob is None and got[205].n_tokens == 30_000
    none = L.build_vocabulary(empty)
    assert L.score(empty, none, L.train(empty, none)).count() == 0
    assert L.score(df.limit(3), none, L.train(empty, none)).count() == 3


def some_network(counts, seed=1):
    rng, net = np.random.default_rng(seed), L.Network(L.Tree.over(np.array(counts)))
    net.weights += rng.normal(size=net.weights.shape).astype("f4") * 0.2
    windows = rng.integers(0, L.PAD + 1, (7, 4)).astype(np.int32)
    return net, windows, rng.integers(0, len(counts), 7)


@pytest.mark.parametrize("counts", [[5, 3, 2, 1, 1], [1, 1], [100, 1, 1, 50, 3, 3, 3, 9]])
def test_tree_is_huffmans_and_adds_up(counts):
    net, windows, _ = some_network(counts)
    tree, total = net.tree, sum(counts)
    assert (tree.length * counts).sum() == (brute_lengths_of(counts) * np.array(counts)).sum()
    whole = sum(np.exp(net.log_prob(windows, np.full(7, k))) for k in range(len(counts)))
    assert np.allclose(whole, 1)
    fresh = L.Network(tree)
    fresh.weights[: L.CONTEXT] = 0
    assert np.allclose([np.exp(fresh.log_prob(windows[:1], np.array([k])))[0] for k in range(len(counts))], np.array(counts) / total)


def brute_lengths_of(counts):
    import heapq

    heap = [(c, k, {k: 0}) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, i, {k: d + 1 for k, d in (x | y).items()}))
    return np.array([heap[0][2][k] for k in range(len(counts))])


def test_log_prob_by_brute_force():
    net, windows, leaves = some_network([5, 3, 2, 1, 1])
    for w, y, got in zip(windows, leaves, net.log_prob(windows, leaves), strict=True):
        h = np.tanh(sum(net.weights[k * (L.PAD + 1) + w[k], : L.HIDDEN].astype(float) for k in range(4)) + net.weights[L.CONTEXT, : L.HIDDEN])
        a, want = net.tree.begin[y], 0.0
        for node, second in zip(net.tree.node[a : a + net.tree.length[y]], net.tree.second[a : a + net.tree.length[y]]):
            z = h @ net.weights[L.CONTEXT + 1 + node, : L.HIDDEN] + net.weights[L.CONTEXT + 1 + node, L.HIDDEN]
            want += -np.log1p(np.exp(-z if second else z))
        assert got == pytest.approx(want, abs=1e-4)


def test_slopes_are_those_of_the_mean():
    net, windows, leaves = some_network([5, 3, 2, 1, 1, 4])
    rows, slope, times = net.slopes(windows, leaves)
    assert len(set(rows.tolist())) == len(rows) and times.sum() == 4 * 7 + 7 + net.tree.length[leaves].sum()
    for r in range(len(rows)):
        for c in (0, L.HIDDEN - 1, L.HIDDEN):
            was = net.weights[rows[r], c]
            ends = []
            for step in (1e-2, -1e-2):
                net.weights[rows[r], c] = was + step
                ends.append(-net.log_prob(windows, leaves).mean())
            net.weights[rows[r], c] = was
            assert slope[r, c] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=1e-4)


def test_lm_rare_words(spark):
    texts = ["a a a a b b b c c d", "c d e E f", "a c d", None, "", "a c d", "a c d a", "g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = [(t or "").lower().split() for t in texts]
    counts = {w: sum(d.count(w) for d in docs) for d in docs for w in d}
    vocabulary = L.build_vocabulary(df.where("doc_id < 7"), 2)  # g is not counted
    assert vocabulary.words == ["a", "c"] and vocabulary.left == sum(counts[w] for w in "bdef")
    net = L.Network(vocabulary.tree)
    places = [(k, i, w, d[i - 1] if i else None, d[i + 1] if i + 1 < len(d) else None) for k, d in enumerate(docs) for i, w in enumerate(d) if w not in "ac"]
    symbol = {w: i for w, i in zip("abcdefg", L.Vocabulary.look_up(vocabulary, L.pa.array(list("abcdefg"), L.pa.large_string()))[2])} | {None: 2}
    want = {}
    for k, (doc, text) in enumerate(zip(docs, texts, strict=True)):
        e = L.encode(L.pa.array([text]), vocabulary)
        total, again = float(net.log_prob(e.windows(), e.leaves).sum()), 0
        for _, _, w, l, r in (p for p in places if p[0] == k):
            same = sum(p[2] == w and symbol[p[3]] == symbol[l] and symbol[p[4]] == symbol[r] for p in places) - 1
            room = min(sum(symbol[p[3]] == symbol[l] for p in places), sum(symbol[p[4]] == symbol[r] for p in places)) - 1
            share = (counts[w] if w != "g" else 1) / vocabulary.left
            total += np.log((1 - L.MEMORY) * share + (L.MEMORY * same / room if room else 0))
            again += same > 0
        want[k] = (len(doc), total, again / len(doc) if doc else None)
    got = {r.doc_id: r for r in L.score(df, vocabulary, net).collect()}
    for k, (n, total, again) in want.items():
        assert got[k].n_tokens == n and got[k].log_prob == pytest.approx(total, abs=1e-4)
        assert got[k].seen_again == (None if again is None else pytest.approx(again))
    assert want[2][2] and want[0][2] is not None


def test_windows_of_some_words():
    vocabulary = L.Vocabulary(["a", "b"], L.Tree.over(np.array([3, 2, 1])), 1)
    e = L.encode(L.pa.array(["a b a c", None, "b", "c a b"]), vocabulary)
    for first in range(3):
        assert np.array_equal(e.windows(first, 3), e.windows()[first::3])
    assert e.windows()[0].tolist()[:2] == [L.PAD, L.PAD] and e.windows()[4].tolist() == [L.PAD] * 4


def test_lm_trains_on_every_word(spark):
    text = " ".join(["a b c d"] * 20_000)  # predicting every fourth word alone would teach one of the four
    df = spark.createDataFrame([(0, text)], "doc_id long, text string").coalesce(1)
    vocabulary = L.build_vocabulary(df)
    e = L.encode(L.pa.array([text]), vocabulary)
    each = L.train(df, vocabulary).log_prob(e.windows(), e.leaves)
    assert min(each[k::4].mean() for k in range(4)) > -0.5


def test_averages_by_row():
    group = L.pd.DataFrame({"chunk": [3] * 3, "task": [70, 64, 65], "part": [np.array(x, "<f4").tobytes() for x in ([1, 1, 5, 5], [2, 2, 5, 5], [9, 9, 5, 5])], "moved": [np.array(x, "<f4").tobytes() for x in ([1, 0], [3, 0], [0, 0])]})
    row = L.mean_rows(group).iloc[0]
    assert row["chunk"] == 3 and row["task"] == 1 and np.allclose(np.frombuffer(row["part"], "<f4"), [1.75, 1.75, 5, 5], atol=1e-4) and np.frombuffer(row["moved"], "<f4").tolist() == [4, 0]


def brute_revisits(rows):
    out = {}
    for r in rows:
        if r["kind"] != "revisit":
            continue
        full = [f for f in rows if f["kind"] == "response" and f["url"] == r["url"] and f["url"] is not None and f["ts"] < r["ts"]]
        if not full:
            out[r["record_id"]] = ("no earlier response", None)
            continue
        f = max(full, key=lambda f: (f["ts"], f["record_id"]))
        a, b = r["headers"], f["headers"]
        differs = a["etag"] != b["etag"] if "etag" in a and "etag" in b else "last-modified" in a and "last-modified" in b and a["last-modified"] != b["last-modified"]
        out[r["record_id"]] = ("validator differs", None) if differs else ("resolved", f["record_id"])
    return out


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(W, "chunks_for", lambda rows: 7)
    rng, rows = random.Random(9), []
    for i in range(300):
        kind = rng.choice(["response", "revisit"])
        headers = {k: str(rng.randrange(2)) for k in ("etag", "last-modified") if rng.random() < 0.6} | {"content-length": str(i), "x": str(i)}
        rows.append({"record_id": i, "ts": rng.randrange(200), "kind": kind, "url": rng.choice(["h/a", "h/a", "h/a", "h/b", f"h/{i}"]), "headers": headers, "digest": f"d{i}"})
    df = spark.createDataFrame(rows, "record_id long, ts long, kind string, url string, headers map<string,string>, digest string")
    got = {r.record_id: r for r in W.resolve_revisits(df.withColumn("node", F.lit(1))).where("kind = 'revisit'").collect()}
    want = brute_revisits(rows)
    assert {k: (r.outcome, r.source_id) for k, r in got.items()} == want
    for k, (outcome, source) in want.items():
        if outcome == "resolved":
            assert got[k].merged["content-length"] == rows[source]["headers"]["content-length"] and got[k].merged["x"] == str(k) and got[k].source_digest == f"d{source}"
    odd = spark.createDataFrame([(1, None, "response", "h/a", {}, "d"), (2, 5, "revisit", "h/a", {"etag": "1"}, None), (3, None, "revisit", None, None, None)], df.schema)
    assert {r.outcome for r in W.resolve_revisits(odd).where("kind = 'revisit'").collect()} == {"no earlier response"}
    assert W.resolve_revisits(df.limit(0)).count() == 0


def test_warc_headers(spark):
    rows = [
        (1, 1, "response", "h/a", {"ETag": "a", "etag": "b", "X": "1", "Content-Length": "9"}, "d1", "keep", "own"),
        (2, 2, "revisit", "h/a", None, None, "keep", "own"),
        (3, 3, "revisit", "h/a", {"ETAG": "b", "x": "2", "content-length": "0"}, None, "keep", "own"),
        (4, 4, "revisit", "h/a", {"Etag": "zzz"}, None, "keep", "own"),
    ]
    rows = [(*r[:4], None if r[4] is None else list(r[4]), None if r[4] is None else list(r[4].values()), *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "record_id long, ts long, kind string, url string, k array<string>, v array<string>, digest string, `__near` string, outcome string")
    df = df.withColumn("headers", F.map_from_arrays("k", "v")).drop("k", "v")
    got = {r.record_id: r for r in W.resolve_revisits(df).collect()}
    stored = {"etag": "b", "x": "1", "content-length": "9"}  # of fields that differ in case the last counts
    assert got[1].merged == stored and got[2].merged == stored and got[2].outcome == "resolved" and got[2].source_id == 1
    assert got[3].merged == stored | {"x": "2"} and got[4].outcome == "validator differs" and got[4].merged is None
    assert {r["__near"] for r in got.values()} == {"keep"} and set(got[1].asDict()) == {"record_id", "ts", "kind", "url", "headers", "digest", "__near", *W.RESULT}


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=1#top", "example.com/a?b=1"),
    ("https://example.com/a/", "example.com/a"),
    ("http://e.org/a?page=2&ref=x", "e.org/a?page=2"),
    ("http://e.org?ref=x", "e.org"),
])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(W.canonical_url(F.col("u"))).first()[0] == want
