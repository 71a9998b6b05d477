"""N-gram Jaccard join by a token-group matrix.

A document is the set of its word shingles. Two documents link when 100 * |A & B| >= percent * |A | B|.
The join returns classes: every document with its set's size and the least doc_id reachable by links.

1. Documents with equal sets form a class; one of them, the representative, goes on.
2. *Tokens.* Sizes fall into bands so that linked sets lie in one band or in neighbours. For band pair
   beta, linked sets differ in at most H elements, so of H + 1 + e hash ranges at least 1 + e hold the
   same elements in both. A set's tokens are the digests of its ranges; empty ranges are left out while
   there are at most e of them, so a linked set shares ``need`` = 1 + e - (ranges left out) tokens at least.
   A set that shares fewer tokens with all others together has no partner and leaves; then tokens
   that only one set still has leave too. What merely shares a passage goes here.
3. *Groups.* A set's group is led by the least set with which any of its tokens is shared; groups that
   are large are cut into chunks of bounded size.
4. *Matrix.* For tokens that occur in several groups, the table (token, group) is each group's token
   union. A query's overlap with a group's union bounds how many tokens it can share with any member;
   groups below ``need`` cannot hold a partner.
5. Only qualifying groups, and each set's own, are opened: full sets are compared with an inverted index
   and exact intersections. A star of links per local component leaves each group, never all pairs.
6. Components of the links, in the distributed graph.

No pair is lost and none is capped: the bounds of 2 and 4 hold for every linked pair, and 5 is exact (up
to equal 64-bit hashes of different shingles).

Defined results: null or empty texts and texts without words have an empty set, link with nothing and
are their own component; a text of fewer words than ``width`` is one shingle; copies link; rows of one doc_id
with different texts are documents of their own, each in the component of its text; a null doc_id takes the
component of its class; repeated rows get a row each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import connected_components
from .common import documents, lean, materialize, release, slices, text_hash
from .shingles import mix, shingle_sets

RECORD = np.dtype([("token", "<u4"), ("node", "<i8"), ("beta", "u1"), ("need", "u1")])
TOKENS_PER_BUCKET = 1_000_000
#: A token in more sets of one slice than this is settled there; one set stands for them in the token's bucket.
HOT_IN_SLICE = 64
#: Shingles of a chunk of a group, and of the queries that one task compares with it.
SHINGLES_PER_CHUNK, SHINGLES_PER_LANE = 500_000, 1_000_000
HITS_AT_ONCE = 250_000
#: Bytes of a group's texts from which its memory is given back at once.
RELEASE_OVER = 1 << 20


class Bands:
    """Size bands and, for each pair of neighbouring bands, the ranges and the spare matches."""

    def __init__(self, percent: int, most: int = 1 << 40) -> None:
        self.percent, low = percent, [1]
        while low[-1] < most:
            low.append(100 * low[-1] // percent + 1)
        self.low = np.array(low, np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, beta: int) -> int:
        """The most elements in which linked sets of bands beta and beta, or beta and beta + 1, differ."""
        high = int(self.low[beta + 1]) - 1
        return (100 - self.percent) * (high + 100 * high // self.percent) // (100 + self.percent)

    def spare(self, beta: int) -> int:
        return max(1, self.differ(beta) // 6)


def set_identity(own: np.ndarray) -> bytes:
    """128 bits that depend on the elements of a set alone."""
    return np.array([mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], "<u8").tobytes()


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a set: sets with the same least element differ in the low half only."""
    high = int(mix(own[:1])[0]) >> 32
    return (high << 32 | int(mix(own).sum(dtype=np.uint64)) >> 32) - (1 << 63)


def set_tokens(own: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (64 bits) of a sorted set, their band pair, and the matches that a partner needs."""
    band = bands.of(len(own))
    running = np.concatenate([[np.uint64(0)], np.cumsum(mix(own + np.uint64(0x1F123BB5)), dtype=np.uint64)])
    found, betas, needs = [], [], []
    for beta in (band, band - 1):
        if beta < 0 or not bands.differ(beta):
            continue  # sets that may not differ are equal: one class
        spare = bands.spare(beta)
        ranges = bands.differ(beta) + 1 + spare
        edge = np.searchsorted(own, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) << np.uint64(32))
        edge = np.concatenate([[0], edge, [len(own)]])
        digest = running[edge[1:]] - running[edge[:-1]]
        filled = np.diff(edge) > 0
        empty = ranges - int(filled.sum())
        use = filled if empty <= spare else np.ones(ranges, bool)
        at = np.flatnonzero(use)
        found.append(mix(digest[at] ^ mix((at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(beta + 1))))
        betas.append(np.full(len(at), beta, np.uint8))
        needs.append(np.full(len(at), min(255, max(1, 1 + spare - empty)), np.uint8))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    return np.concatenate(found), np.concatenate(betas), np.concatenate(needs)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, identity, node of every row; the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(part.column(2), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_identity(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "identity", "node"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, identity binary, node long")


def packed_tokens(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """bucket, records: the tokens of all sets, dealt by token; tokens that are hot within a slice stay with it (bucket < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for part in slices(batch, 0):
                found, seen = [], set()
                for own in shingle_sets(part.column(0), width):
                    if not len(own) or (node := node_of(own)) in seen:
                        continue
                    seen.add(node)
                    token, beta, need = set_tokens(own, bands)
                    record = np.empty(len(token), RECORD)
                    record["token"], record["node"], record["beta"], record["need"] = token & np.uint64(0xFFFFFFFF), node, beta, need
                    found.append((token, record))
                if not found:
                    continue
                token, record = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                by = np.argsort(token)
                token, record = token[by], record[by]
                bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                first = np.concatenate([[True], token[1:] != token[:-1]])
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(token)))
                hot = np.repeat(size > HOT_IN_SLICE, size)
                rows: list[tuple[int, bytes]] = []
                if hot.any():
                    # the bucket's number goes with the records, in front
                    for b in np.unique(bucket[hot]).tolist():
                        rows.append((-1 - b, record[hot & (bucket == b)].tobytes()))
                    least = np.minimum.reduceat(record["node"], begin)
                    record["node"][begin[size > HOT_IN_SLICE]] = least[size > HOT_IN_SLICE]
                stay = ~hot | first
                bucket, record = bucket[stay], record[stay]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                rows += [(b, record[cuts[b] : cuts[b + 1]].tobytes()) for b in np.unique(bucket).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "records"])

    return docs.select("text").mapInArrow(lean(run), "bucket int, records binary")


SHARED = "token long, node long, beta int, need int"
#: Rounds in which sets with too few shared tokens leave.
PRUNINGS = 2


def _shared(bucket: int, raw: list[bytes], settled: bool) -> pa.RecordBatch:
    """The tokens among the records that two or more sets have."""
    record = np.frombuffer(b"".join(raw), RECORD)
    by = np.lexsort((record["node"], record["token"]))
    record = record[by]
    same = np.concatenate([[False], record["token"][1:] == record["token"][:-1]])
    fresh = ~(same & np.concatenate([[False], record["node"][1:] == record["node"][:-1]]))
    record, same = record[fresh], same[fresh]
    begin = np.flatnonzero(~same)
    size = np.diff(np.append(begin, len(record)))
    keep = np.repeat((size > 1) | settled, size)
    record = record[keep]
    token = record["token"].astype(np.int64) | np.int64(bucket) << 32
    columns = [pa.array(token), pa.array(record["node"].astype(np.int64)), pa.array(record["beta"].astype(np.int32)), pa.array(record["need"].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["token", "node", "beta", "need"])


def shared_tokens(packed: DataFrame) -> DataFrame:
    """token, node, beta, need for tokens of two or more sets."""

    def gather(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = pa.Table.from_batches([_shared(bucket, table.column("records").to_pylist(), False)])
        release()
        return out

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _shared(-1 - bucket, [raw], True)

    dealt = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(gather, SHARED)
    return dealt.union(packed.where("bucket < 0").mapInArrow(lean(settle), SHARED))


def prune(shared: DataFrame) -> DataFrame:
    """The rows of sets that share as many tokens as a partner needs, for tokens that several such sets have; with the
    least of these as leader."""
    shared = shared.select("token", "node", "beta", "need")
    enough = shared.groupBy("node", "beta").agg(F.count(F.lit(1)).alias("tokens"), F.max("need").alias("least")).where("tokens >= least")
    kept = shared.join(enough.select("node", "beta"), ["node", "beta"], "left_semi")
    several = kept.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    return kept.join(several.select("token", "leader"), "token").select("token", "node", "beta", "need", "leader")


def open_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b (nodes) within (grp, lane) of ``rows`` (grp, lane, query, node, text): members are compared with
    each other in lane 0, queries with members in their lane. Rows whose text is another set than ``node`` are left out:
    they have the same doc_id only."""

    def run(table: pa.Table) -> pa.Table:
        out = compared(table)
        if table.nbytes > RELEASE_OVER:
            release()
        return out

    def compared(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").combine_chunks(), width)
        ids = table.column("node").to_pylist()
        is_query = table.column("query").to_pylist()
        seen: set[tuple[bool, int]] = set()
        members, queries = [], []
        for i, (node, asks) in enumerate(zip(ids, is_query, strict=True)):
            if (asks, node) in seen or not len(sets[i]) or node_of(sets[i]) != node:
                continue
            seen.add((asks, node))
            (queries if asks else members).append(i)
        parent = list(range(len(members)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        size = np.array([len(sets[i]) for i in members], np.int64)
        flat = np.concatenate([sets[i] for i in members]) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), size)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        token, begin = np.unique(flat, return_index=True)
        stop = np.append(begin[1:], len(flat))
        out: set[tuple[int, int]] = set()

        def compare(asking: list[int], own: bool) -> None:
            """Links of the sets ``asking``; of members, only those with later members."""
            n = np.array([len(sets[i]) for i in asking], np.int64)
            words = np.concatenate([sets[i] for i in asking])
            who = np.repeat(np.arange(len(asking)), n)
            at = np.minimum(np.searchsorted(token, words), len(token) - 1)
            hit = token[at] == words
            at, who = at[hit], who[hit]
            count = stop[at] - begin[at]
            turn = np.repeat(begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            both = np.bincount(np.repeat(who, count) * len(members) + owner[turn], minlength=len(asking) * len(members)).reshape(len(asking), -1)
            linked = 100 * both >= percent * (n[:, None] + size[None] - both)
            linked &= both > 0
            for q, m in zip(*np.nonzero(linked), strict=True):
                if own:
                    a, b = root(base + int(q)), root(int(m))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                else:
                    out.add((ids[asking[q]], ids[members[root(int(m))]]))

        def in_turn(asking: list[int], own: bool) -> None:
            nonlocal base
            if not len(token):
                return
            lengths = stop - begin
            base, held, hits = 0, [], 0
            for k, i in enumerate(asking):
                at = np.minimum(np.searchsorted(token, sets[i]), len(token) - 1)
                cost = int(lengths[at].sum()) + len(members)
                if held and hits + cost > HITS_AT_ONCE:
                    compare(held, own)
                    base, held, hits = k, [], 0
                held.append(i)
                hits += cost
            if held:
                compare(held, own)

        base = 0
        in_turn(members, True)
        if table.column("lane")[0].as_py() == 0:
            out |= {(ids[members[i]], ids[members[root(i)]]) for i in range(len(members)) if root(i) != i}
        in_turn(queries, False)
        pairs = [p for p in out if p[0] != p[1]]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return rows.groupBy("grp", "lane").applyInArrow(run, "a long, b long")


def _id_filter(ids: DataFrame, column: str, rows: int) -> tuple[np.ndarray, int]:
    """A Bloom filter (one hash) of a long column: 16 bits a row, 8 MB at most whatever the input."""
    bits = 1 << min(26, max(16, (16 * max(1, rows)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    run = lean(run)
    total = np.zeros(bits // 8, np.uint8)
    for r in ids.select(column).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    return total, bits


def texts_of(docs: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """doc_id, text of the rows whose doc_id may be in the filter."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = mix(ids.view(np.uint64)) % np.uint64(bits)
            found = held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(found.astype(bool)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, text string")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash of every row of ``docs`` (doc_id, text)."""
    found = materialize(profiles(docs, width), "join-profiles")
    classes = materialize(found.where("n_shingles > 0 and doc_id is not null").groupBy("identity").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"), F.first("n_shingles").alias("n")), "join-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, min(1 << 20, total // 2 // TOKENS_PER_BUCKET))
    shared = materialize(shared_tokens(packed_tokens(docs, width, percent, buckets)), "join-tokens")
    for _ in range(PRUNINGS):
        shared = materialize(prune(shared), "join-tokens")
    # groups, in chunks of bounded size
    led = shared.groupBy("node").agg(F.min("leader").alias("leader"))
    members = materialize(led.join(classes, "node"), "join-members")
    chunks = members.groupBy("leader").agg(F.ceil(F.sum("n") / SHINGLES_PER_CHUNK).cast("int").alias("chunks"))
    grouped = materialize(members.join(chunks, "leader").select("node", "doc_id", "n", F.xxhash64("leader", F.pmod(F.hash("node"), "chunks")).alias("grp")), "join-groups")
    # the matrix of tokens that several groups have, and queries by their overlap with each group's union
    placed = shared.select("token", "node", "beta", "need").join(grouped.select("node", "grp"), "node")
    spread = materialize(placed.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("token"), "join-spread")
    across = materialize(placed.join(spread, "token").distinct(), "join-across")
    matrix = across.select("token", F.col("grp").alias("other")).distinct()
    overlap = across.join(matrix, "token").where("grp <> other").groupBy("node", "other", "beta").agg(F.count(F.lit(1)).alias("overlap"), F.max("need").alias("need"))
    visits = overlap.where("overlap >= need").select("node", F.col("other").alias("grp")).distinct()
    visits = materialize(visits.join(grouped.select("node", "doc_id", "n"), "node").select("node", "doc_id", "n", "grp"), "join-visits")
    # open the groups that have two sets or a query; many queries are dealt to lanes, each with the members
    queries = visits.groupBy("grp").agg(F.ceil(F.sum("n") / SHINGLES_PER_LANE).cast("int").alias("lanes"))
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    opened = sizes.join(queries, "grp", "left").select("grp", "size", F.coalesce("lanes", F.lit(1)).alias("lanes"), F.col("lanes").isNotNull().alias("asked")).where("size > 1 or asked")
    opened = materialize(opened, "join-opened")
    own = grouped.join(opened, "grp").select("node", "doc_id", "grp", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(False).alias("query"))
    asking = visits.join(opened, "grp").select("node", "doc_id", "grp", F.pmod(F.hash("node"), "lanes").alias("lane"), F.lit(True).alias("query"))
    work = materialize(own.unionByName(asking), "join-work")
    wanted, bits = _id_filter(work, "doc_id", work.count())
    texts = texts_of(docs, wanted, bits)
    if found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():
        # repeated rows would meet each of their group's lanes as often as they are repeated
        texts = texts.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text")).select("doc_id", "text")
    links = open_groups(work.join(texts, "doc_id").select("grp", "lane", "query", "node", "text"), width, percent)
    parts = materialize(connected_components(materialize(links, "join-links")), "join-components")
    linked = classes.join(parts, "node").select("identity", "doc_id", "component")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = linked.join(least, "component").select("identity", "least")
    named = classes.join(linked, "identity", "left").select("identity", F.coalesce("least", "doc_id").alias("component_id"))
    return found.join(named, "identity", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def op6_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_set_join": op6_set_join}
