import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_components, prose, size

from amalgam.llm.mixing import capped_targets


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with documents (shouting ones are bad, with copies and near copies) and labels."""
    rng, rows, labels = random.Random(21), [], []
    for i in range(220):
        text = "\n".join(prose(14, rng).capitalize() + "." for _ in range(rng.randint(2, 5)))
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", rng.choice("abbbc"), len(text)))
        if i % 2:
            labels.append((i, int(i % 5 != 0), 0))
        elif i % 10 == 0:
            labels.append((i, 0, 0))
    good = [r for r in rows if r[0] % 5]
    for k in range(20):
        rows.append((300 + k, good[k][1], "en", "c", 1))
        words = good[k + 30][1].split(" ")
        rows.append((400 + k, " ".join([words[0], "zzzz", *words[2:]]), None, None, None))
    rows.append((500, None, None, None, None))
    path = tmp_path_factory.mktemp("world")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_and_run(spark, world):
    path, rows = world
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept.append([tuple(r) for r in docs.collect()])
    scored, exact, near, mixed = kept
    clean = [r for r in rows if r[0] >= 300 or r[0] % 5]
    assert {r[0] for r in scored} >= {r[0] for r in clean if r[1]} and not {r[0] for r in scored} & {r[0] for r in rows[:220] if r[0] % 5 == 0}
    best = {}
    for r in scored:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())
    groups = brute_components(exact, pipeline.WIDTH, pipeline.PERCENT)
    assert sorted(r[0] for r in near) == sorted(d for d, (_, c) in groups.items() if c == d)
    assert set(mixed) <= set(near)
    names = sorted({r[3] for r in near}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in near if r[3] == s) for s in names]
    for s, t in zip(names, capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        assert sum(size(r[1]) for r in mixed if r[3] == s) == pytest.approx(t, abs=250)
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    whole = pipeline.run(spark, path).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, whole)) and len(packed) == len(mixed)
    assert sorted(r.n_tokens for r in packed) == sorted(size(r[1]) for r in mixed)


def test_empty(spark, world):
    path, _ = world
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns(spark, world, k):
    """Columns named like those that stages use pass through, with the rows."""
    path, rows = world
    names = ["__id", "__key", "__stay", "__rank", "__quality", "__source", "__copies", "__copy", "__slot", "__bits", "key", "score", "kept", "text_hash", "component_id", "stay", "rows", "a.b"]
    docs = spark.read.parquet(f"{path}/documents.parquet").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    name, stage = pipeline.STAGES[k]
    got = stage(spark, docs, path)
    assert got.columns == docs.columns
    plain = stage(spark, docs.select([c.split()[0] for c in SCHEMA.split(", ")]), path)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in plain.collect())
    assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_rows_of_one_doc_id(spark, world):
    path, _ = world
    rng = random.Random(8)
    a, b = prose(60, rng), prose(60, rng)
    near = " ".join([*a.split()[:-1], "zzz"])
    rows = [(1, a, "en", "s", 1), (7, near, "en", "s", 2), (7, b, "en", "s", 3), (8, near, "en", "s", 4), (None, near, "en", "s", 5), (None, None, None, None, 6), (9, "", "en", "s", 7), (1, a, "en", "s", 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = pipeline.near_dedup(spark, docs, path).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (7, b), (0, ""), (9, "")])  # another text of doc 7 stays, one of two rows that are alike
    exact = pipeline.dedup(spark, docs, path).collect()
    assert sorted((r.doc_id, r.text) for r in exact) == sorted([(1, a), (7, b), (8, near), (9, "")])
    assert sum(r.doc_id == 1 for r in exact) == 1
    mixed = pipeline.mixing(spark, docs, path).collect()
    assert {(r.doc_id, r.n_chars) for r in mixed} <= {(r[0], r[4]) for r in rows} and any(r.n_chars == 6 for r in mixed)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
