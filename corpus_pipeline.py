"""From raw documents to packed training batches: five operators in a row.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's docs. All but the last return the columns of ``docs``, of the rows that stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import all_of, documents, materialize, small_batches, split_by_bitmap, text_hash, text_of, unused
from amalgam.llm.exact_dedup import exact_dedup
from amalgam.llm.line_crf import quality_of, train
from amalgam.llm.mixing import mix
from amalgam.llm.packing import pack
from amalgam.llm.set_join import jaccard_components

#: Near duplicates: shingles of five words, a Jaccard similarity of 0.8.
WIDTH, PERCENT = 5, 80


def without(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows that ``decided`` (doc_id, key, kept; a row per row of docs) turns down.

    A row is known by its doc_id and ``key``. Where several rows have both and some are turned down, the
    one with the least hash of all columns stands for those that are kept. Few rows are touched: the others
    pass a bitmap of the doc_ids concerned and take no shuffle.
    """
    fate = decided.groupBy("doc_id", "key").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("rows"))
    some = materialize(fate.where("stay < rows"), "pipeline-turned-down")
    doc_id = F.col("doc_id").cast("long")
    sure, maybe = split_by_bitmap(docs, doc_id, some, F.col("doc_id"), some.count())
    own, own_key, stay, rank = unused(docs, "__id", "__key", "__stay", "__rank")
    marks = some.select(F.col("doc_id").alias(own), F.col("key").alias(own_key), F.col("stay").alias(stay))
    met = maybe.join(marks, doc_id.eqNullSafe(F.col(own)) & (key == F.col(own_key)), "left")
    open_, settled = met.where(F.col(stay) > 0), met.where(F.col(stay).isNull())
    every = F.struct(*all_of(docs))
    one = open_.groupBy(own, own_key).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias(rank))
    twins = one.select(*[F.col(rank)[c].alias(c) for c in docs.columns])
    return sure.union(settled.select(all_of(docs))).union(twins)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good: a score of 0.5 or more.

    Null and empty texts are one empty line and scored as such; long texts are scored whole; ties at 0.5
    stay; repeated rows are scored each, alike; null doc_ids are scored but never trained on; an empty
    table stays empty; without a usable label every document stays. Other columns pass through, also
    one that is named like the score's.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    (score,) = unused(docs, "__quality")
    return quality_of(docs, train(docs, labels), score).where(F.col(score) >= 0.5).drop(score)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id.

    A null text is the empty text; null doc_ids are the smallest; of repeated rows (doc_id and text) one
    stays, with the least hash of all its columns; long texts are compared whole, by SHA-256; an empty
    table stays empty; other columns pass through, whatever their names.
    """
    found = exact_dedup(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return without(docs, found, F.sha2(text_of().cast("binary"), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the least doc_id (then the least hash of its text).

    Rows are told apart by doc_id and text, so another text of the same doc_id stays. Texts without words
    are near copies of nothing; null doc_ids come last among near copies, and near copies without any
    doc_id stay; of repeated rows one stays; long texts are compared whole; an empty table stays empty;
    other columns pass through, whatever their names.
    """
    found = materialize(jaccard_components(docs, WIDTH, PERCENT), "pipeline-near")
    linked = found.where("n_shingles > 0 and component_id is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = linked.groupBy("component_id").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("members")).where("members > 1")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    placed = linked.join(best, "component_id").select("doc_id", F.col("text_hash").alias("key"), is_best.alias("is_best"))
    fate = placed.groupBy("doc_id", "key", "is_best").agg(F.count(F.lit(1)).alias("rows"))
    # one of the rows that are alike stays
    decided = fate.select("doc_id", "key", F.explode(F.when(F.col("is_best") & (F.col("rows") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array("is_best"))).alias("kept"))
    return without(docs, decided, text_hash())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a part of it counting from its half on.

    Rows with equal doc_id, source and text share what the mix takes of them; null texts have size 0 and,
    as all documents without words, stay once; a null source is a source of its own; long texts count
    whole; ties are broken by seeded hashes; an empty table stays empty; other columns pass through,
    whatever their names.
    """
    own, at, key, copies, copy = unused(docs, "__id", "__source", "__key", "__copies", "__copy")
    taken = mix(docs).groupBy(F.col("doc_id").alias(own), F.col("source").alias(at), F.col("text_hash").alias(key)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("total"))
    times = F.when(F.col("total") > 0, F.floor(F.col("taken") / F.col("total") + 0.5)).otherwise(1).cast("int")
    chosen = materialize(taken.select(own, at, key, times.alias(copies)).where(F.col(copies) > 0), "pipeline-copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(at)) & (text_hash() == F.col(key))
    mixed = docs.join(chosen, same)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(all_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training batches.

    Null and empty texts have length 0; a text longer than a batch's budget is a batch of its own; ties in
    length share a bucket; repeated rows take a place each; null doc_ids come first in their bucket's
    chunks; an empty table gives an empty result; other columns are not read.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the classifier and the seeded mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
