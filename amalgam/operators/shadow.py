"""Shadow classifiers beside the score: record-disjoint folds, best-F1 thresholds, area under precision and recall."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import connected_components
from ..storage import materialize
from .blocking import PAIR, Rules, finest
from .evaluate import confusion
from .labels import FLAGS, agreement_flags


def folds(pairs: DataFrame, n: int = 2) -> DataFrame:
    """Adds fold: pairs that share records, also through others, are in one fold."""
    parts = connected_components(pairs.select(*PAIR), *PAIR)
    return pairs.join(parts.select(F.col("node").alias(PAIR[0]), "component"), PAIR[0]).withColumn("fold", F.pmod(F.xxhash64("component"), F.lit(n)).cast("int")).drop("component")


def one_fold(records: DataFrame, rules: Rules, n: int = 2) -> bool:
    """Whether all pairs that the rules make are in one of the ``n`` folds, so that none has both others and its own.

    Records of a block are linked through the least of them, which joins what the block's pairs join; no pair is made.
    """
    links = []
    for columns in finest(columns for _, columns in rules):
        known = records.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).select("record_id", *columns)
        least = known.groupBy(*columns).agg(F.min("record_id").alias("least"))
        links.append(known.join(least, list(columns)).where("record_id <> least").select("record_id", "least"))
    parts = connected_components(reduce(DataFrame.unionByName, links), "record_id", "least")
    return parts.select(F.pmod(F.xxhash64("component"), F.lit(n))).distinct().count() < 2


def best_threshold(scored: DataFrame, score: str) -> float:
    """The distinct score with the best F1, the least of them on ties; 0.5 without scores.

    The driver holds the histogram of scores, which has no more rows than there are distinct vectors of features.
    """
    s = F.col(score).cast("double").alias("s")
    found = sorted(scored.where(F.col(score).isNotNull() & F.col("y").isNotNull()).groupBy(s).agg(F.count_if(F.col("y") > 0).alias("hits"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.s)
    if not found:
        return 0.5
    hits, n = (np.array([r[c] for r in found], np.int64) for c in ("hits", "n"))
    tp, chosen = (np.cumsum(x[::-1])[::-1] for x in (hits, n))
    return float(found[int(np.argmax(2 * tp / (chosen + hits.sum())))].s)


def with_agreements(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the agreement flags of each pair as 1 or 0; a missing side does not agree."""
    flags = agreement_flags(pairs, records).select(*PAIR, *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in FLAGS])
    return pairs.join(flags, PAIR)


def shadow_scores(pairs: DataFrame, truth: DataFrame, records: DataFrame, n_folds: int = 2) -> DataFrame:
    """model, fold, threshold, pr_auc, tp, fp, fn, tn of each classifier on each fold it has not seen."""
    data = folds(with_agreements(pairs, records), n_folds).join(truth.select(*PAIR, F.lit(1.0).alias("__t")), PAIR, "left").withColumn("y", F.coalesce("__t", F.lit(0.0))).drop("__t")
    gammas = [c for c in pairs.columns if c.startswith("gamma_")]
    data = data.withColumn("log_p", F.log10(F.greatest("match_probability", F.lit(1e-12))))
    data = VectorAssembler(inputCols=["log_p", "match_weight"], outputCol="two").transform(VectorAssembler(inputCols=["log_p", "match_weight", *gammas, *FLAGS], outputCol="levels").transform(data))
    data = materialize(data.select("y", "fold", "match_probability", "two", "levels"), "shadow")
    area = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s", metricName="areaUnderPR")
    rows = []
    for fold in range(n_folds):
        seen, held = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if seen.select("y").distinct().count() < 2 or held.select("y").distinct().count() < 2:
            continue
        fitted = {"threshold": None, "logistic": LogisticRegression(featuresCol="two", labelCol="y", regParam=0.01).fit(seen), "boosted": GBTClassifier(featuresCol="levels", labelCol="y", maxIter=10, maxDepth=3, seed=42).fit(seen)}
        for name, m in fitted.items():
            use = lambda d, m=m: d.withColumn("s", F.col("match_probability")) if m is None else m.transform(d).withColumn("s", vector_to_array("probability")[1])
            t = best_threshold(use(seen), "s")
            out = use(held)
            c = confusion(out, F.col("y") > 0, F.col("s"), [t]).first()
            rows.append((name, fold, t, round(area.evaluate(out), 4), c.tp, c.fp, c.fn, c.tn))
    return scores_table(pairs.sparkSession, rows)


def scores_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "model string, fold int, threshold double, pr_auc double, tp long, fp long, fn long, tn long")
