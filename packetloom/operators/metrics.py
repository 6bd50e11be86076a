"""Scores of detectors: thresholds, ranks and the usual measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.prepare import quantiles, running_sums

#: Labels that mean ordinary traffic.
NORMAL = ("benign", "normal", "0", "false", "no", "non-anomaly", "non_anomaly")


def binary_label(column: str) -> F.Column:
    """0 for a label of ordinary traffic, 1 for any other, also unknown and null."""
    return F.when(F.lower(F.trim(F.col(column))).isin(list(NORMAL)), 0).otherwise(1)


def score_metrics(df: DataFrame, score: str, train: str, contamination: float = 0.05) -> DataFrame:
    """Mean, deviation and percentiles of the test scores, and the rate at or above the training threshold.

    Quantiles come from the counts of distinct scores in ranges, no task holds all of them.
    """
    counts = df.groupBy(F.col(train).alias("t__"), F.col(score).alias("s__")).agg(F.count("*").alias("n__"))
    threshold = quantiles(counts.where("t__"), (), "s__", "n__", [1 - contamination]).select(F.col("q")[0].alias("threshold"))
    q = quantiles(counts.where("not t__"), (), "s__", "n__", [0.5, 0.95, 0.99])
    test = df.where(~F.col(train)).join(F.broadcast(threshold))
    out = test.agg(F.count("*").alias("n"), F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"), F.first("threshold").alias("threshold"), F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("anomaly_rate"))
    return out.join(F.broadcast(q)).select("n", "score_mean", "score_std", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "threshold", "anomaly_rate")


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives of each distinct score: partial sums before any sort."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))


def known_label(column: str) -> F.Column:
    """Whether a label says anything; null counts as a label, as in the reference tables."""
    return ~F.coalesce(F.lower(F.trim(F.col(column))).isin(["", "unknown", "nan", "none", "<na>"]), F.lit(False))


def can_be_measured(df: DataFrame, column: str) -> bool:
    """Whether two rows or more have a known label and both classes are there."""
    known, classes = df.agg(F.sum(known_label(column).cast("long")), F.count_distinct(binary_label(column))).first()
    return (known or 0) >= 2 and classes == 2


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of pairs of both classes in the right order, ties half; null with one class."""
    ranked = running_sums(_by_score(df, score, label), ["s"], {"below": F.col("n") - F.col("p")})
    return ranked.agg((F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2)) / F.nullif(F.sum("p") * F.sum(F.col("n") - F.col("p")), F.lit(0))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over falling thresholds of precision times the gain in recall."""
    ranked = running_sums(_by_score(df, score, label).withColumn("m", -F.col("s")), ["m"], {"tp": F.col("p"), "all": F.col("n")})
    return ranked.agg((F.sum(F.col("p") * (F.col("tp") + F.col("p")) / (F.col("all") + F.col("n"))) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))
