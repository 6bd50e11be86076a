"""Joins of reports with the feature catalogue, and the tables that summaries of runs are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from packetloom.functions.catalog import FEATURES, NEVER, available_features

#: Raw columns that scores may be shown with, and those that trace a record.
CONTEXT = ("timestamp", "packet_length", "payload_size", "payload_entropy", "inter_arrival_time", "jitter", "flow_duration", "packet_rate")
TRACE = ("capture", "timestamp", "protocol", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "transport", "label")
#: Columns that are never inputs, whatever their type.
HIDDEN = ("row_id", "label", "protocol", "flow_id", "timestamp", "capture", "src_port", "dst_port")


def catalogue(spark: SparkSession, protocols: list[str] | None = None) -> DataFrame:
    """The feature catalogue as a table of some hundred rows: name, display_name, category, cost, protocols, implemented."""
    rows = [(f.name, f.display_name, f.category, f.cost, list(f.protocols), f.name not in NEVER) for f in available_features(protocols)]
    return spark.createDataFrame(rows, "name string, display_name string, category string, cost string, protocols array<string>, implemented boolean")


def visible_columns(schema: StructType, protocols: list[str]) -> list[str]:
    """Numeric columns that are features of all the protocols and neither metadata nor ports."""
    shared = set.intersection(*[{f.name for f in available_features([p])} for p in protocols]) if protocols else set()
    return [f.name for f in schema.fields if isinstance(f.dataType, NumericType) and f.name in shared and f.name not in HIDDEN]


def record_columns(schema: StructType, protocol: str) -> list[str]:
    """Columns to show records of one protocol with: what traces them, then its features."""
    own = {f.name for f in available_features([protocol])}
    return [*(c for c in TRACE if c in schema.names), *(c for c in schema.names if c in own and c not in TRACE)]


def feature_reason(availability: str = "availability", spread: str = "spread_rank", correlation: str = "max_corr", outliers: str = "outlier_rate") -> Column:
    """Why a feature has its signal value, in words."""
    coverage = F.when(F.col(availability) >= 0.95, "coverage is high").when(F.col(availability) < 0.6, "coverage is limited")
    said = F.concat_ws("; ", coverage, F.when(F.col(spread) >= 0.75, "captures a wide operating range"), F.when(F.col(correlation) <= 0.65, "is not strongly redundant"), F.when(F.col(outliers) >= 0.05, "reacts to rare behaviour"))
    return F.when(said == "", "has a stable but lower-priority signal").otherwise(said)


def with_catalogue(table: DataFrame, spark: SparkSession, name: str = "name") -> DataFrame:
    """Left join of any table of features with the catalogue, which is broadcast (its size is fixed)."""
    return table.join(F.broadcast(catalogue(spark).withColumnRenamed("name", "name__")), F.col(name) == F.col("name__"), "left").drop("name__")


def evidence_report(evidence: DataFrame, spark: SparkSession) -> DataFrame:
    """Feature evidence with its catalogue entry and the reason."""
    return with_catalogue(evidence, spark).withColumn("reason", feature_reason())


def signal_by_category(report: DataFrame) -> DataFrame:
    return report.groupBy(F.coalesce("category", F.lit("uncatalogued")).alias("category")).agg(F.avg("signal_value").alias("mean_signal_value"), F.count("name").alias("features"))


def importance_report(importance: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("scope", "model")) -> DataFrame:
    """Importances with share, running share and what the evidence says of the feature.

    A run has a row per feature, some hundred, so a window over a run stays small.
    """
    part = Window.partitionBy(*keys)
    order = part.orderBy(F.desc("raw_importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    total = F.greatest(F.sum("raw_importance").over(part), F.lit(2.220446049250313e-16))
    out = importance.withColumn("importance_share", F.col("raw_importance") / total)
    out = out.withColumn("cumulative_importance", F.sum("importance_share").over(order))
    told = evidence.select(F.col("name").alias("feature"), "signal_value", *(["reason"] if "reason" in evidence.columns else []))
    return out.join(F.broadcast(told), "feature", "left")


def catalogue_quality(spark: SparkSession, quality: DataFrame, columns: list[str], protocols: list[str] | None = None) -> DataFrame:
    """Catalogue entries that a table has, with their quality; a row per protocol of the report."""
    return catalogue(spark, protocols).where(F.col("name").isin(list(columns))).join(quality.select("name", "protocol", "missing_ratio", "variance", "extraction_status"), "name", "left")


def category_counts(spark: SparkSession, columns: list[str], protocols: list[str] | None = None) -> DataFrame:
    """Catalogue features by category, and how many of them a table has."""
    return catalogue(spark, protocols).groupBy("category").agg(F.count("*").alias("features"), F.sum(F.col("name").isin(list(columns)).cast("long")).alias("present_in_run"), F.sum((F.col("cost") == "medium").cast("long")).alias("medium_cost"))


def score_context(scores: DataFrame, raw: DataFrame, protocol: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Scores with up to eight raw columns of their record that they do not have yet.

    row_id counts the records of the scope, all of them or those of one protocol.
    """
    extra = [c for c in CONTEXT if c in raw.columns and c not in scores.columns]
    if row_id not in scores.columns or not extra:
        return scores
    some = raw if protocol is None else raw.where(F.lower("protocol") == protocol)
    return scores.join(some.select(row_id, *extra), row_id, "left")


def resource_means(comparison: DataFrame) -> DataFrame:
    """Mean seconds to fit and mean growth of memory by model."""
    return comparison.groupBy("model").agg(F.avg("fit_seconds").alias("fit_seconds"), F.avg("process_memory_delta_mb").alias("process_memory_delta_mb"))


def difference(df: DataFrame, value: str, out: str, order: list[str], keys: list[str]) -> DataFrame:
    """A value less the one before it, as losses are shown by epoch."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row per number: percentiles, losses or correlations under their names."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def compact_number(number: Column) -> Column:
    """12345 as 12.3K, 2500000 as 2.5M; below a thousand with separators; null as unknown."""
    return F.when(number.isNull(), "unknown").when(number >= 1_000_000, F.concat(F.format_string("%.1f", number / 1_000_000), F.lit("M"))).when(number >= 1000, F.concat(F.format_string("%.1f", number / 1000), F.lit("K"))).otherwise(F.format_number(number, 0))


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def capture_tallies(packets: DataFrame, kept: str | None = None) -> DataFrame:
    """By capture: packets read, those of a supported protocol, retained and filtered rows.

    packets: all packets of the captures with `protocol`, null for unsupported ones.
    """
    keep = F.col("protocol").isNotNull() if kept is None else F.coalesce(F.col("protocol") == kept, F.lit(False))
    return packets.groupBy("capture").agg(F.max("packet_index").alias("packets_read"), F.count("protocol").alias("supported"), F.sum(keep.cast("long")).alias("retained_rows"), F.sum((F.col("protocol").isNotNull() & ~keep).cast("long")).alias("filtered_rows"))


def protocol_tallies(packets: DataFrame) -> DataFrame:
    """Packets by capture and supported protocol."""
    return packets.where("protocol is not null").groupBy("capture", "protocol").agg(F.count("*").alias("packets"))


FEATURE_NAMES = tuple(f.name for f in FEATURES)
