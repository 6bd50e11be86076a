"""Aggregations: counts, timelines, flow tables, histograms, quality and evidence reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from packetloom.functions.catalog import FEATURES, NEVER
from packetloom.functions.storage import checkpointed
from packetloom.functions.text import micros, percent_rank
from packetloom.operators.prepare import quantiles
from packetloom.operators.reports import catalogue


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent combinations; ties by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns).limit(k)


def flow_rollup(df: DataFrame, flow: str = "flow_id", ts: str = "timestamp", length: str = "packet_length") -> DataFrame:
    """Records, bytes, mean length, first and last time and duration by flow; a null flow is one."""
    out = df.groupBy(flow).agg(F.count("*").alias("records"), F.sum(length).alias("total_bytes"), F.avg(length).alias("mean_length"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return out.withColumn("duration", (micros("last_seen") - micros("first_seen")) / 1e6)


def timeline(df: DataFrame, ts: str, means: list[str], length: str, flow: str, src: str, bucket: str | None = None) -> DataFrame:
    """Time buckets with those that are empty: counts, means, 95th percentile, distinct flows and sources.

    The bucket is 15 minutes, an hour beyond 14 days, a day beyond 120, unless it is given.
    """
    if bucket is None:
        low, high = df.agg(F.min(micros(ts)), F.max(micros(ts))).first()
        days = ((high or 0) - (low or 0)) / 86_400e6
        bucket = "1 day" if days > 120 else "1 hour" if days > 14 else "15 minutes"
    at = df.withColumn("bucket", F.window(ts, bucket)["start"])
    made = at.groupBy("bucket").agg(F.count("*").alias("records"), *[F.avg(c).alias(f"mean_{c}") for c in means], F.count_distinct(flow).alias("flows"), F.count_distinct(src).alias("sources"))
    q = quantiles(at.groupBy("bucket", length).agg(F.count("*").alias("n__")), ("bucket",), length, "n__", [0.95]).select(F.col("bucket").alias("q__"), F.col("q")[0].alias("p95_length"))
    made = made.join(q, F.col("bucket") == F.col("q__"), "left").drop("q__")
    calendar = made.agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"), F.expr(f"interval {bucket}"))).alias("bucket"))
    return calendar.join(made, "bucket", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("records", "flows", "sources")})


def minute_counts(df: DataFrame, ts: str, by: str) -> DataFrame:
    return df.groupBy(F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute"), by).agg(F.count("*").alias("n"))


def weekday_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows of each weekday, Monday 0, with zeros."""
    days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return days.join(df.groupBy(F.weekday(ts).alias("weekday")).agg(F.count("*").alias("n")), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def hour_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def boxplot(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and the extremes inside 1.5 quartile distances, by group, from counts of distinct values."""
    counts = checkpointed(df.groupBy(by, F.col(value).alias("v__")).agg(F.count("*").alias("n__")))
    q = quantiles(counts, (by,), "v__", "n__", [0.25, 0.5, 0.75])
    fences = q.select(F.col(by).alias("by__"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = (F.col("v__") >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (F.col("v__") <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    met = counts.join(F.broadcast(fences), counts[by].eqNullSafe(F.col("by__")))
    return met.groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v__"))).alias("low"), F.max(F.when(inside, F.col("v__"))).alias("high"), F.sum(F.when(inside, 0).otherwise(F.col("n__"))).alias("outliers"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per column, values as text."""
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, "name", "value")


def value_counts_of(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Rows of each distinct value by `ids` and column: value as text, number (null if it is none), n.

    Columns of numbers are never written as text; their value is the number's.
    """
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType | BooleanType)]
    texts = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(ids, numbers, "name", "number")
        parts.append(long.groupBy(*ids, "name", "number").agg(F.count("*").alias("n")).withColumn("value", F.col("number").isNotNull()).select(*ids, "name", F.when(F.col("value"), "").alias("value"), "number", "n"))
    if texts:
        long = unpivot(df, ids, texts)
        parts.append(long.groupBy(*ids, "name", "value").agg(F.count("*").alias("n")).select(*ids, "name", "value", F.expr("try_cast(value AS double)").alias("number"), "n"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def moments(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sample variance and adjusted skewness of numbers by key, about the mean, from value counts."""
    known = counts.where("number is not null")
    means = known.groupBy(*keys).agg((F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean__"), F.sum("n").cast("double").alias("w__"))
    means = means.withColumnsRenamed({k: f"m_{k}__" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"m_{k}__")) for k in keys])
    apart = known.join(F.broadcast(means), same).withColumn("d__", F.col("number") - F.col("mean__"))
    made = apart.groupBy(*keys).agg(F.first("w__").alias("w"), F.sum(F.col("d__") ** 2 * F.col("n")).alias("s2"), F.sum(F.col("d__") ** 3 * F.col("n")).alias("s3"))
    variance = F.when(F.col("w") > 1, F.col("s2") / (F.col("w") - 1))
    skew = F.when((F.col("w") > 2) & (F.col("s2") > 0), F.sqrt(F.col("w") * (F.col("w") - 1)) / (F.col("w") - 2) * (F.col("s3") / F.col("w")) / (F.col("s2") / F.col("w")) ** 1.5)
    return made.select(*keys, variance.alias("variance"), skew.alias("skewness"))


def quality_report(df: DataFrame, columns: list[str], by: str = "protocol", flow: str = "flow_id", never: tuple[str, ...] = NEVER, low: float = 0.05, near: float = 0.99) -> DataFrame:
    """How usable each column is for each group, with a status whose first match counts.

    Distinct values, zeros, moments and quartiles come from the counts of distinct values,
    the coverage of flows from one aggregate over flows; `never` names what no decoder yields.
    """
    counts = checkpointed(value_counts_of(df, [by], columns))
    values = counts.groupBy(by, "name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("observed_count"), F.count("value").alias("unique_count"), F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("n_num__"), F.sum(F.when(F.col("number") == 0, F.col("n")).otherwise(0)).alias("zeros__"), F.sum("n").alias("records"))
    numbers = counts.where("number is not null").groupBy(by, "name", "number").agg(F.sum("n").alias("n"))
    quart = quantiles(numbers, (by, "name"), "number", "n", [0.25, 0.75]).select(F.col(by).alias("by__"), F.col("name").alias("name__"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    spread = moments(counts, [by, "name"]).select(F.col(by).alias("by2__"), F.col("name").alias("name2__"), "variance")
    flows = df.where(F.col(flow).isNotNull()).groupBy(by, flow).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).groupBy(by).agg(F.count("*").alias("flow_count"), *[F.sum(F.col(c).cast("long")).alias(c) for c in columns])
    covered = flows.unpivot([by, "flow_count"], columns, "name3__", "observed_flow_count").withColumnRenamed(by, "by3__")
    out = values.join(F.broadcast(quart), values[by].eqNullSafe(F.col("by__")) & (F.col("name") == F.col("name__")), "left").join(F.broadcast(spread), values[by].eqNullSafe(F.col("by2__")) & (F.col("name") == F.col("name2__")), "left").join(F.broadcast(covered), values[by].eqNullSafe(F.col("by3__")) & (F.col("name") == F.col("name3__")), "left").drop("by__", "name__", "by2__", "name2__", "by3__", "name3__")
    out = out.withColumns({"flow_count": F.coalesce("flow_count", F.lit(0)), "observed_flow_count": F.coalesce("observed_flow_count", F.lit(0))})
    out = out.withColumns({"observed_ratio": F.col("observed_count") / F.col("records"), "observed_flow_ratio": F.col("observed_flow_count") / F.greatest("flow_count", F.lit(1)), "numeric": F.col("n_num__") > 0, "zero_ratio": F.try_divide("zeros__", "n_num__")})
    status = F.when(F.col("records") == 0, "no_records").when(F.col("name").isin(list(never)), "not_implemented").when(F.col("observed_count") == 0, "not_observed").when(F.greatest("observed_ratio", "observed_flow_ratio") < low, "low_coverage").when(F.col("unique_count") <= 1, "constant").when(F.col("numeric") & (F.col("zero_ratio") >= near), "near_constant").otherwise("usable")
    out = out.withColumns({"extraction_status": status, "model_usable": status == "usable"})
    number_only = {c: F.when(F.col("numeric"), F.bround(c, 6)) for c in ("variance", "iqr")}
    return out.withColumns({"missing_ratio": F.bround(1 - F.col("observed_ratio"), 4), "nonzero_ratio": F.when(F.col("numeric"), F.bround(1 - F.col("zero_ratio"), 4))} | {c: F.bround(c, 4) for c in ("observed_ratio", "observed_flow_ratio")} | {"zero_ratio": F.when(F.col("numeric"), F.bround("zero_ratio", 4))} | number_only).drop("n_num__", "zeros__")


#: What each status means.
REASONS = {
    "no_records": "there are no records of this protocol", "not_implemented": "no decoder yields this field yet", "not_observed": "no packet at hand has this field",
    "low_coverage": "seen in under 5 % of both records and flows", "constant": "a single value cannot tell records apart", "near_constant": "99 % of the values or more are zero", "usable": "coverage and variation suffice",
}


def catalogue_report(spark: SparkSession, df: DataFrame, by: str = "protocol", flow: str = "flow_id") -> DataFrame:
    """The quality report over all catalogue features that apply to each protocol of a table, also those it has no column for."""
    df = df.withColumn(by, F.lower(by))
    columns = [f.name for f in FEATURES if f.name in df.columns]
    found = quality_report(df.select(by, flow, *columns), columns, by, flow).withColumnRenamed(by, "by__").withColumnRenamed("name", "name__")
    size = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("records__"), F.count_distinct(flow).alias("flows__"))
    entries = catalogue(spark).withColumn(by, F.explode("protocols")).drop("protocols")
    out = entries.join(size, by).join(found, (F.col(by) == F.col("by__")) & (F.col("name") == F.col("name__")), "left").drop("by__", "name__")
    out = out.withColumns({"records": F.coalesce("records", "records__"), "flow_count": F.coalesce("flow_count", "flows__"), "present": F.col("name").isin(columns), "extraction_status": F.coalesce("extraction_status", F.when(~F.col("implemented"), "not_implemented").otherwise("not_observed")), "implementation_status": F.when(F.col("implemented"), "implemented").otherwise("not_implemented")})
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("observed_count", "observed_flow_count", "unique_count", "observed_ratio", "observed_flow_ratio")} | {"missing_ratio": F.coalesce("missing_ratio", F.lit(1.0)), "numeric": F.coalesce("numeric", F.lit(False)), "model_usable": F.col("extraction_status") == "usable"})
    said = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return out.withColumn("reason", said[F.col("extraction_status")]).drop("records__", "flows__", "implemented")


def feature_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Availability, spread, outliers, zeros, skew and signal value of numeric columns.

    Everything but the correlations (one pass) comes from the counts of distinct values.
    Ranks are over the few columns.
    """
    counts = checkpointed(value_counts_of(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns).select("name", "number", "n"))
    quart = checkpointed(quantiles(counts, ("name",), "number", "n", [0.25, 0.75]).select(F.col("name").alias("name__"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")))
    out_of = (F.col("number") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("number") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    known = F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0))
    made = counts.join(F.broadcast(quart), F.col("name") == F.col("name__"), "left").groupBy("name").agg(
        (known / F.sum("n")).alias("availability"), (F.first("q3") - F.first("q1")).alias("iqr"), F.coalesce(F.sum(F.when(out_of, F.col("n")).otherwise(0)) / F.greatest(known, F.lit(1)), F.lit(0.0)).alias("outlier_rate"),
        (F.sum(F.when(F.coalesce("number", F.lit(0.0)) == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("zero_rate"), (F.count("number") / F.sum("n")).alias("cardinality_ratio"),
    )
    spread = moments(counts, ["name"]).select(F.col("name").alias("name__"), "variance", F.abs("skewness").alias("skew"))
    made = made.join(F.broadcast(spread), F.col("name") == F.col("name__"), "left").drop("name__").withColumn("skew", F.coalesce("skew", F.lit(0.0)))
    pairs = [(a, b) for a in columns for b in columns if a < b]
    corr = df.agg(*[F.abs(F.corr(a, b)).alias(f"{a}\u0000{b}") for a, b in pairs]) if pairs else None
    if corr is not None:
        rows = corr.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"`{a}\u0000{b}`").alias("r")) for a, b in pairs for x in (a, b)])).alias("x")).select("x.*")
        made = made.join(rows.groupBy("name").agg(F.max("r").alias("max_corr")), "name", "left")
    else:
        made = made.withColumn("max_corr", F.lit(0.0))
    made = checkpointed(made)
    made = made.withColumn("max_corr", F.coalesce("max_corr", F.lit(0.0))).withColumns({"spread__": F.round(F.log1p("iqr"), 9), "novelty__": F.round(1 - F.col("max_corr"), 9)})
    made = made.withColumns({"cov_rank": percent_rank("availability"), "spread_rank": percent_rank("spread__"), "novelty_rank": percent_rank("novelty__"), "rare_rank": percent_rank("outlier_rate")})
    return made.withColumn("signal_value", F.bround(100 * (0.35 * F.col("cov_rank") + 0.30 * F.col("spread_rank") + 0.20 * F.col("novelty_rank") + 0.15 * F.col("rare_rank")), 1)).drop("spread__", "novelty__")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ordered pair of columns and their correlation, from a single pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def importance_rollup(df: DataFrame, keys: tuple[str, ...] = ("scope", "model", "method")) -> DataFrame:
    """Importance of raw features: sums over their columns, shares and ranks in each run."""
    out = df.groupBy(*keys, "feature").agg(F.sum("raw_importance").alias("raw_importance"), F.count("*").alias("transformed_columns"))
    part = Window.partitionBy(*keys)
    out = out.withColumn("total__", F.sum("raw_importance").over(part))
    out = out.withColumn("importance", F.when(F.col("total__") > 0, F.col("raw_importance") / F.col("total__")).otherwise(0.0)).drop("total__")
    return out.withColumn("importance_rank", F.row_number().over(part.orderBy(F.desc("importance"), "feature")))


def profile_summary(df: DataFrame, by: str, features: str, metrics: list[str], baseline: str) -> DataFrame:
    """Means of metrics by profile, and the share of features saved against the baseline profile."""
    out = df.groupBy(by).agg(F.avg(features).alias(features), *[F.avg(m).alias(m) for m in metrics])
    base = df.where(F.col(by) == baseline).agg(F.avg(features).alias("base__"))
    return out.join(F.broadcast(base)).withColumn("feature_reduction_vs_all", 1 - F.col(features) / F.col("base__")).drop("base__")


def crosstab(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum((F.col(column) == v).cast("long")).alias(v) for v in values])


def global_metrics(df: DataFrame, flow: str, protocol: str, ts: str, features: int | None = None) -> DataFrame:
    """Records, distinct flows and protocols, minutes observed and, if given, the number of numeric features."""
    out = [] if features is None else [F.lit(features).alias("feature_columns")]
    return df.agg(*out, F.count("*").alias("records"), F.count_distinct(flow).alias("flows"), F.count_distinct(protocol).alias("protocols"), ((F.max(micros(ts)) - F.min(micros(ts))) / 60e6).alias("observed_minutes"))


def ranked(col: Column | str, ascending: bool = True) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.asc_nulls_last() if ascending else col.desc_nulls_last()
