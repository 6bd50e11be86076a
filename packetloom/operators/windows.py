"""Features of packets within flows, hosts and conversations (tables in, tables out).

Ties in time are broken by `index`, the order in which packets were read. Totals of a host
or a capture are grouped and joined, so that a hot host meets partial aggregates only; places
in an order come from ranges of it.
"""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.text import entropy, micros
from packetloom.operators.prepare import running_sums

FLOW, TS, INDEX = ("capture", "flow_id"), "timestamp", "packet_index"


def _flow(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys)


def with_totals(df: DataFrame, keys: tuple[str, ...], totals: list[Column], of: DataFrame | None = None) -> DataFrame:
    """Adds aggregates over all rows with the same keys (null is a key as well).

    The rows of a hot key meet partial aggregates and a join that can be split, no window.
    `of` is the table to aggregate if it is not `df`, such as a stored one that `df` extends.
    """
    made = (df if of is None else of).groupBy(*[F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)]).agg(*totals)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k{i}__")) for i, k in enumerate(keys)], F.lit(True))
    return df.join(made, same, "left").drop(*[f"k{i}__" for i in range(len(keys))])


def flow_timing(df: DataFrame, keys: tuple[str, ...] = FLOW, ts: str = TS, index: str = INDEX) -> DataFrame:
    """flow_duration, inter_arrival_time, jitter (the second packet's is its own gap) and packet_rate."""
    whole, order = _flow(keys), _flow(keys).orderBy(ts, index)
    df = df.withColumn("at__", micros(ts))
    df = df.withColumns({"flow_duration": F.greatest((F.col("at__") - F.min("at__").over(whole)) / 1e6, F.lit(0.0)), "inter_arrival_time": F.greatest(F.coalesce((F.col("at__") - F.lag("at__").over(order)) / 1e6, F.lit(0.0)), F.lit(0.0)), "n__": F.row_number().over(order)})
    df = df.withColumns({"jitter": F.coalesce(F.abs(F.col("inter_arrival_time") - F.lag("inter_arrival_time").over(order)), F.lit(0.0)), "packet_rate": F.col("n__") / F.greatest("flow_duration", F.lit(1.0))})
    return df.drop("at__", "n__")


def flow_totals(df: DataFrame, keys: tuple[str, ...] = FLOW, length: str = "packet_length", direction: str = "direction", of: DataFrame | None = None) -> DataFrame:
    """Packets, bytes, mean and sample deviation of a flow, and its ratio of own to other direction's bytes."""
    df = with_totals(df, keys, [F.count("*").alias("flow_total_packets"), F.sum(length).alias("flow_total_bytes"), F.avg(length).alias("packet_length_mean"), F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("packet_length_std")], of)
    df = with_totals(df, (*keys, direction), [F.sum(length).alias("same__")], of)
    return df.withColumn("flow_byte_ratio", F.col("same__") / F.greatest(F.col("flow_total_bytes") - F.col("same__"), F.lit(1.0))).drop("same__")


def calendar_cycles(df: DataFrame, ts: str = TS) -> DataFrame:
    """Hour of day and day of week (Monday 0) on the circle."""
    hour, day = F.hour(ts) * (2 * pi / 24), F.weekday(ts) * (2 * pi / 7)
    return df.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "weekday_sin": F.sin(day), "weekday_cos": F.cos(day)})


def source_behaviour(df: DataFrame, capture: str = "capture", src: str = "src_ip", dst: str = "dst_ip", flow: str = "flow_id", ts: str = TS, index: str = INDEX, window_seconds: int = 60, of: DataFrame | None = None) -> DataFrame:
    """source_packet_rate, source_destination_count, destination_entropy, burstiness.

    The rate's numerator counts a host's packets in the order of flow, then time. The
    entropy is that of the joined list of destinations, as text.
    """
    base = df if of is None else of
    pairs = base.select(capture, src, dst).distinct()
    hosts = pairs.groupBy(capture, src).agg(F.count(dst).alias("source_destination_count"), entropy(F.array_join(F.array_sort(F.collect_set(dst)), "|")).alias("destination_entropy"))
    begun = base.groupBy(capture, src).agg(F.min(micros(ts)).alias("begun__"))
    hosts = hosts.withColumnsRenamed({capture: "hc__", src: "hs__"})
    own = begun.join(hosts, F.col(capture).eqNullSafe(F.col("hc__")) & F.col(src).eqNullSafe(F.col("hs__")), "left").select(F.col(capture).alias("c__"), F.col(src).alias("s__"), "begun__", "source_destination_count", "destination_entropy")
    totals = base.groupBy(F.col(capture).alias("t__")).agg((F.count("*") / F.greatest((F.max(micros(ts)) - F.min(micros(ts))) / 1e6, F.lit(1.0))).alias("all__"))
    df = running_sums(df.withColumn("at__", micros(ts)), [flow, ts, index], {"n__": F.lit(1)}, (capture, src))
    df = df.join(own, F.col(capture).eqNullSafe(F.col("c__")) & F.col(src).eqNullSafe(F.col("s__")), "left").join(totals, F.col(capture).eqNullSafe(F.col("t__")), "left").drop("c__", "s__", "t__")
    df = df.withColumn("source_packet_rate", (F.col("n__") + 1) / F.greatest((F.col("at__") - F.col("begun__")) / 1e6, F.lit(1.0)))
    return df.withColumns({"burstiness": F.col("source_packet_rate") / F.greatest("all__", F.lit(1e-6)), "behavior_window_seconds": F.lit(window_seconds)}).drop("at__", "n__", "begun__", "all__")


def repeat_count(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("capture", "src_ip"), of: DataFrame | None = None) -> DataFrame:
    """Rows of a host with the same value; null values have none."""
    return with_totals(df, (*keys, value), [F.count(value).alias(out)], of).withColumn(out, F.when(F.col(value).isNotNull(), F.col(out)))


def error_rates(df: DataFrame, rcode: str, status: str, method: str, exception: str, host: tuple[str, ...] = ("capture", "src_ip"), flow: tuple[str, ...] = FLOW, of: DataFrame | None = None) -> DataFrame:
    """Share of name errors, of failed statuses (among known ones), posts to gets, and exceptions by flow."""
    bad = F.when(F.col(status).isNotNull(), ((F.col(status) >= 400) & (F.col(status) < 600)).cast("double"))
    posts, gets = F.sum((F.col(method) == "POST").cast("long")), F.sum((F.col(method) == "GET").cast("long"))
    ratio = (F.coalesce(posts, F.lit(0)) / F.greatest(F.coalesce(gets, F.lit(0)), F.lit(1))).alias("http_post_get_ratio")
    df = with_totals(df, host, [F.avg((F.coalesce(F.col(rcode), F.lit(0)) == 3).cast("double")).alias("dns_nxdomain_rate"), F.avg(bad).alias("http_error_ratio"), ratio], of)
    return with_totals(df, flow, [F.avg(F.col(exception).cast("double")).alias("modbus_exception_rate")], of)


def address_deviation(df: DataFrame, address: str, out: str = "modbus_address_deviation", keys: tuple[str, ...] = FLOW, of: DataFrame | None = None) -> DataFrame:
    """Distance from the flow's median address."""
    return with_totals(df, keys, [F.median(address).alias("m__")], of).withColumn(out, F.abs(F.col(address) - F.col("m__"))).drop("m__")


def response_matched(df: DataFrame, reference: str, out: str, direction: str = "direction", keys: tuple[str, ...] = FLOW, of: DataFrame | None = None) -> DataFrame:
    """1 if both directions of a flow bear the reference; a null reference is 0."""
    df = with_totals(df, (*keys, reference), [F.min(direction).alias("l__"), F.max(direction).alias("h__")], of)
    return df.withColumn(out, F.when(F.col(reference).isNotNull() & (F.col("l__") != F.col("h__")), 1).otherwise(0)).drop("l__", "h__")


def context_fill(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (*FLOW, "direction"), ts: str = TS, index: str = INDEX) -> DataFrame:
    """The last known value before, else the first known one after, within the conversation's direction."""
    order = Window.partitionBy(*keys).orderBy(ts, index)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) for c in columns})


def rolling(df: DataFrame, value: str, out: str, rows: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Mean over the current and the `rows - 1` rows before it."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)))


def ecdf(df: DataFrame, value: str, out: str, keys: tuple[str, ...], tie: str) -> DataFrame:
    """Place in ascending order over the number of rows."""
    df = running_sums(df, [value, tie], {"n__": F.lit(1)}, keys)
    return with_totals(df, keys, [F.count("*").alias("a__")]).withColumn(out, (F.col("n__") + 1) / F.col("a__")).drop("n__", "a__")


def average_rank(df: DataFrame, value: str, out: str, keys: tuple[str, ...]) -> DataFrame:
    """Rank from above 0 to 1 in which ties share their average rank, from counts of the distinct values; null values have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c__"))
    placed = with_totals(running_sums(counts, [value], {"b__": F.col("c__")}, keys), keys, [F.sum("c__").alias("a__")])
    ranks = placed.select(*[F.col(k).alias(f"k{i}__") for i, k in enumerate((*keys, value))], ((F.col("b__") + (F.col("c__") + 1) / 2) / F.col("a__")).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k{i}__")) for i, k in enumerate((*keys, value))])
    return df.join(ranks, same, "left").drop(*[f"k{i}__" for i in range(len(keys) + 1)])
