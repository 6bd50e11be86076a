"""The registered queries over the driver's tables and, for each, the same in DuckDB's SQL.

`events` stands in for packets: the user is the source, the type is the destination and
picks the protocol, the value is the length, `$.k` of props is any small number of a header.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.catalog import FEATURES
from packetloom.functions.protocols import dns_columns, http_columns, infer_protocol, modbus_columns, s7_columns, ssh_columns, url_columns
from packetloom.functions.text import entropy, u8, u16
from packetloom.operators import detectors, mapping, metrics, prepare, reports, rollups, windows
from packetloom.plans.features import LABEL_ALIASES, in_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The protocol that each event type stands for.
PROTOCOLS = {"click": "http", "view": "dns", "error": "s7comm", "purchase": "modbus", "signup": "ssh"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    protocol = F.lit("other")
    for kind, name in PROTOCOLS.items():
        protocol = F.when(F.col("event_type") == kind, name).otherwise(protocol)
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("packet_index"), F.concat(F.lit("cap"), (F.col("user_id") % 3).cast("string")).alias("capture"), user.alias("src_ip"), F.col("event_type").alias("dst_ip"), F.concat(user, F.lit("|"), F.col("event_type")).alias("flow_id"),
        protocol.alias("protocol"), (F.col("event_id") % 2).cast("int").alias("direction"), F.col("value").alias("packet_length"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.lit(1024) + F.col("user_id") % 7).cast("int").alias("src_port"), (F.length("event_type") * 10).cast("int").alias("dst_port"),
    )


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROTOCOLS.items())
P = f"""p AS (SELECT event_id AS packet_index, 'cap' || cast(user_id % 3 AS VARCHAR) AS capture, cast(user_id AS VARCHAR) AS src_ip, event_type AS dst_ip, cast(user_id AS VARCHAR) || '|' || event_type AS flow_id,
  CASE event_type {_CASES} ELSE 'other' END AS protocol, cast(event_id % 2 AS INTEGER) AS direction, value AS packet_length, ts AS timestamp, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, cast(1024 + user_id % 7 AS INTEGER) AS src_port, cast(length(event_type) * 10 AS INTEGER) AS dst_port, epoch_us(ts) AS us FROM events)"""
FLOW = "PARTITION BY capture, flow_id"
ORDER = "ORDER BY timestamp, packet_index"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*columns: str) -> list[F.Column]:
    return [F.round(c, 6).alias(c) for c in columns]


@query("flow_timing", f"""WITH {P}, a AS (SELECT *, greatest((us - min(us) OVER ({FLOW})) / 1e6, 0) AS d, greatest(coalesce((us - lag(us) OVER ({FLOW} {ORDER})) / 1e6, 0), 0) AS i, row_number() OVER ({FLOW} {ORDER}) AS n FROM p)
  SELECT packet_index, round(d, 6) AS flow_duration, round(i, 6) AS inter_arrival_time, round(coalesce(abs(i - lag(i) OVER ({FLOW} {ORDER})), 0), 6) AS jitter, round(n / greatest(d, 1), 6) AS packet_rate FROM a""")
def flow_timing(spark, sf_dir):
    return windows.flow_timing(packets(spark, sf_dir)).select("packet_index", *r6("flow_duration", "inter_arrival_time", "jitter", "packet_rate"))


@query("flow_totals", f"""WITH {P}, a AS (SELECT *, count(*) OVER ({FLOW}) AS n, sum(packet_length) OVER ({FLOW}) AS b, avg(packet_length) OVER ({FLOW}) AS m, stddev_samp(packet_length) OVER ({FLOW}) AS s, sum(packet_length) OVER (PARTITION BY capture, flow_id, direction) AS o FROM p)
  SELECT packet_index, n AS flow_total_packets, round(b, 4) AS flow_total_bytes, round(m, 7) AS packet_length_mean, round(coalesce(s, 0), 5) AS packet_length_std, round(o / greatest(b - o, 1), 5) AS flow_byte_ratio FROM a""")
def flow_totals(spark, sf_dir):
    return windows.flow_totals(packets(spark, sf_dir)).select("packet_index", "flow_total_packets", *[F.round(c, n).alias(c) for c, n in (("flow_total_bytes", 4), ("packet_length_mean", 7), ("packet_length_std", 5), ("flow_byte_ratio", 5))])


@query("calendar_cycles", f"""WITH {P} SELECT packet_index, round(sin(2 * pi() * hour(timestamp) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(timestamp) / 24), 6) + 0 AS hour_cos, round(sin(2 * pi() * (isodow(timestamp) - 1) / 7), 6) + 0 AS weekday_sin, round(cos(2 * pi() * (isodow(timestamp) - 1) / 7), 6) + 0 AS weekday_cos FROM p""")
def calendar_cycles(spark, sf_dir):
    return windows.calendar_cycles(packets(spark, sf_dir)).select("packet_index", *[(F.round(c, 6) + F.lit(0)).alias(c) for c in ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos")])


@query("source_behaviour", f"""WITH {P}, h AS (SELECT capture, src_ip, count(DISTINCT dst_ip) AS c, list_entropy(string_split(string_agg(DISTINCT dst_ip, '|' ORDER BY dst_ip), '')) AS e, min(us) AS t FROM p GROUP BY ALL),
  g AS (SELECT capture, count(*) / greatest((max(us) - min(us)) / 1e6, 1) AS r FROM p GROUP BY capture),
  a AS (SELECT p.*, h.c, h.e, g.r, row_number() OVER (PARTITION BY p.capture, p.src_ip ORDER BY flow_id, timestamp, packet_index) / greatest((us - t) / 1e6, 1) AS q FROM p JOIN h USING (capture, src_ip) JOIN g USING (capture))
  SELECT packet_index, round(q, 6) AS source_packet_rate, c AS source_destination_count, round(e, 4) AS destination_entropy, round(q / greatest(r, 1e-6), 4) AS burstiness FROM a""")
def source_behaviour(spark, sf_dir):
    return windows.source_behaviour(packets(spark, sf_dir)).select("packet_index", *r6("source_packet_rate"), "source_destination_count", "destination_entropy", F.round("burstiness", 4).alias("burstiness"))


@query("repeat_counts", f"""WITH {P}, a AS (SELECT *, nullif(k, 3) AS v FROM p) SELECT packet_index, CASE WHEN v IS NOT NULL THEN count(*) OVER (PARTITION BY capture, src_ip, v) END AS repeat_count FROM a""")
def repeat_counts(spark, sf_dir):
    return windows.repeat_count(packets(spark, sf_dir).withColumn("v", F.expr("nullif(k, 3)")), "v", "repeat_count").select("packet_index", "repeat_count")


@query("error_rates", f"""WITH {P}, a AS (SELECT *, k % 5 AS rcode, CASE WHEN k % 3 = 0 THEN NULL ELSE 200 + 100 * (k % 4) END AS status, CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 END AS ex FROM p),
  b AS (SELECT *, avg(CASE WHEN coalesce(rcode, 0) = 3 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS x, avg(CASE WHEN status IS NOT NULL THEN CASE WHEN status >= 400 AND status < 600 THEN 1.0::DOUBLE ELSE 0 END END) OVER w AS y, coalesce(sum(CASE WHEN method = 'POST' THEN 1 WHEN method IS NOT NULL THEN 0 END) OVER w, 0) AS po, coalesce(sum(CASE WHEN method = 'GET' THEN 1 WHEN method IS NOT NULL THEN 0 END) OVER w, 0) AS ge, avg(ex::DOUBLE) OVER ({FLOW}) AS z FROM a WINDOW w AS (PARTITION BY capture, src_ip))
  SELECT packet_index, round(x, 6) AS dns_nxdomain_rate, round(y, 6) AS http_error_ratio, round(po::DOUBLE / greatest(ge, 1), 6) AS http_post_get_ratio, round(z, 6) AS modbus_exception_rate FROM b""")
def error_rates(spark, sf_dir):
    df = packets(spark, sf_dir).selectExpr("*", "k % 5 AS rcode", "CASE WHEN k % 3 = 0 THEN NULL ELSE 200 + 100 * (k % 4) END AS status", "CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method", "CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 END AS ex")
    return windows.error_rates(df, "rcode", "status", "method", "ex").select("packet_index", *r6("dns_nxdomain_rate", "http_error_ratio", "http_post_get_ratio", "modbus_exception_rate"))


@query("address_deviation", f"WITH {P} SELECT packet_index, round(abs(k - median(k) OVER ({FLOW})), 6) AS modbus_address_deviation FROM p")
def address_deviation(spark, sf_dir):
    return windows.address_deviation(packets(spark, sf_dir), "k").select("packet_index", *r6("modbus_address_deviation"))


@query("response_matched", f"""WITH {P}, a AS (SELECT *, nullif(k, 5) AS v FROM p) SELECT packet_index, CASE WHEN v IS NOT NULL AND min(direction) OVER (PARTITION BY capture, flow_id, v) <> max(direction) OVER (PARTITION BY capture, flow_id, v) THEN 1 ELSE 0 END AS matched FROM a""")
def response_matched(spark, sf_dir):
    return windows.response_matched(packets(spark, sf_dir).withColumn("v", F.expr("nullif(k, 5)")), "v", "matched").select("packet_index", "matched")


@query("context_fill", f"""WITH {P}, a AS (SELECT *, CASE WHEN k % 4 = 0 THEN k END AS v FROM p) SELECT packet_index, coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM a WINDOW w AS (PARTITION BY capture, flow_id, direction {ORDER})""")
def context_fill(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("v", F.expr("CASE WHEN k % 4 = 0 THEN k END"))
    return windows.context_fill(df, ["v"]).select("packet_index", "v")


@query("ecdf_rolling", f"""WITH {P} SELECT packet_index, round(avg(packet_length) OVER (PARTITION BY protocol {ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, round(avg(packet_length) OVER (PARTITION BY protocol {ORDER} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS mean25, round(row_number() OVER (PARTITION BY protocol ORDER BY packet_length, packet_index) / count(*) OVER (PARTITION BY protocol), 9) AS ecdf,
  round((rank() OVER (PARTITION BY protocol ORDER BY k) + (count(*) OVER (PARTITION BY protocol, k) - 1) / 2) / count(*) OVER (PARTITION BY protocol), 9) AS pct FROM p""")
def ecdf_rolling(spark, sf_dir):
    df = packets(spark, sf_dir)
    for n in (5, 25):
        df = windows.rolling(df, "packet_length", f"mean{n}", n, ("protocol",), ("timestamp", "packet_index"))
    df = windows.average_rank(windows.ecdf(df, "packet_length", "ecdf", ("protocol",), "packet_index"), "k", "pct", ("protocol",))
    return df.select("packet_index", *r6("mean5", "mean25"), F.round("ecdf", 9).alias("ecdf"), F.round("pct", 9).alias("pct"))


@query("flow_summary", f"""WITH {P} SELECT flow_id, arg_min(nullif(src_ip, '7'), (timestamp, packet_index)) FILTER (nullif(src_ip, '7') IS NOT NULL) AS src_ip, arg_min(src_port, (timestamp, packet_index)) AS src_port, arg_min(dst_ip, (timestamp, packet_index)) AS dst_ip, arg_min(dst_port, (timestamp, packet_index)) AS dst_port, arg_min(protocol, (timestamp, packet_index)) AS protocol, min(timestamp) AS flow_start, max(timestamp) AS flow_end, count(*) AS packet_count FROM p GROUP BY flow_id""")
def flow_summary(spark, sf_dir):
    return mapping.flow_summary(packets(spark, sf_dir).withColumn("src_ip", F.expr("nullif(src_ip, '7')")))


def _labels(spark, sf_dir):
    df = packets(spark, sf_dir).where("packet_index % 37 = 0")
    return df.select(F.col("packet_index").alias("csv_row"), F.when(F.col("k") % 2 == 0, "attack").otherwise("benign").alias("label"), F.expr("CASE WHEN k % 9 <> 0 THEN timestamp + interval '2' second END").alias("label_timestamp"), F.expr("CASE WHEN k % 5 = 0 THEN timestamp + interval '1' hour END").alias("label_end_timestamp"), F.expr("CASE WHEN k % 4 <> 1 THEN src_ip END").alias("src_ip"), F.expr("CASE WHEN k % 4 <> 1 OR k % 8 = 1 THEN dst_ip ELSE 'view' END").alias("dst_ip"), F.expr("CASE WHEN k % 3 = 0 THEN src_port END").alias("src_port"), F.expr("CASE WHEN k % 6 = 0 THEN dst_port END").alias("dst_port")).withColumn("dst_ip", F.expr("CASE WHEN label = 'attack' AND csv_row % 5 = 0 THEN NULL ELSE dst_ip END"))


_LABELS = f"""{P}, f AS (SELECT flow_id, arg_min(src_ip, (timestamp, packet_index)) AS src_ip, arg_min(dst_ip, (timestamp, packet_index)) AS dst_ip, arg_min(src_port, (timestamp, packet_index)) AS src_port, arg_min(dst_port, (timestamp, packet_index)) AS dst_port, min(timestamp) AS flow_start, epoch_us(min(timestamp)) AS fs FROM p GROUP BY flow_id),
  l AS (SELECT packet_index AS csv_row, CASE WHEN k % 2 = 0 THEN 'attack' ELSE 'benign' END AS label, CASE WHEN k % 9 <> 0 THEN us + 2000000 END AS ls, CASE WHEN k % 5 = 0 THEN us + 3600000000 END AS le, CASE WHEN k % 4 <> 1 THEN src_ip END AS src, CASE WHEN k % 2 = 0 AND packet_index % 5 = 0 THEN NULL WHEN k % 4 <> 1 OR k % 8 = 1 THEN dst_ip ELSE 'view' END AS dst, CASE WHEN k % 3 = 0 THEN src_port END AS sp, CASE WHEN k % 6 = 0 THEN dst_port END AS dp FROM p WHERE packet_index % 37 = 0),
  c AS (SELECT * FROM f JOIN l ON ((src IS NULL OR src = src_ip) AND (dst IS NULL OR dst = dst_ip) AND (sp IS NULL OR sp = src_port) AND (dp IS NULL OR dp = dst_port)) OR ((src IS NULL OR src = dst_ip) AND (dst IS NULL OR dst = src_ip) AND (sp IS NULL OR sp = dst_port) AND (dp IS NULL OR dp = src_port))),
  b AS (SELECT flow_id, count(*) AS n, max(CASE WHEN ls IS NOT NULL THEN 1 ELSE 0 END) AS timed, min(csv_row) AS any_row, min(CASE WHEN ls IS NOT NULL AND le IS NOT NULL AND ls <= fs AND fs <= le THEN csv_row END) AS in_row, min(CASE WHEN ls IS NOT NULL THEN abs(ls - fs) END) AS d, arg_min(csv_row, (abs(ls - fs), csv_row)) FILTER (ls IS NOT NULL) AS near_row FROM c GROUP BY flow_id),
  m AS (SELECT f.flow_id, coalesce(n, 0) AS candidate_count, CASE WHEN timed = 0 THEN any_row WHEN in_row IS NOT NULL THEN in_row WHEN d / 1e6 <= 86400 THEN near_row END AS csv_row,
    CASE WHEN timed = 0 THEN 0.7 WHEN in_row IS NOT NULL THEN 0.98 WHEN d / 1e6 <= 86400 THEN round_even(greatest(0.6, 0.95 - d / 1e6 / 86400 * 0.2), 3) ELSE 0.0 END AS match_confidence FROM f LEFT JOIN b USING (flow_id))"""
_MAPPED = f"""WITH {_LABELS} SELECT flow_id, candidate_count, coalesce(label, 'unknown') AS label, CASE WHEN csv_row IS NULL THEN 'unmatched' WHEN candidate_count = 1 THEN 'matched' ELSE 'matched_from_candidates' END AS match_status, cast(match_confidence AS DOUBLE) AS match_confidence, csv_row FROM m LEFT JOIN l USING (csv_row)"""


def _mapped(spark, sf_dir, few):
    flows = mapping.flow_summary(packets(spark, sf_dir))
    out = mapping.map_labels(flows, _labels(spark, sf_dir), reverse=mapping.REVERSE, tolerance=86400.0, few=few)
    return out.select("flow_id", "candidate_count", "label", "match_status", "match_confidence", "csv_row")


@query("label_map", _MAPPED)
def label_map(spark, sf_dir):
    return _mapped(spark, sf_dir, mapping.FEW)


@query("label_map_blocks", _MAPPED)
def label_map_blocks(spark, sf_dir):
    """The same, with every label found by blocks of time."""
    return _mapped(spark, sf_dir, 0)


_RAW = """r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type END AS "Label", CASE WHEN event_id % 5 <> 0 THEN 'a' || user_id END AS "Category", date_trunc('minute', ts) AS m FROM events)"""


@query("label_ingest", f"""WITH {_RAW} SELECT event_id AS csv_row, CASE WHEN event_id % 3 = 1 THEN "Label" ELSE "Category" END AS label, CASE WHEN event_id % 4 = 3 THEN NULL ELSE m END AS label_timestamp, '10.0.' || event_id % 200 || '.1' AS src_ip, CASE WHEN event_id % 2 = 0 THEN '10.1.1.' || event_id % 9 ELSE '10.2.2.2' END AS dst_ip, cast(event_id % 1000 AS INTEGER) AS src_port, cast(CASE WHEN event_id % 7 = 0 THEN 443 ELSE event_id % 50 END AS INTEGER) AS dst_port FROM r""")
def label_ingest(spark, sf_dir):
    """Labels, addresses, ports and times in the forms that label files have them in."""
    m = F.date_trunc("minute", F.col("ts").cast("timestamp_ntz"))
    form = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(m, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(m, 'd/M/yyyy H:mm') WHEN 2 THEN date_format(m, 'dd/MM/yyyy hh:mm:ss a') ELSE 'no time' END")
    raw = read(spark, sf_dir, "events").withColumn("m", m).selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type END AS Label", "CASE WHEN event_id % 5 <> 0 THEN concat('a', user_id) END AS Category", "m",
        "concat('[10.0.', event_id % 200, '.1]') AS `Src IP`", "CASE WHEN event_id % 2 = 0 THEN concat('10.1.1.', event_id % 9, ', 10.9.9.9') END AS `Dst IP`", "CASE WHEN event_id % 7 <> 0 THEN cast(event_id % 50 AS string) ELSE 'none' END AS `Dst Port`", "concat('10.7.7.7-', event_id % 1000, '-10.2.2.2-443-6') AS `Flow ID`",
    ).withColumn("Timestamp", form)
    out = mapping.ingest_labels(raw, LABEL_ALIASES["it"], "event_id")
    return out.select("csv_row", "label", F.col("label_timestamp").cast("timestamp_ntz").alias("label_timestamp"), "src_ip", "dst_ip", "src_port", "dst_port")


@query("label_attach", f"""WITH {P}, l AS (SELECT flow_id, arg_max(CASE WHEN k % 2 = 0 THEN 'attack' ELSE 'benign' END, packet_index) AS label FROM p WHERE packet_index % 11 = 0 GROUP BY flow_id) SELECT packet_index, label FROM p LEFT JOIN l USING (flow_id)""")
def label_attach(spark, sf_dir):
    df = packets(spark, sf_dir)
    labels = df.where("packet_index % 11 = 0").select("flow_id", F.col("packet_index").alias("row"), F.when(F.col("k") % 2 == 0, "attack").otherwise("benign").alias("label"))
    return mapping.attach_labels(df, labels).select("packet_index", "label")


@query("label_normalize", r"""SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '/(en|de)/', 1)), ''), nullif(trim(regexp_extract(url, '/(fr|es)/', 1)), '')) AS label, nullif(regexp_extract('host ' || page_id % 256 || '.1.2.3:80 ' || url, '((?:\d{1,3}\.){3}\d{1,3})', 1), '') AS src_ip FROM pages""")
def label_normalize(spark, sf_dir):
    df = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/(en|de)/", 1).alias("a"), F.regexp_extract("url", "/(fr|es)/", 1).alias("b"), F.concat(F.lit("host "), (F.col("page_id") % 256).cast("string"), F.lit(".1.2.3:80 "), "url").alias("text"))
    return mapping.normalize_labels(df, ["a", "b"], {"src_ip": "text"}).select("page_id", "label", "src_ip")


@query("score_context", f"""WITH {P}, r AS (SELECT row_number() OVER ({ORDER}) - 1 AS row_id, timestamp, packet_length FROM p WHERE protocol = 'http') SELECT row_id, row_id * 0.5::DOUBLE AS anomaly_score, timestamp, packet_length FROM r WHERE row_id % 3 = 0""")
def score_context(spark, sf_dir):
    """Scores of one protocol's records with the raw columns of these."""
    raw = prepare.with_row_id(packets(spark, sf_dir).where("protocol = 'http'"), "timestamp", "packet_index")
    scores = raw.where("row_id % 3 = 0").select("row_id", (F.col("row_id") * 0.5).alias("anomaly_score"))
    return reports.score_context(scores, raw, "http")


_QUALITY = ["packet_length", "k", "sparse", "flag", "dst_ip"]


@query("quality_report", f"""WITH {P}, s AS (SELECT *, CASE WHEN packet_index % 100 = 0 THEN k END AS sparse, 1 AS flag FROM p),
  u AS ({" UNION ALL ".join(f"SELECT protocol, flow_id, '{c}' AS name, cast({c} AS VARCHAR) AS value FROM s" for c in _QUALITY)}),
  a AS (SELECT protocol, name, count(*) AS records, count(DISTINCT flow_id) AS flow_count, count(value) AS observed_count, count(DISTINCT CASE WHEN value IS NOT NULL THEN flow_id END) AS observed_flow_count, count(DISTINCT value) AS unique_count, count(try_cast(value AS DOUBLE)) AS nn, sum(CASE WHEN try_cast(value AS DOUBLE) = 0 THEN 1 WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 0 END) AS z, var_samp(try_cast(value AS DOUBLE)) AS v, quantile_cont(try_cast(value AS DOUBLE), 0.75) - quantile_cont(try_cast(value AS DOUBLE), 0.25) AS q FROM u GROUP BY ALL),
  b AS (SELECT *, observed_count / records AS o, observed_flow_count / flow_count AS of, nn > 0 AS num, z / nullif(nn, 0) AS zr FROM a)
  SELECT protocol, name, records, flow_count, observed_count, observed_flow_count, unique_count, round(o, 4) AS observed_ratio, num AS "numeric", round(CASE WHEN num THEN v END, 3) AS variance, round(CASE WHEN num THEN q END, 4) AS iqr, round(CASE WHEN num THEN zr END, 4) AS zero_ratio,
    CASE WHEN observed_count = 0 THEN 'not_observed' WHEN greatest(o, of) < 0.05 THEN 'low_coverage' WHEN unique_count <= 1 THEN 'constant' WHEN num AND zr >= 0.99 THEN 'near_constant' ELSE 'usable' END AS extraction_status FROM b""")
def quality_report(spark, sf_dir):
    df = packets(spark, sf_dir).withColumns({"sparse": F.expr("CASE WHEN packet_index % 100 = 0 THEN k END"), "flag": F.lit(1)})
    out = rollups.quality_report(df, _QUALITY)
    return out.select("protocol", "name", "records", "flow_count", "observed_count", "observed_flow_count", "unique_count", "observed_ratio", "numeric", F.round("variance", 3).alias("variance"), F.round("iqr", 4).alias("iqr"), "zero_ratio", "extraction_status")


@query("value_counts", f"WITH {P} SELECT protocol AS value, count(*) AS n FROM p GROUP BY protocol")
def value_counts(spark, sf_dir):
    return rollups.value_counts(packets(spark, sf_dir), "protocol")


@query("global_metrics", f"WITH {P} SELECT count(*) AS records, count(DISTINCT flow_id) AS flows, count(DISTINCT protocol) AS protocols, round((max(us) - min(us)) / 60e6, 6) AS observed_minutes FROM p")
def global_metrics(spark, sf_dir):
    return rollups.global_metrics(packets(spark, sf_dir), "flow_id", "protocol", "timestamp").withColumn("observed_minutes", F.round("observed_minutes", 6))


@query("top_pairs", f"WITH {P} SELECT src_ip, dst_ip, count(*) AS n FROM p GROUP BY ALL ORDER BY n DESC, src_ip, dst_ip LIMIT 25")
def top_pairs(spark, sf_dir):
    return rollups.top_counts(packets(spark, sf_dir), ["src_ip", "dst_ip"], 25)


@query("flow_rollup", f"WITH {P} SELECT nullif(flow_id, '1|click') AS flow_id, count(*) AS records, round(sum(packet_length), 4) AS total_bytes, round(avg(packet_length), 6) AS mean_length, min(timestamp) AS first_seen, max(timestamp) AS last_seen, round((max(us) - min(us)) / 1e6, 6) AS duration FROM p GROUP BY 1")
def flow_rollup(spark, sf_dir):
    out = rollups.flow_rollup(packets(spark, sf_dir).withColumn("flow_id", F.expr("nullif(flow_id, '1|click')")))
    return out.select("flow_id", "records", F.round("total_bytes", 4).alias("total_bytes"), *r6("mean_length"), "first_seen", "last_seen", *r6("duration"))


@query("timeline", f"""WITH {P}, a AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS bucket, count(*) AS records, avg(packet_length) AS m, avg(k) AS mk, quantile_cont(packet_length, 0.95) AS p95, count(DISTINCT flow_id) AS flows, count(DISTINCT src_ip) AS sources FROM p GROUP BY 1),
  c AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM a) SELECT c.bucket, coalesce(records, 0) AS records, round(m, 6) AS mean_packet_length, round(mk, 6) AS mean_k, round(p95, 6) AS p95_length, coalesce(flows, 0) AS flows, coalesce(sources, 0) AS sources FROM c LEFT JOIN a USING (bucket)""")
def timeline(spark, sf_dir):
    return rollups.timeline(packets(spark, sf_dir), "timestamp", ["packet_length", "k"], "packet_length", "flow_id", "src_ip").select("bucket", "records", *r6("mean_packet_length", "mean_k", "p95_length"), "flows", "sources")


@query("minute_counts", f"WITH {P} SELECT date_trunc('minute', timestamp) AS minute, protocol, count(*) AS n FROM p GROUP BY ALL")
def minute_counts(spark, sf_dir):
    return rollups.minute_counts(packets(spark, sf_dir), "timestamp", "protocol")


@query("weekday_counts", f"WITH {P} SELECT cast(w AS INTEGER) AS weekday, count(packet_index) AS n FROM range(7) r(w) LEFT JOIN p ON isodow(timestamp) - 1 = w GROUP BY w")
def weekday_counts(spark, sf_dir):
    return rollups.weekday_counts(packets(spark, sf_dir), "timestamp")


@query("hour_counts", f"WITH {P} SELECT cast(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM p GROUP BY 1")
def hour_counts(spark, sf_dir):
    return rollups.hour_counts(packets(spark, sf_dir), "timestamp")


@query("histogram", f"WITH {P} SELECT cast(CASE WHEN packet_length < 0 THEN 0 WHEN packet_length >= 500 THEN 51 ELSE floor(packet_length / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1")
def histogram(spark, sf_dir):
    return rollups.histogram(packets(spark, sf_dir), "packet_length", 0.0, 500.0, 50)


@query("boxplot", f"""WITH {P}, q AS (SELECT protocol, quantile_cont(packet_length, 0.25) AS q1, quantile_cont(packet_length, 0.5) AS median, quantile_cont(packet_length, 0.75) AS q3 FROM p GROUP BY protocol), i AS (SELECT p.*, q1, median, q3, packet_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM p JOIN q USING (protocol))
  SELECT protocol, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN ok THEN packet_length END), 6) AS low, round(max(CASE WHEN ok THEN packet_length END), 6) AS high, cast(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM i GROUP BY protocol, i.q1, i.median, i.q3""")
def boxplot(spark, sf_dir):
    return rollups.boxplot(packets(spark, sf_dir), "packet_length", "protocol").select("protocol", *r6("q1", "median", "q3", "low", "high"), "outliers")


@query("correlation_melt", """WITH c AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem) SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", round(corr(a, b), 6) AS correlation FROM c UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(a, c), 6) FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(b, c), 6) FROM c""")
def correlation_melt(spark, sf_dir):
    out = rollups.correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.where("left > right").select("left", "right", *r6("correlation"))


_EVIDENCE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SKEW = ", ".join(f"corr({a}, {b}) AS {a}{b}" for a in "qedt" for b in "qedt" if a < b)


def _evidence_sql() -> str:
    short = dict(zip(_EVIDENCE, "qedt", strict=True))
    best = {c: "greatest(" + ", ".join(f"abs({min(s, o)}{max(s, o)})" for o in "qedt" if o != s) + ")" for c, s in short.items()}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) / count(*) AS availability, var_samp({c}) AS variance, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.25) AS q1, sum(CASE WHEN coalesce({c}, 0) = 0 THEN 1 ELSE 0 END) / count(*) AS zero_rate, count(DISTINCT {c}) / count({c}) AS cardinality_ratio, abs(skewness({c})) AS skew, (SELECT {best[c]} FROM r) AS max_corr FROM lineitem" for c in _EVIDENCE)
    outs = " UNION ALL ".join(f"SELECT '{c}' AS name, avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0::DOUBLE ELSE 0 END) AS outlier_rate FROM lineitem, a WHERE name = '{c}'" for c in _EVIDENCE)
    rank = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER ()"
    return f"""WITH s AS (SELECT l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem), r AS (SELECT {_SKEW} FROM s), a AS ({rows}), o AS ({outs}), j AS (SELECT *, round(ln(1 + q3 - q1), 9) AS sp, round(1 - max_corr, 9) AS nv FROM a JOIN o USING (name))
      SELECT name, round(availability, 6) AS availability, round(variance, 2) AS variance, round(q3 - q1, 4) AS iqr, round(outlier_rate, 6) AS outlier_rate, round(zero_rate, 6) AS zero_rate, round(cardinality_ratio, 6) AS cardinality_ratio, round(skew, 5) AS skew, round(max_corr, 6) AS max_corr,
      round_even(100 * (0.35 * {rank.format('availability')} + 0.30 * {rank.format('sp')} + 0.20 * {rank.format('nv')} + 0.15 * {rank.format('outlier_rate')}), 1) AS signal_value FROM j"""


@query("feature_evidence", _evidence_sql())
def feature_evidence(spark, sf_dir):
    out = rollups.feature_evidence(read(spark, sf_dir, "lineitem").select(*_EVIDENCE), _EVIDENCE)
    return out.select("name", *r6("availability"), F.round("variance", 2).alias("variance"), F.round("iqr", 4).alias("iqr"), *r6("outlier_rate", "zero_rate", "cardinality_ratio"), F.round("skew", 5).alias("skew"), *r6("max_corr"), "signal_value")


@query("crosstab", f"WITH {P} SELECT capture, src_ip, cast(sum(CASE WHEN protocol = 'http' THEN 1 ELSE 0 END) AS BIGINT) AS http, cast(sum(CASE WHEN protocol = 'dns' THEN 1 ELSE 0 END) AS BIGINT) AS dns FROM p GROUP BY ALL")
def crosstab(spark, sf_dir):
    return rollups.crosstab(packets(spark, sf_dir), ["capture", "src_ip"], "protocol", ["http", "dns"])


@query("union_by_name", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def union_by_name(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), allowMissingColumns=True)


@query("importance_rollup", """WITH i AS (SELECT 'all' AS scope, p_brand AS model, 'gain' AS method, p_type AS feature, cast(p_size AS DOUBLE) AS raw_importance FROM part), a AS (SELECT scope, model, method, feature, sum(raw_importance) AS raw_importance, count(*) AS transformed_columns FROM i GROUP BY ALL), b AS (SELECT *, round(raw_importance / sum(raw_importance) OVER (PARTITION BY scope, model, method), 9) AS importance FROM a)
  SELECT *, row_number() OVER (PARTITION BY scope, model, method ORDER BY importance DESC, feature) AS importance_rank FROM b""")
def importance_rollup(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.lit("all").alias("scope"), F.col("p_brand").alias("model"), F.lit("gain").alias("method"), F.col("p_type").alias("feature"), F.col("p_size").cast("double").alias("raw_importance"))
    return rollups.importance_rollup(df).withColumn("importance", F.round("importance", 9))


@query("profile_summary", """WITH a AS (SELECT p_brand AS profile, avg(p_size) AS n, avg(p_retailprice) AS ap FROM part GROUP BY 1) SELECT profile, round(n, 6) AS n, round(ap, 6) AS ap, round(1 - n / (SELECT n FROM a WHERE profile = (SELECT min(profile) FROM a)), 6) AS feature_reduction_vs_all FROM a""")
def profile_summary(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_brand").alias("profile"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("ap"))
    base = df.agg(F.min("profile")).first()[0]
    return rollups.profile_summary(df, "profile", "n", ["ap"], base).select("profile", *r6("n", "ap", "feature_reduction_vs_all"))


@query("comparison_rank", """SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 7) DESC NULLS LAST, nullif(p_brand, 'Brand#11') DESC NULLS LAST, p_retailprice ASC NULLS LAST, p_partkey) AS place FROM part QUALIFY place <= 100""")
def comparison_rank(spark, sf_dir):
    df = read(spark, sf_dir, "part").withColumns({"ap": F.expr("nullif(p_size, 7)"), "auc": F.expr("nullif(p_brand, 'Brand#11')")})
    order = (rollups.ranked("ap", False), rollups.ranked("auc", False), rollups.ranked("p_retailprice"), "p_partkey")
    # A hundred rows are ranked again, as the order of rows is lost behind a limit.
    return df.orderBy(*order).limit(100).select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("temporal_split", f"WITH {P}, r AS (SELECT packet_index, row_number() OVER ({ORDER}) - 1 AS row_id FROM p) SELECT packet_index, row_id, row_id < greatest(1, least((SELECT count(*) FROM p) - 1, cast(floor((SELECT count(*) FROM p) * 0.8) AS BIGINT))) AS is_train FROM r")
def temporal_split(spark, sf_dir):
    df = prepare.with_row_id(packets(spark, sf_dir), "timestamp", "packet_index")
    return prepare.temporal_split(df, "row_id", read(spark, sf_dir, "events").count()).select("packet_index", "row_id", "is_train")


def _scale_sql(robust: bool) -> str:
    value = "coalesce({0}, m_{0})"
    cols = ("packet_length", "kk")
    med = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    stat = ", ".join(f"quantile_cont({value.format(c)}, 0.25) AS a_{c}, quantile_cont({value.format(c)}, 0.5) AS b_{c}, quantile_cont({value.format(c)}, 0.75) AS c_{c}, stddev_pop({value.format(c)}) AS s_{c}, avg({value.format(c)}) AS v_{c}" for c in cols)
    out = ", ".join(f"round(({value.format(c)} - {'b' if robust else 'v'}_{c}) / {'CASE WHEN c_' + c + ' - a_' + c + ' > 1e-12 THEN c_' + c + ' - a_' + c + ' WHEN s_' + c + ' > 1e-12 THEN s_' + c + ' ELSE 1 END' if robust else 'CASE WHEN s_' + c + ' > 1e-12 THEN s_' + c + ' ELSE 1 END'}, 6) + 0 AS {c}" for c in cols)
    return f"WITH {P}, t AS (SELECT packet_index, packet_length, cast(CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS DOUBLE) AS kk FROM p), f AS (SELECT * FROM t WHERE packet_index % 5 <> 0), m AS (SELECT {med} FROM f), s AS (SELECT {stat} FROM f, m) SELECT packet_index, {out} FROM t, m, s"


def _scaled(spark, sf_dir, fit):
    df = packets(spark, sf_dir).select("packet_index", "packet_length", F.expr("cast(CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS double)").alias("kk"))
    cols = ["packet_length", "kk"]
    return prepare.scale(df, fit(df.where("packet_index % 5 <> 0"), cols), cols).select("packet_index", *[(F.round(c, 6) + F.lit(0)).alias(c) for c in cols])


@query("robust_scale", _scale_sql(True))
def robust_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, prepare.fit_robust)


@query("standard_scale", _scale_sql(False))
def standard_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, prepare.fit_standard)


@query("category_cap", f"WITH {P}, t AS (SELECT src_ip FROM p GROUP BY src_ip ORDER BY count(*) DESC, min(packet_index) LIMIT 50) SELECT packet_index, CASE WHEN src_ip IN (SELECT src_ip FROM t) THEN src_ip ELSE '__OTHER__' END AS src_ip FROM p")
def category_cap(spark, sf_dir):
    return prepare.cap_categories(packets(spark, sf_dir), "src_ip", "packet_index").select("packet_index", "src_ip")


@query("one_hot", f"""WITH {P}, t AS (SELECT packet_index, nullif(protocol, 'ssh') AS protocol FROM p), f AS (SELECT coalesce(protocol, (SELECT protocol FROM t WHERE protocol IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, protocol LIMIT 1)) AS v, packet_index FROM t) SELECT packet_index, {", ".join(f"CASE WHEN v = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS protocol_{x}" for x in ("dns", "http", "modbus", "s7comm"))} FROM f""")
def one_hot(spark, sf_dir):
    df = packets(spark, sf_dir).select("packet_index", F.expr("nullif(protocol, 'ssh')").alias("protocol"))
    return prepare.one_hot(df, df, "protocol").drop("protocol")


@query("coverage", f"WITH {P}, s AS (SELECT CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS kk, dst_ip FROM p) SELECT 'kk' AS name, round(count(kk) / count(*), 6) AS observed, count(DISTINCT kk) AS distinct_values FROM s UNION ALL SELECT 'dst_ip', 1.0, count(DISTINCT dst_ip) FROM s")
def coverage(spark, sf_dir):
    df = packets(spark, sf_dir).select("dst_ip", F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE k END").alias("kk"))
    return prepare.coverage(df, ["kk", "dst_ip"]).withColumn("observed", F.round("observed", 6))


@query("systematic_sample", f"WITH {P}, r AS (SELECT packet_index, row_number() OVER ({ORDER}) - 1 AS row_id FROM p), n AS (SELECT count(*) AS n FROM p) SELECT DISTINCT packet_index, row_id FROM r, n, range(60) g(i) WHERE row_id = (i * (n - 1)) // 59")
def systematic_sample(spark, sf_dir):
    df = prepare.with_row_id(packets(spark, sf_dir), "timestamp", "packet_index")
    return prepare.systematic_sample(df, "row_id", read(spark, sf_dir, "events").count(), 60).select("packet_index", "row_id")


@query("window_scores", f"""WITH {P}, r AS (SELECT row_number() OVER ({ORDER}) - 1 AS row_id, packet_length AS error FROM p), n AS (SELECT count(*) AS n FROM p), w AS (SELECT DISTINCT s FROM (SELECT unnest(range(0, n - 10 + 1, 4)) AS s FROM n UNION ALL SELECT n - 10 FROM n)) SELECT row_id, round(avg(error), 6) AS score, count(*) AS windows FROM r JOIN w ON row_id >= s AND row_id < s + 10 GROUP BY row_id""")
def window_scores(spark, sf_dir):
    df = prepare.with_row_id(packets(spark, sf_dir), "timestamp", "packet_index").select("row_id", F.col("packet_length").alias("error"))
    return prepare.window_scores(df, "row_id", "error", read(spark, sf_dir, "events").count(), 10, 4).withColumn("score", F.round("score", 6))


def _scores(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", 0).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_orderkey") % 5 != 0).alias("train"))


_S = "s AS (SELECT round(l_extendedprice, 0) AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_orderkey % 5 <> 0 AS train FROM lineitem)"


@query("score_metrics", f"WITH {_S}, t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM s WHERE train) SELECT count(*) AS n, round(avg(score), 4) AS score_mean, round(stddev_pop(score), 4) AS score_std, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95, round(quantile_cont(score, 0.99), 4) AS p99, round(any_value(threshold), 4) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS anomaly_rate FROM s, t WHERE NOT train")
def score_metrics(spark, sf_dir):
    out = metrics.score_metrics(_scores(spark, sf_dir), "score", "train")
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("score_mean", "score_std", "p50", "p95", "p99", "threshold")], *r6("anomaly_rate"))


@query("roc_auc", f"WITH {_S}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s) SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scores(spark, sf_dir), "score", "label").withColumn("roc_auc", F.round("roc_auc", 6))


@query("average_precision", f"WITH {_S}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / a) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scores(spark, sf_dir), "score", "label").withColumn("average_precision", F.round("average_precision", 6))


@query("text_entropy", "SELECT page_id, round(list_entropy(string_split(url, '')), 4) AS url_entropy FROM pages")
def text_entropy(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", entropy("url").alias("url_entropy"))


@query("url_tokens", r"""SELECT page_id, length(url) AS url_length, CASE WHEN contains(url, '?') THEN length(substr(url, strpos(url, '?') + 1)) - length(replace(substr(url, strpos(url, '?') + 1), '=', '')) ELSE 0 END AS query_parameters, CASE WHEN contains(lower(url), '../') THEN 1 ELSE 0 END + CASE WHEN contains(lower(url), 'ref=') THEN 1 ELSE 0 END AS tokens FROM pages""")
def url_tokens(spark, sf_dir):
    return url_columns(read(spark, sf_dir, "pages"), "url", tokens=("../", "ref=")).select("page_id", "url_length", "query_parameters", F.col("suspicious_tokens").alias("tokens"))


@query("byte_decode", """WITH b AS (SELECT page_id, encode(url) AS d FROM pages), h AS (SELECT page_id, hex(d) AS x, octet_length(d) AS n FROM b) SELECT page_id, cast('0x' || substr(x, 1, 4) AS INTEGER) AS u16_0, cast('0x' || substr(x, 15, 2) AS INTEGER) AS u8_7, cast('0x' || substr(x, 15, 2) AS INTEGER) & 127 AS function_code, CASE WHEN cast('0x' || substr(x, 9, 4) AS INTEGER) = n - 6 THEN 1 ELSE 0 END AS length_valid FROM h""")
def byte_decode(spark, sf_dir):
    df = read(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("payload"))
    return modbus_columns(df, "payload").select("page_id", u16("payload", 0).alias("u16_0"), u8("payload", 7).alias("u8_7"), F.col("modbus_function_code").alias("function_code"), F.col("modbus_length_valid").alias("length_valid"))


def _h(column: str, size: int) -> F.Column:
    """A number as `size` bytes in hex digits."""
    return F.lpad(F.hex(F.expr(column).cast("long")), 2 * size, "0")


def _bytes(df: DataFrame, *parts: F.Column) -> DataFrame:
    return df.withColumn("payload", F.unhex(F.concat(*parts)))


_MODBUS = """m AS (SELECT event_id, event_id % 65536 AS tid, event_id % 3 AS pid, CASE WHEN event_id % 4 = 0 THEN 9 ELSE 6 END AS len, user_id % 256 AS unit, event_id % 45 AS fc, event_id % 11 = 0 AS ex, event_id % 60000 AS addr, user_id % 125 AS q FROM events)"""


@query("modbus_decode", f"""WITH {_MODBUS} SELECT event_id, tid AS modbus_transaction_id, unit AS modbus_unit_id, fc AS modbus_function_code, CASE WHEN pid = 0 THEN 1 ELSE 0 END AS modbus_protocol_id_valid, CASE WHEN len = 6 THEN 1 ELSE 0 END AS modbus_length_valid, CASE WHEN fc BETWEEN 1 AND 24 OR fc = 43 THEN 0 ELSE 1 END AS modbus_nonstandard_function, CASE WHEN ex THEN 1 ELSE 0 END AS modbus_is_exception,
  CASE WHEN fc IN (1, 2, 3, 4, 7, 11, 12, 17, 20, 24, 43) THEN 'read' WHEN fc IN (5, 6, 15, 16, 21, 22, 23) THEN 'write' WHEN fc = 8 THEN 'diagnostic' ELSE 'other' END AS modbus_function_category, CASE WHEN ex THEN addr // 256 END AS modbus_exception_code, CASE WHEN NOT ex AND fc IN (1, 2, 3, 4, 5, 6, 15, 16, 22, 23) THEN addr END AS modbus_starting_address, CASE WHEN NOT ex AND fc IN (1, 2, 3, 4, 5, 6, 15, 16, 22, 23) THEN q END AS modbus_quantity, addr // 256 AS modbus_byte_count, CASE WHEN fc IN (3, 4, 6, 16) THEN q END AS modbus_value FROM m""")
def modbus_decode(spark, sf_dir):
    """All columns of Modbus over packets made from the events."""
    df = _bytes(read(spark, sf_dir, "events"), _h("event_id % 65536", 2), _h("event_id % 3", 2), _h("CASE WHEN event_id % 4 = 0 THEN 9 ELSE 6 END", 2), _h("user_id % 256", 1), _h("event_id % 45 + CASE WHEN event_id % 11 = 0 THEN 128 ELSE 0 END", 1), _h("event_id % 60000", 2), _h("user_id % 125", 2))
    return modbus_columns(df).select("event_id", *[f"modbus_{c}" for c in ("transaction_id", "unit_id", "function_code", "protocol_id_valid", "length_valid", "nonstandard_function", "is_exception", "function_category", "exception_code", "starting_address", "quantity", "byte_count", "value")])


@query("s7_decode", """WITH s AS (SELECT event_id, event_id % 8 AS ros, event_id % 65536 AS ref, event_id % 200 AS dl, event_id % 9 AS ec, event_id % 7 AS eo, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 40 WHEN 3 THEN 26 ELSE 240 END AS fc, user_id % 20 AS items, user_id % 10 AS sz, user_id % 3000 AS db, user_id % 132 AS area FROM events)
  SELECT event_id, ros AS s7_rosctr, ref AS s7_pdu_reference, 12 AS s7_parameter_length, dl AS s7_data_length, ec AS s7_error_class, eo AS s7_error_code, fc AS s7_function_code, items AS s7_item_count, CASE WHEN fc = 40 THEN 1 ELSE 0 END AS s7_control_command, CASE WHEN fc = 26 THEN 1 ELSE 0 END AS s7_block_transfer, CASE WHEN fc IN (4, 5) THEN sz END AS s7_transfer_size, CASE WHEN fc IN (4, 5) THEN db END AS s7_db_number, CASE WHEN fc IN (4, 5) THEN area END AS s7_area_code, 0 AS s7_is_plus FROM s""")
def s7_decode(spark, sf_dir):
    """All columns of S7 over packets made from the events."""
    fc = "CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 40 WHEN 3 THEN 26 ELSE 240 END"
    df = _bytes(read(spark, sf_dir, "events"), F.lit("03000021" + "02F080"), F.lit("32"), _h("event_id % 8", 1), _h("event_id % 65536", 2), F.lit("000C"), _h("event_id % 200", 2), _h("event_id % 9", 1), _h("event_id % 7", 1), _h(fc, 1), _h("user_id % 20", 1), F.lit("120A"), _h("user_id % 10", 1), F.lit("00"), _h("user_id % 3000", 2), _h("user_id % 132", 1), F.lit("000000"))
    return s7_columns(df).select("event_id", *[f"s7_{c}" for c in ("rosctr", "pdu_reference", "parameter_length", "data_length", "error_class", "error_code", "function_code", "item_count", "control_command", "block_transfer", "transfer_size", "db_number", "area_code", "is_plus")])


_DNS = """d AS (SELECT event_id, 'h' || user_id || '-x.' || event_type || '.test' AS name, event_id % 16 AS rcode, event_id % 3 = 0 AS answer, event_id % 2 AS aa, user_id % 2 AS tc, event_id % 5 = 0 AS ra, 1 + user_id % 30 AS qt, 60 * (event_id % 100) AS ttl FROM events)"""


@query("dns_decode", f"""WITH {_DNS} SELECT event_id, name AS dns_qname, length(name) AS dns_qname_length, round(list_entropy(string_split(name, '')), 4) AS dns_qname_entropy, 3 AS dns_label_count, qt AS dns_qtype, round(length(regexp_replace(name, '[^0-9]', '', 'g')) / length(name), 6) AS dns_digit_ratio, round(1 / length(name), 6) AS dns_hyphen_ratio, round(length(regexp_replace(name, '[^a-z]', '', 'g')) / length(name), 3) AS dns_ngram_score, rcode AS dns_rcode, aa AS dns_authoritative, tc AS dns_truncated, CASE WHEN ra THEN 1 ELSE 0 END AS dns_recursion_available,
  CASE WHEN answer THEN 1 ELSE 0 END AS dns_answer_count, CASE WHEN answer THEN ttl END AS dns_ttl, CASE WHEN answer THEN 12 + length(name) + 2 + 4 + 16 END AS dns_response_size FROM d""")
def dns_decode(spark, sf_dir):
    """All columns of DNS over messages made from the events, answers with a pointer to the question."""
    e = read(spark, sf_dir, "events").withColumn("first", F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit("-x")))
    flags = "CASE WHEN event_id % 3 = 0 THEN 32768 ELSE 0 END + 1024 * (event_id % 2) + 512 * (user_id % 2) + CASE WHEN event_id % 5 = 0 THEN 128 ELSE 0 END + event_id % 16"
    label = [F.concat(F.lpad(F.hex(F.length(c).cast("long")), 2, "0"), F.hex(F.encode(c, "UTF-8"))) for c in (F.col("first"), F.col("event_type"), F.lit("test"))]
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("C00C00010001"), _h("60 * (event_id % 100)", 4), F.lit("000400000000"))).otherwise(F.lit(""))
    df = _bytes(e, _h("event_id % 65536", 2), _h(flags, 2), F.lit("0001"), _h("CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END", 2), F.lit("00000000"), *label, F.lit("00"), _h("1 + user_id % 30", 2), F.lit("0001"), answer)
    out = dns_columns(df)
    return out.select("event_id", "dns_qname", "dns_qname_length", "dns_qname_entropy", "dns_label_count", "dns_qtype", *r6("dns_digit_ratio", "dns_hyphen_ratio"), F.round("dns_ngram_score", 3).alias("dns_ngram_score"), *[f"dns_{c}" for c in ("rcode", "authoritative", "truncated", "recursion_available", "answer_count", "ttl", "response_size")])


@query("ssh_decode", """WITH s AS (SELECT event_id, event_id % 2 = 0 AS banner, event_id % 4 < 2 AS client, 'k' || user_id || ',k2' AS kex, repeat('c,', cast(event_id % 4 AS INTEGER)) || 'c' AS ciphers, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm1,m2' END AS macs FROM events)
  SELECT event_id, CASE WHEN banner AND client THEN 'SSH-2.0-agent_' || event_id % 10 END AS ssh_client_banner, CASE WHEN banner AND NOT client THEN 'SSH-2.0-agent_' || event_id % 10 END AS ssh_server_banner, CASE WHEN NOT banner THEN kex END AS ssh_kex_algorithms, CASE WHEN NOT banner THEN event_id % 4 + 1 END AS ssh_cipher_count, CASE WHEN NOT banner THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END END AS ssh_mac_count, CASE WHEN NOT banner THEN 1 END AS ssh_compression_count, CASE WHEN NOT banner THEN md5(kex || ';' || ciphers || ';x;' || macs || ';y;none') END AS hassh FROM s""")
def ssh_decode(spark, sf_dir):
    """All columns of SSH over banners and name lists made from the events."""
    e = read(spark, sf_dir, "events").selectExpr("*", "concat('k', user_id, ',k2') AS kex", "concat(repeat('c,', cast(event_id % 4 AS int)), 'c') AS ciphers", "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm1,m2' END AS macs")
    lists = [F.concat(F.lpad(F.hex(F.length(c).cast("long")), 8, "0"), F.hex(F.encode(c, "UTF-8"))) for c in (F.col("kex"), F.col("ciphers"), F.lit("x"), F.col("macs"), F.lit("y"), F.lit("none"))]
    banner = F.hex(F.encode(F.concat(F.lit("SSH-2.0-agent_"), (F.col("event_id") % 10).cast("string"), F.lit("\r\n")), "UTF-8"))
    df = _bytes(e, F.when(F.col("event_id") % 2 == 0, banner).otherwise(F.concat(F.lit("0000000000" + "14" + "00" * 16), *lists)))
    df = df.withColumn("dst_port", F.expr("CASE WHEN event_id % 4 < 2 THEN 22 ELSE 40000 END"))
    return ssh_columns(df).select("event_id", "ssh_client_banner", "ssh_server_banner", "ssh_kex_algorithms", "ssh_cipher_count", "ssh_mac_count", "ssh_compression_count", "hassh")


_HTTP = """h AS (SELECT event_id, event_id % 3 AS kind, '/' || event_type || '/../x?a=' || user_id || CASE WHEN event_id % 2 = 0 THEN '&b=2' ELSE '' END AS target, 200 + 100 * (event_id % 4) AS status FROM events)"""


@query("http_decode", f"""WITH {_HTTP} SELECT event_id, CASE kind WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS http_method, CASE WHEN kind < 2 THEN length(target) END AS http_url_length, CASE WHEN kind < 2 THEN round(list_entropy(string_split(target, '')), 4) END AS http_url_entropy, CASE WHEN kind < 2 THEN CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END END AS http_query_parameter_count, CASE WHEN kind < 2 THEN 1 END AS http_suspicious_token_count, CASE WHEN kind < 2 THEN 'h' || event_id % 7 END AS http_host, CASE WHEN kind < 2 THEN 'agent: ' || event_id % 3 END AS http_user_agent, CASE WHEN kind = 2 THEN 1 WHEN kind = 1 THEN 4 ELSE 3 END AS http_header_count,
  CASE WHEN kind = 1 THEN cast(event_id % 500 AS DOUBLE) END AS http_content_length, CASE WHEN kind = 2 THEN 0 ELSE 1 + event_id % 2 END AS http_cookie_count, CASE WHEN kind = 2 THEN status END AS http_status_code, CASE WHEN kind = 2 THEN 42 + length(cast(event_id % 1000 AS VARCHAR)) END AS http_response_size FROM h""")
def http_decode(spark, sf_dir):
    """All columns of HTTP over requests and responses made from the events."""
    e = read(spark, sf_dir, "events").selectExpr("*", "concat('/', event_type, '/../x?a=', user_id, CASE WHEN event_id % 2 = 0 THEN '&b=2' ELSE '' END) AS target")
    heads = F.concat(F.lit("\r\nHost: h"), (F.col("event_id") % 7).cast("string"), F.lit("\r\nUSER-AGENT: agent: "), (F.col("event_id") % 3).cast("string"), F.lit("\r\nCookie: x=1"), F.when(F.col("event_id") % 2 == 1, "; y=2").otherwise(""))
    get = F.concat(F.lit("GET "), F.col("target"), F.lit(" HTTP/1.1"), heads, F.lit("\r\n\r\n"))
    post = F.concat(F.lit("POST "), F.col("target"), F.lit(" HTTP/1.1"), heads, F.lit("\r\nContent-Length: "), (F.col("event_id") % 500).cast("string"), F.lit("\r\n\r\nno: header"))
    response = F.concat(F.lit("HTTP/1.1 "), (F.lit(200) + 100 * (F.col("event_id") % 4)).cast("string"), F.lit(" Reason\r\nServer: test\r\n\r\nbody "), (F.col("event_id") % 1000).cast("string"))
    df = e.withColumn("payload", F.encode(F.when(F.col("event_id") % 3 == 0, get).when(F.col("event_id") % 3 == 1, post).otherwise(response), "UTF-8"))
    return http_columns(df).select("event_id", *[f"http_{c}" for c in ("method", "url_length", "url_entropy", "query_parameter_count", "suspicious_token_count", "host", "user_agent", "header_count", "content_length", "cookie_count", "status_code", "response_size")])


@query("protocol_inference", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'dns' WHEN 1 THEN 'modbus' WHEN 2 THEN 's7comm' WHEN 3 THEN 'ssh' WHEN 4 THEN 'http' WHEN 5 THEN 'ssh' WHEN 6 THEN 'http' END AS protocol FROM events""")
def protocol_inference(spark, sf_dir):
    """Protocols by port and by first bytes; port 102 without S7 bytes and unknown ports are none."""
    port = F.expr("CASE event_id % 9 WHEN 0 THEN 53 WHEN 1 THEN 502 WHEN 2 THEN 102 WHEN 3 THEN 22 WHEN 4 THEN 8080 WHEN 7 THEN 102 ELSE 9999 END")
    text = F.expr("CASE event_id % 9 WHEN 5 THEN 'SSH-2.0' WHEN 6 THEN 'get /x' WHEN 2 THEN 'a2b' WHEN 7 THEN 'abc' ELSE 'SSH' END")
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, port).otherwise(40000).alias("src_port"), F.when(F.col("event_id") % 2 == 1, port).otherwise(40000).alias("dst_port"), F.encode(text, "UTF-8").alias("payload"))
    return df.select("event_id", infer_protocol().alias("protocol"))


@query("final_order", f"WITH {P} SELECT packet_index, row_number() OVER (ORDER BY timestamp, capture, flow_id, packet_index) - 1 AS row_id FROM p")
def final_order(spark, sf_dir):
    return in_order(packets(spark, sf_dir)).select("packet_index", "row_id")


@query("capture_tallies", f"WITH {P} SELECT capture, max(packet_index) AS packets_read, sum(CASE WHEN protocol <> 'other' THEN 1 ELSE 0 END) AS supported, sum(CASE WHEN protocol = 'http' THEN 1 ELSE 0 END) AS retained_rows, sum(CASE WHEN protocol NOT IN ('other', 'http') THEN 1 ELSE 0 END) AS filtered_rows FROM p GROUP BY capture")
def capture_tallies(spark, sf_dir):
    return reports.capture_tallies(packets(spark, sf_dir).withColumn("protocol", F.expr("nullif(protocol, 'other')")), "http")


@query("score_percentile", f"WITH {_S} SELECT score, count(*) AS n, round(min(pct), 9) AS pct FROM (SELECT score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS pct FROM s WHERE NOT train) GROUP BY score")
def score_percentile(spark, sf_dir):
    out = windows.average_rank(_scores(spark, sf_dir).where("not train"), "score", "pct", ())
    return out.groupBy("score").agg(F.count("*").alias("n"), F.round(F.min("pct"), 9).alias("pct"))


_CATALOGUE = "c(name, category, cost, protocols) AS (VALUES " + ", ".join(f"('{f.name}', '{f.category}', '{f.cost}', '{','.join(f.protocols)}')" for f in FEATURES) + ")"
_THERE = ("packet_length", "direction", "http_method", "modbus_quantity")


@query("category_counts", f"WITH {_CATALOGUE} SELECT category, count(*) AS features, sum(CASE WHEN name IN {_THERE} THEN 1 ELSE 0 END) AS present_in_run, sum(CASE WHEN cost = 'medium' THEN 1 ELSE 0 END) AS medium_cost FROM c GROUP BY category")
def category_counts(spark, sf_dir):
    return reports.category_counts(spark, list(_THERE))


@query("catalogue_quality", f"""WITH {P}, {_CATALOGUE}, g AS (SELECT protocol, count(*) AS n, count(DISTINCT flow_id) AS f FROM p WHERE protocol <> 'other' GROUP BY 1), e AS (SELECT g.protocol, g.n, g.f, c.name, c.category, c.cost FROM c, g WHERE list_contains(string_split(c.protocols, ','), g.protocol))
  SELECT protocol, name, category, cost, n AS records, f AS flow_count, CASE WHEN name IN ('packet_length', 'direction') THEN n ELSE 0 END AS observed_count, name IN ('packet_length', 'direction') AS present, CASE WHEN name IN ('packet_length', 'direction') THEN 'usable' WHEN name IN ('ssh_auth_method', 'ssh_failed_auth_count', 'ssh_open_channel_count', 'ssh_keepalive_interval', 's7_return_code') THEN 'not_implemented' ELSE 'not_observed' END AS extraction_status FROM e""")
def catalogue_quality(spark, sf_dir):
    """The quality report over the whole catalogue, also of features that the table has no column for."""
    df = packets(spark, sf_dir).where("protocol <> 'other'").select("protocol", "flow_id", "packet_length", "direction")
    return rollups.catalogue_report(spark, df).select("protocol", "name", "category", "cost", "records", "flow_count", "observed_count", "present", "extraction_status")


_AS_FEATURES = {"l_quantity": "packet_length", "l_extendedprice": "payload_entropy", "l_discount": "http_method", "l_tax": "extra"}


def _evidence(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*[F.col(a).alias(b) for a, b in _AS_FEATURES.items()])
    return reports.evidence_report(rollups.feature_evidence(df, list(_AS_FEATURES.values())), spark)


_EVIDENCE_SQL = f"""{_CATALOGUE}, x AS ({_evidence_sql()}), n(name, feature) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _AS_FEATURES.items())}), y AS (SELECT feature AS name, x.* EXCLUDE (name) FROM x JOIN n USING (name)), z AS (SELECT y.*, c.category, c.cost, (rank() OVER (ORDER BY round(ln(1 + iqr), 6)) + (count(*) OVER (PARTITION BY round(ln(1 + iqr), 6)) - 1) / 2) / count(*) OVER () AS sr FROM y LEFT JOIN c USING (name))"""


@query("evidence_reason", f"""WITH {_EVIDENCE_SQL} SELECT name, category, cost, coalesce(nullif(concat_ws('; ', CASE WHEN availability >= 0.95 THEN 'coverage is high' WHEN availability < 0.6 THEN 'coverage is limited' END, CASE WHEN sr >= 0.75 THEN 'captures a wide operating range' END, CASE WHEN max_corr <= 0.65 THEN 'is not strongly redundant' END, CASE WHEN outlier_rate >= 0.05 THEN 'reacts to rare behaviour' END), ''), 'has a stable but lower-priority signal') AS reason FROM z""")
def evidence_reason(spark, sf_dir):
    return _evidence(spark, sf_dir).select("name", "category", "cost", "reason")


@query("signal_by_category", f"WITH {_EVIDENCE_SQL} SELECT coalesce(category, 'uncatalogued') AS category, round(avg(signal_value), 4) AS mean_signal_value, count(*) AS features FROM z GROUP BY 1")
def signal_by_category(spark, sf_dir):
    return reports.signal_by_category(_evidence(spark, sf_dir)).withColumn("mean_signal_value", F.round("mean_signal_value", 4))


@query("importance_report", f"""WITH {_EVIDENCE_SQL}, i AS (SELECT p_brand AS model, CASE p_size % 4 WHEN 0 THEN 'packet_length' WHEN 1 THEN 'payload_entropy' WHEN 2 THEN 'http_method' ELSE 'other' END AS feature, sum(p_size) AS raw FROM part GROUP BY ALL), j AS (SELECT *, raw / sum(raw) OVER (PARTITION BY model) AS share FROM i)
  SELECT model, feature, round(share, 9) AS importance_share, round(sum(share) OVER (PARTITION BY model ORDER BY raw DESC, feature ROWS UNBOUNDED PRECEDING), 9) AS cumulative_importance, signal_value FROM j LEFT JOIN z ON feature = name""")
def importance_report(spark, sf_dir):
    feature = F.expr("CASE p_size % 4 WHEN 0 THEN 'packet_length' WHEN 1 THEN 'payload_entropy' WHEN 2 THEN 'http_method' ELSE 'other' END")
    sums = read(spark, sf_dir, "part").groupBy(F.lit("all").alias("scope"), F.col("p_brand").alias("model"), feature.alias("feature")).agg(F.sum("p_size").alias("raw_importance"))
    return reports.importance_report(sums, _evidence(spark, sf_dir)).select("model", "feature", F.round("importance_share", 9).alias("importance_share"), F.round("cumulative_importance", 9).alias("cumulative_importance"), "signal_value")


@query("resource_means", "SELECT p_brand AS model, round(avg(p_size), 6) AS fit_seconds, round(avg(p_retailprice), 6) AS process_memory_delta_mb FROM part GROUP BY 1")
def resource_means(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("fit_seconds"), F.col("p_retailprice").alias("process_memory_delta_mb"))
    return reports.resource_means(df).select("model", *r6("fit_seconds", "process_memory_delta_mb"))


@query("loss_change", """WITH h AS (SELECT p_brand AS model, p_partkey AS epoch, p_retailprice AS train_loss, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS loss_change FROM part) SELECT model, epoch, 'train_loss' AS metric, round(train_loss, 6) AS value FROM h UNION ALL SELECT model, epoch, 'loss_change', round(loss_change, 6) FROM h""")
def loss_change(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("epoch"), F.col("p_retailprice").alias("train_loss"))
    return reports.melt(reports.difference(df, "train_loss", "loss_change", ["epoch"], ["model"]), ["model", "epoch"], ["train_loss", "loss_change"]).withColumn("value", F.round("value", 6))


@query("formats", r"""SELECT p_partkey, trim(regexp_replace(lower(p_type || '  #' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' WHEN p_partkey * 1300 + 37 >= 1000000 THEN printf('%.1fM', (p_partkey * 1300 + 37) / 1000000) WHEN p_partkey * 1300 + 37 >= 1000 THEN printf('%.1fK', (p_partkey * 1300 + 37) / 1000) ELSE cast(p_partkey * 1300 + 37 AS VARCHAR) END AS compact FROM part""")
def formats(spark, sf_dir):
    number = F.expr("CASE WHEN p_partkey % 10 <> 0 THEN p_partkey * 1300 + 37 END")
    return read(spark, sf_dir, "part").select("p_partkey", reports.slug(F.concat("p_type", F.lit("  #"), "p_brand")).alias("slug"), reports.compact_number(number).alias("compact"))


#: Smaller than the defaults, which the reference uses: the queries run at every scale of the tables.
_SMALL = {"lstm_autoencoder": lambda: detectors.LstmAutoencoder(hidden=16, latent=8, layers=1, dropout=0.0, epochs=20, patience=5, rate=0.005, batch=64, most_windows=2000)}


def _detect(name: str) -> Query:
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        if name == "local_outlier_factor":
            return detectors.local_outliers(df, "embedding", "vec_id").where("anomaly_score is not null").withColumn("anomaly_score", F.round("anomaly_score", 4))
        model = detectors.fit_detector(df, "embedding", (detectors.DETECTORS | _SMALL)[name](), "vec_id")
        return detectors.score_detector(df, "embedding", model, "vec_id").select("vec_id", F.round("anomaly_score", 6).alias("anomaly_score"))

    return run


for _name in detectors.DETECTORS:
    QUERIES[_name] = _detect(_name)
#: Every row is fitted; a scored row may be its own neighbour.
SQL["local_outlier_factor"] = """WITH e AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM e a, e b),
  n AS (SELECT a, b, d FROM d WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 35), r AS (SELECT a AS id, max(d) AS radius FROM n GROUP BY a), l AS (SELECT n.a AS id, 1 / (avg(greatest(n.d, r.radius)) + 1e-10) AS density FROM n JOIN r ON r.id = n.b GROUP BY n.a),
  s AS (SELECT a, b, d FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 35), o AS (SELECT s.a AS id, 1 / (avg(greatest(s.d, r.radius)) + 1e-10) AS own, avg(l.density) AS near FROM s JOIN r ON r.id = s.b JOIN l ON l.id = s.b GROUP BY s.a)
  SELECT id AS vec_id, round(near / own, 4) AS anomaly_score FROM o"""
