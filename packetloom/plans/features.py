"""From captures to the feature table, and the run over an inventory of datasets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import protocols
from packetloom.functions.catalog import FEATURES
from packetloom.functions.storage import checkpointed
from packetloom.functions.text import entropy
from packetloom.operators import mapping, prepare, reports, rollups, windows
from packetloom.sources import tables
from packetloom.sources.pcap import read_captures

PROTOCOLS = {"ssh": "it", "dns": "it", "http": "it", "modbus": "ot", "s7comm": "ot"}
#: The columns of HTTP that hold for a whole direction of a flow.
HTTP_CONTEXT = (
    "http_method", "http_url_length", "http_url_entropy", "http_query_parameter_count", "http_suspicious_token_count",
    "http_host", "http_user_agent", "http_header_count", "http_content_length", "http_cookie_count",
    "http_status_code", "http_response_size", "http_error_ratio", "http_post_get_ratio", "http_request_repeat_count",
)
#: The columns that every packet has, before those of the catalogue.
BASE = (
    "capture", "timestamp", "protocol", "transport", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port",
    "direction", "is_request_direction", "packet_length", "payload_size", "payload_entropy", "tcp_flag_count",
)
#: Columns of the labels of each domain, in the order in which they count.
LABEL_ALIASES = {
    "it": {
        "label": ["Label", "Attack Name", "Category"], "flow_id": ["Flow ID", "FlowID"], "start": ["Timestamp", "timestamp"], "src_ip": ["Src IP", "src_ip"],
        "dst_ip": ["Dst IP", "dst_ip"], "src_port": ["Src Port", "src_port"], "dst_port": ["Dst Port", "dst_port"],
    },
    "ot": {"label": ["state", "Label", "label"], "start": ["startDate", "start", "timestamp"], "end": ["endDate", "end"], "src_ip": ["sIPs", "sAddress", "src_ip"], "dst_ip": ["rIPs", "rAddress", "dst_ip"]},
}
ORDER = ("timestamp", "capture", "flow_id", "packet_index")
_TEXTS = {"ssh_client_banner", "ssh_server_banner", "ssh_kex_algorithms", "hassh", "ssh_auth_method", "dns_qname", "http_method", "http_host", "http_user_agent", "modbus_function_category"}
_REALS = re.compile(r"(ratio|rate|entropy|score|duration|mean|std|jitter|time|sin|cos|burstiness|deviation|interval|bytes|content_length)$")
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"http": protocols.http_columns, "modbus": protocols.modbus_columns, "s7comm": protocols.s7_columns, "ssh": protocols.ssh_columns, "dns": protocols.dns_columns}


def with_protocol(packets: DataFrame) -> DataFrame:
    """Adds the protocol of each packet; multicast DNS counts as DNS, null is none of the five."""
    multicast = F.coalesce((F.col("transport") == "UDP") & ((F.col("src_port") == 5353) | (F.col("dst_port") == 5353)), F.lit(False))
    return packets.withColumn("protocol", protocols.infer_protocol(has_dns=multicast))


def decode(packets: DataFrame, expected: str | None = None, dns_payload: str = "dissected") -> DataFrame:
    """Protocol, flow and decoded columns of packets; those of other protocols are null.

    Each protocol's rows meet only their own decoder; the parts are united by name. DNS over
    TCP has its length before the message. With dns_payload 'dissected' a DNS packet has no
    payload beside its message (sizes and entropy 0, as the reference has them); with 'udp'
    the message is its payload.
    """
    if expected and expected not in PROTOCOLS:
        raise ValueError(f"unknown protocol: {expected}")
    if dns_payload not in ("dissected", "udp"):
        raise ValueError("dns_payload is 'dissected' or 'udp'")
    df = with_protocol(packets).where("protocol is not null")
    df = protocols.flow_columns(df).withColumns({"payload_size": F.length("payload"), "payload_entropy": entropy("payload")})
    out = None
    for name in [expected] if expected else list(DECODERS):
        own = df.where(F.col("protocol") == name)
        if name == "dns":
            own = own.withColumn("payload", F.when(F.col("transport") == "TCP", F.expr("substring(payload, 3)")).otherwise(F.col("payload")))
        part = DECODERS[name](own)
        if name == "dns" and dns_payload == "dissected":
            part = part.withColumns({"payload_size": F.lit(0), "payload_entropy": F.lit(0.0), "dns_response_size": F.when(F.col("dns_response_size").isNotNull(), F.lit(0))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.drop("payload")


def behaviour(df: DataFrame) -> DataFrame:
    """Flow, timing, calendar, host and protocol behaviour on top of decoded packets.

    The decoded packets are checkpointed once: every total is a group over that table, joined
    to the packets, and none is computed over the joins before it.
    """
    base = checkpointed(df)
    have = set(base.columns)
    blank = {c: F.lit(None).cast(t) for c, t in (("dns_rcode", "int"), ("dns_qname", "string"), ("http_status_code", "int"), ("http_method", "string"), ("http_url", "string"), ("modbus_is_exception", "int"), ("modbus_starting_address", "int"), ("modbus_transaction_id", "int"), ("s7_pdu_reference", "int")) if c not in have}
    base = base.withColumns(blank) if blank else base
    df = windows.calendar_cycles(windows.flow_totals(windows.flow_timing(base), of=base))
    df = checkpointed(windows.source_behaviour(df, of=base))
    parts = []
    for name in PROTOCOLS:
        own, of = df.where(F.col("protocol") == name), base.where(F.col("protocol") == name)
        if name in ("dns", "http", "modbus"):
            keep = {"dns": ["dns_nxdomain_rate"], "http": ["http_error_ratio", "http_post_get_ratio"], "modbus": ["modbus_exception_rate"]}[name]
            rates = windows.error_rates(own, "dns_rcode", "http_status_code", "http_method", "modbus_is_exception", of=of)
            own = rates.drop(*({"dns_nxdomain_rate", "http_error_ratio", "http_post_get_ratio", "modbus_exception_rate"} - set(keep)))
        if name == "dns":
            own = windows.repeat_count(own, "dns_qname", "dns_query_repeat_count", of=of)
        elif name == "http":
            own = windows.repeat_count(own, "http_url", "http_request_repeat_count", of=of)
            own = windows.context_fill(own, [c for c in HTTP_CONTEXT if c in own.columns])
        elif name == "modbus":
            own = windows.response_matched(windows.address_deviation(own, "modbus_starting_address", of=of), "modbus_transaction_id", "modbus_response_matched", of=of)
        elif name == "s7comm":
            own = windows.response_matched(own, "s7_pdu_reference", "s7_response_matched", of=of)
        parts.append(own)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def kind_of(name: str) -> str:
    """The type of a catalogue column that no decoder has made."""
    return "string" if name in _TEXTS else "double" if _REALS.search(name) else "int"


def stable_schema(df: DataFrame) -> DataFrame:
    """The base columns and all of the catalogue in a fixed order, then what else there is; missing ones are null."""
    wanted = [*BASE, *sorted({f.name for f in FEATURES} - set(BASE))]
    rest = [c for c in df.columns if c not in wanted]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind_of(c)).alias(c) for c in wanted], *rest)


def in_order(df: DataFrame) -> DataFrame:
    """Adds row_id, the place by time, capture, flow and packet, dealt by ranges."""
    return prepare.with_row_id(df, *ORDER)


def extract(spark: SparkSession, path: str | list[str], expected: str | None = None, max_packets: int | None = None, *, dns_payload: str = "dissected", row_id: bool = False) -> DataFrame:
    """The feature table of captures: base columns, the whole catalogue, and row_id if asked for."""
    out = stable_schema(behaviour(decode(read_captures(spark, path, max_packets), expected, dns_payload)))
    return in_order(out) if row_id else out


def tallies(spark: SparkSession, path: str | list[str], expected: str | None = None, max_packets: int | None = None) -> DataFrame:
    """Packets read, supported, retained and filtered of each capture."""
    return reports.capture_tallies(with_protocol(read_captures(spark, path, max_packets, keep_all=True)), expected)


def scopes(strategy: str, groups: Iterable[str], present: Iterable[str]) -> dict[str, list[str]]:
    """Protocols of each model: one per protocol, or one per group (it, ot, else all)."""
    there = sorted(set(present))
    if strategy == "per_protocol":
        return {p: [p] for p in there}
    if strategy != "grouped":
        raise ValueError(f"unknown strategy: {strategy}")
    return {f"grouped_{g}": [p for p in there if g not in ("it", "ot") or PROTOCOLS.get(p) == g] for g in groups}


def quality(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The quality report over the whole catalogue, for each protocol the features that apply to it."""
    return rollups.catalogue_report(spark, table)


def label_table(spark: SparkSession, path: str, domain: str, *, default: str = "unknown", day_first: bool = True) -> DataFrame:
    """A label file in the common schema, its rows numbered in file order."""
    raw = tables.read_table(spark, path)
    if not raw.head(1):
        raise ValueError(f"no rows in {path}")
    numbered = prepare.with_row_id(raw.withColumn("file__", F.monotonically_increasing_id()), "file__")
    return mapping.ingest_labels(numbered, LABEL_ALIASES[domain], "row_id", default=default, day_first=day_first, source_file=PurePosixPath(path).name, domain=domain)


def map_table(features: DataFrame, labels: DataFrame, *, reverse: bool = True, tolerance: float = 5.0, default: str = "unknown") -> DataFrame:
    """The flows of a feature table with their labels, matched on both addresses and ports."""
    return mapping.map_labels(mapping.flow_summary(features), labels, reverse=mapping.REVERSE if reverse else None, tolerance=tolerance, default=default)


def run_inventory(spark: SparkSession, datasets: list[dict[str, Any]], root: str, *, max_packets: int | None = None, reverse: bool = True, tolerance: float = 5.0, evaluate: Callable[[DataFrame], Any] | None = None) -> dict[str, Any]:
    """Extract, quality report and label maps of each dataset, then one table of all of them.

    datasets: id, path, domain, protocol and labels (files), as `tables.inventory` gives them.
    A dataset that fails is noted and left out, and so is a label file; the others go on.
    Everything is written below `root`, and the summary as run-summary.json.
    """
    done, tables_made = [], []
    for item in datasets:
        name = re.sub(r"[^A-Za-z0-9_-]+", "-", str(item["id"])).strip("-")
        note: dict[str, Any] = {"dataset_id": item["id"], "domain": item.get("domain"), "path": str(item["path"]), "expected_protocol": item.get("protocol"), "status": "pending", "mappings": []}
        done.append(note)
        try:
            made = extract(spark, item["path"], item.get("protocol"), max_packets).withColumn("dataset_id", F.lit(item["id"]))
            tables.write_table(made, f"{root}/features/{name}.parquet")
            table = tables.read_table(spark, f"{root}/features/{name}.parquet")
            counts = {r["protocol"]: r["count"] for r in table.groupBy("protocol").count().collect()}
            tables.write_table(quality(spark, table), f"{root}/reports/{name}-feature-quality.parquet")
            statuses = {r["extraction_status"]: r["count"] for r in tables.read_table(spark, f"{root}/reports/{name}-feature-quality.parquet").groupBy("extraction_status").count().collect()}
            note |= {"status": "extracted", "features": f"{root}/features/{name}.parquet", "feature_rows": sum(counts.values()), "protocol_counts": counts, "feature_validation": statuses, "captures": [r.asDict() for r in tallies(spark, item["path"], item.get("protocol"), max_packets).orderBy("capture").collect()]}
            tables_made.append(table)
        except Exception as error:
            note |= {"status": "extraction_failed", "error": f"{type(error).__name__}: {error}"}
            continue
        for file in item.get("labels", []):
            stem = re.sub(r"[^A-Za-z0-9_-]+", "-", PurePosixPath(str(file)).stem).strip("-")
            told: dict[str, Any] = {"labels": str(file), "output": f"{root}/mapping/{name}--{stem}.parquet", "status": "pending"}
            note["mappings"].append(told)
            try:
                tables.write_table(map_table(table, label_table(spark, str(file), item["domain"]), reverse=reverse, tolerance=tolerance), told["output"])
                matched = {r["match_status"]: r["count"] for r in tables.read_table(spark, told["output"]).groupBy("match_status").count().collect()}
                told |= {"status": "complete", "flows": sum(matched.values()), "match_statuses": matched}
            except Exception as error:
                told |= {"status": "failed", "error": f"{type(error).__name__}: {error}"}
    summary: dict[str, Any] = {"created_at": datetime.now(timezone.utc).isoformat(), "output_root": root, "dataset_count": len(datasets), "successful_extractions": len(tables_made), "combined_features": None, "feature_evaluation": {"status": "not_run", "runs": []}, "datasets": done}
    if tables_made:
        all_of = tables_made[0]
        for table in tables_made[1:]:
            all_of = all_of.unionByName(table, allowMissingColumns=True)
        summary["combined_features"] = f"{root}/features/all-datasets.parquet"
        tables.write_table(all_of, summary["combined_features"])
        combined = tables.read_table(spark, summary["combined_features"])
        tables.write_table(quality(spark, combined), f"{root}/reports/all-datasets-feature-quality.parquet")
        if evaluate:
            try:
                summary["feature_evaluation"] = {"status": "complete", "runs": evaluate(combined)}
            except Exception as error:
                summary["feature_evaluation"] = {"status": "failed", "runs": [], "error": f"{type(error).__name__}: {error}"}
    tables.write_json(summary, f"{root}/run-summary.json")
    return summary
