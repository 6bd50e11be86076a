"""A thin command line over the plans: python -m packetloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from packetloom.functions.catalog import create_profile, load_profile
from packetloom.operators import rollups
from packetloom.plans import features, models
from packetloom.sources import tables

#: The folders and protocols of an inventory that no configuration names.
DEFAULTS = {
    "data": {"raw_pcap_dir": "data/raw/pcap", "it_label_dir": "data/raw/labels/it", "ot_label_dir": "data/raw/labels/ot", "protocol_folders": [], "datasets": []},
    "capture": {"supported_protocols": ["ssh", "dns", "http", "modbus", "s7comm"]},
    "mapping": {"timestamp_tolerance_seconds": 5.0, "allow_reverse_flow_match": True},
    "models": {"contamination": 0.05, "train_split": 0.8, "split_strategy": "temporal", "candidates": ["isolation_forest", "local_outlier_factor", "one_class_svm", "lstm_autoencoder"]},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="packetloom", description=__doc__)
    out.add_argument("--config", help="JSON or YAML laid over the defaults")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    limit = ("--max-packets", {"type": int})
    add("resources")
    add("extract", ("capture", {}), ("output", {}), ("--protocol", {}), limit)
    add("run", ("output", {}), limit)
    add("map", ("features", {}), ("labels", {}), ("output", {}), ("--domain", {"choices": ["it", "ot"], "default": "it"}))
    add("profile-create", ("name", {}), ("folder", {}), ("--features", {"nargs": "+", "required": True}), ("--protocols", {"nargs": "*"}), ("--description", {"default": ""}))
    add("profile-list", ("folder", {}))
    add("analyze", ("features", {}), ("output", {}))
    add("prepare", ("features", {}), ("output", {}), ("--profile", {}), ("--labels", {}), ("--protocols", {"nargs": "*"}))
    add("train", ("features", {}), ("output", {}), ("--strategy", {"choices": ["per_protocol", "grouped"], "default": "per_protocol"}), ("--group", {"choices": ["it", "ot", "all"], "default": "all"}), ("--profile", {}), ("--labels", {}), ("--detectors", {"nargs": "*"}))
    return out


def _order(columns: list[str]) -> tuple[str, ...]:
    return tuple(c for c in features.ORDER if c in columns)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; prints what it made as JSON. An error that the user can mend goes to stderr, with code 2."""
    args = parser().parse_args(arguments)
    try:
        config = tables.load_config(DEFAULTS, args.config)
        if args.command == "profile-create":
            print(json.dumps({"profile": str(create_profile(args.name, args.features, args.folder, args.description, args.protocols))}))
            return 0
        if args.command == "profile-list":
            print(json.dumps([json.loads(p.read_text()) | {"path": str(p)} for p in sorted(Path(args.folder).glob("*.json"))], indent=2))
            return 0
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        print(json.dumps(_run(args, config, spark), indent=2, default=str))
        return 0
    except (ValueError, FileNotFoundError) as error:
        print(f"packetloom: {error}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace, config: dict, spark: SparkSession):
    if args.command == "resources":
        return {"master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "driver_cores": os.cpu_count(), "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None)}
    if args.command == "extract":
        tables.write_table(features.extract(spark, tables.capture_files(args.capture), args.protocol, args.max_packets), args.output)
        counts = {r["protocol"]: r["count"] for r in tables.read_table(spark, args.output).groupBy("protocol").count().collect()}
        return {"output": args.output, "rows": sum(counts.values()), "protocol_counts": counts}
    if args.command == "run":
        told = config["mapping"]
        return features.run_inventory(spark, tables.inventory(config), args.output, max_packets=args.max_packets, reverse=told["allow_reverse_flow_match"], tolerance=told["timestamp_tolerance_seconds"])
    table = tables.read_table(spark, args.features)
    if args.command == "map":
        told = config["mapping"]
        made = features.map_table(table, features.label_table(spark, args.labels, args.domain), reverse=told["allow_reverse_flow_match"], tolerance=told["timestamp_tolerance_seconds"])
        tables.write_table(made, args.output)
        return {"output": args.output, "match_statuses": {r["match_status"]: r["count"] for r in tables.read_table(spark, args.output).groupBy("match_status").count().collect()}}
    if args.command == "analyze":
        tables.write_table(rollups.catalogue_report(spark, table), args.output)
        return {"output": args.output, "statuses": {r["extraction_status"]: r["count"] for r in tables.read_table(spark, args.output).groupBy("extraction_status").count().collect()}}
    wanted = load_profile(args.profile, str(Path(args.profile).parent))["features"] if args.profile else None
    labels = tables.read_table(spark, args.labels) if args.labels else None
    order = _order(table.columns)
    told = config["models"]
    if args.command == "prepare":
        ready, _, manifest = models.prepare_features(table, wanted, args.protocols, order, told["train_split"], labels=labels, split=told["split_strategy"])
        tables.write_table(ready, args.output)
        return {"output": args.output} | manifest
    groups = ("all",) if args.group == "all" else (args.group,)
    runs = models.train_models(table.where(F.col("protocol").isNotNull()), order, args.detectors or told["candidates"], args.strategy, groups, wanted, told["contamination"], split=told["split_strategy"], share=told["train_split"], labels=labels, folder=args.output)
    return [{k: v for k, v in r.items() if k not in ("scores", "importance", "manifest")} for r in runs]


if __name__ == "__main__":
    sys.exit(main())
