"""Preparation, training and comparison of detectors over scopes and feature profiles."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from packetloom.functions.catalog import available_features
from packetloom.functions.storage import checkpointed
from packetloom.operators import detectors, mapping, metrics, prepare, rollups, windows
from packetloom.plans.features import scopes
from packetloom.sources import tables

METADATA = ("label", "protocol", "flow_id", "timestamp", "capture")


def prepare_features(df: DataFrame, features: list[str] | None, protocols: list[str] | None, order: tuple[str, ...], share: float = 0.8, robust: bool = True, most_categories: int = 50, least_observed: float = 0.05, labels: DataFrame | None = None, label_order: str = "row", split: str = "temporal") -> tuple[DataFrame, list[str], dict[str, Any]]:
    """row_id, is_train, metadata and model inputs; the input names; a manifest of what was kept and why not.

    Labels, if given, replace the table's own (the last of each flow counts). Of the wanted
    columns those that apply to the observed protocols and are there stay, unless they are
    known in too few rows or constant; numbers are imputed and scaled and texts made columns
    by what the training rows show. The training rows are the first `share` of the rows in
    `order`, or with split 'random' a seeded share of them.
    """
    if labels is not None:
        if missing := {"flow_id", "label"} - set(labels.columns):
            raise ValueError(f"labels have no {sorted(missing)}")
        df = mapping.attach_labels(df, labels if label_order in labels.columns else labels.withColumn(label_order, F.monotonically_increasing_id()), order=label_order)
    if split not in ("temporal", "random"):
        raise ValueError("a split is 'temporal' or 'random'")
    df = df.where(F.col("protocol").isin(list(protocols))) if protocols else df
    observed = [r[0] for r in df.where("protocol is not null").select(F.lower("protocol")).distinct().collect()]
    applicable = {f.name for f in available_features(observed)}
    requested = list(dict.fromkeys(features)) if features is not None else sorted(applicable)
    wanted = [f for f in requested if f in applicable and f in df.columns]
    stats = {r["name"]: r for r in prepare.coverage(df, [*wanted, "protocol"]).collect()}
    sparse = [c for c in (*wanted, "protocol") if (stats[c]["observed"] or 0) < least_observed]
    constant = [c for c in (*wanted, "protocol") if c not in sparse and stats[c]["distinct_values"] <= 1]
    kept = [c for c in (*wanted, "protocol") if c not in sparse and c not in constant]
    numbers = [c for c in kept if isinstance(df.schema[c].dataType, NumericType | BooleanType)]
    texts = [c for c in kept if c not in numbers]
    meta = [c for c in METADATA if c in df.columns]
    rows = prepare.with_row_id(df.select(*dict.fromkeys([*meta, *kept, *order])), *order)
    n = rows.count()
    rows = prepare.temporal_split(rows, "row_id", n, share) if split == "temporal" else prepare.random_split(rows, "row_id", share)
    for c in texts:
        rows = prepare.cap_categories(rows.withColumn(f"{c}__", F.col(c)), f"{c}__", "row_id", most_categories)
    fit = rows.where("is_train")
    inputs = list(numbers)
    out = rows
    if numbers:
        out = prepare.scale(out, (prepare.fit_robust if robust else prepare.fit_standard)(fit, numbers), numbers)
    for c in texts:
        before = set(out.columns)
        out = prepare.one_hot(out, fit, f"{c}__", most_categories + 1)
        made = [x for x in out.columns if x not in before]
        for x in made:
            out = out.withColumnRenamed(x, x.replace(f"{c}__", c, 1))
        inputs += [x.replace(f"{c}__", c, 1) for x in made]
    ready = checkpointed(out.select("row_id", "is_train", *[c for c in meta if c not in inputs], *inputs))
    fitted = ready.where("is_train").count()
    manifest = {
        "protocols": protocols, "source_rows": n, "prepared_rows": n, "selected_input_features": kept, "inapplicable_profile_features": sorted(set(requested) - applicable), "dropped_missing_features": sorted(sparse),
        "dropped_constant_features": constant, "numeric_input_features": numbers, "categorical_input_features": texts, "transformer_fit_rows": fitted, "transformed_feature_count": len(inputs),
    }
    return ready, inputs, manifest


def train_models(df: DataFrame, order: tuple[str, ...], names: list[str], strategy: str = "per_protocol", groups: tuple[str, ...] = ("it", "ot"), features: list[str] | None = None, contamination: float = 0.05, least_rows: int = 12, models: dict[str, Callable[[], detectors.Detector]] | None = None, observer: Callable[[dict], None] | None = None, *, split: str = "temporal", share: float = 0.8, labels: DataFrame | None = None, folder: str | None = None) -> list[dict[str, Any]]:
    """Fits each detector on each scope's training rows and measures it on the rest.

    Returns a row per model with its measures; under `scores` its scored test rows with their
    percentile, under `importance` a table of its raw features, under `manifest` what was
    prepared. Sorted by average precision, then area, both falling, then the 95th percentile.
    A model is measured against labels if two test rows or more have a known one and both
    classes are there. With `folder` models, scores, importances and a comparison are written
    there. An observer is told of each step; what it raises is ignored.
    """

    def tell(**event: Any) -> None:
        try:
            if observer:
                observer(event)
        except Exception:
            pass

    known = detectors.DETECTORS | (models or {})
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    spark = df.sparkSession
    present = [r[0] for r in df.select("protocol").distinct().collect() if r[0]]
    done = []
    for scope, protocols in scopes(strategy, groups, present).items():
        tell(event="scope_started", scope=scope, protocols=protocols)
        part = df.where(F.col("protocol").isin(protocols))
        if not protocols or part.limit(least_rows).count() < least_rows:
            tell(event="scope_skipped", scope=scope, protocols=protocols)
            continue
        ready, inputs, manifest = prepare_features(part, features, protocols, order, share, labels=labels, split=split)
        if not inputs:
            tell(event="scope_skipped", scope=scope, protocols=protocols)
            continue
        tell(event="scope_prepared", scope=scope, protocols=protocols, rows=manifest["prepared_rows"], input_features=len(inputs))
        whole = ready.withColumn("features", F.array(*[F.col(f"`{c}`").cast("double") for c in inputs]))
        fit = whole.where("is_train")
        measured = False
        if "label" in whole.columns:
            normal = fit.where(metrics.binary_label("label") == 0)
            fit = normal if normal.limit(10).count() >= 10 else fit
            measured = metrics.can_be_measured(whole.where("not is_train"), "label")
        fit_rows = fit.count()
        for name in names:
            about = {"scope": scope, "protocols": protocols, "model": name}
            tell(event="model_started", **about, training_rows=fit_rows, test_rows=manifest["prepared_rows"] - manifest["transformer_fit_rows"], input_features=len(inputs))
            before, began = _memory_mb(), time.perf_counter()
            model = detectors.fit_detector(fit, "features", known[name](), "row_id", tell=lambda about=about, **event: tell(**(event | about)))
            seconds, grown = time.perf_counter() - began, _memory_mb() - before
            tell(event="model_scoring", **about, fit_seconds=seconds)
            # The threshold is a quantile of the rows that were fitted, not of all training rows.
            seen = checkpointed(detectors.score_detector(fit.select("row_id", "features"), "features", model, "row_id").select("anomaly_score", F.lit(True).alias("is_train")))
            test = whole.where("not is_train")
            scored = checkpointed(detectors.score_detector(test, "features", model, "row_id").drop("features"))
            row = metrics.score_metrics(seen.unionByName(scored.select("anomaly_score", "is_train")), "anomaly_score", "is_train", contamination).first().asDict()
            row |= {"roc_auc": None, "average_precision": None}
            if measured:
                marked = scored.withColumn("y", metrics.binary_label("label"))
                row |= {"roc_auc": metrics.roc_auc(marked, "anomaly_score", "y").first()[0], "average_precision": metrics.average_precision(marked, "anomaly_score", "y").first()[0]}
            if isinstance(model, detectors.LstmAutoencoder):
                held = [h["validation_loss"] for h in model.history if h["validation_loss"] is not None]
                row |= {"reconstruction_mse_mean": row["score_mean"], "reconstruction_rmse": row["score_mean"] ** 0.5, "epochs_completed": len(model.history), "best_training_loss": min(h["train_loss"] for h in model.history), "best_validation_loss": min(held, default=None)}
            flagged = windows.average_rank(scored, "anomaly_score", "score_percentile", ()).withColumns({"is_anomaly": F.col("anomaly_score") >= row["threshold"], "scope": F.lit(scope), "model": F.lit(name)})
            method, shares = detectors.importance(test, "features", model, inputs, "row_id")
            table = spark.createDataFrame([(scope, name, method, detectors.raw_feature(c, manifest["selected_input_features"]), c, float(v)) for c, v in shares], "scope string, model string, method string, feature string, transformed_feature string, raw_importance double")
            ranked = rollups.importance_rollup(table)
            done.append({"training_rows": fit_rows, "test_rows": row["n"], "input_features": len(inputs), "fit_seconds": round(seconds, 4), "process_memory_delta_mb": round(grown, 3), "importance_method": method, "scores": flagged, "importance": ranked, "manifest": manifest} | about | row)
            if folder:
                at = f"{folder}/{scope}/{name}"
                detectors.save_detector(model, f"{at}/model", scope=scope, protocols=protocols, input_columns=inputs, selected_input_features=manifest["selected_input_features"])
                tables.write_table(flagged, f"{at}/scores.parquet")
                tables.write_table(ranked, f"{at}/feature-importance.parquet")
                tables.write_json({k: v for k, v in row.items()}, f"{at}/metrics.json")
                if isinstance(model, detectors.LstmAutoencoder):
                    tables.write_json(model.history, f"{at}/training-history.json")
                tables.write_json(manifest, f"{folder}/{scope}/prepared.manifest.json")
            tell(event="model_completed", **about, fit_seconds=seconds, threshold=row["threshold"])

    def place(r: dict) -> tuple:
        return tuple((r.get(k) is None, -(r.get(k) or 0)) for k in ("average_precision", "roc_auc")) + ((r["p95"] is None, r["p95"] or 0),)

    done = sorted(done, key=place)
    if folder:
        tables.write_json([{k: v for k, v in r.items() if k not in ("scores", "importance", "manifest")} for r in done], f"{folder}/comparison.json")
    return done


def comparison_table(spark: SparkSession, runs: list[dict[str, Any]]) -> DataFrame:
    """The rows of `train_models` as a table, in their order."""
    kinds = {"scope": "string", "model": "string", "training_rows": "long", "test_rows": "long", "input_features": "int", "fit_seconds": "double", "process_memory_delta_mb": "double", "importance_method": "string", "score_mean": "double", "score_std": "double", "p50": "double", "p95": "double", "p99": "double", "threshold": "double", "anomaly_rate": "double", "roc_auc": "double", "average_precision": "double"}
    return spark.createDataFrame([(k, *(r.get(c) for c in kinds)) for k, r in enumerate(runs, 1)], ", ".join(f"{c} {t}" for c, t in ({"place": "int"} | kinds).items()))


def _memory_mb() -> float:
    """The most memory that this process has had so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def run_feature_experiments(df: DataFrame, order: tuple[str, ...], names: list[str], profiles: dict[str, list[str]], **options: Any) -> tuple[list[dict], list[dict]]:
    """The baseline with all features, then each profile; a failing one is noted and left out."""
    rows, failures = [], []
    observer = options.get("observer")

    def tell(event: dict) -> None:
        try:
            if observer:
                observer(event)
        except Exception:
            pass

    for profile, features in {"all_features": None, **profiles}.items():
        try:
            tell({"event": "profile_started", "feature_profile": profile})
            rows += [{"feature_profile": profile} | r for r in train_models(df, order, names, features=features, **options)]
        except Exception as error:
            failures.append({"feature_profile": profile, "error": str(error)})
            tell({"event": "profile_failed", "feature_profile": profile, "error": str(error)})
    return rows, failures


def feature_evaluation(df: DataFrame, order: tuple[str, ...], names: list[str], profiles: dict[str, list[str]], strategy: str = "grouped", groups: tuple[str, ...] = ("all",), **options: Any) -> list[dict[str, Any]]:
    """The optional last step of an inventory: the same detectors with all features and with each
    profile, summed up by profile against the baseline; failures stay with their profile."""
    rows, failures = run_feature_experiments(df, order, names, profiles, strategy=strategy, groups=groups, **options)
    base = {(r["scope"], r["model"]): r["input_features"] for r in rows if r["feature_profile"] == "all_features"}
    kept = [{k: v for k, v in r.items() if k not in ("scores", "importance", "manifest")} | {"feature_reduction_vs_all": 1 - r["input_features"] / base[r["scope"], r["model"]] if (r["scope"], r["model"]) in base else None} for r in rows]
    return kept + failures


def sweep_grid(hidden: list[int], lengths: list[int], most: int = 8) -> list[dict[str, int]]:
    """Combinations of hidden size and window length, both 2 or more, in order without repeats."""
    pairs = list(product(dict.fromkeys(hidden), dict.fromkeys(lengths)))
    if not pairs or len(pairs) > most or min(min(p) for p in pairs) < 2:
        raise ValueError(f"1 to {most} combinations of values from 2 on")
    return [{"hidden": h, "length": n, "stride": n} for h, n in pairs]


def run_lstm_sweep(df: DataFrame, order: tuple[str, ...], grid: list[dict[str, int]], profiles: dict[str, list[str]], **options: Any) -> tuple[list[dict], list[dict]]:
    """One experiment per combination; failures stay with their variant."""
    rows, failures = [], []
    for k, choice in enumerate(grid):
        made = {"lstm_autoencoder": lambda c=choice: detectors.LstmAutoencoder(**c)}
        good, bad = run_feature_experiments(df, order, ["lstm_autoencoder"], profiles, models=made, **options)
        rows += [{"sweep_variant": k} | choice | r for r in good]
        failures += [{"sweep_variant": k} | choice | r for r in bad]
    return rows, failures
