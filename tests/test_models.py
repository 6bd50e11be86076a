"""Profiles, preparation and experiments on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.catalog import FEATURES, available_features, create_profile, load_profile
from packetloom.operators import detectors, metrics
from packetloom.plans.models import comparison_table, prepare_features, run_feature_experiments, run_lstm_sweep, sweep_grid, train_models

SCHEMA = "flow_id string, protocol string, packet_length double, payload_entropy double, http_method string, dns_rcode int, row long"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(f"f{k // 2}", "http", 60.0 + k, (k % 7) / 7, "GET" if k % 2 else "POST", 0, k) for k in range(40)], SCHEMA)


def test_catalogue_and_profiles(tmp_path):
    assert len(FEATURES) == 97 and len(available_features(["modbus"])) == 38
    path = create_profile("small", ["packet_length", " packet_length ", "http_method"], str(tmp_path), protocols=["http"])
    assert load_profile("small", str(tmp_path))["features"] == ["packet_length", "http_method"] and path.exists()
    with pytest.raises(ValueError):
        create_profile("small", ["modbus_value"], str(tmp_path), protocols=["http"])
    assert len(sweep_grid([8, 16], [5, 10])) == 4
    with pytest.raises(ValueError):
        sweep_grid([1], [5])


def test_preparation_leaves_foreign_columns_out(table):
    ready, inputs, manifest = prepare_features(table, ["packet_length", "payload_entropy", "http_method", "dns_rcode", "modbus_value"], ["http"], ("row",))
    assert manifest["prepared_rows"] == ready.count() == 40 and not any(c.startswith("dns") for c in inputs)
    assert {"packet_length", "payload_entropy", "http_method_GET", "http_method_POST"} == set(inputs)
    assert manifest["inapplicable_profile_features"] == ["dns_rcode", "modbus_value"] and manifest["dropped_constant_features"] == ["protocol"]
    assert manifest["transformer_fit_rows"] == 32 and ready.where("is_train").agg({"row_id": "max"}).first()[0] == 31


def test_preparation_joins_labels_and_splits_at_random(spark, table):
    labels = spark.createDataFrame([("f0", "attack", 1), ("f0", "benign", 2), ("f1", "attack", 1)], "flow_id string, label string, row long")
    ready, _, manifest = prepare_features(table.withColumnRenamed("row", "at"), None, ["http"], ("at",), labels=labels, split="random")
    got = {(r.flow_id, r.label) for r in ready.where("flow_id in ('f0', 'f1', 'f2')").collect()}
    assert got == {("f0", "benign"), ("f1", "attack"), ("f2", None)} and 20 < manifest["transformer_fit_rows"] < 40
    with pytest.raises(ValueError):
        prepare_features(table, None, ["http"], ("row",), labels=labels.drop("label"))


def test_training_measures_explains_and_saves(spark, table, tmp_path):
    events = []
    labelled = table.withColumn("label", F.when(F.col("row") % 9 == 8, "attack").otherwise("benign"))
    small = {"lstm_autoencoder": lambda: detectors.LstmAutoencoder(length=4, stride=4, hidden=3, latent=2, epochs=2)}
    rows = train_models(labelled, ("row",), ["isolation_forest", "lstm_autoencoder"], models=small | {"isolation_forest": lambda: detectors.IsolationForest(20)}, observer=events.append, folder=str(tmp_path))
    assert {r["model"] for r in rows} == {"isolation_forest", "lstm_autoencoder"}
    for r in rows:
        assert 0 <= r["roc_auc"] <= 1 and r["fit_seconds"] > 0
        got = r["scores"].collect()
        assert len(got) == r["test_rows"] == 8 and max(x.score_percentile for x in got) <= 1
        shares = {x.feature: x.importance for x in r["importance"].collect()}
        assert set(shares) == {"packet_length", "payload_entropy", "http_method"} and abs(sum(shares.values()) - 1) < 1e-9
        again = detectors.load_detector(f"{tmp_path}/{r['scope']}/{r['model']}/model")
        assert type(again).__name__ in ("IsolationForest", "LstmAutoencoder")
    assert [e["event"] for e in events if e["event"] in ("scope_started", "scope_prepared", "lstm_started", "lstm_completed")] == ["scope_started", "scope_prepared", "lstm_started", "lstm_completed"]
    assert comparison_table(spark, rows).count() == 2 and (tmp_path / "comparison.json").exists()


def test_saved_detectors_score_alike(tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 3))
    for k, d in enumerate((detectors.IsolationForest(10), detectors.LocalOutlierFactor(5), detectors.OneClassSvm(), detectors.PcaReconstruction(0.6), detectors.LstmAutoencoder(hidden=4, latent=2, epochs=2))):
        d.fit(x)
        detectors.save_detector(d, str(tmp_path / f"m{k}"))
        assert np.allclose(detectors.load_detector(str(tmp_path / f"m{k}")).score(x), d.score(x))


def test_labels_gate():
    assert detectors.raw_feature("http_method_GET", ["http", "http_method"]) == "http_method" and detectors.raw_feature("x", ["y"]) == "x"


def test_measures_need_two_known_rows_and_both_classes(spark):
    def can(labels):
        return metrics.can_be_measured(spark.createDataFrame([(x,) for x in labels], "label string"), "label")

    assert can(["benign", "attack"]) and not can(["unknown", "", "attack"]) and not can(["benign", "normal"]) and can(["benign", "benign", "unknown"])


def test_components_from_sums_over_all_rows(spark):
    x = np.random.default_rng(6).normal(size=(500, 4)) @ np.diag([5, 2, 1, 0.1]) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").repartition(5)
    model = detectors.fit_detector(df, "v", detectors.PcaReconstruction(0.9), "k", 10)
    assert np.allclose(model.score(x), detectors.PcaReconstruction(0.9).fit(x).score(x))


def test_windows_are_rows_that_follow_one_another(spark):
    """Fit and score by windows in Spark are those of plain code over the ordered rows."""
    x = np.random.default_rng(7).normal(size=(103, 2))
    df = spark.createDataFrame([(10 * k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").repartition(7)
    seen = []

    class Spy(detectors.LstmAutoencoder):
        def fit_windows(self, w, tell=None):
            seen.append(w)
            return super().fit_windows(w)

    plain = detectors.LstmAutoencoder(length=10, stride=4, hidden=3, latent=2, epochs=1, most_windows=7)
    length, starts = plain.fitted_starts(103)
    spy = detectors.fit_detector(df, "v", Spy(length=10, stride=4, hidden=3, latent=2, epochs=1, most_windows=7), "k")
    assert np.allclose(seen[0], x[starts[:, None] + np.arange(length)]) and len(starts) == 7
    plain.fit(x)
    assert np.allclose(plain.score(x), spy.score(x))
    got = detectors.score_detector(df, "v", plain, "k", span=20).orderBy("k").collect()
    assert np.allclose([r.anomaly_score for r in got], plain.score(x))


def test_neighbour_densities_by_plain_loops():
    x = np.random.default_rng(8).normal(size=(40, 2))
    k = 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :k]
    radius = np.sort(d, 1)[:, k - 1]
    density = np.array([1 / (np.mean([max(d[i, j], radius[j]) for j in near[i]]) + 1e-10) for i in range(40)])
    y = np.random.default_rng(9).normal(size=(10, 2))
    e = np.sqrt(((y[:, None] - x[None]) ** 2).sum(2))
    own = np.argsort(e, 1)[:, :k]
    want = [np.mean(density[own[i]]) * (np.mean([max(e[i, j], radius[j]) for j in own[i]]) + 1e-10) for i in range(10)]
    assert np.allclose(detectors.LocalOutlierFactor(k).fit(x).score(y), want)


def test_support_vectors_satisfy_the_dual():
    x = np.random.default_rng(10).normal(size=(80, 2))
    m = detectors.OneClassSvm(nu=0.2).fit(x)
    assert abs(m.a.sum() - 1) < 1e-9 and (m.a <= 1 / (0.2 * 80) + 1e-9).all()
    outside = (m.score(x) > 1e-3).mean()
    assert outside <= 0.2 + 1e-9 and len(m.a) >= 0.2 * 80


def test_hyper_parameters_are_checked():
    for bad in ({"length": 1}, {"stride": 0}, {"stride": 11}, {"hidden": 0}, {"layers": 0}, {"dropout": 1.0}, {"validation": 0.5}, {"epochs": 0}):
        with pytest.raises(ValueError):
            detectors.LstmAutoencoder(**bad)


def test_sweep_keeps_failures_with_their_variant(table):
    grid = sweep_grid([2, 3], [4])
    assert grid == [{"hidden": 2, "length": 4, "stride": 4}, {"hidden": 3, "length": 4, "stride": 4}]
    rows, failures = run_lstm_sweep(table, ("row",), [{"hidden": 2, "length": 4, "stride": 4, "latent": 2, "epochs": 1}, {"hidden": 0}], {}, least_rows=12)
    assert {r["sweep_variant"] for r in rows} == {0} and {f["sweep_variant"] for f in failures} == {1}


def test_experiments_isolate_failures(table):
    rows, failures = run_feature_experiments(table, ("row",), ["pca_reconstruction"], {"lengths": ["packet_length"]})
    assert [r["feature_profile"] for r in rows] == ["all_features", "lengths"] and not failures
    assert all(r["scores"].count() == r["test_rows"] == 8 for r in rows)
    assert run_feature_experiments(table, ("row",), ["no_such"], {})[1]
