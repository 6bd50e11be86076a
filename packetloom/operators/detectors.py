"""Anomaly detectors in numpy: fitted on what bounds the driver, scored where the rows are.

A higher score is more anomalous. Values that are null or not finite count as 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.storage import checkpointed
from packetloom.operators import prepare


class Detector(Protocol):
    def fit(self, x: np.ndarray) -> Any: ...

    def score(self, x: np.ndarray) -> np.ndarray: ...


def finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


class IsolationForest:
    """Random splits of samples of up to 256 rows (Liu et al. 2008): 2 ** -(mean depth / expected depth)."""

    def __init__(self, trees: int = 300, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        n = min(self.sample, len(x))
        self.norm, self.used = self.expected(n), np.zeros(x.shape[1])
        self.forest = [self._tree(x[rng.choice(len(x), n, replace=False)], rng, int(np.ceil(np.log2(max(n, 2))))) for _ in range(self.trees)]
        return self

    def _tree(self, x: np.ndarray, rng: np.random.Generator, height: int) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []

        def grow(rows: np.ndarray, at: int) -> int:
            node = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (depth, at + self.expected(len(rows)))):
                column.append(value)
            spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(x.shape[1])
            if at < height and spread.any():
                f = int(rng.choice(np.flatnonzero(spread)))
                c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                below = rows[:, f] < c
                self.used[f] += len(rows)
                feature[node], cut[node] = f, c
                left[node] = grow(rows[below], at + 1)
                right[node] = grow(rows[~below], at + 1)
            return node

        grow(x, 0)
        return tuple(map(np.array, (feature, cut, left, right, depth)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, depth in self.forest:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] < cut[at], left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** -(total / len(self.forest) / (self.norm or 1.0))

    def importance(self) -> np.ndarray:
        return self.used / (self.used.sum() or 1.0)


class LocalOutlierFactor:
    """Density of a row against that of its k nearest fitted rows (Breunig et al. 2000).

    Fitted rows that are scored again are new rows and may be their own neighbours.
    """

    def __init__(self, k: int = 35, block: int = 512):
        self.k, self.block = k, block

    def _near(self, x: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        ids, far = [], []
        for at in range(0, len(x), self.block):
            part = x[at : at + self.block]
            d = np.sqrt(np.maximum((part**2).sum(1)[:, None] - 2 * part @ self.x.T + (self.x**2).sum(1), 0))
            if own:
                d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            best = np.argsort(d, 1, kind="stable")[:, :k]
            ids.append(best)
            far.append(np.take_along_axis(d, best, 1))
        return np.concatenate(ids), np.concatenate(far)

    def fit(self, x: np.ndarray) -> LocalOutlierFactor:
        self.x, self.n = x, min(max(2, self.k), len(x) - 1)
        ids, far = self._near(x, self.n, True)
        self.radius = far[:, -1]
        self.density = 1 / (np.maximum(far, self.radius[ids]).mean(1) + 1e-10)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        ids, far = self._near(x, self.n, False)
        own = 1 / (np.maximum(far, self.radius[ids]).mean(1) + 1e-10)
        return self.density[ids].mean(1) / own


class OneClassSvm:
    """Support of the rows under a radial kernel, nu of them outside; pairwise optimisation."""

    def __init__(self, nu: float = 0.05, steps: int = 20_000, tolerance: float = 1e-4):
        self.nu, self.steps, self.tolerance = nu, steps, tolerance

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))

    def fit(self, x: np.ndarray) -> OneClassSvm:
        n = len(x)
        self.gamma = 1 / (x.shape[1] * (x.var() or 1.0))
        top = 1 / (self.nu * n)
        a = np.zeros(n)
        full = int(self.nu * n)
        a[:full] = top
        if full < n:
            a[full] = 1 - full * top
        k = self._kernel(x, x)
        g = k @ a
        for _ in range(self.steps):
            up, down = np.where(a < top - 1e-12, g, np.inf), np.where(a > 1e-12, g, -np.inf)
            i, j = int(up.argmin()), int(down.argmax())
            if g[j] - g[i] < self.tolerance:
                break
            move = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - a[i], a[j])
            a[i] += move
            a[j] -= move
            g += move * (k[i] - k[j])
        free = (a > 1e-10) & (a < top - 1e-10)
        self.rho = g[free].mean() if free.any() else g[a > 0].max()
        self.x, self.a = x[a > 1e-10], a[a > 1e-10]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._kernel(x, self.x) @ self.a


class PcaReconstruction:
    """Mean squared error after keeping the components with 95 per cent of the variance."""

    def __init__(self, keep: float = 0.95):
        self.keep = keep

    def fit(self, x: np.ndarray) -> PcaReconstruction:
        self.mean = x.mean(0)
        _, s, v = np.linalg.svd(x - self.mean, full_matrices=False)
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        self.v = v[: int(np.searchsorted(share, self.keep)) + 1]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        d = x - self.mean
        return ((d - d @ self.v.T @ self.v) ** 2).mean(1)


class LstmAutoencoder:
    """Encoder, latent layer and decoder over windows of rows in order; squared errors by step.

    Both sides are stacks of `layers`, with dropout between layers while fitting. Adam on the
    mean squared error; the last share of the windows validates, training stops after
    `patience` epochs without gain and the best weights come back. The defaults are the
    reference's; `most_windows` windows, evenly spread, are fitted at most.
    """

    def __init__(self, length: int = 10, stride: int = 10, hidden: int = 128, latent: int = 64, layers: int = 2, dropout: float = 0.2, rate: float = 0.001, batch: int = 256, epochs: int = 100, validation: float = 0.15, patience: int = 15, most_windows: int = 5000, seed: int = 42):
        if length < 2:
            raise ValueError("a window has two rows or more")
        if not 1 <= stride <= length:
            raise ValueError("the stride is from 1 to the window's length")
        if min(hidden, latent, layers, batch, epochs, most_windows) < 1:
            raise ValueError("sizes, layers, batch, epochs and windows are positive")
        if not 0 <= dropout < 1 or not 0 <= validation < 0.5:
            raise ValueError("dropout is from 0 to below 1, validation from 0 to below 0.5")
        self.length, self.stride, self.hidden, self.latent, self.layers, self.dropout = length, stride, hidden, latent, layers, dropout
        self.rate, self.batch, self.epochs, self.validation, self.patience, self.most, self.seed = rate, batch, epochs, validation, patience, most_windows, seed
        self.history: list[dict[str, Any]] = []

    def parameters(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("length", "stride", "hidden", "latent", "layers", "dropout", "rate", "batch", "epochs", "validation", "patience", "most", "seed")}

    def _init(self, d: int) -> None:
        rng, h, z = np.random.default_rng(self.seed), self.hidden, self.latent
        shapes: dict[str, tuple] = {"Wz": (h, z), "bz": (z,), "Wo": (h, d), "bo": (d,)}
        for side, width in (("e", d), ("d", z)):
            for k in range(self.layers):
                shapes |= {f"W{side}{k}": ((h if k else width) + h, 4 * h), f"b{side}{k}": (4 * h,)}
        self.p = {k: rng.normal(0, (s[0]) ** -0.5, s) if len(s) == 2 else np.zeros(s) for k, s in shapes.items()}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def _run(self, inputs: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> list[tuple]:
        n, h = len(inputs[0]), self.hidden
        state, cell, kept = np.zeros((n, h)), np.zeros((n, h)), []
        for x in inputs:
            xh = np.concatenate([x, state], 1)
            a = xh @ w + b
            i, f, o, g = self._sigmoid(a[:, :h]), self._sigmoid(a[:, h : 2 * h] + 1), self._sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            t = np.tanh(cell)
            state = o * t
            kept.append((xh, i, f, o, g, before, t, state))
        return kept

    def _back(self, kept: list[tuple], w: np.ndarray, outer: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        h, dw, db = self.hidden, np.zeros_like(w), np.zeros(w.shape[1])
        dh, dc, dx = np.zeros_like(kept[0][7]), np.zeros_like(kept[0][7]), []
        for (xh, i, f, o, g, before, t, _), extra in zip(reversed(kept), reversed(outer), strict=True):
            dh = dh + extra
            dc = dc + dh * o * (1 - t**2)
            a = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g**2)], 1)
            dw += xh.T @ a
            db += a.sum(0)
            back = a @ w.T
            dx.append(back[:, : xh.shape[1] - h])
            dh, dc = back[:, xh.shape[1] - h :], dc * f
        return dw, db, dx[::-1]

    def _stack(self, side: str, inputs: list[np.ndarray], rng: np.random.Generator | None) -> tuple[list, list]:
        """States of each layer by step, and the dropout masks between layers."""
        runs, masks = [], []
        for k in range(self.layers):
            runs.append(self._run(inputs, self.p[f"W{side}{k}"], self.p[f"b{side}{k}"]))
            inputs = [step[7] for step in runs[-1]]
            masks.append([(rng.random(x.shape) >= self.dropout) / (1 - self.dropout) for x in inputs] if rng is not None and self.dropout and k + 1 < self.layers else None)
            if masks[-1]:
                inputs = [x * m for x, m in zip(inputs, masks[-1], strict=True)]
        return runs, masks

    def _unstack(self, side: str, runs: list, masks: list, outer: list[np.ndarray], grads: dict) -> list[np.ndarray]:
        for k in reversed(range(self.layers)):
            if masks[k]:
                outer = [x * m for x, m in zip(outer, masks[k], strict=True)]
            grads[f"W{side}{k}"], grads[f"b{side}{k}"], outer = self._back(runs[k], self.p[f"W{side}{k}"], outer)
        return outer

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        steps = x.shape[1]
        enc = self._stack("e", [x[:, t] for t in range(steps)], rng)
        z = enc[0][-1][-1][7] @ self.p["Wz"] + self.p["bz"]
        dec = self._stack("d", [z] * steps, rng)
        return np.stack([k[7] @ self.p["Wo"] + self.p["bo"] for k in dec[0][-1]], 1), (enc, dec)

    def gradients(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        y, (enc, dec) = self.forward(x, rng)
        error, steps = 2 * (y - x) / x.size, x.shape[1]
        g = {"Wo": sum(k[7].T @ error[:, t] for t, k in enumerate(dec[0][-1])), "bo": error.sum((0, 1))}
        dz = sum(self._unstack("d", *dec, [error[:, t] @ self.p["Wo"].T for t in range(steps)], g))
        last = enc[0][-1][-1][7]
        g["Wz"], g["bz"] = last.T @ dz, dz.sum(0)
        self._unstack("e", *enc, [np.zeros_like(last)] * (steps - 1) + [dz @ self.p["Wz"].T], g)
        return float(((y - x) ** 2).mean()), g

    def starts(self, n: int) -> tuple[int, np.ndarray]:
        """The length of windows over n rows, and where they begin: every stride, and one that ends at the last row."""
        length = min(self.length, n)
        return length, np.unique(np.append(np.arange(0, n - length + 1, min(self.stride, length)), n - length))

    def fitted_starts(self, n: int) -> tuple[int, np.ndarray]:
        length, starts = self.starts(n)
        return length, starts if len(starts) <= self.most else starts[np.linspace(0, len(starts) - 1, self.most, dtype=int)]

    def _windows(self, x: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
        return x[starts[:, None] + np.arange(length)]

    def fit(self, x: np.ndarray, tell: Callable[..., None] = lambda **event: None) -> LstmAutoencoder:
        """Fits on rows that follow one another."""
        return self.fit_windows(self._windows(x, *self.fitted_starts(len(x))), tell)

    def fit_windows(self, w: np.ndarray, tell: Callable[..., None] = lambda **event: None) -> LstmAutoencoder:
        self._init(w.shape[2])
        held = round(len(w) * self.validation)
        held = 0 if held >= len(w) - 1 else held
        train, check = w[: len(w) - held], w[len(w) - held :]
        tell(event="lstm_started", epochs=self.epochs, training_windows=len(train), validation_windows=held, sequence_length=w.shape[1], input_features=w.shape[2])
        rng, moments, step = np.random.default_rng(self.seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        best, stalled, kept, self.history = np.inf, 0, self.p, []
        for epoch in range(1, self.epochs + 1):
            total, order = 0.0, rng.permutation(len(train))
            for at in range(0, len(order), self.batch):
                part = train[order[at : at + self.batch]]
                loss, grads = self.gradients(part, rng)
                total += loss * len(part)
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            known = float(((self.forward(check)[0] - check) ** 2).mean()) if held else None
            watched = total / len(train) if known is None else known
            stalled = 0 if watched < best - 1e-8 else stalled + 1
            if not stalled:
                best, kept = watched, {k: v.copy() for k, v in self.p.items()}
            self.history.append({"epoch": epoch, "train_loss": total / len(train), "validation_loss": known, "learning_rate": self.rate, "best_loss": best, "stalled_epochs": stalled})
            tell(event="epoch", epochs=self.epochs, **self.history[-1])
            if stalled >= self.patience:
                break
        self.p = kept
        tell(event="lstm_completed", epochs=self.epochs, epochs_completed=len(self.history), best_loss=best, stopped_early=len(self.history) < self.epochs)
        return self

    def errors(self, w: np.ndarray) -> np.ndarray:
        """Mean squared error of each step of each window."""
        return ((self.forward(w)[0] - w) ** 2).mean(2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """A row's mean error over the windows that cover it; rows are in order."""
        length, starts = self.starts(len(x))
        total, n = np.zeros(len(x)), np.zeros(len(x))
        at = starts[:, None] + np.arange(length)
        np.add.at(total, at, self.errors(self._windows(x, length, starts)))
        np.add.at(n, at, 1)
        return total / n


DETECTORS: dict[str, Callable[[], Detector]] = {"isolation_forest": IsolationForest, "local_outlier_factor": LocalOutlierFactor, "one_class_svm": OneClassSvm, "pca_reconstruction": PcaReconstruction, "lstm_autoencoder": LstmAutoencoder}


def _matrix(values: pd.Series) -> np.ndarray:
    return finite(np.array([np.asarray(v, float) for v in values]))


def _moments(df: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix of a vector column, from sums over all rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = 0, None, None
        for batch in batches:
            if len(batch):
                x = _matrix(batch[features])
                n += len(x)
                first = x.sum(0) if first is None else first + x.sum(0)
                second = x.T @ x if second is None else second + x.T @ x
        if n:
            yield pd.DataFrame({"n": n, "at": np.arange(first.size * (first.size + 1)), "v": np.concatenate([first, second.ravel()])})

    made = df.select(features).mapInPandas(sums, "n long, at int, v double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("at").collect()
    n, d = made[0]["n"], int(np.sqrt(len(made)))
    total = np.array([r["v"] for r in made])
    mean = total[:d] / n
    return n, mean, total[d:].reshape(d, d) - n * np.outer(mean, mean)


def fit_detector(df: DataFrame, features: str, detector: Detector, key: str, fit_rows: int = 5000, seed: int = 42, tell: Callable[..., None] = lambda **event: None) -> Detector:
    """Fits a detector on what it needs of the rows, which bounds what the driver holds.

    A detector over windows gets whole windows of rows that follow one another in the key's
    order, spread evenly over all of them; principal components come from sums over all
    rows; a forest gets as many rows as its trees sample in all; any other one gets the
    `fit_rows` rows with the smallest seeded hash of the key (all rows, if there are no more).
    """
    if isinstance(detector, LstmAutoencoder):
        rows = prepare.with_row_id(df.select(F.col(key).alias("key__"), features), "key__")
        length, starts = detector.fitted_starts(rows.count())
        places = np.unique(starts[:, None] + np.arange(length))
        wanted = df.sparkSession.createDataFrame(pd.DataFrame({"row_id": places}))
        found = rows.join(F.broadcast(wanted), "row_id").select("row_id", features).toPandas().sort_values("row_id")
        x = _matrix(found[features])
        return detector.fit_windows(x[np.searchsorted(places, starts)[:, None] + np.arange(length)], tell)
    if isinstance(detector, PcaReconstruction):
        _, detector.mean, scatter = _moments(df, features)
        values, vectors = np.linalg.eigh(scatter)
        values = np.maximum(values[::-1], 0)
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        detector.v = vectors[:, ::-1].T[: int(np.searchsorted(share, detector.keep)) + 1]
        return detector
    if isinstance(detector, IsolationForest):
        fit_rows = detector.trees * detector.sample
    drawn = df.select(key, features).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(fit_rows).toPandas().sort_values(key)
    return detector.fit(_matrix(drawn[features]))


def score_detector(df: DataFrame, features: str, detector: Detector, key: str, out: str = "anomaly_score", span: int = 10_000) -> DataFrame:
    """Adds a score to every row. A detector over windows gets runs of about `span` rows in the
    key's order, each with the rows of the next run that its last windows reach into."""
    shared = df.sparkSession.sparkContext.broadcast(detector)
    if not isinstance(detector, LstmAutoencoder):

        @F.pandas_udf("double")
        def score(batch: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(_matrix(batch))) if len(batch) else pd.Series(dtype=float)

        return df.withColumn(out, score(F.col(features)))

    rows = prepare.with_row_id(df.select(F.col(key).alias("key__"), features), "key__").withColumnRenamed("row_id", "place__")
    n = rows.count()
    length = min(detector.length, n)
    stride = min(detector.stride, length)
    span = max(span // stride, 1) * stride
    last = n - length

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place__")
        place, x, run = part["place__"].to_numpy(), _matrix(part[features]), int(part["run__"].iloc[0])
        starts = np.arange(run * span, min((run + 1) * span, last + 1), stride)
        if run * span <= last < (run + 1) * span and last % stride:
            starts = np.append(starts, last)
        at = starts[:, None] - place[0] + np.arange(length)
        total, covered = np.zeros(len(x)), np.zeros(len(x), np.int64)
        if len(starts):
            np.add.at(total, at, shared.value.errors(x[at]))
            np.add.at(covered, at, 1)
        return pd.DataFrame({"place__": place, "e__": total, "c__": covered})

    run = F.floor(F.col("place__") / span)
    also = F.when((F.col("place__") % span < length - 1) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
    parts = rows.select("place__", features, F.explode(also).alias("run__")).groupBy("run__").applyInPandas(of, "place__ long, e__ double, c__ long")
    means = parts.groupBy("place__").agg((F.sum("e__") / F.sum("c__")).alias(out))
    scored = rows.select("key__", "place__").join(means, "place__").drop("place__")
    return df.join(scored, F.col(key) == F.col("key__")).drop("key__")


class Nearest:
    """For each query the k first points by distance, then key, found block by block.

    A matrix product with a margin for its error tells which points can be among them; their
    distances are then summed up dimension by dimension, so that copies are at exactly 0.
    """

    def __init__(self, q: np.ndarray, k: int, most: int = 200_000):
        self.q, self.k, self.most, self.size = q, k, most, (q**2).sum(1)
        self.far, self.key, self.of = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k), np.int64)
        self.filled = np.zeros(len(q), np.int64)

    def add(self, x: np.ndarray, key: np.ndarray, of: np.ndarray) -> None:
        size = (x**2).sum(1)
        d = self.q @ x.T
        d *= -2
        d += self.size[:, None]
        d += size
        margin = 1e-12 * (self.size + size.max())
        bound = self.far[:, -1] ** 2 * (1 + 1e-12)
        if len(x) >= self.k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(d, self.k - 1, 1)[:, self.k - 1] + margin)
        near = ~(d > (bound + margin)[:, None])
        # Queries whose points may change, as many at once as have `most` candidates.
        total = np.cumsum(near.sum(1))
        for rows in np.split(np.arange(len(near)), np.flatnonzero(np.diff(total // self.most)) + 1):
            i, j = np.nonzero(near[rows])
            if not i.size:
                continue
            own, far = rows[np.unique(i)], np.zeros(len(i))
            a, b = self.q[rows[i]].T, x[j].T
            for u, v in zip(a, b, strict=True):
                far += (u - v) ** 2
            there = np.arange(self.k) < self.filled[own, None]
            row = np.concatenate([np.repeat(own, self.filled[own]), rows[i]])
            far, keys, ofs = (np.concatenate(pair) for pair in ((self.far[own][there], np.sqrt(far)), (self.key[own][there], key[j]), (self.of[own][there], of[j])))
            order = np.lexsort((keys, far, row))
            row, begin = row[order], np.searchsorted(row[order], row[order])
            place = np.arange(len(row)) - begin
            kept = place < self.k
            at, order = (row[kept], place[kept]), order[kept]
            self.far[at], self.key[at], self.of[at] = far[order], keys[order], ofs[order]
            self.filled[own] = np.minimum(np.bincount(row, minlength=len(self.q))[own], self.k)


def local_outliers(df: DataFrame, features: str, key: str, k: int = 35, out: str = "anomaly_score") -> DataFrame:
    """The local outlier factor of every row among all rows, exactly: the key and its score.

    The neighbours of a row's density are the k nearest other rows, those it is compared with
    may have it among them, as when fitted rows are scored again; ties go to the smaller key,
    a distinct whole number. A table of one row has a null score. Rows with equal vectors have
    equal scores, so only the first one asks for neighbours and k + 1 of them can be some. Blocks
    of about 1 MB of vectors meet pairwise: the work grows with the square of the distinct
    vectors, what a task holds does not.
    """
    spark, wide = df.sparkSession, k + 1
    number = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    rows = df.select(F.col(key).cast("long").alias("key"), F.transform(F.col(features).cast("array<double>"), number).alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    height = max(64, min(2048, (1 << 17) // max(width or 0, 1)))
    in_class = Window.partitionBy("v").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = checkpointed(rows.withColumns({"copy": F.row_number().over(in_class), "of": F.min("key").over(in_class)}).where(F.col("copy") <= wide))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        x = np.array(part["v"].tolist(), float)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "n": [len(x)], "keys": [part["key"].to_numpy(np.int64).tobytes()], "ofs": [part["of"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    count = max(1, -(-n // height))
    blocks = checkpointed(points.withColumn("block", F.pmod(F.xxhash64(F.lit(42), "key"), F.lit(count))).groupBy("block").applyInPandas(pack, "block long, n long, keys binary, ofs binary, x binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.frombuffer(row[f"{side}keys"], np.int64), np.frombuffer(row[f"{side}ofs"], np.int64), np.frombuffer(row[f"{side}x"]).reshape(row[f"{side}n"], -1)

        def told() -> pa.RecordBatch:
            there = np.arange(wide) < best.filled[:, None]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (np.repeat(asks, best.filled), best.far[there], best.key[there], best.of[there])], names=["q", "d", "key", "of"])

        now, best, asks = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["qblock"] != now:
                    if best is not None:
                        yield told()
                    keys, ofs, x = read(row, "q")
                    now, asks, best = row["qblock"], keys[keys == ofs], Nearest(x[keys == ofs], wide)
                keys, ofs, x = read(row, "")
                best.add(x, keys, ofs)
        if best is not None:
            yield told()

    asking = blocks.select(*[F.col(c).alias(f"q{c}") for c in blocks.columns]).repartition(count)
    pairs = asking.crossJoin(blocks.repartition(-(-count // 64)).hint("shuffle_replicate_nl"))
    size, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set(size, "8m")
    try:
        found = checkpointed(pairs.mapInArrow(meet, "q long, d double, key long, of long").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "key", "of"))), 1, wide).alias("t")))
    finally:
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)

    others = F.slice(F.filter("t", lambda p: p["key"] != F.col("q")), 1, k)
    radii = checkpointed(found.select(F.col("q").alias("of"), F.array_max(F.transform(others, lambda p: p["d"])).alias("radius")))

    def density(near: DataFrame) -> DataFrame:
        return near.join(radii, "of").groupBy("q").agg((1 / (F.avg(F.greatest("d", "radius")) + 1e-10)).alias("density"))

    densities = checkpointed(density(found.select("q", F.explode(others).alias("p")).select("q", "p.d", "p.of")))
    around = found.select("q", F.explode(F.slice("t", 1, k)).alias("p")).select("q", "p.d", "p.of")
    beside = around.join(densities.select(F.col("q").alias("of"), F.col("density").alias("near")), "of").groupBy("q").agg(F.avg("near").alias("near"))
    scores = checkpointed(density(around).join(beside, "q").select(F.col("q").alias("of"), (F.col("near") / F.col("density")).alias(out)))
    first = points.join(scores, "of", "left").select("key", out)
    # Of vectors with more copies than that, each of which stands for k + 1 rows at least.
    full = points.where(F.col("copy") == wide).select("v", "of").join(scores, "of", "left").select("v", out)
    rest = rows.join(points.select("key"), "key", "left_anti").join(F.broadcast(full), "v").select("key", out)
    return first.unionAll(rest).withColumnRenamed("key", key)


def permutation_importance(df: DataFrame, features: str, detector: Detector, names: list[str], key: str, most: int = 4000, seed: int = 42) -> list[tuple[str, float]]:
    """Mean change of the score when one column of an evenly spread sample is shuffled."""
    rows = prepare.with_row_id(df.select(F.col(key).alias("key__"), features), "key__")
    x = _matrix(prepare.systematic_sample(rows, "row_id", rows.count(), most).toPandas().sort_values("row_id")[features])
    rng, base, found = np.random.default_rng(seed), detector.score(x), []
    for k, name in enumerate(names):
        y = x.copy()
        y[:, k] = rng.permutation(y[:, k])
        found.append((name, float(np.abs(detector.score(y) - base).mean())))
    return found


def importance(df: DataFrame, features: str, detector: Detector, names: list[str], key: str) -> tuple[str, list[tuple[str, float]]]:
    """How, and how much, each input matters: a forest by its splits, others by permutation."""
    if isinstance(detector, IsolationForest):
        return "isolation_tree_split_gain", list(zip(names, detector.importance().tolist(), strict=True))
    return "permutation_score_shift", permutation_importance(df, features, detector, names, key)


def raw_feature(column: str, features: list[str]) -> str:
    """The feature that an input column comes from: the longest name that it equals or begins with."""
    return next((f for f in sorted(features, key=len, reverse=True) if column == f or column.startswith(f"{f}_")), column)


def save_detector(detector: Detector, path: str, **about: Any) -> None:
    """Arrays as NPZ and all else as JSON, side by side; nothing in it is executable."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    state = {k: v for k, v in vars(detector).items() if not callable(v)}
    arrays: dict[str, np.ndarray] = {}

    def plain(name: str, value: Any) -> Any:
        if isinstance(value, np.ndarray):
            arrays[name] = value
            return {"array": name}
        if isinstance(value, dict):
            return {k: plain(f"{name}.{k}", v) for k, v in value.items()}
        if isinstance(value, list | tuple):
            return [plain(f"{name}.{k}", v) for k, v in enumerate(value)]
        return value.item() if isinstance(value, np.generic) else value

    body = {"detector": type(detector).__name__, "state": {k: plain(k, v) for k, v in state.items()}} | about
    np.savez(target.with_suffix(".npz"), **arrays)
    target.with_suffix(".json").write_text(json.dumps(body, indent=1))


def load_detector(path: str) -> Detector:
    target = Path(path)
    body, arrays = json.loads(target.with_suffix(".json").read_text()), np.load(target.with_suffix(".npz"))

    def back(value: Any) -> Any:
        if isinstance(value, dict):
            return arrays[value["array"]] if set(value) == {"array"} else {k: back(v) for k, v in value.items()}
        return [back(v) for v in value] if isinstance(value, list) else value

    detector = {c.__name__: c for c in (IsolationForest, LocalOutlierFactor, OneClassSvm, PcaReconstruction, LstmAutoencoder)}[body["detector"]]()
    vars(detector).update(back(body["state"]))
    return detector
