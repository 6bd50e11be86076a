"""A convolutional text classifier for toxicity, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import Scratch, releasing, sifted, small_batches, without
from packetloom.operators.prepare import running_sums

#: Rows of the embedding table (row 0 pads), its width, filter widths and filters of each.
ROWS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
#: Words of one step of scoring; a longer text is scored in overlapping steps.
STEP = 1 << 17
STRIP = b".,;:!?\"'()[]"
#: Whole passes over the labelled rows at least, where they are dealt into several shards; sums that meet in one task.
PASSES, MET = 4, 16


class WordRows(dict):
    """For a word, two rows of the embedding table in one number: its own and its first five bytes'."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        bare = word.strip(STRIP)
        own, start = (1 + xxhash.xxh32_intdigest(x, seed) % (ROWS - 1) for seed, x in ((1, bare), (2, bare[:5])))
        both = own << 32 | start
        if len(word) <= 64:
            self[word] = both
        return both


def word_rows(cache: WordRows, text: str | None) -> np.ndarray:
    """A text's words as pairs of rows, padded so that every filter fits; without words, padding alone."""
    words = (text or "").lower().encode().split()
    out = np.zeros((max(1, len(words)) + max(WIDTHS) - 1, 2), np.int32)
    both = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    out[: len(words), 0], out[: len(words), 1] = both >> 32, both & 0xFFFFFFFF
    return out


class Model:
    """Word embeddings, convolutions of several widths, the maximum of each, a logistic unit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32), "v": np.zeros(len(WIDTHS) * FILTERS, np.float32), "c": np.zeros(1, np.float32)}
        self.p["v"][:] = rng.normal(0, 0.3, self.p["v"].shape)
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["e"][0] = 0

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        e = self.p["e"]
        return e[rows[:, 0]] + e[rows[:, 1]]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter and where it begins."""
        best, where = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
        for at in range(0, len(rows) - max(WIDTHS) + 1, STEP):
            x = self._windows(rows[at : at + STEP + max(WIDTHS) - 1])
            n = len(x) - max(WIDTHS) + 1
            for k, w in enumerate(WIDTHS):
                y = sum(x[j : j + n] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)) + self.p[f"b{w}"]
                top = y.argmax(0)
                high, own = y[top, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                better = high > best[own]
                where[own] = np.where(better, top + at, where[own])
                best[own] = np.where(better, high, best[own])
        return np.maximum(best, 0), where

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.pooled(rows)[0] @ self.p["v"] + self.p["c"][0]))))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, steps: int, rate: float = 0.01, batch: int = 32, seed: int = 5, weights: np.ndarray | None = None) -> Model:
        """Adam on the (weighted) logistic loss in whole passes; only the windows that won the pooling get a gradient."""
        rng, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        while step < steps:
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                grad = {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"}
                touched_rows, touched_grads = [], []
                part = order[lo : lo + batch]
                for i in part:
                    rows = texts[i]
                    best, where = self.pooled(rows)
                    error = 1 / (1 + np.exp(-(best @ self.p["v"] + self.p["c"][0]))) - labels[i]
                    if weights is not None:
                        error = error * weights[i]
                    grad["v"] += error * best
                    grad["c"] += error
                    back = error * self.p["v"] * (best > 0)
                    for k, w in enumerate(WIDTHS):
                        for f in np.flatnonzero(back[k * FILTERS : (k + 1) * FILTERS]):
                            g, at = back[k * FILTERS + f], where[k * FILTERS + f]
                            x = self._windows(rows[at : at + w])
                            grad[f"w{w}"][: x.size, f] += g * x.ravel()
                            grad[f"b{w}"][f] += g
                            to = (g * self.p[f"w{w}"][: x.size, f]).reshape(-1, DIM)
                            for col in (0, 1):
                                touched_rows.append(rows[at : at + w, col])
                                touched_grads.append(to)
                step += 1
                lr = rate * (1 - 0.9**step) ** -1 * (1 - 0.999**step) ** 0.5
                for k, g in grad.items():
                    m, v = moments[k]
                    g = g / len(part)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= lr * m / (np.sqrt(v) + 1e-8)
                if touched_rows:
                    ids, inverse = np.unique(np.concatenate(touched_rows), return_inverse=True)
                    g = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(g, inverse, np.concatenate(touched_grads) / len(part))
                    m, v = moments["e"]
                    m[ids] += 0.1 * (g - m[ids])
                    v[ids] += 0.001 * (g * g - v[ids])
                    self.p["e"][ids] -= lr * m[ids] / (np.sqrt(v[ids]) + 1e-8)
                    self.p["e"][0] = 0
        return self


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap below which the F1 value is highest; 0.5 if a class is missing."""
    if len(scores) == 0 or labels.min() == labels.max():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.02, 0.98))


def best_thresholds(scored: DataFrame) -> dict[str, float]:
    """`best_threshold` of each language's rows (lang, score, toxic), without all scores of one in one task."""
    counted = scored.groupBy("lang", (-F.col("score")).alias("s")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    ranked = running_sums(counted, ["s"], {"n_before": F.col("n"), "hits_before": F.col("hits")}, ("lang",)).select("lang", "s", (F.col("n_before") + F.col("n")).alias("n"), (F.col("hits_before") + F.col("hits")).alias("hits"))
    whole = scored.groupBy("lang").agg(F.sum("toxic").alias("all_hits"), F.count("*").alias("all"))
    f1 = 2 * F.col("hits") / (F.col("n") + F.col("all_hits"))
    best = ranked.join(whole.where("all_hits > 0 and all_hits < all"), "lang").groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), (-F.col("s")).alias("score")))["score"].alias("high"))
    below = ranked.join(best, "lang").groupBy("lang", "high").agg(F.max(F.when(-F.col("s") < F.col("high"), -F.col("s"))).alias("low"))
    found = whole.select("lang").join(below, "lang", "left").orderBy("lang").collect()
    return {r["lang"]: 0.5 if r["high"] is None else float(np.clip((r["high"] + (r["low"] or 0)) / 2, 0.02, 0.98)) for r in found}


def _fit_shards(packed: DataFrame, model: Model, dealt: int, weights: tuple[float, float], steps: int, rounds: int) -> Model:
    """Every round starts each shard from the same model and takes the mean of what they learned.

    A row of the embedding table counts for the shards that have its words. Sums of up to
    `MET` shards meet in a task, again and again, so the driver gets one, whatever their number.
    """
    spark, shards, names = packed.sparkSession, packed.count(), [k for k in model.p if k != "e"]

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("shard")
        total = sum(np.frombuffer(v) for v in parts["learned"])
        return pd.DataFrame({"shard": [parts["shard"].iloc[0] // MET], "learned": [total.tobytes()]})

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    own, before = Model(), shared.value.p
                    own.p = {k: v.copy() for k, v in before.items()}
                    words, labels = np.frombuffer(r.words, np.uint16).reshape(-1, 2).astype(np.int32), np.frombuffer(r.labels, np.float32)
                    texts = np.split(words, np.cumsum(np.frombuffer(r.sizes, np.int64))[:-1])
                    own.fit(texts, labels, steps, seed=5 + turn * dealt + r.shard, weights=np.where(labels > 0, weights[1], weights[0]).astype(np.float32))
                    change = {k: v.astype(float) - before[k] for k, v in own.p.items()}
                    learned = np.concatenate([*[change[k].ravel() for k in names], change["e"].ravel(), change["e"].any(1).astype(float)])
                    yield pd.DataFrame({"shard": [r.shard], "learned": [learned.tobytes()]})

        made, left = packed.mapInPandas(releasing(learn), "shard long, learned binary"), dealt
        while left > 1:
            made, left = made.groupBy(F.expr(f"shard div {MET}").alias("met")).applyInPandas(added, "shard long, learned binary"), ceil(left / MET)
        with small_batches(spark):
            total, at, after = np.frombuffer(made.collect()[0]["learned"]), 0, Model()
        shared.destroy()
        for k in names:
            size = model.p[k].size
            after.p[k], at = (model.p[k] + total[at : at + size].reshape(model.p[k].shape) / shards).astype(np.float32), at + size
        e, touched = total[at : at + ROWS * DIM].reshape(ROWS, DIM), total[at + ROWS * DIM :]
        after.p["e"] = (model.p["e"] + e / np.maximum(touched, 1)[:, None]).astype(np.float32)
        model = after
    return model


def train(docs: DataFrame, labels: DataFrame, *, shard_rows: int = 4000, steps: int = 800, sample_chars: int = 40_000_000) -> tuple[Model, dict[str, float]]:
    """Fits the model and one threshold per language on all labelled rows.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used, but each of those, with its
    whole text: remainder 1 serves for the thresholds, 2 to 4 for the model. Texts are read as
    words once, and dealt by a hash of their doc_id into shards of `shard_rows` rows and
    `sample_chars` characters on average, which bounds what a task holds; the driver holds the
    model. A single shard makes `steps` steps and ends its pass; more of them make as many
    in all, `PASSES` passes at least, and meet after each (`_fit_shards`). Both kinds of
    labels have the same weight in all. A document with labels that differ counts as toxic if
    one says so; of texts that share a doc_id the smallest one trains.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    known = known.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).where("fold <> 0")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordRows()
        for batch in batches:
            batch["words"] = [word_rows(cache, t).astype(np.uint16).tobytes() for t in batch["text"]]
            yield batch[["doc_id", "toxic", "fold", "lang", "chars", "words"]]

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "doc_id"])
        sizes = np.array([len(w) // 4 for w in part["words"]], np.int64)
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "labels": [part["toxic"].to_numpy(np.float32).tobytes()], "sizes": [sizes.tobytes()], "words": [b"".join(part["words"])]})

    with Scratch(spark) as scratch:
        known = scratch.keep(known, "labels")
        there = sifted(docs.where(F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)), known.select("doc_id"), "doc_id", known.count())
        found = there.join(known, "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min(F.struct("text", "lang")).alias("t"))
        texts = found.select("doc_id", "toxic", "fold", F.coalesce("t.lang", F.lit("")).alias("lang"), F.length("t.text").cast("long").alias("chars"), "t.text")
        texts = scratch.keep(texts.mapInPandas(releasing(read), "doc_id long, toxic int, fold long, lang string, chars long, words binary"), "words")
        fit, model = texts.where("fold <> 1"), Model()
        n, hits, chars = fit.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
        if 0 < hits < n:
            shards = max(ceil(n / shard_rows), ceil(chars / sample_chars))
            dealt = fit.withColumn("h", F.xxhash64(F.lit(17), "doc_id")).withColumn("shard", F.pmod("h", F.lit(shards)))
            packed = dealt.groupBy("shard").applyInPandas(pack, "shard long, labels binary, sizes binary, words binary")
            packed = scratch.keep(packed.repartition(shards), "shards")
            weights = (n / (2 * (n - hits)), n / (2 * hits))
            rounds = 1 if shards == 1 else max(PASSES, ceil(steps * 32 / n))
            model = _fit_shards(packed, model, shards, weights, steps if shards == 1 else 1, rounds)
        else:
            model.p["c"][0] = -4
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def score(words: pd.Series) -> pd.Series:
            return pd.Series([shared.value.score(np.frombuffer(w, np.uint16).reshape(-1, 2).astype(np.int32)) for w in words], dtype=float)

        scored = scratch.keep(texts.where("fold = 1").select("lang", "toxic", score("words").alias("score")), "scored")
        return model, best_thresholds(scored)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> DataFrame:
    """Adds score (0 to 1), threshold (of the row's language, 0.5 if none) and toxic.

    The score depends on the text alone. Every word of a text is read, a long text in
    overlapping steps. Null and empty texts get the score of a text without words; equal
    texts get equal scores; input columns with these three names are replaced; an empty
    table gives an empty result, and without labels of both kinds all scores are low. A row
    with a null doc_id is scored, but has no label and never trains.
    """
    model, thresholds = train(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordRows()
        for batch in batches:
            yield pd.Series([shared.value.score(word_rows(cache, t)) for t in batch], dtype=float)

    docs = without(docs, "score", "threshold", "toxic")
    by_lang = F.lit(0.5)
    for name, value in thresholds.items():
        by_lang = F.when(F.col(f"`{lang}`") == name, F.lit(value)).otherwise(by_lang)
    scored = docs.withColumn("score", score(F.col(f"`{text}`"))).withColumn("threshold", by_lang)
    return scored.withColumn("toxic", F.col("score") >= F.col("threshold"))
