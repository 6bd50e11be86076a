"""Model inputs: splits, imputation, scaling, category caps, one-hot columns and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.storage import checkpointed

TINY = 1e-12


def with_row_id(df: DataFrame, *order: str, parts: int = 0) -> DataFrame:
    """Adds row_id, the place from 0 in a total order, without sorting in one task.

    Rows are dealt by ranges of the order; each range is numbered on its own and the sizes
    of the ranges before it are added (one row per range). The dealt rows are checkpointed,
    as the sampled bounds of the ranges would differ if they were computed twice.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("mono__", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    dealt = dealt.withColumns({"part__": F.shiftright("mono__", 33), "place__": F.col("mono__").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("part__").agg(F.count("*").alias("n__"))
    before = sizes.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("first__"))
    return dealt.join(F.broadcast(before), "part__").withColumn("row_id", F.col("first__") + F.col("place__")).drop("mono__", "part__", "place__", "first__")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], keys: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Adds, for each output name, the sum of a column over the earlier rows of the key.

    Rows are dealt by ranges of keys and order, so neither a whole table nor the rows of a
    hot key are ordered in one task. Sums inside a range are windows; what a key has in
    earlier ranges is added from a table that only has the keys on a border, one for each
    range at most, and is broadcast. The order has to be total for a fixed result.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    dealt = df.withColumns({f"{c}__": v for c, v in sums.items()}).repartitionByRange(n, *by) if by else df
    dealt = checkpointed(dealt.withColumn("part__", F.spark_partition_id()))
    totals = dealt.groupBy("part__", *keys).agg(*[F.sum(f"{c}__").alias(f"{c}__t") for c in sums])
    # Only the first key of a range can have rows in earlier ranges; it has its smallest values there.
    firsts = totals.withColumn("k__", F.struct(F.lit(0), *keys)).groupBy("part__").agg(F.min("k__").alias("least__"))
    edge = totals.withColumn("k__", F.struct(F.lit(0), *keys)).join(F.broadcast(firsts), "part__")
    lasts = totals.withColumn("k__", F.struct(F.lit(0), *keys)).groupBy("part__").agg(F.max("k__").alias("most__"))
    border = edge.join(F.broadcast(lasts), "part__").where("k__ = least__ or k__ = most__")
    earlier = Window.partitionBy("k__").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    before = border.select("part__", F.col("k__"), *[F.sum(f"{c}__t").over(earlier).alias(f"{c}__b") for c in sums]).where(F.col(f"{next(iter(sums))}__b").isNotNull())
    within = Window.partitionBy("part__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("k__", F.struct(F.lit(0), *keys)).join(F.broadcast(before), ["part__", "k__"], "left")
    zero = {c: F.lit(0) for c in sums}
    return met.select(*df.columns, *[(F.coalesce(F.sum(f"{c}__").over(within), zero[c]) + F.coalesce(f"{c}__b", zero[c])).alias(c) for c in sums])


def quantiles(counts: DataFrame, keys: tuple[str, ...], value: str, n: str, shares: list[float]) -> DataFrame:
    """Exact quantiles by key, with linear interpolation, from the number `n` of rows of each distinct value.

    Returns the keys and q, an array. Places come from `running_sums`, so neither a sort nor
    a buffer of all values is in one task.
    """
    k = [f"k{i}__" for i in range(len(keys))]
    some = counts.where(F.col(value).isNotNull()).select(*[F.col(c).alias(x) for c, x in zip(keys, k, strict=True)], F.col(value).cast("double").alias("v__"), F.col(n).alias("n__"))
    total = some.groupBy(*[F.col(x).alias(f"t{x}") for x in k]).agg(F.sum("n__").alias("all__"))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"t{x}")) for x in k], F.lit(True))
    placed = running_sums(some, ["v__"], {"below__": F.col("n__")}, tuple(k)).join(F.broadcast(total), same)
    out = []
    for i, share in enumerate(shares):
        at = (F.col("all__") - 1) * F.lit(float(share))
        for name, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            out.append(F.max(F.when((F.col("below__") <= place) & (place < F.col("below__") + F.col("n__")), F.col("v__"))).alias(f"{name}{i}__"))
        out.append(F.max(at - F.floor(at)).alias(f"f{i}__"))
    made = placed.groupBy(*k).agg(*out)
    value_of = [F.col(f"l{i}__") + (F.col(f"h{i}__") - F.col(f"l{i}__")) * F.col(f"f{i}__") for i in range(len(shares))]
    return made.select(*[F.col(x).alias(c) for c, x in zip(keys, k, strict=True)], F.array(*value_of).alias("q"))


def random_split(df: DataFrame, row_id: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """A seeded share of the rows, wherever they stand, is the training part."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1 << 20)) < int(share * (1 << 20)))


def temporal_split(df: DataFrame, row_id: str, n: int, share: float = 0.8) -> DataFrame:
    """The first `share` of the rows in stored order is the training part."""
    boundary = max(1, min(n - 1, int(n * share)))
    return df.withColumn("is_train", F.col(row_id) < boundary)


def _filled_counts(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of the distinct values of each column with nulls as its median, and the medians; one pass over the rows."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v")
    counts = checkpointed(long.groupBy("name", "v").agg(F.count("*").alias("n")))
    medians = checkpointed(quantiles(counts, ("name",), "v", "n", [0.5]).select(F.col("name").alias("m__"), F.col("q")[0].alias("median")))
    filled = counts.join(F.broadcast(medians), F.col("name") == F.col("m__"), "left").select("name", F.coalesce("v", "median").alias("v"), "n")
    return checkpointed(filled.where("v is not null").groupBy("name", "v").agg(F.sum("n").alias("n"))), medians


def _spread(filled: DataFrame) -> DataFrame:
    """Mean and population deviation of each column from its counts."""
    means = filled.groupBy("name").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).withColumnRenamed("name", "a__")
    return filled.join(F.broadcast(means), F.col("name") == F.col("a__")).groupBy("name").agg(F.first("mean").alias("mean"), F.sqrt(F.sum((F.col("v") - F.col("mean")) ** 2 * F.col("n")) / F.sum("n")).alias("deviation"))


def _one_row(table: DataFrame, columns: list[str], named: dict[str, Column]) -> DataFrame:
    """A table by column name as a single row, with a column for each of `named` and each name."""
    return table.agg(*[F.max(F.when(F.col("name") == c, value)).alias(f"{k}_{c}") for k, value in named.items() for c in columns])


def fit_robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median and scale of each column after imputation by the median.

    The scale is the quartile distance, the population deviation where that is nil, else 1.
    """
    filled, _ = _filled_counts(df, columns)
    q = quantiles(filled, ("name",), "v", "n", [0.25, 0.5, 0.75]).withColumnRenamed("name", "q__")
    met = _spread(filled).join(F.broadcast(q), F.col("name") == F.col("q__"))
    width = F.col("q")[2] - F.col("q")[0]
    return _one_row(met, columns, {"m": F.col("q")[1], "w": F.when(width > TINY, width).when(F.col("deviation") > TINY, F.col("deviation")).otherwise(1.0)})


def fit_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median for imputation, then mean and population deviation."""
    filled, medians = _filled_counts(df, columns)
    met = _spread(filled).join(F.broadcast(medians), F.col("name") == F.col("m__"))
    return _one_row(met, columns, {"i": F.col("median"), "m": F.col("mean"), "w": F.when(F.col("deviation") > TINY, F.col("deviation")).otherwise(1.0)})


def scale(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(value - centre) / scale, nulls imputed; `fitted` is a single row."""
    impute = "i_" if f"i_{columns[0]}" in fitted.columns else "m_"
    met = df.join(F.broadcast(fitted))
    return met.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.col(f"{impute}{c}")) - F.col(f"m_{c}")) / F.col(f"w_{c}") for c in columns}).select(*df.columns)


def cap_categories(df: DataFrame, column: str, order: str, most: int = 50, other: str = "__OTHER__") -> DataFrame:
    """Keeps the `most` commonest values (ties: first seen) if there are more; nulls stay."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    kept = counts.orderBy(F.desc("n"), "first").limit(most).select(F.col(column).alias("kept__"))
    return df.join(F.broadcast(kept), F.col(column) == F.col("kept__"), "left").withColumn(column, F.when(F.col(column).isNull() | F.col("kept__").isNotNull(), F.col(column)).otherwise(other)).drop("kept__")


def mode(df: DataFrame, column: str) -> DataFrame:
    """The commonest value, the smallest of equals, as one row."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("mode"))


def one_hot(df: DataFrame, fit: DataFrame, column: str, most: int = 51) -> DataFrame:
    """A column per value seen in `fit` (more than `most` are an error); nulls as the mode, unknown values all 0."""
    values = [r[0] for r in fit.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values; cap its categories first")
    filled = df.join(F.broadcast(mode(fit, column)), F.lit(True), "left").withColumn("v__", F.coalesce(F.col(column), F.col("mode")))
    return filled.select(*df.columns, *[F.when(F.col("v__") == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in values])


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of known values and number of distinct ones of each column, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"a_{c}") for c in columns], *[F.count_distinct(c).alias(f"u_{c}") for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"a_{c}").alias("observed"), F.col(f"u_{c}").alias("distinct_values")) for c in columns])).alias("x")).select("x.*")


def systematic_sample(df: DataFrame, row_id: str, n: int, most: int) -> DataFrame:
    """`most` rows evenly spread over the positions 0 to n - 1; all if there are no more."""
    if n <= most:
        return df
    if most < 2:
        return df.where(F.col(row_id) == 0).limit(most)
    k = F.ceil(F.col(row_id) * (most - 1) / (n - 1))
    return df.where((F.floor(k * (n - 1) / (most - 1)) == F.col(row_id)) & (k < most))


def seeded_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def windows(row_id: Column, n: int, length: int, stride: int) -> Column:
    """First rows of the windows that cover a row: every `stride` rows and one that ends at the last."""
    length = min(length, n)
    stride = min(stride, length)
    last = n - length
    low = F.greatest(F.lit(0), F.ceil((row_id - length + 1) / stride)).cast("long")
    high = F.least(F.floor(row_id / stride), F.lit(last // stride)).cast("long")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<long>"))
    tail = F.when((row_id >= last) & F.lit(last % stride != 0), F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.concat(regular, tail)


def window_scores(df: DataFrame, row_id: str, error: str, n: int, length: int, stride: int) -> DataFrame:
    """A row's score: the mean over the windows that cover it of the mean error of its step."""
    return df.select(row_id, error, F.explode(windows(F.col(row_id), n, length, stride)).alias("window")).groupBy(row_id).agg(F.avg(error).alias("score"), F.count("*").alias("windows"))
