"""What the operators of this subpackage share: tables, written intermediates and components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that part words, as every contract of this subpackage has them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"
#: A block of a Bloom filter has eight words of 32 bits; each key sets one bit in each word.
WORDS = 8
#: Keys that more than one row in HOT_SHARE bears are at most HOT_SHARE; their entries are broadcast.
HOT_SHARE, HOT_ROWS = 2000, 100
#: Links (16 bytes each) up to which one task finds their components; more take rounds of joins.
FEW_LINKS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a session in one process (tests) gets a temporary folder if none is named; on a
    cluster that is an error, as executors could not read one another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="packetloom-")
    atexit.register(shutil.rmtree, own, True)
    context.setCheckpointDir(own)
    return own


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Hands rows to Python workers in batches of `size`, so that two tasks' batches stay small beside an executor's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def trim_native(spark: SparkSession) -> bool:
    """Hands free native memory of the driver's JVM back to the system, and tells if that JVM can.

    Compilers, planners and network threads each free into an arena of their own, which the C
    library keeps; over a thousand stages that grows to hundreds of MB beside the heap.
    """
    jvm, of = spark._jvm, spark._jvm.java.lang.Class.forName

    def array(kind, *values):
        made = spark.sparkContext._gateway.new_array(kind, len(values))
        for k, value in enumerate(values):
            made[k] = value
        return made

    # By the public interface: the server's own class is not open to calls from outside.
    types = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *types))
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:  # not known before Java 17.0.9, or elsewhere than on Linux
        return False
    return True


def _written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/packetloom-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it again; it goes when the driver ends."""
    path, made = _written(df, name)
    where, files = _path(df.sparkSession, path)
    files.deleteOnExit(where)
    return made


class Scratch:
    """Intermediate tables of one operator, in the shared folder until the `with` block ends.

    Written tables cut the lineage and outlive executors. What an operator returns must not
    read them: its last step is `stored`. Leaving also lets the driver collect its garbage,
    without which Spark keeps the files of finished shuffles, and give free native memory back.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, made = _written(df, name)
        self.paths[id(made)] = (path, made)
        self.tidy()
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for made in tables:
            path, _ = self.paths.pop(id(made))
            where, files = _path(self.spark, path)
            files.delete(where, True)

    def tidy(self) -> None:
        """Only where executors are apart: what a session in one process leaves goes with it."""
        master = self.spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            gc.collect()
            self.spark._jvm.System.gc()
            trim_native(self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[made for _, made in list(self.paths.values())])
        self.tidy()


def release_worker() -> None:
    """Hands free memory of this Python process back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def releasing(step: Callable) -> Callable:
    """`step` over a task's batches, with `release_worker` when its rows have ended."""

    @wraps(step)
    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        release_worker()

    return run


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that bear the name of an output column (whatever their case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def join_counted(rows: DataFrame, entries: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join of `rows` with `entries`, which has one row per key and in `n` how many rows bear it.

    A key that over total / HOT_SHARE rows bear would overload the task it is dealt to. There
    are at most HOT_SHARE such keys, so their entries are broadcast, and their rows are dealt
    evenly in the shuffled join that all others take part in.
    """
    columns = [c for c in entries.columns if c not in (key, n)]
    bound = max(HOT_ROWS, total // HOT_SHARE)
    value = F.struct(*[F.col(f"`{c}`") for c in columns])
    hot = F.broadcast(entries.where(F.col(n) > bound).select(F.col(key).alias("hotkey__"), value.alias("hot__")))
    cold = entries.where(F.col(n) <= bound).select(F.col(key).alias("coldkey__"), F.lit(0).cast("long").alias("coldsalt__"), value.alias("cold__"))
    met = rows.join(hot, F.col(key) == F.col("hotkey__"), "left")
    met = met.withColumn("salt__", F.when(F.col("hot__").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
    met = met.join(cold, (F.col(key) == F.col("coldkey__")) & (F.col("salt__") == F.col("coldsalt__")), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col("hot__")[c], F.col("cold__")[c]).alias(c) for c in columns])


def bloom_bits(hashed: Column) -> list[Column]:
    """The bit of each of the eight words of a block: eight fields of five bits of a second hash."""
    spread = F.xxhash64(F.lit(11), hashed)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filled blocks of a blocked Bloom filter: block number and its eight words of 32 bits."""
    hashed = listed.select(F.xxhash64(key).alias("h"))
    own = hashed.select(F.pmod("h", F.lit(blocks)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bloom_bits(F.col("h")))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def sifted(rows: DataFrame, keys: DataFrame, key: str, n: int, most_blocks: int = 1 << 16) -> DataFrame:
    """`rows` without most of those whose key is none of the `n` keys, ahead of an exact join.

    A Bloom filter of eight bits a key, which is broadcast if it has `most_blocks` (4.7 MB)
    at most; a larger one would cost more than it spares, so all rows go on.
    """
    blocks = max(1, ceil(n * 8 / (32 * WORDS)))
    if blocks > most_blocks:
        return rows
    filled = bloom_blocks(keys, key, blocks).withColumnRenamed("block", "block__")
    asked = rows.withColumn("h__", F.xxhash64(key))
    all_set = F.lit(True)
    for k, bit in enumerate(bloom_bits(F.col("h__"))):
        all_set = all_set & (F.col(f"w{k}").bitwiseAND(bit) == bit)
    return asked.join(F.broadcast(filled), F.pmod("h__", F.lit(blocks)) == F.col("block__")).where(all_set).select(*[F.col(f"`{c}`") for c in rows.columns])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each node of the links (u, v) reaches, by union-find."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ends = np.concatenate([np.zeros(0, np.int64), *(u for u, _ in parts), *(v for _, v in parts)])
    nodes, codes = np.unique(ends, return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    half = len(ends) // 2
    for a, b in zip(codes[:half].tolist(), codes[half:].tolist(), strict=True):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    least = np.array([root(i) for i in range(len(up))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], names=["node", "component"])


def components(links: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of a link table: one row (node, component) per linked node, the least one included.

    The component is the smallest node that can be reached. Up to FEW_LINKS distinct links
    between whole numbers meet in one task. Beyond that two steps alternate, each one
    aggregation and one join on the nodes: every node points its neighbours at the smallest
    node it sees (large star), then every node hangs its smaller neighbours below the
    smallest (small star). The rounds grow with the logarithm of the longest path. Links are
    made distinct before each shuffle; a hot node (the centre of a star) meets partial
    aggregates and, in the joins, a broadcast of its entry. Null nodes and links of a node
    to itself are ignored. The result is a table of `scratch`.
    """
    with Scratch(links.sparkSession) as own:
        edges = own.keep(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct(), "links")
        total = edges.count()
        if total <= FEW_LINKS and edges.schema["u"].dataType == T.LongType():
            return scratch.keep(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
        before = None
        while True:
            both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            large = join_counted(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
            small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = join_counted(large, small_least, "u", "n", 2 * total).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
            last, edges = edges, own.keep(small, "links")
            own.drop(last)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                hung = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
                own_least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                return scratch.keep(hung.unionAll(own_least), "components")
            before = now


def exact_links(values: np.ndarray, sizes: np.ndarray, side: np.ndarray, similarity: float, most: int = 4096, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs with the Jaccard similarity, enough to span all of its components.

    values: the distinct numbers of each entry, one after another; sizes: how many, none 0.
    With two sides only pairs across are checked. Every pair is, but for those that earlier
    links (or equal labels) connect already.
    """
    sizes = sizes.astype(np.int64)
    if len(sizes) == 2:
        shared = len(np.intersect1d(values[: sizes[0]], values[sizes[0] :], assume_unique=True))
        ok = (side[1] != side[0] or not side.any()) and (label is None or label[0] != label[1]) and shared >= similarity * (sizes.sum() - shared)
        return (np.array([0]), np.array([1])) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    known, codes = np.unique(values, return_inverse=True)
    places, sided, found = np.arange(len(sizes)), bool(side.any()), []
    starts, label, flag = np.cumsum(sizes) - sizes, places.copy() if label is None else label.copy(), np.zeros(len(known), bool)
    for i in range(len(sizes)):
        fits = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i])
        open_ = np.flatnonzero(fits & (label != label[i]) & (side > side[i] if sided else places > i))
        if not open_.size:
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        flag[own] = True
        total = np.cumsum(sizes[open_])
        for part in np.split(open_, np.flatnonzero(np.diff(np.maximum(total // 1_000_000, places[: len(open_)] // most))) + 1):
            n = sizes[part]
            begin = np.cumsum(n) - n
            shared = np.add.reduceat(flag[codes[np.repeat(starts[part] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
            for j in part[shared >= similarity * (n + sizes[i] - shared)].tolist():
                if label[j] != label[i]:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
        flag[own] = False
    links = np.array(found, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def similar_links(entries: DataFrame, keys: list[str], similarity: float, most: int = 4096) -> DataFrame:
    """Links (a, b) of ids by `exact_links` within each group of `keys`, which has to be bounded.

    entries: the keys, id, side, label (equal ones are connected already) and s (the set). The
    sets stay in the flat arrays that they arrive in.
    """
    names = ("id", "side", "label", "s")
    grouped = entries.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("rows")).where(F.size("rows") > 1).select(*[F.col(f"rows.{n}").alias(n) for n in names])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, side, label, sets = (batch.column(n).flatten() for n in names)
            ids, side, label = ids.to_numpy(), side.to_numpy(), label.to_numpy()
            sizes, values = pc.list_value_length(sets).to_numpy(), sets.flatten().to_numpy()
            ends, at, deep = np.cumsum(pc.list_value_length(batch.column("id")).to_numpy()), 0, 0
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for end in ends.tolist():
                own = sizes[at:end]
                width = int(own.sum())
                i, j = exact_links(values[deep : deep + width], own, side[at:end], similarity, most, np.unique(label[at:end], return_inverse=True)[1])
                a.append(ids[at:end][i])
                b.append(ids[at:end][j])
                at, deep = end, deep + width
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return grouped.mapInArrow(releasing(check), "a long, b long")
