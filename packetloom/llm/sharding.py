"""Two-pass external shuffle into shards, with built-in functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import without

OWN = ("size", "shard", "grown_shard", "slot")
#: Tasks of the second pass, and buckets, at most; beyond, buckets grow: 64 MB at 100 TB, eight to a task.
TASKS, BUCKETS = 200_000, 1_600_000


def _draw(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(shard), key)


def shuffle_into_shards(docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text", seed: int = 7, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Deals `docs` into shards and brings each shard into a random order.

    Pass one scatters records into buckets. The shard is the one with the highest seeded
    hash of (key, shard), so it depends on the key and the number of shards alone, and one
    more shard only takes rows into itself (`grown_shard`). A second seeded hash over key
    and text spreads the rows of a shard over buckets; there are as many buckets as keep the
    expected size near `bucket_bytes` (see BUCKETS for tables beyond 25 TB). Pass two gathers each bucket, which fits in memory,
    orders it by hash and applies the engine's Fisher-Yates `shuffle` with the given seed.
    A bucket's first slot is the number of rows in the shard's earlier buckets.

    Returns every input row and column plus size (UTF-8 bytes of the text and 8), shard,
    slot (from 0 without gaps in each shard) and grown_shard. A null text has size 8; a null
    key is a key like any other (its rows share a shard but not a bucket); repeated rows
    are kept (rows equal in key and text share a bucket: nothing that a retry would see
    otherwise tells them apart); an empty table gives an empty result; input columns with the names of these
    four are replaced. No row depends on another row's text, so copies and hot sources do
    not gather.
    """
    docs = without(docs, *OWN)
    key_col, text_col = F.col(f"`{key}`"), F.col(f"`{text}`")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = max(1, ceil(total / (shards * max(bucket_bytes, total // BUCKETS))))
    best = F.greatest(*[F.struct(_draw(key_col, s, seed).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    dealt = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), size.alias("size"), best.alias("best"), _draw(key_col, shards, seed).alias("more"), F.xxhash64(F.lit(seed + 1), key_col, text_col).alias("mix")).select(
        "rec", "size", "mix", F.col("best.s").alias("shard"), F.when(F.col("more") > F.col("best.h"), F.lit(shards)).otherwise(F.col("best.s")).alias("grown_shard"), (F.col("best.s") * parts + F.pmod("mix", F.lit(parts))).cast("long").alias("bucket")
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket")
    first = counts.select("bucket", (F.sum("n").over(earlier) - F.col("n")).alias("first"))
    gathered = dealt.repartition(min(shards * parts, TASKS), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("mix", "shard", "grown_shard", "size", "rec"))).alias("rows"))
    ordered = gathered.join(first, "bucket").sortWithinPartitions("bucket")
    mixed = ordered.select("first", F.shuffle("rows", F.lit(seed)).alias("rows"))
    return mixed.select("first", F.posexplode("rows").alias("pos", "row")).select("row.rec.*", "row.size", "row.shard", (F.col("first") + F.col("pos")).cast("long").alias("slot"), "row.grown_shard")
