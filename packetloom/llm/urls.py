"""URL rules and a blocked Bloom filter over listed URLs, with built-in functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import WORDS, bloom_bits, bloom_blocks, join_counted, stored, without

#: (verdict, host, path): each holds for its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty for null and without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.`, `m.` or `blog.`, path without `.html` or closing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def filter_urls(pages: DataFrame, listed: DataFrame, *, url: str = "url", rules: tuple = RULES, bits_per_key: int = 16, broadcast_blocks: int = 1 << 16) -> DataFrame:
    """Judges each page's URL: rules first, then a list of canonical URLs to block.

    `listed` has one string column of canonical URLs. A Bloom filter in blocks of 256 bits
    is built from it, as large as `bits_per_key` asks for. Up to `broadcast_blocks` (4 MB at
    most) it is broadcast and probed on the page rows themselves: rows that it rules out
    stay where they are and are decided; only possible hits go to the exact join on the
    canonical URL that removes false positives. A larger filter is joined by block number
    with the distinct canonical URLs. In the exact join a URL that many pages share is
    spread over tasks.

    Adds host, path, rule (host and path of the rule that fits, the longest if several),
    verdict and the canonical URL. Null and malformed URLs have empty host and path, fit no
    rule and are allowed. Repeated rows stay; input columns with these names are replaced;
    nulls and empty names in `listed` are ignored; empty tables give empty results.
    """
    pages = without(pages, "host", "path", "rule", "verdict", "canonical")
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row__") if pages.columns else F.lit(None).alias("row__")
    at = pages.select(own, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    at = at.withColumns({"canonical": canonical(F.col("host"), F.col("path")), "rule": rule, "verdict": verdict})

    name = listed.columns[0]
    listed = stored(listed.select(F.col(f"`{name}`").alias("canonical")).where("canonical <> ''").distinct(), "listed")
    keys = listed.count()
    blocks = max(1, ceil(keys * bits_per_key / (32 * WORDS)))
    filled = bloom_blocks(listed, "canonical", blocks)
    hashed = at.withColumn("h", F.xxhash64("canonical"))
    asked = hashed.select("*", F.pmod("h", F.lit(blocks)).alias("block"), *[b.alias(f"q{k}") for k, b in enumerate(bloom_bits(F.col("h")))])
    open_ = F.col("verdict").isNull() & (F.col("canonical") != "")
    all_set = F.lit(True)
    for k in range(WORDS):
        all_set = all_set & (F.col(f"w{k}").bitwiseAND(F.col(f"q{k}")) == F.col(f"q{k}"))
    columns = ["row__", "host", "path", "rule", "verdict", "canonical"]
    if blocks <= broadcast_blocks:
        probed = asked.join(F.broadcast(filled), "block", "left").select(*columns, (open_ & F.coalesce(all_set, F.lit(False))).alias("possible"))
        counts = probed.where("possible").groupBy("canonical").agg(F.count("*").alias("n"))
    else:
        probed = at.select(*columns, open_.alias("possible"))
        counts = asked.where(open_).groupBy("canonical", "block", *[f"q{k}" for k in range(WORDS)]).agg(F.count("*").alias("n")).join(filled, "block").where(all_set).select("canonical", "n")
    hits = stored(counts.join(listed, "canonical").select("canonical", "n", F.lit("block").alias("listed")), "hits")
    total = hits.agg(F.sum("n")).first()[0] or 0
    passed = join_counted(probed.where("possible").select(*columns), hits, "canonical", "n", total)
    judged = passed.unionByName(probed.where("not possible").select(*columns, F.lit(None).cast("string").alias("listed")))
    return judged.select("row__.*", "host", "path", "rule", F.coalesce("verdict", "listed", F.lit("allow")).alias("verdict"), "canonical")


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """A block list from the crawl itself: canonical URLs that two or more pages bear."""
    made = pages.select(canonical(host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))).alias("canonical")).where("canonical <> ''")
    return made.groupBy("canonical").agg(F.count("*").alias("n")).where("n >= 2").select("canonical")
