"""SimHash fingerprints and near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import Scratch, components, join_counted, releasing, similar_links, stored, without

#: Rows of a tile, rows of it that are compared at once, and population counts that share a tile at a wide radius.
TILE, STRIP, COUNT_STEP = 4096, 64, 6
#: Further fingerprints that sift candidates, and how many of all 256 bits may differ. At a
#: similarity of 0.8 a bit differs with a probability of 0.15 (long texts) to 0.19 (five
#: shingles): 39 to 48 bits are expected with a deviation of 6, and 128 of unlike texts.
SIEVES, SIEVE_BITS = ("w1", "w2", "w3"), 80


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words: of all."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, max(1, len(words) - width + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes."""
    if not hashes.size:
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > hashes.size, bitorder="little").view(np.int64)[0])


def _sieves(hashes: np.ndarray) -> list[int]:
    """Fingerprints of the same shingles under other hashes."""
    out = []
    for k in range(1, len(SIEVES) + 1):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint(x ^ (x >> np.uint64(32))))
    return out


def with_fingerprint(docs: DataFrame, *, text: str = "text", width: int = 3, distinct: bool = False) -> DataFrame:
    """Adds fp (the fingerprint as a signed number) and n_shingles; a null text counts as empty.

    With `distinct` a shingle that repeats in a text votes and counts once, and the sieves
    are added.
    """
    names = ["fp", "n_shingles", *(SIEVES if distinct else ())]

    @F.pandas_udf(", ".join(f"{n} {'int' if n == 'n_shingles' else 'long'}" for n in names))
    def of(texts: pd.Series) -> pd.DataFrame:
        if distinct:
            return pd.DataFrame([(fingerprint(h), h.size, *_sieves(h)) for h in (np.unique(shingle_hashes(t, width)) for t in texts)], columns=names)
        rows = [(fingerprint(h), h.size) for h in (shingle_hashes(t, width) for t in texts)]
        return pd.DataFrame(rows, columns=names)

    docs = without(docs, *names)
    return docs.select("*", of(F.col(f"`{text}`")).alias("made__")).select(*[F.col(f"`{c}`") for c in docs.columns], "made__.*")


class Forest:
    """Union-find over small integers; keeps one link for each merger."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.up[at]
        while (self.up[at] != at).any():
            at = self.up[at]
        return at

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the links i-j, those that join trees; each pass takes one per smaller root."""
        took_i, took_j = [i[:0]], [j[:0]]
        while i.size:
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            self.up[high] = np.minimum(a, b)[first]
            took_i.append(i[first])
            took_j.append(j[first])
        return np.concatenate(took_i), np.concatenate(took_j)


def _strips(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in a and b that differ in `radius` bits at most, and the distance."""
    for at in range(0, a.size, STRIP):
        far = np.bitwise_count(a[at : at + STRIP, None] ^ b[None, :])
        i, j = np.nonzero(far <= radius)
        distance = far[i, j]
        i = i + at
        if same:
            upper = i < j
            i, j, distance = i[upper], j[upper], distance[upper]
        if i.size:
            yield i, j, distance


def _offsets(blocks: int, radius: int, step: int, classes: bool) -> list[int]:
    """Differences of tile keys within the radius; of two opposite ones only the positive."""
    most = -(-radius // step)
    ranges = [range(-most, most + 1)] * blocks
    found = {sum(d * 128**k for k, d in enumerate(by)) + c * 128**blocks for by in product(*ranges) if sum(max(0, (abs(d) - 1) * step + 1) for d in by) <= radius for c in ((-1, 0, 1) if classes else (0,))}
    return sorted(x for x in found if x >= 0)


def tile_pairs(nodes: DataFrame, scratch: Scratch, radius: int, blocks: int, *, step: int = 1, ratio: float = 0.0, extra: tuple[str, ...] = (), most_size: int = 1 << 22) -> DataFrame:
    """Pairs of tiles that can hold fingerprints within the radius.

    nodes: id, fp, size and `extra`. A tile key has the population count of each of `blocks` equal
    fields of the fingerprint, in steps of `step` (and, with a ratio, the size's logarithm to
    its base). The sum of the differences of the counts is a lower bound of the distance, so
    all other pairs of tiles are skipped without loss. A key with over TILE rows, or whose
    sizes add up to over `most_size`, has several tiles. Pairs are first listed by the tiles'
    names alone, then each goes to the task of its second tile, so the tiles of a popular
    key are compared in as many tasks as there are tiles.
    """
    names = ("id", "fp", "size", *extra)
    bits = 64 // blocks
    mask = (1 << bits) - 1
    key = F.lit(0).cast("long")
    for k in range(blocks):
        field = F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit(mask)) if blocks > 1 else F.col("fp")
        key = key + F.floor(F.bit_count(field) / step).cast("long") * F.lit(128**k)
    if ratio:
        key = key + F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-log(ratio)) + F.lit(1e-9)).cast("long") * F.lit(128**blocks)
    keyed = nodes.withColumn("key", key)
    many = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / most_size)).cast("int").alias("parts")), "keys")
    total = many.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("id", "fp"), F.col("parts")).cast("int")
    tiles = join_counted(keyed, many, "key", "n", total).select("key", part.alias("part"), F.struct(*names).alias("row")).groupBy("key", "part").agg(F.collect_list("row").alias("rows"))
    tiles = scratch.keep(tiles.select("key", "part", *[F.col(f"rows.{n}").alias(n) for n in names]), "tiles")
    steps = F.explode(F.array(*map(F.lit, _offsets(blocks, radius, step, bool(ratio)))))
    asked = tiles.select(F.col("key").alias("own"), F.col("part").alias("pa"), steps.alias("by")).withColumn("key", F.col("own") + F.col("by"))
    named = asked.join(many.drop("n"), "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("by > 0 or pa <= part").drop("parts")
    left = tiles.select(F.col("key").alias("own"), F.col("part").alias("pa"), *names)
    met = named.join(left, ["own", "pa"]).join(tiles.select("key", "part", *[F.col(n).alias(f"{n}_b") for n in names]), ["key", "part"])
    return met.select(*names, *[f"{n}_b" for n in names], F.expr("by = 0 and pa = part").alias("same"), F.xxhash64("own", "pa", "key", "part").alias("pair"))


def fingerprint_links(nodes: DataFrame, scratch: Scratch, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) of ids that span the components of "within the radius".

    Each pair of tiles is compared whole; of its links a spanning forest leaves the task, so
    a dense group of g fingerprints gives a multiple of g links and loses no connection.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, fp, ids_b, fp_b, same in zip(batch["id"], batch["fp"], batch["id_b"], batch["fp_b"], batch["same"], strict=True):
                both, n = np.concatenate([ids, ids_b]), len(ids)
                forest = Forest(n if same else n + len(ids_b))
                for i, j, _ in _strips(np.asarray(fp).view(np.uint64), np.asarray(fp_b).view(np.uint64), radius, same):
                    i, j = forest.add(i, j if same else j + n)
                    out.append((both[i], both[j]))
            if out:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    return tile_pairs(nodes, scratch, radius, blocks).select("id", "fp", "id_b", "fp_b", "same").mapInPandas(releasing(compare), "a long, b long")


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    Distinct fingerprints (64 bits, one vote per shingle of `width` words) are compared in
    tiles by exclusive-or and bit counts; links of `radius` or fewer differing bits make
    components. Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id that links reach. Null and empty texts have the fingerprint zero and link like
    any other; equal texts share one fingerprint, compared once; a null doc_id takes part
    and gets the class of its fingerprint (null if no other row has one). Repeated rows stay;
    other input columns are not read. `blocks` is 4 up to some 10^8 distinct fingerprints;
    8 keeps tiles small beyond.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        made = with_fingerprint(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), width=width)
        made = stored(made.select("doc_id", "fp"), "simhash")
        nodes = scratch.keep(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
        links = fingerprint_links(nodes.select(F.col("fp").alias("id"), "fp", F.lit(1).alias("size")), scratch, radius, blocks)
        reach = components(links, scratch).select(F.col("node").alias("fp"), "component")
        named = nodes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
        total = made.count()
        classes = stored(join_counted(named, least, "component", "fps", total).select("fp", "component_id", "n"), "classes")
    return join_counted(made, classes, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _candidate_groups(nodes: DataFrame, scratch: Scratch, radius: int, similarity: float) -> DataFrame:
    """Entries of each pair of tiles that chains of candidates connect: pair, grp, side, id.

    Every candidate pair of a pair of tiles lies inside one group, and an entry is there once
    however many candidates it has, so dense groups leave the task in proportion to their size.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = zip(*(batch[c] for c in SIEVES), strict=True), zip(*(batch[f"{c}_b"] for c in SIEVES), strict=True)
            for ids, fp, size, ids_b, fp_b, size_b, same, pair, wide, wide_b in zip(*(batch[c] for c in ("id", "fp", "size", "id_b", "fp_b", "size_b", "same", "pair")), *each, strict=True):
                size, size_b, n = np.asarray(size), np.asarray(size_b), len(ids)
                both = ids if same else np.concatenate([ids, ids_b])
                forest = Forest(len(both))
                sieves = [(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64)) for a, b in zip(wide, wide_b, strict=True)]
                for i, j, far in _strips(np.asarray(fp).view(np.uint64), np.asarray(fp_b).view(np.uint64), radius, same):
                    fits = np.minimum(size[i], size_b[j]) >= similarity * np.maximum(size[i], size_b[j])
                    i, j, far = i[fits], j[fits], far[fits].astype(np.int64)
                    for a, b in sieves:
                        far += np.bitwise_count(a[i] ^ b[j])
                    i, j = i[far <= SIEVE_BITS], j[far <= SIEVE_BITS]
                    forest.add(i, j if same else j + n)
                roots = forest.roots(np.arange(len(both)))
                met = np.flatnonzero(np.bincount(roots, minlength=len(both))[roots] > 1)
                if met.size:
                    yield pd.DataFrame({"pair": pair, "grp": roots[met], "side": 0 if same else (met >= n).astype(np.int64), "id": np.asarray(both)[met]})

    return tile_pairs(nodes, scratch, radius, 1, step=COUNT_STEP, ratio=similarity, extra=SIEVES).mapInPandas(releasing(compare), "pair long, grp long, side long, id long")


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 22, similarity: float = 0.8, most: int = 4096) -> DataFrame:
    """Classes of documents whose word shingles have a Jaccard similarity of 0.8 or more.

    Equal texts are one entry. Entries whose fingerprints differ in `radius` bits or fewer
    (tiled exact comparison) and whose sizes allow the similarity are candidates; the exact
    similarity of their shingle sets decides. Fingerprints and sizes are of distinct shingles,
    as the similarity is. At a similarity of 0.8 two fingerprints differ in 10 bits on average
    (12 for the shortest texts), with a deviation of 3: of 138,000 simulated pairs of 0.8 to
    0.89 the radius of 22 lost 1 (14: 2,413), the further fingerprints that keep unlike texts
    away (SIEVES) none. No candidate is passed over: what chains of candidates connect in a
    pair of tiles (2 * TILE entries at most) meets in one task, where each pair that links do
    not connect yet is checked (of a row, `most` pairs at a time). Returns doc_id and
    class_id (its smallest doc_id) of every row. Rows with a null doc_id are left out; null
    and empty texts equal only each other; texts that share a doc_id are entries of their own.
    """
    with Scratch(docs.sparkSession) as scratch:
        return stored(_classes(docs, scratch, doc_id, text, width, radius, similarity, most).select("doc_id", "class_id"), "near-copies")


def first_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 22, similarity: float = 0.8, most: int = 4096) -> DataFrame:
    """`docs` with one row of each class of near_copies: the smallest doc_id, then the text with the smallest MD5.

    Of rows equal in doc_id and text one stays. Rows with a null doc_id all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        classes = _classes(docs, scratch, doc_id, text, width, radius, similarity, most)
        keep = classes.groupBy("class__").agg(F.min(F.struct("doc_id", "key")).alias("k")).select(F.col("k.doc_id").alias("id__"), F.col("k.key").alias("key__"))
        keep = stored(keep, "first-copies")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("id__"), _text_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key__"), F.struct(*own).alias("row__"))
    first = keyed.dropDuplicates(["id__", "key__"]).join(keep, ["id__", "key__"], "left_semi").select("row__.*")
    return first.unionAll(docs.where(F.col(f"`{doc_id}`").isNull()).select(*own))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _classes(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, width: int, radius: int, similarity: float, most: int) -> DataFrame:
    """doc_id, key (of the text), class__ (of the entry) and class_id of every row with a doc_id."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")
    docs = docs.withColumn("key", _text_key(F.col("text")))
    made = scratch.keep(with_fingerprint(docs, width=width, distinct=True).drop("text"), "fingerprints")
    entries = made.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("n_shingles").alias("size"), *[F.first(c).alias(c) for c in SIEVES])
    entries = scratch.keep(entries.withColumn("id", F.xxhash64("key")), "entries")
    made = made.select("doc_id", "key")

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts])

    groups = scratch.keep(_candidate_groups(entries.where("size > 0").select("id", "fp", "size", *SIEVES), scratch, radius, similarity), "groups")
    # The row with the smallest doc_id stands for all copies of a text, so copies don't gather in the join.
    named = entries.join(groups.select("id").distinct(), "id", "left_semi").select("id", F.col("least").alias("doc_id"))
    own = docs.select("doc_id", F.xxhash64("key").alias("id"), "text").join(named, ["doc_id", "id"], "left_semi").dropDuplicates(["id"]).select("id", sets("text").alias("s"))
    links = scratch.keep(similar_links(groups.join(own, "id").withColumn("label", F.col("id")), ["pair", "grp"], similarity, most), "links")
    classes = components(links, scratch).toDF("id", "component")
    classed = entries.join(classes, "id", "left").select("key", "least", "n", F.coalesce("component", "id").alias("component"))
    least = classed.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("texts"))
    total = made.count()
    named = scratch.keep(join_counted(classed, least, "component", "texts", total).select("key", "n", F.col("component").alias("class__"), "class_id"), "classes")
    return join_counted(made, named, "key", "n", total).select("doc_id", "key", "class__", "class_id")
