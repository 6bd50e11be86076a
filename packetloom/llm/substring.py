"""Substring dedup: near-equal paragraphs across documents, found by MinHash banding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import Scratch, components, join_counted, releasing, sifted, similar_links, stored, without

#: Words of a shingle; bands and rows of a band: at a Jaccard similarity of 0.8 a pair
#: collides with a probability of 1 - (1 - 0.8 ** 2) ** 4 = 0.983, at 0.9 of 0.9987.
WIDTH, BANDS, ROWS = 5, 4, 2
#: Words of a window paragraph, and how many successive places for one hold the start of one
#: at least: a run of WINDOW + REACH - 1 = 50 words has a window inside wherever it stands.
WINDOW, REACH = 15, 36
#: Distinct shingles that a paragraph has at least: a word over and over is no paragraph.
LEAST_SHINGLES = 6
#: Entries of a block of a large bucket; each pair of blocks meets in one task.
BLOCK = 1024
#: Words that are handled at once (a longer text alone), and units that leave a worker at once.
GROUP_WORDS, SLICE = 1 << 16, 1 << 15
UNITS = "doc_id long, text_key long, first_word int, n_words int, content long, " + ", ".join(f"b{k} long" for k in range(BANDS))
MEMBERS = "doc_id long, text_key long, first_word int, n_words int, content long, around binary, shingles array<long>"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64: a bijection of 64 bits without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 9)
        if len(word) <= 64:
            self[word] = h
        return h


_SEEDS = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _MIX)
_XOR, _TIMES = _SEEDS[: BANDS * ROWS], _SEEDS[BANDS * ROWS :] | np.uint64(1)


def text_words(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode().lower().split()


def hashes(words: list[bytes], known: WordHashes | None = None) -> np.ndarray:
    return np.fromiter(map((known if known is not None else WordHashes()).__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = _mix(out * _MIX + h[k : k + len(out)])
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct five-word hashes of a paragraph."""
    return np.unique(_runs(h, min(WIDTH, len(h))))


def _sliding(x: np.ndarray, width: int, of: np.ufunc, fill: np.uint64) -> np.ndarray:
    """`of` over each `width` successive values from a place on; beyond the end there is `fill`."""
    out, done = x.copy(), 1
    while done < width:
        by = min(done, width - done)
        out = of(out, np.concatenate([out[by:], np.full(min(by, len(out)), fill)]))
        done += by
    return out


def window_starts(g: np.ndarray, room: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of window paragraphs: the least shingle hash of each REACH successive places.

    g: shingle hashes of texts one after another; room: how many words a text has from each
    place on; first: where texts begin. A place needs WINDOW words. A text with fewer than
    REACH such places has at least one window all the same.
    """
    fits = room >= WINDOW
    least = _sliding(g, REACH, np.minimum, _NONE)
    whole = room >= WINDOW + REACH - 1
    reached = _sliding(np.where(whole, least, np.uint64(0))[::-1], REACH, np.maximum, np.uint64(0))[::-1]
    chosen = fits & (reached == g)
    for at in first[fits[first] & ~whole[first]].tolist():
        chosen[at + int(g[at : at + room[at] - WINDOW + 1].argmin())] = True
    return np.flatnonzero(chosen)


def _bands(shingle: np.ndarray, least, kind: int) -> np.ndarray:
    """Bands by paragraph; `least` takes the smallest value of each paragraph.

    Lines and windows have bands of their own, as the sizes of the two rule out the similarity.
    """
    out = []
    for k in range(BANDS):
        band = np.full(1, 2 * k + kind, np.uint64)
        for r in range(ROWS):
            at = k * ROWS + r
            band = _mix(band * _MIX + least((shingle ^ _XOR[at]) * _TIMES[at]))
        out.append(band)
    return np.stack(out)


def _words_of(texts: list[str], known: WordHashes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts by line; their hashes one text after another; words of each text, where
    each begins, and which places are words.

    Between texts there is a gap of one place, so that no run of words goes from one to the next.
    """
    lines = [[line.split() for line in t.encode().lower().split(b"\n")] for t in texts]
    sizes = np.array([sum(map(len, x)) for x in lines], np.int64)
    h, begin = np.zeros(int(sizes.sum()) + len(texts), np.uint64), np.cumsum(sizes + 1) - sizes - 1
    real = np.ones(len(h), bool)
    real[begin + sizes] = False
    h[real] = hashes([w for x in lines for line in x for w in line], known)
    return lines, h, sizes, begin, real


def group_units(ids: np.ndarray, keys: np.ndarray, texts: list[str], known: WordHashes, least_words: int) -> pa.RecordBatch:
    """The paragraphs of some texts: their lines of `least_words` or more, and windows."""
    lines, h, sizes, begin, _ = _words_of(texts, known)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(h)) - begin[text_of]
    room = sizes[text_of] - place
    g = np.concatenate([_runs(h, WIDTH), np.full(min(WIDTH - 1, len(h)), _NONE)])

    at = window_starts(g, room, begin[sizes > 0])
    own = g[at[:, None] + np.arange(WINDOW - WIDTH + 1)]
    ranked = np.sort(own, 1)
    rich = (ranked[:, 1:] != ranked[:, :-1]).sum(1) + 1 >= LEAST_SHINGLES
    at, own = at[rich], own[rich]
    words = h[at[:, None] + np.arange(WINDOW)]
    content = _mix((_mix(words + np.arange(WINDOW, dtype=np.uint64) * _MIX)).sum(1, dtype=np.uint64) + np.uint64(WINDOW))
    bands = _bands(own, lambda x: x.min(1), 0)

    line_sizes = np.array([len(line) for x in lines for line in x], np.int64)
    line_text = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    line_first = np.cumsum(line_sizes) - line_sizes + line_text
    long = line_sizes >= max(least_words, WIDTH)
    line_first, line_sizes = line_first[long], line_sizes[long]
    counts = line_sizes - WIDTH + 1
    starts = np.cumsum(counts) - counts
    inner = g[np.repeat(line_first - starts, counts) + np.arange(counts.sum())]
    if len(starts):
        line = np.repeat(np.arange(len(starts)), counts)
        order = np.lexsort((inner, line))
        new = np.ones(len(inner), bool)
        new[1:] = (inner[order][1:] != inner[order][:-1]) | (line[order][1:] != line[order][:-1])
        rich = np.bincount(line[order][new], minlength=len(starts)) >= LEAST_SHINGLES
        word_starts = np.cumsum(line_sizes) - line_sizes
        nth = np.arange(line_sizes.sum()) - np.repeat(word_starts, line_sizes)
        each = h[np.repeat(line_first, line_sizes) + nth]
        line_content = _mix(np.add.reduceat(_mix(each + nth.astype(np.uint64) * _MIX), word_starts) + line_sizes.astype(np.uint64))
        line_bands = _bands(inner, lambda x: np.minimum.reduceat(x, starts), 1)
        line_first, line_sizes, line_content, line_bands = line_first[rich], line_sizes[rich], line_content[rich], line_bands[:, rich]
    else:
        line_content, line_bands = np.zeros(0, np.uint64), np.zeros((BANDS, 0), np.uint64)

    where = np.concatenate([at, line_first])
    text = text_of[where]
    columns = [pa.array(ids[text]), pa.array(keys[text]), pa.array(place[where].astype(np.int32)), pa.array(np.concatenate([np.full(len(at), WINDOW), line_sizes]).astype(np.int32)), pa.array(np.concatenate([content, line_content]).view(np.int64))]
    columns += [pa.array(np.concatenate([a, b]).view(np.int64)) for a, b in zip(bands, line_bands, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "first_word", "n_words", "content", *(f"b{k}" for k in range(BANDS))])


def paragraph_units(docs: DataFrame, least_words: int) -> DataFrame:
    """One row per paragraph; a window has WINDOW words, a line more."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lo, size = 0, 0
            for k, n in enumerate(pc.binary_length(texts).to_pylist()):
                size += n
                if size >= 6 * GROUP_WORDS or k + 1 == batch.num_rows:
                    made = group_units(ids[lo : k + 1], keys[lo : k + 1], texts[lo : k + 1].to_pylist(), known, least_words)
                    for at in range(0, made.num_rows, SLICE):
                        yield made.slice(at, SLICE)
                    lo, size = k + 1, 0

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text").mapInArrow(releasing(make), UNITS)


def group_members(texts: list[str], counts: np.ndarray, first: np.ndarray, sizes: np.ndarray, wants: np.ndarray, known: WordHashes) -> tuple[pa.Array, pa.Array]:
    """Of paragraphs, `counts` for each text: the words around windows, and shingles where wanted.

    A byte stands for each of the words before and behind, the nearest first (0: the text
    ends); lines have none.
    """
    _, h, _, begin, real = _words_of(texts, known)
    at = begin[np.repeat(np.arange(len(texts)), counts)] + first
    code = np.concatenate([np.zeros(REACH, np.uint8), np.where(real, 1 + h % np.uint64(255), 0).astype(np.uint8), np.zeros(REACH, np.uint8)])
    window = sizes == WINDOW
    w = at[window][:, None] + REACH
    # Beyond the gap is another text: all codes from the first empty one on are empty.
    around = np.concatenate([x * np.logical_and.accumulate(x > 0, 1) for x in (code[w - 1 - np.arange(REACH - 1)], code[w + WINDOW + np.arange(REACH - 1)])], 1)
    offsets = np.cumsum([0, *window]) * 2 * (REACH - 1)
    packed = pa.Array.from_buffers(pa.binary(), len(at), [pa.array(window).buffers()[1], pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(around.tobytes())])
    g = _runs(h, WIDTH)
    own = [np.unique(g[a : a + n - WIDTH + 1]) if y else None for a, n, y in zip(at.tolist(), sizes.tolist(), wants.tolist(), strict=True)]
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in own)])
    values = np.concatenate([np.zeros(0, np.uint64), *(x for x in own if x is not None)]).view(np.int64)
    lists = pa.ListArray.from_buffers(pa.list_(pa.int64()), len(at), [pa.array(wants).buffers()[1], pa.py_buffer(ends.astype(np.int32))], children=[pa.array(values)])
    return packed, lists


def paragraph_members(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text_key, first_word, n_words, content, wants) with the words around windows
    and, where `wants` says so, the shingles, all read from the texts in one pass."""
    names = ("first_word", "n_words", "content", "wants")
    wanted = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*names)).alias("some"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            lo, size, lengths = 0, 0, pc.binary_length(batch.column(2)).to_pylist()
            for k, n in enumerate(lengths):
                size += n
                if size < 6 * GROUP_WORDS and k + 1 < batch.num_rows:
                    continue
                part = batch.slice(lo, k + 1 - lo)
                lo, size = k + 1, 0
                first, sizes, content, wants = (part.column(3 + i).flatten() for i in range(4))
                counts = pc.list_value_length(part.column(3)).to_numpy()
                around, lists = group_members(part.column(2).to_pylist(), counts, first.to_numpy(), sizes.to_numpy(), wants.to_numpy(zero_copy_only=False), known)
                row = pa.array(np.repeat(np.arange(part.num_rows), counts))
                made = pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), first, sizes, content, around, lists], names=["doc_id", "text_key", "first_word", "n_words", "content", "around", "shingles"])
                for at in range(0, made.num_rows, SLICE):
                    yield made.slice(at, SLICE)

    there = docs.where("doc_id is not null and text is not null").join(wanted, ["doc_id", "text_key"])
    return there.select("doc_id", "text_key", "text", *[f"some.{n}" for n in names]).mapInArrow(releasing(read), MEMBERS)


def _islands(spans: DataFrame) -> DataFrame:
    """Merges spans of a document that overlap or touch; the least kept_doc_id stays."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("first_word", "last_word")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("fresh", (F.col("first_word") > F.coalesce(F.max("last_word").over(before), F.lit(-1))).cast("int"))
    numbered = fresh.withColumn("island", F.sum("fresh").over(order))
    return numbered.groupBy("doc_id", "text_key", "island").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("kept_doc_id").alias("kept_doc_id"), F.max("line").alias("line")).drop("island")


def _star_links(met: DataFrame, sets: DataFrame, similarity: float, total: int) -> DataFrame:
    """Links of the entries of large buckets to the first of their bucket."""
    large = met.where(F.col("n") > BLOCK)
    firsts = large.groupBy("band").agg(F.min("content").alias("a"), F.count("*").alias("rows"))
    pairs = join_counted(large.select("band", F.col("content").alias("b")), firsts, "band", "rows", total).where("a <> b").select("a", "b").distinct()
    counted = sets.join(pairs.groupBy("a").agg(F.count("*").alias("n")), F.col("content") == F.col("a")).select("a", "n", F.col("shingles").alias("sa"))
    both = join_counted(pairs, counted, "a", "n", total).join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _block_pairs(met: DataFrame) -> DataFrame:
    """Entries of buckets that links do not connect yet, once for each pair of blocks.

    Buckets with the same entries count once. Returns band, low, high, side, content, label.
    """
    entries = F.sum(F.xxhash64("content").cast("decimal(38,0)"))
    apart = met.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), entries.alias("sum")).where("least < most")
    apart = apart.groupBy("n", "sum").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "n")
    dealt = join_counted(met, apart, "band", "n", met.count()).where("parts is not null").withColumn("own", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "content", "label")


def band_buckets(entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """band, content and n, how many contents share the band; and the number of rows.

    entries: content, keep (doc_id, text_key, first_word, n_words) and the bands. A bucket is
    a band that several contents share, unless these are windows of one text that overlap.
    """
    # Places of one text differ by the words between them, those of different texts by far more.
    at = F.shiftleft(F.xxhash64("keep.doc_id", "keep.text_key"), 24).bitwiseOR(F.col("keep.first_word").bitwiseAND(F.lit((1 << 24) - 1)).cast("long"))
    found, total = [], 0
    # Band by band, so that the files of one shuffle are gone before the next.
    for k in range(BANDS):
        banded = entries.select("content", at.alias("at"), F.col(f"b{k}").alias("band"))
        buckets = banded.groupBy("band").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).where(f"n > 1 and coalesce(try_subtract(high, low), {WINDOW}) >= {WINDOW}")
        buckets = scratch.keep(buckets.select("band", "n", F.col("n").alias("size")), "buckets")
        bands, rows = buckets.agg(F.count("*"), F.sum("n")).first()
        likely = sifted(banded.drop("at"), buckets, "band", bands)
        found.append(scratch.keep(join_counted(likely, buckets, "band", "n", rows or 0).where("size is not null").select("band", "content", F.col("size").alias("n")), "met"))
        total += rows or 0
    return reduce(DataFrame.unionAll, found), total


def paragraph_links(met: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, total: int) -> DataFrame:
    """Links (a, b) of contents that span the components of colliding, similar paragraphs.

    met: the buckets as `band_buckets` has them; sets: the shingles of each content. All pairs
    of a bucket's entries are checked exactly, but for those that links connect already. A
    bucket of over BLOCK entries is first compared with its first entry; what that leaves
    apart is dealt to pairs of blocks.
    """
    label = F.col("content")
    links = None
    if met.where(F.col("n") > BLOCK).head(1):
        links = scratch.keep(_star_links(met, sets, similarity, total), "star")
        met = met.join(components(links, scratch).toDF("content", "label"), "content", "left")
        label = F.coalesce("label", "content")
    blocks = scratch.keep(_block_pairs(scratch.keep(met.select("band", "content", label.alias("label")), "labelled")), "blocks")
    more = similar_links(blocks.join(sets, "content").select("band", "low", "high", F.col("content").alias("id"), "side", "label", F.col("shingles").alias("s")), ["band", "low", "high"], similarity)
    return more if links is None else links.unionAll(more)


@F.pandas_udf(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())]))
def _equal_words(own: pd.Series, kept: pd.Series) -> pd.DataFrame:
    """How many words before and behind two windows are equal, one after another."""
    n = REACH - 1
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 2, n) for x in (own, kept))
    run = np.logical_and.accumulate((a == b) & (a > 0), 2).sum(2)
    return pd.DataFrame({"left": run[:, 0], "right": run[:, 1]})


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, least_words: int = 25, least_run: int = 40) -> DataFrame:
    """Spans of words that repeat an earlier paragraph of any document.

    Paragraphs are lines of `least_words` or more, and windows of WINDOW words that start at
    content-defined places, so that a passage of 50 words or more has a window inside
    wherever it was pasted. Every paragraph gets a MinHash signature of its five-word shingles,
    cut into bands; equal ones (same words) are one entry, as they share all bands. All pairs
    of entries that collide in a band are verified by their exact Jaccard similarity, unless
    links connect them already, and components of links of `similarity` or more are classes.
    The first paragraph of each class (by doc_id, text and place) is kept; all others are
    spans to remove, windows together with the words around them that equal those around the
    kept one (by a byte per word: an end may take in a word too much with a probability of
    1/255). Spans that touch are merged; those with a whole line stay, and of the others those
    of `least_run` words or more.

    Returns doc_id, first_word, n_words (counted over the text's words, parted by the six
    blanks), kept_doc_id and text_key, which tells texts that share a doc_id apart. Null
    texts, and rows with a null doc_id, have no spans and are left alone; rows equal in doc_id
    and text count as one document; a repetition inside one document is a span as well. A
    paragraph with fewer than LEAST_SHINGLES distinct shingles is none. A very common
    paragraph is a single entry after partial aggregation, and its rows are dealt evenly.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    place = F.struct("doc_id", "text_key", "first_word", "n_words")
    bands = [f"b{k}" for k in range(BANDS)]
    with Scratch(docs.sparkSession) as scratch:
        units = scratch.keep(paragraph_units(docs, least_words), "paragraphs")
        entries = scratch.keep(units.groupBy("content").agg(F.count("*").alias("n"), F.min(place).alias("keep"), *[F.first(b).alias(b) for b in bands]), "entries")
        met, collisions = band_buckets(entries, scratch)
        # What several places hold, or what collides in a band: all that can be in a class of two or more.
        likely = entries.drop(*bands).join(met.select("content").distinct().withColumn("collides", F.lit(True)), "content", "left").where("n > 1 or collides")
        likely = scratch.keep(likely.withColumn("collides", F.coalesce("collides", F.lit(False))), "likely")
        scratch.drop(entries)
        number, total = likely.agg(F.count("*"), F.sum("n")).first()
        rows = join_counted(sifted(units.drop(*bands), likely, "content", number), likely, "content", "n", total or 0).where("keep is not null")
        rows = scratch.keep(rows.select("doc_id", "text_key", "first_word", "n_words", "content", (F.col("collides") & (place == F.col("keep"))).alias("wants")).distinct(), "rows")
        scratch.drop(units)
        read = scratch.keep(paragraph_members(docs, rows), "members")
        sets = read.where("shingles is not null").select("content", "shingles").dropDuplicates(["content"])
        links = scratch.keep(paragraph_links(met, sets, scratch, similarity, collisions), "links")
        reach = components(links, scratch).withColumnRenamed("node", "content")
        classed = likely.join(reach, "content", "left").where("n > 1 or component is not null").select("content", "n", "keep", F.coalesce("component", "content").alias("component"))
        classed = scratch.keep(classed, "classed")
        least = classed.groupBy("component").agg(F.min("keep").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("contents"))
        classes = scratch.keep(join_counted(classed, least, "component", "contents", total or 0).select("content", "n", "first", "rows"), "classes")
        members = join_counted(read.drop("shingles"), classes, "content", "n", total or 0).where("first is not null")
        members = scratch.keep(members.select("doc_id", "text_key", "first_word", "n_words", "around", F.xxhash64("first").alias("class"), "first", "rows"), "classed-members")
        kept = members.where(place == F.col("first")).select("class", "rows", F.col("around").alias("kept_around")).dropDuplicates(["class"])
        # A window that overlaps the kept one is not its repetition.
        other = (place != F.col("first")) & ~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("first_word") < F.col("first.first_word") + F.col("first.n_words")))
        met = join_counted(members.where(other).drop("rows"), kept, "class", "rows", total or 0)
        none = F.lit(bytes(2 * (REACH - 1)))
        met = met.withColumn("more", _equal_words(F.coalesce("around", none), F.coalesce("kept_around", none)))
        spans = met.select("doc_id", "text_key", (F.col("first_word") - F.col("more.left")).alias("first_word"), (F.col("first_word") + F.col("n_words") + F.col("more.right")).alias("last_word"), F.col("first.doc_id").alias("kept_doc_id"), F.col("around").isNull().alias("line"))
        found = _islands(spans.distinct()).withColumn("n_words", F.col("last_word") - F.col("first_word"))
        return stored(found.where(f"line or n_words >= {least_run}").select("doc_id", "first_word", "n_words", "kept_doc_id", "text_key"), "spans")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; blanks before the next word go as well."""
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for first, n in sorted(spans):
        out.append(data[at : starts[min(first, len(starts) - 1)]])
        at = starts[min(first + n, len(starts) - 1)]
    return b"".join([*out, data[at:]]).decode()


def remove_spans(docs: DataFrame, spans: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the spans cut out of their texts; adds cut_words, how many went.

    A span belongs to the rows with its doc_id and text; rows with a null doc_id or text,
    which have no spans, are dealt evenly in the join.
    """
    listed = spans.groupBy(F.col("doc_id").alias("id__"), F.col("text_key").alias("key__")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans__"), F.sum("n_words").alias("cut_words")).withColumn("salt__", F.lit(0).cast("long"))
    docs = without(docs, "cut_words")
    own = [F.col(f"`{c}`") for c in docs.columns]

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut_spans(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(texts, some, strict=True)], dtype=object)

    at = docs.select(F.struct(*own).alias("row__"), F.col(f"`{doc_id}`").cast("long").alias("doc__"), F.xxhash64(F.col(f"`{text}`")).alias("text_key__"), F.col(f"`{text}`").alias("text__"))
    at = at.withColumn("at__", F.when(F.col("doc__").isNotNull() & F.col("text__").isNotNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
    met = at.join(listed, (F.col("doc__") == F.col("id__")) & (F.col("text_key__") == F.col("key__")) & (F.col("at__") == F.col("salt__")), "left").withColumn("text__", cut_out("text__", "spans__"))
    return met.select(*[F.col("text__").alias(text) if c == text else F.col("row__")[c].alias(c) for c in docs.columns], F.coalesce("cut_words", F.lit(0).cast("long")).alias("cut_words"))
