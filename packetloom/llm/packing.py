"""Packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil
from pathlib import Path
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import releasing, stored

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class ChunkIds(dict):
    """Ids of texts between blanks as little-endian bytes; forgets all when full.

    Blanks part the tokens of a tokenizer that drops white space, so a text's ids are the
    ids of its chunks one after another. Letters and a comma or full stop behind them are
    tokens apart, so such a chunk is put together from its word and its mark. A word of
    lower-case letters in normal form is a single part that no step before the model changes
    but the writing of its bytes as letters, so it goes to the model at once.
    """

    def __init__(self, definition: str, most: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_str(definition), most

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        word, end = chunk.decode(), chunk[-1:]
        if end in b",." and word[:-1].isalpha():
            ids = self[chunk[:-1]] + self[end]
        elif word.isalpha() and word == word.lower() and is_normalized("NFC", word):
            found = self.tokenizer.model.tokenize("".join(map(_BYTE_LETTERS.__getitem__, chunk)))
            ids = np.array([t.id for t in found], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        """The tokenizer lower-cases itself; doing so before finds more chunks in the table.

        A special token's name must keep its case, so a text that may hold one is left as it is.
        """
        data = (text or "").encode()
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


#: Chunk tables of a worker process by definition, kept between its tasks.
_KEPT: dict[str, ChunkIds] = {}


def token_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids and `end_id`, cut every `capacity` ids.

    The tokenizer's definition (a bounded file) goes to the tasks as a broadcast value.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _KEPT.get(shared.value) or _KEPT.setdefault(shared.value, ChunkIds(shared.value))
        for batch in batches:
            made = []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = chunks.of(value) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    made.append((row, piece, at // 4, len(part) // 4, crc32(part)))
            rows = list(np.array(made, np.int64).reshape(-1, 5).T)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), pa.array(rows[1].astype(np.int32)), *map(pa.array, rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(releasing(cut_up), PIECES)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how many sequences have each.

    Works on the number of pieces of each length, so its cost depends on the capacity only.
    First the complement of each length, longest first, is looked up among single lengths,
    then sums of two, then of three; a combination that fills the gap exactly is consumed as
    often as its availability allows. What is left goes to the tightest gap that takes it,
    longest first, all sequences of one pattern at a time.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    def most(combination: tuple[int, ...]) -> int:
        return min(left[x] // k for x, k in Counter(combination).items())

    def consume(combination: tuple[int, ...]) -> bool:
        n = int(most(combination))
        if n:
            for x in combination:
                left[x] -= n
            done.append((combination, n))
        return n > 0

    def pair(first: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        """The combination with the longest second part that fills the gap with two more."""
        have = left.copy()
        for x in first:
            have[x] -= 1
        x = np.arange((gap + 1) // 2, gap)
        fits = (have[x] > 0) & (have[gap - x] > 0) & ((2 * x != gap) | (have[x] > 1))
        at = np.flatnonzero(fits)
        return (*first, int(x[at[-1]]), int(gap - x[at[-1]])) if at.size else None

    for a in range(capacity, 0, -1):
        gap = capacity - a
        while left[a]:
            if gap == 0:
                consume((a,))
                continue
            if left[gap] > (a == gap) and consume((a, gap)):
                continue
            found = pair((a,), gap) if gap > 1 else None
            if not found and gap > 2:
                for b in np.flatnonzero(left[: gap - 1])[::-1]:
                    if 3 * b < gap:
                        break
                    if left[b] > (a == b) and (found := pair((a, int(b)), gap - int(b))):
                        break
            if not found or not consume(found):
                break

    gaps: list[int] = []
    open_by_gap: defaultdict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap == 0:
            done.append((pattern, n))
            return
        if not open_by_gap[gap]:
            insort(gaps, gap)
        open_by_gap[gap].append((pattern, n))

    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            at = bisect_left(gaps, a)
            if at < len(gaps):
                gap = gaps[at]
                pattern, there = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps.pop(at)
                used = min(n, there)
                if there > used:
                    put(pattern, there - used)
                put((*pattern, a), used)
                n -= used
            else:
                each = min(n, capacity // a)
                put((a,) * each, n // each)
                n -= n // each * each
    return done + [x for group in open_by_gap.values() for x in group]


def rank_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: first rank, first sequence and offset of each run of pieces, by rank."""
    taken: Counter[int] = Counter()
    runs: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: np.array(found, np.int64).T.copy() for length, found in runs.items()}


def pack_best_fit(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs the token pieces of all documents into as few sequences as it can.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 and the sequence_id and
    offset where it goes. The driver only gets the number of pieces of each length (at most
    `capacity` rows) and sends the plan back (a few runs per length, bounded by the capacity
    as well). A piece's rank among those of its length picks its run; ranks are counted
    within salted parts of each length and the parts added up, so a length that a third of
    all pieces has is spread over tasks. A null or empty text is the end id alone; repeated
    rows are packed each; a null doc_id stays null; an empty table gives an empty result;
    other columns are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = docs.sparkSession.sparkContext.broadcast(rank_table(plan_patterns(counts, capacity)))
    salts = max(64, ceil(sum(counts.values()) / 200_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt")
    first = parts.select("length", "salt", (F.sum("n").over(earlier) - F.col("n")).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("salt", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                starts, sequences, offsets = runs.value[int(length)]
                run = np.searchsorted(starts, ranks[at], "right") - 1
                sequence[at], offset[at] = sequences[run] + ranks[at] - starts[run], offsets[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(releasing(place), f"{PIECES}, sequence_id long, offset long")
