"""Unigram pieces: counting tokens with an automaton, encoding and decoding over a trie."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Scores are whole multiples of 1/UNIT, so sums are exact in any order and in 32-bit floats.
UNIT = 16
#: What an unknown character costs below the lowest score, and kinds of pieces.
UNKNOWN_PENALTY, NORMAL, BYTE = 10, 1, 6


@dataclass(frozen=True)
class Vocabulary:
    """pieces by id; units: score of each in 1/UNIT, None if a text can't match it; byte_ids."""

    pieces: tuple[str, ...]
    units: tuple[int | None, ...]
    byte_ids: tuple[int, ...]

    @property
    def unknown_units(self) -> int:
        return min(u for u in self.units if u is not None) - UNKNOWN_PENALTY * UNIT

    @property
    def breaks(self) -> str:
        """Line feed if no piece holds it: texts can be cut around it."""
        return "" if any("\n" in p for p, u in zip(self.pieces, self.units, strict=True) if u is not None) else "\n"

    def __post_init__(self) -> None:
        if any(MARK in p.lstrip(MARK) for p, u in zip(self.pieces, self.units, strict=True) if u is not None):
            raise ValueError("a piece has the space marker behind another character")


def rank_vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a published model with byte fallback, scored by rank.

    No unigram model is at hand, so Zipf's law gives the log scores: -ln(rank + 2), where the
    rank is the order in which the file lists its ordinary pieces, to 1/UNIT.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    pieces = tuple(model.id_to_piece(i) for i in ids)
    ordinary = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    units: list[int | None] = [None] * len(pieces)
    for rank, i in enumerate(ordinary):
        units[i] = -round(UNIT * log(rank + 2))
    return Vocabulary(pieces, tuple(units), tuple(next(i for i in ids if pieces[i] == f"<0x{b:02X}>") for b in range(256)))


def segments(text: str | None, breaks: str) -> list[str]:
    """Parts of the marked text that no piece crosses: runs of markers with what follows."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if breaks:
        marked = marked.replace("\n", " \n ")
    if MARK + MARK in marked:
        return [s for part in marked.split(" ") for s in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", part)]
    return [s for s in marked.replace(MARK, " " + MARK).split(" ") if s]


class Counter(dict):
    """For a segment: best score in units and number of pieces, packed into one number.

    The automaton lists all pieces that end at a character, the longest first. A later
    candidate replaces an earlier one only if its score is higher, so of equal paths the one
    whose last piece is longest stays. A character without a piece of its own counts as
    unknown and as one piece per UTF-8 byte. No path is kept, only score and count.
    """

    SHIFT = 40

    def __init__(self, vocabulary: Vocabulary, most: int = 800_000):
        import ahocorasick

        super().__init__()
        self.most, self.unknown = most, vocabulary.unknown_units
        self.automaton = ahocorasick.Automaton()
        for piece, units in zip(vocabulary.pieces, vocabulary.units, strict=True):
            if units is not None:
                self.automaton.add_word(piece, (len(piece), units))
        self.automaton.make_automaton()

    def best(self, segment: str) -> tuple[int, int]:
        score: list[int | None] = [0] + [None] * len(segment)
        count = [0] * (len(segment) + 1)
        done = 0

        def unknown(upto: int) -> None:
            """Settles the ends up to `upto` that have no piece of one character."""
            nonlocal done
            for end in range(done + 1, upto + 1):
                if not single[end]:
                    new = score[end - 1] + self.unknown
                    if score[end] is None or new > score[end]:
                        score[end], count[end] = new, count[end - 1] + len(segment[end - 1].encode())
            done = max(done, upto)

        single = [False] * (len(segment) + 1)
        for at, (length, units) in self.automaton.iter(segment):
            end = at + 1
            unknown(end - 1)
            single[end] = single[end] or length == 1
            new = score[end - length] + units
            if score[end] is None or new > score[end]:
                score[end], count[end] = new, count[end - length] + 1
        unknown(len(segment))
        return score[-1], count[-1]

    def __missing__(self, segment: str) -> int:
        if len(self) >= self.most:
            self.clear()
        score, count = self.best(segment)
        packed = -score << self.SHIFT | count
        if len(segment) <= 64:
            self[segment] = packed
        return packed


class Trie:
    """A double array over the UTF-8 bytes of the pieces: state s goes by byte b to base[s] + b."""

    def __init__(self, vocabulary: Vocabulary):
        tree: list[dict[int, int]] = [{}]
        leaf: dict[int, int] = {}
        for i, (piece, units) in enumerate(zip(vocabulary.pieces, vocabulary.units, strict=True)):
            if units is None:
                continue
            at = 0
            for b in piece.encode():
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                at = tree[at][b]
            leaf[at] = i
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        #: First free cell (a byte below it leaves room for any base), and where the search for nodes of several children begins.
        free, wide, queue = 257, 1, deque([(0, 0)])
        while queue:
            node, state = queue.popleft()
            self.value[state] = leaf.get(node, -1)
            below = sorted(tree[node])
            if not below:
                continue
            self._room(free)
            while self.check[free] >= 0:
                free += 1
                self._room(free)
            base = begun = max(1, free - below[0], wide if len(below) > 1 else 1)
            self._room(base)
            while any(self.check[base + b] >= 0 for b in below):
                base += 1
                self._room(base)
            if base - begun > 64:
                wide = base - 64
            self.base[state] = base
            for b in below:
                self.check[base + b] = state
                queue.append((tree[node][b], base + b))

    def _room(self, base: int) -> None:
        while base + 256 >= len(self.base):
            n = len(self.base)
            self.base += [0] * n
            self.check += [-1] * n
            self.value += [-1] * n


class Encoder(dict):
    """For a segment: the ids of its best path as little-endian bytes, and the bytes these decode to.

    Segments are encoded and decoded one by one, and what a text's segments give is joined:
    no piece crosses two segments, and the bytes of a run of ids are those of each in turn.
    """

    def __init__(self, vocabulary: Vocabulary, trie: Trie, most: int = 500_000):
        super().__init__()
        self.most, self.unknown, self.byte_ids = most, vocabulary.unknown_units, vocabulary.byte_ids
        self.units, self.trie = vocabulary.units, trie
        of_byte = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.bytes_of = [of_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(vocabulary.pieces)]

    def best(self, segment: str) -> list[int]:
        """Viterbi over bytes: starts ascend, and only a higher score replaces a path."""
        data, base, check, value, units = segment.encode(), self.trie.base, self.trie.check, self.trie.value, self.units
        n = len(data)
        low = -(1 << 62)
        score = [0] + [low] * n
        origin, piece = [0] * (n + 1), [-1] * (n + 1)
        start = 0
        while start < n:
            first = data[start]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, single, state, end = score[start], False, 0, start
            # A state without children has base 0, and no cell below 257 belongs to a state.
            for byte in data[start:]:
                end += 1
                to = base[state] + byte
                if check[to] != state:
                    break
                state, found = to, value[to]
                if found >= 0:
                    new = here + units[found]
                    if new > score[end]:
                        score[end], origin[end], piece[end] = new, start, found
                    if end - start == width:
                        single = True
            if not single:
                new, end = here + self.unknown, start + width
                if new > score[end]:
                    score[end], origin[end], piece[end] = new, start, -1
            start += width
        ids: list[int] = []
        end = n
        while end:
            start = origin[end]
            ids += [piece[end]] if piece[end] >= 0 else [self.byte_ids[b] for b in reversed(data[start:end])]
            end = start
        return ids[::-1]

    def __missing__(self, segment: str) -> tuple[bytes, bytes]:
        if len(self) >= self.most:
            self.clear()
        ids = self.best(segment)
        both = np.array(ids, "<i4").tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(segment) <= 64:
            self[segment] = both
        return both

    def decode(self, ids: list[int]) -> str:
        """Pieces and fallback bytes joined, markers as spaces, without the leading one."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


#: Built tables of a worker process, kept between its tasks.
_KEPT: dict[tuple[str, Vocabulary], dict] = {}


def _kept(kind: str, vocabulary: Vocabulary, make) -> dict:
    if (kind, vocabulary) not in _KEPT:
        _KEPT[kind, vocabulary] = make()
    return _KEPT[kind, vocabulary]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of pieces and best score of every whole text, without making the pieces.

    Returns doc_id, n_tokens (long) and score (double). Null and empty texts have none and
    score 0. Rows and their order are as read; nothing is shuffled, and a long text needs
    memory in proportion to its length only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_tokens long, score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _kept("count", shared.value, lambda: Counter(shared.value))
        breaks, mask = shared.value.breaks, (1 << Counter.SHIFT) - 1
        for batch in batches:
            sums = [sum(map(counter.__getitem__, segments(t, breaks))) for t in batch]
            yield pd.DataFrame({"n_tokens": [s & mask for s in sums], "score": [-(s >> Counter.SHIFT) / UNIT for s in sums]})

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), count(F.col(f"`{text}`")).alias("made")).select("doc_id", "made.*")


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text", slice_rows: int = 200) -> DataFrame:
    """Ids of every whole text and the text that they decode to: doc_id, text, ids, decoded.

    Results leave the worker every `slice_rows` rows, which bounds its memory.

    Null and empty texts have no ids and decode to an empty text. A text that holds the
    space marker itself decodes to spaces there, as the marking can't tell them apart.
    """
    context = docs.sparkSession.sparkContext
    shared, trie = context.broadcast(vocabulary), context.broadcast(Trie(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept("encode", shared.value, lambda: Encoder(shared.value, trie.value))
        breaks = shared.value.breaks
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                made = [list(map(encoder.__getitem__, segments(t, breaks))) for t in part.column(1).to_pylist()]
                ids = [b"".join([x for x, _ in m]) for m in made]
                decoded = [b"".join([x for _, x in m]).removeprefix(b" ") for m in made]
                offsets = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "text", "ids", "decoded"])

    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(encode, "doc_id long, text string, ids array<int>, decoded string")


def ids_digest(ids: str = "ids") -> Column:
    """CRC-32 of the ids as text parted by spaces, with built-in functions."""
    return F.crc32(F.encode(F.array_join(F.col(ids).cast("array<string>"), " "), "UTF-8")).cast("long")
