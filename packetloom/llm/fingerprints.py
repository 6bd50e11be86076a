"""Document fingerprints as invertible Bloom lookup sketches, with built-in functions only."""

from __future__ import annotations

from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored

#: Cells of a table: three parts, and a key has one cell in each. Peeling rounds. Keys that
#: a table is meant for, and how often the number of tables may double.
PART, CELLS, ROUNDS, LOAD, RETRIES = 8, 24, 12, 6, 3
_EMPTY = "cast(array() AS array<bigint>)"
#: A paragraph ends with a sentence whose digest has none of these bits: two sentences on average.
GRAIN = 1


def _mask(key: str) -> str:
    """SQL for the cells of a key in a table as bits: one of each part, by three bits of the key."""
    return " | ".join(f"shiftleft(1, {PART * t} + cast(shiftright({key}, {5 * t + 3}) & {PART - 1} AS int))" for t in range(CELLS // PART))


def by_table(keys: str, tables: str) -> str:
    """SQL for the keys of each table; a key's table is given by bits of its own.

    Keys are dealt to groups of tables first, so the steps are keys times the square root of
    the tables. `tables` is SQL for a power of two.
    """
    number = "pmod(shiftright(k, 24), z.t)"
    groups = f"transform(sequence(0, z.r - 1), g -> filter({keys}, k -> {number} div z.w = g))"
    split = f"flatten(transform({groups}, own -> transform(sequence(0, z.w - 1), t -> filter(own, k -> {number} % z.w = t))))"
    root = "cast(shiftleft(1, cast(ceil(log2(v) / 2) AS int)) AS int)"
    return f"transform(transform(array({tables}), v -> named_struct('t', v, 'r', {root}, 'w', cast(v / {root} AS int))), z -> CASE WHEN z.t = 1 THEN array({keys}) ELSE {split} END)[0]"


def sketch(keys: str, tables: str) -> str:
    """SQL for the cells of all tables: number of keys, their exclusive-or, that of their checks."""
    marked = f"transform(own, k -> named_struct('k', k, 'h', hash(k), 'm', {_mask('k')}))"
    cell = "aggregate(filter(u, x -> bit_get(x.m, j) = 1), named_struct('n', 0, 'k', 0L, 'c', 0), (a, x) -> named_struct('n', a.n + 1, 'k', a.k ^ x.k, 'c', a.c ^ x.h))"
    return f"flatten(transform(transform({by_table(keys, tables)}, own -> {marked}), u -> transform(sequence(0, {CELLS - 1}), j -> {cell})))"


def fold(cells: str, tables: str, to: str) -> str:
    """SQL for the sketch in fewer tables (both powers of two): the cells that meet are added."""
    return f"""CASE WHEN {tables} = {to} THEN {cells} ELSE transform(sequence(0, {CELLS} * {to} - 1), j -> aggregate(sequence(0, cast({tables} / {to} AS int) - 1), named_struct('n', 0, 'k', 0L, 'c', 0),
      (a, i) -> named_struct('n', a.n + {cells}[j + i * {CELLS} * {to}].n, 'k', a.k ^ {cells}[j + i * {CELLS} * {to}].k, 'c', a.c ^ {cells}[j + i * {CELLS} * {to}].c))) END"""


def peels(keys: str, tables: str) -> str:
    """SQL that tells whether a sketch of these keys alone can be peeled, by the masks of the keys."""
    seen = "aggregate(s, named_struct('one', 0, 'two', 0), (a, m) -> named_struct('one', a.one | m, 'two', a.two | (a.one & m)))"
    step = f"CASE WHEN size(s) = 0 THEN s ELSE transform(array({seen}), p -> filter(s, m -> (m & p.one & ~p.two) = 0))[0] END"
    return f"forall({by_table(keys, tables)}, own -> size(aggregate(sequence(1, {ROUNDS}), transform(own, k -> {_mask('k')}), (s, r) -> {step})) = 0)"


def tables_for(keys: str) -> str:
    """SQL for the number of tables: the first power of two in which the keys can be peeled.

    It begins with LOAD keys for a table and doubles on failure, RETRIES times at most.
    """
    first = f"cast(shiftleft(1, cast(ceil(log2(greatest(size({keys}), {LOAD}) / {LOAD}D)) AS int)) AS int)"
    tries = " ".join(f"WHEN {peels(keys, f'({2**k} * f)')} THEN {2**k} * f" for k in range(RETRIES))
    return f"transform(array({first}), f -> CASE {tries} ELSE {2**RETRIES} * f END)[0]"


def difference(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def peel(cells: str) -> str:
    """SQL that takes pure cells out until none is left: ok, and the keys of either side.

    Odd rounds list the keys of pure cells (one key by count and check), even rounds take
    these out of every cell that has them, or end the peeling if there are none.
    """
    kind = "struct<n: int, k: bigint, h: int, m: int>"
    pure = f"array_distinct(transform(filter(s.d, x -> abs(x.n) = 1 and x.c = hash(x.k)), x -> named_struct('n', x.n, 'k', x.k, 'h', x.c, 'm', {_mask('x.k')})))"
    taken = "transform(s.d, (x, j) -> aggregate(filter(s.q, q -> bit_get(q.m, j) = 1), x, (a, q) -> named_struct('n', a.n - q.n, 'k', a.k ^ q.k, 'c', a.c ^ q.h)))"
    none = f"cast(array() AS array<{kind}>)"
    step = f"CASE WHEN s.e THEN s WHEN r % 2 = 1 THEN named_struct('d', s.d, 'q', {pure}, 'o', s.o, 'e', false) WHEN size(s.q) = 0 THEN named_struct('d', s.d, 'q', s.q, 'o', s.o, 'e', true) ELSE named_struct('d', {taken}, 'q', {none}, 'o', concat(s.o, s.q), 'e', false) END"
    state = f"aggregate(sequence(1, {2 * ROUNDS}), named_struct('d', {cells}, 'q', {none}, 'o', {none}, 'e', false), (s, r) -> {step})"
    return f"transform(array({state}), s -> named_struct('ok', forall(s.d, x -> x.n = 0 and x.k = 0), 'a', size(filter(s.o, q -> q.n = 1)), 'b', size(filter(s.o, q -> q.n = -1))))[0]"


def decode(left: str, right: str, tables: str) -> str:
    """SQL for the numbers of keys that either of two sketches alone has; null if a table resists."""
    each = f"transform(array({difference(left, right)}), w -> transform(transform(sequence(0, {tables} - 1), t -> slice(w, {CELLS} * t + 1, {CELLS})), d -> {peel('d')}))[0]"
    total = "aggregate(r, named_struct('a', 0, 'b', 0), (s, x) -> named_struct('a', s.a + x.a, 'b', s.b + x.b))"
    return f"transform(array({each}), r -> CASE WHEN forall(r, x -> x.ok) THEN {total} END)[0]"


def sentences(text: str) -> str:
    """SQL for the digests of a text's sentences, in order: up to `.`, `!`, `?`, a line feed or 200 characters."""
    return f"transform(filter(regexp_extract_all({text}, '[^.!?\\n]{{1,200}}', 0), x -> trim(x) <> ''), x -> xxhash64(trim(x)))"


def paragraphs(digests: str) -> str:
    """SQL for distinct digests of paragraphs: runs of sentences up to one whose digest has no
    bit of GRAIN. Cuts depend on the content, so an edit leaves the others as they are, and the
    grain is the same for texts of any length."""
    ends = f"filter(sequence(0, size({digests}) - 1), i -> ({digests}[i] & {GRAIN}) = 0 or i = size({digests}) - 1)"
    run = f"xxhash64(slice({digests}, coalesce(get(e, n - 1), -1) + 2, i - coalesce(get(e, n - 1), -1)))"
    return f"CASE WHEN size({digests}) = 0 THEN {_EMPTY} ELSE array_distinct(transform(array({ends}), e -> transform(e, (i, n) -> {run}))[0]) END"


def as_hex(cells: str) -> str:
    """SQL for a fingerprint's text: of each cell count, keys and checks, or a dot if it is empty."""
    return f"array_join(transform({cells}, x -> CASE WHEN x.n = 0 THEN '.' ELSE concat(lpad(hex(x.n), 4, '0'), lpad(hex(x.k), 16, '0'), right(lpad(hex(x.c), 8, '0'), 8)) END), '')"


def likeness(left: str, right: str) -> str:
    """SQL for the share of common paragraphs in all, from two structs of keys p, tables n and cells c.

    The sketches are brought to the smaller number of tables, subtracted and peeled. If that
    fails, each one is peeled alone, at its own size, and the keys are compared: that this
    succeeds was made sure of when its size was chosen, so the keys at hand are taken for it.
    Either way the result depends on the two fingerprints alone.
    """
    to = f"least({left}.n, {right}.n)"
    peeled = decode(fold(f"{left}.c", f"{left}.n", to), fold(f"{right}.c", f"{right}.n", to), to)
    alone = f"named_struct('a', size(array_except({left}.p, {right}.p)), 'b', size(array_except({right}.p, {left}.p)))"
    return f"transform(array(coalesce({peeled}, {alone})), d -> CASE WHEN size({left}.p) + d.b = 0 THEN 1D ELSE cast(size({left}.p) - d.a AS double) / (size({left}.p) + d.b) END)[0]"


def sketched(digests: str) -> str:
    """SQL for a struct of a text's paragraphs p, the number of tables n and the cells c."""
    sized = f"transform(array({paragraphs(digests)}), p -> named_struct('p', p, 'n', {tables_for('p')}))"
    return f"transform({sized}, q -> named_struct('p', q.p, 'n', q.n, 'c', {sketch('q.p', 'q.n')}))[0]"


def range_of(doc_id: Column, edges: list) -> Column:
    """The number of edges below an id, by a search in two steps of about the root of their number."""
    width = max(1, isqrt(len(edges)))
    blocks = [edges[k : k + width] for k in range(0, len(edges), width)]
    block = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks]), lambda e: e < doc_id))
    inner = F.coalesce(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block), F.array(F.lit(edges[-1])))
    return block * width + F.size(F.filter(inner, lambda e: e < doc_id))


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows_per_part: int = 2000, most_parts: int = 10_000) -> DataFrame:
    """Fingerprints every text and its edited text, and compares them by their sketches.

    The edited text has the last quarter of the characters replaced by as many from the
    start of the next document (by doc_id; after the last comes the first). A fingerprint
    is the sketch of the text's paragraphs in as many tables of 24 cells as let it be peeled,
    as hex digits. Two are compared by subtracting the cells and peeling.

    Documents are dealt by ranges of doc_id (quantiles, found without sorting); only the
    first document of each range, whose number is in proportion to the ranges, is joined to
    the range before it. There are up to `most_parts` ranges; beyond, they grow and their
    rows are sorted on disk. An id that fills several ranges is split by a hash of the text.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty: its sketch has no keys and is like another empty
    one (1.0); a single document is its own next one; repeated doc_ids follow one another in
    the order of a hash of their texts; null doc_ids come first.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    docs = docs.withColumn("u", F.shiftrightunsigned(F.xxhash64("t"), 1))
    rows = docs.count()
    parts = max(1, min(most_parts, rows // rows_per_part))
    edges = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10000).alias("e")).first()["e"] if parts > 1 and rows else None
    many = Counter(edges or [])
    edges = sorted(many)
    part: Column = F.lit(0).cast("long")
    if edges:
        part = F.coalesce(range_of(F.col("doc_id"), edges), F.lit(0)).cast("long") * F.lit(2 * most_parts)
        if hot := {e: n for e, n in many.items() if n > 1}:
            share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.coalesce("doc_id", F.lit(edges[0]))), F.lit(0))
            part = part + F.when(F.col("doc_id").isNotNull() & (share > 0), 1 + F.floor(F.col("u") / F.lit(2.0**63) * share)).otherwise(0)
    docs = docs.select("doc_id", "t", "u", part.alias("part"))
    firsts = stored(docs.groupBy("part").agg(F.min(F.struct("doc_id", "u", "t")).alias("f")), "firsts")
    # Ranges are few; those without rows have no entry, so each points at the next that has one.
    order = [r["part"] for r in firsts.select("part").orderBy("part").collect()]
    after = docs.sparkSession.createDataFrame([(p, order[(k + 1) % len(order)]) for k, p in enumerate(order)], "part long, after long")
    lead = firsts.select(F.col("part").alias("after"), F.col("f.t").alias("ft")).join(after, "after").select("part", "ft")
    order_by = Window.partitionBy("part").orderBy("doc_id", "u", "t")
    step = docs.withColumn("next", F.lead("t").over(order_by)).join(lead, "part").select("doc_id", "t", F.coalesce("next", "ft").alias("nt"))
    step = step.withColumn("n_chars", F.char_length("t").cast("long"))
    quarter = "cast(floor(n_chars / 4) AS int)"
    step = step.withColumn("et", F.expr(f"concat(left(t, cast(n_chars AS int) - {quarter}), left(nt, {quarter}))"))
    made = [f"transform(array({sentences(x)}), y -> {sketched('y')})[0]" for x in ("t", "et", "nt")]
    # A lambda variable holds the three sketches, so that each is made once.
    step = step.withColumn("r", F.expr(f"transform(array(named_struct('x', {made[0]}, 'e', {made[1]}, 'n', {made[2]})), s -> named_struct('f', {as_hex('s.x.c')}, 'g', {as_hex('s.e.c')}, 'a', {likeness('s.x', 's.e')}, 'b', {likeness('s.x', 's.n')}))[0]"))
    return step.select("doc_id", "n_chars", F.sha2(F.encode("et", "UTF-8"), 256).alias("edited_sha256"), F.inline(F.array(F.struct(F.col("r.f").alias("fingerprint"), F.col("r.g").alias("edited_fingerprint"), F.col("r.a").alias("near_edited"), F.col("r.b").alias("near_next")))))
