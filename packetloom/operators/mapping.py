"""Label tables in one schema, flow summaries, and the match of flows to labels by address and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import micros

FIELDS = ("src_ip", "src_port", "dst_ip", "dst_port")
REVERSE = {"src_ip": "dst_ip", "src_port": "dst_port", "dst_ip": "src_ip", "dst_port": "src_port"}
#: Labels of one key that flows meet one by one; beyond, they are summed up by blocks of time.
FEW = 32
#: Blocks of time are powers of two of a microsecond; ORIGIN keeps times positive.
LEVELS, ORIGIN = 56, 1 << 54
#: Date patterns by the order of day and month; the other order is tried where the first fails.
_ISO = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
_DAY_FIRST = ("d/M/yyyy H:m[:s][.SSSSSS]", "d/M/yyyy h:m[:s] a", "d-M-yyyy H:m[:s]", "d.M.yyyy H:m[:s]", "d/M/yyyy", "d/M/yy H:m[:s]")
_MONTH_FIRST = ("M/d/yyyy H:m[:s][.SSSSSS]", "M/d/yyyy h:m[:s] a", "M-d-yyyy H:m[:s]", "M.d.yyyy H:m[:s]", "M/d/yyyy", "M/d/yy H:m[:s]")


def flow_summary(df: DataFrame, flow: str = "flow_id", ts: str = "timestamp", index: str = "packet_index", firsts: tuple[str, ...] = (*FIELDS, "protocol")) -> DataFrame:
    """One row per flow: its first known values in time order, start, end and packets; null flows drop."""
    order = F.struct(ts, index)
    return df.where(F.col(flow).isNotNull()).groupBy(flow).agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in firsts], F.min(ts).alias("flow_start"), F.max(ts).alias("flow_end"), F.count("*").alias("packet_count"))


def mixed_timestamp(text: Column, day_first: bool = True) -> Column:
    """A time in any of the usual forms, day before month unless that fails; null if none fits."""
    text = F.trim(text)
    patterns = (*_ISO, *((_DAY_FIRST + _MONTH_FIRST) if day_first else (_MONTH_FIRST + _DAY_FIRST)))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def flow_id_parts(text: Column) -> dict[str, Column]:
    """Addresses and ports of identifiers like 10.0.0.1-80-10.0.0.2-443 (or with colons)."""
    quad, out = r"((?:\d{1,3}\.){3}\d{1,3})", {}
    for k, name in enumerate(FIELDS, 1):
        part = F.nullif(F.regexp_extract(text, rf"{quad}[-:](\d+)[-:]{quad}[-:](\d+)", k), F.lit(""))
        out[name] = part if name.endswith("ip") else part.try_cast("int")
    return out


def first_quad(text: Column) -> Column:
    """The first dotted quad of a text."""
    return F.nullif(F.regexp_extract(text, r"((?:\d{1,3}\.){3}\d{1,3})", 1), F.lit(""))


def first_known(df: DataFrame, names: list[str]) -> Column | None:
    """The first of the named columns that the table has, as text."""
    return next((F.col(f"`{n}`").cast("string") for n in names if n in df.columns), None)


def ingest_labels(df: DataFrame, aliases: dict[str, list[str]], row: str, *, default: str = "unknown", day_first: bool = True, source_file: str | None = None, domain: str | None = None) -> DataFrame:
    """A label table in the common schema; `row` is its column with the place in the file.

    aliases: for label, start, end, src_ip, src_port, dst_ip, dst_port and flow_id the
    columns that may hold it, in order. Of the label columns the first that is not blank in
    a row counts, of the others the first that the table has. Addresses are the first dotted
    quad of a text, ports whole numbers, times any of the usual forms; what is missing comes
    from the flow identifier, if there is one.
    """
    there = [c for c in aliases.get("label", []) if c in df.columns]
    labels = [F.when(~F.col(f"`{c}`").cast("string").rlike(r"^\s*$"), F.col(f"`{c}`").cast("string")) for c in there]
    none = F.lit(None).cast("string")
    found = {k: first_known(df, aliases.get(k, [])) for k in ("start", "end", "flow_id", *FIELDS)}
    parts = flow_id_parts(found["flow_id"]) if found["flow_id"] is not None else {}

    def field(name: str) -> Column:
        col = found[name]
        own = F.lit(None) if col is None else first_quad(col) if name.endswith("ip") else F.when(col.try_cast("double") == F.floor(col.try_cast("double")), col.try_cast("double").try_cast("int"))
        return F.coalesce(own.cast("string" if name.endswith("ip") else "int"), *([parts[name]] if parts else []))

    time = {k: none.cast("timestamp") if found[k] is None else mixed_timestamp(found[k], day_first) for k in ("start", "end")}
    return df.select(F.col(row).cast("long").alias("csv_row"), (F.coalesce(*labels) if labels else F.lit(default)).alias("label"), time["start"].alias("label_timestamp"), time["end"].alias("label_end_timestamp"), *[field(n).alias(n) for n in FIELDS], F.lit(source_file).cast("string").alias("source_file"), F.lit(domain).cast("string").alias("source_domain"))


def normalize_labels(df: DataFrame, label_columns: list[str], address: dict[str, str]) -> DataFrame:
    """First non-blank label of several columns; first dotted quad of a column for each address (output to input)."""
    some = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in label_columns]
    return df.withColumns({"label": F.coalesce(*some)} | {out: first_quad(F.col(c)) for out, c in address.items()})


def _blocks(low: str, high: str) -> str:
    """SQL for the fewest blocks (level, number) that make up the times from low to before high."""
    kind = "array<struct<level: int, block: bigint>>"
    left = "CASE WHEN s.a % 2 = 1 THEN array(named_struct('level', k, 'block', s.a)) ELSE cast(array() AS {}) END".format(kind)
    right = "CASE WHEN s.b % 2 = 1 THEN array(named_struct('level', k, 'block', s.b - 1)) ELSE cast(array() AS {}) END".format(kind)
    step = f"CASE WHEN s.a >= s.b THEN s ELSE named_struct('a', (s.a + s.a % 2) div 2, 'b', s.b div 2, 'o', concat(s.o, {left}, {right})) END"
    return f"aggregate(sequence(0, {LEVELS}), named_struct('a', {low}, 'b', {high}, 'o', cast(array() AS {kind})), (s, k) -> {step}, s -> s.o)"


def map_labels(flows: DataFrame, labels: DataFrame, fields: dict[str, str] | None = None, reverse: dict[str, str] | None = None, tolerance: float = 5.0, default: str = "unknown", few: int = FEW) -> DataFrame:
    """Every flow with its best label, status and confidence.

    fields: label column to flow column; a label agrees with a flow if all fields that it
    knows are equal, in the flow's own direction or, with `reverse`, in the swapped one.
    Without timed candidates the first label in file order counts (0.7). Else a label whose
    interval holds the flow's start (0.98), or the nearest in time within the tolerance
    (0.95 less 0.2 for the share of the tolerance, 0.6 at least).

    Labels are keyed by which fields they know and by the values of these; a flow asks for
    one key per pattern and direction (a key that is the same both ways is asked for once), so
    no label agrees twice. Counts and the first label come from one aggregate per key. A key
    of up to `few` labels is joined to its flows. Of a larger one (labels that know no
    field at all have the same key) the labels are summed up by blocks of time: an interval
    is cut into the blocks it is made of, and of each block only its first label is kept; a
    flow finds its neighbours in time by the blocks beside its own. So flows and labels never
    meet pairwise beyond `few`, whatever their number.
    """
    fields = fields or {n: n for n in FIELDS}
    names = list(fields)
    ways = [fields, reverse] if reverse else [fields]
    patterns = [r[0] for r in labels.select(F.array(*[F.col(n).isNotNull() for n in names])).distinct().collect()]
    number = {tuple(p): k for k, p in enumerate(patterns)}

    def key(columns: list[Column]) -> Column:
        return F.concat_ws("\x1f", F.lit("k"), *[c.cast("string") for c in columns])

    pattern = F.lit(None).cast("int")
    for known, k in number.items():
        pattern = F.when(reduce(lambda a, b: a & b, [F.col(n).isNotNull() if x else F.col(n).isNull() for n, x in zip(names, known, strict=True)]), F.lit(k)).otherwise(pattern)
    row = F.struct("csv_row", "label").alias("row")
    listed = labels.withColumns({"p": pattern, "at": micros("label_timestamp") + F.lit(ORIGIN), "end": micros("label_end_timestamp") + F.lit(ORIGIN)}).select("p", key([F.when(F.col(n).isNotNull(), F.col(n)) for n in names]).alias("key"), row, "at", "end")

    asked = []
    for known, k in number.items():
        used = [n for n, x in zip(names, known, strict=True) if x]
        keys = [F.when(reduce(lambda a, b: a & b, [F.col(way[n]).isNotNull() for n in used], F.lit(True)), key([F.col(way[n]) for n in used])) for way in ways]
        asked += [F.when(x.isNotNull(), F.struct(F.lit(k).alias("p"), x.alias("key"))) for x in keys]
    start = (micros("flow_start") + F.lit(ORIGIN)).alias("s")
    wants = flows.select("flow_id", start, F.explode(F.array_distinct(F.array_compact(F.array(*asked)))).alias("k")).select("flow_id", "s", "k.p", "k.key") if asked else flows.limit(0).select("flow_id", start, F.lit(0).alias("p"), F.lit("").alias("key"))

    sums = listed.groupBy("p", "key").agg(F.count("*").alias("n"), F.max(F.col("at").isNotNull().cast("int")).alias("timed"), F.min("row").alias("any"))
    met = wants.join(sums, ["p", "key"])
    large = sums.where(F.col("n") > few).select("p", "key")
    inside = F.col("at").isNotNull() & F.col("end").isNotNull() & (F.col("at") <= F.col("s")) & (F.col("s") <= F.col("end"))
    near = F.struct(F.abs(F.col("at") - F.col("s")).alias("d"), F.col("row"))

    # Keys of few labels: pairs.
    pairs = met.where(F.col("n") <= few).drop("n", "timed", "any").join(listed.where("at is not null"), ["p", "key"]).where("s is not null")
    direct = pairs.select("flow_id", F.when(inside, F.col("row")).alias("in"), near.alias("near"))
    # Keys of many: by blocks of time.
    many = listed.join(large, ["p", "key"], "left_semi").where("at is not null")
    covers = many.where("end >= at").select("p", "key", "row", F.explode(F.expr(_blocks("at", "end + 1"))).alias("x")).groupBy("p", "key", "x.level", "x.block").agg(F.min("row").alias("in"))
    spread = many.select("p", "key", "row", "at", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("block", F.expr("shiftright(at, level)"))
    sides = spread.groupBy("p", "key", "level", "block").agg(F.min(F.struct("at", "row")).alias("low"), F.max(F.struct("at", (-F.col("row.csv_row")).alias("m"), F.col("row"))).alias("high"))
    hot = met.where((F.col("n") > few) & F.col("s").isNotNull()).select("flow_id", "s", "p", "key")
    levels = hot.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("block", F.expr("shiftright(s, level)"))
    held = levels.join(covers, ["p", "key", "level", "block"]).select("flow_id", F.col("in"), F.lit(None).cast(near_type(listed)).alias("near"))
    beside = levels.withColumn("odd", F.col("block") % 2).withColumn("block", F.explode(F.when(F.col("level") == 0, F.array(F.col("block"), F.expr("block + 1 - 2 * odd"))).otherwise(F.array(F.expr("block + 1 - 2 * odd"))))).join(sides, ["p", "key", "level", "block"])
    side = F.when(F.expr("low.at >= s"), F.struct(F.col("low.at").alias("at"), F.col("low.row").alias("row"))).otherwise(F.struct(F.col("high.at").alias("at"), F.col("high.row").alias("row")))
    beside = beside.withColumn("x", side).select("flow_id", F.lit(None).cast(row_type(listed)).alias("in"), F.struct(F.abs(F.col("x.at") - F.col("s")).alias("d"), F.col("x.row").alias("row")).alias("near"))

    counted = met.select("flow_id", "n", "timed", "any", F.lit(None).cast(row_type(listed)).alias("in"), F.lit(None).cast(near_type(listed)).alias("near"))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [counted, direct, held, beside])
    best = found.groupBy("flow_id").agg(F.sum("n").alias("n__"), F.max("timed").alias("timed__"), F.min("any").alias("any__"), F.min("in").alias("in__"), F.min("near").alias("near__"))
    out = flows.join(best, "flow_id", "left")
    distance = F.col("near__.d") / 1e6
    close = distance <= tolerance
    picked = F.when(F.col("timed__") == 0, F.col("any__")).when(F.col("in__").isNotNull(), F.col("in__")).when(close, F.col("near__.row"))
    confidence = F.when(F.col("timed__") == 0, 0.7).when(F.col("in__").isNotNull(), 0.98).when(close, F.bround(F.greatest(F.lit(0.6), 0.95 - distance / max(tolerance, 1.0) * 0.2), 3)).otherwise(0.0)
    status = F.when(picked.isNull(), "unmatched").when(F.col("n__") == 1, "matched").otherwise("matched_from_candidates")
    return out.select(*flows.columns, F.coalesce("n__", F.lit(0)).alias("candidate_count"), F.coalesce(picked["label"], F.lit(default)).alias("label"), status.alias("match_status"), confidence.alias("match_confidence"), picked["csv_row"].alias("csv_row"))


def row_type(listed: DataFrame):
    return listed.schema["row"].dataType


def near_type(listed: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("d", T.LongType()), T.StructField("row", row_type(listed))])


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "flow_id", order: str = "row", label: str = "label") -> DataFrame:
    """Left join of the last label of each key; a label the table already has is replaced."""
    last = labels.groupBy(key).agg(F.max_by(label, order).alias(label))
    return df.drop(label).join(last, key, "left")


def label_summary(mapped: DataFrame) -> DataFrame:
    """Flows by match status, label and protocol, as a mapping's audit has them."""
    return mapped.groupBy("match_status", "label", "protocol").agg(F.count("*").alias("flows"), F.sum("packet_count").alias("packets"), F.avg("match_confidence").alias("mean_confidence"))
