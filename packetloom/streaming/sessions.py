"""An extension: flow sessions over a stream of packets, closed by an idle timeout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flow_sessions(packets: DataFrame, ts: str = "timestamp", flow: str = "flow_id", length: str = "packet_length", idle: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Packets, bytes and times of each session; works on streams and on tables alike."""
    if packets.isStreaming:
        packets = packets.withWatermark(ts, late)
    out = packets.groupBy(F.session_window(ts, idle).alias("session"), flow).agg(F.count("*").alias("packets"), F.sum(length).alias("bytes"), F.max(ts).alias("last_seen"))
    return out.select(flow, F.col("session.start").alias("session_start"), "packets", "bytes", "last_seen")
