"""Packet captures as tables: framing and addresses in Arrow batches, the rest as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from ipaddress import IPv6Address

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "capture string, packet_index long, timestamp timestamp, transport string, src_ip string, src_port int, dst_ip string, dst_port int, tcp_flags int, packet_length int, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Link types, and IPv6 headers that lead to another one.
ETHERNET, RAW, LINUX_SLL, NULL_LOOP = 1, (12, 101, 228, 229), 113, 0
IPV6_OPTIONS = {0, 43, 60, 135}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of each packet, whichever of the two formats it is."""
    magic = data[:4]
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _next_generation(data)
        return
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    if magic not in kinds:
        if data:
            raise ValueError("neither a PCAP nor a PCAPNG file")
        return
    end, per = kinds[magic]
    link, at = struct.unpack_from(end + "I", data, 20)[0] & 0xFFFF, 24
    while at + 16 <= len(data):
        seconds, part, size, _ = struct.unpack_from(end + "IIII", data, at)
        if at + 16 + size > len(data):
            return
        yield seconds * 1_000_000 + part // per, link, data[at + 16 : at + 16 + size]
        at += 16 + size


def _next_generation(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    at, end, links = 0, "<", []
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            end, links = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
        kind, size = struct.unpack_from(end + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            links.append((struct.unpack_from(end + "H", body)[0], _ticks(body[8:], end)))
        elif kind == 6 and len(body) >= 20:
            port, high, low, held = struct.unpack_from(end + "IIII", body)
            if port < len(links):
                yield (high << 32 | low) * 1_000_000 // links[port][1], links[port][0], body[20 : 20 + held]
        elif kind == 3 and links:
            held = struct.unpack_from(end + "I", body)[0]
            yield 0, links[0][0], body[4 : 4 + held]
        at += size


def _ticks(options: bytes, end: str) -> int:
    """Ticks in a second by the interface's resolution option; a million without it."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(end + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size:
            return 2 ** (options[at + 4] & 0x7F) if options[at + 4] & 0x80 else 10 ** options[at + 4]
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def addresses(link: int, frame: bytes) -> tuple | None:
    """(transport, source, port, destination, port, flags, payload) of a TCP or UDP packet over IP."""
    if link == ETHERNET:
        at, kind = 14, int.from_bytes(frame[12:14])
        while kind in (0x8100, 0x88A8) and at + 4 <= len(frame):
            kind, at = int.from_bytes(frame[at + 2 : at + 4]), at + 4
        if kind not in (0x0800, 0x86DD):
            return None
    elif link == LINUX_SLL:
        at = 16
    elif link == NULL_LOOP:
        at = 4
    elif link in RAW:
        at = 0
    else:
        return None
    ip = frame[at:]
    if not ip:
        return None
    if ip[0] >> 4 == 4 and len(ip) >= 20:
        start, total, proto = (ip[0] & 15) * 4, int.from_bytes(ip[2:4]), ip[9]
        if int.from_bytes(ip[6:8]) & 0x1FFF:
            return None
        src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
        body = ip[start : total if total >= start else len(ip)]
    elif ip[0] >> 4 == 6 and len(ip) >= 40:
        proto, body = ip[6], ip[40 : 40 + int.from_bytes(ip[4:6])]
        while proto in IPV6_OPTIONS and len(body) >= 8:
            proto, body = body[0], body[8 * (body[1] + 1) :]
        src, dst = str(IPv6Address(ip[8:24])), str(IPv6Address(ip[24:40]))
    else:
        return None
    if proto == 6 and len(body) >= 20:
        return "TCP", src, int.from_bytes(body[0:2]), dst, int.from_bytes(body[2:4]), body[13], body[(body[12] >> 4) * 4 :]
    if proto == 17 and len(body) >= 8:
        return "UDP", src, int.from_bytes(body[0:2]), dst, int.from_bytes(body[2:4]), 0, body[8:]
    return None


def read_captures(spark: SparkSession, path: str | list[str], max_packets: int | None = None, keep_all: bool = False) -> DataFrame:
    """One row per TCP or UDP packet over IP; packet_index counts all packets of a file from 1.

    Files are read by the engine's own binary source, from any store it knows, one task per
    file or more; a file of over 2 GB has to be split before. `max_packets` bounds the raw
    packets of a file, before any filter. With `keep_all` other packets have a row as well,
    without addresses. A capture has the name of its file, behind that of its folder if
    files of several folders have the same name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][cC][aA][pP]*").load(path).where(F.lower("path").rlike(r"\.pcap(ng)?$")).select("path", "content")
    names = files.select(F.substring_index("path", "/", -1).alias("name")).groupBy("name").count().where("count > 1")
    twice = {r["name"] for r in names.collect()}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                capture = name.rsplit("/", 1)[-1]
                capture = "/".join(name.rsplit("/", 2)[-2:]) if capture in twice else capture
                for index, (micros, link, frame) in enumerate(frames(bytes(content)), 1):
                    if max_packets and index > max_packets:
                        break
                    if found := addresses(link, frame):
                        transport, src, sport, dst, dport, flags, payload = found
                        rows.append((capture, index, EPOCH + timedelta(microseconds=micros), transport, src, sport, dst, dport, flags, len(frame), payload))
                    elif keep_all:
                        rows.append((capture, index, EPOCH + timedelta(microseconds=micros), None, None, None, None, None, None, len(frame), None))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
                yield pd.DataFrame(rows, columns=COLUMNS) if rows else pd.DataFrame({c: pd.Series(dtype="datetime64[ns, UTC]" if c == "timestamp" else object) for c in COLUMNS})

    return files.mapInPandas(parse, SCHEMA).withColumn("tcp_flag_count", F.bit_count("tcp_flags"))
