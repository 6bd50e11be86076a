"""Protocol decoders as column expressions over transport payloads.

Only DNS names and SSH name lists, which need offsets read one after another, are left to
Arrow functions; a decoder's columns that a query doesn't use are pruned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.text import entropy, u8, u16

#: Ports, verbs, tokens and function codes of the protocols.
SERVICE_PORTS = {53: "dns", 502: "modbus", 102: "s7comm", 22: "ssh", 80: "http"}
HTTP_PORTS = (80, 8000, 8080, 8081, 8888)
HTTP_STARTS = ("GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "HTTP/")
HTTP_METHODS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|CONNECT"
SUSPICIOUS = ("../", "%2e%2e", "<script", "%3cscript", "union select", " or 1=1", ";--")
MODBUS_READ, MODBUS_WRITE, MODBUS_DIAGNOSTIC = (1, 2, 3, 4, 7, 11, 12, 17, 20, 24, 43), (5, 6, 15, 16, 21, 22, 23), (8,)
MODBUS_ADDRESSED, MODBUS_VALUED = (1, 2, 3, 4, 5, 6, 15, 16, 22, 23), (3, 4, 6, 16)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def find_byte(payload: str, value: int) -> Column:
    """Offset from 0 of the first such byte, -1 if there is none.

    Bytes become characters one by one; as UTF-8 a byte behind a stray lead byte would be lost.
    """
    return F.instr(F.decode(F.col(payload), "ISO-8859-1"), chr(value)) - 1


def infer_protocol(payload: str = "payload", src: str = "src_port", dst: str = "dst_port", has_dns: Column | None = None) -> Column:
    """The protocol of a packet by ports and first bytes; null if it is none of the five."""

    def port(*numbers: int) -> Column:
        return F.col(src).isin(*numbers) | F.col(dst).isin(*numbers)

    head = F.upper(F.decode(F.substring(payload, 1, 16), "ISO-8859-1"))
    starts = F.lit(False)
    for verb in HTTP_STARTS:
        starts = starts | head.startswith(verb)
    dns = port(53) if has_dns is None else port(53) | has_dns
    s7 = port(102) & ((find_byte(payload, 0x32) >= 0) | (F.length(payload) > 7))
    ssh = port(22) | F.decode(F.substring(payload, 1, 4), "ISO-8859-1").startswith("SSH-")
    return F.when(dns, "dns").when(port(502), "modbus").when(s7, "s7comm").when(ssh, "ssh").when(port(*HTTP_PORTS) | starts, "http")


def flow_columns(df: DataFrame, capture: str = "capture", transport: str = "transport", src: str = "src_ip", sport: str = "src_port", dst: str = "dst_ip", dport: str = "dst_port") -> DataFrame:
    """flow_id with its ends in order (address as text, then port), direction and is_request_direction."""
    a, b = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)

    def end(x: Column) -> Column:
        return F.concat_ws(":", x["ip"], x["port"].cast("string"))

    request = F.col(dport).isin(*HTTP_PORTS)
    for number, name in SERVICE_PORTS.items():
        request = request | ((F.col(dport) == number) & (F.col("protocol") == name))
    return df.withColumns({"flow_id": F.concat(F.col(capture), F.lit("::"), F.col(transport), F.lit("|"), end(low), F.lit("|"), end(high)), "direction": flag(a <= b), "is_request_direction": flag(F.coalesce(request, F.lit(False)))})


def url_columns(df: DataFrame, url: str, tokens: tuple[str, ...] = SUSPICIOUS, prefix: str = "") -> DataFrame:
    """Length, entropy, number of query parameters and of suspicious tokens that occur."""
    query = F.when(F.contains(url, F.lit("?")), F.regexp_extract(url, r"(?s)\?(.*)$", 1)).otherwise("")
    found = sum((flag(F.contains(F.lower(url), F.lit(t))) for t in tokens), F.lit(0))
    return df.withColumns({f"{prefix}url_length": F.length(url), f"{prefix}url_entropy": entropy(url), f"{prefix}query_parameters": F.length(query) - F.length(F.replace(query, F.lit("="), F.lit(""))), f"{prefix}suspicious_tokens": found})


def http_columns(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Request line, headers and status from the first 2048 bytes."""
    text = F.decode(F.substring(payload, 1, 2048), "ISO-8859-1")
    df = df.withColumn("lines__", F.split(F.coalesce(text, F.lit("")), "\r\n"))
    rest = F.slice(F.col("lines__"), 2, F.greatest(F.size("lines__") - 1, F.lit(0)))
    blank = F.array_position(rest, F.lit(""))
    heads = F.filter(F.when(blank > 0, F.slice(rest, F.lit(1), (blank - 1).cast("int"))).otherwise(rest), lambda x: F.contains(x, F.lit(":")))
    df = df.withColumns({"first__": F.col("lines__")[0], "heads__": F.transform(heads, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))})

    def header(name: str) -> Column:
        return F.try_element_at(F.filter("heads__", lambda h: h["k"] == name), F.lit(-1))["v"]

    target = F.nullif(F.regexp_extract("first__", rf"^({HTTP_METHODS})\s+(\S+)", 2), F.lit(""))
    status = F.nullif(F.regexp_extract("first__", r"^HTTP/\d(?:\.\d)?\s+(\d{3})", 1), F.lit("")).cast("int")
    df = df.withColumns({
        "http_header_count": F.size(F.array_distinct(F.transform("heads__", lambda h: h["k"]))), "http_host": header("host"), "http_user_agent": header("user-agent"), "http_content_length": header("content-length").try_cast("double"),
        "http_cookie_count": F.size(F.filter(F.split(F.coalesce(header("cookie"), F.lit("")), ";"), lambda x: F.contains(x, F.lit("=")))),
        "http_method": F.nullif(F.regexp_extract("first__", rf"^({HTTP_METHODS})\s+(\S+)", 1), F.lit("")), "target__": target, "http_url": F.substring(target, 1, 2048), "http_status_code": F.when(target.isNull(), status),
    })
    df = url_columns(df, "target__", prefix="h__")
    known = F.col("target__").isNotNull()
    df = df.withColumns({"http_url_length": F.col("h__url_length"), "http_url_entropy": F.when(known, F.col("h__url_entropy")), "http_query_parameter_count": F.when(known, F.col("h__query_parameters")), "http_suspicious_token_count": F.when(known, F.col("h__suspicious_tokens")), "http_response_size": F.when(F.col("http_status_code").isNotNull(), F.length(payload))})
    return df.drop("lines__", "first__", "heads__", "target__", "h__url_length", "h__url_entropy", "h__query_parameters", "h__suspicious_tokens")


def modbus_columns(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Header, function and addressing of Modbus/TCP; all null under 8 bytes."""
    n = F.length(payload)
    there = n >= 8
    raw = u8(payload, 7)
    function, exception = raw.bitwiseAND(F.lit(0x7F)), raw >= 0x80
    addressed = there & ~(exception & (n > 8)) & (n >= 12) & function.isin(*MODBUS_ADDRESSED)
    last = F.conv(F.hex(F.substring(F.col(payload), n - 1, F.lit(2))), 16, 10).cast("int")
    category = F.when(function.isin(*MODBUS_READ), "read").when(function.isin(*MODBUS_WRITE), "write").when(function.isin(*MODBUS_DIAGNOSTIC), "diagnostic").otherwise("other")
    return df.withColumns({
        "modbus_transaction_id": F.when(there, u16(payload, 0)), "modbus_unit_id": F.when(there, u8(payload, 6)), "modbus_function_code": F.when(there, function), "modbus_function_category": F.when(there, category),
        "modbus_protocol_id_valid": F.when(there, flag(u16(payload, 2) == 0)), "modbus_length_valid": F.when(there, flag(u16(payload, 4) == n - 6)), "modbus_nonstandard_function": F.when(there, flag(~(function.between(1, 24) | (function == 43)))),
        "modbus_is_exception": F.when(there, flag(exception)), "modbus_exception_code": F.when(there & exception & (n > 8), u8(payload, 8)), "modbus_starting_address": F.when(addressed, u16(payload, 8)), "modbus_quantity": F.when(addressed, u16(payload, 10)),
        "modbus_byte_count": F.when(n > 8, u8(payload, 8)), "modbus_value": F.when((n >= 10) & function.isin(*MODBUS_VALUED), last),
    })


def s7_columns(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Header and parameters behind the first 0x32 byte; only s7_is_plus if none fits."""
    df = df.withColumn("m__", find_byte(payload, 0x32)).withColumn("b__", F.expr(f"CASE WHEN m__ >= 0 AND m__ + 10 <= length(`{payload}`) THEN substring(`{payload}`, m__ + 1) END"))
    size = u16("b__", 4)
    df = df.withColumn("a__", F.substring(F.col("b__"), F.lit(11), size))
    function = u8("a__", 0)
    item = (F.length("a__") >= 10) & function.isin(4, 5)
    out = {
        "s7_rosctr": u8("b__", 1), "s7_pdu_reference": u16("b__", 2), "s7_parameter_length": size, "s7_data_length": u16("b__", 6), "s7_error_class": u8("b__", 8), "s7_error_code": u8("b__", 9), "s7_function_code": function,
        "s7_item_count": F.when(function.isNotNull(), F.coalesce(u8("a__", 1), F.lit(0))), "s7_control_command": F.when(function.isNotNull(), flag(function.isin(0x28, 0x29))), "s7_block_transfer": F.when(function.isNotNull(), flag(function.isin(0x1A, 0x1B))),
        "s7_transfer_size": F.when(item, u8("a__", 4)), "s7_db_number": F.when(item, u16("a__", 6)), "s7_area_code": F.when(item, u8("a__", 8)), "s7_is_plus": flag(F.contains(F.decode(F.col(payload), "ISO-8859-1"), F.lit("S7comm-Plus"))), "s7_return_code": F.lit(None).cast("int"),
    }
    return df.withColumns(out).drop("m__", "b__", "a__")


def _lists(payload: bytes | None) -> list[str] | None:
    """Up to ten length-prefixed name lists from 17 bytes behind the first 0x14 byte."""
    at = -1 if payload is None else payload.find(b"\x14")
    if at < 0 or at + 17 >= len(payload):
        return None
    at, found = at + 17, []
    while len(found) < 10 and at + 4 <= len(payload):
        size = struct.unpack_from(">I", payload, at)[0]
        if at + 4 + size > len(payload):
            break
        found.append(payload[at + 4 : at + 4 + size].decode("latin-1"))
        at += 4 + size
    return found or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def ssh_lists(payloads: pd.Series) -> pd.Series:
    return pd.Series([_lists(p) for p in payloads], dtype=object)


def ssh_columns(df: DataFrame, payload: str = "payload", dst: str = "dst_port") -> DataFrame:
    """Banners and negotiation lists of SSH."""
    head = F.decode(F.substring(payload, 1, 257), "ISO-8859-1")
    banner = F.when(head.startswith("SSH-"), F.substring(F.regexp_extract(head, r"^([^\r\n]*)", 1), 1, 255))
    df = df.withColumn("l__", ssh_lists(F.col(payload)))

    def count(k: int) -> Column:
        item = F.get("l__", F.lit(k))
        return F.when(F.col("l__").isNotNull(), F.when(item.isNull() | (item == ""), 0).otherwise(F.size(F.split(item, ","))))

    empty = {c: F.lit(None).cast(t) for c, t in (("ssh_auth_method", "string"), ("ssh_failed_auth_count", "int"), ("ssh_open_channel_count", "int"), ("ssh_keepalive_interval", "double"))}
    return df.withColumns({"ssh_client_banner": F.when(F.col(dst) == 22, banner), "ssh_server_banner": F.when(F.coalesce(F.col(dst), F.lit(0)) != 22, banner), "ssh_kex_algorithms": F.get("l__", F.lit(0)), "ssh_cipher_count": count(1), "ssh_mac_count": count(3), "ssh_compression_count": count(5), "hassh": F.when(F.col("l__").isNotNull(), F.md5(F.encode(F.array_join("l__", ";"), "UTF-8")))} | empty).drop("l__")


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name, pointers followed, and where the record goes on behind it."""
    labels, end, hops = [], 0, 0
    while at < len(data):
        size = data[at]
        if size >= 0xC0 and at + 1 < len(data):
            end = end or at + 2
            at = (size & 0x3F) << 8 | data[at + 1]
            hops += 1
            if hops > 32:
                break
        elif size == 0:
            return ".".join(labels), end or at + 1
        else:
            labels.append(data[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size
    return ".".join(labels), end or at


def dns_message(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Name and type of the first question, time to live of the first answer."""
    if data is None or len(data) < 12:
        return None, None, None
    questions, answers = struct.unpack_from(">HH", data, 4)
    at, name, kind, ttl = 12, None, None, None
    for k in range(questions):
        found, at = _name(data, at)
        if at + 4 > len(data):
            return (found if k == 0 else name), kind, None
        if k == 0:
            name, kind = found.rstrip("."), struct.unpack_from(">H", data, at)[0]
        at += 4
    if answers:
        _, at = _name(data, at)
        if at + 10 <= len(data):
            ttl = struct.unpack_from(">I", data, at + 4)[0]
    return name, kind, ttl


@F.pandas_udf(T.StructType([T.StructField("qname", T.StringType()), T.StructField("qtype", T.IntegerType()), T.StructField("ttl", T.LongType())]))
def dns_parts(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in payloads:
        out = pd.DataFrame([dns_message(p) for p in batch], columns=["qname", "qtype", "ttl"], dtype=object)
        yield out.astype({"qtype": "Int32", "ttl": "Int64"})


def dns_columns(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Header flags and the first question; all null for what is no DNS message."""
    df = df.withColumn("d__", dns_parts(F.col(payload)))
    flags, there = u16(payload, 2), F.length(payload) >= 12
    name = F.col("d__.qname")
    size = F.greatest(F.length(name), F.lit(1))

    def bit(k: int) -> Column:
        return F.when(there, F.shiftright(flags, k).bitwiseAND(F.lit(1)))

    return df.withColumns({
        "dns_rcode": F.when(there, flags.bitwiseAND(F.lit(15))), "dns_authoritative": bit(10), "dns_truncated": bit(9), "dns_recursion_available": bit(7), "dns_answer_count": F.when(there, u16(payload, 6)), "dns_qname": name, "dns_qname_length": F.length(name),
        "dns_qname_entropy": F.when(name.isNotNull(), entropy(name)), "dns_label_count": F.regexp_count(name, F.lit(r"\.")) + 1, "dns_qtype": F.col("d__.qtype"), "dns_digit_ratio": F.regexp_count(name, F.lit(r"\d")) / size, "dns_hyphen_ratio": F.regexp_count(name, F.lit("-")) / size,
        "dns_ngram_score": F.bround(F.regexp_count(name, F.lit(r"\p{L}")) / size, 4), "dns_ttl": F.col("d__.ttl"), "dns_response_size": F.when(bit(15) == 1, F.length(payload)),
    }).drop("d__")
