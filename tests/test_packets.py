"""Captures, decoders and label maps on bytes and rows made here."""

import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions import protocols
from packetloom.functions.text import entropy
from packetloom.functions.catalog import FEATURES
from packetloom.operators import mapping, prepare, reports, rollups
from packetloom.operators.detectors import IsolationForest, LocalOutlierFactor, LstmAutoencoder, OneClassSvm
from packetloom.plans.features import BASE, decode, extract, run_inventory, scopes, tallies
from packetloom.sources.pcap import frames
from packetloom.sources.tables import bounded_table, capture_audit, capture_file, capture_files, deep_merge, discover_runs, feature_sources, inventory, load_config, read_table, run_history, write_table
from packetloom.streaming.sessions import flow_sessions

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def tcp(src, sport, dst, dport, payload, vlan=False):
    body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 0x18, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body
    return bytes(12) + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + ip


def pcap(packets):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack("<IIII", t // 10**6, t % 10**6, len(p), len(p)) + p for t, p in packets)


def pcapng(packets):
    out = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 65535, 20)
    for t, p in packets:
        pad = p + bytes(-len(p) % 4)
        size = 32 + len(pad)
        out += struct.pack("<IIIIIII", 6, size, 0, t >> 32, t & 0xFFFFFFFF, len(p), len(p)) + pad + struct.pack("<I", size)
    return out


MODBUS = bytes.fromhex("000100000006010300000001")


def test_frames_of_both_formats():
    packets = [(1_700_000_000_000_000, b"abc"), (1_700_000_000_500_000, b"defgh")]
    assert [(t, f) for t, _, f in frames(pcap(packets))] == packets == [(t, f) for t, _, f in frames(pcapng(packets))]
    assert list(frames(b"")) == []
    with pytest.raises(ValueError):
        list(frames(b"nothing of the kind"))


def test_folder_of_captures_keeps_flows_apart(spark, tmp_path):
    for k, make in enumerate((pcap, pcapng)):
        packet = tcp("192.0.2.10", 50000, "192.0.2.20", 502, struct.pack(">H", k + 1) + MODBUS[2:], vlan=bool(k))
        (tmp_path / f"c{k}.{'pcap' if k == 0 else 'pcapng'}").write_bytes(make([(10**6, packet)]))
    rows = extract(spark, str(tmp_path), "modbus").orderBy("modbus_transaction_id").collect()
    assert [r.modbus_transaction_id for r in rows] == [1, 2] and len({r.flow_id for r in rows}) == 2
    assert rows[0].modbus_function_category == "read" and rows[0].modbus_quantity == 1 and rows[0].is_request_direction == 1 and rows[0].modbus_length_valid == 1
    assert len(capture_files(str(tmp_path))) == 2


def test_http_context_reaches_later_packets(spark, tmp_path):
    head = b"GET /health?a=1&b=2 HTTP/1.1\r\nHost: example\r\nCookie: x=1; y=2\r\n\r\n"
    packets = [(k * 10**6, tcp("198.51.100.10", 51000, "198.51.100.20", 80, p)) for k, p in enumerate((head, b"body bytes"))]
    (tmp_path / "h.pcap").write_bytes(pcap(packets))
    first, second = extract(spark, str(tmp_path), "http").orderBy("packet_index").collect()
    assert (first.http_method, first.http_host, first.http_query_parameter_count, first.http_cookie_count, first.http_header_count) == ("GET", "example", 2, 2, 2)
    assert (second.http_method, second.http_host, second.http_header_count) == ("GET", "example", 0)
    assert second.inter_arrival_time == 1.0 and second.jitter == 1.0 and second.flow_total_packets == 2


def test_dns_ssh_and_s7_bytes(spark):
    question = b"\x03www\x07example\x03com\x00\x00\x01\x00\x01"
    dns = struct.pack(">HHHHHH", 1, 0x8583, 1, 1, 0, 0) + question + b"\xc0\x0c\x00\x01\x00\x01" + struct.pack(">IH", 300, 4) + bytes(4)
    kex = bytes(5) + b"\x14" + bytes(16) + b"".join(struct.pack(">I", len(x)) + x for x in (b"k1,k2", b"h1,h2,h3", b"e", b"a,b"))
    s7 = bytes(7) + b"\x32\x01\x00\x02\x00\x0c\x00\x00\x09\x08\x04\x02" + bytes(12)
    df = spark.createDataFrame([(bytearray(dns), 53), (bytearray(kex), 22), (bytearray(s7), 102), (bytearray(b""), 9)], "payload binary, dst_port int").withColumn("src_port", F.lit(40000))
    kinds = df.select(protocols.infer_protocol().alias("p")).collect()
    assert [r.p for r in kinds] == ["dns", "ssh", "s7comm", None]
    d = protocols.dns_columns(df).first()
    assert (d.dns_qname, d.dns_qtype, d.dns_ttl, d.dns_rcode, d.dns_authoritative, d.dns_label_count, d.dns_answer_count) == ("www.example.com", 1, 300, 3, 1, 3, 1)
    s = protocols.ssh_columns(df).where("dst_port = 22").first()
    assert (s.ssh_kex_algorithms, s.ssh_cipher_count, s.ssh_mac_count, s.ssh_compression_count) == ("k1,k2", 3, 2, 0) and len(s.hassh) == 32
    x = protocols.s7_columns(df).where("dst_port = 102").first()
    assert (x.s7_rosctr, x.s7_pdu_reference, x.s7_parameter_length, x.s7_error_class, x.s7_function_code, x.s7_item_count) == (1, 2, 12, 9, 4, 2)


def test_entropy_counts_bytes(spark):
    got = spark.createDataFrame([("aab",), ("é",), ("",), (None,)], "s string").select(entropy("s").alias("e")).collect()
    assert [r.e for r in got] == [0.9183, 1.0, 0.0, 0.0]


@pytest.mark.parametrize(("shift", "status", "confidence"), [(0, "matched", 0.95), (600, "unmatched", 0.0)])
def test_label_by_address_and_time(spark, shift, status, confidence):
    flows = spark.createDataFrame([("f", "a", "b", "modbus", T0, T0, 1)], "flow_id string, src_ip string, dst_ip string, protocol string, flow_start timestamp, flow_end timestamp, packet_count long")
    labels = spark.createDataFrame([(1, "attack", T0 + timedelta(seconds=shift), None, "b", "a")], "csv_row int, label string, label_timestamp timestamp, label_end_timestamp timestamp, src string, dst string")
    got = mapping.map_labels(flows, labels, {"src": "src_ip", "dst": "dst_ip"}, {"src": "dst_ip", "dst": "src_ip"}).first()
    blocks = mapping.map_labels(flows, labels, {"src": "src_ip", "dst": "dst_ip"}, {"src": "dst_ip", "dst": "src_ip"}, few=0).first()
    assert blocks == got
    assert (got.match_status, got.match_confidence) == (status, confidence) and got.label == ("attack" if shift == 0 else "unknown")


def test_blocks_of_time_find_what_pairs_find(spark):
    """Labels without addresses, intervals and neighbours across the borders of blocks, against all pairs."""
    rng = np.random.default_rng(11)
    at = lambda us: T0 + timedelta(microseconds=int(us))
    flows = spark.createDataFrame([(f"f{k}", "a", 1, "b", 2, "http", at(t), at(t), 1) for k, t in enumerate(rng.integers(0, 10**8, 60))] + [("none", "a", 1, "b", 2, "http", None, None, 1)], "flow_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, flow_start timestamp, flow_end timestamp, packet_count long")
    labels = []
    for k in range(200):
        t, span = int(rng.integers(0, 10**8)), int(rng.integers(0, 4 * 10**6))
        who = [(None, None, None, None), ("a", None, None, 2), ("b", 2, "a", 1), ("z", None, None, None)][k % 4]
        labels.append((k, f"l{k}", at(t) if k % 7 else None, at(t + span) if k % 3 == 0 else None, *who))
    table = spark.createDataFrame(labels, "csv_row long, label string, label_timestamp timestamp, label_end_timestamp timestamp, src_ip string, src_port int, dst_ip string, dst_port int")
    for reverse in (None, mapping.REVERSE):
        got = [sorted(map(str, mapping.map_labels(flows, table, reverse=reverse, tolerance=0.05, few=few).collect())) for few in (10**6, 0, 40)]
        assert got[0] == got[1] == got[2]


def test_tallies_inventory_and_runs(spark, tmp_path):
    """Captures of two folders with the same name, an inventory with labels, and what a run leaves behind."""
    raw, packets = tmp_path / "raw", [(k * 10**6, tcp("192.0.2.10", 50000 + k, "192.0.2.20", port, MODBUS)) for k, port in enumerate((502, 502, 9, 80))]
    for folder in ("modbus", "http"):
        (raw / folder).mkdir(parents=True)
        (raw / folder / "c.PCAP").write_bytes(pcap([*packets, (5 * 10**6, b"no frame")]))
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "l.csv").write_text("state,startDate,endDate,sIPs,rIPs\nscan,1/1/1970 0:00,1/1/1970 1:00,[192.0.2.10],192.0.2.20\n")
    (tmp_path / "labels" / "empty.csv").write_text("state,startDate\n")
    config = {"capture": {"supported_protocols": ["http", "modbus"]}, "data": {"raw_pcap_dir": str(raw), "it_label_dir": "", "ot_label_dir": str(tmp_path / "labels"), "protocol_folders": [{"protocol": "modbus", "labels": ["l.csv", "empty.csv"]}, {"protocol": "http", "id": "web"}]}}
    found = inventory(config)
    assert [(d["id"], d["domain"], len(d["path"])) for d in found] == [("modbus", "ot", 1), ("web", "it", 1)]
    got = {r.capture: (r.packets_read, r.supported, r.retained_rows, r.filtered_rows) for r in tallies(spark, [*found[0]["path"], *found[1]["path"]], "modbus").collect()}
    assert got == {"modbus/c.PCAP": (5, 3, 2, 1), "http/c.PCAP": (5, 3, 2, 1)}
    summary = run_inventory(spark, [*found, {"id": "gone", "path": str(tmp_path / "nowhere.pcap"), "domain": "it"}], str(tmp_path / "run"))
    assert [d["status"] for d in summary["datasets"]] == ["extracted", "extracted", "extraction_failed"]
    assert [(m["status"], m.get("match_statuses")) for m in summary["datasets"][0]["mappings"]] == [("complete", {"matched": 2}), ("failed", None)]
    table = read_table(spark, summary["combined_features"])
    assert table.columns[:15] == list(BASE) and len(set(table.columns) & {f.name for f in FEATURES} | set(BASE)) == 106 and table.count() == 3
    assert discover_runs(str(tmp_path)) == [str(tmp_path / "run")] and set(feature_sources(str(tmp_path / "run"))) == {"http", "modbus"}
    assert run_history(spark, str(tmp_path)).count() == 3 and capture_audit(spark, str(tmp_path / "run")).where("included").count() == 2
    report = read_table(spark, str(tmp_path / "run/reports/modbus-feature-quality.parquet"))
    assert report.count() == len([f for f in FEATURES if "modbus" in f.protocols]) and report.where("extraction_status = 'not_observed'").count() > 0
    small, n = bounded_table(spark, summary["combined_features"], 2)
    assert n == 3 and small.count() == 2


def test_inventories_are_checked(tmp_path):
    base = {"capture": {"supported_protocols": ["http"]}, "data": {"raw_pcap_dir": str(tmp_path), "it_label_dir": ""}}
    bad = [{"protocol_folders": "x"}, {"protocol_folders": [1]}, {"protocol_folders": [{"protocol": "ftp"}]}, {"protocol_folders": [{"protocol": "http", "labels": "x"}]}, {"protocol_folders": [{"protocol": "http", "domain": "x"}]}, {"datasets": [{"id": "a"}]}, {}]
    for data in bad:
        with pytest.raises(ValueError):
            inventory(deep_merge(base, {"data": data}))
    (tmp_path / "A.pcapng").write_bytes(b"")
    assert capture_file(str(tmp_path / "a.pcap")) == str(tmp_path / "A.pcapng") and capture_files(str(tmp_path)) == [str(tmp_path / "A.pcapng")]
    with pytest.raises(FileNotFoundError, match="A.pcapng"):
        capture_file(str(tmp_path / "b.pcap"))
    (tmp_path / "c.json").write_text('{"a": {"b": 2}}')
    assert load_config({"a": {"b": 1, "c": 3}}, str(tmp_path / "c.json")) == {"a": {"b": 2, "c": 3}}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_config({}, str(tmp_path / "d.json"))


def test_dns_beside_port_53_and_over_tcp(spark):
    message = struct.pack(">HHHHHH", 1, 0x8180, 1, 0, 0, 0) + b"\x01a\x04test\x00\x00\x01\x00\x01"
    rows = [("c", 1, T0, "UDP", "a", 5353, "b", 40000, 0, 60, bytearray(message)), ("c", 2, T0, "TCP", "a", 40000, "b", 53, 0, 60, bytearray(struct.pack(">H", len(message)) + message))]
    df = spark.createDataFrame(rows, "capture string, packet_index long, timestamp timestamp, transport string, src_ip string, src_port int, dst_ip string, dst_port int, tcp_flags int, packet_length int, payload binary")
    for option, size in (("dissected", 0), ("udp", len(message))):
        got = decode(df, dns_payload=option).orderBy("packet_index").collect()
        assert [(r.dns_qname, r.dns_response_size) for r in got] == [("a.test", size)] * 2 and (got[0].payload_size == size)


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(12)
    rows = [("hot" if k % 3 else None if k % 2 else f"k{k % 11}", int(v), k) for k, v in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame(rows, "key string, v int, i long").repartition(6)
    got = {r.i: r.s for r in prepare.running_sums(df, ["v", "i"], {"s": F.col("v")}, ("key",), 9).collect()}
    for key, v, i in rows:
        assert got[i] == sum(x for k, x, j in rows if k == key and (x, j) < (v, i))
    counts = df.groupBy("key", "v").agg(F.count("*").alias("n"))
    for r in prepare.quantiles(counts, ("key",), "v", "n", [0, 0.25, 0.5, 0.95, 1]).collect():
        assert np.allclose(r.q, np.quantile([x for k, x, _ in rows if k == r.key], [0, 0.25, 0.5, 0.95, 1]))


def test_sessions_of_tables_and_streams(spark, tmp_path):
    rows = [("f", T0 + timedelta(seconds=s), 10) for s in (0, 30, 200, 210)] + [("g", T0, 5)]
    df = spark.createDataFrame(rows, "flow_id string, timestamp timestamp, packet_length int")
    want = {("f", 2, 20), ("f", 2, 20), ("g", 1, 5)}
    got = flow_sessions(df).collect()
    assert {(r.flow_id, r.packets, r.bytes) for r in got} == want and len(got) == 3
    df.write.parquet(str(tmp_path / "in"))
    stream = flow_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    # Sessions that the watermark has passed are out; the last ones still wait for late packets.
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.flow_id, r.packets) for r in closed} <= {("f", 2), ("g", 1)}


def test_columns_to_show(spark):
    df = spark.createDataFrame([], "label string, src_port int, packet_length double, http_method string, modbus_value int, row_id long")
    assert reports.visible_columns(df.schema, ["modbus"]) == ["packet_length", "modbus_value"] and reports.visible_columns(df.schema, ["modbus", "http"]) == ["packet_length"]
    assert reports.record_columns(df.schema, "http") == ["src_port", "label", "packet_length", "http_method"]


def test_quality_statuses(spark):
    df = spark.createDataFrame([("modbus", str(k % 2), 60 + k, 3, None) for k in range(20)], "protocol string, flow_id string, packet_length int, code int, address int")
    got = {r["name"]: r.extraction_status for r in rollups.quality_report(df, ["packet_length", "code", "address"]).collect()}
    assert got == {"packet_length": "usable", "code": "constant", "address": "not_observed"}


def test_sparse_column_stays_small(spark):
    df = spark.createDataFrame([(0.0,)] * 98 + [(-1_200_000.0,), (-800_000.0,)], "x double")
    got = prepare.scale(df, prepare.fit_robust(df, ["x"]), ["x"]).agg(F.max(F.abs("x"))).first()[0]
    assert got < 20


def test_detectors_find_a_planted_outlier():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 3)), [[9, 9, 9]]])
    for d in (IsolationForest(50), LocalOutlierFactor(20), OneClassSvm()):
        s = d.fit(x).score(x)
        assert len(s) == 301 and int(s.argmax()) == 300


@pytest.mark.parametrize("layers", [1, 2])
def test_autoencoder_gradients_and_scores(layers):
    x = np.random.default_rng(2).normal(size=(48, 3))
    net = LstmAutoencoder(length=6, stride=6, hidden=4, latent=3, layers=layers, dropout=0.3, epochs=3)
    net._init(3)
    w = net._windows(x, *net.starts(48))
    draw = lambda: np.random.default_rng(3)  # noqa: E731  the same masks each time
    _, g = net.gradients(w, draw())
    assert set(g) == set(net.p)
    for name in net.p:
        p = net.p[name]
        at = (0,) * p.ndim
        p[at] += 1e-5
        up = net.gradients(w, draw())[0]
        p[at] -= 2e-5
        assert abs((up - net.gradients(w, draw())[0]) / 2e-5 - g[name][at]) < 1e-6
        p[at] += 1e-5
    assert len(net.fit(x).score(x)) == 48 and net.history[0]["epoch"] == 1


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    for suffix in ("csv", "parquet", "jsonl"):
        write_table(df, str(tmp_path / f"t.{suffix}"))
        assert read_table(spark, str(tmp_path / f"t.{suffix}")).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "t.xlsx")
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert scopes("grouped", ["it", "all"], ["http", "modbus"]) == {"grouped_it": ["http"], "grouped_all": ["http", "modbus"]}
