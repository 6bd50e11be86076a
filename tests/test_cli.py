"""The command line over small files."""

import json

from packetloom import cli
from tests.test_packets import MODBUS, pcap, tcp


def run(capsys, spark, *arguments):
    code = cli.main(list(map(str, arguments)), spark)
    said = capsys.readouterr()
    return code, json.loads(said.out) if said.out.strip() else said.err


def test_from_capture_to_map(spark, tmp_path, capsys):
    (tmp_path / "c.pcap").write_bytes(pcap([(k * 10**6, tcp("192.0.2.10", 50000 + k % 2, "192.0.2.20", 502, MODBUS)) for k in range(6)]))
    (tmp_path / "l.csv").write_text("Label,Src IP,Dst IP,Src Port\nscan,192.0.2.10,192.0.2.20,50001\n")
    code, made = run(capsys, spark, "extract", tmp_path / "C.PCAP", tmp_path / "f.parquet", "--protocol", "modbus")
    assert code == 0 and made["rows"] == 6
    assert run(capsys, spark, "map", tmp_path / "f.parquet", tmp_path / "l.csv", tmp_path / "m.parquet")[1]["match_statuses"] == {"matched": 1, "unmatched": 1}
    assert run(capsys, spark, "analyze", tmp_path / "f.parquet", tmp_path / "q.parquet")[1]["statuses"]["not_observed"] > 0
    assert run(capsys, spark, "profile-create", "p", tmp_path / "profiles", "--features", "packet_length")[0] == 0
    assert len(run(capsys, spark, "profile-list", tmp_path / "profiles")[1]) == 1
    code, said = run(capsys, spark, "extract", tmp_path / "none.pcap", tmp_path / "x.parquet")
    assert code == 2 and "c.pcap" in said
    assert run(capsys, spark, "resources")[1]["master"].startswith("local")
