"""The feature catalogue: names by protocol and category, and profiles of chosen features."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

#: The features of each protocol by category, in the catalogue's order.
CATALOG = {
    "shared": {
        "packet": "packet_length payload_size payload_entropy tcp_flag_count direction is_request_direction",
        "flow": "flow_duration flow_total_packets flow_total_bytes flow_byte_ratio packet_length_mean packet_length_std",
        "timing": "inter_arrival_time jitter packet_rate hour_sin hour_cos weekday_sin weekday_cos",
        "host_behavior": "source_packet_rate source_destination_count destination_entropy burstiness",
    },
    "ssh": {
        "ssh_banner": "ssh_client_banner ssh_server_banner",
        "ssh_negotiation": "ssh_kex_algorithms ssh_cipher_count ssh_mac_count ssh_compression_count hassh",
        "ssh_authentication": "ssh_auth_method ssh_failed_auth_count",
        "ssh_session": "ssh_open_channel_count ssh_keepalive_interval",
    },
    "dns": {
        "dns_query": "dns_qname dns_qname_length dns_qname_entropy dns_label_count dns_qtype dns_digit_ratio dns_hyphen_ratio dns_ngram_score",
        "dns_response": "dns_rcode dns_ttl dns_answer_count dns_response_size dns_authoritative dns_recursion_available dns_truncated",
        "dns_behavior": "dns_nxdomain_rate dns_query_repeat_count",
    },
    "http": {
        "http_request": "http_method http_url_length http_url_entropy http_query_parameter_count http_suspicious_token_count http_host http_user_agent http_header_count http_content_length http_cookie_count",
        "http_response": "http_status_code http_response_size",
        "http_behavior": "http_error_ratio http_post_get_ratio http_request_repeat_count",
    },
    "modbus": {
        "modbus": "modbus_function_code modbus_exception_code modbus_starting_address modbus_quantity modbus_byte_count modbus_unit_id modbus_transaction_id modbus_protocol_id_valid modbus_length_valid modbus_function_category modbus_nonstandard_function modbus_value",
        "modbus_behavior": "modbus_exception_rate modbus_address_deviation modbus_response_matched",
    },
    "s7comm": {
        "s7comm": "s7_rosctr s7_function_code s7_pdu_reference s7_error_class s7_error_code s7_parameter_length s7_data_length s7_item_count s7_area_code s7_db_number s7_transfer_size s7_is_plus s7_control_command s7_block_transfer s7_return_code",
        "s7comm_behavior": "s7_response_matched",
    },
}
#: Names that no decoder yields, and those that cost more than the others.
NEVER = ("ssh_auth_method", "ssh_failed_auth_count", "ssh_open_channel_count", "ssh_keepalive_interval", "s7_return_code")
DEARER = ("payload_entropy", "destination_entropy", "hassh", "dns_ngram_score")


@dataclass(frozen=True)
class Feature:
    name: str
    protocols: tuple[str, ...]
    category: str

    @property
    def display_name(self) -> str:
        return self.name.replace("_", " ").title()

    @property
    def cost(self) -> str:
        return "medium" if self.name in DEARER else "low"


PROTOCOLS = tuple(p for p in CATALOG if p != "shared")
FEATURES = tuple(Feature(n, PROTOCOLS if p == "shared" else (p,), c) for p, groups in CATALOG.items() for c, names in groups.items() for n in names.split())


def available_features(protocols: list[str] | None = None) -> list[Feature]:
    """Features of any of the protocols; all without a choice."""
    return [f for f in FEATURES if not protocols or set(protocols) & set(f.protocols)]


def create_profile(name: str, features: list[str], folder: str, description: str = "", protocols: list[str] | None = None) -> Path:
    """Writes a profile whose version is a digest of name, features and time."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a profile's name has letters, digits, dashes and underscores")
    chosen = list(dict.fromkeys(f.strip() for f in features if f.strip()))
    unknown = set(chosen) - {f.name for f in available_features(protocols)}
    if not chosen or unknown:
        raise ValueError(f"no features, or unknown ones: {sorted(unknown)}")
    now = datetime.now(timezone.utc).isoformat()
    version = hashlib.sha256("|".join([name, *chosen, now]).encode()).hexdigest()[:10]
    path = Path(folder) / f"{name}-{version}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"schema_version": "1.0.0", "name": name, "version": version, "created_at": now, "description": description, "protocols": protocols or [], "features": chosen, "feature_count": len(chosen)}, indent=2))
    return path


def load_profile(name: str, folder: str) -> dict:
    """A profile by path, or the last by name among `name-*.json`."""
    path = Path(name) if Path(name).is_file() else max(Path(folder).glob(f"{name}-*.json"), default=None)
    if path is None:
        raise FileNotFoundError(f"no profile {name} in {folder}")
    profile = json.loads(path.read_text())
    if not profile.get("features"):
        raise ValueError("a profile has features")
    return profile
