"""Record types, parameters and the fixed lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Names and order of the 52 flow features (schema 2.0.0).
# --------------------------------------------------------------------------
FEATURES: tuple[str, ...] = (
    "duration_sec", "total_packets", "total_bytes", "packets_per_sec", "bytes_per_sec",
    "forward_packets", "reverse_packets", "forward_bytes", "reverse_bytes",
    "fwd_rev_packet_ratio", "fwd_rev_byte_ratio",
    "pkt_size_mean", "pkt_size_std", "pkt_size_min", "pkt_size_max", "pkt_size_median",
    "pkt_size_p25", "pkt_size_p75", "pkt_size_p90",
    "iat_mean", "iat_std", "iat_min", "iat_max", "iat_median",
    "fwd_iat_mean", "fwd_iat_std", "fwd_iat_min", "fwd_iat_max",
    "rev_iat_mean", "rev_iat_std", "rev_iat_min", "rev_iat_max",
    "syn_count", "syn_ack_count", "ack_count", "fin_count", "rst_count", "psh_count",
    "syn_ratio", "ack_ratio", "fin_ratio", "rst_ratio", "psh_ratio",
    "protocol", "ip_version", "is_tcp", "is_udp", "is_icmp",
    "payload_bytes_total", "forward_payload_bytes", "reverse_payload_bytes", "payload_ratio",
)
FEATURE_SCHEMA_VERSION = "2.0.0"
NOMINAL_FEATURES: tuple[str, ...] = ("protocol", "ip_version")
LINEAR_FEATURES: tuple[str, ...] = tuple(f for f in FEATURES if f not in NOMINAL_FEATURES)

# --------------------------------------------------------------------------
# TCP flag bits, protocol numbers, DNS type names, GREASE set.
# --------------------------------------------------------------------------
TCP_FIN, TCP_SYN, TCP_RST, TCP_PSH, TCP_ACK = 1, 2, 4, 8, 16
PROTOCOL_NAMES: dict[int, str] = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
DNS_TYPE_NAMES: dict[int, str] = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA",
    33: "SRV", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 65: "HTTPS",
}
TLS_GREASE: tuple[int, ...] = tuple(0x0A0A + 0x1010 * i for i in range(16))

# --------------------------------------------------------------------------
# Threat classes, severities, display names, techniques.
# --------------------------------------------------------------------------
SEVERITIES: tuple[tuple[float, str], ...] = (
    (0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low"),
)
ANOMALY_THRESHOLD = 0.5
MIN_CONFIDENCE = 0.3
THREAT_DISPLAY: dict[str, str] = {
    "benign": "Benign Traffic",
    "ddos": "Possible DDoS Attack",
    "c2": "Possible C2 Beaconing",
    "reconnaissance": "Possible Reconnaissance",
    "scan": "Possible Network Scanning",
    "exfiltration": "Possible Data Exfiltration",
    "brute_force": "Possible Brute Force",
    "dns_tunneling": "Possible DNS Tunneling",
    "unknown": "Unclassified Traffic",
    "other": "Suspicious Activity",
}
# (threat type, technique id, technique name, tactic, rationale, applicability)
TECHNIQUES: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("ddos", "T1498", "Network Denial of Service", "Impact",
     "High packet rate or volume directed at target", "high"),
    ("ddos", "T1499", "Endpoint Denial of Service", "Impact",
     "Connection flooding or resource exhaustion patterns", "medium"),
    ("c2", "T1071", "Application Layer Protocol", "Command and Control",
     "Periodic beaconing or structured communication patterns", "high"),
    ("c2", "T1573", "Encrypted Channel", "Command and Control",
     "Encrypted traffic with beaconing characteristics", "medium"),
    ("reconnaissance", "T1046", "Network Service Scanning", "Discovery",
     "Systematic connection attempts across ports or hosts", "high"),
    ("reconnaissance", "T1595", "Active Scanning", "Reconnaissance",
     "Scanning patterns detected in flow metadata", "medium"),
    ("scan", "T1046", "Network Service Scanning", "Discovery",
     "Port or service enumeration patterns", "high"),
    ("exfiltration", "T1041", "Exfiltration Over C2 Channel", "Exfiltration",
     "Unusual outbound data volume or transfer patterns", "medium"),
    ("exfiltration", "T1048", "Exfiltration Over Alternative Protocol", "Exfiltration",
     "Data transfer via non-standard protocols", "low"),
    ("brute_force", "T1110", "Brute Force", "Credential Access",
     "Repeated authentication attempts with varying credentials", "high"),
    ("dns_tunneling", "T1071.004", "Application Layer Protocol: DNS", "Command and Control",
     "DNS traffic with unusual query patterns or payload sizes", "high"),
)
TECHNIQUE_SCHEMA = ("threat_type string, technique_id string, technique_name string, "
                    "tactic string, technique_rationale string, applicability string")
# detector -> (threat type, technique id) that a behavioural detector may cite
DETECTOR_TECHNIQUES: tuple[tuple[str, str, str], ...] = (
    ("stream_ddos", "ddos", "T1498"),
    ("stream_recon", "reconnaissance", "T1046"),
)

# --------------------------------------------------------------------------
# Raw label -> threat class for the two public flow datasets.
# --------------------------------------------------------------------------
CIC_LABELS: dict[str, str] = {
    "BENIGN": "benign",
    "Benign": "benign",
    "DoS Hulk": "ddos",
    "DoS GoldenEye": "ddos",
    "DoS Slowhttptest": "ddos",
    "DoS slowloris": "ddos",
    "Heartbleed": "ddos",
    "FTP-Patator": "brute_force",
    "SSH-Patator": "brute_force",
    "PortScan": "reconnaissance",
    "Bot": "c2",
    "DDoS": "ddos",
    "Infiltration": "exfiltration",
    # the separator of the web attack labels differs by file encoding
    "Web Attack - Brute Force": "other",
    "Web Attack - XSS": "other",
    "Web Attack - Sql Injection": "other",
    "Web Attack – Brute Force": "other",
    "Web Attack – XSS": "other",
    "Web Attack – Sql Injection": "other",
    "Web Attack � Brute Force": "other",
    "Web Attack � XSS": "other",
    "Web Attack � Sql Injection": "other",
}
UNSW_LABELS: dict[str, str] = {
    "Normal": "benign", "DoS": "ddos", "Exploits": "other", "Fuzzers": "other",
    "Generic": "other", "Reconnaissance": "reconnaissance", "Shellcode": "c2",
    "Worms": "other", "Backdoor": "c2", "Backdoors": "c2", "Analysis": "reconnaissance",
}

# --------------------------------------------------------------------------
# Category and caveat status of every feature.
# --------------------------------------------------------------------------
FEATURE_CATALOGUE: tuple[tuple[str, str, str], ...] = (
    ("duration_sec", "basic", "safe"),
    ("total_packets", "basic", "safe"),
    ("total_bytes", "basic", "safe"),
    ("packets_per_sec", "basic", "safe"),
    ("bytes_per_sec", "basic", "safe"),
    ("forward_packets", "directional", "safe"),
    ("reverse_packets", "directional", "safe"),
    ("forward_bytes", "directional", "safe"),
    ("reverse_bytes", "directional", "safe"),
    ("fwd_rev_packet_ratio", "directional", "caveat"),
    ("fwd_rev_byte_ratio", "directional", "caveat"),
    ("pkt_size_mean", "packet_size_stats", "safe"),
    ("pkt_size_std", "packet_size_stats", "safe"),
    ("pkt_size_min", "packet_size_stats", "safe"),
    ("pkt_size_max", "packet_size_stats", "safe"),
    ("pkt_size_median", "packet_size_stats", "safe"),
    ("pkt_size_p25", "packet_size_stats", "safe"),
    ("pkt_size_p75", "packet_size_stats", "safe"),
    ("pkt_size_p90", "packet_size_stats", "safe"),
    ("iat_mean", "inter_arrival_time", "safe"),
    ("iat_std", "inter_arrival_time", "safe"),
    ("iat_min", "inter_arrival_time", "safe"),
    ("iat_max", "inter_arrival_time", "safe"),
    ("iat_median", "inter_arrival_time", "safe"),
    ("fwd_iat_mean", "inter_arrival_time", "safe"),
    ("fwd_iat_std", "inter_arrival_time", "safe"),
    ("fwd_iat_min", "inter_arrival_time", "safe"),
    ("fwd_iat_max", "inter_arrival_time", "safe"),
    ("rev_iat_mean", "inter_arrival_time", "safe"),
    ("rev_iat_std", "inter_arrival_time", "safe"),
    ("rev_iat_min", "inter_arrival_time", "safe"),
    ("rev_iat_max", "inter_arrival_time", "safe"),
    ("syn_count", "tcp_flags", "safe"),
    ("syn_ack_count", "tcp_flags", "safe"),
    ("ack_count", "tcp_flags", "safe"),
    ("fin_count", "tcp_flags", "safe"),
    ("rst_count", "tcp_flags", "safe"),
    ("psh_count", "tcp_flags", "safe"),
    ("syn_ratio", "tcp_flags", "safe"),
    ("ack_ratio", "tcp_flags", "safe"),
    ("fin_ratio", "tcp_flags", "safe"),
    ("rst_ratio", "tcp_flags", "safe"),
    ("psh_ratio", "tcp_flags", "safe"),
    ("protocol", "protocol", "caveat"),
    ("ip_version", "protocol", "caveat"),
    ("is_tcp", "protocol", "safe"),
    ("is_udp", "protocol", "safe"),
    ("is_icmp", "protocol", "safe"),
    ("payload_bytes_total", "payload_metadata", "safe"),
    ("forward_payload_bytes", "payload_metadata", "safe"),
    ("reverse_payload_bytes", "payload_metadata", "safe"),
    ("payload_ratio", "payload_metadata", "safe"),
)

# --------------------------------------------------------------------------
# Failure codes of the error analysis.
# --------------------------------------------------------------------------
FAILURE_CODES: tuple[tuple[str, str], ...] = (
    ("F1", "Feature representation limitation"),
    ("F2", "Insufficient directional visibility"),
    ("F3", "Threshold limitation"),
    ("F4", "Dataset bias"),
    ("F5", "Model instability"),
    ("F6", "Class imbalance"),
    ("F7", "Out-of-distribution behaviour"),
    ("F8", "Label ambiguity"),
    ("F9", "Flow reconstruction limitation"),
    ("F10", "Explanation limitation"),
)

# --------------------------------------------------------------------------
# Record types.
# --------------------------------------------------------------------------
RAW_PACKET = T.StructType([
    T.StructField("pkt_seq", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("raw", T.BinaryType()),
    T.StructField("wire_len", T.IntegerType()),
    T.StructField("cap_len", T.IntegerType()),
    T.StructField("iface", T.StringType()),
])
PACKET = T.StructType([
    T.StructField("pkt_seq", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("ip_total_length", T.IntegerType()),
    T.StructField("payload_size", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
])


# --------------------------------------------------------------------------
# Parameters.  The defaults are the reference operating points.
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class FlowParams:
    idle_sec: float = 120.0
    fin_grace_sec: float = 1.0


@dataclass(frozen=True)
class WindowParams:
    """Behavioural window and the thresholds of its signals."""

    window_sec: int = 60
    bucket_sec: int = 1
    min_sessions: int = 6
    syn_rate: float = 1000.0
    udp_rate: float = 1000.0
    udp_flow_rate: float = 100.0
    flow_rate: float = 100.0
    packet_rate: float = 2000.0
    unique_sources: int = 32
    entropy_bits: float = 3.0
    min_entropy_observations: int = 32
    periodicity_cv: float = 0.1
    concentration_ratio: float = 0.8
    port_fanout: int = 60
    host_fanout: int = 32
    directional_ratio: float = 10.0
    directional_bytes: int = 1048576
    min_directional_flows: int = 3
    policy_mode: str = "enrich_ml"

    @property
    def span(self) -> int:
        """Number of buckets in one window."""
        return self.window_sec // self.bucket_sec


@dataclass(frozen=True)
class DnsParams:
    window_sec: int = 60
    bucket_sec: int = 1
    pair_ttl_sec: float = 10.0
    entropy_bits: float = 3.5
    entropy_min_label: int = 20
    long_label: int = 40
    long_query: int = 100
    min_queries: int = 20
    unique_domains: int = 16
    unique_subdomains: int = 16
    query_rate: float = 0.3
    high_entropy_ratio: float = 0.7
    long_label_ratio: float = 0.7
    nxdomain_ratio: float = 0.5
    min_responses: int = 10
    txt_ratio: float = 0.8

    @property
    def span(self) -> int:
        return self.window_sec // self.bucket_sec


@dataclass(frozen=True)
class EncryptedParams:
    ttl_sec: float = 60.0
    #: Bytes and seconds from a direction's first segment within which its hello must come; None: all that a hello can take, however late.
    reassembly_bytes: int | None = None
    deadline_sec: float | None = None
