"""Small dimensions: classes with their weights, bands, networks, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Threat classes, fusion weights (P, A, S, R) and severity priors.
CLASS_PARAMS = {
    "DDOS": ((0.45, 0.25, 0.20, 0.10), 0.75),
    "C2_BEACONING": ((0.45, 0.20, 0.25, 0.10), 0.85),
    "DGA_DNS_TUNNELING": ((0.50, 0.15, 0.25, 0.10), 0.65),
    "ENCRYPTED_MALWARE": ((0.50, 0.15, 0.25, 0.10), 0.70),
    "RECON_PORT_SCAN": ((0.40, 0.20, 0.30, 0.10), 0.30),
    "DATA_EXFILTRATION": ((0.40, 0.20, 0.30, 0.10), 0.90),
}
DEFAULT_WEIGHTS, DEFAULT_PRIOR = (0.50, 0.20, 0.20, 0.10), 0.5

# Names under which a class may arrive.
CLASS_ALIASES = {
    "ddos": "DDOS", "volumetric_ddos": "DDOS", "dos": "DDOS", "flood": "DDOS",
    "beacon": "C2_BEACONING", "beaconing": "C2_BEACONING", "c2": "C2_BEACONING", "botnet_c2": "C2_BEACONING", "c2_beaconing": "C2_BEACONING",
    "dga": "DGA_DNS_TUNNELING", "dns_tunnel": "DGA_DNS_TUNNELING", "dns_tunneling": "DGA_DNS_TUNNELING",
    "dns_tunnelling": "DGA_DNS_TUNNELING", "dga_dns_tunneling": "DGA_DNS_TUNNELING",
    "ja3_malware": "ENCRYPTED_MALWARE", "ja3": "ENCRYPTED_MALWARE", "tls_malware": "ENCRYPTED_MALWARE",
    "encrypted_session_malware": "ENCRYPTED_MALWARE", "encrypted_malware": "ENCRYPTED_MALWARE",
    "scan": "RECON_PORT_SCAN", "port_scan": "RECON_PORT_SCAN", "portscan": "RECON_PORT_SCAN", "recon": "RECON_PORT_SCAN",
    "recon_port_scan": "RECON_PORT_SCAN",
    "exfil": "DATA_EXFILTRATION", "exfiltration": "DATA_EXFILTRATION", "data_exfiltration": "DATA_EXFILTRATION",
}

# The short name of each class at the edge.
SHORT_NAMES = {
    "DDOS": "ddos", "C2_BEACONING": "beacon", "DGA_DNS_TUNNELING": "dns_tunnel",
    "ENCRYPTED_MALWARE": "ja3_malware", "RECON_PORT_SCAN": "portscan", "DATA_EXFILTRATION": "exfil",
}

# Lower ends of risk bands.
RISK_BANDS = ((81, "CRITICAL"), (61, "HIGH"), (31, "MEDIUM"), (0, "LOW"))

# Internal networks.
INTERNAL_NETWORKS = ("192.168.50.0/24", "10.0.0.0/8", "172.16.0.0/12")

# Client fingerprints of known malware.
JA3_BLOCKLIST = (
    "e7d705a3286e19ea42f587b344ee6865",
    "a0e9f5d64349fb13191bc781f81f42e1",
    "6734f37431670ce18779794dd34f4aa0",
    "72a589da586844d7f0818ce684948eea",
    "51c64c77e60f3980eea90869b68c58a8",
    "b32309a26951912be7dba376398abc3b",
    "154c1640a0294193563914a1a36423a8",
    "7048a1c97a89e924b162ecd2c5a93a6b",
)

# Counts of frequent English letter pairs; any other pair counts one half.
ENGLISH_PAIRS = {
    "th": 356, "he": 307, "in": 243, "er": 205, "an": 199, "re": 185, "on": 176, "at": 149, "en": 145, "nd": 135,
    "ti": 134, "es": 131, "or": 128, "te": 120, "of": 117, "ed": 113, "is": 113, "it": 112, "al": 109, "ar": 107,
    "st": 105, "to": 104, "nt": 104, "ng": 95, "se": 93, "ha": 93, "as": 87, "ou": 87, "io": 83, "le": 83,
    "ve": 83, "co": 79, "me": 79, "de": 76, "hi": 76, "ri": 73, "ro": 73, "ic": 70, "ne": 69, "ea": 69,
    "ra": 69, "ce": 65, "li": 62, "ch": 60, "ll": 58, "be": 58, "ma": 57, "si": 55, "om": 55, "ur": 54,
}
PAIR_TOTAL = sum(ENGLISH_PAIRS.values()) + 0.5 * (26 * 26 - len(ENGLISH_PAIRS))


def class_params(spark: SparkSession) -> DataFrame:
    """``(threat_class, w_p, w_a, w_s, w_r, prior)``, one row per class."""
    rows = [(c, *w, prior) for c, (w, prior) in CLASS_PARAMS.items()]
    return spark.createDataFrame(rows, "threat_class string, w_p double, w_a double, w_s double, w_r double, prior double")


def networks(spark: SparkSession, cidrs: tuple[str, ...] = INTERNAL_NETWORKS) -> DataFrame:
    """``(cidr, lo, hi)``: address ranges of IPv4 networks as numbers."""
    return spark.createDataFrame([(c, *cidr_range(c)) for c in cidrs], "cidr string, lo long, hi long")


def cidr_range(cidr: str) -> tuple[int, int]:
    address, _, bits = cidr.partition("/")
    value = 0
    for part in address.split("."):
        value = value * 256 + int(part)
    size = 1 << (32 - int(bits))
    low = value // size * size
    return low, low + size - 1
