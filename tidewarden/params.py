"""Thresholds of detectors, fusion and correlation, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """One set of thresholds; ``dataclasses.replace`` makes variants."""

    # volumetric floods
    ddos_z: float = 3.0
    ddos_entropy: float = 3.0
    ddos_sources: int = 50
    ddos_rate_window_s: int = 60
    ddos_mean: float = 10.0
    ddos_std: float = 5.0
    # beacons
    beacon_cv: float = 0.30
    beacon_min_flows: int = 5
    beacon_acf: float = 0.7
    beacon_acf_min_times: int = 8
    # scans
    scan_ports: int = 20
    scan_window_s: int = 10
    scan_full_ports: float = 100.0
    # exfiltration
    exfil_ratio: float = 10.0
    exfil_min_bytes: int = 100_000
    exfil_mean: float = 2.0
    exfil_std: float = 1.5
    exfil_z: float = 3.0
    # names and fingerprints
    dga_probability: float = 0.5
    dga_entropy: float = 3.0
    tls_blocklist_confidence: float = 0.95
    tls_probability: float = 0.5
    # fusion and correlation
    z_ceiling: float = 6.0
    cooldown_s: int = 30
    recency_window_s: int = 600
    recency_half_life_s: float = 120.0
    incident_gap_s: int = 600


DEFAULTS = Params()
