"""Detectors and readers on hand-made records with default thresholds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import detectors, features, ml, normalize
from tidewarden.sources import sensors
from tidewarden.sources.paths import new_path
from tidewarden.streaming import jobs

FLOW = "event_id long, flow_id string, ts double, us long, event_type string, src_ip string, dst_ip string, dst_port int, bytes_out long, bytes_in long, pkts_out long, pkts_in long, duration double, conn_state string, dns_query string, ja3 string"


def flows(spark, rows):
    made = []
    for k, r in enumerate(rows):
        x = {"ts": float(k), "src": "10.0.0.5", "dst": "198.51.100.1", "port": 443, "out": 100, "in": 100, "state": "SF", "query": None, "ja3": None} | r
        made.append((k, str(k), x["ts"], int(x["ts"] * 1e6), "flow", x["src"], x["dst"], x["port"], x["out"], x["in"], 1, 1, 1.0, x["state"], x["query"], x["ja3"]))
    return spark.createDataFrame(made, FLOW)


def test_scan(spark):
    probe = flows(spark, [{"ts": 100 + k / 100, "port": k, "state": "S0"} for k in range(200)])
    row = detectors.detect_scan(probe).first()
    assert row["threat_class"] == "RECON_PORT_SCAN" and row["confidence"] == 1.0 and row["evidence"][0].startswith("ports=200")
    assert detectors.detect_scan(flows(spark, [{"ts": 100 + k / 100, "port": k} for k in range(19)])).count() == 0


def test_flood(spark):
    many = flows(spark, [{"ts": 120 + k / 1000, "src": f"203.0.{k // 250}.{k % 250}"} for k in range(1000)])
    assert detectors.detect_ddos(many).first()["confidence"] == 1.0
    assert detectors.detect_ddos(flows(spark, [{"ts": 120 + k / 1000} for k in range(1000)])).count() == 0


def test_beacon(spark):
    random.seed(1)
    regular = flows(spark, [{"ts": 5 * k + random.uniform(-0.3, 0.3)} for k in range(30)])
    assert detectors.detect_beacon(regular).first()["threat_class"] == "C2_BEACONING"
    t, bursts = 0.0, []
    for _ in range(30):
        t += random.expovariate(0.2)
        bursts.append({"ts": t})
    assert detectors.detect_beacon(flows(spark, bursts)).count() == 0


def test_beacon_proxy(spark):
    rows = flows(spark, [{}]).withColumns({"source_flow_count": F.lit(12), "unique_ips": F.lit(1), "mean_gap": F.lit(5.0)})
    assert detectors.detect_beacon_proxy(rows).count() == 1
    assert detectors.detect_beacon_proxy(rows.withColumn("unique_ips", F.lit(5))).count() == 0


def test_exfiltration_only_from_inside(spark):
    big = {"out": 2_000_000, "in": 100}
    found = detectors.detect_exfil(flows(spark, [big, big | {"src": "203.0.113.5"}, big | {"src": "fe80::1"}, {"out": 50_000, "in": 1}]))
    assert found.count() == 1 and found.first()["confidence"] == 1.0


def test_listed_fingerprints_in_any_spelling(spark):
    listed = sensors.read_blocklist(spark)
    ja3 = "72a589da586844d7f0818ce684948eea"
    rows = flows(spark, [{"ja3": f" {ja3.upper()} "}, {"ja3": "nan"}, {"ja3": "0" * 32}, {}])
    assert [r["confidence"] for r in detectors.detect_tls(rows, listed).collect()] == [0.95]


def test_labels_are_never_read(spark):
    listed = sensors.read_blocklist(spark)
    rows = flows(spark, [{"ja3": "0" * 32}]).withColumn("label", F.lit("ja3_malware"))
    assert detectors.detect_tls(rows, listed).count() == 0


def test_a_group_is_on_one_side_of_the_split(spark):
    train, test = ml.group_split(flows(spark, [{"src": f"10.0.0.{k % 40}"} for k in range(400)]), "src_ip")
    assert train.count() + test.count() == 400 and train.select("src_ip").distinct().join(test, "src_ip", "left_semi").count() == 0


def test_isolation_forest_finds_the_odd_row(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") == 0, F.array(F.lit(50.0), F.lit(-50.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("features_array"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    scores = {r["id"]: r["anomaly"] for r in ml.isolation_scores(rows, ml.fit_isolation_forest(rows, "id", trees=40)).collect()}
    assert max(scores, key=scores.get) == 0 and scores[0] > 0.3


def test_short_series_have_trivial_autocorrelation(spark):
    acf = lambda xs: spark.range(1).select(features.acf_of(F.array(*[F.lit(float(x)) for x in xs])).alias("a")).first()["a"]
    assert acf([1, 2]) == [1.0] and acf([3, 3, 3, 3]) == [0.0, 0.0, 0.0]
    assert acf([1, 5, 1, 5, 1, 5, 1, 5])[2] == pytest.approx(0.75)


def test_row_detector_isolates_errors(spark):
    def rule(event):
        if event["flow_id"] == "1":
            raise KeyError("x")
        return None if event["flow_id"] == "0" else [{"threat_class": "scan", "confidence": 0.5, "evidence": ["e"]}] * 2

    found, errors = detectors.from_row_detector(rule, "mine")(flows(spark, [{}, {}, {}]).select("flow_id", "src_ip", "dst_ip", "ts"))
    assert found.count() == 2 and errors.first()["error"].startswith("KeyError")


def test_envelopes(spark):
    good = '{"ts":"12.5","flow_id":7,"src_ip":"1.2.3.4","event_type":"flow"}'
    bad = [None, "nope", "[1]", '{"ts":1,"flow_id":"a","src_ip":"b"}', good.replace("12.5", "nan"), "{}"]
    valid, rejects = sensors.parse_envelope(spark.createDataFrame([(x,) for x in [good, *bad]], "data string"))
    row = valid.first()
    assert valid.count() == 1 and (row["ts"], row["flow_id"]) == (12.5, "7") and rejects.count() == len(bad)


def test_nested_records(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": "2026-01-01T05:30:00.5+0530", "flow_id": 1, "event_type": "flow", "src_ip": "10.0.0.1", "src_port": 5, "dest_ip": "b", "dest_port": 80, "flow": {"bytes_toserver": 10, "age": 0, "state": "new"}}),
        json.dumps({"timestamp": "bad", "event_type": "flow", "src_ip": "fe80::1", "dest_ip": "fe80::2", "icmp_type": 1}),
        json.dumps({"timestamp": "2026-01-01T00:00:00+0000", "event_type": "dns", "src_ip": "a", "dest_ip": "b", "dns": {"queries": [{"rrname": "x.y", "rrtype": "TXT"}]}}),
        json.dumps({"timestamp": "2026-01-01T00:00:00+0000", "event_type": "tls", "src_ip": "a", "dest_ip": "b", "ja3_hash": "h"}),
        json.dumps({"event_type": "stats", "stats": {}}), '{"broken',
    ]
    (tmp_path / "eve.json").write_text("\n".join(lines))
    rows = normalize.normalize_eve(sensors.read_eve(spark, str(tmp_path))).collect()
    by = {r["src_ip"] + r["event_type"]: r for r in rows}
    assert len(rows) == 4 and by["10.0.0.1flow"]["ts"] == pytest.approx(1767225600.5) and by["10.0.0.1flow"]["duration"] == 0
    assert by["fe80::1flow"]["flow_id"] == "fe80::1:None-fe80::2:None" and by["fe80::1flow"]["ts"] is None
    assert (by["adns"]["dns_query"], by["adns"]["dns_qtype"], by["atls"]["ja3"]) == ("x.y", "TXT", "h")


def test_flat_records_take_their_type_from_the_file(spark, tmp_path):
    (tmp_path / "conn.log").write_text('{"ts":1.5,"uid":"C1","id.orig_h":"a","id.orig_p":1,"id.resp_h":"b","id.resp_p":2,"orig_bytes":7}\n')
    (tmp_path / "dns.log").write_text('{"ts":2.5,"id.orig_h":"a","id.orig_p":1,"id.resp_h":"b","id.resp_p":53,"query":"q"}\n')
    (tmp_path / "weird.log").write_text('{"ts":2.5}\n')
    rows = {r["log_type"]: r for r in normalize.normalize_zeek(sensors.read_zeek(spark, str(tmp_path))).collect()}
    assert set(rows) == {"conn", "dns"} and rows["conn"]["flow_id"] == "C1" and rows["dns"]["flow_id"] == "a:1-b:53" and rows["dns"]["dns_query"] == "q"


def test_blocklist_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('["AA ", "bb"]')
    (tmp_path / "l.csv").write_text("# c\nCC,bad,1\n\nbb,x\n")
    got = {r[0] for r in sensors.read_blocklist(spark, str(tmp_path / "l.json"), str(tmp_path / "l.csv")).collect()}
    assert {"aa", "bb", "cc"} < got and len(got) == 11


def test_metrics_listener_counts_each_run_from_nothing(spark, small):
    from tidewarden.plans.streams import stream_flows

    metrics = jobs.Metrics()
    spark.streams.addListener(metrics)
    rows = stream_flows(spark, small).groupBy("src_ip").count()
    runs = [metrics.wait(jobs.drain(rows, "complete", new_path(spark, "stream"), new_path(spark, "state"))) for _ in range(2)]
    spark.streams.removeListener(metrics)
    assert [r["rows"] for r in runs] == [1000, 1000] and all(r["batches"] == len(r["millis"]) >= 1 for r in runs)


def test_an_autocorrelation_costs_no_power_of_its_length(spark):
    """A block of the longest size took n ** 3 steps: hours for a few of them."""
    import time

    rng = random.Random(4)
    series = [[rng.random() + (k % 7 == 0) for k in range(n)] for n in (200, 1000, 4096)]
    rows = spark.createDataFrame([(x,) for x in series for _ in range(8)], "x array<double>")
    start = time.monotonic()
    got = [r["a"] for r in rows.select(features.acf_of(F.col("x")).alias("a")).collect()]
    assert time.monotonic() - start < 60 and len(got) == 24
    for x, a in zip(series, got[::8]):
        mean = sum(x) / len(x)
        c = [v - mean for v in x]
        want = {lag: sum(p * q for p, q in zip(c, c[lag:])) / sum(v * v for v in c) for lag in (0, 1, 2, 7, len(x) // 2)}
        assert len(a) == len(x) // 2 + 1 and {lag: a[lag] for lag in want} == pytest.approx(want, abs=1e-9)


def test_a_long_series_has_one_autocorrelation(spark, tmp_path):
    import duckdb

    from tidewarden.plans.common import ACF_SQL, BEACON_GAPS

    made, rng = [], random.Random(4)
    for name, n in (("long", 4600), ("short", 40), ("flat", 4200), (None, 4300)):
        at = 0.0
        for k in range(n):
            at += 1.0 if name == "flat" else 5.0 + 3 * (k % 2 if k > 4560 else rng.random()) + (k % 2200 < 30) * 9
            made.append({"ts": at, "src": name})
    rows = flows(spark, made).cache()
    keys = ["src_ip", "dst_ip"]
    got = {r["src_ip"]: r for r in features.autocorrelation(rows, keys).collect()}
    assert len(got) == 4 and len(got["long"]["acf"]) == 4599 // 2 + 1 and got["long"]["acf"][0] == 1.0
    assert got["flat"]["acf_peak"] == 0.0 and got["long"]["acf"][got["long"]["acf_lag"]] == got["long"]["acf_peak"]
    some = rows.where("src_ip in ('long', 'short')")
    some.write.parquet(str(tmp_path / "flows"))
    sql = f"WITH flows AS (SELECT * FROM '{tmp_path}/flows/*.parquet'), {BEACON_GAPS}, {ACF_SQL} SELECT s, acf_peak FROM peaks"
    for name, peak in duckdb.sql(sql).fetchall():
        assert got[name]["acf_peak"] == pytest.approx(peak, abs=1e-9)
    by_blocks = {r["src_ip"]: r for r in features.autocorrelation(some, keys, longest=37).collect()}
    for name, r in by_blocks.items():
        assert r["acf_lag"] == got[name]["acf_lag"] and r["acf"] == pytest.approx(got[name]["acf"], abs=1e-9)
    peaks = {r["src_ip"]: r["acf_peak"] for r in detectors.beacon_stats(some).collect()}
    assert peaks == {name: pytest.approx(r["acf_peak"], abs=1e-9) for name, r in by_blocks.items()}


def test_an_envelope_is_parsed_once(spark):
    valid, rejects = sensors.parse_envelope(spark.createDataFrame([("{}",), (None,), ("[1]",), ('{"ts":"1","flow_id":"f","src_ip":"s","event_type":"flow","x":2}',)], "data string"))
    for part in (valid, rejects):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert valid.count() == 1 and sorted(r["error"] for r in rejects.collect()) == ["no data", "not a JSON object", "not a JSON object"]
