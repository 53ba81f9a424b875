"""Long bursts, trailing sums, streams with restarts and late rows, pruned appends, safe archives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import alerts as A
from tidewarden.operators import features, joins, sinks, windows
from tidewarden.params import DEFAULTS
from tidewarden.streaming import jobs, keyed

FOUND = "alert_id string, entity string, threat_class string, event_time double"


def greedy(rows, cooldown_s):
    """What the recurrence keeps, one after the other."""
    last, kept = {}, set()
    for i, entity, name, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if entity is not None and ((entity, name) not in last or t >= last[entity, name] + cooldown_s):
            last[entity, name] = t
            kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_of_bursts_against_the_recurrence(spark, seed):
    rng, rows = random.Random(seed), []
    for entity, step in (("dense", 0.4), ("ties", 1.0), ("sparse", 40.0), ("edge", 30.0), (None, 5.0)):
        t = rng.choice([0.0, 1.7e9 + 0.3])
        for k in range(400):
            t += step if entity in ("ties", "edge") else rng.expovariate(1 / step)
            t += 500.0 if rng.random() < 0.01 else 0.0
            rows.append((f"{entity}{k:04}", entity, rng.choice(["DDOS", "C2_BEACONING"]), t if entity != "ties" else float(round(t / 3))))
    made = spark.createDataFrame(rows + rows[:50], FOUND).repartition(5)
    for block in (1, 3, 16):
        assert {r["alert_id"] for r in windows.cooldown(made, 30.0, block).collect()} == greedy(rows, 30.0)
    assert windows.cooldown(made.limit(0)).count() == 0
    assert windows.cooldown(made, 0.0).count() == sum(r[1] is not None for r in rows)


def test_a_burst_of_a_million_is_spread_over_tasks(spark):
    rows = spark.range(1_000_000).select(
        F.lpad(F.col("id").cast("string"), 7, "0").alias("alert_id"), F.lit("h").alias("entity"), F.lit("DDOS").alias("threat_class"),
        (F.col("id") * 0.7 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("event_time"),
    )
    times = np.array([r[0] for r in rows.select("event_time").orderBy("event_time", "alert_id").collect()])
    want, at = 0, 0
    while at < len(times):
        want, at = want + 1, int(np.searchsorted(times, times[at] + 30.0))
    kept = windows.cooldown(rows, 30.0).select("event_time").orderBy("event_time").collect()
    assert len(kept) == want and min(b[0] - a[0] for a, b in zip(kept, kept[1:])) >= 30.0
    blocks = rows.groupBy(F.floor(F.col("event_time") / (30.0 * windows.BLOCK_COOLDOWNS))).count().agg(F.max("count"), F.count("*")).first()
    assert blocks[0] < 1000 and blocks[1] > 1000  # what a task folds at once


def test_bursts_are_followed_many_to_a_batch(spark):
    rows = [(f"{e}-{k:03}", f"e{e}", "DDOS", float(e + k * (7 + e % 5))) for e in range(60) for k in range(40)]
    made = spark.createDataFrame(rows, "alert_id string, entity string, threat_class string, event_time double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # bursts go on from batch to batch
    try:
        kept = windows.cooldown(made, 30.0, 2)
        assert {r["alert_id"] for r in kept.collect()} == greedy(rows, 30.0)
        assert "FlatMapGroups" not in plan(kept)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_block_tables_lead_where_the_recurrence_leads():
    rng = random.Random(5)
    for _ in range(200):
        times = np.array(sorted(rng.uniform(100, 160) for _ in range(rng.randint(1, 12))))
        entry, end = windows.block_table(times, True, 7.0)
        for _ in range(20):
            last = rng.uniform(times[0] - 7.0, times[0])
            now = last
            for t in times:
                now = t if t >= now + 7.0 else now
            k = int(np.searchsorted(entry, last + 7.0))
            assert (end[k] if k < len(end) else last) == now


def test_trailing_sums_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(f"a{k:03}", rng.choice(["x", "y", None]), "DDOS", float(rng.choice([0, 1_700_000_000]) + rng.randint(0, 4000) / 2)) for k in range(400)]
    made = spark.createDataFrame(rows, FOUND).repartition(4)
    got = {r["alert_id"]: r["recency"] for r in windows.repeat_recency(made).collect()}
    near = {r["alert_id"]: (r["n_prior"], r["nearest"]) for r in joins.prior_alerts(made.where("entity is not null")).collect()}
    for i, entity, _, t in rows:
        before = sorted(((u, j) for j, e, _, u in rows if e == entity and t - 600 <= u and (u, j) < (t, i)), reverse=True)
        assert got[i] == pytest.approx(1 - math.exp(-sum(2 ** (-(t - u) / 120) for u, _ in before)), abs=1e-12)
        if entity is not None:
            assert near[i] == (len(before), [j for _, j in before[:3]])
    assert len(got) == len(rows) and windows.repeat_recency(made.limit(0)).count() == 0


FLOW = "event_id long, us long, ts double, src_ip string, dst_port int, dst_ip string"


def flow(i, t, src="s", port=1, ip="d"):
    return (i, int(t * 1e6), float(t), src, port, ip)


def trailing(rows, window):
    out = {}
    for i, _, t, src, _, _ in rows:
        own = [r for r in rows if r[3] == src and t - window <= r[2] and (r[2], r[0]) <= (t, i)]
        out[i] = (len({r[4] for r in own} - {None}), len({r[5] for r in own}), len(own))
    return out


def test_trailing_state_over_batches_with_restarts(spark):
    rng, t, rows = random.Random(7), 1_700_000_000.0, []
    for k in range(900):
        t += rng.expovariate(1 / 9)
        rows.append(flow(k, round(t, 3), rng.choice("abc"), rng.choice([1, 2, 3, 4, None]), f"d{rng.randint(0, 5)}"))
    rows[601:650] = sorted(rows[601:650], key=lambda r: r[4] or 0)  # out of order within a part
    parts = [spark.createDataFrame(rows[a : a + 300], FLOW).coalesce(2) for a in (0, 300, 600)]
    found, queries = jobs.in_turns(spark, parts, lambda fed: keyed.trailing_state(fed, 600.0))
    assert len(queries) == 3 and len({q.runId for q in queries}) == 3
    got = {r["event_id"]: (r["ports"], r["ips"], r["attempts"]) for r in found.collect()}
    assert got == trailing(rows, 600.0)


def state_rows(query):
    last = query.recentProgress[-1].stateOperators[0]
    return last.numRowsTotal


def test_idle_sources_are_forgotten(spark):
    parts = [[flow(k, 1000.0 + k, f"s{k}") for k in range(20)], [flow(100, 50_000.0, "late")], [flow(101, 50_001.0, "late")]]
    _, queries = jobs.in_turns(spark, [spark.createDataFrame(p, FLOW) for p in parts], lambda fed: keyed.trailing_state(fed, 600.0))
    assert state_rows(queries[0]) == 20 and state_rows(queries[-1]) == 1


def test_a_batch_of_a_source_is_one_piece_of_state(spark):
    """Each quarter of the window was a piece, with calls of the state store of its own."""
    parts = [[flow(k, 1000.0 + 100 * k) for k in range(40)], [flow(100, 5000.0)]]
    found, queries = jobs.in_turns(spark, [spark.createDataFrame(p, FLOW) for p in parts], lambda fed: keyed.trailing_state(fed, 600.0))
    assert state_rows(queries[0]) == 1 and state_rows(queries[1]) == 1
    assert {r["event_id"]: r["attempts"] for r in found.collect()} == {r[0]: trailing(parts[0] + parts[1], 600.0)[r[0]][2] for r in parts[0] + parts[1]}


def detections(spark, rows):
    return spark.createDataFrame([(i, e, c, t, 0.8, 0.5) for i, e, c, t in rows], "alert_id string, entity string, threat_class string, event_time double, confidence double, anomaly double")


def test_alert_engine_over_batches_is_the_batch_engine(spark):
    rng, rows, t = random.Random(8), [], 1_700_000_000.0
    for k in range(600):
        t += rng.expovariate(1 / 12) + (2000.0 if rng.random() < 0.01 else 0.0)
        rows.append((f"a{k:04}", rng.choice(["x", "y"]), rng.choice(["DDOS", "C2_BEACONING", "RECON_PORT_SCAN"]), round(t, 2)))
    whole = detections(spark, rows)
    parts = [detections(spark, rows[a : a + 150]) for a in range(0, 600, 150)]
    parts[2] = parts[2].union(detections(spark, rows[295:300]))  # delivered again
    found, queries = jobs.in_turns(spark, parts, keyed.alert_engine)
    got = {r["alert_id"]: (round(r["recency"], 9), r["risk_score"], r["alert_count"], r["incident_risk"], r["incident_start"]) for r in found.collect()}
    kept = windows.repeat_recency(windows.cooldown(whole, DEFAULTS.cooldown_s))
    from tidewarden.functions import scalars as S

    risk = S.fuse(F.col("threat_class"), F.col("confidence"), F.col("anomaly"), F.col("recency"))
    want = windows.running_incident(windows.split_incidents(kept.withColumn("risk_score", risk)))
    assert got == {r["alert_id"]: (round(r["recency"], 9), r["risk_score"], r["alert_count"], r["incident_risk"], r["first_seen"]) for r in want.collect()}
    assert found.count() == len(got)


def test_idle_entities_of_the_engine_are_forgotten(spark):
    parts = [[(f"a{k}", f"e{k}", "DDOS", 1000.0 + k) for k in range(20)], [("b", "z", "DDOS", 90_000.0)], [("c", "z", "DDOS", 90_001.0)]]
    _, queries = jobs.in_turns(spark, [detections(spark, p) for p in parts], keyed.alert_engine)
    assert state_rows(queries[0]) > 60 and state_rows(queries[-1]) < 12


def test_late_rows_are_dropped_and_counted(spark):
    parts = [[flow(k, 10_000.0 + 60 * k) for k in range(100)], [flow(200, 10_001.0), flow(201, 20_000.0)], [flow(202, 40_000.0)]]
    made = [spark.createDataFrame(p, FLOW).withColumn("flow_id", F.col("event_id").cast("string")) for p in parts]
    found, queries = jobs.in_turns(spark, made, lambda fed: jobs.window_features(jobs.deduplicate(jobs.timed(fed), "flow_id", "10 minutes"), "1 hour"))
    assert jobs.rows_dropped(queries, "dedupeWithinWatermark") == 1
    assert found.agg(F.sum("attempts")).first()[0] == 101  # all but the late row and the last window


def test_poisoned_rows_land_in_quarantine_and_the_stream_goes_on(spark, tmp_path):
    good = '{"ts":"%d","flow_id":"f","src_ip":"1.2.3.4","event_type":"flow"}'
    source, events, rejects, state = (str(tmp_path / n) for n in ("in", "events", "rejects", "state"))
    for k in range(3):
        spark.createDataFrame([(good % k,), ("broken",), (None,)], "data string").write.mode("append").parquet(source)
        query = jobs.quarantined(spark.readStream.schema("data string").parquet(source), events, rejects, state)
        assert query.exception() is None
    assert sorted(r["ts"] for r in spark.read.parquet(events).collect()) == [0.0, 1.0, 2.0]
    parked = spark.read.parquet(rejects).groupBy("kind", "error").count().collect()
    assert {(r[0], r[1], r[2]) for r in parked} == {("event", "not a JSON object", 3), ("event", "no data", 3)}


def test_nearest_ranks():
    assert [jobs.nearest_rank([*range(1, 101)], q) for q in (50, 95, 99, 100)] == [50, 95, 99, 100]
    assert jobs.nearest_rank([7], 50) == 7 and jobs.nearest_rank([], 99) == 0.0


@pytest.mark.parametrize("longest", [16, 4096])
def test_dominant_frequency_against_a_whole_transform(spark, longest):
    rng, rows, series = random.Random(9), [], {}
    for name, n, period in (("wave", 300, 12), ("noise", 77, 0), ("short", 4, 0), (None, 50, 5), ("one", 1, 0)):
        t, own = 1_700_000_000.0, []
        for k in range(n):
            rows.append((len(rows), t, name))
            gap = round(2000.0 + (900.0 * math.sin(2 * math.pi * k / period) if period else 0.0) + 300 * rng.random(), 3)
            own.append(gap)
            t += gap
        series[name] = own[: n - 1]
    made = spark.createDataFrame(rows, "event_id long, ts double, src string").repartition(3)
    got = {r["src"]: (r["frequency"], r["magnitude"]) for r in features.dominant_frequency(made, ["src"], longest).collect()}
    assert "one" not in got and got["short"] == (0.0, 0.0) and len(got) == 4
    for name in ("wave", "noise", None):
        x = np.array(series[name])
        power = np.abs(np.fft.rfft(x - x.mean()))[1:]
        assert got[name] == (pytest.approx(np.fft.rfftfreq(len(x))[1:][power.argmax()]), pytest.approx(power.max(), rel=1e-6))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_appends_read_only_the_days_they_touch(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = lambda ids, day: spark.createDataFrame([(i, 86400.0 * day + 5) for i in ids], "alert_id string, event_time double")
    for day in range(5):
        sinks.append_alerts(rows(["a", "b"] if day == 0 else [f"{day}a"], day), path)
    batch = rows(["a", "c"], 0).union(rows(["3a"], 3))
    placed = batch.withColumn("part", sinks.alert_part(batch.columns))
    held = sinks.touched_alerts(placed, path)
    assert sorted(r[0] for r in held.select("alert_id").collect()) == ["3a", "a", "b"]
    assert "PartitionFilters: [part" in plan(held) and len(held.inputFiles()) >= 2
    sinks.append_alerts(batch, path)
    assert sorted(r[0] for r in spark.read.parquet(path).select("alert_id").collect()) == ["1a", "2a", "3a", "4a", "a", "b", "c"]


ALERT = "alert_id string, incident_id string, severity string, threat_class string, src_ip string, dst_ip string, event_time double"


@pytest.fixture
def active(spark, tmp_path):
    alerts = spark.createDataFrame([(f"a{k}", "i", "LOW", "DDOS", "s", "d", float(k)) for k in range(3)], ALERT)
    alerts.write.parquet(f"{tmp_path}/active/alerts")
    spark.createDataFrame([("i", 3)], "incident_id string, alert_count long").write.parquet(f"{tmp_path}/active/incidents")
    return str(tmp_path / "active"), str(tmp_path / "archive")


def counts(spark, active, root):
    return [spark.read.parquet(f"{p}").count() for p in (f"{active}/alerts", f"{active}/incidents", f"{root}/alerts", f"{root}/incidents")]


def test_archive_empties_the_active_tables(spark, active):
    assert sinks.archive_and_clear(spark, *active, "s1").first()["total_alerts"] == 3
    assert counts(spark, *active) == [0, 0, 3, 1]
    assert sinks.archive_and_clear(spark, *active, "s1").first()["total_alerts"] == 3  # again: nothing changes
    assert counts(spark, *active) == [0, 0, 3, 1] and sinks.archive_and_clear(spark, *active, "s2") is None


@pytest.mark.parametrize("step", ["_rename", "archive_session", "_delete"])
@pytest.mark.parametrize("done", [False, True])
def test_an_archive_that_stopped_is_finished_by_the_next_run(spark, active, monkeypatch, step, done):
    real, calls = getattr(sinks, step), []

    def stop(*args):
        calls.append(1)
        if done:
            real(*args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, step, stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.archive_and_clear(spark, *active, "s1")
    assert calls
    sinks.archive_and_clear(spark, *active, "s1")
    assert counts(spark, *active) == [0, 0, 3, 1]


def test_rejects_of_both_sides_are_parked(spark, tmp_path):
    event = "event_flow_id string, event_src_ip string, event_dst_ip string, event_ts double"
    schema = f"threat_class string, confidence double, evidence array<string>, flow_id string, src_ip string, dst_ip string, anomaly double, detector string, event_time double, {event}"
    row = lambda c, i, t: (c, 0.9, ["seen"], i, "h", "x", 0.5, "d", t, i, "h", "x", t)
    found = spark.createDataFrame([row("scan", "1", 5.0), row("ransomware", "2", 6.0), row("ddos", "3", 7.0)], schema)
    bad = lambda c, p, a, r: F.when(c == "DDOS", F.lit(700).cast("long")).otherwise(F.lit(50).cast("long"))
    alerts, before, after = A.guarded_alerts(found, str(tmp_path / "g"), fusion=bad)
    assert [r["flow_id"] for r in alerts.collect()] == ["1"] and [r["flow_id"] for r in before.collect()] == ["2"] and [r["flow_id"] for r in after.collect()] == ["3"]
    parked = {(r["kind"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/g/quarantine").collect()}
    assert parked == {("detection", "threat_class"), ("alert", "risk_score")}
