"""Window operators: trailing features, rolling scores, recency, incidents, winners, cooldown."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CLASS_PARAMS
from ..functions.scalars import clip01, round_half_up, severity


def trailing_features(flows: DataFrame, window_s: int = 600) -> DataFrame:
    """Each flow with its source's distinct ports and addresses, attempts and mean gap over the trailing window.

    The window ends with the flow itself; rows of one second count as one moment.
    Distinct counts come from sets over a range frame, since windows take no distinct
    aggregates.  Rows are partitioned by source and stretch of ``window_s``, each row
    also going to the next stretch as history, so a busy source is spread over time;
    only one row per stretch is sorted by source alone.
    """
    timed = flows.withColumn("_s", F.floor("ts").cast("long")).withColumn("_b", F.floor(F.col("_s") / window_s).cast("long"))
    lasts = timed.groupBy("src_ip", "_b").agg(F.max("ts").alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy("src_ip").orderBy("_b"))).drop("_last")
    inside = Window.partitionBy("src_ip", "_b").orderBy("ts", "event_id")
    gapped = timed.withColumn("_lag", F.lag("ts").over(inside)).join(lasts, ["src_ip", "_b"], "left")
    gapped = gapped.withColumn("_gap", F.col("ts") - F.coalesce("_lag", "_before"))
    spread = gapped.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_p", F.col("_b") + F.col("_ahead"))
    w = Window.partitionBy("src_ip", "_p").orderBy("_s").rangeBetween(-window_s, 0)
    featured = spread.withColumns({
        "trailing_ports": F.size(F.collect_set("dst_port").over(w)), "trailing_ips": F.size(F.collect_set("dst_ip").over(w)),
        "trailing_attempts": F.count("*").over(w), "trailing_gap": F.coalesce(F.avg("_gap").over(w), F.lit(0.0)),
    })
    return featured.where("_ahead = 0").drop("_s", "_b", "_lag", "_before", "_gap", "_ahead", "_p")


def rolling_zscore(buckets: DataFrame, keys: list[str], metric: str, history: int = 60, ceiling: float = 6.0) -> DataFrame:
    """Buckets with ``z`` of the metric against the ``history`` buckets before, and ``z_confidence``."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-history, -1)
    mean, std = F.avg(metric).over(w), F.stddev_samp(metric).over(w)
    z = F.when(std.isNull() | (std < 1e-9), 0.0).otherwise((F.col(metric) - mean) / std)
    return buckets.withColumn("z", z).withColumn("z_confidence", F.least(F.lit(1.0), F.abs("z") / ceiling))


#: Cooldowns that a block of an entity's history spans: at most one detection more than that is kept in it.
BLOCK_COOLDOWNS = 16


def cooldown(detections: DataFrame, cooldown_s: float = 30.0, block: int = BLOCK_COOLDOWNS) -> DataFrame:
    """Detections that are kept: per entity and class the first, then the first at least ``cooldown_s`` after the last kept.

    A recurrence, cut into blocks of time so that a long burst is spread over tasks.
    What a block does to those behind it is a table: from where its first kept detection
    can be to its last one, found by doubling the pointers to the next kept one.  The
    tables of a burst are followed from block to block, which gives the last detection
    kept before each; then every block is folded alone.  A block that begins
    ``cooldown_s`` after all before it needs no table.  Repeats of an alert id are one
    detection; ties go by alert id; without a positive cooldown all are kept.  Detections
    without an entity or a class are dropped.
    """
    if cooldown_s <= 0:
        return detections.where("entity is not null and threat_class is not null").dropDuplicates(["alert_id"])
    keys = ["entity", "threat_class"]
    at = F.floor(F.col("event_time") / (block * cooldown_s)).alias("_block")
    listed = detections.groupBy(*keys, at).agg(F.array_sort(F.collect_set(F.struct("event_time", "alert_id"))).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_block")  # one row per block
    ends = listed.select(*keys, "_block", F.element_at("_l", 1)["event_time"].alias("_first"), F.element_at("_l", -1)["event_time"].alias("_last"))
    tied = F.coalesce(F.col("_first") - F.lag("_last").over(w) < cooldown_s, F.lit(False))
    marked = ends.select(*keys, "_block", tied.alias("_tied"))
    begins = F.last(F.when(~F.col("_tied"), F.col("_block")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.select(*keys, "_block", "_tied", begins.alias("_burst"), F.coalesce(F.lead("_tied").over(w), F.lit(False)).alias("_more"))
    tables = listed.join(marked.where("_tied or _more"), [*keys, "_block"]).select(*keys, "_block", "_burst", "_tied", F.transform("_l", lambda x: x["event_time"]).alias("_t"))
    before = _last_before(tables, cooldown_s)
    start = F.struct(F.col("_before").alias("last"), F.array().cast("array<string>").alias("kept"))

    def step(state, x):
        keep = state["last"].isNull() | (x["event_time"] >= state["last"] + cooldown_s)
        kept = F.when(keep, F.concat(state["kept"], F.array(x["alert_id"]))).otherwise(state["kept"])
        return F.struct(F.when(keep, x["event_time"]).otherwise(state["last"]).alias("last"), kept.alias("kept"))

    folded = listed.join(before, [*keys, "_block"], "left").select(*keys, F.explode(F.aggregate("_l", start, step)["kept"]).alias("alert_id"))
    return detections.join(folded, [*keys, "alert_id"], "left_semi").dropDuplicates(["alert_id"])


def _last_before(tables: DataFrame, cooldown_s: float) -> DataFrame:
    """``(entity, threat_class, _block, _before)``: the time of the last detection kept before each block of a burst.

    A task goes over its bursts in order, many to a batch of rows, and remembers one time.
    It holds tables, not detections: an entry for each place within one cooldown of a
    block's start that leads to a different end.
    """
    arrow = pa.schema([("entity", pa.string()), ("threat_class", pa.string()), ("_block", pa.int64()), ("_burst", pa.int64()), ("entry", pa.list_(pa.float64())), ("exit", pa.list_(pa.float64()))])

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [block_table(t.values.to_numpy(), tied, cooldown_s) for t, tied in zip(batch.column(5), batch.column(4).to_pylist())]
            entry, end = (pa.array([x[k] for x in made], pa.list_(pa.float64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], entry, end], schema=arrow)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        burst, last = None, math.nan
        for batch in batches:
            before = []
            for own, entry, end in zip(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))), batch.column(4), batch.column(5)):
                if own != burst:
                    burst, last = own, math.nan
                before.append(last)
                entry, end = entry.values.to_numpy(), end.values.to_numpy()
                k = 0 if math.isnan(last) else int(np.searchsorted(entry, last + cooldown_s))
                last = float(end[k]) if k < len(end) else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.float64())], names=["entity", "threat_class", "_block", "_before"])

    keys = ["entity", "threat_class", "_burst"]
    steps = tables.mapInArrow(tabled, "entity string, threat_class string, _block long, _burst long, entry array<double>, exit array<double>")
    followed = steps.repartition(*keys).sortWithinPartitions(*keys, "_block").mapInArrow(follow, "entity string, threat_class string, _block long, _before double")
    return followed.withColumn("_before", F.nanvl("_before", F.lit(None).cast("double")))


def block_table(times: np.ndarray, tied: bool, cooldown_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a block can be entered, and the time of its last kept detection for each entry.

    ``times`` is in order.  A block is entered at its first time that is a cooldown
    behind the last kept one, so past the first cooldown only the next time can be.
    """
    far = np.searchsorted(times, times + cooldown_s)
    end = np.minimum(far, len(times) - 1)
    end[far == len(times)] = np.flatnonzero(far == len(times))
    while (end != end[end]).any():
        end = end[end]
    most = min(len(times), int(far[0]) + 1) if tied else 1
    entry, last = times[:most], times[end[:most]]
    keep = np.append(last[1:] != last[:-1], True)  # of entries with one end the latest stands for all
    return entry[keep], last[keep]


def repeat_recency(alerts: DataFrame, window_s: int = 600, half_life_s: float = 120.0) -> DataFrame:
    """Alerts with ``recency`` from the entity's earlier alerts within ``window_s``; ties go by alert id, which is unique.

    The decayed sum of a window is read off running sums of buckets of ``window_s``: what
    the alert's own bucket holds before it, and what the bucket before holds from the
    window's edge on.  Weights are relative to their bucket's start, so no power grows
    with the time, and a busy entity is spread over its buckets.
    """
    at, q = F.col("event_time"), F.floor(F.col("event_time") / window_s)
    row = F.struct(*alerts.columns)
    side = lambda own, q, at, row: F.struct(F.lit(own).alias("own"), q.alias("q"), at.alias("at"), row.alias("_row"))
    edge = side(0, q - 1, at - window_s, F.lit(None).cast(alerts.select(row.alias("r")).schema["r"].dataType))
    sides = alerts.select("alert_id", "entity", "event_time", F.inline(F.array(side(1, q, at, row), edge)))
    decay = F.pow(F.lit(2.0), (F.col("event_time") - F.col("q") * F.lit(float(window_s))) / half_life_s)
    weighed = sides.withColumn("_w", F.when(F.col("own") == 1, decay).otherwise(0.0))
    w = Window.partitionBy("entity", "q").orderBy("at", "own", "alert_id")  # an edge comes before alerts of its moment
    before = F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = F.when(F.col("own") == 1, before).otherwise(F.greatest(whole - before, F.lit(0.0))) / decay
    both = weighed.select("alert_id", part.alias("_m"), "_row").groupBy("alert_id").agg(F.sum("_m").alias("_m"), F.first("_row", ignorenulls=True).alias("_row"))
    return both.select("_row.*", clip01(F.lit(1.0) - F.exp(-F.col("_m"))).alias("recency"))


def split_incidents(alerts: DataFrame, gap_s: float = 600.0) -> DataFrame:
    """Alerts with ``incident_id``: a new one after a gap of more than ``gap_s`` within the entity.

    The id is derived from entity and first alert, so a repeated run gives the same.
    """
    w = Window.partitionBy("entity").orderBy("event_time", "alert_id")
    gap = F.col("event_time") - F.lag("event_time").over(w)
    starts = F.when(gap.isNull() | (gap > gap_s), F.col("alert_id"))
    marked = alerts.withColumn("_start", F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    digest = F.substring(F.sha1(F.concat_ws("|", "entity", "_start").cast("binary")), 1, 16)
    return marked.withColumn("incident_id", F.concat(F.lit("INC-"), digest)).drop("_start")


def running_incident(alerts: DataFrame) -> DataFrame:
    """Alerts with their incident's state after each: count, times, classes in order, noisy-OR of class maxima."""
    w = Window.partitionBy("incident_id").orderBy("event_time", "alert_id").rowsBetween(Window.unboundedPreceding, 0)
    survive, firsts = F.lit(1.0), []
    for name in CLASS_PARAMS:
        worst = F.max(F.when(F.col("threat_class") == name, F.col("risk_score"))).over(w)
        survive = survive * (F.lit(1.0) - F.least(F.coalesce(worst, F.lit(0)) / 100.0, F.lit(1.0)))
        first = F.min(F.when(F.col("threat_class") == name, F.struct("event_time", "alert_id", F.lit(name).alias("name")))).over(w)
        firsts.append(first)
    ordered = F.array_sort(F.filter(F.array(*firsts), lambda x: x.isNotNull()))
    return alerts.withColumns({
        "alert_count": F.count("*").over(w), "first_seen": F.min("event_time").over(w), "last_seen": F.max("event_time").over(w),
        "threat_classes": F.transform(ordered, lambda x: x["name"]),
        "incident_risk": F.least(F.lit(100), round_half_up((F.lit(1.0) - survive) * 100.0)),
    }).withColumn("incident_severity", severity(F.col("incident_risk")))


# How specific a class is, and the order that decides last.
SPECIFICITY = {"DGA_DNS_TUNNELING": 3, "ENCRYPTED_MALWARE": 3, "C2_BEACONING": 2, "DATA_EXFILTRATION": 2, "DDOS": 1, "RECON_PORT_SCAN": 1}


def best_detection(detections: DataFrame, key: str = "flow_id") -> DataFrame:
    """One detection per event: by confidence, then specificity of its class, then class and detector."""
    rank = F.lit(0)
    for name, value in SPECIFICITY.items():
        rank = F.when(F.col("threat_class") == name, value).otherwise(rank)
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), rank.desc(), "threat_class", "detector")
    return detections.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_features(attributions: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The ``n`` features of each key with the largest absolute contribution, ranked."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "feature")
    return attributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
