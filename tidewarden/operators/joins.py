"""Joins of events and alerts with lists, dimensions, features and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import DEFAULT_PRIOR, DEFAULT_WEIGHTS
from ..functions.scalars import ipv4_number

SENTINELS = ("", "nan", "none", "null")  # fixed values: texts that stand for no fingerprint


def match_blocklist(events: DataFrame, blocklist: DataFrame, how: str = "flag") -> DataFrame:
    """Events with ``blocklist_hit``, or for ``how`` "hits" or "clean" only those that are or are not listed.

    Fingerprints are compared trimmed and lower-cased; sentinel texts never match.
    """
    key = F.lower(F.trim("ja3"))
    keyed = events.withColumn("_ja3", F.when(~key.isin(*SENTINELS), key))
    listed = blocklist.select(F.col("ja3").alias("_ja3")).distinct()
    if how in ("hits", "clean"):
        return keyed.join(listed, "_ja3", "left_semi" if how == "hits" else "left_anti").drop("_ja3")
    flagged = keyed.join(listed.withColumn("_hit", F.lit(True)), "_ja3", "left")
    return flagged.withColumn("blocklist_hit", F.coalesce("_hit", F.lit(False))).drop("_ja3", "_hit")


def with_class_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Fusion weights and severity prior of each row's class; defaults for any other class."""
    joined = rows.join(params, "threat_class", "left")
    defaults = dict(zip(("w_p", "w_a", "w_s", "w_r"), DEFAULT_WEIGHTS)) | {"prior": DEFAULT_PRIOR}
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def cidr_join(rows: DataFrame, networks: DataFrame, ip: str = "src_ip", carry: bool = False) -> DataFrame:
    """Rows with each network that holds their address; rows in none are left out.

    ``networks`` has ``cidr`` and its first and last address, ``lo`` and ``hi``.  A
    network's addresses share all bits but its lowest, so for each size of network, at most
    33, the join is one of equal numbers; a list of any length needs no broadcast.
    ``carry`` as in ``ipv4_number``.
    """
    sized = networks.withColumn("_bits", F.round(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")).withColumn("_net", F.expr("shiftright(lo, _bits)"))
    sizes = sorted(r[0] for r in sized.select("_bits").distinct().collect())  # 33 at most
    numbered = rows.withColumn("_ip", ipv4_number(F.col(ip), carry)).withColumn("_bits", F.explode(F.array(*[F.lit(b) for b in sizes]).cast("array<int>")))
    held = numbered.withColumn("_net", F.expr("shiftright(_ip, _bits)")).join(sized.drop("lo", "hi"), ["_bits", "_net"])
    return held.drop("_ip", "_bits", "_net")


def attach_features(events: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Events with the features of their key; every event stays."""
    return events.join(features, keys, "left")


def prior_alerts(alerts: DataFrame, window_s: float = 600.0, nearest: int = 3) -> DataFrame:
    """``alert_id, n_prior, nearest``: how many earlier alerts the entity has at most ``window_s`` before, and the ids of the last of them.

    One row per alert, whatever its entity's alerts are: counts are differences of
    running counts in buckets of ``window_s``, and the nearest are the ones before it in
    its bucket, then the last of the bucket before.  Ties go by alert id, which is unique.
    """
    at, q = F.col("event_time"), F.floor(F.col("event_time") / window_s)
    side = lambda own, q, at: F.struct(F.lit(own).alias("own"), q.alias("q"), at.alias("at"))
    sides = alerts.select("alert_id", "entity", "event_time", F.inline(F.array(side(1, q, at), side(0, q - 1, at - window_s))))
    w = Window.partitionBy("entity", "q").orderBy("at", "own", "alert_id")  # an edge comes before alerts of its moment
    before = F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.coalesce(F.sum("own").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0))
    counted = sides.select("alert_id", F.when(F.col("own") == 1, before).otherwise(behind).alias("n")).groupBy("alert_id").agg(F.sum("n").alias("n_prior"))

    own = alerts.select("alert_id", "entity", at.alias("at"), q.alias("q"))
    inside = Window.partitionBy("entity", "q").orderBy("at", "alert_id")
    tails = own.withColumn("_r", F.row_number().over(Window.partitionBy("entity", "q").orderBy(F.desc("at"), F.desc("alert_id")))).where(F.col("_r") <= nearest)
    tails = tails.groupBy("entity", (F.col("q") + 1).alias("q")).agg(F.collect_list(F.struct("at", "alert_id")).alias("_tail"))
    close = own.withColumn("_near", F.collect_list(F.struct("at", "alert_id")).over(inside.rowsBetween(-nearest, -1))).join(tails, ["entity", "q"], "left")
    both = F.concat("_near", F.filter(F.coalesce("_tail", F.array()), lambda x: x["at"] >= F.col("at") - window_s))
    latest = F.slice(F.sort_array(both, asc=False), 1, nearest)
    return counted.join(close.select("alert_id", F.transform(latest, lambda x: x["alert_id"]).alias("nearest")), "alert_id")


def prior_pairs(alerts: DataFrame, window_s: float = 600.0) -> DataFrame:
    """``alert_id, prior_id``: each alert with every earlier one of its entity at most ``window_s`` before; ties go by alert id.

    An alert looks into its own bucket of ``window_s`` and the one before, so a busy
    entity is spread over its buckets.
    """
    at, q = F.col("event_time"), F.floor(F.col("event_time") / window_s)
    earlier = alerts.select("entity", F.col("alert_id").alias("prior_id"), at.alias("prior_time"), q.alias("_q"))
    later = alerts.select("entity", "alert_id", "event_time", F.explode(F.array(q, q - 1)).alias("_q"))
    before = (F.col("prior_time") < at) | ((F.col("prior_time") == at) & (F.col("prior_id") < F.col("alert_id")))
    return later.join(earlier, ["entity", "_q"]).where(before & (F.col("prior_time") >= at - window_s)).select("alert_id", "prior_id")


def alerts_with_incidents(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts with their incident's risk and count; orphans keep nulls."""
    side = incidents.select("incident_id", F.col("risk_score").alias("incident_risk"), F.col("alert_count").alias("incident_alerts"))
    return alerts.join(side, "incident_id", "left")


def orphans(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts that name an incident which is not there."""
    return alerts.where(F.col("incident_id").isNotNull()).join(incidents.select("incident_id"), "incident_id", "left_anti")


def new_alerts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Alerts of a batch, once each, that the table does not hold."""
    return batch.dropDuplicates(["alert_id"]).join(existing.select("alert_id"), "alert_id", "left_anti")
