"""Sinks: idempotent alert tables, incidents, quarantine, session archive, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import new_alerts
from .reports import alert_stats


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Parts of a table up to which a batch names the ones it touches; beyond, they are found by a join.
NAMED_PARTS = 1000


def alert_part(columns: list[str]) -> Column:
    """The part of a table that an alert lies in: the day of its event, or the beginning of its id where times are not kept."""
    return F.floor(F.col("event_time") / 86400).cast("string") if "event_time" in columns else F.substring("alert_id", 1, 2)


def touched_alerts(batch: DataFrame, path: str) -> DataFrame:
    """Ids of the table at ``path`` in those parts that the batch's alerts lie in; no other part is read.

    An alert that comes again has its time and id again, so it lies where it lay.
    """
    spark = batch.sparkSession
    table = spark.read.schema("alert_id string, part string").parquet(path)
    parts = batch.select("part").distinct()
    named = [r[0] for r in parts.limit(NAMED_PARTS + 1).collect()]
    return table.where(F.col("part").isin(named)) if len(named) <= NAMED_PARTS else table.join(parts, "part", "left_semi")


def append_alerts(batch: DataFrame, path: str) -> None:
    """Append the alerts of a batch that the table at ``path`` does not hold, once each.

    The table is laid out in parts (column ``part``); what a batch costs grows with the
    parts it touches, not with the table.
    """
    placed = batch.withColumn("part", F.coalesce(alert_part(batch.columns), F.lit("none")))
    held = touched_alerts(placed, path) if exists(batch.sparkSession, path) else placed.select("alert_id").limit(0)
    new_alerts(placed, held).write.mode("append").partitionBy("part").parquet(path)


def latest_incidents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new incidents, by id the one last seen; on a tie the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("incident_id").orderBy(F.desc("_new"), F.desc("last_seen"), F.desc("alert_count"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def upsert_incidents(batch: DataFrame, path: str) -> str:
    """Write the next version of the incident table below ``path`` and return its folder.

    Versions are whole folders, numbered; readers take the last one, so a failed
    write changes nothing.
    """
    spark = batch.sparkSession
    now = current_version(spark, path)
    old = spark.read.schema(batch.schema).parquet(f"{path}/v={now}") if now else batch.limit(0)
    target = f"{path}/v={now + 1}"
    latest_incidents(old, batch).write.parquet(target)
    return target


def current_version(spark: SparkSession, path: str) -> int:
    version = 0
    while exists(spark, f"{path}/v={version + 1}/_SUCCESS"):
        version += 1
    return version


def tagged_json(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("kind", F.lit(kind))


def write_tagged_json(rows: DataFrame, kind: str, path: str) -> None:
    tagged_json(rows, kind).write.mode("append").json(path)


def quarantine(rejects: DataFrame, kind: str, error: Column, at: Column) -> DataFrame:
    """``kind, payload, error, quarantined_at``: the whole row as JSON and why, at most 500 characters."""
    payload = F.to_json(F.struct(*[F.col(c) for c in rejects.columns]))
    return rejects.select(F.lit(kind).alias("kind"), payload.alias("payload"), F.substring(error.cast("string"), 1, 500).alias("error"), at.alias("quarantined_at"))


def replay_quarantine(parked: DataFrame, alert_schema: str, incident_schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parked alerts, parked incidents, and what stays: raw events and rows that no longer parse."""
    whole = parked.withColumns({
        "alert": F.when(F.col("kind") == "alert", F.from_json("payload", alert_schema)),
        "incident": F.when(F.col("kind") == "incident", F.from_json("payload", incident_schema)),
    })
    alerts = whole.where("alert.alert_id is not null").select("alert.*")
    incidents = whole.where("incident.incident_id is not null").select("incident.*")
    rest = whole.where("alert.alert_id is null and incident.incident_id is null").select(*parked.columns)
    return alerts, incidents, rest


def session_summary(alerts: DataFrame, incidents: DataFrame, session_id: Column, reason: str) -> DataFrame:
    """One row about a session: times, totals, distinct addresses, counts by class and level."""
    total = incidents.agg(F.count("*").alias("total_incidents"))
    return alert_stats(alerts).join(total, F.lit(True)).withColumns({"session_id": session_id, "reason": F.lit(reason)})


def archive_session(alerts: DataFrame, incidents: DataFrame, session: str, root: str, reason: str = "manual") -> DataFrame | None:
    """Copy both tables below ``root`` under the session and return its summary; None if there are no alerts.

    ``archive_and_clear`` empties the active tables as well.
    """
    if alerts.isEmpty():
        return None
    for name, rows in (("alerts", alerts), ("incidents", incidents)):
        rows.write.mode("overwrite").parquet(f"{root}/{name}/session_id={session}")
    summary = session_summary(alerts, incidents, F.lit(session), reason)
    summary.drop("session_id").write.mode("overwrite").parquet(f"{root}/sessions/session_id={session}")
    return summary


def archive_and_clear(spark: SparkSession, active: str, root: str, session: str, reason: str = "manual") -> DataFrame | None:
    """Move the tables ``alerts`` and ``incidents`` below ``active`` into the archive and leave empty ones; the summary, or None if there was no alert.

    The tables are first set aside by a rename, with empty ones in their place, so alerts
    that come meanwhile belong to the next session.  What was set aside is copied, counted
    against the copy, summed up, and only then deleted.  A run that was stopped at any step
    is finished by running it again with the same session; one that had ended changes nothing.
    """
    aside = {name: f"{active}/{name}.session={session}" for name in ("alerts", "incidents")}
    done = f"{root}/sessions/session_id={session}"
    if not exists(spark, f"{done}/_SUCCESS"):
        for name, place in aside.items():
            if not exists(spark, place):
                schema = spark.read.parquet(f"{active}/{name}").schema
                _rename(spark, f"{active}/{name}", place)
                spark.createDataFrame([], schema).write.parquet(f"{active}/{name}")
        alerts, incidents = (spark.read.parquet(place) for place in aside.values())
        if alerts.isEmpty():
            return None
        archive_session(alerts, incidents, session, root, reason)
    for name, place in aside.items():  # a stop after the rename leaves no table: put an empty one there
        if exists(spark, place):
            held, copy = spark.read.parquet(place), spark.read.parquet(f"{root}/{name}/session_id={session}")
            if held.count() != copy.count():
                raise RuntimeError(f"the archive of {name} does not hold all rows; nothing was deleted")
            if not exists(spark, f"{active}/{name}"):
                spark.createDataFrame([], held.schema).write.parquet(f"{active}/{name}")
            _delete(spark, place)
    return spark.read.parquet(done).withColumn("session_id", F.lit(session))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(path(old), path(new)):
        raise OSError(f"{old} cannot be renamed")


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Session summaries, the newest first."""
    return sessions_latest_first(spark.read.parquet(f"{root}/sessions").withColumn("session_id", F.col("session_id").cast("string")))


def sessions_latest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("session_id"))


def load_session(spark: SparkSession, root: str, session: str) -> tuple[DataFrame, DataFrame]:
    """A session's alerts and incidents; only its folders are read."""
    return tuple(spark.read.parquet(f"{root}/{name}/session_id={session}") for name in ("alerts", "incidents"))


def delete_session(spark: SparkSession, root: str, session: str) -> None:
    for name in ("alerts", "incidents", "sessions"):
        _delete(spark, f"{root}/{name}/session_id={session}")


def flat_map(column: str) -> Column:
    """A map as ``k:v; k:v`` in order of keys."""
    return F.concat_ws("; ", F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))


def export_rows(sessions: DataFrame) -> DataFrame:
    """The tabular summary of sessions, maps flattened."""
    return sessions.select(
        "session_id", "total_alerts", "total_incidents", "unique_source_ips", "unique_dest_ips", flat_map("by_threat_class").alias("top_threats"),
        flat_map("by_severity").alias("risk_breakdown"), "reason",
    )


def export_csv(sessions: DataFrame, path: str) -> None:
    export_rows(sessions).write.mode("overwrite").option("header", True).csv(path)


def fresh_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"
