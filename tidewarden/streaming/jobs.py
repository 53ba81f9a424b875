"""Streaming forms: windows, sessions, delivery, quarantine and metrics; keyed state is in ``keyed``.

Every job reads what is there with the available-now trigger and stops, or runs on
with another trigger; the same functions serve both.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.sinks import append_alerts, quarantine
from ..sources.paths import new_path
from ..sources.sensors import parse_envelope


def timed(flows: DataFrame) -> DataFrame:
    """Flows with ``event_time`` as a timestamp, which watermarks need."""
    return flows.withColumn("event_time", F.timestamp_micros("us"))


def drain(rows: DataFrame, mode: str, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process everything that is there, then stop.

    Complete results replace the table at ``path`` with each batch; appended ones are
    written once, whatever fails and is tried again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append" and each is None:
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(each or write).start()
    query.awaitTermination()
    return query


def run(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into the shared folder and read the result."""
    path = new_path(spark, "stream")
    drain(rows, mode, path, new_path(spark, "stream-state"))
    return spark.read.schema(rows.schema).parquet(path)


def window_features(flows: DataFrame, window: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Approximate distinct ports and addresses, and attempts, per source and event-time window.

    With ``delay`` rows later than that behind the newest are dropped, and windows are
    final once it has passed; a batch run over all rows is the way to repair them.
    """
    rows = flows if "event_time" in flows.columns else timed(flows)
    rows = rows.withWatermark("event_time", delay) if delay else rows
    grouped = rows.groupBy("src_ip", F.window("event_time", window, slide) if slide else F.window("event_time", window))
    stats = grouped.agg(F.approx_count_distinct("dst_port").alias("ports"), F.approx_count_distinct("dst_ip").alias("ips"), F.count("*").alias("attempts"))
    return stats.select("src_ip", F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "ports", "ips", "attempts")


def gap_sessions(flows: DataFrame, gap: str = "3600 seconds", delay: str = "1 hour") -> DataFrame:
    """Attempts per source in stretches of activity that a gap ends."""
    grouped = timed(flows).withWatermark("event_time", delay).groupBy("src_ip", F.session_window("event_time", gap))
    stats = grouped.agg(F.count("*").alias("attempts"))
    return stats.select("src_ip", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "attempts")


def deduplicate(rows: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """One row per key within the watermark's delay."""
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def deliver(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Deliver alerts at least once with the effect of once: what the table holds is not written again."""
    return drain(alerts, "append", path, checkpoint, each=lambda batch, _: append_alerts(batch, path))


def in_turns(spark: SparkSession, parts: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[StreamingQuery]]:
    """A stream that is fed part by part and started anew for each, from the checkpoint of the last.

    Parts are written one after the other to a folder that the stream follows; what the
    query of one part has seen, state and watermark, is what the next goes on from.
    Returns all it has written, and the queries.
    """
    source, path, checkpoint, queries = new_path(spark, "fed"), new_path(spark, "stream"), new_path(spark, "stream-state"), []
    for part in parts:
        part.write.mode("append").parquet(source)
        made = job(spark.readStream.schema(part.schema).parquet(source))
        queries.append(drain(made, "append", path, checkpoint))
    return spark.read.schema(made.schema).parquet(path), queries


def rows_dropped(queries: Iterable[StreamingQuery], operator: str) -> int:
    """Rows that the watermark kept from an operator, as the queries' progress tells."""
    return sum(s.numRowsDroppedByWatermark for q in queries for p in q.recentProgress for s in p.stateOperators if s.operatorName == operator)


def quarantined(entries: DataFrame, events: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Take a stream of envelopes apart: sound events go to one table, poisoned entries with their error to another.

    A batch that is tried again writes its parts again, each below its own number, so the
    effect is that of once; no entry stops the stream.
    """

    def split(batch: DataFrame, number: int) -> None:
        good, bad = parse_envelope(batch)
        good.write.mode("overwrite").parquet(f"{events}/batch={number}")
        parked = quarantine(bad, "event", F.col("error"), F.current_timestamp().cast("double"))
        parked.write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return drain(entries, "append", events, checkpoint, each=split)


class Metrics(StreamingQueryListener):
    """What the runs of a session's queries did, each run counted from nothing.

    Of a run it keeps rows, batches, how long each batch took, the rate of the last
    hundred batches, rows that watermarks dropped, and the last figures of every
    ``Dataset.observe``.  ``wait`` returns once the run's end has been told, which
    comes after all of its batches.
    """

    def __init__(self):
        self.runs: dict[str, dict] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        run = str(event.runId)
        self.runs[run] = {"rows": 0, "batches": 0, "millis": [], "rates": [], "dropped": 0, "observed": {}}
        self.ended.setdefault(run, threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = self.runs[str(p.runId)]
        run["rows"] += p.numInputRows
        if p.numInputRows:
            run["batches"] += 1
            run["millis"].append(p.durationMs.get("triggerExecution", 0))
            run["rates"] = [*run["rates"][-99:], p.processedRowsPerSecond]
        run["dropped"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        for name, row in p.observedMetrics.items():
            run["observed"].setdefault(name, []).append(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> dict:
        """The figures of a run that has ended."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("the end of the run was not told")
        return self.runs[str(query.runId)]


def nearest_rank(values: list[float], q: float) -> float:
    """The smallest value that at least ``q`` percent of all do not exceed; 0 for none."""
    return sorted(values)[math.ceil(q / 100 * len(values)) - 1] if values else 0.0
