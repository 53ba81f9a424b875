"""Keyed state of streams: trailing windows and the alert engine, by ``transformWithState``.

State is kept in small pieces, so a batch writes only what it touches, and event-time
timers clear a key that has been silent for as long as anything of it can matter.  The
RocksDB state store is needed; ``keyed_state`` sets it for a session.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..dims import CLASS_PARAMS
from ..params import DEFAULTS, Params

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Have the session's streams keep state in RocksDB, which map state and timers need."""
    spark.conf.set(PROVIDER, ROCKS)


def until(seconds: float) -> int:
    """The first millisecond past an event time."""
    return math.floor(seconds * 1000) + 1


def rearm(handle: StatefulProcessorHandle, at: int, watermark: int) -> None:
    """Leave one timer, at ``at``; one that the watermark has passed would never fire."""
    old = [*handle.listTimers()]
    for t in old:
        if t != at:
            handle.deleteTimer(t)
    if at not in old and at > watermark:
        handle.registerTimer(at)


TRAILING = "event_id long, src_ip string, ports int, ips int, attempts int"


#: Flows below which a piece of state takes in those of the next batch.
PIECE = 64


class TrailingWindow(StatefulProcessor):
    """Distinct ports and addresses, and attempts, of a source in the window that ends with each flow.

    A batch adds its flows of a source as one piece, or to the last piece while that holds
    fewer than ``PIECE``, so a call of the state store serves all of them; a piece of which
    half can matter no more is written anew without that.  Counts per value go up and down as flows come and go, so a
    flow costs the same however full the window is.
    """

    def __init__(self, window_s: float):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "number long", "ts array<double>, ids array<long>, ports array<int>, ips array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {number: [*zip(*columns)] for (number,), columns in self.pieces.iterator()}
        new = sorted(((r.ts, r.event_id, r.dst_port, r.dst_ip) for r in rows), key=lambda x: x[:2])
        flows = [(*x, False) for piece in held.values() for x in piece] + [(*x, True) for x in new]
        window, ports, ips, out = deque(), Counter(), Counter(), []
        for ts, i, port, ip, fresh in sorted(flows, key=lambda x: x[:2]):
            window.append((ts, port, ip))
            ports[port] += 1
            ips[ip] += 1
            while window[0][0] < ts - self.window_s:
                _, old_port, old_ip = window.popleft()
                for counts, value in ((ports, old_port), (ips, old_ip)):
                    counts[value] -= 1
                    if not counts[value]:
                        del counts[value]
            if fresh:  # null is no target
                out.append(Row(event_id=i, src_ip=key[0], ports=len(ports) - (None in ports), ips=len(ips) - (None in ips), attempts=len(window)))
        self._keep(held, new, timerValues.getCurrentWatermarkInMs())
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for number, ts in [(number, max(columns[0])) for (number,), columns in self.pieces.iterator()]:
            if self._end(ts) <= watermark:
                self.pieces.removeKey((number,))
        return iter(())

    def _end(self, ts: float) -> int:
        """From when on no flow can reach one at ``ts``."""
        return until(ts + self.window_s)

    def _keep(self, held: dict[int, list[tuple]], new: list[tuple], watermark: int) -> None:
        """Add the new flows and cut old pieces; each has a timer that removes it once no flow can reach it."""
        reached = lambda piece: [x for x in piece if self._end(x[0]) > watermark]
        last = max(held, default=0)
        number = last if len(held.get(last, [])) < PIECE else last + 1
        for old, piece in held.items():
            left = reached(piece)
            if old != number and left and 2 * len(left) < len(piece):
                self.pieces.updateValue((old,), tuple(map(list, zip(*left))))
        left = sorted(reached([*held.get(number, []), *new]), key=lambda x: x[:2])
        if left:
            self.pieces.updateValue((number,), tuple(map(list, zip(*left))))
            self.handle.registerTimer(self._end(left[-1][0]))

    def close(self) -> None:
        pass


def trailing_state(flows: DataFrame, window_s: float = 600.0, delay: str = "10 minutes") -> DataFrame:
    """Each flow with its source's distinct ports, addresses and attempts in the trailing window, itself included.

    Flows of a batch are taken in event-time order; one that comes out of order within
    ``delay`` is counted against what has come so far, a later one is dropped.
    """
    keyed_state(flows.sparkSession)
    timed = flows.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", delay)
    return timed.select("event_id", "src_ip", "ts", "dst_port", "dst_ip", "event_time").groupBy("src_ip").transformWithState(TrailingWindow(window_s), TRAILING, "append", "EventTime")


SCORED = "alert_id string, entity string, threat_class string, event_time double, recency double, risk_score long, alert_count long, incident_risk long, incident_start double"


class Engine(StatefulProcessor):
    """Cooldown, recency, fusion and the open incident of one entity."""

    def __init__(self, params: Params):
        self.params = params
        self.horizon_s = max(params.cooldown_s, params.recency_window_s, params.incident_gap_s)
        self.slot_s = params.recency_window_s / 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "threat_class string", "at double")
        self.past = handle.getMapState("past", "slot long", "times array<double>, ids array<string>")
        self.open = handle.getValueState("open", "first double, last double, count long")
        self.worst = handle.getMapState("worst", "threat_class string", "risk long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        p = self.params
        cool = {name: at for (name,), (at,) in self.kept.iterator()}
        past = {slot: (list(times), list(ids)) for (slot,), (times, ids) in self.past.iterator()}
        first, last, count = self.open.get() or (0.0, -math.inf, 0)
        worst = {name: risk for (name,), (risk,) in self.worst.iterator()}
        before = {"cool": dict(cool), "worst": dict(worst)}
        seen = {i for _, ids in past.values() for i in ids}
        times = sorted(t for own, _ in past.values() for t in own)
        touched, out = set(), []
        for r in sorted(rows, key=lambda r: (r.event_time, r.alert_id)):
            name, t = r.threat_class, r.event_time
            if r.alert_id in seen or (name in cool and t < cool[name] + p.cooldown_s):
                continue
            m = sum(2.0 ** (-(t - h) / p.recency_half_life_s) for h in times if t - p.recency_window_s <= h <= t)
            recency = min(1.0, max(0.0, 1 - math.exp(-m)))
            (w_p, w_a, w_s, w_r), prior = CLASS_PARAMS[name]
            risk = math.floor(100.0 * min(1.0, max(0.0, 0.0 + w_p * r.confidence + w_a * r.anomaly + w_s * prior + w_r * recency)) + 0.5)
            if t - last > p.incident_gap_s:
                worst, first, count = {}, t, 0
            count, last = count + 1, max(last, t)
            worst[name] = max(worst.get(name, 0), risk)
            survive = 1.0
            for c in CLASS_PARAMS:
                survive *= 1.0 - min(1.0, worst.get(c, 0) / 100.0)
            joint = min(100, math.floor(100.0 * (1.0 - survive) + 0.5))
            out.append(Row(alert_id=r.alert_id, entity=key[0], threat_class=name, event_time=t, recency=recency, risk_score=risk, alert_count=count, incident_risk=joint, incident_start=first))
            slot = math.floor(t / self.slot_s)
            own = past.setdefault(slot, ([], []))
            own[0].append(t)
            own[1].append(r.alert_id)
            touched.add(slot)
            times = [h for h in times if h >= t - p.recency_window_s] + [t]
            seen.add(r.alert_id)
            cool[name] = t
        if out:
            for name, at in cool.items():
                if before["cool"].get(name) != at:
                    self.kept.updateValue((name,), (at,))
            for name in before["worst"].keys() - worst.keys():
                self.worst.removeKey((name,))
            for name, risk in worst.items():
                if before["worst"].get(name) != risk:
                    self.worst.updateValue((name,), (risk,))
            edge = math.floor((min(last, timerValues.getCurrentWatermarkInMs() / 1000) - p.recency_window_s) / self.slot_s)
            for slot in past:
                if slot < edge:
                    self.past.removeKey((slot,))
                elif slot in touched:
                    self.past.updateValue((slot,), past[slot])
            self.open.update((first, last, count))
            rearm(self.handle, until(last + self.horizon_s), timerValues.getCurrentWatermarkInMs())
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if held is not None and until(held[1] + self.horizon_s) <= timerValues.getCurrentWatermarkInMs():
            for state in (self.kept, self.past, self.open, self.worst):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_engine(detections: DataFrame, params: Params = DEFAULTS, delay: str = "10 minutes") -> DataFrame:
    """The alert engine over a stream of identified detections, one keyed state per entity.

    Rows of a batch are taken in event-time order; cooldown, recency history and the open
    incident are carried from batch to batch.  A detection that arrives again is dropped
    for as long as the recency window remembers it.  A row that comes late across batches
    may join an incident that a batch run would have bridged; one later than ``delay`` is
    dropped.  An entity is forgotten once nothing of it can matter any more.
    """
    keyed_state(detections.sparkSession)
    timed = detections.withColumn("at", F.timestamp_micros((F.col("event_time") * 1e6).cast("long"))).withWatermark("at", delay)
    kept = timed.select("entity", "alert_id", "threat_class", "event_time", "confidence", "anomaly", "at")
    return kept.groupBy("entity").transformWithState(Engine(params), SCORED, "append", "EventTime")
