"""Stateful operators of a stream: alert spells that end because time passes, and crossings and trips fold by fold.

Both keep their state per vehicle in Spark's state store (transformWithState; set spark.sql.streaming.stateStore.providerClass to
the RocksDB provider), so they go on after a restart. Readings of a vehicle are taken in the order of their time inside a batch. One that is
not newer than what the vehicle has had changes no alert; late fixes can't be folded any more and are handed on as rows of kind "late", for the
replay by day (operators.replay) to deal with.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from math import asin, cos, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import alert_readings
from ..operators.geofence import _cells_at, _cells_of
from ..rules import ACCURACY, EARTH_RADIUS_M, LAT, LON, Rules

_NONE = Rules()
_US = 1_000_000
SPELLS = "vehicle_id string, kind string, opened_at timestamp_ntz, shown_at timestamp_ntz, hidden_at timestamp_ntz, why string"


def _moment(us: int | None) -> datetime | None:
    return None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)


def _us(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


class _Spells(StatefulProcessor):
    """State of a vehicle, read and written once a batch; by kind: the newest reading, whether it is a breach, the alert's opening and since when it has been shown."""

    def __init__(self, stale_s: int):
        self.stale_s = stale_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getValueState("kinds", "kinds array<struct<kind string, last long, breached boolean, opened long, shown long>>")

    def _held(self) -> dict[str, tuple]:
        held = self.kinds.get()
        return {k: tuple(r) for k, *r in held[0]} if held else {}

    def _keep(self, kinds: dict[str, tuple]) -> None:
        self.kinds.update(([(k, *v) for k, v in kinds.items()],))

    def _timers(self, kinds: dict[str, tuple]) -> set[int]:
        """When shown alerts hide if nothing else comes; kinds may share a moment."""
        return {self._hides(last) // 1000 for last, breached, _, shown in kinds.values() if breached and shown is not None}

    def _hides(self, last: int) -> int:
        """When a reading stops being fresh; ages are whole seconds."""
        return (last // _US + self.stale_s + 1) * _US

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kinds = self._held()
        set_before = self._timers(kinds)
        for r in sorted(rows, key=lambda r: r["us"]):
            kind, t = r["kind"], r["us"]
            last, breached, opened, shown = kinds.get(kind, (None, False, None, None))
            if last is not None and t <= last:
                continue
            if breached and shown is not None:
                hides = self._hides(last)
                if t >= hides:
                    yield self._spell(key, kind, opened, shown, hides, "stale")
                    shown = None
                elif not r["breached"]:
                    yield self._spell(key, kind, opened, shown, t, "resolved")
            if r["breached"]:
                opened, shown = opened if breached else t, t if shown is None or not breached else shown
            else:
                opened = shown = None
            kinds[kind] = (t, r["breached"], opened, shown)
        wanted = self._timers(kinds)
        for moment in set_before - wanted:
            self.handle.deleteTimer(moment)
        for moment in wanted - set_before:
            self.handle.registerTimer(moment)
        self._keep(kinds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        kinds = self._held()
        for kind, (last, breached, opened, shown) in kinds.items():
            if breached and shown is not None and self._hides(last) == at:
                kinds[kind] = (last, breached, opened, None)
                yield self._spell(key, kind, opened, shown, at, "stale")
        self._keep(kinds)

    def _spell(self, key, kind, opened: int, shown: int, hidden: int, why: str) -> Row:
        return Row(vehicle_id=key[0], kind=kind, opened_at=_moment(opened), shown_at=_moment(shown), hidden_at=_moment(hidden), why=why)

    def close(self) -> None:
        pass


def alert_spells_stream(log: DataFrame, rules: Rules = _NONE, delay: str = "0 seconds") -> DataFrame:
    """Spells (as alerts.alert_spells) of a streaming log. A spell comes out when it ends: with a reading that clears the alert, or when the stream's time has left the last breach behind."""
    rows = alert_readings(log, rules).withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", delay)
    rows = rows.select("vehicle_id", "kind", "breached", "at", _us(F.col("event_time")).alias("us"))
    return rows.groupBy("vehicle_id").transformWithState(_Spells(rules.stale_s), SPELLS, "Append", "EventTime")


FOUND = "what string, vehicle_id string, geofence_id string, kind string, event_time timestamp_ntz, window_start timestamp_ntz, uncertain boolean, destination_geofence_id string, ended_at timestamp_ntz, end_uncertain boolean"


@lru_cache(256)
def _spans_of(text: str) -> list[tuple[float, ...]]:
    """Versions of a fence, each as numbers: from, until (microseconds), latitude, longitude, radius, active. Rows and state hold them as JSON text, which is parsed once for many rows."""
    return [tuple(map(float, s)) for s in json.loads(text)]


@lru_cache(256)
def _near_of(text: str) -> dict[str, str]:
    return {n["geofence_id"]: n["spans"] for n in json.loads(text)}


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2.0 * EARTH_RADIUS_M * asin(sqrt(a))


def _trips(crossings: list[tuple]) -> list[tuple]:
    """Trips of one vehicle's crossings (time, kind, fence, uncertain); see operators.trips."""
    order = sorted(crossings, key=lambda c: (c[0], c[1] == "exit", c[2]))
    first: dict[str, str] = {}
    for _, kind, fence, _ in order:
        first.setdefault(fence, kind)
    around, out = sum(kind == "exit" for kind in first.values()), []
    for k, (t, kind, fence, unsure) in enumerate(order):
        around += 1 if kind == "entry" else -1
        if kind == "exit" and around == 0:
            then = order[k + 1] if k + 1 < len(order) else (None, None, None, False)
            out.append((fence, t, unsure, then[2], then[0], then[3]))
    return out


class _Fold(StatefulProcessor):
    """State of a vehicle: its first and last trusted fix and an entry per fence that it has been near (as CROSSING_STATE), read and written once a batch; and its crossings, a batch's appended at once."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = "fence string, believed boolean, inside boolean, since long, before long, last long, fixes int, spans string"
        self.own = handle.getValueState("own", f"first long, last long, seen long, pairs array<struct<{pair}>>")
        self.crossings = handle.getListState("crossings", "t long, kind string, fence string, uncertain boolean")

    def _held(self) -> tuple[int | None, int | None, int | None, dict[str, tuple]]:
        first, last, seen, pairs = self.own.get() or (None, None, None, [])
        return first, last, seen, {fence: tuple(state) for fence, *state in pairs}

    def _keep(self, first: int | None, last: int | None, seen: int | None, known: dict[str, tuple]) -> None:
        self.own.update((first, last, seen, [(fence, *state) for fence, state in known.items()]))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState
        if r["what"] == "own":
            self._keep(r["since"], r["before"], r["last"], self._held()[3])
        elif r["what"] == "state":
            first, last, seen, known = self._held()
            self._keep(first, last, seen, known | {r["fence"]: (r["believed"], r["inside"], r["since"], r["before"], r["last"], r["fixes"], r["spans"])})
        else:
            self.crossings.appendValue((r["since"], r["kind"], r["fence"], r["uncertain"]))

    def _outside_before(self, spans: str, first: int | None, last: int | None) -> tuple | None:
        """What is known of a fence that was never near: outside, if a fix fell into a time when it was active."""
        moments = []
        for s in _spans_of(spans):
            if first is not None and s[5] and first < s[1] and last >= s[0]:
                moments += [last] if last < s[1] else [first] if first >= s[0] else []
        return (False, False, max(moments), None, max(moments), 1, spans) if moments else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fixes: dict[int, list] = {}
        for r in rows:  # a row for each grid of fences: parts of one instant belong together
            f = fixes.setdefault(r["us"], [None, None, None, {}])
            for k, name in enumerate((LAT, LON, ACCURACY)):
                if r[name] is not None and (f[k] is None or r[name] > f[k]):
                    f[k] = r[name]
            if r["near"] is not None:
                f[3].update(_near_of(r["near"]))
        (first, last, seen, known), found = self._held(), []
        for t in sorted(fixes):
            lat, lon, accuracy, near = fixes[t]
            if seen is not None and t <= seen:
                yield Row(what="late", vehicle_id=key[0], geofence_id=None, kind=None, event_time=_moment(t), window_start=None, uncertain=None, destination_geofence_id=None, ended_at=None, end_uncertain=None)
                continue
            seen = t
            if lat is None or lon is None or (accuracy is not None and accuracy > self.rules.max_accuracy_m):
                continue
            for fence in {*near, *known}:
                state = known.get(fence) or self._outside_before(near[fence], first, last) or (None, False, t, None, t, 0, near[fence])
                spans = near[fence] if fence in near else state[6]
                span = next((s for s in reversed(_spans_of(spans)) if s[0] <= t < s[1]), None)
                if span is None or not span[5]:
                    known[fence] = state
                    continue
                side = False
                if fence in near:
                    d, margin = _metres(lat, lon, span[2], span[3]), max(self.rules.min_margin_m, accuracy or 0.0)
                    side = True if d <= span[4] - margin else False if d >= span[4] + margin else None
                if side is None:
                    known[fence] = state
                    continue
                known[fence], crossing = self._advanced(state, t, side, spans)
                if crossing:
                    found.append((fence, *crossing))
            first, last = t if first is None else first, t
        self._keep(first, last, seen, known)
        if found:
            yield from self._news(key[0], found)

    def _advanced(self, state: tuple, t: int, side: bool, spans: str) -> tuple[tuple, tuple | None]:
        if not state[5]:
            return (side, side, t, None, t, 1, spans), None  # the first side is believed at once
        believed, inside, since, before, last, fixes, _ = state
        if side == inside:
            fixes = min(fixes + 1, self.rules.confirmation_fixes)
        else:
            inside, since, before, fixes = side, t, last, 1
        crossing = None
        if believed != inside and fixes >= self.rules.confirmation_fixes:
            gap = self.rules.max_certain_gap // timedelta(microseconds=1)
            believed, crossing = inside, ("entry" if inside else "exit", since, before, before is not None and since - before > gap)
        return (believed, inside, since, before, t, fixes, spans), crossing

    def _news(self, vehicle: str, found: list[tuple]) -> Iterator[Row]:
        old = [tuple(c) for c in self.crossings.get()]
        self.crossings.appendList([(since, kind, fence, unsure) for fence, kind, since, _, unsure in found])
        for fence, kind, since, before, unsure in found:
            yield Row(what="crossing", vehicle_id=vehicle, geofence_id=fence, kind=kind, event_time=_moment(since), window_start=_moment(before), uncertain=unsure, destination_geofence_id=None, ended_at=None, end_uncertain=None)
        was, now = (set(_trips(c)) for c in (old, old + [(since, kind, fence, unsure) for fence, kind, since, _, unsure in found]))
        for what, some in (("trip gone", was - now), ("trip", now - was)):
            for fence, t, unsure, to, ended, end_unsure in sorted(some, key=lambda x: (x[1], x[0])):
                yield Row(what=what, vehicle_id=vehicle, geofence_id=fence, kind=None, event_time=_moment(t), window_start=None, uncertain=unsure, destination_geofence_id=to, ended_at=_moment(ended), end_uncertain=end_unsure)

    def close(self) -> None:
        pass


def _spans(versions: DataFrame) -> DataFrame:
    until = F.coalesce(_us(F.col("valid_to")).cast("double"), F.lit(float("inf")))
    one = F.array(_us(F.col("valid_from")).cast("double"), until, "lat", "lon", "radius_m", F.col("active").cast("double"))
    return versions.groupBy("geofence_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("spans"))  # the versions of a fence


def crossings_stream(packets: DataFrame, versions: DataFrame, rules: Rules = _NONE, state: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """News of a stream of packets (schema PACKET): crossings as they are confirmed, trips as they begin and change ("trip gone" takes an earlier row back), and late fixes.

    versions: the fences as they are when the query starts. state, events: crossing_state and geofence_events of a batch fold to go on from. Latitude and longitude of a fix come in one packet.
    """
    spans = _spans(versions)
    cell = ["grid", "cell_lat", "cell_lon"]
    cells = _cells_of(versions, max(rules.min_margin_m, rules.max_accuracy_m))
    near = cells.select("geofence_id", *cell).distinct().join(spans, "geofence_id").groupBy(*cell).agg(F.to_json(F.sort_array(F.collect_list(F.struct("geofence_id", "spans")))).alias("near"))
    rows = packets.select("vehicle_id", "event_time", *[F.col("signals")[s].alias(s) for s in (LAT, LON, ACCURACY)]).filter(f"{LAT} IS NOT NULL OR {LON} IS NOT NULL OR {ACCURACY} IS NOT NULL")
    rows = _cells_at(rows, cells, LAT, LON).join(near, cell, "left").select("vehicle_id", _us(F.col("event_time")).alias("us"), LAT, LON, ACCURACY, "near")
    start = None
    if state is not None:
        none = {n: F.lit(None).cast(t) for n, t in (("kind", "string"), ("uncertain", "boolean"))}
        held = state.join(spans, "geofence_id", "left")
        what = F.when(F.col("geofence_id") == "", "own").otherwise("state")
        start = held.select("vehicle_id", what.alias("what"), F.col("geofence_id").alias("fence"), "believed", "inside", _us(F.col("since")).alias("since"), _us(F.col("before")).alias("before"), _us(F.col("last_time")).alias("last"), "fixes", "spans", *[v.alias(n) for n, v in none.items()])
        if events is not None:
            given = {"what": F.lit("crossing"), "fence": F.col("geofence_id"), "since": _us(F.col("event_time")), "kind": F.col("kind"), "uncertain": F.col("uncertain")}
            start = start.unionByName(events.select("vehicle_id", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in start.schema if f.name != "vehicle_id"]))
        start = start.groupBy("vehicle_id")
    return rows.groupBy("vehicle_id").transformWithState(_Fold(rules), FOUND, "Update", "None", start)


def into_folder(news: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stateful query over all that is there now and write what each batch says to a folder of its own (a batch that is done again replaces it)."""
    spark = news.sparkSession
    key, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        each = lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
        news.writeStream.foreachBatch(each).outputMode("update" if "what" in news.columns else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def trips_of_news(news: DataFrame) -> DataFrame:
    """The trips that stand after all news of crossings_stream, with the columns of trips.trips."""
    key = ["vehicle_id", "geofence_id", "event_time", "uncertain", "destination_geofence_id", "ended_at", "end_uncertain"]
    left = news.filter("what IN ('trip', 'trip gone')").groupBy(*key).agg(F.sum(F.when(F.col("what") == "trip", 1).otherwise(-1)).alias("n")).filter("n > 0")
    return left.select(
        F.md5(F.concat("vehicle_id", "geofence_id", F.col("event_time").cast("string"))).alias("trip_id"),
        "vehicle_id",
        F.col("geofence_id").alias("origin_geofence_id"),
        F.col("event_time").alias("started_at"),
        "destination_geofence_id",
        "ended_at",
        F.when(F.col("ended_at").isNull(), "in_progress").otherwise("completed").alias("status"),
        F.col("uncertain").alias("start_uncertain"),
        "end_uncertain",
        F.lit(None).cast("double").alias("distance_km"),
    )
