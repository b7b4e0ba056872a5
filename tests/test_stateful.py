"""Stateful streams, stopped and started again between batches, against the batch operators."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrace.operators import alerts as A
from voltrace.operators import current as C
from voltrace.operators import geofence as G
from voltrace.operators.replay import position_days
from voltrace.operators.trips import trips
from voltrace.sources import telemetry as E
from voltrace.sources.schemas import PACKET, SIGNAL_READINGS
from voltrace.streaming.stateful import alert_spells_stream, crossings_stream, into_folder, trips_of_news

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
T0 = datetime(2024, 1, 1)


def slices(rows, time_col, cuts, folder):
    """Rows of each time slice, written one after the other."""
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows.filter((F.col(time_col) >= F.lit(low)) & (F.col(time_col) < F.lit(high))).coalesce(2).write.mode("append").parquet(folder)
        yield


def same(a, b):
    columns = sorted(a.columns)
    x, y = (sorted(map(repr, d.select(columns).collect())) for d in (a, b))
    assert x == y
    return len(x)


def test_alert_spells(spark, tmp_path):
    log = E.telemetry_log(E.events(spark, SF))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in slices(log, "event_time", [T0, T0 + timedelta(days=9), T0 + timedelta(days=17), T0 + timedelta(days=40)], folder):
        stream = spark.readStream.schema(SIGNAL_READINGS).parquet(folder)
        into_folder(alert_spells_stream(stream, E.RULES), out, str(tmp_path / "checkpoint"))
    end = log.filter(F.col("signal").isin(*A.KINDS.values())).agg(F.max("event_time")).first()[0]
    whole = A.alert_spells(log, E.RULES)
    done = F.col("hidden_at") < F.lit(end)  # spells that the stream's time has left behind
    n = same(spark.read.parquet(out).filter(done).drop("batch"), whole.filter(done))
    assert n > 100 and {r["why"] for r in whole.select("why").distinct().collect()} == {"stale", "resolved"}
    instances = A.replay(log, E.RULES).select("vehicle_id", "kind", "opened_at")
    assert sorted(map(repr, whole.select("vehicle_id", "kind", "opened_at").distinct().collect())) == sorted(map(repr, instances.collect()))


def test_crossings_and_trips(spark, tmp_path):
    events = E.events(spark, SF)
    packets, (_, versions) = E.position_packets(events), E.telemetry_fences(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in slices(packets, "event_time", [T0, T0 + timedelta(days=6), T0 + timedelta(days=21), T0 + timedelta(days=40)], folder):
        into_folder(crossings_stream(spark.readStream.schema(PACKET).parquet(folder), versions, E.RULES), out, str(tmp_path / "checkpoint"))
    news = spark.read.parquet(out).drop("batch")
    whole = G.crossings(C.location_fixes(E.telemetry_positions(events)), versions, E.RULES)
    found = news.filter("what = 'crossing'").select(*whole.columns)
    assert same(found, whole) > 100
    assert same(trips_of_news(news), trips(whole)) > 20
    assert news.filter("what = 'late'").isEmpty()


def test_going_on_from_a_batch(spark, tmp_path):
    """The first half by the batch fold, whose state the stream starts from; a late fix is handed on."""
    events, middle = E.events(spark, SF), T0 + timedelta(days=14)
    versions = E.telemetry_fences(spark)[1]
    positions = E.telemetry_positions(events)
    old = positions.filter(F.col("event_time") < F.lit(middle))
    line = G.steps(G.sides(C.location_fixes(old), versions, E.RULES), E.RULES)
    state, before = G.state_of(line), G.confirmed(line, E.RULES)
    day = position_days(C.location_fixes(old, complete=False), E.RULES).groupBy("vehicle_id").agg(F.min("since").alias("since"), F.max("before").alias("before"), F.max("last_time").alias("last_time"))
    own = day.selectExpr("vehicle_id", "'' AS geofence_id", "CAST(NULL AS boolean) AS believed", "false AS inside", "since", "before", "last_time", "0 AS fixes")
    state = state.unionByName(own.select(*state.columns))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    packets = E.position_packets(events)
    packets.filter(F.col("event_time") >= F.lit(middle)).write.parquet(folder)
    packets.filter(F.col("event_time") < F.lit(middle)).limit(1).write.mode("append").parquet(folder)
    into_folder(crossings_stream(spark.readStream.schema(PACKET).parquet(folder), versions, E.RULES, state, before), out, str(tmp_path / "checkpoint"))
    news = spark.read.parquet(out).drop("batch")
    whole = G.crossings(C.location_fixes(positions), versions, E.RULES)
    same(news.filter("what = 'crossing'").select(*whole.columns).unionByName(before.select(*whole.columns)), whole)
    assert news.filter("what = 'late'").count() == 1
    # trips of the batch that the stream has taken back, and what it says instead
    first = trips(before).select("vehicle_id", F.col("origin_geofence_id").alias("geofence_id"), F.col("started_at").alias("event_time"), F.col("start_uncertain").alias("uncertain"), "destination_geofence_id", "ended_at", "end_uncertain", F.lit("trip").alias("what"))
    assert same(trips_of_news(news.select(*first.columns).unionByName(first)), trips(whole)) > 10


def test_two_alerts_that_hide_in_one_second(spark, tmp_path):
    """The moment is a timer of both kinds: that one of them is seen again takes it from neither."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    low, hot = ("soc", 5.0), ("battery_temp", 60.0)
    hour = timedelta(hours=1)
    for rows in ([("v", *low, T0), ("v", *hot, T0)], [("v", *low, T0 + hour)], [("w", *low, T0 + 100 * hour)], [("w", *low, T0 + 101 * hour)]):
        log = spark.createDataFrame([(v, s, t, t, x, f"{v}{s}{t}") for v, s, x, t in rows], "vehicle_id string, signal string, event_time timestamp_ntz, ingest_time timestamp_ntz, value double, packet_id string")
        log.select(*SIGNAL_READINGS.names).write.mode("append").parquet(folder)
        into_folder(alert_spells_stream(spark.readStream.schema(SIGNAL_READINGS).parquet(folder), E.RULES), out, str(tmp_path / "checkpoint"))
    found = spark.read.parquet(out).select("vehicle_id", "kind", "why", "hidden_at").collect()
    stale = E.RULES.stale_after + timedelta(seconds=1)
    assert sorted(map(tuple, found)) == [("v", "battery_soc", "stale", T0 + hour + stale), ("v", "battery_temp", "stale", T0 + stale)]


@pytest.mark.parametrize("processor", ["_Fold", "_Spells"])
def test_state_is_read_and_written_once_a_batch(processor, monkeypatch):
    """However many readings, fences and crossings a vehicle has."""
    from voltrace.streaming import stateful

    calls = []

    class Held:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                return self.value if name == "get" else None

            return call

    handle = type("Handle", (), {n: lambda self, *_: Held() for n in ("getValueState", "getMapState", "getListState")} | {n: lambda self, *_: calls.append(n) for n in ("registerTimer", "deleteTimer")})()
    us = 1_000_000
    if processor == "_Spells":
        made = stateful._Spells(E.RULES.stale_s)
        rows = [{"us": k * us, "kind": ("battery_soc", "battery_temp")[k % 2], "breached": k % 3 > 0} for k in range(40)]
    else:
        made = stateful._Fold(E.RULES)
        monkeypatch.setattr(made, "_news", lambda vehicle, found: iter(found))
        rows = [{"us": k * us, "lat": 0.0, "lon": 0.0, "gps_accuracy_m": 5.0, "near": None} for k in range(40)]
    made.init(handle)
    list(made.handleInputRows(("v",), iter(rows), None))
    assert sorted(c for c in calls if not c.endswith("Timer")) == ["get", "update"] and len(calls) <= 4
