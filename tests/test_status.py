from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrace.functions.exprs import age_seconds, at, bucket, contains_text
from voltrace.operators import status as S
from voltrace.operators.current import guarded_upsert, last_positions, latest_per_vehicle, location_fixes
from voltrace.rules import Rules
from voltrace.sources.schemas import ALERTS, LATEST_READINGS, SIGNAL_READINGS

NOW = datetime(2024, 6, 1, 12)
MIN = timedelta(minutes=1)

CASES = [
    ("never", None, None, None, "offline"),
    ("quiet 11 min", 11, (30.0, 11), None, "offline"),
    ("moving 9 min", 9, (30.0, 9), None, "moving"),
    ("idle", 1, (0.0, 1), (1.0, 1), "idle"),
    ("engine off", 1, (0.0, 1), (0.0, 1), "stopped"),
    ("stale speed", 1, (50.0, 15), (1.0, 1), "stopped"),
    ("stale ignition", 1, (0.0, 1), (1.0, 15), "stopped"),
    ("no speed", 1, None, (1.0, 1), "stopped"),
    ("exactly ten", 10, (5.0, 10), None, "moving"),
    ("clock ahead", -2, (5.0, -2), None, "moving"),
]


@pytest.fixture(scope="module")
def fleet(spark):
    latest = []
    for name, ping, speed, ignition, _ in CASES:
        for signal, value in (("soc", (50.0, ping) if ping is not None else None), ("speed", speed), ("ignition", ignition)):
            if value:
                latest.append((name, signal, NOW - value[1] * MIN, value[0]))
    latest = spark.createDataFrame(latest, LATEST_READINGS)
    vehicles = spark.createDataFrame([(c[0], f"KA-{i}", "eTruck 19T" if i % 2 else "eVan") for i, c in enumerate(CASES)], "vehicle_id string, reg_no string, model string")
    alerts = spark.createDataFrame([], ALERTS)
    return S.fleet_rows(vehicles, latest, alerts, NOW)


def test_ladder(fleet):
    got = {r["vehicle_id"]: r["status"] for r in fleet.collect()}
    assert got == {c[0]: c[-1] for c in CASES}


def test_counts_equal_the_lists(fleet):
    for query in (None, "etruck", " EVAN ", "nothing"):
        counts = {r["status"]: r["n"] for r in S.status_counts(fleet, query).collect()}
        assert set(counts) == {"moving", "idle", "stopped", "offline"}
        for s, n in counts.items():
            assert S.fleet_list(fleet, s, query).count() == n


def test_age_counts_second_boundaries(spark):
    row = spark.range(1).select(age_seconds(at(datetime(2024, 1, 1, 0, 0, 0, 900_000)), datetime(2024, 1, 1, 0, 10, 1, 100_000)).alias("a"), age_seconds(at(NOW + MIN), NOW).alias("b"), age_seconds(F.lit(None).cast("timestamp_ntz"), NOW).alias("c")).first()
    assert tuple(row) == (601, 0, None)


@pytest.mark.parametrize("width", [300, 360, 420, 2520, 10080, 14400])
def test_bucket_origin(spark, width):
    import duckdb

    expected = duckdb.sql(f"SELECT time_bucket(INTERVAL {width} SECOND, TIMESTAMP '2024-06-01 12:00:00')").fetchall()[0][0]
    assert spark.range(1).select(bucket(at(NOW), width).alias("b")).first()["b"] == expected


def test_search_keeps_backslashes(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",)], "x string")
    assert [r["x"] for r in df.filter(contains_text("A\\B", F.col("x"))).collect()] == ["a\\b"]


def test_upsert_never_goes_back(spark):
    current = spark.createDataFrame([("v", "soc", NOW, 50.0)], LATEST_READINGS)

    def after(minutes, value):
        batch = spark.createDataFrame([("v", "soc", NOW + minutes * MIN, NOW, value, "p")], SIGNAL_READINGS)
        return guarded_upsert(current, batch).first()["value"]

    assert (after(-5, 1.0), after(0, 2.0), after(5, 3.0)) == (50.0, 50.0, 3.0)


def test_register_is_complete(spark):
    vehicles = spark.createDataFrame([("v", "r", "m")], "vehicle_id string, reg_no string, model string")
    latest = spark.createDataFrame([("v", "soc", NOW - MIN, 19.9), ("v", "battery_temp", NOW - MIN, 45.0), ("v", "speed", NOW - 11 * MIN, 1.0)], LATEST_READINGS)
    got = {r["signal"]: r["verdict"] for r in S.readings_register(vehicles, latest, NOW).collect()}
    assert got == {"soc": "alert", "battery_temp": "normal", "speed": "stale", "range_km": "missing", "odometer": "missing", "ignition": "missing"}


def test_fix_ties(spark):
    rows = []
    for packet, arrived, lat, lon in (("p1", 1, 1.0, 9.0), ("p2", 2, 2.0, 8.0)):
        rows += [("v", "lat", NOW, NOW + arrived * MIN, lat, packet), ("v", "lon", NOW, NOW + arrived * MIN, lon, packet)]
    rows.append(("v", "lat", NOW + MIN, NOW, 5.0, "p3"))
    log = spark.createDataFrame(rows, SIGNAL_READINGS)
    assert [(r["lat"], r["lon"]) for r in location_fixes(log).collect()] == [(2.0, 9.0)]
    assert [(r["lat"], r["lon"]) for r in location_fixes(log, "first_received").collect()] == [(1.0, 9.0)]


def test_empty_tables(spark):
    latest = spark.createDataFrame([], LATEST_READINGS)
    assert latest_per_vehicle(latest).count() == 0
    assert last_positions(latest).count() == 0
    vehicles = spark.createDataFrame([], "vehicle_id string, reg_no string, model string")
    assert S.fleet_rows(vehicles, latest, spark.createDataFrame([], ALERTS), NOW, Rules()).count() == 0
