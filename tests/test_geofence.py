"""Crossings and trips: known scenarios, and random ones against plain folds."""

import random
from datetime import datetime, timedelta

import pytest

from voltrace.operators.geofence import all_versions, create_fence, crossings, crossings_of_sides, current_fences, edit_fences, geofence_list, set_active
from voltrace.operators.trips import trip_list, trips
from voltrace.rules import EARTH_RADIUS_M, Rules
from voltrace.sources.schemas import GEOFENCE_EVENTS, GEOFENCE_VERSIONS, GEOFENCES, LATEST_READINGS

T0 = datetime(2024, 6, 1)
MIN = timedelta(minutes=1)
LAT, LON = 12.9716, 77.5946
FIX = "vehicle_id string, event_time timestamp_ntz, ingest_time timestamp_ntz, packet_id string, lat double, lon double, accuracy_m double"


def east(metres):
    import math

    return LON + metres / (EARTH_RADIUS_M * math.pi / 180 * math.cos(math.radians(LAT)))


def fixes(spark, points):
    """points: (minute, metres east, accuracy)."""
    rows = [("v", T0 + m * MIN, T0, "p", LAT, east(x), None if a is None else float(a)) for m, x, a in points]
    return spark.createDataFrame(rows, FIX)


def fence(spark, *versions):
    """versions: (id, version, radius, active, from minute, to minute)."""
    rows = [(f, n, f, LAT, LON, float(r), on, T0 + a * MIN, None if b is None else T0 + b * MIN) for f, n, r, on, a, b in versions]
    return spark.createDataFrame(rows, GEOFENCE_VERSIONS)


ONE = [("f", 1, 200, True, -100, None)]
SCENARIOS = {
    "baseline": ([(0, 50, 5)], ONE, []),
    "departure": ([(0, 50, 5), (1, 60, 5), (2, 400, 5), (3, 900, 5)], ONE, [("exit", 2)]),
    "round trip": ([(0, 50, 5), (1, 500, 5), (2, 900, 5), (3, 900, 5), (4, 100, 5), (5, 40, 5)], ONE, [("exit", 1), ("entry", 4)]),
    "outlier": ([(0, 50, 5), (1, 50, 5), (2, 5000, 5), (3, 50, 5), (4, 50, 5)], ONE, []),
    "dating": ([(0, 50, 5), (5, 900, 5), (6, 950, 5)], ONE, [("exit", 5)]),
    "broken candidate": ([(0, 50, 5), (1, 900, 5), (2, 50, 5), (3, 900, 5)], ONE, []),
    "jitter": ([(0, 50, 5)] + [(i, 190 if i % 2 else 210, 5) for i in range(1, 41)], ONE, []),
    "junk accuracy": ([(0, 50, 5), (1, 5000, 400), (2, 5000, 400)], ONE, []),
    "wide accuracy, near": ([(0, 50, 60), (1, 240, 60), (2, 240, 60)], ONE, []),
    "wide accuracy, far": ([(0, 50, 60), (1, 300, 60), (2, 300, 60)], ONE, [("exit", 1)]),
    "no accuracy": ([(0, 50, None), (1, 230, None), (2, 230, None)], ONE, [("exit", 1)]),
    "late fix": ([(0, 50, 5), (2, 900, 5), (3, 50, 5), (4, 950, 5)], ONE, []),
    "widened": ([(1, 500, 5), (2, 500, 5), (6, 500, 5), (7, 500, 5)], [("f", 1, 200, True, -9, 5), ("f", 2, 1000, True, 5, None)], [("entry", 6)]),
    "deactivated": ([(0, 50, 5), (3, 900, 5), (4, 950, 5)], [("f", 1, 200, True, -9, 2), ("f", 2, 200, False, 2, None)], []),
}


@pytest.mark.parametrize("name", sorted(SCENARIOS))
def test_scenario(spark, name):
    points, versions, expected = SCENARIOS[name]
    got = crossings(fixes(spark, points), fence(spark, *versions)).orderBy("event_time").collect()
    assert [(r["kind"], (r["event_time"] - T0) // MIN) for r in got] == expected


def test_gap_makes_a_crossing_uncertain(spark):
    got = crossings(fixes(spark, [(0, 50, 5), (180, 9000, 5), (181, 9500, 5)]), fence(spark, *ONE)).collect()
    assert [(r["kind"], r["uncertain"], r["window_start"]) for r in got] == [("exit", True, T0)]


def test_nested_fences_both_cross(spark):
    versions = fence(spark, ("depot", 1, 200, True, -9, None), ("city", 1, 2000, True, -9, None))
    got = crossings(fixes(spark, [(0, 50, 5), (1, 900, 5), (2, 950, 5), (3, 5000, 5), (4, 5500, 5)]), versions).collect()
    assert sorted((r["geofence_id"], r["kind"]) for r in got) == [("city", "exit"), ("depot", "exit")]


def fold_crossings(sided, confirm=2, gap=30):
    out, inside, last, side, since, count = [], None, None, None, None, 0
    for t, s in sided:
        if inside is None:
            inside, last = s, t
        elif s == inside:
            last, side, count = t, None, 0
        else:
            if side == s:
                count += 1
            else:
                side, since, count = s, t, 1
            if count >= confirm:
                out.append((since, "entry" if s else "exit", last, since - last > gap))
                inside, last, side, count = s, t, None, 0
    return out


def fold_trips(rows):
    """rows: (minute, fence, kind)."""
    rows = sorted(rows, key=lambda r: (r[0], r[2] == "exit", r[1]))
    first, around = set(), set()
    for _, f, k in rows:
        if f not in first and k == "exit":
            around.add(f)
        first.add(f)
    out, start = [], None
    for t, f, k in rows:
        if k == "exit":
            if f in around:
                around.discard(f)
                if not around and start is None:
                    start = (f, t)
        else:
            away = not around
            around.add(f)
            if away and start:
                out.append((*start, f, t))
                start = None
    return out + ([(*start, None, None)] if start else [])


@pytest.mark.parametrize("confirm", [1, 2, 3])
def test_windows_equal_the_folds(spark, confirm):
    rng = random.Random(confirm)
    rows, cross, trip = [], [], []
    for v in range(60):
        mine = []
        for f in range(rng.randint(1, 4)):
            side, sided = rng.random() < 0.5, []
            for m in sorted(rng.sample(range(400), rng.randint(1, 60))):
                if rng.random() < 0.35:
                    side = not side
                sided.append((m, side))
            rows += [(f"v{v}", f"f{f}", T0 + m * MIN, s) for m, s in sided]
            found = fold_crossings(sided, confirm)
            cross += [(f"v{v}", f"f{f}", *c) for c in found]
            mine += [(t, f"f{f}", k) for t, k, *_ in found]
        trip += [(f"v{v}", *t) for t in fold_trips(mine)]
    df = spark.createDataFrame(rows, "vehicle_id string, geofence_id string, event_time timestamp_ntz, inside boolean")
    got = crossings_of_sides(df, Rules(confirmation_fixes=confirm)).cache()
    minute = lambda t: None if t is None else (t - T0) // MIN
    assert sorted((r["vehicle_id"], r["geofence_id"], minute(r["event_time"]), r["kind"], minute(r["window_start"]), r["uncertain"]) for r in got.collect()) == sorted(cross)
    made = sorted((r["vehicle_id"], r["origin_geofence_id"], minute(r["started_at"]), r["destination_geofence_id"] or "", minute(r["ended_at"]) or 0) for r in trips(got).collect())
    assert made == sorted((a, b, c, d or "", e or 0) for a, b, c, d, e in trip)


def events(spark, rows):
    return spark.createDataFrame([("v", f, k, T0 + m * MIN, None, u) for m, f, k, u in rows], GEOFENCE_EVENTS)


def test_trip_legs_and_names(spark):
    made = trips(events(spark, [(0, "A", "exit", False), (10, "B", "entry", False), (20, "B", "exit", True), (30, "C", "entry", False), (40, "C", "exit", False), (50, "A", "entry", True)]))
    versions = spark.createDataFrame([("A", 1, "old", 0.0, 0.0, 1.0, True, T0, T0), ("A", 2, "Alpha", 0.0, 0.0, 1.0, True, T0, None)], GEOFENCE_VERSIONS)
    got = trip_list(made, versions, "v").collect()
    assert [(r["origin_geofence_id"], r["destination_geofence_id"], r["start_uncertain"], r["end_uncertain"], r["duration_s"]) for r in got] == [("C", "A", False, True, 600), ("B", "C", True, False, 600), ("A", "B", False, False, 600)]
    assert got[0]["destination_name"] == "Alpha" and got[1]["destination_name"] is None


def test_nested_trip_and_handover(spark):
    made = trips(events(spark, [(0, "depot", "exit", False), (5, "city", "exit", False), (100, "city", "entry", False), (105, "depot", "entry", False)])).collect()
    assert [(r["origin_geofence_id"], r["destination_geofence_id"]) for r in made] == [("city", "city")]
    assert trips(events(spark, [(30, "A", "exit", False), (30, "B", "entry", False)])).count() == 0


def test_fence_edits(spark):
    fences, versions = create_fence(spark.createDataFrame([], GEOFENCES), spark.createDataFrame([], GEOFENCE_VERSIONS), "f", "Depot", LAT, LON, 200, T0)
    same = edit_fences(versions, spark.createDataFrame([("f", "Yard", None, None, None, None)], "geofence_id string, name string, lat double, lon double, radius_m double, active boolean"), T0)
    assert [(r["version"], r["name"], r["valid_to"]) for r in all_versions(same).collect()] == [(1, "Yard", None)]
    later = set_active(same, "f", False, T0 + MIN)
    assert [(r["version"], r["active"], r["valid_to"]) for r in all_versions(later).collect()] == [(1, True, T0 + MIN), (2, False, None)]
    latest = spark.createDataFrame([("v", "lat", T0, LAT), ("v", "lon", T0, LON), ("w", "lat", T0, LAT)], LATEST_READINGS)
    assert [r["vehicle_count"] for r in geofence_list(latest, current_fences(fences, same)).collect()] == [1]
    assert geofence_list(latest, current_fences(fences, later), include_inactive=False).count() == 0
