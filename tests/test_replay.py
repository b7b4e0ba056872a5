"""Late packets and retention: states by day give what one batch over everything gives."""

import random
from datetime import datetime, timedelta

import pytest

from voltrace.plans.engine import Engine
from voltrace.rules import Rules
from voltrace.sources.schemas import GEOFENCE_VERSIONS, PACKET
from voltrace.sources.store import Store

NOW = datetime(2024, 6, 8, 12)
MIN = timedelta(minutes=1)


class Clock:
    now = NOW

    def __call__(self):
        return self.now


def packets(spark, rows):
    """rows: (vehicle, minutes before or after NOW, metres east of the first fence, accuracy)."""
    return spark.createDataFrame([(v, NOW + m * MIN, {"lat": 12.9716, "lon": 77.5946 + east / 108_500, "gps_accuracy_m": float(acc)}, None) for v, m, east, acc in rows], PACKET)


def fences(engine, valid_from=NOW - timedelta(days=400)):
    rows = [(name, 1, name, 12.9716, 77.5946 + east / 108_500, float(radius), True, valid_from, None) for name, east, radius in (("Depot", 0, 300), ("Gate", 900, 250), ("City", 0, 4000), ("Far", 60_000, 500))]
    versions = engine.spark.createDataFrame(rows, GEOFENCE_VERSIONS)
    engine.store.publish(replace={"geofences": versions.selectExpr("geofence_id", "valid_from AS created_at"), "geofence_versions": versions})


def found(engine):
    events = sorted((r["vehicle_id"], r["geofence_id"], r["kind"], r["event_time"], str(r["window_start"]), r["uncertain"]) for r in engine.store.read("geofence_events").collect())
    trips = sorted((r["vehicle_id"], r["origin_geofence_id"], r["started_at"], str(r["ended_at"]), r["status"]) for r in engine.store.read("trips").collect())
    return events, trips


def drive(rng, vehicles, days=6):
    rows = []
    for v in range(vehicles):
        east = rng.choice([0.0, 900.0, 59_000.0, 9_000.0])
        m = -days * 1440 + rng.randint(0, 2000)
        while m < 0:
            rows.append((f"v{v}", m, east, rng.choice([5, 8, 60, 300])))
            m += rng.choice([7, 20, 45, 400, 900])
            east = rng.choice([east, east + rng.uniform(-500, 500), rng.uniform(-5_000, 5_000), 60_000.0 + rng.uniform(-900, 900)])
    return rows


@pytest.mark.parametrize("seed", [1])
def test_any_order_gives_what_one_batch_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = drive(rng, 8)
    one, many = (Engine(spark, str(tmp_path / k), Clock(), buckets=2) for k in ("one", "many"))
    for engine in (one, many):
        fences(engine)
    one.ingest(packets(spark, rows))
    late = [r for r in rows if rng.random() < 0.15]
    rest = sorted((r for r in rows if r not in late), key=lambda r: r[1])
    cut = [0, len(rest) // 3, len(rest) * 2 // 3, len(rest)]
    batches = [rest[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    rng.shuffle(late)
    batches.insert(rng.randint(1, 3), late[: len(late) // 2])
    batches.append(late[len(late) // 2 :])
    for b in batches:
        many.ingest(packets(spark, b))
    want = found(one)
    assert found(many) == want and len(want[0]) > 20
    one.recompute_fleet()  # nobody is registered: nothing changes
    many.register_vehicles(spark.createDataFrame([(f"v{k}", "r", "m") for k in range(8)], "vehicle_id string, reg_no string, model string"))
    many.recompute_fleet()
    assert found(one) == found(many) == want
    more = [(f"v{k}", m, e, 5) for k in range(8) for m, e in ((-3, 10.0), (-2, 20.0), (-700, 910.0))]
    for engine in (one, many):
        engine.ingest(packets(spark, more))
    assert found(one) == found(many)


def test_an_exit_behind_the_cut_off_is_not_lost(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), Rules(raw_retention=timedelta(days=1)), buckets=2)
    fences(engine)
    cut = -1440  # minutes: one day before NOW
    inside, outside = 0.0, 6_000.0
    engine.ingest(packets(spark, [("v", cut - 60, 2_000.0, 5), ("v", cut - 50, 2_000.0, 5), ("v", cut - 40, inside, 5), ("v", cut - 30, inside, 5), ("v", cut + 20, outside, 5), ("v", cut + 30, outside, 5)]))
    before = found(engine)
    assert [e[2] for e in before[0] if e[1] == "Depot"] == ["entry", "exit"]
    engine.compact()
    assert engine.store.read("signal_readings").count() == 6 and found(engine) == before
    engine.ingest(packets(spark, [("v", cut + 25, outside, 5)]))  # late, behind the cut-off
    assert found(engine) == before
    engine.ingest(packets(spark, [("v", cut - 35, outside, 5)]))  # from before it: what was seen then is settled
    assert found(engine) == before
    engine.ingest(packets(spark, [("v", cut + 22, inside, 5), ("v", cut + 26, inside, 5)]))
    assert [(e[2], e[3]) for e in found(engine)[0] if e[1] == "Depot"] == [("entry", NOW + (cut - 40) * MIN)]  # no two fixes outside follow each other any more


@pytest.mark.parametrize("seed", [3])
def test_retention_between_batches_changes_nothing(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = sorted(drive(rng, 6), key=lambda r: r[1])
    engines = [Engine(spark, str(tmp_path / k), Clock(), Rules(raw_retention=timedelta(days=2)), buckets=2) for k in ("kept", "compacted")]
    for engine in engines:
        fences(engine)
    late = [r for r in rows if r[1] > -2 * 1440 and rng.random() < 0.2]  # later than any cut-off
    rest = [r for r in rows if r not in late]
    for part in ([r for r in rest if r[1] < -3000], [r for r in rest if r[1] >= -3000], late[::2], late[1::2]):
        for engine in engines:
            engine.ingest(packets(spark, part))
        engines[1].clock.now = NOW - (timedelta(days=1) if part[0][1] < -3000 else timedelta(0))
        engines[1].compact()
        engines[1].clock.now = NOW
    assert engines[1].store.read("signal_readings").count() < engines[0].store.read("signal_readings").count()
    assert found(engines[0]) == found(engines[1]) and len(found(engines[0])[0]) > 15
    engines[1].register_vehicles(spark.createDataFrame([(f"v{k}", "r", "m") for k in range(6)], "vehicle_id string, reg_no string, model string"))
    engines[1].recompute_fleet()
    assert found(engines[0]) == found(engines[1])


def test_a_late_packet_reads_only_the_days_behind_its_state(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=1)
    fences(engine)
    engine.ingest(packets(spark, [("v", m, 10.0 * (m % 7), 5) for m in range(-6 * 1440, 0, 240)]))
    opened = []
    read = Store.read

    def spy(self, table, **narrow):
        out = read(self, table, **narrow)
        if table == "signal_readings":
            opened.append(narrow["since"])
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(day" in plan
        return out

    monkeypatch.setattr(Store, "read", spy)
    engine.ingest(packets(spark, [("v", -300, 15.0, 5)]))
    assert opened == [datetime(2024, 6, 8)]
    engine.ingest(packets(spark, [("v", -3000, 15.0, 5)]))
    assert opened[1:] == [datetime(2024, 6, 6)]
    engine.ingest(packets(spark, [("v", -1, 15.0, 5), ("w", -1, 15.0, 5)]))  # in order, and a vehicle never seen before
    assert len(opened) == 2


def test_states_of_days(spark, tmp_path):
    """One state row per pair and day that is over, and what a replay has written counts in place of older rows."""
    from voltrace.operators.replay import SELF, valid_days

    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=2)
    fences(engine)
    rows = drive(random.Random(7), 5)
    for part in (sorted(rows, key=lambda r: r[1])[0::2], sorted(rows, key=lambda r: r[1])[1::2]):
        engine.ingest(packets(spark, part))
    days = valid_days(engine.store.read("crossing_days")).collect()
    keys = [(r["vehicle_id"], r["geofence_id"], r["as_of"]) for r in days]
    assert len(keys) == len(set(keys))
    seen = {(v, (NOW + m * MIN).date()) for v, m, _, _ in rows}
    last = {v: max(d for w, d in seen if w == v) for v, _ in seen}
    assert {(r["vehicle_id"], (r["as_of"] - MIN).date()) for r in days if r["geofence_id"] == SELF} == {(v, d) for v, d in seen if d < last[v]}


def test_a_first_fix_in_the_band_says_nothing(spark, tmp_path):
    """A vehicle's first fixes lie in the band around the edge; what comes next is its first side, in one batch or in many, in order or late."""
    rows = [("v", -4000, 310.0, 60), ("v", -2500, 305.0, 60), ("v", -2400, 10.0, 5), ("v", -2390, 12.0, 5), ("v", -900, 5_500.0, 5), ("v", -890, 5_500.0, 5), ("w", -3000, 300.0, 60), ("w", -100, 2_000.0, 5), ("w", -90, 0.0, 5), ("w", -80, 0.0, 5)]
    orders = [[rows], [[r] for r in sorted(rows, key=lambda r: r[1])][:3] + [rows[2:]], [rows[3:6] + rows[9:], rows[6:9], rows[:3]]]
    seen = []
    for k, batches in enumerate(orders):
        engine = Engine(spark, str(tmp_path / str(k)), Clock(), buckets=1)
        fences(engine)
        for b in batches:
            engine.ingest(packets(spark, b))
        seen.append(found(engine))
    assert seen[0] == seen[1] == seen[2]
    assert [(e[0], e[2]) for e in seen[0][0] if e[1] == "Depot"] == [("v", "exit"), ("w", "entry")]
