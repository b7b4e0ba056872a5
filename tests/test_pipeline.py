"""Ingest, alerts, store, streaming and retention, end to end."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrace.operators import alerts as A
from voltrace.operators import history as H
from voltrace.operators.ingest import explode_signals, identified, new_rows
from voltrace.plans.engine import Engine
from voltrace.rules import Rules
from voltrace.sources.schemas import ALERTS, LATEST_READINGS, PACKET, SIGNAL_READINGS, SIGNAL_ROLLUPS
from voltrace.sources.store import KEEP, Conflict, Store
from voltrace.streaming import pipeline as P
from voltrace.streaming.simulator import packets_of

NOW = datetime(2024, 6, 1, 12)
MIN = timedelta(minutes=1)


class Clock:
    now = NOW

    def __call__(self):
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), Clock(), buckets=1)


def packets(spark, *rows):
    """rows: (vehicle, minute, signals, device id)."""
    return spark.createDataFrame([(v, NOW + m * MIN, s, d) for v, m, s, d in rows], PACKET)


def test_dedupe(engine, spark):
    one = packets(spark, ("v1", -1, {"soc": 50.0}, "d1"))
    assert engine.ingest(one)["accepted"] == 1
    assert engine.ingest(one) == {"accepted": 0, "duplicates": 1, "clock_skew_future": 0, "empty_packet": 0}
    same = packets(spark, ("v1", -2, {"soc": 50.0, "speed": 1.0}, None), ("v1", -2, {"speed": 1.0, "soc": 50.0}, None))
    assert engine.ingest(same)["accepted"] == 1
    assert engine.ingest(packets(spark, ("v1", -2, {"soc": 51.0, "speed": 1.0}, None)))["accepted"] == 1
    assert engine.store.read("packets").count() == 3


def test_rejects(engine, spark):
    got = engine.ingest(packets(spark, ("v", 120, {"soc": 1.0}, "a"), ("v", 2, {"soc": 50.0}, "b"), ("v", -1, {}, "c"), ("v", 5, {"soc": 50.0}, "d")))
    assert got == {"accepted": 2, "duplicates": 0, "clock_skew_future": 1, "empty_packet": 1}
    assert engine.store.read("rejected_packets").count() == 2


def test_alert_life(engine, spark):
    def state():
        return [(r["alert_id"], r["severity"], r["resolved_at"] is not None) for r in engine.store.read("alerts").orderBy("opened_at").collect()]

    engine.store.publish(replace={"vehicles": spark.createDataFrame([("v", "r", "m")], "vehicle_id string, reg_no string, model string")})
    engine.ingest(packets(spark, ("v", -5, {"soc": 18.0}, None)))
    (first, severity, done), = state()
    assert (severity, done) == ("warning", False)
    engine.ingest(packets(spark, ("v", -4, {"soc": 8.0}, None)))
    assert state() == [(first, "critical", False)]
    engine.dismiss(first, "onIt")
    assert engine.active_count() == 0 and engine.dismissed_count() == 1
    engine.undo_dismiss(first)
    assert engine.active_count() == 1
    engine.dismiss(first, "onIt")
    engine.ingest(packets(spark, ("v", -3, {"soc": 90.0}, None)))
    assert state() == [(first, "critical", True)]
    engine.ingest(packets(spark, ("v", -2, {"soc": 9.0}, None)))
    assert len(state()) == 2 and engine.active_alerts().count() == 1
    engine.ingest(packets(spark, ("v", -60, {"soc": 99.0}, None)))  # late: changes nothing
    assert engine.active_count() == 1
    engine.clock.now = NOW + 30 * MIN
    engine.refresh_derived_state()
    assert engine.active_count() == 0 and len(state()) == 2  # hidden, not resolved
    engine.clock.now = NOW


def test_alert_boundaries(spark):
    latest = spark.createDataFrame([(f"v{i}", s, NOW - MIN, v) for i, (s, v) in enumerate([("soc", 20.0), ("soc", 19.999), ("soc", 10.0), ("soc", 9.999), ("battery_temp", 45.0), ("battery_temp", 45.001)])], LATEST_READINGS)
    got = {r["vehicle_id"]: (r["breached"], r["severity"]) for r in A.alert_conditions(latest, NOW).collect()}
    assert [got[f"v{i}"][0] for i in range(6)] == [False, True, True, True, False, True]
    assert [got[f"v{i}"][1] for i in (1, 2, 3, 5)] == ["warning", "warning", "critical", "critical"]
    assert A.step(spark.createDataFrame([], ALERTS), A.alert_conditions(latest.limit(0), NOW)).count() == 0


def test_split_batches_and_order_do_not_matter(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"v{rng.randint(0, 3)}", -rng.randint(0, 300), {"soc": round(rng.random() * 100, 2), "lat": 12.9716, "lon": 77.5946 + rng.random() / 50}, None) for _ in range(60)]
    seen = []
    for k, batches in enumerate(([rows], [rows[i::4] for i in range(4)], [rows[::-1][:40], rows[:40]])):
        engine = Engine(spark, str(tmp_path / f"s{k}"), Clock(), buckets=2)
        engine.create_geofence("Depot", 12.9716, 77.5946, 900, NOW - timedelta(days=1))
        for b in batches:
            engine.ingest(packets(spark, *b))
        t = engine.store.snapshot()
        seen.append([
            sorted(map(tuple, t["signal_readings"].drop("ingest_time").collect())),
            sorted((r["vehicle_id"], r["signal"], r["event_time"]) for r in t["latest_readings"].collect()),
            sorted((r["vehicle_id"], r["kind"], r["event_time"]) for r in t["geofence_events"].collect()),
            sorted((r["vehicle_id"], r["started_at"]) for r in t["trips"].collect()),
        ])
    assert seen[0] == seen[1] == seen[2]


def test_rollups(spark):
    log = spark.createDataFrame([("v", "soc", NOW + i * MIN, NOW, float(i), str(i)) for i in range(-30, 0)] + [("v", "lat", NOW - 9 * MIN, NOW, 1.0, "x")], SIGNAL_READINGS)
    whole = sorted(map(tuple, H.rollup(log, NOW).collect()))
    late = H.rollup(log.filter("CAST(value AS INT) % 2 = 0"), NOW)
    assert sorted(map(tuple, H.merge_rollups(H.rollup(log.filter("CAST(value AS INT) % 2 <> 0"), NOW), late).collect())) == whole
    assert len(whole) == 6 and sum(r[-1] for r in whole) == 30
    chart = H.signal_history(log, spark.createDataFrame([], SIGNAL_ROLLUPS), NOW, "v", window=timedelta(hours=1), max_points=6).collect()
    assert [r["value"] for r in chart] == [-21.0, -11.0, -1.0]
    assert [r["value"] for r in H.recent_readings(log, "v", limit=2).collect()] == [-1.0, -2.0]


def test_backfill_and_retention(engine):
    n, k, stages, changes = 20, 200, [], []
    stop = engine.subscribe(lambda: changes.append(1))
    report = engine.backfill(n, k, stages.append)
    assert (report.vehicles, report.rows) == (n, n * (k * 6 + k // 2 * 3))
    assert stages == list(report.seconds) == ["vehicles", "geofences", "signals", "positions", "latest"] and len(changes) == 5
    stop()
    assert engine.already_populated()
    counts = {r["status"]: r["n"] for r in engine.status_counts().collect()}
    assert sum(counts.values()) == n and counts["offline"] == n // 5
    engine.recompute_fleet()
    crossings = engine.store.read("geofence_events").count()
    assert crossings > 0 and engine.store.read("trips").count() > 0
    assert {r["name"]: r["vehicle_count"] for r in engine.geofences().collect()}["Bengaluru ORR"] == n
    before = engine.soc_history("v1", timedelta(days=8)).count()
    engine.rules = Rules(raw_retention=timedelta(hours=5))
    report = engine.compact()
    assert report["rows_dropped"] > 0 and report["rollup_rows"] > 0
    assert engine.store.read("signal_rollups").filter("signal IN ('lat', 'lon')").isEmpty()
    assert engine.soc_history("v1", timedelta(days=8)).count() == before
    engine.recompute_fleet()  # what was derived before the cut-off stays
    assert engine.store.read("geofence_events").count() >= crossings * 0.5
    assert engine.detail("v1")["register"].count() == 6
    assert engine.select_one("SELECT count(*) AS n FROM vehicles WHERE vehicle_id = :v", v="v1")["n"] == 1
    assert engine.select_one("SELECT count(*) AS n FROM vehicles WHERE vehicle_id = ? AND model <> ?", "v1", "none")["n"] == 1
    assert len(changes) == 5  # nobody listens any more
    engine.destroy()


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 3)
    row = spark.createDataFrame([("v", "r", "m")], "vehicle_id string, reg_no string, model string")
    assert store.publish(append={"vehicles": row}, batch=("b", 1))
    assert not store.publish(append={"vehicles": row}, batch=("b", 1))
    held = store.read("vehicles")
    store.publish(append={"vehicles": row})
    assert held.count() == 1 and store.read("vehicles").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        store.publish(append={"vehicles": row, "trips": row})
    assert store.read("vehicles").count() == 2
    store.publish(replace={"vehicles": row})
    store.vacuum()
    assert store.read("vehicles").count() == 1 and len(store._manifests()) == 1


def test_stream_equals_one_batch(spark, tmp_path):
    made = packets_of(spark.range(400).select(F.col("id").alias("value")), NOW - timedelta(hours=1)).coalesce(1)
    folder = str(tmp_path / "in")
    for i in range(3):
        made.filter(F.pmod(F.xxhash64("vehicle_id", "event_time"), F.lit(3)) == i).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(folder)
    a, b = Store(spark, str(tmp_path / "a"), 1), Store(spark, str(tmp_path / "b"), 1)
    told = []
    stop = P.on_progress(spark, lambda *what: told.append(what), "ingest")
    P.start(stream, a, str(tmp_path / "checkpoint"), lambda: NOW, once=True).awaitTermination()
    for _ in range(100):  # the listener is told from another thread
        if sum(rows for *_, rows in told) >= made.count():
            break
        time.sleep(0.1)
    assert {name for name, *_ in told} == {"ingest"} and sum(rows for *_, rows in told) == made.count() and [batch for _, batch, _ in told] == sorted(batch for _, batch, _ in told)
    stop()
    P.process_batch(b, made, NOW)
    for table in ("signal_readings", "latest_readings", "packets"):
        assert sorted(map(str, a.read(table).collect())) == sorted(map(str, b.read(table).collect()))
    P.start(stream, a, str(tmp_path / "checkpoint2"), lambda: NOW, name="again", once=True).awaitTermination()
    assert a.read("packets").count() == b.read("packets").count()


def test_packets_without_news(spark):
    batch = explode_signals(identified(packets(spark, ("v", -1, {"soc": 1.0}, "d"))), NOW)
    assert new_rows(batch, batch).count() == 0


def test_replay_of_alerts(spark):
    log = spark.createDataFrame([("v", "soc", NOW + i * MIN, NOW, v, str(i)) for i, v in enumerate([50.0, 15.0, 8.0, 60.0, 5.0])], SIGNAL_READINGS)
    got = [tuple(r) for r in A.replay(log).orderBy("opened_at").select("opened_at", "last_seen_at", "resolved_at").collect()]
    assert got == [(NOW + MIN, NOW + 2 * MIN, NOW + 3 * MIN), (NOW + 4 * MIN, NOW + 4 * MIN, None)]


def test_statements_for_effect(engine, spark):
    rows = spark.createDataFrame([("v1", "r1", "m"), ("v2", "r2", "m"), ("v3", "r3", "n")], "vehicle_id string, reg_no string, model string")
    engine.register_vehicles(rows)
    engine.register_vehicles(rows.selectExpr("vehicle_id", "'other' AS reg_no", "model").union(spark.createDataFrame([("v4", "r4", "n")])))
    assert [r["reg_no"] for r in engine.select("SELECT reg_no FROM vehicles ORDER BY vehicle_id")] == ["r1", "r2", "r3", "r4"]
    spark.range(1).createOrReplaceTempView("vehicles")  # a view of the user's own
    engine.update("vehicles", {"reg_no": "concat(reg_no, ', WHERE ')", "model": "'a, b'"}, "vehicle_id = ?", "v2")
    engine.delete("vehicles", "model = :m", m="n")
    engine.insert("vehicles", "SELECT 'v9', ?, 'm'", "r9")
    assert [tuple(r) for r in engine.select("SELECT * FROM vehicles ORDER BY vehicle_id")] == [("v1", "r1", "m"), ("v2", "r2, WHERE ", "a, b"), ("v9", "r9", "m")]
    with pytest.raises(ValueError, match="of the store"):
        engine.delete("users")
    assert spark.table("vehicles").columns == ["id"]
    latest = spark.createDataFrame([(f"v{k}", "soc", NOW, float(k)) for k in range(9)], LATEST_READINGS)
    engine.store.publish(replace={"latest_readings": latest})
    engine.delete("latest_readings", "value > ? OR vehicle_id = ?", 7.0, "v1")
    engine.update("latest_readings", {"value": "value + :more", "signal": "'x'"}, "vehicle_id = 'v3'", more=1.0)
    assert sorted((r["vehicle_id"], r["signal"], r["value"]) for r in engine.store.read("latest_readings").collect()) == [(f"v{k}", "x" if k == 3 else "soc", 4.0 if k == 3 else float(k)) for k in (0, 2, 3, 4, 5, 6, 7)]
    assert engine.meta("schema_version") == "3" and engine.meta("none") is None
    engine.set_meta("tour", "1")
    engine.set_meta("tour", "2")
    assert engine.meta("tour") == "2" and engine.store.read("meta").count() == 2


def test_fences_of_a_user_are_kept(engine):
    engine.create_geofence("Mine", 1.0, 2.0, 300)
    assert not engine.seed_fences()
    engine.backfill(3, 5)
    assert [r["name"] for r in engine.geofences().collect()] == ["Mine"]


def test_writers_wait_for_each_other(spark, tmp_path):
    import threading

    store = Store(spark, str(tmp_path / "s"), 2)
    stale = store.manifest()["number"]
    row = lambda k: spark.createDataFrame([(f"k{k}", "v")], "key string, value string")
    threads = [threading.Thread(target=lambda k=k: store.transact(lambda t: {"replace": {"meta": t["meta"].unionByName(row(k))}}, ["meta"])) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.read("meta").count() == 7  # no write is lost
    with pytest.raises(Conflict):
        store.publish(append={"meta": row(9)}, based_on=stale)
    assert store.read("meta").count() == 7


def test_a_claim_of_a_dead_writer_is_given_up(spark, tmp_path):
    import os

    store = Store(spark, str(tmp_path / "s"), 2)
    claim = tmp_path / "s" / "_manifest" / f".claim-{store.manifest()['number'] + 1:012d}"
    claim.write_text("")
    row = spark.createDataFrame([("k", "v")], "key string, value string")
    with pytest.raises(Conflict):  # it might be at work
        store.publish(append={"meta": row})
    os.utime(claim, (0, 0))
    store.transact(lambda t: {"append": {"meta": row}}, [])
    assert store.read("meta").count() == 2 and not claim.exists()


def test_nothing_is_done_for_a_batch_that_is_published(engine, spark, monkeypatch):
    batch = packets(spark, ("v1", -1, {"soc": 50.0}, "d1"))
    assert engine.ingest(batch, ("b", 3))["accepted"] == 1
    monkeypatch.setattr(P, "identified", None)  # not even looked at
    assert engine.ingest(batch, ("b", 3)) == engine.ingest(batch, ("b", 2)) == P.NOTHING


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=16)
    engine.create_geofence("Depot", 12.9716, 77.5946, 900, NOW - timedelta(days=9))
    at = lambda v, m, east: (v, m, {"lat": 12.9716, "lon": 77.5946 + east}, None)
    engine.ingest(packets(spark, *[at(f"v{i}", -3000, 0.0) for i in range(40)], *[at(f"v{i}", -50, 0.0) for i in range(40)]))
    before = {t: {p["path"]: p["buckets"] for p in parts if "buckets" in p} for t, parts in engine.store.manifest()["tables"].items()}
    engine.ingest(packets(spark, at("v1", -20, 0.1), at("v1", -10, 0.1)))
    (mine,) = engine.store.buckets_of(spark.createDataFrame([("v1",)], "vehicle_id string"))
    after = engine.store.manifest()["tables"]
    for table in P.TOUCHED:
        new = [p for p in after[table] if p["path"] not in before[table]]
        assert all(set(p["buckets"]) <= {mine} for p in new), table  # nothing else was written
        assert all(p["buckets"] == [b for b in before[table][p["path"]] if b != mine] for p in after[table] if p["path"] in before[table]), table
    assert [(r["vehicle_id"], r["kind"]) for r in engine.store.read("geofence_events").collect()] == [("v1", "exit")]
    plan = engine.store.read("signal_readings", buckets=[mine], since=NOW - timedelta(hours=2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {f.split("bucket=")[1].split("/")[0] for f in engine.store.read("signal_readings", buckets=[mine]).inputFiles()} == {str(mine)}


def test_late_readings_are_replayed_others_go_on(spark, tmp_path, monkeypatch):
    rng, made = random.Random(9), []
    for v in range(6):
        east = 0.0
        for m in range(-400, 0, 10):
            east = max(-0.02, min(0.02, east + rng.uniform(-0.012, 0.012)))
            made.append((f"v{v}", m, {"lat": 12.9716, "lon": 77.5946 + east}, None))
    late = [r for r in made if r[0] == "v3" and r[1] % 70 == 0]
    rest = [r for r in made if r not in late]
    one, many = (Engine(spark, str(tmp_path / k), Clock(), buckets=2) for k in ("one", "many"))
    for engine in (one, many):
        engine.create_geofence("Depot", 12.9716, 77.5946, 900, NOW - timedelta(days=1))
        engine.create_geofence("Gate", 12.9716, 77.6046, 500, NOW - timedelta(days=1))
    one.ingest(packets(spark, *made))
    for low, high in ((-400, -250), (-250, -90), (-90, 0)):
        many.ingest(packets(spark, *[r for r in rest if low <= r[1] < high]))
    many.ingest(packets(spark, *late))
    events = [sorted((r["vehicle_id"], names[r["geofence_id"]], r["kind"], r["event_time"], r["window_start"]) for r in e.store.read("geofence_events").collect()) for e in (one, many) for names in [{r["geofence_id"]: r["name"] for r in e.geofences().collect()}]]
    assert events[0] == events[1] and len(events[0]) > 20
    trips = [sorted((r["vehicle_id"], r["started_at"], r["ended_at"] or NOW) for r in e.store.read("trips").collect()) for e in (one, many)]
    assert trips[0] == trips[1]
    many.recompute_fleet()
    assert one.store.read("crossing_state").filter("geofence_id <> ''").count() > 0


def test_parts_are_merged_and_old_ones_removed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=2)
    for k in range(18):
        engine.store.publish(append={"signal_readings": spark.createDataFrame([(f"v{k}", "soc", NOW + k * MIN, NOW, float(k), f"p{k}")], SIGNAL_READINGS)})
    listed = engine.store.manifest()["tables"]["signal_readings"]
    assert engine.store.read("signal_readings").count() == 18
    assert sorted(p["level"] for p in listed) == [0, 0, 1, 1]
    assert len(engine.store._manifests()) <= 2 * KEEP
    engine.store.publish(forget={"signal_readings": NOW + 5 * MIN})
    assert engine.store.read("signal_readings").count() == 13 and len(engine.store.manifest()["tables"]["signal_readings"]) == 4
    assert engine.store.read("signal_readings", since=NOW + 9 * MIN, until=NOW + 12 * MIN).count() == 3


def test_a_small_batch_takes_few_tasks_whatever_the_partitions(spark, tmp_path):
    engine, session = Engine(spark, str(tmp_path / "store"), Clock(), buckets=1), spark.sparkContext
    rows = packets(spark, *[(f"v{k % 3}", -k, {"lat": 12.97, "lon": 77.59, "soc": 50.0}, f"d{k}") for k in range(12)])
    keys = ["vehicle_id", "event_time", "device_packet_id"]
    rows = rows.groupBy(*keys).agg(F.first("signals").alias("signals")).select(*rows.columns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.setJobGroup("small batch", "", False)
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    try:
        assert P.process_batch(engine.store, rows, NOW, ("b", 0))["accepted"] == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        session._jsc.clearJobGroup()
    seen = session.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("small batch") for s in seen.getJobInfo(j).stageIds]
    assert not [s for s in stages if s and s.numCompletedTasks >= 61]


def test_small_parts_have_few_files_however_many_buckets(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=256)
    store = engine.store
    rows = packets(spark, *[(f"v{k}", -1440 * d, {"lat": 12.97, "lon": 77.59}, f"d{k}.{d}") for k in range(300) for d in range(3)])
    assert P.process_batch(store, rows, NOW, ("b", 0))["accepted"] == 900
    for table in ("signal_readings", "packets", "crossing_days"):
        (part,) = store.manifest()["tables"][table]
        assert part["written"] <= 16 and len(list((tmp_path / "s" / table).rglob("part-*.parquet"))) <= 48
    some = store.buckets_of(rows.filter("vehicle_id IN ('v1', 'v7')"))
    found = {r[0] for r in store.read("signal_readings", buckets=some).select("vehicle_id").distinct().collect()}
    assert {"v1", "v7"} <= found and store.read("signal_readings", buckets=some).count() == 6 * len(found) < 200
    assert P.process_batch(store, rows, NOW, ("b", 1))["duplicates"] == 900


def test_statements_keep_what_shares_a_folder_with_the_changed_rows(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Clock(), buckets=2)
    rows = spark.createDataFrame([(f"v{k}", "soc", NOW, NOW, float(k), f"p{k}") for k in range(40)], SIGNAL_READINGS)
    engine.store.publish(append={"signal_readings": rows}, replace={"latest_readings": rows.select("vehicle_id", "signal", "event_time", "value")})
    assert P.grow(engine.store, per_bucket=2) == 32
    engine.delete("signal_readings", "vehicle_id = 'v3'")
    engine.update("signal_readings", {"value": "value + 100"}, "vehicle_id = 'v4'")
    left = {r["vehicle_id"]: r["value"] for r in engine.store.read("signal_readings").collect()}
    assert left == {f"v{k}": float(k) + 100 * (k == 4) for k in range(40) if k != 3}
