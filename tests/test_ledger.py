"""Packets are recognised however old they are, and only days that may hold them are read."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from voltrace.plans.engine import Engine
from voltrace.rules import Rules
from voltrace.sources import ledger as L
from voltrace.sources.schemas import PACKET
from voltrace.sources.store import Store

NOW = datetime(2024, 6, 8, 12)
HOUR = timedelta(hours=1)


def packets(spark, rows):
    """rows: (device id or null, hours before NOW, soc)."""
    return spark.createDataFrame([(f"v{h % 5}", NOW - h * HOUR, {"soc": float(x)}, d) for d, h, x in rows], PACKET)


def test_filters():
    rng = np.random.default_rng(1)
    for n in (1, 5, 3000):
        mine, other = rng.integers(-(1 << 63), 1 << 63, n), rng.integers(-(1 << 63), 1 << 63, 20_000)
        bits = L.made_of(mine)
        assert L.may_hold(bits, mine).all() and L.may_hold(bits, other).mean() < 0.05
        assert len(bits) <= max(8, n * L.BITS // 8 + 1)


def test_repeats_of_all_ages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MANY", 1)
    engine = Engine(spark, str(tmp_path / "s"), lambda: NOW, Rules(raw_retention=timedelta(days=5)), buckets=2)
    first = [(f"d{h}" if h % 2 else None, h, h % 90) for h in range(0, 150, 3)]
    assert engine.ingest(packets(spark, first))["accepted"] == 50
    opened = []
    read = Store.read

    def spy(self, table, **narrow):
        out = read(self, table, **narrow)
        if table == "packets":
            opened.append((narrow["days"], "PartitionFilters: [isnotnull(day" in out._jdf.queryExecution().executedPlan().toString() or "day#" in out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(Store, "read", spy)
    again = [first[1], first[-1], ("new", 2, 1), (None, 7, 1)]
    assert engine.ingest(packets(spark, again)) == {"accepted": 2, "duplicates": 2, "clock_skew_future": 0, "empty_packet": 0}
    asked = set(opened[0][0])
    assert {(NOW - h * HOUR).date() for h in (3, 147)} <= asked and len(asked) <= 4 and opened[0][1]
    late = [("d3", 60, 5)]  # an id of another day: the device says that it is the same packet
    assert engine.ingest(packets(spark, late))["duplicates"] == 1
    monkeypatch.setattr(Store, "read", read)
    engine.compact()
    held = engine.store.read("ledger_filters")
    assert held.groupBy("bucket", "day", "part").count().filter("count > 1").isEmpty()
    assert held.agg({"day": "min"}).first()[0] >= (NOW - timedelta(days=5)).date()
    kept = [r for r in first if r[1] <= 120]
    assert engine.ingest(packets(spark, kept)) == {"accepted": 0, "duplicates": len(kept), "clock_skew_future": 0, "empty_packet": 0}
    assert engine.store.read("packets").count() == len(kept) + 2


def test_buckets_follow_the_fleet(spark, tmp_path):
    """After growth a batch rewrites the buckets of its vehicles only, and what was written before is read as ever."""
    from voltrace.streaming import pipeline as P

    engine = Engine(spark, str(tmp_path / "s"), lambda: NOW, buckets=2)
    of = lambda v, h, x: (f"v{v}", NOW - h * HOUR, {"soc": float(x), "lat": 12.9, "lon": 77.5 + x / 1000}, None)
    batch = lambda rows: spark.createDataFrame(rows, PACKET)
    rows = [of(v, 30 - h, (v + h) % 90) for v in range(60) for h in (1, 2)]
    engine.ingest(batch(rows))
    tables = ("signal_readings", "latest_readings", "packets", "crossing_state", "crossing_days", "alerts")
    content = lambda: {t: sorted(map(repr, engine.store.read(t).collect())) for t in tables}
    before = content()
    assert P.grow(engine.store, 5) == 16 and engine.store.buckets == 16 and P.grow(engine.store, 5) == 16
    assert content() == before
    for b in (3, 12):
        some = {r["vehicle_id"] for r in engine.store.read("signal_readings", buckets=[b]).collect()}
        assert some == {r["vehicle_id"] for r in engine.store.read("latest_readings", buckets=[b]).collect()} and some
    parts = {p["path"]: p for p in engine.store.manifest()["tables"]["latest_readings"]}
    assert engine.ingest(batch([*rows[:4], of(7, 1, 3)]))["accepted"] == 1
    (mine,) = engine.store.buckets_of(spark.createDataFrame([("v7",)], "vehicle_id string"))
    new = [p for p in engine.store.manifest()["tables"]["latest_readings"] if p["path"] not in parts]
    assert [p["buckets"] for p in new] == [[mine]] and all(p["buckets"] == [b for b in parts[p["path"]]["buckets"] if b != mine] for p in engine.store.manifest()["tables"]["latest_readings"] if p["path"] in parts)
    assert engine.ingest(batch([of(7, 1, 3), of(7, 40, 5)])) == {"accepted": 1, "duplicates": 1, "clock_skew_future": 0, "empty_packet": 0}
    assert engine.store.read("signal_readings").count() == 3 * 122


def test_filters_are_made_without_a_python_group_each(spark):
    entries = spark.range(500).selectExpr("concat('p', id) AS packet_id", "timestamp_ntz'2024-01-01' + make_dt_interval(id % 5) AS event_time")
    found = L.filters(entries, 4)
    assert "InPandas" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan
    hashes = L._hashed(4, entries, F.to_date("event_time").alias("day")).toPandas().groupby(["bucket", "day"])["h"]
    assert {(r["bucket"], r["day"]): bytes(r["bits"]) for r in found.collect()} == {k: L.made_of(np.array(h)) for k, h in hashes}
    assert L.filters(entries.limit(0), 4).count() == 0
