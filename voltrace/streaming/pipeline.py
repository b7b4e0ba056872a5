"""Micro-batches: log, current state, alerts and derived rows, published together.

State lives in the snapshot store, not in operator state, so packets are recognised
however late they come, and nothing is dropped by a watermark. A batch that is
retried is recognised by its id and published once.

A batch reads and rewrites the buckets of the vehicles that it touches. Crossings of a vehicle whose positions are all
newer than what it had go on from its state; a vehicle with late positions is replayed from the last day before them (operators.replay).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.exprs import at
from ..operators import alerts as A
from ..operators import history
from ..operators.current import guarded_upsert
from ..operators.ingest import explode_signals, identified, ledger_rows, new_rows, reject_reason, rejected_rows, touched
from ..operators.replay import SELF, at_cutoff, derive, from_base, started, valid_days
from ..rules import POSITION, Rules
from ..sources.ledger import filters, known, tidied
from ..sources.store import PATIENCE_S, Conflict, Store

_NONE = Rules()
#: Packets of a batch up to which their ids are sent to the ledger; beyond, both sides are shuffled.
MOST_BROADCAST = 100_000
#: Vehicles of a bucket, beyond which retention makes more buckets.
PER_BUCKET = 64
TOUCHED = ("latest_readings", "alerts", "geofence_events", "crossing_state", "trips")
NOTHING = {"accepted": 0, "duplicates": 0, "clock_skew_future": 0, "empty_packet": 0}


class Kept:
    """Frames that several results are made of, written beside the store and read again. They go when the publish is done.

    What is read again has a short plan and comes in as many parts as its bytes need; a persisted frame would keep every partition of the shuffle that it came out of,
    so each step that is made of it would run a task for every one, however little it holds.
    """

    def __init__(self, store: Store):
        self.store, self.paths = store, []

    def cut(self, df: DataFrame) -> DataFrame:
        path, made = self.store.work(df)
        self.paths.append(path)
        return made

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.store.drop_work(path)


def process_batch(store: Store, packets: DataFrame, now: datetime, batch: tuple[str, int] | None = None, rules: Rules = _NONE) -> dict[str, int]:
    """Ingest one batch of packets (schema PACKET) and publish everything that follows from it; returns the accounting. Made again if another writer publishes meanwhile."""
    until = time.monotonic() + PATIENCE_S
    while True:
        try:
            return _process(store, packets, now, batch, rules)
        except Conflict:
            if time.monotonic() > until:
                raise


def _process(store: Store, packets: DataFrame, now: datetime, batch: tuple[str, int] | None, rules: Rules) -> dict[str, int]:
    manifest = store.manifest()
    if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
        return dict(NOTHING)  # published already
    based_on, cutoff = manifest["number"], store.forgotten("signal_readings", manifest)
    with Kept(store) as keep:
        judged = keep.cut(identified(packets).withColumn("reason", reject_reason(now, rules)))
        counts = judged.agg(
            F.count_if(F.col("reason").isNull()).alias("offered"),
            *[F.count_if(F.col("reason") == r).alias(r) for r in ("clock_skew_future", "empty_packet")],
        ).first().asDict()
        accepted, rejected = judged.filter("reason IS NULL").drop("reason"), rejected_rows(judged, now)
        # the ids of a batch of usual size are sent to the days of the ledger that may hold them
        ledger = known(store, keep.cut(accepted.select("packet_id").distinct())) if counts["offered"] <= MOST_BROADCAST else store.read("packets").select("packet_id")
        fresh = keep.cut(new_rows(explode_signals(accepted, now), ledger))
        entries = keep.cut(ledger_rows(fresh))
        new = entries.count()
        counts = {"accepted": new, "duplicates": counts.pop("offered") - new} | counts
        if not new:
            store.publish(append={"rejected_packets": rejected}, batch=batch, based_on=based_on)
            return counts
        keys = keep.cut(touched(fresh))
        buckets = store.buckets_of(keys)
        t = store.snapshot(["geofence_versions", "crossing_days", *TOUCHED], buckets=buckets)
        latest = keep.cut(guarded_upsert(t["latest_readings"], fresh))
        alerts = A.step(t["alerts"], A.alert_conditions(latest, now, rules, keys))

        positions = fresh.filter(F.col("signal").isin(*POSITION))
        t["crossing_days"] = keep.cut(valid_days(t["crossing_days"]))
        seen = t["latest_readings"].select("vehicle_id", F.lit(True).alias("seen")).distinct()
        marked = keep.cut(started(touched(positions), t["crossing_state"], t["crossing_days"], cutoff).join(seen, "vehicle_id", "left"))
        late = marked.filter("late")
        # only vehicles that were there before have older readings, and only those from their base on are needed
        need = marked.filter("late AND seen").agg(F.count("*").alias("n"), F.min("base").alias("since"), F.count_if(F.col("base").isNull()).alias("whole")).first()
        rows = positions.join(marked.filter("NOT late").select("vehicle_id"), "vehicle_id", "left_semi").unionByName(from_base(positions, late))
        if need["n"]:
            log = store.read("signal_readings", buckets=store.buckets_of(marked.filter("late AND seen")), since=None if need["whole"] else need["since"])
            rows = rows.unionByName(from_base(log.filter(F.col("signal").isin(*POSITION)), late))
        made = derive(rows, marked, t, rules, cutoff, based_on + 1, keep)
        made["crossing_days"] = keep.cut(made["crossing_days"])  # its size tells into how many buckets it is split
        store.publish(
            append={"signal_readings": fresh, "packets": entries, "ledger_filters": filters(entries, store.buckets), "rejected_packets": rejected, "crossing_days": made.pop("crossing_days")},
            replace={"latest_readings": latest, "alerts": alerts} | made,
            within=dict.fromkeys(TOUCHED, buckets),
            batch=batch,
            based_on=based_on,
        )
        return counts


def refresh(store: Store, now: datetime, rules: Rules = _NONE) -> None:
    """Judge all alert conditions again because time has passed."""
    store.transact(lambda t: {"replace": {"alerts": A.step(t["alerts"], A.alert_conditions(t["latest_readings"], now, rules))}}, ["alerts", "latest_readings"])


def recompute_fleet(store: Store, now: datetime, rules: Rules = _NONE) -> None:
    """Derive crossings, trips and states of all registered vehicles anew, in one job, from their states at the retention cut-off; other vehicles are replayed when they next report."""
    with Kept(store) as keep:

        def build(t: dict[str, DataFrame]) -> dict:
            manifest = store.manifest()
            cutoff = store.forgotten("signal_readings", manifest)
            days = keep.cut(valid_days(t["crossing_days"]))
            first = days.filter(F.col("as_of") <= F.lit(cutoff).cast("timestamp_ntz")) if cutoff else days.limit(0)
            bases = first.filter(F.col("geofence_id") == SELF).groupBy("vehicle_id").agg(F.max("as_of").alias("base"))
            marked = keep.cut(t["vehicles"].select("vehicle_id", F.lit(True).alias("late")).join(bases, "vehicle_id", "left"))
            positions = t["signal_readings"].filter(F.col("signal").isin(*POSITION))
            made = derive(from_base(positions, marked), marked, t | {"crossing_days": days}, rules, cutoff, manifest["number"] + 1, keep)
            kept = days.join(marked.select("vehicle_id"), "vehicle_id", "left_anti").unionByName(first.join(marked.select("vehicle_id"), "vehicle_id", "left_semi"))
            return {"replace": made | {"crossing_days": keep.cut(kept.unionByName(made["crossing_days"]))}}

        store.transact(build)


def grow(store: Store, per_bucket: int = PER_BUCKET) -> int:
    """Double the number of buckets until one has at most per_bucket vehicles on average; returns the number.

    A batch rewrites the buckets that it touches, so what it rewrites follows its own vehicles and not the fleet. Tables that are replaced
    by bucket are written anew, once a doubling; the log, the ledger and states of days stay as they are, and are split when their parts are merged, as far as their size asks for it.
    """
    vehicles = store.read("latest_readings").select("vehicle_id").distinct().count()
    wanted = store.buckets
    while vehicles > wanted * per_bucket:
        wanted *= 2
    if wanted > store.buckets:
        store.transact(lambda t: {"replace": {n: t[n] for n in TOUCHED} | {"ledger_filters": filters(t["packets"], wanted)}, "buckets": wanted}, [*TOUCHED, "packets"])
    return wanted


def rollups(store: Store) -> DataFrame:
    """One row per vehicle, signal and bucket; rows of a bucket that were rolled up at different times are merged."""
    rows = store.read("signal_rollups")
    return history.merge_rollups(rows, rows.limit(0))


def compact(store: Store, now: datetime, rules: Rules = _NONE) -> dict[str, int]:
    """Tiered retention; returns rows dropped and rollup rows.

    Old days leave the log, the ledger and the rollups by the manifest, and nothing of what stays is rewritten but the buckets of alerts that go.
    The state of every vehicle at the cut-off is kept, so what comes later is derived as if all were there still.
    """
    raw, oldest = history.cutoffs(now, rules)
    old_alerts = F.col("resolved_at") < at(oldest)
    with Kept(store) as keep:
        old = store.read("signal_readings", until=raw)
        dropped = old.count()

        def build(t: dict[str, DataFrame]) -> dict:
            manifest = store.manifest()
            days = t | {"crossing_days": keep.cut(valid_days(t["crossing_days"]))}
            states = at_cutoff(store.read("signal_readings", until=raw), days, raw, store.forgotten("signal_readings", manifest), manifest["number"] + 1, rules, keep)
            made = {"append": {"signal_rollups": keep.cut(history.rollup(old, raw, rules)), "crossing_days": keep.cut(states)}, "forget": {"signal_readings": raw, "packets": raw, "crossing_days": raw, "signal_rollups": oldest}}
            made["replace"] = {"ledger_filters": tidied(store, keep.cut(t["ledger_filters"]), raw.date())}
            gone = store.buckets_of(t["alerts"].filter(old_alerts))
            if gone:
                made["replace"]["alerts"] = store.read("alerts", buckets=gone).filter(~F.coalesce(old_alerts, F.lit(False)))
                made["within"] = {"alerts": gone}
            return made

        store.transact(build, ["ledger_filters", "alerts", "crossing_state", "crossing_days", "geofence_versions", "geofence_events", "trips"])
    grow(store)
    return {"rows_dropped": dropped, "rollup_rows": rollups(store).count()}


class _Progress(StreamingQueryListener):
    def __init__(self, name: str | None, call: Callable[[str, int, int], None]):
        self.name, self.call = name, call

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.name is None or p.name == self.name:
            self.call(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def on_progress(spark: SparkSession, call: Callable[[str, int, int], None], name: str | None = None) -> Callable[[], None]:
    """Call call(query, batch, rows read) after every batch of a streaming query (name: of this one only); returns how to stop it."""
    listener = _Progress(name, call)
    spark.streams.addListener(listener)
    return lambda: spark.streams.removeListener(listener)


def start(packets: DataFrame, store: Store, checkpoint: str, clock: Callable[[], datetime], name: str = "ingest", rules: Rules = _NONE, once: bool = False) -> StreamingQuery:
    """Run process_batch on a streaming DataFrame of packets. once: all that is there now, then stop."""

    def each(frame: DataFrame, batch_id: int) -> None:
        process_batch(store, frame, clock(), (name, batch_id), rules)

    writer = packets.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
