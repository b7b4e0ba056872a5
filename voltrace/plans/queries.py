"""Named queries over the telemetry view of events; each takes (spark, sf_dir)."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import with_place
from ..operators import alerts as A
from ..operators import current as C
from ..operators import geofence as G
from ..operators import history as H
from ..operators import ingest as I
from ..operators import status as S
from ..operators import trips as T
from ..sources import generate
from ..sources import telemetry as E
from ..sources.store import Store
from ..sources.telemetry import NOW, RULES
from ..streaming import pipeline as P

ALERTS_BEFORE = datetime(2024, 1, 29)
RAW_CUT = datetime(2024, 1, 24)
#: Samples of each generated vehicle; there are as many vehicles as suppliers.
SAMPLES = 240
#: For queries that go through a store: nothing is old enough to be frozen.
STORED = replace(RULES, raw_retention=timedelta(days=3650))
STORE_BUCKETS = 8
#: The cut-off of the store that drops its old readings between two batches.
CUT = datetime(2024, 1, 16)

_STORES: list[Store] = []
_FILLED: dict[tuple, Store | DataFrame] = {}


def _filled(fill: Callable[[_View], Store | DataFrame]) -> Callable[[_View], Store | DataFrame]:
    """A store, or stored rows, that several queries read is filled once a session and sf_dir."""

    def once(v: _View) -> Store | DataFrame:
        key = (id(v.spark), v.spark.sparkContext.applicationId, v.sf_dir, fill.__name__)
        if key not in _FILLED:
            _FILLED[key] = fill(v)
        return _FILLED[key]

    return once


def _store(spark: SparkSession) -> Store:
    """An empty store in the shared folder, removed at exit."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _STORES.append(Store(spark, f"{(root or tempfile.mkdtemp(prefix='voltrace-')).rstrip('/')}/stores/{uuid.uuid4().hex}", STORE_BUCKETS))
    return _STORES[-1]


@atexit.register
def _remove_stores() -> None:
    for store in _STORES:
        with contextlib.suppress(Exception):  # the session has ended, or the folder is gone already
            store.destroy()


class _View:
    """The telemetry tables of one sf_dir, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = E.events(spark, sf_dir)

    @property
    def log(self) -> DataFrame:
        return E.telemetry_log(self.events)

    @property
    def latest(self) -> DataFrame:
        return C.latest_readings(self.log)

    @property
    def positions(self) -> DataFrame:
        return E.telemetry_positions(self.events)

    @property
    def vehicles(self) -> DataFrame:
        return E.telemetry_vehicles(self.events, self.spark.read.parquet(f"{self.sf_dir}/customer.parquet"))

    @property
    def alerts(self) -> DataFrame:
        return E.telemetry_alerts(self.log, ALERTS_BEFORE)

    @property
    def conditions(self) -> DataFrame:
        return A.alert_conditions(self.latest, NOW, RULES)

    @property
    def fences(self) -> DataFrame:
        return G.current_fences(*E.telemetry_fences(self.spark))

    @property
    def versions(self) -> DataFrame:
        return E.telemetry_fences(self.spark)[1]

    @property
    def n_generated(self) -> int:
        return self.spark.read.parquet(f"{self.sf_dir}/supplier.parquet").count()

    @property
    def event_versions(self) -> DataFrame:
        return E.event_fences(self.events)[1]

    @property
    def fleet(self) -> DataFrame:
        return S.fleet_rows(self.vehicles, self.latest, self.alerts, NOW, RULES)

    @property
    def crossings(self) -> DataFrame:
        return G.crossings(C.location_fixes(self.positions), self.versions, RULES)

    @property
    def trips(self) -> DataFrame:
        return T.trips(self.crossings)

    @property
    def ingest(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(accepted packets, rejected rows, new log rows), where every third packet is in the ledger."""
        accepted, rejected = I.split(I.identified(E.telemetry_packets(self.events)), NOW, RULES)
        known = I.identified(E.telemetry_packets(self.events.filter("event_id % 3 = 0"))).select("packet_id").distinct()
        return accepted, rejected, I.new_rows(I.explode_signals(accepted, NOW), known)


def _guarded_upsert(v: _View) -> DataFrame:
    half = v.log.filter("CAST(packet_id AS BIGINT) % 2 = 0")
    return C.guarded_upsert(C.latest_readings(half), v.log.filter("CAST(packet_id AS BIGINT) % 2 = 1"))


def _alert_counts(v: _View) -> DataFrame:
    one = A.active_count(v.alerts, v.latest, NOW, RULES).select(F.col("n").alias("active"))
    return one.crossJoin(A.dismissed_count(v.alerts).select(F.col("n").alias("dismissed")))  # single rows


def _smallest(v: _View, condition: str = "true") -> str:
    return v.alerts.filter(condition).agg(F.min("alert_id")).first()[0] or ""


def _step(v: _View) -> DataFrame:
    return A.step(v.alerts, v.conditions)


def _edits(v: _View) -> DataFrame:
    """An edit for every fence whose edits are sign-ups: some move it, some rename it, some switch it off."""
    k = F.substring("geofence_id", 2, 9).cast("int")
    return v.event_versions.select("geofence_id").distinct().select(
        "geofence_id",
        F.when(k % 2 == 0, F.concat(F.lit("New "), "geofence_id")).alias("name"),
        F.when(k % 3 == 0, F.lit(13.0)).alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.when(k % 3 == 1, F.lit(900.0)).alias("radius_m"),
        F.when(k % 4 == 3, F.lit(False)).alias("active"),
    )


def _scd2_edit(v: _View) -> DataFrame:
    return G.edit_fences(v.event_versions, _edits(v), NOW)


def _visits(v: _View, versions: DataFrame) -> DataFrame:
    """Fixes inside a fence by its version in force."""
    rows = G.version_asof(C.location_fixes(v.positions), versions, RULES)
    d = G.haversine_m(F.col("lat"), F.col("lon"), F.col("fence_lat"), F.col("fence_lon"))
    return rows.filter(d <= F.col("radius_m")).select("vehicle_id", "geofence_id", "event_time", "version", "active")


def _asof(v: _View) -> DataFrame:
    """The version of every fence at every trusted fix, for all vehicles and fences."""
    vehicles, fences = v.positions.select("vehicle_id").distinct(), v.versions.select("geofence_id").distinct()
    pairs = vehicles.withColumn("geofence_id", F.explode(F.array(*[F.lit(r[0]) for r in fences.collect()])))  # four fences
    rows = G.version_asof(C.location_fixes(v.positions), v.versions, RULES, pairs)
    return rows.select("vehicle_id", "geofence_id", "event_time", "version", "active")


def _history(v: _View) -> DataFrame:
    raw = v.log.filter(F.col("event_time") >= F.lit(RAW_CUT).cast("timestamp_ntz"))
    return H.signal_history(raw, H.rollup(v.log, RAW_CUT, RULES), NOW, window=timedelta(days=28), max_points=240)


def _merge(v: _View) -> DataFrame:
    odd = "CAST(packet_id AS BIGINT) % 2 = {}"
    return H.merge_rollups(*[H.rollup(v.log.filter(odd.format(k)), RAW_CUT, RULES) for k in (0, 1)])


def _retention(v: _View) -> DataFrame:
    tables = {"signal_readings": v.log, "packets": I.ledger_rows(v.log), "signal_rollups": H.rollup(v.log.limit(0), RAW_CUT, RULES), "alerts": v.alerts}
    left = H.compact(tables, NOW, RULES)
    parts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("signal_readings", "signal_rollups", "alerts", "packets")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _generated_positions(v: _View) -> DataFrame:
    wide = generate.positions(generate.grid(v.spark, v.n_generated, SAMPLES, NOW))
    return generate.unpivot_positions(wide).select("vehicle_id", "event_time", "signal", F.round("value", 6).alias("value"))


def _generated_signals(v: _View) -> DataFrame:
    rows = generate.signals(generate.grid(v.spark, v.n_generated, SAMPLES, NOW))
    return rows.select("vehicle_id", "event_time", "signal", F.round("value", 6).alias("value"))


def _streamed(v: _View) -> DataFrame:
    """The simulator's packets, one for each event, through the ingest of the streaming path: log rows per vehicle and signal."""
    from ..streaming.simulator import packets_of

    packets = I.identified(packets_of(v.events.select(F.col("event_id").alias("value")), NOW - timedelta(days=30)))
    accepted, _ = I.split(packets, NOW, RULES)
    return I.explode_signals(accepted, NOW).groupBy("vehicle_id", "signal").agg(F.count("*").alias("n"), F.countDistinct("packet_id").alias("packets"))


def _sliced(v: _View, rows: DataFrame, time_col: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stateful query says of rows that come in two time slices; it is stopped between them and goes on from its checkpoint."""
    from ..streaming.stateful import into_folder

    folder = _store(v.spark).root
    late = F.col(time_col) >= F.lit(CUT).cast("timestamp_ntz")
    for part in (~late, late):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        into_folder(query(v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.parquet(f"{folder}/out").drop("batch")


def _streamed_spells(v: _View) -> DataFrame:
    """Alert spells from the stream, but for those that its time has not left behind."""
    from ..streaming.stateful import alert_spells_stream

    end = A.alert_readings(v.log, RULES).agg(F.max("event_time")).first()[0]  # one moment
    return _sliced(v, v.log, "event_time", lambda s: alert_spells_stream(s, RULES)).filter(F.col("hidden_at") < F.lit(end))


@_filled
def _news(v: _View) -> DataFrame:
    from ..streaming.stateful import crossings_stream

    return _sliced(v, E.position_packets(v.events), "event_time", lambda s: crossings_stream(s, v.versions, RULES))


def _streamed_trips(v: _View) -> DataFrame:
    from ..streaming.stateful import trips_of_news

    return trips_of_news(_news(v))


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """The rows of a result with their place in its order."""
    return with_place(df, order, f"{_store(df.sparkSession).root}/places")


@_filled
def _ingested(v: _View) -> Store:
    """Two batches through a store, the second with all packets of the first again."""
    store = _store(v.spark)
    for k, part in enumerate(("event_id % 2 = 0", "true")):
        P.process_batch(store, E.telemetry_packets(v.events.filter(part)), NOW, ("events", k), STORED)
    return store


@_filled
def _driven(v: _View) -> Store:
    """Positions in four batches through a store with fences: two in order, then late ones of some vehicles, then the rest."""
    store, middle = _store(v.spark), F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    fences, versions = E.telemetry_fences(v.spark)
    store.publish(replace={"geofences": fences, "geofence_versions": versions})
    late, new = F.col("event_id") % 7 == 0, F.col("ts").cast("timestamp_ntz") >= middle
    for k, part in enumerate((~late & ~new, ~late & new, late & (F.col("user_id") % 2 == 0), late)):
        P.process_batch(store, E.position_packets(v.events.filter(part)), NOW, ("positions", k), STORED)
    return store


def _refreshed(v: _View) -> DataFrame:
    store = _store(v.spark)
    store.publish(replace={"alerts": v.alerts, "latest_readings": v.latest})
    P.refresh(store, NOW, RULES)
    return store.read("alerts")


def _recomputed(v: _View) -> DataFrame:
    store = _store(v.spark)
    fences, versions = E.telemetry_fences(v.spark)
    store.publish(replace={"geofences": fences, "geofence_versions": versions, "vehicles": v.vehicles}, append={"signal_readings": v.positions})
    P.recompute_fleet(store, NOW, STORED)
    return store.read("geofence_events")


def _dateline(v: _View) -> DataFrame:
    """Positions moved to both sides of 180 degrees, and fences around there."""
    here = C.last_positions(C.latest_readings(v.positions))
    moved = here.withColumn("lon", F.when(F.col("lon") + 102.38 >= 180.0, F.col("lon") + 102.38 - 360.0).otherwise(F.col("lon") + 102.38))
    fences = [("d1", 12.99, 179.99, 2500.0), ("d2", 13.0, -179.985, 3000.0), ("d3", 12.98, -180.0, 800.0), ("d4", 12.9, -179.5, 400000.0), ("d5", 12.985, 179.998, 60.0), ("d6", 60.0, 100.0, 9000000.0)]
    rows = v.spark.createDataFrame([(f, f, *at, True) for f, *at in fences], "geofence_id string, name string, lat double, lon double, radius_m double, active boolean")
    return G.containing_fences(moved, rows)


def _created(v: _View) -> DataFrame:
    """A fence for every supplier, beside those of the events; some ids exist already."""
    n = F.col("s_suppkey")
    new = v.spark.read.parquet(f"{v.sf_dir}/supplier.parquet").select(
        F.when(n < 4, F.concat(F.lit("g"), n.cast("string"))).otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("geofence_id"),
        F.col("s_name").alias("name"),
        (F.lit(12.9) + n.cast("double") / 10000.0).alias("lat"),
        (F.lit(77.5) + F.col("s_nationkey").cast("double") / 1000.0).alias("lon"),
        (F.lit(300.0) + F.col("s_nationkey").cast("double") * 100.0).alias("radius_m"),
        F.when(n % 2 == 0, F.lit(datetime(2024, 1, 20))).cast("timestamp_ntz").alias("valid_from"),
    )
    fences, versions = G.create_fences(*E.event_fences(v.events), new, NOW)
    return versions.join(fences, "geofence_id")


def _edited_at_once(v: _View) -> DataFrame:
    """Edits at the instant at which the open version of one fence began: this version is changed in place, the others are closed."""
    began = v.event_versions.filter("valid_to IS NULL").agg(F.max("valid_from")).first()[0]  # one moment
    return G.edit_fences(v.event_versions, _edits(v), began or NOW)


def _retained(v: _View) -> DataFrame:
    """Crossings from two batches between which retention drops the readings before CUT; the second brings late ones from behind it."""
    store, rules = _store(v.spark), replace(RULES, raw_retention=timedelta(days=10))
    fences, versions = E.telemetry_fences(v.spark)
    store.publish(replace={"geofences": fences, "geofence_versions": versions})
    ts = F.col("ts").cast("timestamp_ntz")
    first = (ts < F.lit(CUT)) | ((ts < F.lit(CUT + timedelta(days=4))) & (F.col("event_id") % 3 != 0))
    P.process_batch(store, E.position_packets(v.events.filter(first)), CUT + timedelta(days=10), ("positions", 0), rules)
    P.compact(store, CUT + timedelta(days=10), rules)
    P.process_batch(store, E.position_packets(v.events.filter(~first)), CUT + timedelta(days=15), ("positions", 1), rules)
    return store.read("geofence_events")


def _first_received(v: _View) -> DataFrame:
    """Fixes of one instant, of which the first received counts: here every fix comes a second time, later and elsewhere."""
    again = v.positions.withColumns({"packet_id": F.concat(F.lit("z"), "packet_id"), "ingest_time": F.col("ingest_time") + F.expr("INTERVAL 1 HOUR"), "value": F.col("value") + 1.0})
    first = C.location_fixes(v.positions.unionByName(again), "first_received")
    return first.withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


def _labelled(v: _View) -> DataFrame:
    return v.fleet.select("vehicle_id", S.worst_severity().alias("worst"))


def _scoped(v: _View) -> DataFrame:
    return A.alert_conditions(v.latest, NOW, RULES, v.log.filter("CAST(packet_id AS BIGINT) % 5 = 0").select("vehicle_id"))


_QUERIES: dict[str, Callable[[_View], DataFrame]] = {
    "latest_readings": lambda v: v.latest,
    "guarded_upsert": _guarded_upsert,
    "latest_pivot": lambda v: C.latest_per_vehicle(v.latest),
    "last_ping": lambda v: C.last_ping(v.latest),
    "fix_pivot": lambda v: C.location_fixes(v.positions).withColumns({c: F.round(c, 9) for c in ("lat", "lon")}),
    "fleet_rows": lambda v: v.fleet,
    "fleet_list_search": lambda v: S.fleet_list(v.fleet, "moving", " eTruck "),
    "status_counts": lambda v: S.status_counts(v.fleet),
    "readings_register": lambda v: S.readings_register(v.vehicles, v.latest, NOW, RULES),
    "alert_conditions": lambda v: v.conditions,
    "visible_alerts": lambda v: A.visible_alerts(v.alerts, v.latest, NOW, RULES),
    "alert_rollup": lambda v: A.alert_rollup(v.alerts, v.latest, NOW, RULES),
    "active_alerts": lambda v: A.active_alerts(v.alerts, v.latest, v.vehicles, NOW, RULES),
    "alert_counts": _alert_counts,
    "alert_step": _step,
    "alert_open_new": lambda v: A.opened(v.alerts, v.conditions),
    "alert_dismiss": lambda v: A.dismiss(v.alerts, _smallest(v), "wrongAlert", NOW),
    "alert_undo_dismiss": lambda v: A.undo_dismiss(v.alerts, _smallest(v, "dismissed_at IS NOT NULL")),
    "alert_replay": lambda v: A.replay(v.log, RULES),
    "geofence_containment": lambda v: G.containing_fences(C.last_positions(C.latest_readings(v.positions)), v.fences),
    "current_geofence": lambda v: G.current_geofence(C.latest_readings(v.positions), v.fences),
    "geofence_list": lambda v: G.geofence_list(C.latest_readings(v.positions), v.fences),
    "fence_version_asof": _asof,
    "fence_scd2_edit": _scd2_edit,
    "fence_visits": lambda v: _visits(v, v.versions),
    "fence_visits_many_versions": lambda v: _visits(v, v.event_versions),
    "crossings_many_versions": lambda v: G.crossings(C.location_fixes(v.positions), v.event_versions, RULES),
    "signal_percentiles": lambda v: H.nearest_rank(v.log, ["signal"], "value", [50, 95]),
    "store_retained": _retained,
    "alert_spells": lambda v: A.alert_spells(v.log, RULES),
    "stream_alert_spells": _streamed_spells,
    "stream_crossings": lambda v: _news(v).filter("what = 'crossing'").select("vehicle_id", "geofence_id", "kind", "event_time", "window_start", "uncertain"),
    "stream_trips": _streamed_trips,
    "crossings": lambda v: v.crossings,
    "trips": lambda v: v.trips,
    "trip_list": lambda v: T.trip_list(v.trips, v.versions, limit=None),
    "vehicle_trips_ranked": lambda v: _ranked(T.trip_list(v.trips, v.versions, "v5", 50), T.trip_order()),
    "trips_in_progress": lambda v: T.in_progress_count(v.trips),
    "soc_history": _history,
    "recent_readings": lambda v: H.recent_readings(v.log, "v5"),
    "rollup_5min": lambda v: H.rollup(v.log, RAW_CUT, RULES),
    "rollup_merge": _merge,
    "retention_survivors": _retention,
    "ingest_rejects": lambda v: v.ingest[1].select("packet_id", "vehicle_id", "event_time", "reason"),
    "ingest_accounting": lambda v: I.accounting(*v.ingest),
    "ingest_log_rows": lambda v: v.ingest[2].select("packet_id", "vehicle_id", "signal", "event_time", "value"),
    "ingest_touched": lambda v: I.touched(v.ingest[2]),
    "ledger_rows": lambda v: I.ledger_rows(v.log),
    "generate_vehicles": lambda v: generate.vehicles(v.spark, v.n_generated),
    "generate_signals": _generated_signals,
    "generate_positions": _generated_positions,
    "simulated_ingest": _streamed,
    "store_log": lambda v: _ingested(v).read("signal_readings").drop("ingest_time"),
    "store_latest": lambda v: _ingested(v).read("latest_readings"),
    "store_ledger": lambda v: _ingested(v).read("packets").drop("ingest_time"),
    "store_rejected": lambda v: _ingested(v).read("rejected_packets").drop("ingest_time"),
    "store_geofence_events": lambda v: _driven(v).read("geofence_events"),
    "store_trips": lambda v: _driven(v).read("trips"),
    "store_refresh": _refreshed,
    "store_recompute": _recomputed,
    "alert_conditions_scoped": _scoped,
    "geofence_dateline": _dateline,
    "geofence_list_active": lambda v: G.geofence_list(C.latest_readings(v.positions), v.fences, include_inactive=False),
    "fence_create": _created,
    "fence_edit_same_instant": _edited_at_once,
    "fence_versions_ranked": lambda v: _ranked(v.event_versions, G.VERSION_ORDER),
    "fix_first_received": _first_received,
    "fleet_worst_severity": _labelled,
    "fleet_list_ranked": lambda v: _ranked(v.fleet, S.fleet_order()).select("nth", "vehicle_id"),
    "active_alerts_ranked": lambda v: _ranked(A.active_alerts(v.alerts, v.latest, v.vehicles, NOW, RULES), A.alert_order()).select("nth", "alert_id"),
    "geofence_list_ranked": lambda v: _ranked(G.geofence_list(C.latest_readings(v.positions), v.fences), G.fence_order()).select("nth", "geofence_id"),
    "soc_history_ranked": lambda v: _ranked(_history(v), ["vehicle_id", "bucket_at"]).select("nth", "vehicle_id", "bucket_at"),
    "crossings_ranked": lambda v: _ranked(v.crossings, G.CROSSING_ORDER).select("nth", "vehicle_id", "geofence_id", "kind", "event_time"),
}


def _bind(build: Callable[[_View], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(_View(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for name, build in _QUERIES.items()}
