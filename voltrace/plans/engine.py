"""The facade: open a store, ingest, query. Times come from the clock that is passed in.

Everything that writes goes through the store's queue: a publish that was made from an outdated snapshot is made again.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import geofence as G
from ..operators import history as H
from ..operators import status as S
from ..operators import trips as T
from ..operators.current import guarded_upsert
from ..operators.replay import SELF
from ..rules import SOC, Rules
from ..sources import generate
from ..sources.schemas import BUCKETED_BY, TABLES
from ..sources.store import BUCKETS, Store
from ..streaming import pipeline as P


@dataclass
class BackfillReport:
    """What a backfill has written, and the seconds of each stage."""

    vehicles: int = 0
    rows: int = 0
    seconds: dict[str, float] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime], rules: Rules | None = None, buckets: int = BUCKETS):
        """buckets: into how many parts a new store splits its tables by vehicle; some for each core of the cluster."""
        self.spark, self.store, self.clock, self.rules = spark, Store(spark, root, buckets), clock, rules or Rules()
        self._apart = self.store.in_session(spark.newSession())

    def subscribe(self, listener: Callable[[], None]) -> Callable[[], None]:
        """Call listener after every change of the store; returns how to stop it."""
        return self.store.subscribe(lambda number, tables: listener())

    # fleet and vehicles
    def fleet_rows(self) -> DataFrame:
        t = self.store.snapshot(["vehicles", "latest_readings", "alerts"])
        return S.fleet_rows(t["vehicles"], t["latest_readings"], t["alerts"], self.clock(), self.rules)

    def fleet_list(self, status: str | None = None, query: str | None = None) -> DataFrame:
        return S.fleet_list(self.fleet_rows(), status, query)

    def status_counts(self, query: str | None = None) -> DataFrame:
        return S.status_counts(self.fleet_rows(), query)

    def detail(self, vehicle_id: str) -> dict[str, DataFrame]:
        """The vehicle's fleet row, its register and its most specific fence."""
        t = self.store.snapshot(["vehicles", "latest_readings", "geofences", "geofence_versions"])
        mine = F.col("vehicle_id") == vehicle_id
        latest = t["latest_readings"].filter(mine)
        return {
            "row": self.fleet_rows().filter(mine),
            "register": S.readings_register(t["vehicles"].filter(mine), latest, self.clock(), self.rules).orderBy("place"),
            "geofence": G.current_geofence(latest, G.current_fences(t["geofences"], t["geofence_versions"])),
        }

    def soc_history(self, vehicle_id: str, window: timedelta = timedelta(hours=24), max_points: int = 240) -> DataFrame:
        log, since = self.store.read("signal_readings", since=self.clock() - window), self.rollups()
        return H.signal_history(log, since, self.clock(), vehicle_id, SOC, window, max_points)

    def recent_soc_readings(self, vehicle_id: str, limit: int = 50) -> DataFrame:
        return H.recent_readings(self.store.read("signal_readings"), vehicle_id, SOC, limit)

    # alerts
    def active_alerts(self, vehicle_id: str | None = None) -> DataFrame:
        t = self.store.snapshot(["alerts", "latest_readings", "vehicles"])
        return A.active_alerts(t["alerts"], t["latest_readings"], t["vehicles"], self.clock(), self.rules, vehicle_id)

    def active_count(self) -> int:
        t = self.store.snapshot(["alerts", "latest_readings"])
        return A.active_count(t["alerts"], t["latest_readings"], self.clock(), self.rules).first()["n"]

    def dismissed_count(self) -> int:
        return A.dismissed_count(self.store.read("alerts")).first()["n"]

    def _alert(self, alert_id: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the bucket that holds the alert."""
        found = self.store.buckets_of(self.store.read("alerts").filter(F.col("alert_id") == alert_id))
        if found:
            self.store.transact(lambda t: {"replace": {"alerts": change(self.store.read("alerts", buckets=found))}, "within": {"alerts": found}}, [])

    def dismiss(self, alert_id: str, reason: str) -> None:
        self._alert(alert_id, lambda alerts: A.dismiss(alerts, alert_id, reason, self.clock()))

    def undo_dismiss(self, alert_id: str) -> None:
        self._alert(alert_id, lambda alerts: A.undo_dismiss(alerts, alert_id))

    # fences
    def geofences(self, include_inactive: bool = True) -> DataFrame:
        t = self.store.snapshot(["latest_readings", "geofences", "geofence_versions"])
        return G.geofence_list(t["latest_readings"], G.current_fences(t["geofences"], t["geofence_versions"]), include_inactive)

    def geofence_count(self) -> int:
        return self.store.read("geofences").count()

    def create_geofence(self, name: str, lat: float, lon: float, radius_m: float, valid_from: datetime | None = None) -> str:
        fence, now = uuid.uuid4().hex[:16], self.clock()

        def build(t: dict[str, DataFrame]) -> dict:
            fences, versions = G.create_fence(t["geofences"], t["geofence_versions"], fence, name, lat, lon, radius_m, now, valid_from)
            return {"replace": {"geofences": fences, "geofence_versions": versions} | self._states_before(t, valid_from or now)}

        self.store.transact(build, ["geofences", "geofence_versions", "crossing_state", "crossing_days"])
        return fence

    def edit_geofence(self, geofence_id: str, name: str | None = None, lat: float | None = None, lon: float | None = None, radius_m: float | None = None, active: bool | None = None) -> None:
        now = self.clock()
        edit = self.spark.createDataFrame([(geofence_id, name, lat, lon, radius_m, active)], "geofence_id string, name string, lat double, lon double, radius_m double, active boolean")

        def build(t: dict[str, DataFrame]) -> dict:
            before = t["geofence_versions"].filter((F.col("geofence_id") == geofence_id) & F.col("valid_to").isNull()).agg(F.min("valid_from")).first()[0]
            return {"replace": {"geofence_versions": G.edit_fences(t["geofence_versions"], edit, now)} | self._states_before(t, min(before or now, now))}

        self.store.transact(build, ["geofence_versions", "crossing_state", "crossing_days"])

    def _states_before(self, t: dict[str, DataFrame], moment: datetime) -> dict[str, DataFrame]:
        """The states of vehicles that have reported nothing since the moment from which fences change; the others are replayed from their last day before it when they next report."""
        state, days = t["crossing_state"], t["crossing_days"]
        since = state.filter((F.col("geofence_id") == SELF) & (F.col("last_time") >= G.at(moment))).select("vehicle_id")
        first = max(moment, self.store.forgotten("signal_readings") or moment)  # what was seen before the cut-off is not read again
        return {"crossing_state": state.join(since, "vehicle_id", "left_anti"), "crossing_days": days.filter(F.col("as_of") <= G.at(first)).unionByName(days.filter(F.col("as_of") > G.at(first)).join(since, "vehicle_id", "left_anti"))}

    def set_active(self, geofence_id: str, active: bool) -> None:
        self.edit_geofence(geofence_id, active=active)

    def all_versions(self) -> DataFrame:
        return G.all_versions(self.store.read("geofence_versions"))

    # trips
    def trips(self, vehicle_id: str, limit: int = 50) -> DataFrame:
        t = self.store.snapshot(["trips", "geofence_versions"])
        return T.trip_list(t["trips"], t["geofence_versions"], vehicle_id, limit)

    def in_progress_count(self) -> int:
        return T.in_progress_count(self.store.read("trips")).first()["n"]

    # writing
    def ingest(self, packets: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        return P.process_batch(self.store, packets, self.clock(), batch, self.rules)

    def refresh_derived_state(self) -> None:
        P.refresh(self.store, self.clock(), self.rules)

    def recompute_fleet(self) -> None:
        P.recompute_fleet(self.store, self.clock(), self.rules)

    def register_vehicles(self, vehicles: DataFrame) -> None:
        """Add vehicles; those that are registered already stay as they are."""
        self.store.transact(lambda t: {"append": {"vehicles": vehicles.dropDuplicates(["vehicle_id"]).join(t["vehicles"].select("vehicle_id"), "vehicle_id", "left_anti")}}, ["vehicles"])

    def set_meta(self, key: str, value: str) -> None:
        one = self.spark.createDataFrame([(key, value)], TABLES["meta"])
        self.store.transact(lambda t: {"replace": {"meta": t["meta"].filter(F.col("key") != key).unionByName(one)}}, ["meta"])

    def meta(self, key: str) -> str | None:
        row = self.store.read("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def seed_fences(self) -> bool:
        """The usual four fences, if there are none; whether they were added."""
        if not self.store.read("geofences").isEmpty():
            return False
        fences, versions = generate.seed_fences(self.spark, datetime(2020, 1, 1))
        self.store.publish(replace={"geofences": fences, "geofence_versions": versions} | {t: self.store.read(t).limit(0) for t in ("crossing_state", "crossing_days")})
        return True

    def backfill(self, vehicles: int = 500, samples: int = 700, on_stage: Callable[[str], None] | None = None) -> BackfillReport:
        """Add a synthetic fleet's history: vehicles that are not registered yet, fences if there are none, its log, and the current state."""
        report, now = BackfillReport(vehicles), self.clock()

        def stage(name: str, run: Callable[[], None]) -> None:
            if on_stage:
                on_stage(name)
            began = time.perf_counter()
            run()
            report.seconds[name] = time.perf_counter() - began

        made = {part: generate.log(self.spark, vehicles, samples, now, part) for part in ("signals", "positions")}

        def signals() -> None:
            report.rows += self._published(made["signals"])

        def positions() -> None:
            report.rows += self._published(made["positions"])

        def latest() -> None:
            empty = ("crossing_state", "crossing_days")  # vehicles are replayed when they next report
            rows = made["signals"].unionByName(made["positions"])  # made again, which takes less than reading the log
            self.store.transact(lambda t: {"replace": {"latest_readings": guarded_upsert(t["latest_readings"], rows)} | {n: t[n].limit(0) for n in empty}}, ["latest_readings", *empty])

        stage("vehicles", lambda: self.register_vehicles(generate.vehicles(self.spark, vehicles)))
        stage("geofences", self.seed_fences)
        stage("signals", signals)
        stage("positions", positions)
        stage("latest", latest)
        return report

    def _published(self, rows: DataFrame) -> int:
        """Append rows to the log; how many there were is counted as they are written."""
        seen = Observation()
        self.store.publish(append={"signal_readings": rows.observe(seen, F.count("*").alias("n"))})
        return seen.get["n"]

    def already_populated(self) -> bool:
        return not self.store.read("signal_readings").isEmpty()

    def compact(self) -> dict[str, int]:
        """Tiered retention; returns rows dropped and rollup rows.

        Old days leave the log, the ledger and the rollups by the manifest, and nothing of what stays is rewritten but the buckets of alerts that go.
        The state of every vehicle at the cut-off is kept, so what comes later is derived as if all were there still.
        """
        return P.compact(self.store, self.clock(), self.rules)

    def rollups(self) -> DataFrame:
        """One row per vehicle, signal and bucket; rows of a bucket that were rolled up at different times are merged."""
        return P.rollups(self.store)

    def table_counts(self) -> DataFrame:
        """Rows of every table."""
        out = None
        for name, df in self.store.snapshot().items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    # plain SQL over the tables, in a session of its own: views of the user's session stay as they are
    def _sql(self, sql: str, args: tuple, named: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """A statement over the tables that it names, with positional (?) or named (:name) arguments."""
        if args and named:
            raise ValueError("arguments are either positional or named")
        for name, df in (tables or self._apart.snapshot([t for t in TABLES if re.search(rf"\b{t}\b", sql)])).items():
            df.createOrReplaceTempView(name)
        bound = [a.replace(tzinfo=None) - (a.utcoffset() or timedelta()) if isinstance(a, datetime) else a for a in args]
        return self._apart.spark.sql(sql, args=bound or named or None)

    def select(self, sql: str, *args, **named) -> list[Row]:
        return self._sql(sql, args, named).collect()

    def select_one(self, sql: str, *args, **named) -> Row | None:
        rows = self.select(sql, *args, **named)
        return rows[0] if rows else None

    def insert(self, table: str, rows: str, *args, **named) -> None:
        """Append the rows of a query, in the table's order of columns."""
        self._apart.transact(lambda t: {"append": {table: self._sql(rows, args, named).toDF(*TABLES[table].names)}}, [])

    def delete(self, table: str, where: str = "true", *args, **named) -> None:
        """Delete the rows of a table for which a condition holds; one that is null does not hold."""
        self._change(table, f"SELECT * FROM {table} WHERE NOT coalesce({where}, false)", where, args, args, named)

    def update(self, table: str, values: dict[str, str], where: str = "true", *args, **named) -> None:
        """Set columns of a table to expressions over its columns, where a condition holds. Positional arguments belong to the condition; expressions take named ones."""
        if set(values) - set(TABLES[table].names):
            raise ValueError(f"{table} has no {sorted(set(values) - set(TABLES[table].names))}")
        columns = ", ".join(f"CASE WHEN coalesce({where}, false) THEN {values[c]} ELSE {c} END AS {c}" if c in values else c for c in TABLES[table].names)
        self._change(table, f"SELECT {columns} FROM {table}", where, args * len(values), args, named)

    def _change(self, table: str, sql: str, where: str, args: tuple, tested: tuple, named: dict) -> None:
        """Replace the buckets of a table that hold rows to change by what a statement makes of them."""
        if table not in TABLES:
            raise ValueError(f"{table} is no table of the store")

        def build(t: dict[str, DataFrame]) -> dict:
            if table not in BUCKETED_BY:
                return {"replace": {table: self._sql(sql, args, named, t)}}
            held = self._apart.buckets_of(self._sql(f"SELECT {BUCKETED_BY[table]} FROM {table} WHERE {where}", tested, named, t), BUCKETED_BY[table])
            held = self._apart.widened(table, held)
            some = {table: self._apart.read(table, buckets=held)}
            return {"replace": {table: self._sql(sql, args, named, some)}, "within": {table: held}} if held else {}

        self._apart.transact(build, [table])

    def destroy(self) -> None:
        self.store.destroy()
