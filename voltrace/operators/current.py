"""The current-state projection and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import ACCURACY, IGNITION, LAT, LON, RANGE, SOC, SPEED, TEMP

KEY = ["vehicle_id", "signal"]


def _newest(*ties: str) -> Column:
    return F.struct("event_time", *ties)


def latest_readings(log: DataFrame) -> DataFrame:
    """Newest reading per vehicle and signal; ties go to the later arrival, then the greater packet id.

    One aggregation with map-side combining instead of a window, so what is
    shuffled is a row per key and task, and a hot vehicle is reduced inside each task.
    """
    newest = F.max_by(F.struct("event_time", "value"), _newest("ingest_time", "packet_id")).alias("r")
    return log.groupBy(*KEY).agg(newest).select(*KEY, "r.event_time", "r.value")


def guarded_upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """current with newer readings of the batch; a reading that is not strictly newer changes nothing."""
    incoming = latest_readings(batch).select(*KEY, "event_time", "value", F.lit(0).alias("held"))
    both = current.select(*KEY, "event_time", "value", F.lit(1).alias("held")).unionByName(incoming)
    newest = F.max_by(F.struct("event_time", "value"), F.struct("event_time", "held")).alias("r")
    return both.groupBy(*KEY).agg(newest).select(*KEY, "r.event_time", "r.value")


def _pick(column: str, signal: str, how=F.max) -> Column:
    return how(F.when(F.col("signal") == signal, F.col(column)))


def latest_per_vehicle(latest: DataFrame) -> DataFrame:
    """One row per vehicle: value and time of each status signal, and the last ping."""
    names = {SOC: ("soc", "soc_at"), RANGE: ("range_km", "range_at"), SPEED: ("speed", "speed_at"), IGNITION: ("ignition", "ignition_at"), TEMP: ("battery_temp", "battery_temp_at")}
    columns = []
    for signal, (value, time) in names.items():
        columns += [_pick("value", signal).alias(value), _pick("event_time", signal).alias(time)]
    return latest.groupBy("vehicle_id").agg(*columns, F.max("event_time").alias("last_ping"))


def last_ping(latest: DataFrame) -> DataFrame:
    return latest.groupBy("vehicle_id").agg(F.max("event_time").alias("last_ping"))


def last_positions(latest: DataFrame) -> DataFrame:
    """Last latitude and longitude of every vehicle that has both."""
    here = latest.filter(F.col("signal").isin(LAT, LON)).groupBy("vehicle_id")
    return here.agg(_pick("value", LAT).alias("lat"), _pick("value", LON).alias("lon"), _pick("event_time", LAT).alias("event_time")).dropna(subset=["lat", "lon"])


def location_fixes(log: DataFrame, tie: str = "merge", complete: bool = True) -> DataFrame:
    """Position rows pivoted to fixes.

    tie: what two fixes of one instant become: "merge" takes each component's maximum,
    "first_received" the packet that arrived first. complete: only those with latitude and longitude.
    """
    rows = log.filter(F.col("signal").isin(LAT, LON, ACCURACY))
    keys = ["vehicle_id", "event_time"] + (["packet_id"] if tie == "first_received" else [])
    arrived = [F.min("ingest_time").alias("ingest_time")] + ([] if tie == "first_received" else [F.min("packet_id").alias("packet_id")])
    fixes = rows.groupBy(*keys).agg(_pick("value", LAT).alias("lat"), _pick("value", LON).alias("lon"), _pick("value", ACCURACY).alias("accuracy_m"), *arrived)
    if complete:
        fixes = fixes.dropna(subset=["lat", "lon"])
    if tie == "first_received":
        first = F.min_by(F.struct("lat", "lon", "accuracy_m", "ingest_time", "packet_id"), F.struct("ingest_time", "packet_id")).alias("f")
        fixes = fixes.groupBy("vehicle_id", "event_time").agg(first).select("vehicle_id", "event_time", "f.*")
    return fixes.select("vehicle_id", "event_time", "ingest_time", "packet_id", "lat", "lon", "accuracy_m")
