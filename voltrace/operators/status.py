"""Vehicle status, the fleet list and the readings register."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import age_seconds, at, contains_text, is_fresh
from ..rules import REGISTER, SOC, STATUSES, TEMP, Rules
from .alerts import alert_rollup
from .current import latest_per_vehicle

_NONE = Rules()


def status(now: datetime, rules: Rules = _NONE) -> Column:
    """Offline, moving, idle or stopped; over the columns of latest_per_vehicle."""
    speed_known = F.col("speed").isNotNull() & is_fresh(F.col("speed_at"), now, rules)
    engine_on = (F.col("ignition") == 1) & is_fresh(F.col("ignition_at"), now, rules)
    return (
        F.when(F.col("last_ping").isNull() | (age_seconds(F.col("last_ping"), now) > rules.offline_s), "offline")
        .when(speed_known & (F.col("speed") > 0), "moving")
        .when(speed_known & (F.col("speed") == 0) & engine_on, "idle")
        .otherwise("stopped")
    )


def fleet_rows(vehicles: DataFrame, latest: DataFrame, alerts: DataFrame, now: datetime, rules: Rules = _NONE) -> DataFrame:
    """One row per registered vehicle, with everything the list shows already decided."""
    state = vehicles.join(latest_per_vehicle(latest), "vehicle_id", "left").join(alert_rollup(alerts, latest, now, rules), "vehicle_id", "left")
    return state.select("vehicle_id", "reg_no", "model", "soc", "range_km", "last_ping", status(now, rules).alias("status"), F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"), "worst_rank")


def fleet_order() -> list[Column]:
    """Worst alerts first, then most, then by registration."""
    return [F.coalesce("worst_rank", F.lit(0)).desc(), F.col("open_alerts").desc(), F.col("reg_no"), F.col("vehicle_id")]


def fleet_list(rows: DataFrame, status: str | None = None, query: str | None = None) -> DataFrame:
    """Rows of fleet_rows by status and text, worst alerts first."""
    if status:
        rows = rows.filter(F.col("status") == status)
    if query and query.strip():
        rows = rows.filter(contains_text(query, F.col("reg_no"), F.col("model")))
    return rows.orderBy(*fleet_order())


def worst_severity() -> Column:
    return F.when(F.col("worst_rank") == 2, "critical").when(F.col("worst_rank") == 1, "warning")


def status_counts(rows: DataFrame, query: str | None = None) -> DataFrame:
    """Vehicles per status, 0 for a status that none has."""
    if query and query.strip():
        rows = rows.filter(contains_text(query, F.col("reg_no"), F.col("model")))
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def breached(signal: Column, value: Column, rules: Rules = _NONE) -> Column:
    return F.when(signal == SOC, value < rules.soc_warning).when(signal == TEMP, value > rules.temp_critical).otherwise(False)


def readings_register(vehicles: DataFrame, latest: DataFrame, now: datetime, rules: Rules = _NONE) -> DataFrame:
    """Six rows per vehicle, reported or not: value, age and verdict (missing, stale, alert or normal). Freshness is exact to the microsecond."""
    spark = vehicles.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(REGISTER)), "place int, signal string"))  # six rows
    rows = vehicles.select("vehicle_id").crossJoin(wanted).join(latest, ["vehicle_id", "signal"], "left")
    age_us = F.greatest(F.lit(0).cast("long"), F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp")))
    verdict = (
        F.when(F.col("event_time").isNull(), "missing")
        .when(age_us > int(rules.stale_after.total_seconds() * 1_000_000), "stale")
        .when(breached(F.col("signal"), F.col("value"), rules), "alert")
        .otherwise("normal")
    )
    return rows.select("vehicle_id", "place", "signal", "value", "event_time", F.when(F.col("event_time").isNotNull(), age_us).alias("age_us"), verdict.alias("verdict"))
