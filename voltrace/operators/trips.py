"""Trips between geofences, from crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trips(crossings: DataFrame) -> DataFrame:
    """A trip starts at the exit that leaves a vehicle inside no fence, and ends at its next crossing, an entry.

    The number of fences around a vehicle is those it must have been in at first
    (fences whose first crossing is an exit) and a running sum of entries and exits.
    """
    exits = F.col("kind") == "exit"
    first = Window.partitionBy("vehicle_id", "geofence_id").orderBy("event_time")
    rows = crossings.withColumn("first_exit", F.when((F.row_number().over(first) == 1) & exits, 1).otherwise(0))
    whole = Window.partitionBy("vehicle_id")
    order = whole.orderBy("event_time", F.when(exits, 1).otherwise(0), "geofence_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "around": F.sum("first_exit").over(whole) + F.sum(F.when(exits, -1).otherwise(1)).over(upto),
        "destination_geofence_id": F.lead("geofence_id").over(order),
        "ended_at": F.lead("event_time").over(order),
        "end_uncertain": F.coalesce(F.lead("uncertain").over(order), F.lit(False)),
    })
    return rows.filter((F.col("kind") == "exit") & (F.col("around") == 0)).select(
        F.md5(F.concat("vehicle_id", "geofence_id", F.col("event_time").cast("string"))).alias("trip_id"),
        "vehicle_id",
        F.col("geofence_id").alias("origin_geofence_id"),
        F.col("event_time").alias("started_at"),
        "destination_geofence_id",
        "ended_at",
        F.when(F.col("ended_at").isNull(), "in_progress").otherwise("completed").alias("status"),
        F.col("uncertain").alias("start_uncertain"),
        "end_uncertain",
        F.lit(None).cast("double").alias("distance_km"),
    )


def trip_order() -> list[Column]:
    """Newest first."""
    return [F.col("started_at").desc(), F.col("vehicle_id"), F.col("trip_id")]


def trip_list(trip_rows: DataFrame, versions: DataFrame, vehicle_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Trips with the latest names of both ends and their duration, newest first."""
    names = versions.groupBy("geofence_id").agg(F.max_by("name", "version").alias("name"))
    origin = names.select(F.col("geofence_id").alias("origin_geofence_id"), F.col("name").alias("origin_name"))
    target = names.select(F.col("geofence_id").alias("destination_geofence_id"), F.col("name").alias("destination_name"))
    rows = trip_rows if vehicle_id is None else trip_rows.filter(F.col("vehicle_id") == vehicle_id)
    rows = rows.join(origin, "origin_geofence_id", "left").join(target, "destination_geofence_id", "left")
    seconds = F.unix_seconds(F.col("ended_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    rows = rows.withColumn("duration_s", seconds).orderBy(*trip_order())
    return rows.limit(limit) if limit is not None else rows


def in_progress_count(trip_rows: DataFrame) -> DataFrame:
    return trip_rows.filter("status = 'in_progress'").agg(F.count("*").alias("n"))
