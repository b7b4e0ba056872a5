"""Charts over raw and rolled-up readings, rollups, and tiered retention."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import at, bucket, minus
from ..rules import POSITION, SOC, Rules

_NONE = Rules()
ROLLUP_KEY = ["vehicle_id", "signal", "bucket_start"]


def signal_history(log: DataFrame, rollups: DataFrame, now: datetime, vehicle_id: str | None = None, signal: str = SOC, window: timedelta = timedelta(hours=24), max_points: int = 240) -> DataFrame:
    """The last value of each bucket over raw readings and rollups together; about max_points a vehicle."""
    since = now - window
    raw = log.filter((F.col("signal") == signal) & (F.col("event_time") >= at(since))).select("vehicle_id", "event_time", "value")
    old = rollups.filter((F.col("signal") == signal) & (F.col("bucket_start") >= at(since))).select("vehicle_id", F.col("bucket_start").alias("event_time"), F.col("last_value").alias("value"))
    if vehicle_id is not None:
        raw, old = (d.filter(F.col("vehicle_id") == vehicle_id) for d in (raw, old))
    width = math.ceil(window.total_seconds() / max_points)
    points = raw.unionByName(old).groupBy("vehicle_id", bucket(F.col("event_time"), width).alias("bucket"))
    return points.agg(F.max_by("value", F.struct("event_time", "value")).alias("value"), F.max("event_time").alias("bucket_at")).select("vehicle_id", "bucket_at", "value").orderBy("vehicle_id", "bucket_at")


def recent_readings(log: DataFrame, vehicle_id: str, signal: str = SOC, limit: int = 50) -> DataFrame:
    rows = log.filter((F.col("vehicle_id") == vehicle_id) & (F.col("signal") == signal))
    return rows.select("event_time", "value").orderBy(F.col("event_time").desc(), F.col("value").desc()).limit(limit)


def rollup(log: DataFrame, before: datetime, rules: Rules = _NONE) -> DataFrame:
    """Readings older than before, per bucket; positions are not rolled up."""
    width = int(rules.rollup_bucket.total_seconds())
    rows = log.filter((F.col("event_time") < at(before)) & ~F.col("signal").isin(*POSITION))
    return rows.groupBy("vehicle_id", "signal", bucket(F.col("event_time"), width).alias("bucket_start")).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max_by("value", F.struct("event_time", "value")).alias("last_value"),
        F.max("event_time").alias("last_event_time"),
        F.count("*").alias("sample_count"),
    )


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rollups of the same buckets merged; the last value is the newest reading's, however late the merge."""
    newest = F.max_by("last_value", F.struct("last_event_time", "last_value"))
    return old.unionByName(new).groupBy(*ROLLUP_KEY).agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        newest.alias("last_value"),
        F.max("last_event_time").alias("last_event_time"),
        F.sum("sample_count").alias("sample_count"),
    )


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int], accuracy: int = 2000) -> DataFrame:
    """Exact percentiles by nearest rank per key: the value at place round(percent / 100 * (n - 1)) of n in order, from 0. Null values don't count.

    A sketch, merged from all tasks, brackets each place first; only values inside the bracket, counted by value, are then ordered, so no task sorts a key's rows.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    margin = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p / 100 + side * margin)) for p in percents for side in (-1, 1)]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    each = F.array(*[F.struct(F.lit(p).alias("percent"), F.floor(F.lit(p / 100.0) * (F.col("n") - 1) + 0.5).alias("place"), F.when(F.lit(ends[2 * k] > 0), F.col("ends")[2 * k]).otherwise(F.col("least")).alias("low"), F.when(F.lit(ends[2 * k + 1] < 1), F.col("ends")[2 * k + 1]).otherwise(F.col("most")).alias("high")) for k, p in enumerate(percents)])
    bounds = bounds.select(*keys, F.explode(each).alias("b")).select(*keys, "b.*")
    counted = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    held = counted.join(bounds, keys).filter("v <= high")
    under = held.filter("v < low").groupBy(*keys, "percent").agg(F.sum("c").alias("under"))
    inside = held.filter("v >= low").join(under, [*keys, "percent"], "left")
    upto = Window.partitionBy(*keys, "percent").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.coalesce("under", F.lit(0)) + F.sum("c").over(upto))
    return inside.filter("upto > place").groupBy(*keys, "percent").agg(F.min("v").alias("value"))


def cutoffs(now: datetime, rules: Rules = _NONE) -> tuple[datetime, datetime]:
    return now - rules.raw_retention, now - rules.raw_retention - rules.rollup_retention


def compact(tables: dict[str, DataFrame], now: datetime, rules: Rules = _NONE) -> dict[str, DataFrame]:
    """The tables after retention: old readings rolled up and dropped with their packets, old rollups and old resolved alerts dropped."""
    raw, oldest = cutoffs(now, rules)
    log = tables["signal_readings"]
    rollups = merge_rollups(tables["signal_rollups"], rollup(log, raw, rules))
    return {
        "signal_readings": log.filter(F.col("event_time") >= at(raw)),
        "packets": tables["packets"].filter(F.col("event_time") >= at(raw)),
        "signal_rollups": rollups.filter(F.col("bucket_start") >= at(oldest)),
        "alerts": tables["alerts"].filter(F.col("resolved_at").isNull() | (F.col("resolved_at") >= at(oldest))),
    }


def retention_report(before: DataFrame, after: DataFrame, rollups: DataFrame) -> DataFrame:
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((before, "was"), (after, "left"), (rollups, "rollup_rows"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select((F.col("was") - F.col("left")).alias("rows_dropped"), "rollup_rows")  # single rows
