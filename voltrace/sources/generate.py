"""A deterministic synthetic fleet, made by Spark from ranges; reruns give the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import at
from ..rules import ACCURACY, IGNITION, LAT, LON, ODOMETER, RANGE, SOC, SPEED, TEMP

#: Places that the fleet drives between, and the seeded fences (fixed values).
DEPOT, HUB = (12.9716, 77.5946), (13.0100, 77.6400)
SEED_FENCES = [
    ("North Depot", 12.9716, 77.5946, 400.0),
    ("Customer Hub", 13.0100, 77.6400, 400.0),
    ("Whitefield Yard", 12.9698, 77.7500, 600.0),
    ("Bengaluru ORR", 12.9900, 77.6200, 12000.0),
]
MODELS = ("eTruck 19T", "eTruck 28T", "eVan 3.5T")
SAMPLE_MINUTES = 6


def noise(a: Column, b: Column, by_a: int, by_b: int, n: int) -> Column:
    """A whole number below n, from integer arithmetic that any engine repeats."""
    mixed = F.pmod(a * by_a + b * by_b + (a % 97) * (b % 89), F.lit(1_000_003))
    return F.pmod(mixed * 48_271, F.lit(n))


def vehicles(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (i % len(MODELS) + 1).cast("int"))
    reg = F.concat(F.lit("KA-"), F.lpad((i % 60 + 1).cast("string"), 2, "0"), F.lit("-EV-"), F.lpad(i.cast("string"), 4, "0"))
    return spark.range(n).select(F.concat(F.lit("v"), i.cast("string")).alias("vehicle_id"), reg.alias("reg_no"), model.alias("model"))


def grid(spark: SparkSession, n: int, samples: int, now: datetime) -> DataFrame:
    """vehicle x sample; sample 0 is the newest, every fifth vehicle has been silent for a while.

    One range over the product, so the work is dealt out evenly whatever the shape.
    """
    vi, ki = F.floor(F.col("id") / samples).cast("long"), (F.col("id") % samples).cast("long")
    silent = F.when(F.col("vi") % 5 == 0, 20 + F.col("vi") % 40).otherwise(0)
    back = F.make_dt_interval(mins=(F.col("ki") * SAMPLE_MINUTES + silent).cast("int"))
    rows = spark.range(n * samples).select(vi.alias("vi"), ki.alias("ki"))
    return rows.select("vi", "ki", F.concat(F.lit("v"), F.col("vi").cast("string")).alias("vehicle_id"), (at(now) - back).alias("event_time"))


def signals(rows: DataFrame) -> DataFrame:
    """Six signals of every sample, unpivoted in one pass."""
    vi, ki = F.col("vi"), F.col("ki")
    saw = F.lit(8.0) + F.lit(92.0) * F.abs(F.lit(1.0) - F.lit(2.0) * ((ki + vi * 17) % 240).cast("double") / 240.0)
    soc = F.greatest(F.lit(3.0), F.least(F.lit(100.0), saw))
    speed = F.when((vi + ki) % 7 < 3, F.lit(0.0)).otherwise(F.round(F.lit(15.0) + noise(vi, ki, 31, 17, 6000).cast("double") / 100.0, 1))
    wide = rows.select(
        "vehicle_id", "event_time", "vi", "ki",
        soc.alias(SOC),
        F.round(soc * 4.2, 1).alias(RANGE),
        speed.alias(SPEED),
        F.round(F.lit(22.0) + noise(vi, ki, 13, 7, 2800).cast("double") / 100.0, 1).alias(TEMP),
        F.when((speed > 0) | ((vi + ki) % 11 == 0), F.lit(1.0)).otherwise(F.lit(0.0)).alias(IGNITION),
        F.round(F.lit(120000.0) + vi * F.lit(137.0) + (F.lit(700) - ki) * F.lit(1.7), 1).alias(ODOMETER),
    )
    return wide.unpivot(["vehicle_id", "event_time", "vi", "ki"], [SOC, RANGE, SPEED, TEMP, IGNITION, ODOMETER], "signal", "value")


def positions(rows: DataFrame) -> DataFrame:
    """Fixes of every other sample on a slow orbit between the depot and the hub; one in 23 is junk."""
    part = (F.sin(F.lit(2.0) * F.pi() * F.col("ki") / 96.0 + F.col("vi")) + 1.0) / 2.0
    jitter = noise(F.col("vi"), F.col("ki"), 7919, 104729, 1000).cast("double") / 1000.0
    out = rows.filter("ki % 2 = 0").withColumns({"part": part, "jitter": jitter})
    return out.select(
        "vehicle_id", "event_time", "vi", "ki",
        (F.lit(DEPOT[0]) + F.col("part") * (HUB[0] - DEPOT[0]) + (F.col("jitter") - 0.5) * 0.00025).alias(LAT),
        (F.lit(DEPOT[1]) + F.col("part") * (HUB[1] - DEPOT[1]) + (F.col("jitter") - 0.5) * 0.00025).alias(LON),
        F.when((F.col("vi") + F.col("ki")) % 23 == 0, 150.0 + F.col("jitter") * 200.0).otherwise(4.0 + F.col("jitter") * 12.0).alias(ACCURACY),
    )


def unpivot_positions(wide: DataFrame) -> DataFrame:
    keys = [c for c in wide.columns if c not in (LAT, LON, ACCURACY)]
    return wide.unpivot(keys, [LAT, LON, ACCURACY], "signal", "value")


def log(spark: SparkSession, n: int, samples: int, now: datetime, part: str | None = None) -> DataFrame:
    """The log: 6 rows a sample (part "signals") and 3 more on every other one ("positions"); both if no part is named."""
    rows = grid(spark, n, samples, now)
    sets = [x for x in ((signals(rows), "bf"), (unpivot_positions(positions(rows)), "bfp")) if part in (None, "signals" if x[1] == "bf" else "positions")]
    parts = [d.select("vehicle_id", "signal", "event_time", at(now).alias("ingest_time"), "value", F.concat_ws("-", F.lit(name), "vi", "ki").alias("packet_id")) for d, name in sets]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def seed_fences(spark: SparkSession, valid_from: datetime) -> tuple[DataFrame, DataFrame]:
    """(geofences, geofence_versions) of the four seeded fences."""
    rows = spark.createDataFrame([(f"fence-{i + 1}", *f) for i, f in enumerate(SEED_FENCES)], "geofence_id string, name string, lat double, lon double, radius_m double")
    fences = rows.select("geofence_id", at(valid_from).alias("created_at"))
    return fences, rows.select("geofence_id", F.lit(1).alias("version"), "name", "lat", "lon", "radius_m", F.lit(True).alias("active"), at(valid_from).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
