"""A table of user events seen as telemetry: users are vehicles, event types are signals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..rules import IGNITION, ODOMETER, SOC, SPEED, TEMP, Rules
from .generate import MODELS

#: Rules and time for events that are hours apart, not minutes.
NOW = datetime(2024, 1, 31)
RULES = Rules(offline_after=timedelta(hours=12), stale_after=timedelta(hours=48), max_certain_gap=timedelta(hours=12))
SIGNAL_OF = {"click": SOC, "view": SPEED, "purchase": TEMP, "signup": ODOMETER, "error": IGNITION}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _vehicle() -> F.Column:
    return F.concat(F.lit("v"), F.col("user_id").cast("string"))


def telemetry_log(rows: DataFrame) -> DataFrame:
    """Events as log rows."""
    kind, v = F.col("event_type"), F.col("value")
    signal = F.lit(None).cast("string")
    for name, s in SIGNAL_OF.items():
        signal = F.when(kind == name, s).otherwise(signal)
    value = F.when(kind == "click", F.least(F.lit(100.0), v)).when(kind == "view", F.when(v < 15.0, 0.0).otherwise(v)).when(kind == "error", F.when(v < 10.0, 0.0).otherwise(1.0)).otherwise(v)
    return rows.select(_vehicle().alias("vehicle_id"), signal.alias("signal"), F.col("ts").cast("timestamp_ntz").alias("event_time"), F.col("ts").cast("timestamp_ntz").alias("ingest_time"), value.alias("value"), F.col("event_id").cast("string").alias("packet_id"))


def telemetry_positions(rows: DataFrame) -> DataFrame:
    """Position rows: every vehicle goes to and fro between the depot and the hub once in 120 hours, at its own phase."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    part = F.abs(((hour + F.col("user_id") * 5) % 120 - 60).cast("double")) / 60.0
    wide = rows.select(
        _vehicle().alias("vehicle_id"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        F.col("ts").cast("timestamp_ntz").alias("ingest_time"),
        F.col("event_id").cast("string").alias("packet_id"),
        (F.lit(12.9716) + part * 0.0384).alias("lat"),
        (F.lit(77.5946) + part * 0.0454).alias("lon"),
        F.when(F.col("event_id") % 23 == 0, 150.0).otherwise(5.0 + (F.col("event_id") % 12)).cast("double").alias("gps_accuracy_m"),
    )
    return wide.unpivot(["vehicle_id", "event_time", "ingest_time", "packet_id"], ["lat", "lon", "gps_accuracy_m"], "signal", "value").select("vehicle_id", "signal", "event_time", "ingest_time", "value", "packet_id")


def telemetry_vehicles(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """The register: most users, and a few vehicles that have never reported."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("n") % 3 + 1).cast("int"))
    users = rows.select(F.col("user_id").alias("n")).distinct().filter("n % 29 <> 7")
    silent = customers.filter("c_custkey <= 5").select((F.col("c_custkey") + 900000).alias("n"))
    return users.unionByName(silent).select(F.concat(F.lit("v"), F.col("n").cast("string")).alias("vehicle_id"), F.concat(F.lit("KA-"), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit("-EV-"), F.col("n").cast("string")).alias("reg_no"), model.alias("model"))


def telemetry_alerts(log: DataFrame, before: datetime) -> DataFrame:
    """Alerts as they might stand some days earlier: one for the last breach of each vehicle and kind."""
    old = log.filter(F.col("event_time") < F.lit(before.isoformat(sep=" ")).cast("timestamp_ntz"))
    bad = old.filter(((F.col("signal") == SOC) & (F.col("value") < 20.0)) | ((F.col("signal") == TEMP) & (F.col("value") > 45.0)))
    kind = F.when(F.col("signal") == SOC, "battery_soc").otherwise("battery_temp")
    last = bad.groupBy("vehicle_id", kind.alias("kind")).agg(F.max_by(F.struct("event_time", "value"), F.struct("event_time", "packet_id")).alias("r"))
    number = F.substring("vehicle_id", 2, 20).cast("long")
    time = F.col("r.event_time")
    return last.select(
        F.md5(F.concat("vehicle_id", "kind", time.cast("string"))).alias("alert_id"),
        "vehicle_id",
        "kind",
        F.when((F.col("kind") == "battery_soc") & (F.col("r.value") >= 10.0), "warning").otherwise("critical").alias("severity"),
        F.col("r.value").alias("trigger_value"),
        time.alias("opened_at"),
        time.alias("last_seen_at"),
        F.when(number % 3 == 0, time + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
        F.when(number % 7 == 0, time + F.expr("INTERVAL 2 HOURS")).alias("dismissed_at"),
        F.when(number % 7 == 0, "onIt").alias("dismiss_reason"),
    )


FENCES = [
    ("f1", 1, "North Depot", 12.9716, 77.5946, 2500.0, True, "2020-01-01 00:00:00", "2024-01-12 00:00:00"),
    ("f1", 2, "North Depot Wide", 12.9716, 77.5946, 3000.0, True, "2024-01-12 00:00:00", None),
    ("f2", 1, "Customer Hub", 13.0100, 77.6400, 2800.0, True, "2020-01-01 00:00:00", None),
    ("f3", 1, "Whitefield Yard", 12.9698, 77.7500, 600.0, True, "2020-01-01 00:00:00", "2024-01-20 00:00:00"),
    ("f3", 2, "Whitefield Yard", 12.9698, 77.7500, 600.0, False, "2024-01-20 00:00:00", None),
    ("f4", 1, "Bengaluru ORR", 12.9900, 77.6200, 4000.0, True, "2020-01-01 00:00:00", None),
]


def telemetry_fences(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(geofences, versions), with an edit and a deactivation."""
    rows = spark.createDataFrame(FENCES, "geofence_id string, version int, name string, lat double, lon double, radius_m double, active boolean, valid_from string, valid_to string")
    versions = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})
    return versions.filter("version = 1").select("geofence_id", F.col("valid_from").alias("created_at")), versions


def event_fences(rows: DataFrame, fences: int = 8) -> tuple[DataFrame, DataFrame]:
    """(geofences, versions) whose edits are the sign-ups among the events: hundreds of versions of a few fences."""
    fence, when = F.concat(F.lit("g"), (F.col("user_id") % fences).cast("string")), F.col("ts").cast("timestamp_ntz")
    edits = rows.filter("event_type = 'signup'").groupBy(fence.alias("geofence_id"), when.alias("valid_from")).agg(F.max("event_id").alias("n"))  # one edit an instant
    order = Window.partitionBy("geofence_id").orderBy("valid_from")
    versions = edits.select(
        "geofence_id",
        F.row_number().over(order).alias("version"),
        F.concat(F.lit("Fence "), F.col("geofence_id"), F.lit("."), (F.col("n") % 9).cast("string")).alias("name"),
        (F.lit(12.9716) + (F.col("n") % 5).cast("double") / 125.0).alias("lat"),
        (F.lit(77.5946) + (F.col("n") % 7).cast("double") / 160.0).alias("lon"),
        (F.lit(600.0) + (F.col("n") % 6).cast("double") * 500.0).alias("radius_m"),
        (F.col("n") % 11 != 0).alias("active"),
        "valid_from",
        F.lead("valid_from").over(order).alias("valid_to"),
    )
    return versions.filter("version = 1").select("geofence_id", F.col("valid_from").alias("created_at")), versions


def telemetry_packets(rows: DataFrame) -> DataFrame:
    """Events as packets: some from the future, some without signals, some sent twice, some without a device id."""
    log = telemetry_log(rows).select("vehicle_id", "signal", "event_time", "value", F.col("packet_id").cast("long").alias("n"))
    n = F.col("n")
    time = F.when(n % 41 == 0, F.col("event_time") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("event_time"))
    signals = F.when(n % 37 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(F.create_map(F.col("signal"), F.col("value")))
    device = F.when(n % 2 == 0, F.concat(F.lit("d"), n.cast("string")))
    once = log.select("vehicle_id", time.alias("event_time"), signals.alias("signals"), device.alias("device_packet_id"), "n")
    return once.unionByName(once.filter("n % 10 = 0")).drop("n")


def position_packets(rows: DataFrame) -> DataFrame:
    """Events as packets of one fix each."""
    keys = ["vehicle_id", "event_time", "packet_id"]
    wide = telemetry_positions(rows).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("signal", "value"))).alias("signals"))  # three a packet
    return wide.select("vehicle_id", "event_time", "signals", F.concat(F.lit("p"), "packet_id").alias("device_packet_id"))
