"""A live source of packets: some late, some sent twice.

Built on the rate source, so it is distributed and replays the same packets for the same
ticks; what a tick holds depends only on its number.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import at
from ..sources.generate import DEPOT, HUB, noise

#: One packet in DUPLICATE is sent twice, one in LATE is held back 3 to 6 ticks (fixed values).
DUPLICATE, LATE = 12, 20
TICK_S = 3


def packets_of(slots: DataFrame, start: datetime, fleet: int = 40) -> DataFrame:
    """Packets for rows numbered by value: vehicle value % fleet in tick value div fleet."""
    rows = slots.select((F.col("value") % fleet).alias("vi"), F.floor(F.col("value") / fleet).cast("long").alias("tick"))
    held = F.when(noise(F.col("vi"), F.col("tick"), 11, 29, LATE) == 0, 3 + noise(F.col("vi"), F.col("tick"), 5, 3, 4)).otherwise(F.lit(0))
    sent = rows.withColumn("of", F.greatest(F.lit(0), F.col("tick") - held))
    part = (F.sin(F.col("of") / 40.0 + F.col("vi")) + 1.0) / 2.0
    soc = F.lit(8.0) + F.pmod(F.col("vi") * 17 - F.col("of"), F.lit(240)).cast("double") * (92.0 / 240.0)
    speed = noise(F.col("vi"), F.col("of"), 31, 17, 700).cast("double") / 10.0
    values = {
        "soc": soc, "range_km": soc * 4.2, "speed": speed, "battery_temp": F.lit(22.0) + noise(F.col("vi"), F.col("of"), 13, 7, 280).cast("double") / 10.0,
        "ignition": F.when(speed > 0, 1.0).otherwise(0.0), "odometer": F.lit(120000.0) + F.col("of") * 0.05,
        "lat": F.lit(DEPOT[0]) + part * (HUB[0] - DEPOT[0]), "lon": F.lit(DEPOT[1]) + part * (HUB[1] - DEPOT[1]), "gps_accuracy_m": F.lit(6.0),
    }
    signals = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("double") for v in values.values()]))
    vehicle = F.concat(F.lit("v"), F.col("vi").cast("string"))
    copies = F.when(noise(F.col("vi"), F.col("tick"), 3, 7, DUPLICATE) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = sent.select(vehicle.alias("vehicle_id"), (at(start) + F.make_dt_interval(secs=(F.col("of") * TICK_S).cast("decimal(18,6)"))).alias("event_time"), signals.alias("signals"), F.lit(None).cast("string").alias("device_packet_id"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def live(spark: SparkSession, start: datetime, fleet: int = 40, rows_per_second: int = 14) -> DataFrame:
    return packets_of(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("value"), start, fleet)
