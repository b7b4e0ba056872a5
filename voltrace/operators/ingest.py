"""One batch of packets: refuse, explode, deduplicate, account."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, packet_id
from ..rules import Rules

_NONE = Rules()


def identified(packets: DataFrame) -> DataFrame:
    """Packets with their packet_id: the device's own or a digest of the content."""
    return packets.withColumn("packet_id", packet_id(F.col("vehicle_id"), F.col("event_time"), F.col("signals"), F.col("device_packet_id")))


def reject_reason(now: datetime, rules: Rules = _NONE) -> Column:
    """Why a packet is refused, or null: dated too far ahead, else without signals."""
    empty = F.col("signals").isNull() | (F.size("signals") <= 0)
    return F.when(F.col("event_time") > at(now + rules.future_skew), "clock_skew_future").when(empty, "empty_packet")


def split(packets: DataFrame, now: datetime, rules: Rules = _NONE) -> tuple[DataFrame, DataFrame]:
    """(accepted packets, rejected rows)."""
    rows = packets.withColumn("reason", reject_reason(now, rules))
    return rows.filter("reason IS NULL").drop("reason"), rejected_rows(rows, now)


def rejected_rows(judged: DataFrame, now: datetime) -> DataFrame:
    """The refused ones among packets with a reason."""
    return judged.filter("reason IS NOT NULL").select("packet_id", "vehicle_id", "event_time", at(now).alias("ingest_time"), "reason")


def explode_signals(accepted: DataFrame, now: datetime) -> DataFrame:
    """Log rows of a batch, one per packet and signal."""
    rows = accepted.select("vehicle_id", F.explode("signals").alias("signal", "value"), "event_time", at(now).alias("ingest_time"), "packet_id")
    return collapse(rows).select("vehicle_id", "signal", "event_time", "ingest_time", "value", "packet_id")


def collapse(rows: DataFrame) -> DataFrame:
    """One row per packet and signal: the first received; ties go to the smaller vehicle, time and value."""
    first = F.min(F.struct("ingest_time", "vehicle_id", "event_time", "value")).alias("r")
    return rows.groupBy("packet_id", "signal").agg(first).select("packet_id", "signal", "r.*")


def new_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of packets that the ledger doesn't know."""
    return batch.join(ledger.select("packet_id"), "packet_id", "left_anti").select(*batch.columns)


def ledger_rows(fresh: DataFrame) -> DataFrame:
    one = F.min(F.struct("event_time", "vehicle_id", "ingest_time")).alias("r")
    return fresh.groupBy("packet_id").agg(one, F.count("*").cast("int").alias("signal_count")).select("packet_id", "r.vehicle_id", "r.event_time", "r.ingest_time", "signal_count")


def touched(fresh: DataFrame) -> DataFrame:
    """Vehicles of a batch and the earliest event time that it brought for each."""
    return fresh.groupBy("vehicle_id").agg(F.min("event_time").alias("from_time"))


def accounting(accepted: DataFrame, rejected: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: accepted packets, duplicates, and rejected ones by reason."""
    new = fresh.agg(F.countDistinct("packet_id").alias("accepted"))
    offered = accepted.agg(F.count("*").alias("offered"))
    refused = rejected.agg(F.count_if(F.col("reason") == "clock_skew_future").alias("clock_skew_future"), F.count_if(F.col("reason") == "empty_packet").alias("empty_packet"))
    return new.crossJoin(offered).crossJoin(refused).select("accepted", (F.col("offered") - F.col("accepted")).alias("duplicates"), "clock_skew_future", "empty_packet")  # single rows
