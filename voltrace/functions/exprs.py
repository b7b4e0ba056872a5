"""Scalar expressions on columns; nothing here leaves generated code."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import EARTH_RADIUS_M, Rules

#: Buckets are counted from Monday 2000-01-03.
BUCKET_ORIGIN_S = 946857600


def at(moment: datetime | Column | str) -> Column:
    """A moment as a timestamp without zone; aware datetimes are turned to UTC."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    if isinstance(moment, str):
        return F.lit(moment).cast("timestamp_ntz")
    if moment.tzinfo is not None:
        moment = (moment - moment.utcoffset()).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def epoch_s(t: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(t.cast("timestamp"))


def age_seconds(t: Column, now: datetime | Column) -> Column:
    """Second boundaries between t and now, never below 0; null if t is."""
    return F.when(t.isNotNull(), F.greatest(F.lit(0), epoch_s(at(now)) - epoch_s(t)))


def is_fresh(t: Column, now: datetime | Column, rules: Rules) -> Column:
    return age_seconds(t, now) <= rules.stale_s


def minus(moment: datetime, delta: timedelta) -> Column:
    return at(moment - delta)


def bucket(t: Column, width_s: int) -> Column:
    """Start of the bucket of width_s seconds that holds t."""
    s = epoch_s(t)
    start = s - F.pmod(s - F.lit(BUCKET_ORIGIN_S), F.lit(width_s))
    return F.timestamp_seconds(start).cast("timestamp_ntz")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.pow(F.sin(dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2.0)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def offset_m(lat: Column, lon: Column, north_m: float, east_m: float) -> tuple[Column, Column]:
    """A coordinate moved by metres north and east."""
    per_degree = EARTH_RADIUS_M * 3.141592653589793 / 180
    return lat + north_m / per_degree, lon + F.lit(east_m / per_degree) / F.cos(F.radians(lat))


def margin_m(accuracy: Column, rules: Rules) -> Column:
    """Half width of the band around a fence's edge in which a fix says nothing."""
    return F.greatest(F.lit(rules.min_margin_m), F.coalesce(accuracy, F.lit(0.0)))


def contains_text(needle: str, *columns: Column) -> Column:
    """Any column contains the trimmed needle, whatever the case; % and _ keep their meaning in patterns."""
    pattern = f"%{needle.strip().lower()}%".replace("\\", "\\\\")
    found = [F.lower(c).like(pattern) for c in columns]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def packet_id(vehicle: Column, event_time: Column, signals: Column, device_id: Column) -> Column:
    """The device's id, or a digest of what the packet says, whatever the order of its signals."""
    entries = F.transform(F.array_sort(F.map_entries(signals)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.coalesce(device_id, F.sha2(F.concat_ws("|", vehicle, F.unix_micros(event_time.cast("timestamp")).cast("string"), F.array_join(entries, ",")), 256))


def alert_id(vehicle: Column, kind: Column, opened_at: Column) -> Column:
    return F.md5(F.concat(vehicle, kind, opened_at.cast("string")))
