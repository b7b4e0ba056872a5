"""Wording for people: alert titles, ages, durations and values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words shown to operators (fixed values).
UNITS = {"soc": "%", "range_km": "km", "speed": "km/h", "battery_temp": "°C", "odometer": "km", "ignition": ""}
DISMISS_REASONS = {"onIt": "I am on it", "wrongAlert": "Wrong alert", "somethingElse": "Something else..."}
NOTHING = "—"


def alert_title(kind: Column, severity: Column) -> Column:
    battery = F.when(severity == "critical", "Battery critically low").otherwise("Low battery")
    return F.when(kind == "battery_soc", battery).when(kind == "battery_temp", "Battery overheating")


def alert_detail(kind: Column, value: Column) -> Column:
    return F.when(kind == "battery_soc", F.concat(F.format_string("%.0f", value), F.lit("% state of charge"))).when(kind == "battery_temp", F.format_string("%.1f °C", value))


def dismiss_label(reason: Column) -> Column:
    out = reason
    for name, label in DISMISS_REASONS.items():
        out = F.when(reason == name, label).otherwise(out)
    return out


def _whole(seconds: Column, size: int) -> Column:
    return F.floor(seconds / size).cast("long")


def _hours_minutes(seconds: Column) -> Column:
    return F.concat(_whole(seconds, 3600).cast("string"), F.lit("h "), (_whole(seconds, 60) % 60).cast("string"), F.lit("m"))


def age_text(seconds: Column) -> Column:
    """The older, the coarser; null is never."""
    return (
        F.when(seconds.isNull(), "never")
        .when(seconds < 5, "just now")
        .when(seconds < 60, F.concat(_whole(seconds, 1).cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(_whole(seconds, 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(_hours_minutes(seconds), F.lit(" ago")))
        .otherwise(F.concat(_whole(seconds, 86400).cast("string"), F.lit("d ago")))
    )


def duration_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), NOTHING).when(seconds < 3600, F.concat(_whole(seconds, 60).cast("string"), F.lit("m"))).otherwise(_hours_minutes(seconds))


def clock_text(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "dd/MM HH:mm"), F.lit(NOTHING))


def value_text(value: Column, unit: Column | str = "") -> Column:
    """Whole numbers below 100,000 without a fraction, all others with one digit."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    number = F.when((value == F.round(value, 0)) & (F.abs(value) < 100000), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.when(value.isNull(), NOTHING).when(unit == "", number).otherwise(F.concat(number, F.lit(" "), unit))


def nearest_rank(sorted_values: Column, percent: float) -> Column:
    """The percentile of a sorted array by nearest rank."""
    place = F.floor(F.lit(percent / 100.0) * (F.size(sorted_values) - 1) + 0.5).cast("int")
    return F.element_at(sorted_values, place + 1)
