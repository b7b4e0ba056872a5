"""Every threshold of the domain in one place; pass another Rules to any operator to change one."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

SOC, RANGE, SPEED, TEMP, ODOMETER, IGNITION = "soc", "range_km", "speed", "battery_temp", "odometer", "ignition"
LAT, LON, ACCURACY = "lat", "lon", "gps_accuracy_m"
POSITION = (LAT, LON, ACCURACY)
#: Signals of the readings register, in the order shown.
REGISTER = (SOC, RANGE, SPEED, TEMP, ODOMETER, IGNITION)
STATUSES = ("moving", "idle", "stopped", "offline")
EARTH_RADIUS_M = 6371008.8


@dataclass(frozen=True)
class Rules:
    """Fixed values of the domain. Ages are held against whole seconds."""

    offline_after: timedelta = timedelta(minutes=10)
    stale_after: timedelta = timedelta(minutes=10)
    future_skew: timedelta = timedelta(minutes=5)
    soc_warning: float = 20.0
    soc_critical: float = 10.0
    temp_critical: float = 45.0
    max_accuracy_m: float = 100.0
    min_margin_m: float = 25.0
    confirmation_fixes: int = 2
    max_certain_gap: timedelta = timedelta(minutes=30)
    raw_retention: timedelta = timedelta(days=7)
    rollup_retention: timedelta = timedelta(days=90)
    rollup_bucket: timedelta = timedelta(minutes=5)

    @property
    def offline_s(self) -> int:
        return int(self.offline_after.total_seconds())

    @property
    def stale_s(self) -> int:
        return int(self.stale_after.total_seconds())
