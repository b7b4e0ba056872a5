"""Table schemas. Times are timestamps without zone, in UTC; schemas are never inferred."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType

_KINDS = {"s": StringType(), "d": DoubleType(), "t": TimestampNTZType(), "i": IntegerType(), "l": LongType(), "b": BooleanType(), "y": DateType(), "x": BinaryType()}


def _table(columns: str) -> StructType:
    """name:kind, with ? for nullable."""
    fields = [c.split(":") for c in columns.split()]
    return StructType([StructField(n, _KINDS[k[0]], k.endswith("?")) for n, k in fields])


META = _table("key:s value:s")
VEHICLES = _table("vehicle_id:s reg_no:s model:s")
SIGNAL_READINGS = _table("vehicle_id:s signal:s event_time:t ingest_time:t value:d packet_id:s")
PACKETS = _table("packet_id:s vehicle_id:s event_time:t ingest_time:t signal_count:i")
REJECTED_PACKETS = _table("packet_id:s? vehicle_id:s? event_time:t? ingest_time:t reason:s")
LATEST_READINGS = _table("vehicle_id:s signal:s event_time:t value:d")
GEOFENCES = _table("geofence_id:s created_at:t")
GEOFENCE_VERSIONS = _table("geofence_id:s version:i name:s lat:d lon:d radius_m:d active:b valid_from:t valid_to:t?")
GEOFENCE_EVENTS = _table("vehicle_id:s geofence_id:s kind:s event_time:t window_start:t? uncertain:b")
TRIPS = _table("trip_id:s vehicle_id:s origin_geofence_id:s? started_at:t destination_geofence_id:s? ended_at:t? status:s start_uncertain:b end_uncertain:b distance_km:d?")
ALERTS = _table("alert_id:s vehicle_id:s kind:s severity:s trigger_value:d opened_at:t last_seen_at:t resolved_at:t? dismissed_at:t? dismiss_reason:s?")
#: last_event_time lets a later merge tell which value is newest.
SIGNAL_ROLLUPS = _table("vehicle_id:s signal:s bucket_start:t min_value:d max_value:d last_value:d last_event_time:t sample_count:l")
#: What a vehicle's crossings of a fence go on from: the side last believed and the last run of fixes on one side.
CROSSING_STATE = _table("vehicle_id:s geofence_id:s believed:b? inside:b since:t? before:t? last_time:t fixes:i")
#: The same as it was after all fixes before as_of; made: the publish that has written it.
CROSSING_DAYS = _table("vehicle_id:s geofence_id:s believed:b? inside:b since:t? before:t? last_time:t fixes:i as_of:t made:l")
#: Bloom filters of the ledger (sources.ledger).
LEDGER_FILTERS = _table("bucket:i day:y part:i parts:i bits:x")
PACKET = StructType([
    StructField("vehicle_id", StringType()),
    StructField("event_time", TimestampNTZType()),
    StructField("signals", MapType(StringType(), DoubleType())),
    StructField("device_packet_id", StringType()),
])

TABLES = {
    "meta": META,
    "vehicles": VEHICLES,
    "signal_readings": SIGNAL_READINGS,
    "packets": PACKETS,
    "ledger_filters": LEDGER_FILTERS,
    "rejected_packets": REJECTED_PACKETS,
    "latest_readings": LATEST_READINGS,
    "geofences": GEOFENCES,
    "geofence_versions": GEOFENCE_VERSIONS,
    "geofence_events": GEOFENCE_EVENTS,
    "crossing_state": CROSSING_STATE,
    "crossing_days": CROSSING_DAYS,
    "trips": TRIPS,
    "alerts": ALERTS,
    "signal_rollups": SIGNAL_ROLLUPS,
}
SCHEMA_VERSION = "3"
#: Tables that the store splits into buckets, by which column, and into days.
BUCKETED_BY = {t: "vehicle_id" for t in ("signal_readings", "latest_readings", "geofence_events", "crossing_state", "crossing_days", "trips", "alerts", "signal_rollups")} | {"packets": "packet_id"}
DATED_BY = {"signal_readings": "event_time", "packets": "event_time", "crossing_days": "as_of", "signal_rollups": "bucket_start"}
