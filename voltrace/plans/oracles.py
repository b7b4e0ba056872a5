"""SQL for the queries over the telemetry view of events, in DuckDB's dialect."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
OFFLINE, STALE = 12 * 3600, 48 * 3600

_CTE = {
    "log": """SELECT 'v' || user_id AS vehicle_id,
        CASE event_type WHEN 'click' THEN 'soc' WHEN 'view' THEN 'speed' WHEN 'purchase' THEN 'battery_temp' WHEN 'signup' THEN 'odometer' WHEN 'error' THEN 'ignition' END AS signal,
        ts AS event_time, ts AS ingest_time,
        CASE event_type WHEN 'click' THEN least(100.0::DOUBLE, value) WHEN 'view' THEN CASE WHEN value < 15 THEN 0.0::DOUBLE ELSE value END WHEN 'error' THEN CASE WHEN value < 10 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE value END AS value,
        event_id::VARCHAR AS packet_id FROM events""",
    "vehicles": """SELECT 'v' || n AS vehicle_id, 'KA-' || lpad((n % 60)::VARCHAR, 2, '0') || '-EV-' || n AS reg_no,
        CASE n % 3 WHEN 0 THEN 'eTruck 19T' WHEN 1 THEN 'eTruck 28T' ELSE 'eVan 3.5T' END AS model
        FROM (SELECT DISTINCT user_id AS n FROM events WHERE user_id % 29 <> 7 UNION ALL SELECT c_custkey + 900000 FROM customer WHERE c_custkey <= 5)""",
    "latest": """SELECT vehicle_id, signal, event_time, value FROM
        (SELECT *, row_number() OVER (PARTITION BY vehicle_id, signal ORDER BY event_time DESC, ingest_time DESC, packet_id DESC) AS rn FROM log) WHERE rn = 1""",
    "aged": f"""SELECT *, greatest(0, date_diff('second', event_time, {NOW})) AS age FROM latest""",
    "state": """SELECT vehicle_id, max(CASE WHEN signal = 'soc' THEN value END) AS soc, max(CASE WHEN signal = 'soc' THEN event_time END) AS soc_at,
        max(CASE WHEN signal = 'range_km' THEN value END) AS range_km, max(CASE WHEN signal = 'range_km' THEN event_time END) AS range_at,
        max(CASE WHEN signal = 'speed' THEN value END) AS speed, max(CASE WHEN signal = 'speed' THEN event_time END) AS speed_at,
        max(CASE WHEN signal = 'ignition' THEN value END) AS ignition, max(CASE WHEN signal = 'ignition' THEN event_time END) AS ignition_at,
        max(CASE WHEN signal = 'battery_temp' THEN value END) AS battery_temp, max(CASE WHEN signal = 'battery_temp' THEN event_time END) AS battery_temp_at,
        max(event_time) AS last_ping FROM latest GROUP BY vehicle_id""",
    "conditions": f"""SELECT vehicle_id, CASE signal WHEN 'soc' THEN 'battery_soc' ELSE 'battery_temp' END AS kind, value AS trigger_value, event_time,
        CASE signal WHEN 'soc' THEN value < 20 ELSE value > 45 END AS breached,
        CASE WHEN signal = 'soc' AND value >= 10 THEN 'warning' ELSE 'critical' END AS severity
        FROM aged WHERE signal IN ('soc', 'battery_temp') AND age <= {STALE}""",
    "alerts": """SELECT md5(vehicle_id || kind || event_time::VARCHAR) AS alert_id, vehicle_id, kind,
        CASE WHEN kind = 'battery_soc' AND value >= 10 THEN 'warning' ELSE 'critical' END AS severity, value AS trigger_value,
        event_time AS opened_at, event_time AS last_seen_at,
        CASE WHEN n % 3 = 0 THEN event_time + INTERVAL 1 HOUR END AS resolved_at,
        CASE WHEN n % 7 = 0 THEN event_time + INTERVAL 2 HOUR END AS dismissed_at, CASE WHEN n % 7 = 0 THEN 'onIt' END AS dismiss_reason
        FROM (SELECT *, substr(vehicle_id, 2)::BIGINT AS n, CASE signal WHEN 'soc' THEN 'battery_soc' ELSE 'battery_temp' END AS kind,
                row_number() OVER (PARTITION BY vehicle_id, signal ORDER BY event_time DESC, packet_id DESC) AS rn
              FROM log WHERE event_time < TIMESTAMP '2024-01-29 00:00:00' AND ((signal = 'soc' AND value < 20) OR (signal = 'battery_temp' AND value > 45))) WHERE rn = 1""",
    "visible": f"""SELECT * FROM alerts a WHERE resolved_at IS NULL AND dismissed_at IS NULL AND EXISTS
        (SELECT 1 FROM aged l WHERE l.vehicle_id = a.vehicle_id AND l.signal = CASE a.kind WHEN 'battery_soc' THEN 'soc' ELSE 'battery_temp' END AND l.age <= {STALE})""",
    "rollup": "SELECT vehicle_id, count(*) AS open_alerts, max(CASE severity WHEN 'critical' THEN 2 ELSE 1 END) AS worst_rank FROM visible GROUP BY vehicle_id",
    "fleet": f"""SELECT vehicle_id, reg_no, model, soc, range_km, last_ping,
        CASE WHEN last_ping IS NULL OR date_diff('second', last_ping, {NOW}) > {OFFLINE} THEN 'offline'
             WHEN fresh_speed AND speed > 0 THEN 'moving'
             WHEN fresh_speed AND speed = 0 AND ignition = 1 AND date_diff('second', ignition_at, {NOW}) <= {STALE} THEN 'idle' ELSE 'stopped' END AS status,
        coalesce(open_alerts, 0) AS open_alerts, worst_rank
        FROM (SELECT *, speed IS NOT NULL AND date_diff('second', speed_at, {NOW}) <= {STALE} AS fresh_speed
              FROM vehicles LEFT JOIN state USING (vehicle_id) LEFT JOIN rollup USING (vehicle_id))""",
    "versions": """SELECT * FROM (VALUES
        ('f1', 1, 'North Depot', 12.9716::DOUBLE, 77.5946::DOUBLE, 2500.0::DOUBLE, true, TIMESTAMP '2020-01-01', TIMESTAMP '2024-01-12'),
        ('f1', 2, 'North Depot Wide', 12.9716, 77.5946, 3000.0, true, TIMESTAMP '2024-01-12', NULL),
        ('f2', 1, 'Customer Hub', 13.0100, 77.6400, 2800.0, true, TIMESTAMP '2020-01-01', NULL),
        ('f3', 1, 'Whitefield Yard', 12.9698, 77.7500, 600.0, true, TIMESTAMP '2020-01-01', TIMESTAMP '2024-01-20'),
        ('f3', 2, 'Whitefield Yard', 12.9698, 77.7500, 600.0, false, TIMESTAMP '2024-01-20', NULL),
        ('f4', 1, 'Bengaluru ORR', 12.9900, 77.6200, 4000.0, true, TIMESTAMP '2020-01-01', NULL))
        AS t(geofence_id, version, name, lat, lon, radius_m, active, valid_from, valid_to)""",
    "fix_rows": """SELECT *, 12.9716::DOUBLE + part * 0.0384::DOUBLE AS lat, 77.5946::DOUBLE + part * 0.0454::DOUBLE AS lon,
        CASE WHEN event_id % 23 = 0 THEN 150.0::DOUBLE ELSE 5.0::DOUBLE + event_id % 12 END AS accuracy_m FROM
        (SELECT *, 'v' || user_id AS vehicle_id, abs(((floor(epoch(ts) / 3600)::BIGINT + user_id * 5) % 120 - 60)::DOUBLE) / 60.0::DOUBLE AS part FROM events)""",
    "fixes": """SELECT vehicle_id, ts AS event_time, min(ts) AS ingest_time, min(event_id::VARCHAR) AS packet_id, max(lat) AS lat, max(lon) AS lon, max(accuracy_m) AS accuracy_m
        FROM fix_rows GROUP BY vehicle_id, ts""",
    "here": """SELECT vehicle_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS rn FROM fix_rows) WHERE rn = 1""",
    "inside": """SELECT vehicle_id, geofence_id, name, radius_m, row_number() OVER (PARTITION BY vehicle_id ORDER BY radius_m, geofence_id) AS rank
        FROM here h JOIN (SELECT geofence_id, name, lat AS flat, lon AS flon, radius_m FROM versions WHERE valid_to IS NULL AND active) g
        ON 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(flat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians(flon - lon) / 2), 2))) <= radius_m""",
    "event_edits": """SELECT 'g' || (user_id % 8) AS geofence_id, ts AS valid_from, max(event_id) AS n FROM events WHERE event_type = 'signup' GROUP BY ALL""",
    "event_versions": """SELECT geofence_id, row_number() OVER w::INTEGER AS version, 'Fence ' || geofence_id || '.' || (n % 9) AS name, 12.9716::DOUBLE + (n % 5)::DOUBLE / 125.0::DOUBLE AS lat, 77.5946::DOUBLE + (n % 7)::DOUBLE / 160.0::DOUBLE AS lon,
        600.0::DOUBLE + (n % 6)::DOUBLE * 500.0::DOUBLE AS radius_m, n % 11 <> 0 AS active, valid_from, lead(valid_from) OVER w AS valid_to FROM event_edits WINDOW w AS (PARTITION BY geofence_id ORDER BY valid_from)""",
    "at_fence": """SELECT f.vehicle_id, v.geofence_id, f.event_time, v.version, v.active, v.radius_m, greatest(25.0::DOUBLE, coalesce(f.accuracy_m, 0)) AS margin,
        2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(v.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - f.lon) / 2), 2))) AS d
        FROM fixes f JOIN versions v ON f.event_time >= v.valid_from AND (v.valid_to IS NULL OR f.event_time < v.valid_to)
        WHERE f.accuracy_m IS NULL OR f.accuracy_m <= 100""",
    "sided": """SELECT vehicle_id, geofence_id, event_time, CASE WHEN d <= radius_m - margin THEN true WHEN d >= radius_m + margin THEN false END AS inside FROM at_fence WHERE active""",
    "marked": """SELECT *, lag(inside) OVER w AS was, lag(event_time) OVER w AS prev FROM sided WHERE inside IS NOT NULL WINDOW w AS (PARTITION BY vehicle_id, geofence_id ORDER BY event_time)""",
    "numbered": """SELECT *, sum(CASE WHEN was IS DISTINCT FROM inside THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, geofence_id ORDER BY event_time) AS run FROM marked""",
    "runs": """SELECT vehicle_id, geofence_id, run, bool_and(inside) AS inside, min(event_time) AS event_time, min(prev) AS window_start, count(*) AS n FROM numbered GROUP BY ALL""",
    "believed": """SELECT *, lag(inside) OVER (PARTITION BY vehicle_id, geofence_id ORDER BY run) AS was FROM runs WHERE n >= 2 OR run = 1""",
    "crossed": """SELECT vehicle_id, geofence_id, CASE WHEN inside THEN 'entry' ELSE 'exit' END AS kind, event_time, window_start,
        coalesce(event_time - window_start > INTERVAL 12 HOUR, false) AS uncertain FROM believed WHERE was <> inside""",
    "firsts": """SELECT *, CASE WHEN kind = 'exit' AND row_number() OVER (PARTITION BY vehicle_id, geofence_id ORDER BY event_time) = 1 THEN 1 ELSE 0 END AS first_exit FROM crossed""",
    "legs": """SELECT *, sum(first_exit) OVER (PARTITION BY vehicle_id) + sum(CASE kind WHEN 'exit' THEN -1 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS around,
        lead(geofence_id) OVER w AS to_fence, lead(event_time) OVER w AS to_time, coalesce(lead(uncertain) OVER w, false) AS to_uncertain
        FROM firsts WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_time, CASE kind WHEN 'exit' THEN 1 ELSE 0 END, geofence_id)""",
    "trips": """SELECT md5(vehicle_id || geofence_id || event_time::VARCHAR) AS trip_id, vehicle_id, geofence_id AS origin_geofence_id, event_time AS started_at,
        to_fence AS destination_geofence_id, to_time AS ended_at, CASE WHEN to_time IS NULL THEN 'in_progress' ELSE 'completed' END AS status,
        uncertain AS start_uncertain, to_uncertain AS end_uncertain, NULL::DOUBLE AS distance_km FROM legs WHERE kind = 'exit' AND around = 0""",
    "packets_in": """SELECT vehicle_id, event_time + CASE WHEN n % 41 = 0 THEN INTERVAL 60 DAY ELSE INTERVAL 0 DAY END AS event_time, signal, value, n % 37 = 0 AS empty,
        n, CASE WHEN n % 2 = 0 THEN 'd' || n END AS device_id FROM (SELECT *, packet_id::BIGINT AS n FROM log)""",
    "named": """SELECT *, coalesce(device_id, sha256(vehicle_id || '|' || epoch_us(event_time)::VARCHAR || '|' || CASE WHEN empty THEN '' ELSE signal || '=' || value::VARCHAR END)) AS packet_id,
        CASE WHEN event_time > TIMESTAMP '2024-01-31 00:05:00' THEN 'clock_skew_future' WHEN empty THEN 'empty_packet' END AS reason FROM packets_in""",
    "rolled": """SELECT vehicle_id, signal, time_bucket(INTERVAL 300 SECOND, event_time) AS bucket_start, min(value) AS min_value, max(value) AS max_value,
        arg_max(value, event_time) AS last_value, max(event_time) AS last_event_time, count(*) AS sample_count FROM log WHERE event_time < TIMESTAMP '2024-01-24' GROUP BY ALL""",
}


def _with(body: str, extra: str = "", given: dict[str, str] | None = None) -> str:
    """A statement with the tables that it names and all that they are made of; extra: a table of its own; given: other definitions of some tables."""
    tables = _CTE | (given or {})
    needed: list[str] = []

    def add(text: str) -> None:
        import re

        for name in tables:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(tables[name])
                needed.append(name)

    add(body + extra)
    return "WITH " + ",\n".join([f"{n} AS ({tables[n]})" for n in needed] + [extra] * bool(extra)) + "\n" + body


_SPELLS = f"""SELECT vehicle_id, kind, opened_at, shown_at, CASE WHEN next_at < hides THEN next_at ELSE hides END AS hidden_at, CASE WHEN next_at < hides THEN 'resolved' ELSE 'stale' END AS why FROM (
  SELECT *, max(CASE WHEN opens THEN event_time END) OVER w AS opened_at, max(CASE WHEN shows THEN event_time END) OVER w AS shown_at FROM (
    SELECT *, bad AND NOT coalesce(was, false) AS opens, bad AND (NOT coalesce(was, false) OR date_diff('second', before, event_time) > {STALE}) AS shows, date_trunc('second', event_time) + INTERVAL {STALE + 1} SECOND AS hides FROM (
      SELECT *, lag(bad) OVER w AS was, lag(event_time) OVER w AS before, lead(event_time) OVER w AS next_at FROM (
        SELECT vehicle_id, CASE signal WHEN 'soc' THEN 'battery_soc' ELSE 'battery_temp' END AS kind, event_time, CASE signal WHEN 'soc' THEN value < 20 ELSE value > 45 END AS bad FROM log WHERE signal IN ('soc', 'battery_temp')) WINDOW w AS (PARTITION BY vehicle_id, kind ORDER BY event_time)))
  WINDOW w AS (PARTITION BY vehicle_id, kind ORDER BY event_time)) WHERE bad QUALIFY row_number() OVER (PARTITION BY vehicle_id, kind, opened_at, shown_at ORDER BY event_time DESC) = 1"""
_STEP = """SELECT alert_id, a.vehicle_id, a.kind,
  CASE WHEN {open} AND c.breached AND c.event_time >= last_seen_at THEN c.severity ELSE a.severity END AS severity,
  CASE WHEN {open} AND c.breached AND c.event_time >= last_seen_at THEN c.trigger_value ELSE a.trigger_value END AS trigger_value,
  opened_at, CASE WHEN {open} AND c.breached AND c.event_time >= last_seen_at THEN c.event_time ELSE last_seen_at END AS last_seen_at,
  CASE WHEN {open} AND NOT c.breached THEN c.event_time ELSE resolved_at END AS resolved_at, dismissed_at, dismiss_reason
FROM alerts a LEFT JOIN conditions c ON a.vehicle_id = c.vehicle_id AND a.kind = c.kind""".format(open="resolved_at IS NULL AND c.breached IS NOT NULL")
_OPENED = """SELECT md5(vehicle_id || kind || event_time::VARCHAR) AS alert_id, vehicle_id, kind, severity, trigger_value, event_time AS opened_at, event_time AS last_seen_at,
  NULL::TIMESTAMP AS resolved_at, NULL::TIMESTAMP AS dismissed_at, NULL::VARCHAR AS dismiss_reason FROM conditions c
WHERE breached AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.vehicle_id = c.vehicle_id AND a.kind = c.kind AND resolved_at IS NULL)
  AND md5(vehicle_id || kind || event_time::VARCHAR) NOT IN (SELECT alert_id FROM alerts)"""
_HISTORY = """SELECT vehicle_id, max(event_time) AS bucket_at, arg_max(value, event_time) AS value FROM (
  SELECT vehicle_id, event_time, value FROM log WHERE signal = 'soc' AND event_time >= TIMESTAMP '2024-01-24'
  UNION ALL SELECT vehicle_id, bucket_start, last_value FROM rolled WHERE signal = 'soc' AND bucket_start >= TIMESTAMP '2024-01-03')
GROUP BY vehicle_id, time_bucket(INTERVAL 10080 SECOND, event_time)"""
_REJECT = "CASE WHEN event_time > TIMESTAMP '2024-01-31 00:05:00' THEN 'clock_skew_future' WHEN empty THEN 'empty_packet' END"
_GRID = """SELECT vi, ki, 'v' || vi AS vehicle_id, TIMESTAMP '2024-01-31' - to_minutes((ki * 6 + CASE WHEN vi % 5 = 0 THEN 20 + vi % 40 ELSE 0 END)::INTEGER) AS event_time
  FROM (SELECT row_number() OVER () - 1 AS vi FROM supplier) v, range(0, 240) k(ki)"""
_SIM = "((vi * {a} + tick * {b} + (vi % 97) * (tick % 89)) % 1000003 * 48271 % {n})"
_NOISE = "((vi * {a} + ki * {b} + (vi % 97) * (ki % 89)) % 1000003 * 48271 % {n})"

#: Fences whose edits are the sign-ups.
_MANY = {"versions": "SELECT * FROM event_versions"}
_CHANGED = {"name": "CASE WHEN k % 2 = 0 THEN 'New ' || geofence_id ELSE name END", "lat": "CASE WHEN k % 3 = 0 THEN 13.0::DOUBLE ELSE lat END", "radius_m": "CASE WHEN k % 3 = 1 THEN 900.0::DOUBLE ELSE radius_m END", "active": "CASE WHEN k % 4 = 3 THEN false ELSE active END"}


def _edited(opens: str, now: str) -> str:
    """Versions after an edit of every fence: open ones that began before are closed and followed by the next, others are changed in place."""
    changed = ", ".join(f"{c} AS {n}" for n, c in _CHANGED.items())
    return _with(
        body=f"""SELECT * EXCLUDE (k, opens) FROM (
  SELECT * REPLACE (CASE WHEN opens THEN {now} ELSE valid_to END AS valid_to) FROM e WHERE valid_to IS NOT NULL OR opens
  UNION ALL SELECT * REPLACE ({changed}, version + 1 AS version, {now} AS valid_from, NULL AS valid_to) FROM e WHERE opens
  UNION ALL SELECT * REPLACE ({changed}) FROM e WHERE valid_to IS NULL AND NOT opens)""",
        extra=f"e AS (SELECT *, substr(geofence_id, 2)::INTEGER AS k, valid_to IS NULL AND {opens} AS opens FROM event_versions)",
    )


ORACLES = {
    "latest_readings": _with(body="SELECT * FROM latest"),
    "guarded_upsert": _with(body="SELECT * FROM latest"),
    "latest_pivot": _with(body="SELECT * FROM state"),
    "last_ping": _with(body="SELECT vehicle_id, max(event_time) AS last_ping FROM latest GROUP BY vehicle_id"),
    "fix_pivot": _with(body="SELECT vehicle_id, event_time, ingest_time, packet_id, round(lat, 9) AS lat, round(lon, 9) AS lon, accuracy_m FROM fixes"),
    "fleet_rows": _with(body="SELECT * FROM fleet"),
    "fleet_list_search": _with(body="SELECT * FROM fleet WHERE (reg_no ILIKE '%etruck%' OR model ILIKE '%etruck%') AND status = 'moving'"),
    "status_counts": _with(body="SELECT s.status, count(f.status) AS n FROM (VALUES ('moving'), ('idle'), ('stopped'), ('offline')) s(status) LEFT JOIN fleet f ON f.status = s.status GROUP BY s.status"),
    "readings_register": _with(
        body=f"""SELECT vehicle_id, place, s.signal, value, event_time, age_us,
  CASE WHEN event_time IS NULL THEN 'missing' WHEN age_us > {STALE} * 1000000::BIGINT THEN 'stale'
       WHEN (s.signal = 'soc' AND value < 20) OR (s.signal = 'battery_temp' AND value > 45) THEN 'alert' ELSE 'normal' END AS verdict
FROM (SELECT v.vehicle_id, s.place, s.signal, l.value, l.event_time, CASE WHEN l.event_time IS NOT NULL THEN greatest(0, epoch_us({NOW}) - epoch_us(l.event_time)) END AS age_us
      FROM vehicles v CROSS JOIN (VALUES (0, 'soc'), (1, 'range_km'), (2, 'speed'), (3, 'battery_temp'), (4, 'odometer'), (5, 'ignition')) s(place, signal)
      LEFT JOIN latest l ON l.vehicle_id = v.vehicle_id AND l.signal = s.signal) s"""
    ),
    "alert_conditions": _with(body="SELECT * FROM conditions"),
    "visible_alerts": _with(body="SELECT * FROM visible"),
    "alert_rollup": _with(body="SELECT * FROM rollup"),
    "active_alerts": _with(body="SELECT * FROM visible JOIN vehicles USING (vehicle_id)"),
    "alert_counts": _with(body="SELECT (SELECT count(*) FROM visible) AS active, (SELECT count(*) FROM alerts WHERE resolved_at IS NULL AND dismissed_at IS NOT NULL) AS dismissed"),
    "alert_step": _with(body=_STEP + "\nUNION ALL\n" + _OPENED),
    "alert_open_new": _with(body=_OPENED),
    "alert_dismiss": _with(body=f"SELECT * REPLACE (CASE WHEN alert_id = (SELECT min(alert_id) FROM alerts) THEN {NOW} ELSE dismissed_at END AS dismissed_at, CASE WHEN alert_id = (SELECT min(alert_id) FROM alerts) THEN 'wrongAlert' ELSE dismiss_reason END AS dismiss_reason) FROM alerts"),
    "alert_undo_dismiss": _with(body="SELECT * REPLACE (CASE WHEN alert_id <> (SELECT min(alert_id) FROM alerts WHERE dismissed_at IS NOT NULL) THEN dismissed_at END AS dismissed_at, CASE WHEN alert_id <> (SELECT min(alert_id) FROM alerts WHERE dismissed_at IS NOT NULL) THEN dismiss_reason END AS dismiss_reason) FROM alerts"),
    "geofence_containment": _with(body="SELECT * FROM inside"),
    "current_geofence": _with(body="SELECT * FROM inside WHERE rank = 1"),
    "geofence_list": _with(body="SELECT v.*, coalesce(n, 0) AS vehicle_count FROM versions v LEFT JOIN (SELECT geofence_id, count(*) AS n FROM inside GROUP BY geofence_id) USING (geofence_id) WHERE valid_to IS NULL"),
    "fence_version_asof": _with(body="SELECT vehicle_id, geofence_id, event_time, version, active FROM at_fence"),
    "fence_visits": _with(body="SELECT vehicle_id, geofence_id, event_time, version, active FROM at_fence WHERE d <= radius_m"),
    "fence_visits_many_versions": _with(body="SELECT vehicle_id, geofence_id, event_time, version, active FROM at_fence WHERE d <= radius_m", given=_MANY),
    "crossings_many_versions": _with(body="SELECT * FROM crossed", given=_MANY),
    "fence_scd2_edit": _edited(f"valid_from < {NOW}", NOW),
    "crossings": _with(body="SELECT * FROM crossed"),
    "trips": _with(body="SELECT * FROM trips"),
    "trip_list": _with(
        body="""SELECT t.*, o.name AS origin_name, d.name AS destination_name, floor(epoch(ended_at))::BIGINT - floor(epoch(started_at))::BIGINT AS duration_s FROM trips t
LEFT JOIN (SELECT geofence_id, arg_max(name, version) AS name FROM versions GROUP BY geofence_id) o ON o.geofence_id = origin_geofence_id
LEFT JOIN (SELECT geofence_id, arg_max(name, version) AS name FROM versions GROUP BY geofence_id) d ON d.geofence_id = destination_geofence_id"""
    ),
    "trips_in_progress": _with(body="SELECT count(*) AS n FROM trips WHERE status = 'in_progress'"),
    "soc_history": _with(body=_HISTORY),
    "recent_readings": _with(body="SELECT event_time, value FROM log WHERE vehicle_id = 'v5' AND signal = 'soc' ORDER BY event_time DESC, value DESC LIMIT 50"),
    "rollup_5min": _with(body="SELECT * FROM rolled"),
    "rollup_merge": _with(body="SELECT * FROM rolled"),
    "retention_survivors": _with(body="SELECT 'signal_readings' AS t, count(*) AS n FROM log WHERE event_time >= TIMESTAMP '2024-01-24' UNION ALL SELECT 'signal_rollups', count(*) FROM rolled UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'packets', count(*) FROM log WHERE event_time >= TIMESTAMP '2024-01-24'"),
    "ingest_rejects": _with(body="SELECT packet_id, vehicle_id, event_time, reason FROM (SELECT * FROM named UNION ALL SELECT * FROM named WHERE n % 10 = 0) WHERE reason IS NOT NULL"),
    "ingest_accounting": _with(
        body=f"""SELECT count(DISTINCT CASE WHEN reason IS NULL AND n % 3 <> 0 THEN n END) AS accepted, count(*) FILTER (WHERE reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL AND n % 3 <> 0 THEN n END) AS duplicates,
  count(*) FILTER (WHERE reason = 'clock_skew_future') AS clock_skew_future, count(*) FILTER (WHERE reason = 'empty_packet') AS empty_packet
FROM (SELECT *, {_REJECT} AS reason FROM (SELECT * FROM packets_in UNION ALL SELECT * FROM packets_in WHERE n % 10 = 0))"""
    ),
    "ingest_log_rows": _with(body="SELECT packet_id, vehicle_id, signal, event_time, value FROM named WHERE reason IS NULL AND n % 3 <> 0"),
    "ingest_touched": _with(body=f"SELECT vehicle_id, min(event_time) AS from_time FROM packets_in WHERE {_REJECT} IS NULL AND n % 3 <> 0 GROUP BY vehicle_id"),
    "ledger_rows": _with(body="SELECT packet_id, vehicle_id, event_time, ingest_time, 1::INTEGER AS signal_count FROM log"),
    "generate_vehicles": "SELECT 'v' || i AS vehicle_id, 'KA-' || lpad((i % 60 + 1)::VARCHAR, 2, '0') || '-EV-' || lpad(i::VARCHAR, 4, '0') AS reg_no, CASE i % 3 WHEN 0 THEN 'eTruck 19T' WHEN 1 THEN 'eTruck 28T' ELSE 'eVan 3.5T' END AS model FROM (SELECT row_number() OVER () - 1 AS i FROM supplier) t",
    "generate_signals": f"""WITH g AS ({_GRID}), d AS (SELECT *, greatest(3.0::DOUBLE, least(100.0::DOUBLE, 8.0::DOUBLE + 92.0::DOUBLE * abs(1.0::DOUBLE - 2.0::DOUBLE * (((ki + vi * 17) % 240)::DOUBLE / 240.0::DOUBLE)))) AS soc,
  CASE WHEN (vi + ki) % 7 < 3 THEN 0.0::DOUBLE ELSE round(15.0::DOUBLE + {_NOISE.format(a=31, b=17, n=6000)}::DOUBLE / 100.0::DOUBLE, 1) END AS speed FROM g)
SELECT vehicle_id, event_time, 'soc' AS signal, round(soc, 6) AS value FROM d
UNION ALL SELECT vehicle_id, event_time, 'speed', speed FROM d
UNION ALL SELECT vehicle_id, event_time, 'battery_temp', round(22.0::DOUBLE + {_NOISE.format(a=13, b=7, n=2800)}::DOUBLE / 100.0::DOUBLE, 1) FROM d
UNION ALL SELECT vehicle_id, event_time, 'range_km', round((soc * 4.2::DOUBLE)::DECIMAL(30, 12), 1)::DOUBLE FROM d
UNION ALL SELECT vehicle_id, event_time, 'odometer', round((120000.0::DOUBLE + vi * 137.0::DOUBLE + (700 - ki) * 1.7::DOUBLE)::DECIMAL(30, 9), 1)::DOUBLE FROM d
UNION ALL SELECT vehicle_id, event_time, 'ignition', CASE WHEN speed > 0 OR (vi + ki) % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM d""",
    "generate_positions": f"""WITH g AS ({_GRID}), p AS (SELECT *, (sin(2.0::DOUBLE * pi() * ki / 96.0::DOUBLE + vi) + 1.0::DOUBLE) / 2.0::DOUBLE AS part, {_NOISE.format(a=7919, b=104729, n=1000)}::DOUBLE / 1000.0::DOUBLE AS jitter FROM g WHERE ki % 2 = 0)
SELECT vehicle_id, event_time, s.signal, round(CASE s.signal WHEN 'lat' THEN 12.9716::DOUBLE + part * (13.01::DOUBLE - 12.9716::DOUBLE) + (jitter - 0.5::DOUBLE) * 0.00025::DOUBLE
  WHEN 'lon' THEN 77.5946::DOUBLE + part * (77.64::DOUBLE - 77.5946::DOUBLE) + (jitter - 0.5::DOUBLE) * 0.00025::DOUBLE
  ELSE CASE WHEN (vi + ki) % 23 = 0 THEN 150.0::DOUBLE + jitter * 200.0::DOUBLE ELSE 4.0::DOUBLE + jitter * 12.0::DOUBLE END END, 6) AS value
FROM p CROSS JOIN (VALUES ('lat'), ('lon'), ('gps_accuracy_m')) s(signal)""",
    "alert_replay": _with(
        body="""SELECT vehicle_id, kind, min(event_time) AS opened_at, max(CASE WHEN bad THEN event_time END) AS last_seen_at, min(CASE WHEN NOT bad THEN event_time END) AS resolved_at FROM
(SELECT *, sum(CASE WHEN bad AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id, kind ORDER BY event_time) AS run FROM
  (SELECT *, lag(bad) OVER (PARTITION BY vehicle_id, kind ORDER BY event_time) AS was FROM
    (SELECT vehicle_id, CASE signal WHEN 'soc' THEN 'battery_soc' ELSE 'battery_temp' END AS kind, event_time, CASE signal WHEN 'soc' THEN value < 20 ELSE value > 45 END AS bad FROM log WHERE signal IN ('soc', 'battery_temp'))))
WHERE run > 0 GROUP BY vehicle_id, kind, run"""
    ),
    "vehicle_trips_ranked": _with(
        body="""SELECT t.*, o.name AS origin_name, d.name AS destination_name, floor(epoch(ended_at))::BIGINT - floor(epoch(started_at))::BIGINT AS duration_s, row_number() OVER (ORDER BY started_at DESC, trip_id)::INTEGER AS nth FROM trips t
LEFT JOIN (SELECT geofence_id, arg_max(name, version) AS name FROM versions GROUP BY geofence_id) o ON o.geofence_id = origin_geofence_id
LEFT JOIN (SELECT geofence_id, arg_max(name, version) AS name FROM versions GROUP BY geofence_id) d ON d.geofence_id = destination_geofence_id
WHERE vehicle_id = 'v5' QUALIFY nth <= 50"""
    ),
    "simulated_ingest": f"""WITH s AS (SELECT value % 40 AS vi, value // 40 AS tick FROM (SELECT event_id AS value FROM events) t),
h AS (SELECT *, CASE WHEN {_SIM.format(a=11, b=29, n=20)} = 0 THEN 3 + {_SIM.format(a=5, b=3, n=4)} ELSE 0 END AS held FROM s)
SELECT 'v' || vi AS vehicle_id, signal, count(DISTINCT greatest(0, tick - held)) AS n, count(DISTINCT greatest(0, tick - held)) AS packets
FROM h CROSS JOIN (VALUES ('soc'), ('range_km'), ('speed'), ('battery_temp'), ('ignition'), ('odometer'), ('lat'), ('lon'), ('gps_accuracy_m')) g(signal) GROUP BY ALL""",
    "store_log": _with(body="SELECT vehicle_id, signal, event_time, value, packet_id FROM named WHERE reason IS NULL"),
    "store_latest": _with(body="SELECT vehicle_id, signal, max(event_time) AS event_time, arg_max(value, event_time) AS value FROM named WHERE reason IS NULL GROUP BY ALL"),
    "store_ledger": _with(body="SELECT packet_id, vehicle_id, event_time, 1::INTEGER AS signal_count FROM named WHERE reason IS NULL"),
    "store_rejected": _with(
        body="""SELECT packet_id, vehicle_id, event_time, reason FROM (SELECT * FROM named UNION ALL SELECT * FROM named WHERE n % 10 = 0 UNION ALL SELECT * FROM named WHERE n % 2 = 0 UNION ALL SELECT * FROM named WHERE n % 10 = 0)
WHERE reason IS NOT NULL"""
    ),
    "store_geofence_events": _with(body="SELECT * FROM crossed"),
    "store_trips": _with(body="SELECT * FROM trips"),
    "store_refresh": _with(body=_STEP + "\nUNION ALL\n" + _OPENED),
    "store_recompute": _with(body="SELECT * FROM crossed WHERE vehicle_id IN (SELECT vehicle_id FROM vehicles)"),
    "alert_conditions_scoped": _with(body="SELECT * FROM conditions WHERE vehicle_id IN (SELECT vehicle_id FROM log WHERE packet_id::BIGINT % 5 = 0)"),
    "geofence_dateline": _with(
        body="""SELECT vehicle_id, geofence_id, geofence_id AS name, radius_m, row_number() OVER (PARTITION BY vehicle_id ORDER BY radius_m, geofence_id)::INTEGER AS rank
FROM (SELECT vehicle_id, lat, CASE WHEN lon + 102.38::DOUBLE >= 180 THEN lon + 102.38::DOUBLE - 360 ELSE lon + 102.38::DOUBLE END AS lon FROM here) h
JOIN (VALUES ('d1', 12.99::DOUBLE, 179.99::DOUBLE, 2500.0::DOUBLE), ('d2', 13.0, -179.985, 3000.0), ('d3', 12.98, -180.0, 800.0), ('d4', 12.9, -179.5, 400000.0), ('d5', 12.985, 179.998, 60.0), ('d6', 60.0, 100.0, 9000000.0)) g(geofence_id, flat, flon, radius_m)
ON 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(flat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians(flon - lon) / 2), 2))) <= radius_m"""
    ),
    "geofence_list_active": _with(body="SELECT v.*, coalesce(n, 0) AS vehicle_count FROM versions v LEFT JOIN (SELECT geofence_id, count(*) AS n FROM inside GROUP BY geofence_id) USING (geofence_id) WHERE valid_to IS NULL AND active"),
    "fence_create": _with(
        body=f"""SELECT v.*, CASE WHEN geofence_id[1] = 's' THEN {NOW} ELSE (SELECT min(valid_from) FROM event_versions w WHERE w.geofence_id = v.geofence_id) END AS created_at FROM (
  SELECT * FROM event_versions UNION ALL
  SELECT * FROM (SELECT CASE WHEN s_suppkey < 4 THEN 'g' ELSE 's' END || s_suppkey AS geofence_id, 1, s_name, 12.9::DOUBLE + s_suppkey::DOUBLE / 10000.0::DOUBLE, 77.5::DOUBLE + s_nationkey::DOUBLE / 1000.0::DOUBLE, 300.0::DOUBLE + s_nationkey::DOUBLE * 100.0::DOUBLE, true,
    CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE {NOW} END, NULL FROM supplier) WHERE geofence_id NOT IN (SELECT geofence_id FROM event_versions)) v"""
    ),
    "fence_edit_same_instant": _edited("valid_from < (SELECT max(valid_from) FROM event_versions WHERE valid_to IS NULL)", "(SELECT max(valid_from) FROM event_versions WHERE valid_to IS NULL)"),
    "fence_versions_ranked": _with(body="SELECT *, row_number() OVER (ORDER BY geofence_id, version)::INTEGER AS nth FROM event_versions"),
    "store_retained": _with(body="SELECT * FROM crossed"),
    "alert_spells": _with(body=_SPELLS),
    "stream_alert_spells": _with(body=f"SELECT * FROM ({_SPELLS}) WHERE hidden_at < (SELECT max(event_time) FROM log WHERE signal IN ('soc', 'battery_temp'))"),
    "stream_crossings": _with(body="SELECT * FROM crossed"),
    "stream_trips": _with(body="SELECT * FROM trips"),
    "signal_percentiles": _with(
        body="""SELECT signal, p AS percent, min(value) AS value FROM (SELECT signal, value, row_number() OVER (PARTITION BY signal ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY signal) AS n FROM log), (VALUES (50), (95)) t(p)
WHERE place >= floor(p / 100.0::DOUBLE * (n - 1) + 0.5) GROUP BY signal, p"""
    ),
    "fix_first_received": _with(
        body="""SELECT vehicle_id, ts AS event_time, ts AS ingest_time, min(event_id::VARCHAR) AS packet_id, round(arg_min(lat, event_id::VARCHAR), 9) AS lat, round(arg_min(lon, event_id::VARCHAR), 9) AS lon, arg_min(accuracy_m, event_id::VARCHAR) AS accuracy_m
FROM fix_rows GROUP BY vehicle_id, ts"""
    ),
    "fleet_worst_severity": _with(body="SELECT vehicle_id, CASE worst_rank WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' END AS worst FROM fleet"),
    "fleet_list_ranked": _with(body="SELECT row_number() OVER (ORDER BY coalesce(worst_rank, 0) DESC, open_alerts DESC, reg_no)::INTEGER AS nth, vehicle_id FROM fleet"),
    "active_alerts_ranked": _with(body="SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, opened_at DESC, alert_id)::INTEGER AS nth, alert_id FROM visible JOIN vehicles USING (vehicle_id)"),
    "geofence_list_ranked": _with(body="SELECT row_number() OVER (ORDER BY active DESC, name, geofence_id)::INTEGER AS nth, geofence_id FROM versions WHERE valid_to IS NULL"),
    "soc_history_ranked": _with(body=f"SELECT row_number() OVER (ORDER BY vehicle_id, bucket_at)::INTEGER AS nth, vehicle_id, bucket_at FROM ({_HISTORY})"),
    "crossings_ranked": _with(body="SELECT row_number() OVER (ORDER BY event_time, geofence_id, kind, vehicle_id)::INTEGER AS nth, vehicle_id, geofence_id, kind, event_time FROM crossed"),
}
