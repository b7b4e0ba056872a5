"""Alert conditions, what operators see of them, and the step of their life cycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import alert_id, at, epoch_s, is_fresh
from ..rules import SOC, TEMP, Rules
from ..sources.schemas import ALERTS

_NONE = Rules()
#: Alert kinds and the signals that drive them (fixed values).
KINDS = {"battery_soc": SOC, "battery_temp": TEMP}


def _signal_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, signal in KINDS.items():
        out = F.when(kind == name, signal).otherwise(out)
    return out


def alert_conditions(latest: DataFrame, now: datetime, rules: Rules = _NONE, touched: DataFrame | None = None) -> DataFrame:
    """One row per vehicle and condition that its reading is fresh enough to judge. touched: vehicle_id of those to judge."""
    rows = latest.filter(F.col("signal").isin(*KINDS.values()) & is_fresh(F.col("event_time"), now, rules))
    if touched is not None:
        rows = rows.join(touched.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    soc = F.col("signal") == SOC
    return rows.select(
        "vehicle_id",
        F.when(soc, "battery_soc").otherwise("battery_temp").alias("kind"),
        F.col("value").alias("trigger_value"),
        "event_time",
        F.when(soc, F.col("value") < rules.soc_warning).otherwise(F.col("value") > rules.temp_critical).alias("breached"),
        F.when(soc & (F.col("value") >= rules.soc_critical), "warning").otherwise("critical").alias("severity"),
    )


def visible_alerts(alerts: DataFrame, latest: DataFrame, now: datetime, rules: Rules = _NONE) -> DataFrame:
    """Open, undismissed alerts whose signal is fresh."""
    open_ = alerts.filter("resolved_at IS NULL AND dismissed_at IS NULL").withColumn("signal", _signal_of(F.col("kind")))
    fresh = latest.filter(is_fresh(F.col("event_time"), now, rules)).select("vehicle_id", "signal")
    return open_.join(fresh, ["vehicle_id", "signal"], "left_semi").select(*alerts.columns)


def alert_rollup(alerts: DataFrame, latest: DataFrame, now: datetime, rules: Rules = _NONE) -> DataFrame:
    worst = F.max(F.when(F.col("severity") == "critical", 2).otherwise(1))
    return visible_alerts(alerts, latest, now, rules).groupBy("vehicle_id").agg(F.count("*").alias("open_alerts"), worst.alias("worst_rank"))


def alert_order() -> list[Column]:
    """Critical ones first, then the newest."""
    return [F.when(F.col("severity") == "critical", 0).otherwise(1), F.col("opened_at").desc(), F.col("alert_id")]


def active_alerts(alerts: DataFrame, latest: DataFrame, vehicles: DataFrame, now: datetime, rules: Rules = _NONE, vehicle_id: str | None = None) -> DataFrame:
    """Visible alerts of registered vehicles, critical and newest first."""
    rows = visible_alerts(alerts, latest, now, rules).join(vehicles, "vehicle_id")
    if vehicle_id is not None:
        rows = rows.filter(F.col("vehicle_id") == vehicle_id)
    return rows.orderBy(*alert_order())


def active_count(alerts: DataFrame, latest: DataFrame, now: datetime, rules: Rules = _NONE) -> DataFrame:
    """Visible alerts, those of unregistered vehicles too."""
    return visible_alerts(alerts, latest, now, rules).agg(F.count("*").alias("n"))


def dismissed_count(alerts: DataFrame) -> DataFrame:
    return alerts.filter("dismissed_at IS NOT NULL AND resolved_at IS NULL").agg(F.count("*").alias("n"))


def step(alerts: DataFrame, conditions: DataFrame) -> DataFrame:
    """The alerts after one evaluation: cleared ones resolved, open ones brought up to date, new ones opened.

    One left join and one anti join; alerts stay one row each.
    """
    judged = conditions.select("vehicle_id", "kind", *[F.col(c).alias(f"e_{c}") for c in ("trigger_value", "event_time", "breached", "severity")])
    rows = alerts.join(judged, ["vehicle_id", "kind"], "left")
    open_ = F.col("resolved_at").isNull() & F.col("e_breached").isNotNull()
    clears, moves = open_ & ~F.col("e_breached"), open_ & F.col("e_breached") & (F.col("e_event_time") >= F.col("last_seen_at"))
    old = rows.select(
        "alert_id",
        "vehicle_id",
        "kind",
        F.when(moves, F.col("e_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(moves, F.col("e_trigger_value")).otherwise(F.col("trigger_value")).alias("trigger_value"),
        "opened_at",
        F.when(moves, F.col("e_event_time")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(clears, F.col("e_event_time")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        "dismissed_at",
        "dismiss_reason",
    )
    return old.unionByName(opened(alerts, conditions))


def opened(alerts: DataFrame, conditions: DataFrame) -> DataFrame:
    """Alerts for breached conditions for which none is open; an id that exists already is not opened again."""
    fresh = conditions.filter("breached").join(alerts.filter("resolved_at IS NULL"), ["vehicle_id", "kind"], "left_anti")
    nothing = {"resolved_at": "timestamp_ntz", "dismissed_at": "timestamp_ntz", "dismiss_reason": "string"}
    rows = fresh.select(
        alert_id(F.col("vehicle_id"), F.col("kind"), F.col("event_time")).alias("alert_id"),
        "vehicle_id",
        "kind",
        "severity",
        "trigger_value",
        F.col("event_time").alias("opened_at"),
        F.col("event_time").alias("last_seen_at"),
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
    )
    return rows.join(alerts.select("alert_id"), "alert_id", "left_anti").select(*ALERTS.fieldNames())


def dismiss(alerts: DataFrame, alert: str, reason: str, now: datetime) -> DataFrame:
    hit = F.col("alert_id") == alert
    return alerts.withColumns({"dismissed_at": F.when(hit, at(now)).otherwise(F.col("dismissed_at")), "dismiss_reason": F.when(hit, reason).otherwise(F.col("dismiss_reason"))})


def undo_dismiss(alerts: DataFrame, alert: str) -> DataFrame:
    hit = F.col("alert_id") == alert
    return alerts.withColumns({c: F.when(~hit, F.col(c)) for c in ("dismissed_at", "dismiss_reason")})


def alert_readings(log: DataFrame, rules: Rules = _NONE) -> DataFrame:
    """The readings that drive alerts, by kind, and whether each is a breach."""
    soc = F.col("signal") == SOC
    breached = F.when(soc, F.col("value") < rules.soc_warning).otherwise(F.col("value") > rules.temp_critical)
    return log.filter(F.col("signal").isin(*KINDS.values())).select("vehicle_id", F.when(soc, "battery_soc").otherwise("battery_temp").alias("kind"), "event_time", "value", breached.alias("breached"))


def replay(log: DataFrame, rules: Rules = _NONE) -> DataFrame:
    """Alert instances as a pure function of the log: runs of breached readings, whatever the batches were.

    An instance opens with the first breached reading of a run and resolves with the
    next reading that is not breached.
    """
    order = Window.partitionBy("vehicle_id", "kind").orderBy("event_time")
    change = F.when(F.col("breached") & ~F.coalesce(F.lag("breached").over(order), F.lit(False)), 1).otherwise(0)
    runs = alert_readings(log, rules).withColumn("starts", change).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.filter("run > 0").groupBy("vehicle_id", "kind", "run").agg(F.min("event_time").alias("opened_at"), F.max(F.when(F.col("breached"), F.col("event_time"))).alias("last_seen_at"), F.min(F.when(~F.col("breached"), F.col("event_time"))).alias("resolved_at")).drop("run")


def alert_spells(log: DataFrame, rules: Rules = _NONE) -> DataFrame:
    """When each alert instance is visible, as a pure function of the log: from a breach until a reading clears it, or until no reading is fresh any more; a further breach shows it again."""
    order = Window.partitionBy("vehicle_id", "kind").orderBy("event_time")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = alert_readings(log, rules).withColumns({"was": F.coalesce(F.lag("breached").over(order), F.lit(False)), "before": F.lag("event_time").over(order), "then": F.lead("event_time").over(order)})
    hides = F.timestamp_seconds(epoch_s(F.col("event_time")) + rules.stale_s + 1).cast("timestamp_ntz")
    opens = F.col("breached") & ~F.col("was")
    shows = F.col("breached") & (~F.col("was") | (epoch_s(F.col("event_time")) - epoch_s(F.col("before")) > rules.stale_s))
    rows = rows.withColumns({"hides": hides, "opened_at": F.last(F.when(opens, F.col("event_time")), ignorenulls=True).over(upto), "shown_at": F.last(F.when(shows, F.col("event_time")), ignorenulls=True).over(upto)}).filter("breached")
    last = F.max_by(F.struct("hides", "then"), "event_time").alias("r")
    spells = rows.groupBy("vehicle_id", "kind", "opened_at", "shown_at").agg(last)
    cleared = F.col("r.then") < F.col("r.hides")  # else the next breach would belong to the spell
    return spells.select("vehicle_id", "kind", "opened_at", "shown_at", F.when(cleared, F.col("r.then")).otherwise(F.col("r.hides")).alias("hidden_at"), F.when(cleared, "resolved").otherwise("stale").alias("why"))
