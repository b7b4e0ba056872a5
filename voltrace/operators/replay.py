"""Crossings and trips derived incrementally, from states that are kept by day.

What a vehicle's crossings of a fence go on from is a small state (schema CROSSING_STATE). The state after a vehicle's
newest fix is kept, and the states at the end of each of its earlier days. Readings that are newer than all before go on
from the former. Late ones go back to the last day before them: the fold starts from the state of that day and
reads the log from there on, so older days are never opened. Retention keeps the state at its cut-off in the same
way, so what the dropped readings have shown is still known: nothing derived is lost when readings come late after it.

A row whose fence is SELF stands for the vehicle: last_time is its newest position row, since and before are the first and
last trusted fix of that day. They tell where a vehicle was that has never been near a fence: outside (outside_before). A fence that
was near while no fix said anything of it, being in the band around the edge or before the fence was in force, has a row without fixes: it is looked at from then on.

States of days are appended only, each with the number of its publish. A replay writes all states behind its
start again, so of one vehicle and day those of the newest SELF row count.
"""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at
from ..rules import POSITION, Rules
from ..sources.schemas import CROSSING_DAYS, CROSSING_STATE
from .current import location_fixes
from .geofence import confirmed, near_pairs, outside_before, sides, state_after, state_of, steps
from .trips import trips

_NONE = Rules()
SELF = ""


class Keep(Protocol):
    """How frames are kept that several results are made of."""

    def cut(self, df: DataFrame) -> DataFrame:
        """Store and read again: what is made of it has a short plan and doesn't depend on an executor."""


class _Plain:
    def cut(self, df: DataFrame) -> DataFrame:
        return df


PLAIN = _Plain()
_PAIR = ["vehicle_id", "geofence_id"]


def day_of(t: Column | str) -> Column:
    return F.to_date(t)


def _end(day: Column | str) -> Column:
    return F.date_add(day, 1).cast("timestamp_ntz")


def _of(rows: DataFrame, vehicles: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(vehicles.select("vehicle_id").distinct(), "vehicle_id", how)


def _shaped(rows: DataFrame, schema=CROSSING_STATE) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def position_days(fixes: DataFrame, rules: Rules = _NONE) -> DataFrame:
    """Per vehicle and day of fixes (incomplete ones too): last_time, the newest, and since and before, the first and last trusted one."""
    trusted = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= rules.max_accuracy_m))
    at_fix = F.when(trusted, F.col("event_time"))
    return fixes.groupBy("vehicle_id", day_of("event_time").alias("day")).agg(F.min(at_fix).alias("since"), F.max(at_fix).alias("before"), F.max("event_time").alias("last_time"))


def _as_self(days: DataFrame) -> DataFrame:
    return days.withColumns({"geofence_id": F.lit(SELF), "believed": F.lit(None).cast("boolean"), "inside": F.lit(False), "fixes": F.lit(0)})


def _undecided(pairs: DataFrame) -> DataFrame:
    """State of pairs that are near without anything known of them: no fix with a side yet."""
    nothing = {"believed": F.lit(None).cast("boolean"), "inside": F.lit(False), "since": F.col("near_at"), "before": F.lit(None).cast("timestamp_ntz"), "last_time": F.col("near_at"), "fixes": F.lit(0)}
    return pairs.select(*_PAIR, *[v.alias(c) for c, v in nothing.items()])


def valid_days(days: DataFrame) -> DataFrame:
    """States of days (schema CROSSING_DAYS) without those that a later replay has replaced."""
    newest = days.filter(F.col("geofence_id") == SELF).groupBy("vehicle_id", "as_of").agg(F.max("made").alias("made"))
    return days.join(newest, ["vehicle_id", "as_of", "made"], "left_semi")


def started(moved: DataFrame, state: DataFrame, days: DataFrame, cutoff: datetime | None) -> DataFrame:
    """moved (vehicle_id, from_time: its earliest new position row) with late, and for late vehicles base: the last moment whose state is known and that is not after the day of from_time.

    cutoff: readings before it are gone; a fold doesn't go back behind it. base is null if the vehicle is to be folded from its first reading.
    """
    had = state.filter(F.col("geofence_id") == SELF).select("vehicle_id", "last_time")
    limit = day_of("from_time").cast("timestamp_ntz")
    rows = moved.withColumn("limit", F.greatest(limit, at(cutoff)) if cutoff else limit).join(had, "vehicle_id", "left")
    rows = rows.withColumn("late", F.col("last_time").isNull() | (F.col("from_time") <= F.col("last_time")))
    ends = days.filter(F.col("geofence_id") == SELF).select("vehicle_id", "as_of")
    bases = rows.filter("late").select("vehicle_id", "limit").join(ends, "vehicle_id").filter("as_of <= limit").groupBy("vehicle_id").agg(F.max("as_of").alias("base"))
    return rows.join(bases, "vehicle_id", "left").select("vehicle_id", "late", "base")


def derive(
    rows: DataFrame, marked: DataFrame, tables: dict[str, DataFrame], rules: Rules = _NONE, cutoff: datetime | None = None, made: int = 0, keep: Keep = PLAIN
) -> dict[str, DataFrame]:
    """geofence_events, crossing_state and trips as they are after some readings, and the states of days to append to crossing_days.

    rows: of late vehicles all readings from their base on, of others the new ones. marked: vehicle_id, late, base (from started).
    tables: geofence_versions, geofence_events, crossing_state, trips, and crossing_days (from valid_days). keep: stores what several results are made of.
    """
    versions, late, others = tables["geofence_versions"], marked.filter("late"), marked.filter("NOT late")
    rows = rows.filter(F.col("signal").isin(*POSITION))
    is_self = F.col("geofence_id") == SELF

    # where the fold starts from
    before_base = tables["crossing_days"].join(late.filter("base IS NOT NULL").select("vehicle_id", "base"), "vehicle_id").filter("as_of <= base")
    before_base = keep.cut(before_base)
    back = before_base.filter(~is_self).groupBy(*_PAIR).agg(F.max_by(F.struct("believed", "inside", "since", "before", "last_time", "fixes"), "as_of").alias("r")).select(*_PAIR, "r.*")
    own = _of(tables["crossing_state"], others)
    seeds = back.unionByName(own.filter(~is_self))
    past = before_base.filter(is_self).select("vehicle_id", "since", "before").unionByName(_of(tables["crossing_days"], others).filter(is_self).select("vehicle_id", "since", "before"))
    past = past.unionByName(own.filter(is_self).select("vehicle_id", "since", "before"))
    instants = keep.cut(location_fixes(rows, complete=False))
    fixes = instants.dropna(subset=["lat", "lon"])
    near = keep.cut(near_pairs(fixes, versions, rules))
    unseen = near.join(seeds, _PAIR, "left_anti")
    seeds = seeds.unionByName(outside_before(unseen, past, versions))
    seeds = keep.cut(seeds.unionByName(_undecided(unseen.join(seeds, _PAIR, "left_anti"))))
    line = keep.cut(steps(sides(fixes, versions, rules, seeds), rules, seeds))

    # crossings: what the fold has not seen stays
    bound = F.coalesce("base", at(cutoff)) if cutoff else F.col("base")
    starts = late.select("vehicle_id", F.lit(True).alias("again"), bound.alias("bound"))
    pending = _of(back, late).filter("believed <> inside").select(*_PAIR, F.col("since").alias("open_since"))
    old = tables["geofence_events"].join(starts, "vehicle_id", "left").join(pending, _PAIR, "left")
    stays = F.col("again").isNull() | F.coalesce((F.col("event_time") < F.col("bound")) & (F.col("open_since").isNull() | (F.col("event_time") < F.col("open_since"))), F.lit(False))
    events = keep.cut(old.filter(stays).select(*tables["geofence_events"].columns).unionByName(confirmed(line, rules)))

    # states after the newest fix
    state = _shaped(state_after(line, seeds))
    held = own.filter(is_self).select("vehicle_id", F.lit(True).alias("open"), day_of("last_time").alias("day"), "since", "before", "last_time")
    base_self = before_base.filter(is_self).groupBy("vehicle_id").agg(F.max_by(F.struct("since", "before", "last_time"), "as_of").alias("r"))
    held = held.unionByName(base_self.select("vehicle_id", F.lit(False).alias("open"), day_of("r.last_time").alias("day"), "r.*"))
    days = position_days(instants, rules).withColumn("open", F.lit(True)).unionByName(held)
    days = days.groupBy("vehicle_id", "day").agg(F.max("open").alias("open"), F.min("since").alias("since"), F.max("before").alias("before"), F.max("last_time").alias("last_time"))
    days = keep.cut(days)
    newest = days.groupBy("vehicle_id").agg(F.max("day").alias("last_day"), F.max_by(F.struct("since", "before", "last_time"), "day").alias("r"))
    state = state.unionByName(_shaped(_as_self(newest.select("vehicle_id", "r.*"))))

    # states at the end of days that are over
    ended = days.filter("open").join(newest.select("vehicle_id", "last_day"), "vehicle_id").filter("day < last_day").drop("last_day", "open")
    by_day = state_of(line, day_of("event_time").alias("day"))
    # of a day that the new readings leave behind, or in which a fence was near first
    held_over = _of(seeds, others).unionByName(_of(seeds.filter("fixes = 0"), late))
    by_day = by_day.unionByName(held_over.withColumn("day", day_of("last_time")))
    by_day = by_day.groupBy(*_PAIR, "day").agg(F.max_by(F.struct("believed", "inside", "since", "before", "last_time", "fixes"), F.struct(F.col("fixes") > 0, "last_time")).alias("r")).select(*_PAIR, "day", "r.*")
    closed = by_day.join(ended.select("vehicle_id", "day"), ["vehicle_id", "day"], "left_semi").unionByName(_as_self(ended))
    closed = closed.withColumns({"as_of": _end("day"), "made": F.lit(made).cast("long")})

    return {
        "geofence_events": events,
        "crossing_state": _of(tables["crossing_state"], marked, "left_anti").unionByName(state),
        "crossing_days": _shaped(closed, CROSSING_DAYS),
        "trips": _of(tables["trips"], marked, "left_anti").unionByName(trips(_of(events, marked))),
    }


def from_base(rows: DataFrame, late: DataFrame) -> DataFrame:
    """The readings of late vehicles from their base on."""
    return rows.join(late.select("vehicle_id", "base"), "vehicle_id").filter("base IS NULL OR event_time >= base").drop("base")


def at_cutoff(log: DataFrame, tables: dict[str, DataFrame], raw: datetime, cutoff: datetime | None, made: int, rules: Rules = _NONE, keep: Keep = PLAIN) -> DataFrame:
    """States (schema CROSSING_DAYS, as_of raw) of all vehicles after their fixes before raw; log: the readings before raw that are there still."""
    state = tables["crossing_state"]
    idle = state.filter((F.col("geofence_id") == SELF) & (F.col("last_time") < at(raw)))
    carried = _of(state, idle)
    rows = log.filter(F.col("signal").isin(*POSITION))
    ends = tables["crossing_days"].filter(F.col("geofence_id") == SELF).select("vehicle_id", "as_of").filter(F.col("as_of") <= at(raw))
    known = rows.select("vehicle_id").unionByName(ends.select("vehicle_id")).distinct()
    folded = _of(known, idle, "left_anti").join(ends.groupBy("vehicle_id").agg(F.max("as_of").alias("base")), "vehicle_id", "left").select("vehicle_id", F.lit(True).alias("late"), "base")
    folded = keep.cut(folded)
    found = derive(from_base(rows, folded), folded, tables | {"crossing_state": state.limit(0)}, rules, cutoff, made, keep)["crossing_state"]
    return _shaped(carried.unionByName(found).withColumns({"as_of": at(raw), "made": F.lit(made).cast("long")}), CROSSING_DAYS)
