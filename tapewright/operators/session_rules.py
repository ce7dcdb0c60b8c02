"""Rules about sessions and whole series: gaps, absences, thin tails, derived bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series
from ..session import settle
from .expected import absent_days
from .findings import findings
from .scope import SLICE, Scope, outside_roll

SESSION = [*SLICE, "root", "trade_date"]


class RuleRefused(Exception):
    """A rule declines to evaluate because an input it needs is absent."""


def require_calendar(scope: Scope) -> None:
    if scope.refusal:
        raise RuleRefused(scope.refusal)


def _in_window() -> Column:
    day = F.col("trade_date")
    return day.between(F.col("start_date"), F.col("end_date")) & outside_roll(day)


def session_missing(scope: Scope) -> DataFrame:
    require_calendar(scope)
    absent = absent_days(scope).withColumn("expected", F.coalesce("expected", F.lit(0)))
    return findings(absent, "CMP.SESSION_MISSING", {
        "window_basis": F.col("basis"), "expected_records": F.col("expected")}, affected=F.col("expected"))


def judged_sessions(scope: Scope) -> DataFrame:
    """Minute sessions that were held and whose slot grid is known."""
    return (
        scope.sessions.filter("frequency = 'minute' and root is not null").select(*SESSION)
        .join(scope.windows, SLICE)
        .join(scope.calendar.drop("exchange"), ["root", "trade_date"])
        .filter(_in_window() & ~F.col("is_holiday") & ~F.col("is_early_close")
                & F.col("expected_slots_1m").isNotNull())
    )


def _halted_before(instant: Column) -> Column:
    """Halted minutes of the session that lie before ``instant``."""
    return F.aggregate(
        "halts_utc", F.lit(0).cast("bigint"),
        lambda total, h: total + F.greatest(F.lit(0).cast("bigint"), F.floor(
            (F.unix_seconds(F.least(instant, h["end_utc"])) - F.unix_seconds(h["start_utc"])) / 60)),
    )


def _slot_instant(number: Column) -> Column:
    """Instant of the n-th open slot: each halt that starts at or before it pushes it back."""
    start = F.unix_seconds("session_open_utc") + number * 60
    seconds = F.aggregate(
        F.array_sort("halts_utc"), start,
        lambda at, h: F.when(
            at >= F.unix_seconds(h["start_utc"]),
            at + F.unix_seconds(h["end_utc"]) - F.unix_seconds(h["start_utc"])).otherwise(at),
    )
    return F.timestamp_seconds(seconds)


def missing_timestamp(scope: Scope) -> DataFrame:
    """Runs of open slots without a record, found between neighbours, not on a generated grid.

    Every present minute becomes its number among the session's open slots; a jump in that
    number is a run. Neighbours are compared inside a chunk of the series, in one scan, of which only jumps and the first
    and last number of each chunk are kept; those, with a sentinel at both ends of the session, are compared in turn.
    """
    require_calendar(scope)
    minimum = scope.params("CMP.MISSING_TIMESTAMP")["min_run_slots"]
    sessions = scope.judged.filter("session_open_utc is not null").select(
        *SESSION, "session_open_utc", "session_close_utc", "halts_utc")
    key = ["contract_id", "frequency", "trade_date"]
    slot = F.col("slot")
    inside = (slot >= F.col("session_open_utc")) & (slot < F.col("session_close_utc")) & ~F.exists(
        "halts_utc", lambda h: (slot >= h["start_utc"]) & (slot < h["end_utc"]))

    def number(instant: Column) -> Column:
        return F.floor((F.unix_seconds(instant) - F.unix_seconds("session_open_utc")) / 60) - _halted_before(instant)

    held = scope.slots.join(sessions, SESSION).filter(inside).select(*key, *series.CHUNK, number(slot).alias("no"))
    along = W.partitionBy(*key, *series.CHUNK).orderBy("no")
    least = F.greatest(F.lit(1), F.lit(minimum))
    kept = settle(held.withColumns({"before": F.lag("no").over(along), "after": F.lead("no").over(along)}).filter(
        F.col("before").isNull() | F.col("after").isNull() | (F.col("no") - F.col("before") - 1 >= least)).select(
        *key, "before", "after", "no"), "slot-ends")
    ends = sessions.select(*key, F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("no"), F.lit(False).alias("meets")),
        F.struct(number(F.col("session_close_utc")).alias("no"), F.lit(True).alias("meets")))).alias("end")).select(*key, "end.*")
    # the first number of a chunk and the end of a session meet the last number before them
    edges = kept.filter("before is null or after is null").select(*key, "no", F.col("before").isNull().alias("meets")).unionByName(ends)
    outer = edges.withColumn("before", F.lag("no").over(W.partitionBy(*key).orderBy("no", "meets"))).filter("meets").select(*key, "before", "no")
    inner = kept.filter("before is not null").select(*key, "before", "no")
    gaps = inner.unionByName(outer).withColumn("slots", F.col("no") - F.col("before") - 1).filter(
        F.col("slots") >= least).join(sessions, key)
    return findings(gaps, "CMP.MISSING_TIMESTAMP", {"missing_slots": F.col("slots")},
                    start=_slot_instant(F.col("before") + 1), end=_slot_instant(F.col("no") - 1),
                    affected=F.col("slots"))


def partial_session(scope: Scope) -> DataFrame:
    require_calendar(scope)
    threshold = float(scope.params("CMP.PARTIAL_SESSION")["threshold"])
    counted = F.count("*") if scope.hot_days is None else F.count_distinct("slot")
    slots = scope.slots.groupBy(*SESSION).agg(counted.alias("slots"))
    share = F.col("slots") / F.col("expected_slots_1m")
    short = scope.judged.filter("expected_slots_1m > 0").join(slots, SESSION).filter(share < threshold)
    return findings(short, "CMP.PARTIAL_SESSION", {
        "window_basis": F.col("basis"), "completeness_pct": F.round(share, 6), "threshold": F.lit(threshold),
        "actual_slots": F.col("slots"), "expected_slots": F.col("expected_slots_1m"),
    }, affected=F.col("expected_slots_1m") - F.col("slots"))


def sparse_series(scope: Scope) -> DataFrame:
    minimum = int(scope.params("CMP.SPARSE_SERIES")["min_sessions"])
    thin = scope.sessions.groupBy(*SLICE).agg(
        F.count_distinct("trade_date").alias("sessions"), F.min("trade_date").alias("first_session"),
        F.max("trade_date").alias("trade_date")).filter(F.col("sessions") < minimum)
    return findings(thin, "CMP.SPARSE_SERIES", {
        "sessions": F.col("sessions"), "min_sessions": F.lit(minimum),
        "first_session": F.col("first_session").cast("string"),
        "last_session": F.col("trade_date").cast("string")}, affected=F.col("sessions"))


def thin_near_expiry(scope: Scope) -> DataFrame:
    p = scope.params("ROL.THIN_NEAR_EXPIRY")
    return findings(scope.roll, "ROL.THIN_NEAR_EXPIRY", {
        "window_start": F.col("roll_start").cast("string"), "window_end": F.col("roll_end").cast("string"),
        "expiry_basis": F.col("expiry_basis"),
        "median_session_volume_inside": F.col("median_inside"),
        "median_session_volume_before": F.col("median_before"),
        "days": F.lit(p["days"]), "collapse_ratio": F.lit(p["collapse_ratio"]),
    }, trade_date=F.col("roll_end"))


def no_successor(scope: Scope) -> DataFrame:
    """Slices near expiry whose root holds no later delivery month."""
    days = int(scope.params("ROL.NO_SUCCESSOR")["days"])
    months = scope.tables.contracts.filter("contract_month is not null").select(
        "contract_id", "contract_month", "last_trade_date")
    slices = scope.sessions.filter("root is not null").groupBy(*SLICE, "root").agg(
        F.max("trade_date").alias("last_session")).join(months, "contract_id")
    latest = slices.groupBy("root").agg(F.max("contract_month").alias("latest_month"))
    expiry = F.coalesce("last_trade_date", "last_session")
    ends = slices.join(latest, "root").withColumn("expiry", expiry).filter(
        (F.abs(F.datediff("expiry", "last_session")) <= days)
        & (F.col("latest_month") <= F.col("contract_month")))
    return findings(ends, "ROL.NO_SUCCESSOR", {
        "last_session": F.col("last_session").cast("string"), "expiry": F.col("expiry").cast("string"),
        "root": F.col("root"), "days": F.lit(days)}, trade_date=F.col("last_session"))


def derived_bar_invalid(scope: Scope) -> DataFrame:
    """Daily bars of an earlier build that break their own range; severity follows provenance."""
    p = scope.params("CON.DERIVED_BAR_INVALID")
    if scope.tables.bars is None:
        raise RuleRefused("no bars have been built for the contracts in scope")
    held = scope.sessions.select("contract_id").distinct()
    bars = scope.tables.bars.filter(F.col("basis") == p["basis"]).join(held, "contract_id", "left_semi")
    if bars.isEmpty():
        raise RuleRefused(f"no {p['basis']} bars have been built for the contracts in scope")
    high, low = F.col("high"), F.col("low")
    outside = (F.col("open") < low) | (F.col("open") > high) | (F.col("close") < low) | (F.col("close") > high)
    broken = bars.filter((high < low) | (high.isNotNull() & low.isNotNull() & outside))
    vendor = F.col("source") == "vendor"
    return findings(broken, "CON.DERIVED_BAR_INVALID", {
        name: F.col(name) for name in ("basis", "source", "open", "high", "low", "close")
    }, severity=F.when(vendor, p["vendor_severity"]).otherwise("critical"),
        frequency=F.col("source_frequency"), start=F.col("first_ts_utc"), end=F.col("last_ts_utc"),
        affected=F.col("record_count"), subject=F.col("source"))


SESSION_RULES = {
    "CMP.MISSING_TIMESTAMP": missing_timestamp,
    "CMP.SESSION_MISSING": session_missing,
    "CMP.PARTIAL_SESSION": partial_session,
    "CMP.SPARSE_SERIES": sparse_series,
    "CON.DERIVED_BAR_INVALID": derived_bar_invalid,
    "ROL.THIN_NEAR_EXPIRY": thin_near_expiry,
    "ROL.NO_SUCCESSOR": no_successor,
}
