"""Daily bars from either grain, on either basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import lookup
from ..functions import order
from .cleaning import clean_records, marked_removed

SOURCES = {"derived": ("minute", "last_trade"), "vendor": ("daily", "settlement")}
BAR = ["contract_id", "trade_date"]


def basis_records(records: DataFrame, basis: str, actions: DataFrame | None = None) -> DataFrame:
    """Raw records as they are, clean ones without what the decisions removed."""
    if basis not in ("raw", "clean"):
        raise ValueError(f"unknown basis {basis!r}")
    return records if basis == "raw" or actions is None else clean_records(records, actions)


def _sides(basis: str, kept: Column) -> list[Column]:
    """Aggregates of one basis over the records of a session that ``kept`` marks."""
    key = F.when(kept, F.col("at"))

    def held(name: str) -> Column:
        return F.when(kept, F.col(name))

    columns = {
        "open": F.min_by("open", key), "high": F.max(held("high")), "low": F.min(held("low")), "close": F.max_by("close", key),
        "volume": F.sum(held("volume")),
        "open_interest": F.max_by("open_interest", F.when(F.col("open_interest").isNotNull(), key)),
        "first_ts_utc": F.min(held("ts_utc")), "last_ts_utc": F.max(held("ts_utc")), "record_count": F.count_if(kept),
        "volume_null_count": F.count_if(kept & F.col("volume").isNull()),
    }
    return [c.alias(f"{basis}_{name}") for name, c in columns.items()]


VALUES = ["open", "high", "low", "close", "volume", "open_interest", "first_ts_utc", "last_ts_utc", "record_count", "volume_null_count"]


def bars_of(
    records: DataFrame, actions: DataFrame | None = None, bases: tuple[str, ...] = ("raw", "clean"),
    sources: tuple[str, ...] = ("derived", "vendor"),
) -> DataFrame:
    """One bar per contract, session, source and basis; edge values keep their nulls, open interest does not.

    Every basis of both grains comes from one scan and one hash aggregate: a record that a decision removed counts for the
    raw basis alone. A session whose records are all removed has no clean bar.
    """
    for basis in bases:
        if basis not in ("raw", "clean"):
            raise ValueError(f"unknown basis {basis!r}")
    grains = {SOURCES[source][0]: source for source in sources}
    rows = records.filter(F.col("frequency").isin(*grains))
    kept = F.lit(True)
    if actions is not None and "clean" in bases:
        rows = rows.join(marked_removed(actions), "record_id", "left")
        kept = F.col("gone").isNull()
    sides = [c for basis in bases for c in _sides(basis, kept if basis == "clean" else F.lit(True))]
    wide = rows.withColumn("at", order.in_session()).groupBy(*BAR, "frequency").agg(*sides)
    each = F.explode(F.array(*[
        F.struct(*[F.col(f"{basis}_{name}").alias(name) for name in VALUES], F.lit(basis).alias("basis")) for basis in bases]))
    bar = wide.select(*BAR, F.col("frequency").alias("source_frequency"), each.alias("bar")).filter("bar.record_count > 0")
    return bar.select(
        *BAR, *[F.col(f"bar.{name}") for name in VALUES], lookup({f: s for f, s in grains.items()}, F.col("source_frequency")).alias("source"),
        "source_frequency", lookup({f: SOURCES[s][1] for f, s in grains.items()}, F.col("source_frequency")).alias("close_convention"),
        F.col("bar.basis").alias("basis"))


def bar_provenance(bars: DataFrame, contracts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Session boundary text, expected slots and completeness beside each bar."""
    venue = contracts.select("contract_id", "root", "exchange")
    sessions = calendar.select(
        "exchange", "root", "trade_date", "session_open_utc", "session_close_utc", "expected_slots_1m")
    derived = F.col("source") == "derived"
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    span = F.coalesce(F.concat(
        F.date_format("session_open_utc", iso), F.lit("/"), F.date_format("session_close_utc", iso)),
        F.lit("unresolved"))
    place = F.concat(F.coalesce("exchange", F.lit("?")), F.lit(":"), F.coalesce("root", F.lit("?")), F.lit(":"))
    slots = F.when(derived, F.col("expected_slots_1m"))
    return bars.join(venue, "contract_id", "left").join(sessions, ["exchange", "root", "trade_date"], "left").select(
        *bars.columns, F.concat(place, F.when(derived, span).otherwise("vendor-date-column")).alias("session_boundary"),
        slots.alias("expected_count"),
        F.when(slots > 0, F.col("record_count") * 100.0 / slots).alias("completeness_pct"))


def annotate_bars(bars: DataFrame, quality: DataFrame) -> DataFrame:
    """Finding count and worst severity of the bar's session at its own grain."""
    q = quality.select("contract_id", F.col("frequency").alias("source_frequency"), "trade_date",
                       "finding_count", "max_severity")
    return bars.join(q, ["contract_id", "source_frequency", "trade_date"], "left").withColumn(
        "finding_count", F.coalesce("finding_count", F.lit(0)))


def daily_bars(records: DataFrame, basis: str = "clean", actions: DataFrame | None = None) -> DataFrame:
    """Bars derived from the minute tape."""
    return bars_of(records, actions, (basis,), ("derived",))


def vendor_bars(records: DataFrame, basis: str = "clean", actions: DataFrame | None = None) -> DataFrame:
    """Bars from supplied daily rows."""
    return bars_of(records, actions, (basis,), ("vendor",))


def build_bars(records: DataFrame, actions: DataFrame | None = None, bases: tuple[str, ...] = ("raw", "clean")) -> DataFrame:
    """Every basis and source in one relation, keyed contract, date, basis, source."""
    return bars_of(records, actions, bases)


def read_bars(
    bars: DataFrame, contract_id: str | None = None, trade_date=None, basis: str = "clean",
    source: str = "derived",
) -> DataFrame:
    """Stored bars of one basis and source, in reading order, no gate applied."""
    wanted = (F.col("basis") == basis) & (F.col("source") == source)
    if contract_id is not None:
        wanted = wanted & (F.col("contract_id") == contract_id)
    if trade_date is not None:
        wanted = wanted & (F.col("trade_date") == F.lit(trade_date).cast("date"))
    return bars.filter(wanted).orderBy(*BAR)


def bar_struct() -> Column:
    return F.struct("open", "high", "low", "close", "volume")
