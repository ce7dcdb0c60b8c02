"""The record set, windows and small tables one rule pass works over."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import rule_params
from ..functions import order, series
from ..session import settle, shared_once, small
from ..sources.reference import calendar_for_loaded, tick_dim

SLICE = ["contract_id", "frequency"]
#: What the laid-out records carry.
LAID_OUT = [
    "record_id", *SLICE, "root", "trade_date", "ts_utc", "batch_id", "source_row", "open", "high", "low", "close", "volume", "open_interest"]


@dataclass
class Tables:
    """Input tables of a pass; ``actions`` and ``bars`` come from earlier passes, if any.

    ``products`` and ``ticks``, in the columns of ``product_dim`` and ``tick_dim``, replace the built-in dimensions.
    """

    records: DataFrame
    contracts: DataFrame
    batches: DataFrame
    calendar: DataFrame | None = None
    actions: DataFrame | None = None
    bars: DataFrame | None = None
    products: DataFrame | None = None
    ticks: DataFrame | None = None


def scope_records(
    records: DataFrame, contracts: DataFrame, batches: DataFrame, batch: str | None = None,
    contract_ids: list[str] | None = None, frequencies: list[str] | None = None,
) -> DataFrame:
    """Filtered records with the reference and batch context a rule needs."""
    if batch is not None:
        records = records.filter(F.col("batch_id") == batch)
    if contract_ids:
        records = records.filter(F.col("contract_id").isin(contract_ids))
    if frequencies:
        records = records.filter(F.col("frequency").isin(frequencies))
    bounds = contracts.select("contract_id", "root", "exchange", "first_trade_date", "last_trade_date")
    interval = batches.select("batch_id", "bar_interval", "inferred_interval", "source_timezone")
    return records.join(small(bounds), "contract_id", "left").join(small(interval), "batch_id", "left")


def session_days(records: DataFrame) -> DataFrame:
    """One row per contract, grain, session and UTC day: the only full aggregate of a scope."""
    return records.groupBy(*SLICE, "root", "trade_date", F.to_date("ts_utc").alias("utc_day")).agg(
        F.count("*").alias("records"),
        F.sum(F.coalesce("volume", F.lit(0))).alias("volume"),
        F.min("ts_utc").alias("first_ts_utc"),
        F.max("ts_utc").alias("last_ts_utc"),
    )


def coverage_windows(sessions: DataFrame, contracts: DataFrame, floor: float) -> DataFrame:
    """Dates a slice is expected to cover: liquid sessions, else listing, else what was seen."""
    liquid = F.when(F.col("volume") > floor, F.col("trade_date"))
    spans = sessions.groupBy(*SLICE).agg(
        F.min(liquid).alias("liquid_from"), F.max(liquid).alias("liquid_to"),
        F.min("trade_date").alias("seen_from"), F.max("trade_date").alias("seen_to"),
    )
    listed = F.col("first_trade_date").isNotNull() & F.col("last_trade_date").isNotNull()

    def pick(liquid_col: str, listed_col: str, seen_col: str) -> Column:
        return F.when(F.col("liquid_from").isNotNull(), F.col(liquid_col)).when(
            listed, F.col(listed_col)).otherwise(F.col(seen_col))

    bounds = contracts.select("contract_id", "first_trade_date", "last_trade_date")
    return spans.join(bounds, "contract_id", "left").select(
        *SLICE,
        pick("liquid_from", "first_trade_date", "seen_from").alias("start_date"),
        pick("liquid_to", "last_trade_date", "seen_to").alias("end_date"),
        F.when(F.col("liquid_from").isNotNull(), "liquidity").when(listed, "listed").otherwise("observed")
        .alias("basis"),
    )


def roll_windows(sessions: DataFrame, contracts: DataFrame, days: int, ratio: float) -> DataFrame:
    """Last days before expiry of slices whose median session volume collapsed there."""
    ends = sessions.groupBy(*SLICE).agg(F.max("trade_date").alias("seen_to")).join(
        contracts.select("contract_id", "last_trade_date"), "contract_id", "left"
    ).select(
        *SLICE, F.coalesce("last_trade_date", "seen_to").alias("roll_end"),
        F.when(F.col("last_trade_date").isNotNull(), "listed").otherwise("observed").alias("expiry_basis"),
    ).withColumn("roll_start", F.date_sub("roll_end", days))
    volume, day = F.col("volume").cast("double"), F.col("trade_date")
    medians = sessions.join(ends, SLICE).groupBy(*SLICE, "roll_start", "roll_end", "expiry_basis").agg(
        F.median(F.when(day.between(F.col("roll_start"), F.col("roll_end")), volume)).alias("median_inside"),
        F.median(F.when(day < F.col("roll_start"), volume)).alias("median_before"),
    )
    return medians.filter(F.col("median_inside") < ratio * F.col("median_before"))


def scope_windows(coverage: DataFrame, roll: DataFrame) -> DataFrame:
    """Coverage and roll of every slice side by side."""
    return coverage.join(roll, SLICE, "left")


def outside_roll(day: Column) -> Column:
    return F.col("roll_start").isNull() | ~day.between(F.col("roll_start"), F.col("roll_end"))


def suppression_reason(day: Column) -> Column:
    """Why a session is exempt from completeness, or null; reads a windows row."""
    return F.when(
        ~day.between(F.col("start_date"), F.col("end_date")),
        F.concat(F.lit("outside the "), F.col("basis"), F.lit(" window")),
    ).when(~outside_roll(day), "inside the roll window (ROL.THIN_NEAR_EXPIRY)")


def calendar_refusals(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: scoped sessions without a calendar row and contracts without a root."""
    known = calendar.select("root", "trade_date", F.lit(True).alias("known"))
    absent = F.col("root").isNotNull() & F.col("known").isNull()
    return sessions.join(known, ["root", "trade_date"], "left").agg(
        F.count_distinct(F.when(F.col("root").isNull(), F.col("contract_id"))).alias("unrooted_contracts"),
        F.count_distinct(F.when(absent, F.struct("root", "trade_date"))).alias("missing_sessions"),
    ).withColumn("refused", (F.col("unrooted_contracts") > 0) | (F.col("missing_sessions") > 0))


@dataclass
class Scope:
    """Lazy record set plus settled small tables shared by the rules of one pass."""

    spark: SparkSession
    tables: Tables
    records: DataFrame
    overrides: dict[str, dict] = field(default_factory=dict)

    def params(self, rule_id: str) -> dict:
        return rule_params(rule_id, self.overrides)

    @shared_once
    def days(self) -> DataFrame:
        return settle(session_days(self.records), "session-days")

    @shared_once
    def sessions(self) -> DataFrame:
        return self.days.groupBy(*SLICE, "root", "trade_date").agg(
            F.sum("records").alias("records"), F.sum("volume").alias("volume"),
            F.min("first_ts_utc").alias("first_ts_utc"), F.max("last_ts_utc").alias("last_ts_utc"),
        )

    @shared_once
    def slice_count(self) -> int:
        return self.days.select(*SLICE).distinct().count()

    @shared_once
    def hot_days(self) -> DataFrame | None:
        return series.hot_days(self.days, SLICE)

    @shared_once
    def layout(self) -> DataFrame:
        """Records laid out by chunk of their series: the one exchange that rules on neighbours share."""
        return series.lay_out(self.records.select(*LAID_OUT), SLICE, self.hot_days, "layout")

    @shared_once
    def borders(self) -> DataFrame:
        """The last record and the last positive close before every chunk, one row each."""
        last = {f"before_{name}": F.col(name) for name in ("open", "high", "low", "close", "volume")}
        positive = F.when(F.col("close") > 0, F.col("close"))
        return small(settle(series.borders(self.layout, SLICE, order.in_day(), last, {"before_positive": positive}), "borders"))

    @property
    def slots(self) -> DataFrame:
        """Distinct minutes of each minute session and chunk, counted where the records lie."""
        held = self.layout.filter("frequency = 'minute' and root is not null")
        return held.groupBy(*SLICE, "root", "trade_date", *series.CHUNK, F.date_trunc("minute", "ts_utc").alias("slot")).agg(
            F.lit(1).alias("held")).drop("held")

    @shared_once
    def calendar(self) -> DataFrame:
        """Settled calendar, hinted for broadcast when its count allows."""
        calendar = self.tables.calendar
        if calendar is None:
            calendar = calendar_for_loaded(self.sessions, self.tables.contracts, self.tables.products)
        return small(settle(calendar, "calendar"))

    @shared_once
    def judged(self) -> DataFrame:
        """Held minute sessions of known grid, one row each, written once."""
        from .session_rules import judged_sessions

        return small(settle(judged_sessions(self), "judged"))

    @shared_once
    def open_days(self) -> DataFrame:
        """Ranked open days of every root, one row each: a calendar's length."""
        from .expected import open_days

        return small(settle(open_days(self.calendar), "open-days"))

    @shared_once
    def rank_index(self) -> DataFrame:
        """One row per root."""
        from .expected import rank_index

        return small(settle(rank_index(self.open_days), "rank-index"))

    @shared_once
    def expected_spans(self) -> DataFrame:
        """Ranges of open days that each slice should hold, two rows a slice at most."""
        from .expected import expected_spans

        return small(settle(expected_spans(self), "expected-spans"))

    @shared_once
    def all_windows(self) -> DataFrame:
        roll = self.params("ROL.THIN_NEAR_EXPIRY")
        floor = self.params("CMP.SESSION_MISSING")["volume_floor"]
        coverage = coverage_windows(self.sessions, self.tables.contracts, floor)
        rolling = roll_windows(self.sessions, self.tables.contracts, roll["days"], roll["collapse_ratio"])
        return small(settle(scope_windows(coverage, rolling), "windows"))

    @property
    def roll(self) -> DataFrame:
        return self.all_windows.filter("roll_start is not null").select(
            *SLICE, "roll_start", "roll_end", "expiry_basis", "median_inside", "median_before")

    @property
    def windows(self) -> DataFrame:
        return self.all_windows.drop("expiry_basis", "median_inside", "median_before")

    @shared_once
    def frame(self) -> DataFrame:
        """Both grains of every session side by side, written once for all who compare them."""
        from .reconcile import session_frame

        return settle(session_frame(self), "session-frame")

    @shared_once
    def ticks(self) -> DataFrame:
        """Tick per field side by side: one row per root and grain."""
        given = self.tables.ticks
        lattice = (tick_dim(self.spark, self.tables.products) if given is None else given).filter("not exempt and tick_size > 0")
        wide = lattice.groupBy("root", "frequency").agg(*[
            F.max(F.when(F.col("field") == name, F.col("tick_size"))).alias(f"tick_{name}")
            for name in ("open", "high", "low", "close")
        ])
        return F.broadcast(wide) if given is None and self.tables.products is None else small(wide)

    @shared_once
    def refusal(self) -> str | None:
        """Why session-grained completeness cannot be judged here, or None."""
        row = calendar_refusals(self.sessions, self.calendar).first()
        if row["unrooted_contracts"]:
            return f"{row['unrooted_contracts']} scoped contract(s) have no resolved root"
        if row["missing_sessions"]:
            return f"{row['missing_sessions']} scoped session(s) have no calendar row"
        return None


def build_scope(
    spark: SparkSession, tables: Tables, *, batch: str | None = None, contract_ids: list[str] | None = None,
    frequencies: list[str] | None = None, overrides: dict[str, dict] | None = None,
) -> Scope:
    records = scope_records(tables.records, tables.contracts, tables.batches, batch, contract_ids, frequencies)
    return Scope(spark, tables, records, overrides or {})
