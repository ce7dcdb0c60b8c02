"""Rules that judge one record on its own.

Each rule yields tests: a condition, the severity it fires at, its evidence and the field it
accuses. One rule alone is a filter; a whole pass evaluates every test in a single scan, where
a disjunction of the conditions drops clean rows before anything is built for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import INTERVAL_SECONDS, RULES_BY_ID, lookup
from .findings import FINDING_COLUMNS, finding_id
from .scope import Scope


class Test(NamedTuple):
    when: Column
    details: dict[str, Column]
    subject: str = ""
    severity: Column | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _fields(params: dict, allowed: list[str]) -> list[str]:
    names = list(params.get("fields", allowed))
    unknown = [name for name in names if name not in allowed]
    if unknown:
        raise ValueError(f"params.fields names unknown columns {unknown}")
    return names


PRICES = ["open", "high", "low", "close"]


def null_field(p: dict) -> list[Test]:
    return [Test(_c(f).isNull(), {"field": F.lit(f)}, f) for f in _fields(p, PRICES + ["volume"])]


def non_positive_price(p: dict) -> list[Test]:
    return [Test(_c(f) <= 0, {"field": F.lit(f), "value": _c(f)}, f) for f in _fields(p, PRICES)]


def negative_volume(p: dict) -> list[Test]:
    return [Test(_c("volume") < 0, {"field": F.lit("volume"), "value": _c("volume")}, "volume")]


def non_integer_volume(p: dict) -> list[Test]:
    return [Test(_c("volume_source").isNotNull(), {
        "field": F.lit("volume"), "source_value": _c("volume_source"), "loaded_value": _c("volume")}, "volume")]


def off_tick_price(p: dict) -> list[Test]:
    tests = []
    for f in _fields(p, PRICES):
        tick = _c(f"tick_{f}")
        residual = _c(f) - F.round(_c(f) / tick) * tick
        tests.append(Test(F.abs(residual) > tick * float(p["epsilon_ticks"]), {
            "field": F.lit(f), "value": _c(f), "tick_size": tick, "residual": F.round(residual, 12)}, f))
    return tests


def _intraday() -> Column:
    return ~_c("bar_interval").eqNullSafe(F.lit("1 day"))


def _basis() -> Column:
    return F.when(_intraday(), "intraday").otherwise("daily")


def zero_volume_with_range(p: dict) -> list[Test]:
    daily = p.get("daily_severity")
    wanted = (_intraday() & F.lit("intraday" in p["frequencies"])) | (~_intraday() & F.lit(daily is not None))
    severity = F.when(_intraday(), RULES_BY_ID["VAL.ZERO_VOLUME_WITH_RANGE"].severity).otherwise(F.lit(daily))
    return [Test((_c("volume") == 0) & (_c("high") > _c("low")) & wanted, {
        "bar_interval": _c("bar_interval"), "range": F.round(_c("high") - _c("low"), 12), "basis": _basis()},
        "volume", severity)]


def price_magnitude(p: dict) -> list[Test]:
    low = lookup({root: float(band[0]) for root, band in p["bands"].items()}, _c("root"))
    high = lookup({root: float(band[1]) for root, band in p["bands"].items()}, _c("root"))
    if not p["bands"]:
        return []
    return [Test((_c(f) < low) | (_c(f) > high), {
        "field": F.lit(f), "value": _c(f), "plausible_range": F.array(low, high)}, f)
        for f in _fields(p, PRICES)]


def extreme_volume(p: dict) -> list[Test]:
    ceiling = lookup({k: int(v) for k, v in p["max_plausible"].items()}, _c("frequency"))
    if not p["max_plausible"]:
        return []
    return [Test(_c("volume") > ceiling, {
        "field": F.lit("volume"), "value": _c("volume"), "max_plausible": ceiling}, "volume")]


def high_lt_low(p: dict) -> list[Test]:
    return [Test(_c("high") < _c("low"), {"high": _c("high"), "low": _c("low")})]


def _outside(name: str) -> Column:
    coherent = _c("high") >= _c("low")
    return coherent & ((_c(name) < _c("low")) | (_c(name) > _c("high")))


def _range_details(name: str) -> dict[str, Column]:
    return {"field": F.lit(name), "value": _c(name), "low": _c("low"), "high": _c("high")}


def open_out_of_range(p: dict) -> list[Test]:
    return [Test(_outside("open"), _range_details("open"), "open")]


def close_out_of_range(p: dict) -> list[Test]:
    declared = RULES_BY_ID["CON.CLOSE_OUT_OF_RANGE"].severity
    severity = F.when(_intraday(), declared).otherwise(F.lit(p.get("daily_severity") or declared))
    return [Test(_outside("close"), {**_range_details("close"), "basis": _basis()}, "close", severity)]


def weekend_record(p: dict) -> list[Test]:
    return [Test(F.dayofweek("trade_date").isin(1, 7), {
        "trade_date": _c("trade_date").cast("string"), "weekday": F.date_format("trade_date", "EEEE")})]


def record_in_halt(p: dict) -> list[Test]:
    inside = lambda h: (_c("ts_utc") >= h["start_utc"]) & (_c("ts_utc") < h["end_utc"])
    halt = F.try_element_at(F.filter("halts_utc", inside), F.lit(1))
    return [Test((F.size("halts_utc") > 0) & F.exists("halts_utc", inside), {
        "halt_start_utc": halt["start_utc"], "halt_end_utc": halt["end_utc"]})]


def record_on_holiday(p: dict) -> list[Test]:
    return [Test(_c("is_holiday"), {"trade_date": _c("trade_date").cast("string")})]


def future_timestamp(p: dict) -> list[Test]:
    return [Test(_c("ts_utc") > _c("ingested_at"), {"ts_utc": _c("ts_utc"), "ingested_at": _c("ingested_at")})]


def before_listing(p: dict) -> list[Test]:
    return [Test(_c("trade_date") < _c("first_trade_date"), {
        "trade_date": _c("trade_date").cast("string"),
        "first_trade_date": _c("first_trade_date").cast("string")})]


def after_expiry(p: dict) -> list[Test]:
    return [Test(_c("trade_date") > _c("last_trade_date"), {
        "trade_date": _c("trade_date").cast("string"),
        "last_trade_date": _c("last_trade_date").cast("string")})]


def off_grid(p: dict) -> list[Test]:
    seconds = lookup(INTERVAL_SECONDS, _c("inferred_interval"))
    wall = F.unix_date(F.to_date("ts_exchange")).cast("bigint") * 86_400 + (
        F.hour("ts_exchange") * 3600 + F.minute("ts_exchange") * 60 + F.second("ts_exchange"))
    return [Test(wall % seconds != 0, {
        "inferred_interval": _c("inferred_interval"), "interval_seconds": seconds})]


RECORD_RULES: dict[str, Callable[[dict], list[Test]]] = {
    "CMP.NULL_FIELD": null_field,
    "VAL.NON_POSITIVE_PRICE": non_positive_price,
    "VAL.NEGATIVE_VOLUME": negative_volume,
    "VAL.NON_INTEGER_VOLUME": non_integer_volume,
    "VAL.OFF_TICK_PRICE": off_tick_price,
    "VAL.ZERO_VOLUME_WITH_RANGE": zero_volume_with_range,
    "VAL.PRICE_MAGNITUDE": price_magnitude,
    "VAL.EXTREME_VOLUME": extreme_volume,
    "CON.HIGH_LT_LOW": high_lt_low,
    "CON.OPEN_OUT_OF_RANGE": open_out_of_range,
    "CON.CLOSE_OUT_OF_RANGE": close_out_of_range,
    "CON.WEEKEND_RECORD": weekend_record,
    "CON.RECORD_IN_HALT": record_in_halt,
    "CON.RECORD_ON_HOLIDAY": record_on_holiday,
    "TIM.FUTURE_TIMESTAMP": future_timestamp,
    "TIM.BEFORE_LISTING": before_listing,
    "TIM.AFTER_EXPIRY": after_expiry,
    "TIM.OFF_GRID": off_grid,
}

_NEEDS_CALENDAR = {"CON.RECORD_IN_HALT", "CON.RECORD_ON_HOLIDAY"}


def record_findings(scope: Scope, rule_ids: list[str]) -> DataFrame:
    """Findings of any set of record rules in one scan of the scope."""
    df = scope.records
    if "VAL.OFF_TICK_PRICE" in rule_ids:
        df = df.join(scope.ticks, ["root", "frequency"], "left")
    if _NEEDS_CALENDAR & set(rule_ids):
        df = df.join(scope.calendar.select("root", "trade_date", "is_holiday", "halts_utc"),
                     ["root", "trade_date"], "left")
    tests = [(rule_id, test) for rule_id in rule_ids for test in RECORD_RULES[rule_id](scope.params(rule_id))]
    if not tests:
        raise ValueError(f"no tests to run for {rule_ids}")

    def fires(rule_id: str, test: Test) -> Column:
        grain = RULES_BY_ID[rule_id].frequency
        return test.when if grain is None else test.when & (F.col("frequency") == grain)

    def at_hit(values: list[str]) -> Column:
        return F.element_at(F.lit(values), F.col("hit") + 1)

    def of_hit(values: dict[int, Column]) -> Column:
        """Pick by test number; only the expression of the test that fired is evaluated."""
        picked = F
        for i, value in values.items():
            picked = picked.when(F.col("hit") == i, value)
        return picked

    conditions = [fires(*item) for item in tests]
    numbers = F.array_remove(F.array(*[F.when(c, i).otherwise(-1) for i, c in enumerate(conditions)]), -1)
    hits = df.filter(reduce(or_, conditions)).withColumn("hit", F.explode(numbers))
    declared = at_hit([RULES_BY_ID[rule_id].severity for rule_id, _ in tests])
    varying = {i: t.severity for i, (_, t) in enumerate(tests) if t.severity is not None}
    severity = of_hit(varying).otherwise(declared) if varying else declared
    shaped = hits.select(
        at_hit([rule_id for rule_id, _ in tests]).alias("rule_id"),
        severity.alias("severity"),
        "contract_id", "frequency", F.lit(None).cast("string").alias("compare_frequency"), "trade_date",
        F.col("ts_utc").alias("ts_start_utc"), F.col("ts_utc").alias("ts_end_utc"), "record_id",
        F.lit(1).cast("bigint").alias("affected_rows"),
        of_hit({i: F.to_json(F.struct(*[c.alias(n) for n, c in t.details.items()])) for i, (_, t) in enumerate(tests)})
        .alias("details"),
        at_hit([t.subject for _, t in tests]).alias("_subject"),
    )
    return shaped.withColumn("finding_id", finding_id(F.col("_subject"))).select(*FINDING_COLUMNS)
