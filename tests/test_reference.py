from __future__ import annotations

import datetime as dt

from dateutil.easter import easter as easter_of
from pyspark.sql import functions as F

from tapewright.functions import clock
from tapewright.functions.symbols import parse_symbol
from tapewright.sources import reference as ref


def test_symbols(spark):
    names = ["ESZ25", " srm3m26", "SR3M26", "XXF30", "ESZ5", "spread", ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    parts = parse_symbol(F.col("s"), ref.KNOWN_ROOTS)
    got = {r["s"]: (r["root"], r["contract_month"], r["parse_confidence"])
           for r in df.select("s", *[c.alias(k) for k, c in parts.items()]).collect()}
    assert got["ESZ25"] == ("ES", dt.date(2025, 12, 1), 1.0)
    assert got["SR3M26"] == ("SR3", dt.date(2026, 6, 1), 1.0)
    assert got["XXF30"] == ("XX", dt.date(2030, 1, 1), 0.7)
    assert got["ESZ5"] == got["spread"] == got[""] == (None, None, 0.0)


def test_easter_of_two_centuries(spark):
    rows = spark.range(1900, 2100).select(F.col("id").cast("int").alias("y")).select("y", clock.easter(F.col("y")).alias("d"))
    assert all(r["d"] == easter_of(r["y"]) for r in rows.collect())


def test_holidays(spark):
    years = spark.range(2021, 2027).select(F.col("id").cast("int").alias("year"))
    days = {r["day"]: (r["name"], r["is_holiday"]) for r in clock.holidays(years).collect()}
    assert days[dt.date(2023, 1, 2)] == ("New Year's Day", True) and dt.date(2023, 1, 1) not in days
    assert days[dt.date(2022, 12, 26)] == ("Christmas Day", True)
    assert days[dt.date(2022, 12, 25)] == ("Christmas Eve", False)
    assert days[dt.date(2022, 1, 1)] == ("New Year's Day", True) and dt.date(2021, 12, 31) not in days
    assert days[dt.date(2025, 4, 18)] == ("Good Friday", False)
    assert dt.date(2021, 6, 19) not in days and days[dt.date(2022, 6, 20)] == ("Juneteenth", False)
    assert days[dt.date(2025, 5, 26)] == ("Memorial Day", False)
    assert days[dt.date(2025, 11, 27)] == ("Thanksgiving", False) and days[dt.date(2025, 11, 28)][0] == "Day after Thanksgiving"
    assert sum(closed for _, closed in days.values()) == 12


def _calendar(spark, start: str, end: str, roots=("ES", "SB", "ZC")):
    spans = spark.createDataFrame([(r, start, end) for r in roots], "root string, s string, e string").select(
        "root", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    return ref.session_calendar(spans)


def test_sessions_across_daylight_saving(spark):
    rows = {(r["root"], str(r["trade_date"])): r for r in _calendar(spark, "2025-03-07", "2025-03-10").collect()}
    assert set(d for _, d in rows) == {"2025-03-07", "2025-03-10"}
    assert rows["ES", "2025-03-07"]["session_open_utc"] == dt.datetime(2025, 3, 6, 23, 0)
    assert rows["ES", "2025-03-10"]["session_open_utc"] == dt.datetime(2025, 3, 9, 22, 0)
    assert rows["SB", "2025-03-10"]["session_open_utc"] == dt.datetime(2025, 3, 10, 7, 30)
    halt = rows["ZC", "2025-03-10"]["halts_utc"][0]
    assert (halt["start_utc"], halt["end_utc"]) == (dt.datetime(2025, 3, 10, 12, 45), dt.datetime(2025, 3, 10, 13, 30))


def test_closed_and_shortened_days(spark):
    rows = {str(r["trade_date"]): r for r in _calendar(spark, "2025-12-22", "2025-12-26", ("ES",)).collect()}
    assert rows["2025-12-25"]["expected_slots_1m"] == 0 and rows["2025-12-25"]["session_open_utc"] is None
    assert rows["2025-12-24"]["expected_slots_1m"] is None and rows["2025-12-24"]["is_early_close"]
    assert rows["2025-12-23"]["expected_slots_1m"] == 1380


def test_grid_size_equals_declared_slots(spark):
    calendar = _calendar(spark, "2025-09-15", "2025-09-16")
    grid = ref.expected_grid(calendar.select("root", "trade_date"), calendar).groupBy("root", "trade_date").count()
    assert {(r["root"], r["count"]) for r in grid.collect()} == {("ES", 1380), ("SB", 570), ("ZC", 1055)}


def test_trade_dates_roll_per_root(spark):
    df = spark.createDataFrame(
        [("ES", "2025-09-15 16:59:59"), ("ES", "2025-09-15 17:00:00"), ("ZC", "2025-09-15 18:59:00"),
         ("ZC", "2025-09-15 19:00:00"), ("SB", "2025-09-15 23:00:00"), ("QQ", "2025-09-15 17:00:00")], "root string, ts string")
    day = clock.trade_date(F.col("ts").cast("timestamp_ntz"), ref.open_second(F.col("root")))
    assert [str(r["d"]) for r in df.select(day.alias("d")).collect()] == [
        "2025-09-15", "2025-09-16", "2025-09-15", "2025-09-16", "2025-09-15", "2025-09-16"]


def test_ticks_and_products(spark):
    ticks = ref.tick_dim(spark).collect()
    assert len(ticks) == 64 and ref.product_dim(spark).count() == 8
    assert [t["tick_size"] for t in ticks if t["exempt"]] == [None] * 8


def test_manifest_lowers_confidence_and_widens_dates(spark):
    rows = [("ESZ25", "ES", "Z", "2025", "12", "CME", "1757894400000", "1758240000000"),
            ("ESZ25", "ES", "H", "2025", "12", "CME", "1757808000000", None)]
    manifest = spark.createDataFrame(rows, "contract_symbol string, root string, month_code string, delivery_year string, "
                                           "delivery_month string, exchange string, first_timestamp_ms string, last_timestamp_ms string")
    row = ref.contracts_from_manifest(manifest).collect()[0]
    assert (str(row["first_trade_date"]), str(row["last_trade_date"]), row["parse_confidence"]) == ("2025-09-14", "2025-09-19", 0.5)
