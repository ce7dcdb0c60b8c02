"""Wall-clock, session and holiday arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHICAGO = "America/Chicago"
DAY = 86_400


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def trade_date(ts: Column, open_sec: Column) -> Column:
    """Session date: at or past the open belongs to the next date; a null open never rolls."""
    day = F.to_date(ts)
    return F.when(second_of_day(ts) >= open_sec, F.date_add(day, 1)).otherwise(day)


def local_instant(day: Column, sec: Column, zone: Column | str) -> Column:
    """UTC instant of a local clock reading, correct over daylight saving."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day).cast("long") * DAY + sec), zone)


def session_bounds(day: Column, open_sec: Column, close_sec: Column, zone: Column) -> tuple[Column, Column]:
    """Open and close instants of the session that closes on ``day``."""
    first = F.when(open_sec > close_sec, F.date_sub(day, 1)).otherwise(day)
    return local_instant(first, open_sec, zone), local_instant(day, close_sec, zone)


def halt_windows(day: Column, halts: Column, open_sec: Column, close_sec: Column, zone: Column) -> Column:
    """UTC halts of a session; a halt in the evening block falls on the prior date."""
    overnight = open_sec > close_sec

    def shifted(flag: Column) -> Column:
        return F.when(overnight & flag, F.date_sub(day, 1)).otherwise(day)

    return F.transform(
        halts,
        lambda h: F.struct(
            local_instant(shifted(h["start_sec"] >= open_sec), h["start_sec"], zone).alias("start_utc"),
            local_instant(shifted(h["end_sec"] > open_sec), h["end_sec"], zone).alias("end_utc"),
        ),
    )


def _sunday_to_monday(day: Column) -> Column:
    return F.when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    before_first = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before_first, weekday), 7 * (n - 1))


def easter(year: Column) -> Column:
    """Oudin's closed form: days from 28 March to Easter Sunday."""
    def div(a: Column, b: int | Column) -> Column:
        return F.floor(a / b).cast("int")

    golden = year % 19
    century = div(year, 100)
    epact = (century - div(century, 4) - div(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = epact - div(epact, 28) * (1 - div(F.lit(29), epact + 1) * div(21 - golden, 11))
    weekday = (year + div(year, 4) + moon + 2 - century + div(century, 4)) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), moon - weekday)


def holidays(years: DataFrame) -> DataFrame:
    """Closures and early closes of each ``year``: one row per date, a closure winning."""
    y = F.col("year")
    thanks = _nth(y, 11, "THU", 4)
    christmas = _sunday_to_monday(F.make_date(y, F.lit(12), F.lit(25)))
    fourth = _sunday_to_monday(F.make_date(y, F.lit(7), F.lit(4)))
    # fixed values: the two closures, then the early closes, in precedence order
    named = [
        (_sunday_to_monday(F.make_date(y, F.lit(1), F.lit(1))), "New Year's Day", True),
        (christmas, "Christmas Day", True),
        (_nth(y, 1, "MON", 3), "Martin Luther King Jr. Day", False),
        (_nth(y, 2, "MON", 3), "Presidents Day", False),
        (F.date_sub(easter(y), 2), "Good Friday", False),
        (F.next_day(F.make_date(y, F.lit(5), F.lit(24)), "MON"), "Memorial Day", False),
        (F.date_sub(fourth, 1), "Independence Day eve", False),
        (fourth, "Independence Day", False),
        (_nth(y, 9, "MON", 1), "Labor Day", False),
        (thanks, "Thanksgiving", False),
        (F.date_add(thanks, 1), "Day after Thanksgiving", False),
        (F.date_sub(christmas, 1), "Christmas Eve", False),
        (F.when(y >= 2022, _sunday_to_monday(F.make_date(y, F.lit(6), F.lit(19)))), "Juneteenth", False),
    ]
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("rank"), day.alias("day"), F.lit(name).alias("name"),
            F.lit(closed).alias("is_holiday"), F.lit(not closed).alias("is_early_close"),
        )
        for i, (day, name, closed) in enumerate(named)
    ])
    return (
        years.select(F.inline(entries))
        .filter("day is not null")
        .groupBy("day")
        .agg(F.min_by(F.struct("name", "is_holiday", "is_early_close"), "rank").alias("h"))
        .select("day", "h.*")
    )
