"""Sort keys of several parts in one number.

``min_by`` and ``max_by`` over a struct make Spark sort the whole input first, since a struct cannot be updated in
place. A decimal of 38 digits can, so the same pick becomes a hash aggregate with partial sums on the map side.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a key, and of the 64-bit numbers it is put together from.
DIGITS = 38
CHUNK = 18
#: An instant may lie this far from the date of its session, in microseconds (57 days).
REACH = 5 * 10**12
WIDE = "decimal(38,0)"


def packed(*parts: tuple[Column, int]) -> Column:
    """``(value, digits)`` pairs as one decimal in the order of the pairs, the first one first.

    Values are whole, not negative and below 10 to the power of their digits; null comes first, as in a struct. Anything
    else is an error, never a wrong order. Digits are put together in 64-bit numbers; a key of 36 digits takes one product.
    """
    if sum(digits for _, digits in parts) > DIGITS:
        raise ValueError("a key has 38 digits at most")
    rest, fits = sum(digits for _, digits in parts), F.lit(True)
    chunks: dict[int, Column] = {}
    for value, digits in parts:
        rest -= digits
        whole = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
        fits = fits & (whole >= 0) & ((whole < 10**digits) if digits < 19 else F.lit(True))
        for k in range(rest // CHUNK, (rest + digits - 1) // CHUNK + 1):
            low, high = max(rest, k * CHUNK), min(rest + digits, (k + 1) * CHUNK)
            piece = F.call_function("div", whole, F.lit(10 ** (low - rest))) if low > rest else whole
            piece = piece % 10 ** (high - low) if high < rest + digits else piece
            piece = piece * 10 ** (low - k * CHUNK) if low > k * CHUNK else piece
            chunks[k] = chunks[k] + piece if k in chunks else piece
    total = None
    for k in sorted(chunks, reverse=True):
        own = chunks[k].cast(WIDE)
        total = own if total is None else (total * F.lit(Decimal(10**CHUNK)) + own).cast(WIDE)
    return F.when(fits, total).otherwise(F.raise_error(F.lit("a sort key does not fit its digits")).cast(WIDE))


def session_instant(instant: Column, day: Column) -> Column:
    """Microseconds from ``REACH`` before the session's date, 13 digits; sessions lie around their date."""
    return F.unix_micros(instant) - F.unix_micros(F.coalesce(day, F.to_date(instant)).cast("timestamp")) + REACH


def in_session(instant: str = "ts_utc", day: str = "trade_date", row: str = "source_row", record: str = "record_id") -> Column:
    """Instant, source row (10 digits) and record id (13 digits) of a record within its session."""
    return packed((session_instant(F.col(instant), F.col(day)), 13), (F.col(row), 10), (F.col(record), 13))


def in_day(instant: str = "ts_utc", record: str = "record_id") -> Column:
    """Instant and record id (18 digits) of a record within its UTC day."""
    at = F.col(instant)
    return packed((F.unix_micros(at) - F.unix_micros(F.to_date(at).cast("timestamp")), 11), (F.col(record), 18))


def in_day_by_row(instant: str = "ts_utc", row: str = "source_row", record: str = "record_id") -> Column:
    """Instant, source row (10 digits) and record id (13 digits) of a record within its UTC day."""
    at = F.col(instant)
    return packed((F.unix_micros(at) - F.unix_micros(F.to_date(at).cast("timestamp")), 11), (F.col(row), 10), (F.col(record), 13))
