"""What a slice should hold, from running numbers of its root's open days.

Every open day of a root has a rank. A window of dates is a range of ranks, so counts of expected days and slots are
differences of two running sums, and absent days are the jumps between the ranks of neighbouring sessions. No
slice is laid against all days of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scope import SLICE, Scope


def open_days(calendar: DataFrame) -> DataFrame:
    """``(root, trade_date, rank, slots, slots_upto)`` of every open day; days of unknown grid add no slots."""
    along = W.partitionBy("root").orderBy("trade_date")
    return calendar.filter(~F.col("is_holiday")).select(
        "root", "trade_date", F.row_number().over(along).alias("rank"), F.col("expected_slots_1m").alias("slots"),
        F.sum(F.coalesce("expected_slots_1m", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("slots_upto"))


def rank_index(days: DataFrame) -> DataFrame:
    """One row per root: its first open day, open days up to each date from there on, slots up to each rank."""
    spans = days.groupBy("root").agg(
        F.min("trade_date").alias("first"), F.max("trade_date").alias("last"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "slots_upto"))), lambda d: d["slots_upto"]).alias("slots_upto"))
    dates = spans.select("root", F.explode(F.sequence("first", "last")).alias("trade_date"))
    dense = dates.join(days.select("root", "trade_date", F.lit(1).alias("open")), ["root", "trade_date"], "left").withColumn(
        "upto", F.count("open").over(W.partitionBy("root").orderBy("trade_date")))
    counted = dense.groupBy("root").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("trade_date", "upto"))), lambda d: d["upto"]).alias("opened"))
    return spans.drop("last").join(counted, "root")


def _opened(date: Column) -> Column:
    """Open days up to ``date``; reads an index row."""
    at = F.datediff(date, F.col("first"))
    return F.when(at < 0, F.lit(0).cast("bigint")).otherwise(F.element_at("opened", F.least(at + 1, F.size("opened"))))


def _slots(rank: Column) -> Column:
    """Slots of the first ``rank`` open days; reads an index row."""
    return F.when(rank < 1, F.lit(0).cast("bigint")).otherwise(F.element_at("slots_upto", rank.cast("int")))


def expected_spans(scope: Scope) -> DataFrame:
    """``(slice, root, basis, part, lo, hi, expected)``: ranges of ranks a rooted slice should hold, the roll window cut out."""
    slices = scope.sessions.filter("root is not null").select(*SLICE, "root").distinct()
    rows = slices.join(scope.windows, SLICE).join(scope.rank_index, "root")
    rolls = F.col("roll_start").isNotNull() & F.col("roll_end").isNotNull() & (F.col("roll_start") <= F.col("roll_end"))
    lo, hi = _opened(F.date_sub("start_date", 1)) + 1, _opened(F.col("end_date"))

    def span(part: int, first: Column, last: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), first.alias("lo"), last.alias("hi"))

    parts = F.when(rolls, F.array(
        span(0, lo, F.least(hi, _opened(F.date_sub("roll_start", 1)))), span(1, F.greatest(lo, _opened(F.col("roll_end")) + 1), hi),
    )).otherwise(F.array(span(0, lo, hi)))
    held = rows.withColumn("span", F.explode(F.filter(parts, lambda s: s["lo"] <= s["hi"]))).select("*", "span.*")
    minute = F.col("frequency") == "minute"
    return held.select(
        *SLICE, "root", "basis", "part", "lo", "hi",
        F.when(minute, _slots(F.col("hi")) - _slots(F.col("lo") - 1)).otherwise(F.col("hi") - F.col("lo") + 1).alias("expected"))


def _expected() -> Column:
    return F.when(F.col("frequency") == "minute", F.col("slots")).otherwise(1)


def held_days(scope: Scope) -> DataFrame:
    """Sessions of rooted slices that are expected, with their rank, part and expected records."""
    spans = scope.expected_spans.select(*SLICE, "basis", "part", "lo", "hi")
    return scope.sessions.filter("root is not null").join(scope.open_days, ["root", "trade_date"]).join(
        spans, SLICE).filter(F.col("rank").between(F.col("lo"), F.col("hi"))).select(
        *SLICE, "root", "trade_date", "basis", "part", "rank", _expected().alias("expected"))


def absent_days(scope: Scope) -> DataFrame:
    """Expected days without a session: what is jumped between the ranks of neighbours and the ends of a span."""
    at = [*SLICE, "root", "basis", "part"]
    ends = scope.expected_spans.select(*at, F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("rank"))
    seen = held_days(scope).select(*at, F.col("rank").cast("bigint").alias("rank")).unionByName(ends)
    jumps = seen.withColumn("before", F.lag("rank").over(W.partitionBy(*SLICE, "part").orderBy("rank"))).filter("rank - before > 1")
    gone = jumps.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("rank") - 1))).drop("before", "part")
    return gone.join(scope.open_days, ["root", "rank"]).select(
        *SLICE, "root", "trade_date", "basis", _expected().alias("expected"))
