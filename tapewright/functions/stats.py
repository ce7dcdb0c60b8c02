"""Exact medians of unbounded groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

#: Parts that a range of values is cut into by one pass.
BUCKETS = 4096
#: Distinct values of a group that are put in order in one task; a range with more is cut again.
MOST = 1 << 16
_LOWEST, _HIGHEST = -(2047 << 52), 2047 << 52


def rounded(value: Column | str, places: int) -> Column:
    """Half up, after the noise a float sum picks up from its order has been taken off."""
    return F.round(F.round(value, 9), places)


def with_image(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with a 64-bit integer in the order of a double column: sign, exponent and fraction, found by exact arithmetic.

    Zeros of both signs are one value. NaN and infinities come last, as the largest number does. Each step is a column of its
    own, since a single expression would repeat the ones before it over and over.
    """
    v, size, power = F.col(value), F.col("_size"), F.col("_power")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    guess = F.greatest(F.lit(-1022), F.floor(F.log2(F.greatest(size, F.lit(2.0**-1022)))).cast("int"))
    nearer = F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(
        (power < 1023) & (F.pow(F.lit(2.0), power + 1) <= size), power + 1).otherwise(power)
    # below 2^-1022 there is no leading one; 2^1074 is beyond doubles, so the scaling goes in two steps
    fraction = F.when(size < 2.0**-1022, size * 2.0**537 * 2.0**537).otherwise((size / F.pow(F.lit(2.0), power) - 1) * 2.0**52)
    exponent = F.when(size < 2.0**-1022, F.lit(0).cast("bigint")).otherwise((power + 1023).cast("bigint"))
    beyond = F.when(~F.isnan(v) & (v < 0), F.lit(_LOWEST)).otherwise(F.lit(_HIGHEST))
    steps = df.withColumn("_size", F.when(finite, F.abs(v)).otherwise(0.0)).withColumn("_power", guess).withColumn(
        "_power", F.greatest(F.lit(-1022), nearer)).withColumn("_whole", exponent * F.lit(1 << 52) + fraction.cast("bigint"))
    return steps.withColumn(name, F.when(~finite, beyond).when(v < 0, -F.col("_whole")).otherwise(F.col("_whole"))).drop(
        "_size", "_power", "_whole")


def exact_median(
    df: DataFrame, keys: list[str], value: str, out: str, per_group: Callable[[DataFrame], DataFrame] = lambda d: d,
    count: str | None = None,
) -> DataFrame:
    """``keys, n, out``: the exact median of ``value`` per group, never one group in one task.

    Equal values are counted first, so that every later step reads distinct values; with ``count``, a column that says how
    often a row counts, the caller has done so. A group of ``MOST`` distinct values at most is put in order. In a larger one
    the range of its values is cut into ``BUCKETS`` parts, of which counts choose the next one, until it holds so few values
    or a single one. Ranges are of 64-bit images of the doubles, so that six cuts always suffice, however the values
    clump. ``per_group`` is applied to the sides that hold a row per group; a caller that has counted its groups passes
    ``broadcast``, and the values are then never shuffled by group.
    """
    v = F.col(value).cast("double").alias("v")
    if count is None:
        rows = settle(df.select(*keys, v).filter("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c")), "median-values")
    else:
        rows = df.select(*keys, v, F.col(count).alias("c")).filter("v is not null")
    groups = settle(rows.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count("*").alias("held"), F.min("v").alias("least"), F.max("v").alias("most")), "median-groups")
    few = rows.join(per_group(groups.filter(F.col("held") <= MOST).select(*keys, "n")), keys)
    direct = _in_order(few.withColumn("below", F.lit(0)), keys)
    large = groups.filter(F.col("held") > MOST)
    if large.isEmpty():
        return _middle_of(direct, keys, out)
    state = settle(with_image(with_image(large, "least", "from"), "most", "to").select(
        *keys, "n", F.col("from").alias("low"), F.col("to").alias("high"), "from", "to", F.lit(0).cast("bigint").alias("below"),
        "held", F.lit(None).cast("bigint").alias("cut")), "median-range")
    imaged = settle(with_image(rows.join(per_group(large.select(*keys)), keys), "v", "i"), "median-images")
    while not state.filter(_pending()).isEmpty():
        state = settle(_narrowed(imaged, keys, state, per_group), "median-range")
    return _middle_of(direct.unionByName(_from_ranges(imaged, keys, state, per_group)), keys, out)


def _middle_of(pairs: DataFrame, keys: list[str], out: str) -> DataFrame:
    return pairs.select(*keys, "n", ((F.col("lo") + F.col("hi")) / 2).alias(out))


def _in_order(values: DataFrame, keys: list[str]) -> DataFrame:
    """The two middle values of groups from values ``v`` with their counts ``c``, of which ``below`` lie before the first."""
    first, last = _ranks()
    along = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return values.withColumn("upto", F.col("below") + F.sum("c").over(along)).groupBy(*keys, "n").agg(
        F.min(F.when(F.col("upto") >= first, F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") >= last, F.col("v"))).alias("hi"))


def _pending() -> Column:
    return F.col("cut").isNull() & (F.col("held") > MOST) & (F.col("low") < F.col("high"))


def _ranks() -> tuple[Column, Column]:
    return F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)


def _wide(name: str) -> Column:
    """A 64-bit number where sums of two of them fit."""
    return F.col(name).cast("decimal(20,0)")


def _narrowed(rows: DataFrame, keys: list[str], state: DataFrame, per_group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """State after one cut of every pending range ``low..high``: parts of ``from..to``, and what lies on both sides of it.

    Where the two middle ranks fall into different parts, ``cut`` is the end of the lower one and the range needs no
    more narrowing.
    """
    pending = state.filter(_pending())
    span = _wide("to") - _wide("from") + 1
    step = F.greatest(F.lit(1).cast("bigint"), F.ceil(span / BUCKETS).cast("bigint"))
    part = F.when(F.col("i") < F.col("from"), F.lit(0).cast("bigint")).when(F.col("i") > F.col("to"), F.lit(BUCKETS + 1).cast("bigint")).otherwise(
        F.floor((_wide("i") - _wide("from")) / _wide("step")).cast("bigint") + 1)
    inside = rows.join(per_group(pending.withColumn("step", step)), keys).filter(F.col("i").between(F.col("low"), F.col("high")))
    group = [*keys, "n", "low", "high", "from", "to", "below", "step"]
    counts = inside.groupBy(*group, part.alias("part")).agg(F.sum("c").alias("c"), F.count("*").alias("held"))
    upto = counts.withColumn("upto", F.col("below") + F.sum("c").over(
        W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
    first, last = _ranks()
    start = F.when(F.col("part") == 0, F.col("low")).when(F.col("part") > BUCKETS, F.col("to") + 1).otherwise(
        (_wide("from") + (_wide("part") - 1) * _wide("step")).cast("bigint"))
    end = F.when(F.col("part") == 0, F.col("from") - 1).when(F.col("part") > BUCKETS, F.col("high")).otherwise(
        F.least(_wide("to"), _wide("from") + _wide("part") * _wide("step") - 1).cast("bigint"))
    middle = upto.filter((F.col("upto") >= first) & (F.col("upto") - F.col("c") < last)).select(
        *keys, "n", start.alias("low"), end.alias("high"), (F.col("upto") - F.col("c")).alias("below"), "held")
    chosen = middle.groupBy(*keys, "n").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("below").alias("below"), F.sum("held").alias("held"),
        F.when(F.count("*") > 1, F.min("high")).alias("cut"))
    return state.filter(~_pending()).unionByName(chosen.select(
        *keys, "n", "low", "high", F.col("low").alias("from"), F.col("high").alias("to"), "below", "held", "cut"))


def _from_ranges(
    rows: DataFrame, keys: list[str], state: DataFrame, per_group: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The two middle values from ranges that are small, hold a single value, or are cut between the two middle ranks."""
    inside = rows.join(per_group(state.select(*keys, "n", "low", "high", "below", "cut")), keys).filter(
        F.col("i").between(F.col("low"), F.col("high")))
    apart = inside.filter("cut is not null").groupBy(*keys, "n").agg(
        F.max(F.when(F.col("i") <= F.col("cut"), F.col("v"))).alias("lo"), F.min(F.when(F.col("i") > F.col("cut"), F.col("v"))).alias("hi"))
    return apart.unionByName(_in_order(inside.filter("cut is null"), keys))
