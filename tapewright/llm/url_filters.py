"""Temporal list join: captures judged by the block and allow lists as they stood at fetch time.

Dated list changes of one domain become validity intervals. Intervals and captures meet on the domain and
the month, then on the exact instant, so a capture never meets the whole history of a list. All of it is
DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.session import settle, small


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """``(domain, action, since, until)`` from dated changes ``(domain, changed, action)``.

    A change holds until the next one of its domain; action ``remove`` (or null) ends the entry. Of several
    changes at one instant ``block`` wins over ``allow`` over ``remove``. Null domains or dates are no
    entries. ``until`` is open (null) for the last change.
    """
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    daily = entries.where(F.col("domain").isNotNull() & F.col("changed").isNotNull()).groupBy(
        F.lower("domain").alias("domain"), "changed").agg(F.max(strength).alias("strength"))
    later = Window.partitionBy("domain").orderBy("changed")
    return daily.select(
        "domain", "strength", F.col("changed").alias("since"), F.lead("changed").over(later).alias("until"),
    ).where("strength > 0").select(
        "domain", F.when(F.col("strength") == 2, "block").otherwise("allow").alias("action"), "since", "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: page_id, host, fetched, decision, matched domain and since when it was listed.

    ``captures``: page_id, url, fetched (date). ``entries`` as in ``validity``. The most specific domain with
    an active entry decides (``block`` or ``allow``); without one the decision is ``none``, also for a url
    without host or a capture without a date. Captures are kept row by row, repeated ones too; other columns are not read; empty
    tables give no rows or only ``none``. Whether the intervals are broadcast is decided by counting them.
    """
    taken = settle(captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched",
                                   F.monotonically_increasing_id().alias("_row")), "captures")
    last = F.broadcast(taken.agg(F.max("fetched").alias("last")))
    spans = validity(entries).crossJoin(last).withColumn(
        "ends", F.when(F.col("until").isNull(), F.col("last")).otherwise(F.least(F.date_sub("until", 1), "last"))
    ).where("since <= ends")
    month = F.explode(F.sequence(F.trunc("since", "month"), F.trunc("ends", "month"), F.expr("interval 1 month")))
    listed = small(settle(spans.select(F.col("domain").alias("matched"), "action", "since", "until", month.alias("m")), "lists"))
    near = taken.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select(
        "_row", "fetched", F.explode(suffixes(F.col("host"))).alias("suffix"), F.trunc("fetched", "month").alias("month"))
    hits = near.join(listed, (F.col("suffix") == F.col("matched")) & (F.col("month") == F.col("m"))
                     & (F.col("fetched") >= F.col("since"))
                     & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = hits.groupBy(F.col("_row").alias("_hit")).agg(
        F.max(F.struct(F.length("matched").alias("n"), "matched", "action", "since")).alias("best"))
    return taken.join(best, F.col("_row") == F.col("_hit"), "left").select(
        "page_id", "host", "fetched", F.coalesce("best.action", F.lit("none")).alias("decision"),
        F.col("best.matched").alias("matched"), F.col("best.since").alias("listed_since"))
