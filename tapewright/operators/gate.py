"""Which findings meet a session, what they block, and what a contract can support."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import RULES_BY_ID, severity_name, severity_rank
from ..session import settle, small

SESSION = ["contract_id", "frequency", "trade_date"]


def record_sessions(records: DataFrame) -> DataFrame:
    return records.groupBy(*SESSION).agg(
        F.min("ts_utc").alias("first_ts_utc"), F.max("ts_utc").alias("last_ts_utc"))


def _tally(count: Column | None = None) -> list[Column]:
    """Partial tallies of findings; they add up over any grouping. ``count``: how many findings a row stands for, one by default."""
    critical = F.col("severity") == "critical"
    return [
        (F.count("*") if count is None else F.sum(count)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"),
        F.collect_set(F.when(critical, F.col("rule_id"))).alias("blocking"),
    ]


def _wildcards(df: DataFrame, names: list[str], own: bool | None = None) -> DataFrame:
    """Each row once per way its keys can be matched: by value, or by a finding's null.

    ``own`` keeps only the ways that name the first key, or only those that do not.
    """
    ways = [
        F.struct(*[(F.col(n) if keep else F.lit(None)).cast(df.schema[n].dataType).alias(f"k_{n}")
                   for n, keep in zip(names, flags)])
        for flags in product([True, False], repeat=len(names)) if own is None or flags[0] == own
    ]
    return df.withColumn("way", F.explode(F.array(*ways))).select("*", "way.*").drop("way")


def _meet(sessions: DataFrame, tallies: DataFrame, names: list[str]) -> DataFrame:
    """Sessions beside the tallies whose keys they carry, a tally's null matching any value.

    Without this split all sessions would meet in the few keys of findings that name no contract. Those
    tallies, one per grain and date at most, are broadcast once counted; the rest meet by contract.
    """
    same = [F.col(f"k_{n}").eqNullSafe(F.col(f"f_{n}")) for n in names]
    keyed = sessions.select(*SESSION)
    by_contract = _wildcards(keyed, names, True).join(tallies.filter(F.col(f"f_{names[0]}").isNotNull()), same)
    everywhere = _wildcards(keyed, names, False).join(small(tallies.filter(F.col(f"f_{names[0]}").isNull())), same)
    return by_contract.unionByName(everywhere)


def session_quality(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Open findings meeting each session: how many count on it, how bad, and what blocks it.

    Findings are counted per key, rule and severity first, by plain counts in one scan: sets of rules, which Spark gathers
    by sorting once the keys are many, are made from those counts alone. Sessions are then matched by equality only.
    A null key of a finding matches every session, which a session expresses by also looking
    under null. File findings match by overlapping time, bucketed by UTC day.
    """
    opened = findings.filter("status = 'open'")

    def of_scope(df: DataFrame, *scopes: str) -> DataFrame:
        return df.filter(F.col("rule_id").isin([r for r in RULES_BY_ID if RULES_BY_ID[r].scope in scopes]))

    counts = settle(of_scope(opened, "record", "session", "series").groupBy(*SESSION, "rule_id", "severity").agg(
        F.count("*").alias("held")), "session-tallies")

    def matched(part: DataFrame, names: list[str], counted: bool) -> DataFrame:
        tallies = part.groupBy(*[F.col(n).alias(f"f_{n}") for n in names]).agg(*_tally(F.col("held")))
        return _meet(sessions, tallies, names).select(*SESSION, (F.col("n") if counted else F.lit(0)).alias("n"), "rank", "blocking")

    local = matched(of_scope(counts, "record", "session"), SESSION, True)
    series = matched(of_scope(counts, "series"), ["contract_id", "frequency"], False)
    hits = local.unionByName(series).unionByName(_file_matches(sessions, of_scope(opened, "file")))
    totals = hits.groupBy(*SESSION).agg(
        F.sum("n").alias("finding_count"), F.max("rank").alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("blocking")))).alias("blocking_rule_ids"))
    return sessions.select(*SESSION).join(totals, SESSION, "left").select(
        *SESSION, F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        severity_name(F.col("rank")).alias("max_severity"),
        F.coalesce("blocking_rule_ids", F.array().cast("array<string>")).alias("blocking_rule_ids"))


def disjoint(spans: DataFrame, kind: list[str]) -> DataFrame:
    """``(kind, lo, hi)``: disjoint spans that cover what the spans of each kind cover, closed at both ends.

    Spans are merged inside the UTC day on which they begin; what an earlier day still covers is one instant per day, carried
    along the kind. No kind is ordered in one task but for its days.
    """
    chunk = [*kind, "chunk"]
    rows = spans.withColumn("chunk", F.to_date("lo"))
    inside = W.partitionBy(*chunk).orderBy("lo", "hi")
    carried = rows.groupBy(*chunk).agg(F.max("hi").alias("reach")).select(
        *chunk, F.max("reach").over(W.partitionBy(*kind).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    c = carried.select(*[F.col(k).alias(f"c_{k}") for k in chunk], "carry")
    reach = F.max("hi").over(inside.rowsBetween(W.unboundedPreceding, -1))
    parted = rows.withColumn("reach", reach).join(c, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in chunk]).withColumn(
        "fresh", F.coalesce(F.col("lo") > F.greatest("reach", "carry"), F.lit(True)).cast("int"))
    islands = parted.withColumn("island", F.sum("fresh").over(inside)).groupBy(*chunk, "island", "carry").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("carry").isNull() | (F.col("hi") > F.col("carry")))
    return islands.select(*kind, F.greatest("lo", "carry").alias("lo"), "hi")


def _file_matches(sessions: DataFrame, files: DataFrame) -> DataFrame:
    names = ["contract_id", "frequency"]
    undated = files.filter("ts_start_utc is null")
    tallies = undated.groupBy(*[F.col(n).alias(f"f_{n}") for n in names]).agg(*_tally())
    same = [F.col(f"k_{n}").eqNullSafe(F.col(f"f_{n}")) for n in names]
    always = _meet(sessions, tallies, names).select(
        *SESSION, F.lit(0).cast("bigint").alias("n"), "rank", "blocking")

    def days(first: str, last: str) -> Column:
        return F.explode(F.sequence(F.to_date(first), F.to_date(last)))

    # only the worst severity and the rules count here, so spans of one rule that overlap are one span
    kind = [*[f"f_{n}" for n in names], "rule_id", "severity"]
    raw = files.filter("ts_start_utc is not null and ts_end_utc >= ts_start_utc").select(
        *[F.col(n).alias(f"f_{n}") for n in names], "rule_id", "severity",
        F.col("ts_start_utc").alias("lo"), F.col("ts_end_utc").alias("hi")).groupBy(*kind, "lo").agg(F.max("hi").alias("hi"))
    spans = settle(disjoint(raw, kind).withColumn("day", days("lo", "hi")), "file-spans")
    held = sessions.select(*SESSION, "first_ts_utc", "last_ts_utc", days("first_ts_utc", "last_ts_utc").alias("day"))
    touch = (F.col("lo") <= F.col("last_ts_utc")) & (F.col("hi") >= F.col("first_ts_utc"))

    def met(own: bool) -> DataFrame:
        """Spans that name a contract meet its sessions by key; the others, a few a day once they are disjoint, are broadcast."""
        named = F.col(f"f_{names[0]}").isNotNull()
        part = spans.filter(named) if own else small(spans.filter(~named))
        return _wildcards(held, names, own).join(part, [*same, held["day"] == part["day"]]).filter(touch).select(
            *SESSION, "severity", "rule_id")

    overlap = met(True).unionByName(met(False))
    dated = overlap.groupBy(*SESSION).agg(*_tally()).select(
        *SESSION, F.lit(0).cast("bigint").alias("n"), "rank", "blocking")
    return always.unionByName(dated)


def blocked_sessions(quality: DataFrame) -> DataFrame:
    """Sessions an open critical finding withholds."""
    return quality.filter(F.size("blocking_rule_ids") > 0)


def capability(records: DataFrame, requested: list[str], contract_ids: DataFrame | None = None) -> DataFrame:
    """Per contract: grains held, finest grain, and whether the requested grains are there.

    ``contract_ids`` may list contracts nothing is held for; those are empty, not refused.
    """
    held = records.groupBy("contract_id").agg(F.sort_array(F.collect_set("frequency")).alias("held"))
    if contract_ids is not None:
        held = contract_ids.select("contract_id").distinct().join(held, "contract_id", "left")
    grains = F.coalesce("held", F.array().cast("array<string>"))
    missing = F.size(F.array_except(F.array(*[F.lit(g) for g in requested]), grains)) > 0
    return held.select(
        "contract_id", grains.alias("frequencies_held"),
        F.when(F.size(grains) == 0, "empty").when(missing, "refused").otherwise("available").alias("status"),
        F.when(F.array_contains(grains, "minute"), "minute").otherwise("daily").alias("finest"))


def resolve_frequency(capabilities: DataFrame, requested: str | None = None) -> DataFrame:
    """The grain to answer at: the one named, else the finest held, marked as defaulted."""
    named = F.lit(requested).cast("string")
    return capabilities.select(
        "contract_id", F.coalesce(named, "finest").alias("frequency"), F.lit(requested is None).alias("defaulted"))


def published(series: DataFrame, blocked: DataFrame, frequency: str, capabilities: DataFrame) -> DataFrame:
    """Rows of a series that may be shown: refused contracts and blocked sessions removed."""
    allowed = capabilities.filter("status = 'available'").select("contract_id")
    withheld = blocked.filter(F.col("frequency") == frequency).select("contract_id", "trade_date")
    return series.join(allowed, "contract_id", "left_semi").join(
        withheld, ["contract_id", "trade_date"], "left_anti")


def publication_state(series: DataFrame, blocked: DataFrame, frequency: str, capabilities: DataFrame) -> DataFrame:
    """Per contract why a series looks as it does: unsupported, blocked, published or empty."""
    shown = published(series, blocked, frequency, capabilities).groupBy("contract_id").agg(F.count("*").alias("rows"))
    held_back = blocked.filter(F.col("frequency") == frequency).groupBy("contract_id").agg(
        F.count("*").alias("blocked_sessions"))
    rows, gone = F.coalesce("rows", F.lit(0)), F.coalesce("blocked_sessions", F.lit(0))
    return capabilities.join(shown, "contract_id", "left").join(held_back, "contract_id", "left").select(
        "contract_id", rows.alias("rows"), gone.alias("blocked_sessions"),
        F.when(F.col("status") == "refused", "unsupported").when(gone > 0, "blocked")
        .when(rows > 0, "published").otherwise("empty").alias("state"))
