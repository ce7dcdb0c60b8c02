"""Review of a run by family: cards, issues, per-date marks and the evidence picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import (
    ACTION_VERBS, FAMILIES, FAMILY_LABELS, RULES_BY_ID, SUBJECT_FIELD, VOLUME_RULES, lookup,
    strip_family,
)
from ..session import settle, small

SLICE = ["contract_id", "frequency"]
RIBBON_SLOTS = 20


def open_findings(findings: DataFrame) -> DataFrame:
    """Open findings of named slices with their family, label and accused field."""
    return findings.filter("status = 'open' and contract_id is not null and frequency is not null").withColumns({
        "family": strip_family(F.col("rule_id")),
        "label": lookup({r: RULES_BY_ID[r].name for r in RULES_BY_ID}, F.col("rule_id")),
        "field": F.get_json_object("details", "$.field"),
    })


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def family_cards(slices: DataFrame, findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Four cards per slice, empty families included. ``patterns`` are computed per slice."""
    f = open_findings(findings)
    rule = F.col("rule_id")
    volume = rule.isin(VOLUME_RULES) | ((rule == "CMP.NULL_FIELD") & (F.col("field") == "volume"))
    gaps, invalid = F.col("family") == "gaps", F.col("family") == "invalid"
    counts = f.groupBy(*SLICE).agg(
        F.count_if(gaps).alias("gaps"), F.count_if(gaps & (rule != "CMP.SESSION_MISSING")).alias("holes"),
        F.count_if(rule == "CMP.SESSION_MISSING").alias("absent"),
        F.count_if(F.col("family") == "duplicates").alias("duplicates"),
        F.count_if(rule == "UNQ.EXACT_DUPLICATE").alias("exact"),
        F.count_if(rule == "UNQ.KEY_CONFLICT").alias("conflicts"),
        F.count_if(invalid).alias("invalid"), F.count_if(invalid & volume).alias("volumes"))
    order = F.struct(-F.col("lift"), -F.col("support"), F.col("pattern_id"))
    standing = patterns.groupBy(*SLICE).agg(
        F.count("*").alias("patterns"), F.min_by("narrative", order).alias("narrative"))
    rows = slices.select(*SLICE).distinct().join(counts, SLICE, "left").join(standing, SLICE, "left").fillna(0)
    dot = F.lit(" · ")
    prices = F.col("invalid") - F.col("volumes")
    detail = {
        "gaps": F.concat(_plural(F.col("holes"), "session-open hole", "session-open holes"), dot,
                         _plural(F.col("absent"), "session absent", "sessions absent")),
        "duplicates": F.concat(_plural(F.col("exact"), "exact copy", "exact copies"), dot,
                               _plural(F.col("conflicts"), "key conflict", "key conflicts")),
        "invalid": F.concat(_plural(prices, "price", "prices"), dot,
                            _plural(F.col("volumes"), "volume", "volumes")),
        "patterns": F.coalesce("narrative", F.lit("Nothing recurs here")),
    }
    cards = F.array(*[F.struct(
        F.lit(name).alias("family"), F.lit(FAMILY_LABELS[name][0]).alias("label"), F.col(name).alias("count"),
        F.lit(FAMILY_LABELS[name][1]).alias("unit"), detail[name].alias("detail")) for name in FAMILIES])
    return rows.select(*SLICE, F.inline(cards))


def issues(findings: DataFrame, patterns: DataFrame, changelog: DataFrame) -> DataFrame:
    """Per slice, family and rule: days, records and what cleaning did; patterns as reported."""
    verb = F.coalesce(lookup(ACTION_VERBS, F.col("action")), F.col("action"))
    done = changelog.groupBy(*SLICE, "rule_id", "action").agg(F.sum("records").alias("n")).groupBy(
        *SLICE, "rule_id").agg(F.array_join(F.sort_array(F.collect_list(
            F.concat(verb, F.lit(" "), _plural(F.col("n"), "record", "records")))), "; ").alias("did"))
    by_rule = open_findings(findings).groupBy(*SLICE, "family", "rule_id", "label").agg(
        F.count_distinct("trade_date").alias("days"), F.sum("affected_rows").alias("records")
    ).filter("family <> 'off_strip'").join(done, [*SLICE, "rule_id"], "left").select(
        *SLICE, "family", F.col("label").alias("what"), "days", "records",
        F.coalesce("did", F.lit("Marked, left in place")).alias("what_we_did"))
    standing = patterns.select(
        *SLICE, F.lit("patterns").alias("family"), F.col("narrative").alias("what"),
        F.col("distinct_days").alias("days"), F.col("support").alias("records"),
        F.lit("Shown only").alias("what_we_did"))
    return by_rule.unionByName(standing)


def _bar_days(bars: DataFrame, basis: str) -> DataFrame:
    return bars.filter(F.col("basis") == basis).select(
        "contract_id", F.col("source_frequency").alias("frequency"), "trade_date").distinct()


def overlay(findings: DataFrame, bars: DataFrame, patterns: DataFrame, basis: str = "clean") -> DataFrame:
    """Marks per slice and date: absent, partly missing, duplicate, invalid, in a pattern."""
    day = [*SLICE, "trade_date"]
    days = _bar_days(bars, basis).withColumn("has_bar", F.lit(True))
    standing = patterns.select(*SLICE, "rule_id").distinct().withColumn("in_pattern", F.lit(True))
    f = open_findings(findings).filter("trade_date is not null").join(days, day, "left").join(
        standing, [*SLICE, "rule_id"], "left")
    rule, family = F.col("rule_id"), F.col("family")
    absent = (rule == "CMP.SESSION_MISSING") & F.col("has_bar").isNull()
    gap = (family == "gaps") & ~absent
    volume = (family == "invalid") & (rule.isin(VOLUME_RULES) | F.coalesce(F.col("field") == "volume", F.lit(False)))
    slots = F.coalesce(F.get_json_object("details", "$.missing_slots"), F.col("affected_rows").cast("string"))
    caption = F.when(absent, "No settled bar").when(
        gap, F.concat(slots, F.lit(" missing slots at session open"))).when(
        family == "duplicates", "One of several copies was kept").when(volume, "Volume defect").when(
        family == "invalid", F.col("label"))
    marks = f.groupBy(*day).agg(
        F.bool_or(gap).alias("partial_gap"), F.bool_or(family == "duplicates").alias("duplicate"),
        F.bool_or(family == "invalid").alias("invalid"), F.bool_or(volume).alias("invalid_volume"),
        F.bool_or(F.col("in_pattern").isNotNull()).alias("pattern_member"),
        F.min_by(caption, F.when(caption.isNotNull(), F.struct("rule_id", "ts_start_utc", "finding_id"))).alias("caption"))
    flags = ["partial_gap", "duplicate", "invalid", "invalid_volume", "pattern_member"]
    return days.join(marks, day, "full_outer").select(
        *day, F.when(F.col("has_bar"), "present").otherwise("absent").alias("session"),
        *[F.coalesce(name, F.lit(False)).alias(name) for name in flags],
        F.coalesce("caption", F.lit("")).alias("caption"))


def bars_with_marks(bars: DataFrame, marks: DataFrame, family: str, basis: str = "clean") -> DataFrame:
    """Bars beside their marks; dates without a bar stay, with null prices."""
    day = [*SLICE, "trade_date"]
    prices = bars.filter(F.col("basis") == basis).select(
        "contract_id", F.col("source_frequency").alias("frequency"), "trade_date", "open", "high", "low", "close",
        "volume")
    status = {
        "gaps": F.when(F.col("session") == "absent", "gap: session missing").when(
            F.col("partial_gap"), "gap: session-open hole"),
        "duplicates": F.when(F.col("duplicate"), "duplicate"),
        "invalid": F.when(F.col("invalid_volume") & ~F.col("invalid"), "volume defect").when(
            F.col("invalid"), "invalid value"),
        "patterns": F.when(F.col("pattern_member"), "pattern member"),
    }[family]
    return prices.join(marks, day, "full_outer").withColumn("status", F.coalesce(status, F.lit("clean")))


def _first(df: DataFrame, order: list[Column]) -> DataFrame:
    """First row of each slice; findings are compared as structs, no slice is sorted whole."""
    row = F.struct(*df.columns)
    return df.groupBy(*SLICE).agg(F.min_by(row, F.struct(*order)).alias("pick")).select("pick.*")


def _looked_up(picks: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """The records of a few picked ids, found by a counted broadcast and not by a shuffle."""
    picks = settle(picks, "picks")
    wanted = records.select("record_id", "ts_utc", "open", "high", "low", "close", "volume", "source_row").join(
        small(picks.select("record_id").distinct()), "record_id", "left_semi")
    return picks.join(wanted, "record_id", how)


def gap_evidence(findings: DataFrame, records: DataFrame, bars: DataFrame, basis: str = "clean") -> DataFrame:
    """Largest run of missing slots as a ribbon of present and absent minutes, else an absent
    session, else the first gap there is, without a ribbon."""
    f = open_findings(findings).filter("family = 'gaps'")
    missing = f.filter("rule_id = 'CMP.MISSING_TIMESTAMP'")
    pick = _first(missing, [-F.col("affected_rows"), F.col("trade_date"), F.col("ts_start_utc")]).select(
        *SLICE, "trade_date", "affected_rows", "ts_start_utc")
    before = max(0, (RIBBON_SLOTS - 4) // 4)
    first = F.col("ts_start_utc") - F.expr(f"interval {before} minutes")
    slots = F.explode(F.sequence(first, first + F.expr(f"interval {RIBBON_SLOTS - 1} minutes"), F.expr("interval 1 minute")))
    ribbon = pick.withColumn("slot", slots)
    held = records.filter("frequency = 'minute'").select(
        "contract_id", "trade_date", F.date_trunc("minute", "ts_utc").alias("slot")).join(
        small(ribbon.select("contract_id", "trade_date", "slot")), ["contract_id", "trade_date", "slot"], "left_semi"
    ).distinct().withColumn("held", F.lit(True))
    drawn = ribbon.join(held, ["contract_id", "trade_date", "slot"], "left").select(
        *SLICE, F.lit("gaps_ribbon").alias("kind"), "trade_date",
        F.concat(F.col("affected_rows").cast("string"), F.lit(" consecutive minute slots missing on "),
                 F.col("trade_date").cast("string"), F.lit(".")).alias("caption"),
        F.date_format("slot", "HH:mm").alias("label"), F.col("held").isNotNull().alias("present"))
    none = F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("present")
    gone = f.filter("rule_id = 'CMP.SESSION_MISSING'").join(
        _bar_days(bars, basis), [*SLICE, "trade_date"], "left_anti").join(pick.select(*SLICE), SLICE, "left_anti")
    absent = _first(gone, [F.col("trade_date"), F.col("finding_id")]).select(
        *SLICE, F.lit("absent_session").alias("kind"), "trade_date",
        F.concat(F.lit("No settled bar on "), F.col("trade_date").cast("string"), F.lit(".")).alias("caption"), *none)
    rest = f.join(pick.select(*SLICE), SLICE, "left_anti").join(absent.select(*SLICE), SLICE, "left_anti")
    other = _first(rest, [F.col("trade_date"), F.col("rule_id"), F.col("finding_id")]).select(
        *SLICE, F.lit("gaps_ribbon").alias("kind"), "trade_date", F.col("label").alias("caption"), *none)
    return drawn.unionByName(absent).unionByName(other)


def duplicate_evidence(findings: DataFrame, records: DataFrame) -> DataFrame:
    """The first duplicate of each slice: the row kept beside the row dropped."""
    f = open_findings(findings).filter("family = 'duplicates'")
    pick = _first(f, [F.col("trade_date"), F.col("rule_id"), F.col("record_id")]).select(
        *SLICE, "trade_date", "rule_id", F.inline(F.array(
            F.struct(F.lit("kept").alias("which"),
                     F.get_json_object("details", "$.keeps_record_id").cast("bigint").alias("record_id")),
            F.struct(F.lit("dropped").alias("which"), F.col("record_id").alias("record_id")))))
    return _looked_up(pick, records)


def invalid_evidence(findings: DataFrame, records: DataFrame) -> DataFrame:
    """The first invalid value of each slice with the record it accuses."""
    f = open_findings(findings).filter("family = 'invalid'")
    pick = _first(f, [F.col("trade_date"), F.col("rule_id"), F.col("record_id"), F.col("finding_id")])
    field = F.coalesce("field", lookup(SUBJECT_FIELD, F.col("rule_id")), F.lit("unknown"))
    source = F.when(F.col("frequency") == "daily", "vendor").otherwise("source_record")
    return pick.select(
        *SLICE, "trade_date", "rule_id", F.col("label").alias("caption"), field.alias("field"),
        source.alias("evidence_source"), "record_id").transform(lambda chosen: _looked_up(chosen, records, "left"))


def pattern_evidence(patterns: DataFrame, buckets: int = 8) -> DataFrame:
    """Buckets of the strongest pattern's rule and dimension, eight at most."""
    order = [F.desc("lift"), F.desc("support"), F.col("pattern_id")]
    best = patterns.groupBy(*SLICE).agg(F.min_by(
        F.struct("rule_id", "dimension"), F.struct(-F.col("lift"), -F.col("support"), F.col("pattern_id"))).alias("b"))
    same = patterns.join(best.select(*SLICE, "b.*"), [*SLICE, "rule_id", "dimension"], "left_semi")
    ranked = same.withColumn("position", F.row_number().over(W.partitionBy(*SLICE).orderBy(*order)))
    return ranked.filter(F.col("position") <= buckets)


def overview(cards: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row per contract and held grain with the four family counts."""
    wide = cards.groupBy(*SLICE).agg(*[
        F.max(F.when(F.col("family") == name, F.col("count"))).alias(name) for name in FAMILIES])
    return wide.join(contracts.select("contract_id", "root"), "contract_id", "left")
