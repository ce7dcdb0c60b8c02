"""Rule catalogue, score weights and label maps: the fixed values of the ruleset."""

from __future__ import annotations

import copy
import json
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import literal_table


class Rule(NamedTuple):
    rule_id: str
    dimension: str
    name: str
    severity: str
    scope: str
    frequency: str | None
    params: dict[str, Any]


# ---- fixed values -----------------------------------------------------------------------
SEVERITY_RANK = {"info": 1, "warning": 2, "error": 3, "critical": 4}
TRIAGE_WEIGHT = {"critical": 8.0, "error": 4.0, "warning": 2.0, "info": 0.5}
SCORE_WEIGHTS = {
    "completeness": 0.30,
    "validity": 0.25,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "timeliness": 0.10,
    "reconciliation": 0.20,
}
RECORD_DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "timeliness")
DIMENSION_CODES = {
    "completeness": "cmp",
    "uniqueness": "unq",
    "validity": "val",
    "consistency": "con",
    "timeliness": "tim",
    "reconciliation": "rec",
}
DEFECT_SEVERITIES = ("warning", "error", "critical")
EXCLUDING_SEVERITIES = ("error", "critical")
MIN_RECORDS = 100

PRICE_FIELDS = ["open", "high", "low", "close"]
PRICE_BANDS = {
    "CL": [5.0, 500.0],
    "ES": [500.0, 30000.0],
    "GC": [200.0, 20000.0],
    "SB": [2.0, 200.0],
    "SR3": [90.0, 101.0],
    "VX": [5.0, 200.0],
    "ZC": [100.0, 3000.0],
    "ZN": [50.0, 250.0],
}

RULES = [
    Rule("CMP.NULL_FIELD", "completeness", "Null OHLCV field", "error", "record", None,
         {"fields": PRICE_FIELDS + ["volume"]}),
    Rule("CMP.MISSING_TIMESTAMP", "completeness", "Missing grid slots", "warning", "session", "minute",
         {"volume_floor": 1000, "min_run_slots": 1}),
    Rule("CMP.SESSION_MISSING", "completeness", "Session absent", "error", "session", None,
         {"volume_floor": 1000}),
    Rule("CMP.PARTIAL_SESSION", "completeness", "Partial session", "warning", "session", "minute",
         {"threshold": 0.95, "volume_floor": 1000}),
    Rule("CMP.SPARSE_SERIES", "completeness", "Sparse series", "info", "series", None,
         {"min_sessions": 20}),
    Rule("UNQ.EXACT_DUPLICATE", "uniqueness", "Exact duplicate row", "warning", "record", None,
         {"keep": "lowest_source_row"}),
    Rule("UNQ.KEY_CONFLICT", "uniqueness", "Key conflict", "error", "record", None, {}),
    Rule("UNQ.DUPLICATE_FILE", "uniqueness", "Duplicate file", "warning", "file", None, {}),
    Rule("VAL.NON_POSITIVE_PRICE", "validity", "Non-positive price", "error", "record", None,
         {"fields": PRICE_FIELDS}),
    Rule("VAL.NEGATIVE_VOLUME", "validity", "Negative volume", "error", "record", None, {}),
    Rule("VAL.NON_INTEGER_VOLUME", "validity", "Non-integer volume", "warning", "record", None, {}),
    Rule("VAL.OFF_TICK_PRICE", "validity", "Off-tick price", "warning", "record", None,
         {"epsilon_ticks": 1e-4, "fields": PRICE_FIELDS}),
    Rule("VAL.ZERO_VOLUME_WITH_RANGE", "validity", "Zero volume with a price range", "warning", "record",
         None, {"frequencies": ["intraday"], "daily_severity": "info"}),
    Rule("VAL.PRICE_MAGNITUDE", "validity", "Implausible price magnitude", "warning", "record", None,
         {"bands": PRICE_BANDS, "fields": PRICE_FIELDS}),
    Rule("VAL.EXTREME_VOLUME", "validity", "Extreme volume", "info", "record", None,
         {"max_plausible": {"minute": 100_000, "daily": 5_000_000}}),
    Rule("CON.HIGH_LT_LOW", "consistency", "High below low", "error", "record", None, {}),
    Rule("CON.OPEN_OUT_OF_RANGE", "consistency", "Open outside the bar range", "error", "record", None, {}),
    Rule("CON.CLOSE_OUT_OF_RANGE", "consistency", "Close outside the bar range", "error", "record", None,
         {"daily_severity": "warning"}),
    Rule("CON.WEEKEND_RECORD", "consistency", "Weekend session", "error", "record", None, {}),
    Rule("CON.RECORD_IN_HALT", "consistency", "Record inside a halt", "warning", "record", None, {}),
    Rule("CON.RECORD_ON_HOLIDAY", "consistency", "Record on a holiday", "warning", "record", None, {}),
    Rule("CON.STALE_REPEAT", "consistency", "Stale repeated bar", "warning", "session", None,
         {"n": 30, "n_by_root": {"SR3": 120, "ZC": 90, "SB": 90, "VX": 60}}),
    Rule("CON.PRICE_JUMP", "consistency", "Price jump", "info", "record", None,
         {"threshold": {"minute": 0.05, "daily": 0.25}}),
    Rule("CON.DERIVED_BAR_INVALID", "consistency", "Daily bar violates OHLC invariants", "critical",
         "session", None, {"vendor_severity": "warning", "basis": "clean"}),
    Rule("TIM.OUT_OF_ORDER", "timeliness", "Out-of-order timestamp", "warning", "record", None, {}),
    Rule("TIM.FUTURE_TIMESTAMP", "timeliness", "Future timestamp", "error", "record", None, {}),
    Rule("TIM.BEFORE_LISTING", "timeliness", "Record before listing", "warning", "record", None, {}),
    Rule("TIM.AFTER_EXPIRY", "timeliness", "Record after expiry", "error", "record", None, {}),
    Rule("TIM.OFF_GRID", "timeliness", "Off-grid timestamp", "warning", "record", None, {}),
    Rule("TIM.TIMEZONE_MISALIGNED", "timeliness", "Timezone misaligned", "critical", "file", "minute",
         {"min_records": 100, "min_active_hours": 20}),
    Rule("REC.OHLC_DISAGREE", "reconciliation", "Derived bar disagrees with the vendor daily bar", "error",
         "session", None,
         {"tolerance_ticks": 0, "min_coverage_pct": 0.98, "fields": ["open", "high", "low"]}),
    Rule("REC.VOLUME_SHORTFALL", "reconciliation",
         "Minute volume falls short of the vendor daily volume", "warning", "session", None,
         {"max_shortfall_pct": 0.10}),
    Rule("REC.SESSION_ONLY_IN_ONE", "reconciliation", "Session present at one granularity only", "warning",
         "session", None, {"absent_daily_severity": "info"}),
    Rule("REC.CLOSE_CONVENTION", "reconciliation", "Vendor close is a settlement, not a last trade", "info",
         "session", None,
         {"close_convention_ticks": 1, "settlement_mark_local": {"default": "15:00"},
          "mark_tolerance_minutes": 60}),
    Rule("ROL.THIN_NEAR_EXPIRY", "completeness", "Thin volume near expiry", "info", "series", None,
         {"days": 10, "collapse_ratio": 0.2}),
    Rule("ROL.NO_SUCCESSOR", "completeness", "No successor contract", "info", "series", None, {"days": 30}),
    Rule("OUT.RETURN_MAD", "validity", "Outlying log return", "info", "record", None,
         {"threshold": 3.5, "constant": 0.6745, "min_records": 30}),
    Rule("OUT.VOLUME_MAD", "validity", "Outlying volume", "info", "record", None,
         {"threshold": 3.5, "constant": 0.6745, "min_records": 30}),
]

DEDUPE_DROP_RULES = ["UNQ.EXACT_DUPLICATE"]
NEVER_EXCLUDE_RULES = ["VAL.OFF_TICK_PRICE"]
SETTLEMENT_RULES = ["CON.CLOSE_OUT_OF_RANGE", "CMP.SESSION_MISSING", "UNQ.KEY_CONFLICT", "VAL.OFF_TICK_PRICE"]
RECONCILIATION_DEFECTS = ["REC.OHLC_DISAGREE", "REC.VOLUME_SHORTFALL"]
CORROBORATED_RULES = ["CON.CLOSE_OUT_OF_RANGE", "CON.OPEN_OUT_OF_RANGE", "CON.HIGH_LT_LOW"]
SUBJECT_FIELD = {
    "CON.CLOSE_OUT_OF_RANGE": "close",
    "CON.OPEN_OUT_OF_RANGE": "open",
    "VAL.NEGATIVE_VOLUME": "volume",
    "VAL.NON_INTEGER_VOLUME": "volume",
    "VAL.ZERO_VOLUME_WITH_RANGE": "volume",
    "VAL.EXTREME_VOLUME": "volume",
    "TIM.AFTER_EXPIRY": "timestamp",
    "TIM.BEFORE_LISTING": "timestamp",
    "TIM.FUTURE_TIMESTAMP": "timestamp",
    "TIM.OFF_GRID": "timestamp",
    "TIM.OUT_OF_ORDER": "timestamp",
    "TIM.TIMEZONE_MISALIGNED": "timestamp",
    "CON.WEEKEND_RECORD": "timestamp",
    "CON.RECORD_IN_HALT": "timestamp",
    "CON.RECORD_ON_HOLIDAY": "timestamp",
    "REC.VOLUME_SHORTFALL": "volume",
}
FAMILY_RULES = {
    "gaps": ["CMP.MISSING_TIMESTAMP", "CMP.SESSION_MISSING", "CMP.PARTIAL_SESSION"],
    "duplicates": ["UNQ.EXACT_DUPLICATE", "UNQ.KEY_CONFLICT"],
    "invalid": [
        "CMP.NULL_FIELD", "VAL.NON_POSITIVE_PRICE", "VAL.NEGATIVE_VOLUME", "VAL.NON_INTEGER_VOLUME",
        "VAL.OFF_TICK_PRICE", "VAL.ZERO_VOLUME_WITH_RANGE", "VAL.PRICE_MAGNITUDE", "VAL.EXTREME_VOLUME",
        "CON.HIGH_LT_LOW", "CON.OPEN_OUT_OF_RANGE", "CON.CLOSE_OUT_OF_RANGE",
    ],
}
VOLUME_RULES = [
    "VAL.NEGATIVE_VOLUME", "VAL.NON_INTEGER_VOLUME", "VAL.ZERO_VOLUME_WITH_RANGE", "VAL.EXTREME_VOLUME",
]
FAMILIES = ["gaps", "duplicates", "invalid", "patterns"]
FAMILY_LABELS = {
    "gaps": ("Gaps", "runs"),
    "duplicates": ("Duplicates", "records"),
    "invalid": ("Invalid values", "rows"),
    "patterns": ("Recurring patterns", "standing"),
}
ACTION_VERBS = {"exclude": "excluded", "dedupe_drop": "dropped", "coerce": "coerced", "impute": "imputed"}
INTERVAL_SECONDS = {"1 minute": 60, "5 minutes": 300, "15 minutes": 900, "1 hour": 3600, "1 day": 86400}
# ---- end of fixed values ----------------------------------------------------------------

RULES_BY_ID = {rule.rule_id: rule for rule in RULES}
ENGINE_RULES = [rule.rule_id for rule in RULES if rule.rule_id != "UNQ.DUPLICATE_FILE"]


def rule_params(rule_id: str, overrides: dict[str, dict] | None = None) -> dict[str, Any]:
    """Declared params of a rule with a deployment's overrides laid on top."""
    params = copy.deepcopy(RULES_BY_ID[rule_id].params)
    params.update((overrides or {}).get(rule_id, {}))
    return params


def rules_frame(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """The catalogue as rows; 38 of them, so it may always be broadcast."""
    rows = [
        (r.rule_id, r.dimension, r.name, r.severity, r.scope, r.frequency,
         json.dumps(rule_params(r.rule_id, overrides), sort_keys=True), TRIAGE_WEIGHT[r.severity])
        for r in RULES
    ]
    return F.broadcast(literal_table(
        spark,
        "rule_id string, dimension string, name string, rule_severity string, scope string, "
        "applies_to_frequency string, params string, triage_weight double",
        rows,
    ))


def lookup(values: dict[str, Any], key: Column) -> Column:
    """A constant dict as a map expression; missing keys give null."""
    if not values:
        return F.lit(None)
    pairs = [F.lit(item) for entry in values.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, severity)


def severity_name(rank: Column) -> Column:
    return lookup({v: k for k, v in SEVERITY_RANK.items()}, rank)


def rule_dimension(rule_id: Column) -> Column:
    return lookup({r.rule_id: r.dimension for r in RULES}, rule_id)


def strip_family(rule_id: Column) -> Column:
    """Review family of a rule: gaps, duplicates, invalid or off_strip."""
    families = {rule: family for family, members in FAMILY_RULES.items() for rule in members}
    return F.coalesce(lookup(families, rule_id), F.lit("off_strip"))
