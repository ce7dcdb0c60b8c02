"""One callable per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.catalogue import ENGINE_RULES, rules_frame, strip_family
from tapewright.functions import clock
from tapewright.functions.symbols import parse_symbol
from tapewright.operators import bars as B
from tapewright.operators import cleaning as C
from tapewright.operators import compare as X
from tapewright.operators import gate as G
from tapewright.operators import patterns as P
from tapewright.operators import reconcile as R
from tapewright.operators import reports as RP
from tapewright.operators import review as RV
from tapewright.operators import scope as S
from tapewright.operators import scoring as SC
from tapewright.operators import suggestions as SG
from tapewright.operators.vwap import vwap_15m
from tapewright.plans.assess import rule_counts, rule_findings, run_rules
from tapewright.plans.load import load_lines
from tapewright.session import scratch_path, settle
from tapewright.sources import inference, ingest, inject, landing, purge, readers, reference, sinks

from .env import OVERRIDES, Env, env, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Evidence compared beside the finding columns: name in details, type.
EVIDENCE: dict[str, list[tuple[str, str]]] = {
    "CMP.NULL_FIELD": [("field", "string")],
    "CMP.MISSING_TIMESTAMP": [("missing_slots", "bigint")],
    "CMP.SESSION_MISSING": [("window_basis", "string"), ("expected_records", "bigint")],
    "CMP.PARTIAL_SESSION": [("window_basis", "string"), ("completeness_pct", "double"), ("actual_slots", "bigint")],
    "CMP.SPARSE_SERIES": [("sessions", "bigint"), ("first_session", "string")],
    "UNQ.EXACT_DUPLICATE": [("copies", "bigint"), ("keeps_record_id", "bigint"), ("keeps_source_row", "bigint")],
    "UNQ.KEY_CONFLICT": [("variants", "bigint")],
    "VAL.NON_POSITIVE_PRICE": [("field", "string"), ("value", "double")],
    "VAL.NEGATIVE_VOLUME": [("value", "bigint")],
    "VAL.NON_INTEGER_VOLUME": [("source_value", "string"), ("loaded_value", "bigint")],
    "VAL.OFF_TICK_PRICE": [("field", "string"), ("value", "double"), ("residual", "double")],
    "VAL.ZERO_VOLUME_WITH_RANGE": [("basis", "string"), ("range", "double")],
    "VAL.PRICE_MAGNITUDE": [("field", "string"), ("value", "double")],
    "VAL.EXTREME_VOLUME": [("value", "bigint"), ("max_plausible", "bigint")],
    "CON.HIGH_LT_LOW": [("high", "double"), ("low", "double")],
    "CON.OPEN_OUT_OF_RANGE": [("value", "double")],
    "CON.CLOSE_OUT_OF_RANGE": [("value", "double"), ("basis", "string")],
    "CON.WEEKEND_RECORD": [("weekday", "string")],
    "CON.STALE_REPEAT": [("run_length", "bigint"), ("threshold_n", "bigint"), ("repeated_close", "double")],
    "CON.PRICE_JUMP": [("log_return", "double"), ("previous_close", "double")],
    "CON.DERIVED_BAR_INVALID": [("source", "string"), ("close", "double")],
    "TIM.TIMEZONE_MISALIGNED": [("observed_dead_hour_local", "bigint"), ("offset_hours", "bigint")],
    "TIM.OFF_GRID": [("interval_seconds", "bigint")],
    "REC.OHLC_DISAGREE": [("field", "string"), ("difference", "double"), ("difference_ticks", "double"),
                          ("comparison", "string")],
    "REC.VOLUME_SHORTFALL": [("ratio", "double"), ("shortfall", "bigint")],
    "REC.SESSION_ONLY_IN_ONE": [("records", "bigint")],
    "REC.CLOSE_CONVENTION": [("close_gap_ticks", "double"), ("close_at_mark", "double"), ("mark_gap_minutes", "double")],
    "ROL.THIN_NEAR_EXPIRY": [("window_start", "string"), ("median_session_volume_inside", "double"),
                             ("expiry_basis", "string")],
    "ROL.NO_SUCCESSOR": [("expiry", "string")],
    "OUT.RETURN_MAD": [("log_return", "double"), ("median", "double"), ("mad", "double"), ("modified_z", "double")],
    "OUT.VOLUME_MAD": [("log_volume", "double"), ("median", "double"), ("mad", "double"), ("modified_z", "double")],
}
FULL_TAPE_RULES = {
    rule for rule in ENGINE_RULES
    if rule.startswith(("VAL.", "UNQ.", "TIM.")) or rule in (
        "CMP.NULL_FIELD", "CON.HIGH_LT_LOW", "CON.OPEN_OUT_OF_RANGE", "CON.CLOSE_OUT_OF_RANGE",
        "CON.WEEKEND_RECORD", "CON.RECORD_IN_HALT", "CON.RECORD_ON_HOLIDAY", "CON.STALE_REPEAT", "CON.PRICE_JUMP")
}
BASE = ["finding_id", "rule_id", "severity", "contract_id", "frequency", "compare_frequency", "trade_date",
        "ts_start_utc", "ts_end_utc", "record_id", "affected_rows"]


def query(name: str):
    def register(fn: Callable[[Env], DataFrame]) -> Callable[[Env], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(env(spark, sf_dir)))
        return fn
    return register


def with_evidence(found: DataFrame, rule_id: str) -> DataFrame:
    return found.select(*BASE, *[
        F.get_json_object("details", f"$.{name}").cast(kind).alias(name) for name, kind in EVIDENCE.get(rule_id, [])])


def _rule_scope(e: Env, rule_id: str) -> S.Scope:
    if rule_id == "TIM.TIMEZONE_MISALIGNED":
        quiet = e.tape.filter(F.hour("ts_exchange") != 3)
        return S.build_scope(e.spark, e.tables(quiet), overrides=OVERRIDES)
    if rule_id == "ROL.THIN_NEAR_EXPIRY":
        return e.rolling
    if rule_id.startswith("OUT."):
        return S.build_scope(e.spark, e.tables(e.tape, actions=e.actions), overrides=OVERRIDES)
    return e.whole if rule_id in FULL_TAPE_RULES else e.scope


for _rule in ENGINE_RULES:
    query(_rule)(lambda e, rule=_rule: with_evidence(rule_findings(_rule_scope(e, rule), rule), rule))


# ---- calendar and reference ---------------------------------------------------------------

@query("CAL-01")
def _(e: Env) -> DataFrame:
    """Symbols of the tape, some bent out of shape."""
    n = F.col("record_id")
    symbol = F.when(n % 7 == 0, F.lower("contract_id")).when(n % 7 == 1, F.concat(F.lit("X"), "contract_id")).when(
        n % 7 == 2, F.concat("contract_id", F.lit("!"))).otherwise(F.col("contract_id"))
    parts = parse_symbol(F.col("symbol"), reference.KNOWN_ROOTS)
    return e.tape.select(symbol.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("rows")).select(
        "symbol", "rows", *[c.alias(k) for k, c in parts.items()])


@query("CAL-02")
def _(e: Env) -> DataFrame:
    """Ticks of the fields the tape quotes, with how often each is quoted."""
    held = e.tape.join(e.contracts.select("contract_id", "root"), "contract_id").groupBy("root", "frequency").agg(
        F.count("*").alias("rows"))
    products = reference.product_dim(e.spark).select("root", "exchange", "multiplier", "slots_1m", "spans_midnight")
    return reference.tick_dim(e.spark).join(held, ["root", "frequency"]).join(products, "root")


@query("CAL-03")
def _(e: Env) -> DataFrame:
    root = parse_symbol(F.col("contract_id"), reference.KNOWN_ROOTS)["root"]
    day = clock.trade_date(F.col("ts_exchange"), reference.open_second(root))
    return e.tape.filter("frequency = 'minute'").select("contract_id", "ts_exchange", day.alias("d")).groupBy(
        "contract_id", F.col("d").alias("trade_date")).agg(
        F.count("*").alias("rows"), F.min("ts_exchange").alias("first"), F.max("ts_exchange").alias("last"))


@query("CAL-04")
def _(e: Env) -> DataFrame:
    """Bounds of the tape's sessions, and of the same dates half a year on, across daylight saving."""
    days = e.whole.sessions.filter("frequency = 'minute'").select(
        "root", F.explode(F.array("trade_date", F.add_months("trade_date", 6))).alias("trade_date")).distinct()
    opens, closes = clock.session_bounds(F.col("trade_date"), F.col("open_sec"), F.col("close_sec"), F.col("timezone"))
    return days.join(reference.product_dim(e.spark), "root").select(
        "root", "trade_date", opens.alias("open_utc"), closes.alias("close_utc"))


@query("CAL-05")
def _(e: Env) -> DataFrame:
    days = e.whole.sessions.filter("frequency = 'minute'").select("root", "trade_date").distinct()
    halts = clock.halt_windows(F.col("trade_date"), F.col("halts"), F.col("open_sec"), F.col("close_sec"), F.col("timezone"))
    return days.join(reference.product_dim(e.spark), "root").select("root", "trade_date", F.inline(halts))


@query("CAL-06")
def _(e: Env) -> DataFrame:
    years = e.whole.sessions.select(F.explode(F.sequence(
        F.year(F.date_sub("trade_date", 5)), F.year(F.date_add("trade_date", 366)))).alias("year")).distinct()
    return clock.holidays(years).withColumnRenamed("day", "trade_date")


@query("CAL-07")
def _(e: Env) -> DataFrame:
    return reference.read_calendar(e.whole.calendar, root="ZC", start="2024-01-02").drop("exchange")


@query("CAL-08")
def _(e: Env) -> DataFrame:
    return reference.calendar_for_loaded(e.tape, e.contracts).withColumn("halts", F.size("halts_utc")).drop("halts_utc")


@query("CAL-09")
def _(e: Env) -> DataFrame:
    """Contracts the tape introduces beside one that is known and one that cannot be parsed."""
    odd = F.when(F.col("record_id") % 1000 == 0, F.concat(F.lit("spread "), "contract_id")).otherwise(F.col("contract_id"))
    known = e.contracts.filter("contract_id = 'ESH24'")
    return reference.ensure_contracts(e.tape.withColumn("contract_id", odd), known).drop("timezone")


@query("CAL-10")
def _(e: Env) -> DataFrame:
    return reference.contract_coverage(e.tape, e.contracts, active_on="2024-01-10")


@query("CAL-12")
def _(e: Env) -> DataFrame:
    days = e.scope.sessions.filter("frequency = 'minute'").select("root", "trade_date").distinct()
    return reference.expected_grid(days, e.scope.calendar).groupBy("root", "trade_date").agg(
        F.count("*").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


# ---- scope and windows ----------------------------------------------------------------------

@query("WIN-01")
def _(e: Env) -> DataFrame:
    scoped = S.scope_records(e.tape, e.contracts, e.batches, contract_ids=["ESH24", "ZCH24"], frequencies=["minute"])
    return scoped.groupBy("contract_id", "root", "exchange", "bar_interval", "batch_id", "first_trade_date",
                          "last_trade_date").agg(F.count("*").alias("records"), F.sum("volume").alias("volume"))


@query("WIN-02")
def _(e: Env) -> DataFrame:
    """Three floors, so that every basis is met."""
    parts = [S.coverage_windows(e.scope.sessions, e.contracts, floor).withColumn("volume_floor", F.lit(floor))
             for floor in (1000.0, 3400.0, 1e9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WIN-03")
def _(e: Env) -> DataFrame:
    return e.rolling.roll


@query("WIN-04")
def _(e: Env) -> DataFrame:
    days = e.rolling.sessions.select("contract_id", "frequency", "trade_date")
    return days.join(e.rolling.windows, ["contract_id", "frequency"]).withColumn(
        "reason", S.suppression_reason(F.col("trade_date")))


@query("WIN-05")
def _(e: Env) -> DataFrame:
    whole = S.calendar_refusals(e.whole.sessions, e.whole.calendar).withColumn("scope", F.lit("every day"))
    return whole.unionByName(S.calendar_refusals(e.scope.sessions, e.scope.calendar).withColumn(
        "scope", F.lit("weekdays")))


# ---- reconciliation and runs --------------------------------------------------------------

@query("REC-01")
def _(e: Env) -> DataFrame:
    return e.scope.frame.drop("vendor_ts_utc")


@query("REC-02")
def _(e: Env) -> DataFrame:
    return R.close_marks(e.scope).drop("first_ts_utc", "last_ts_utc")


@query("RUN-01")
def _(e: Env) -> DataFrame:
    """A pass over every day of the tape: the calendar rules refuse, the others report."""
    found, refused = run_rules(e.whole, run_id="run-2")
    return rule_counts(found, refused).select("rule_id", "outcome", "findings", "affected_rows")


@query("RUN-02")
def _(e: Env) -> DataFrame:
    """The assessed run: findings, decisions and metric rows per rule or dimension."""
    counts = e.findings.groupBy(F.lit("findings").alias("part"), F.col("rule_id").alias("key")).agg(F.count("*").alias("n"))
    acts = e.actions.groupBy(F.lit("actions").alias("part"), F.col("rule_id").alias("key")).agg(F.count("*").alias("n"))
    rows = e.metrics.groupBy(F.lit("metrics").alias("part"), F.col("dimension").alias("key")).agg(F.count("*").alias("n"))
    return counts.unionByName(acts).unionByName(rows)


# ---- cleaning and scores --------------------------------------------------------------------

@query("CLN-01")
def _(e: Env) -> DataFrame:
    """Decisions of the run, after the ones on ES had already been taken."""
    prior = C.cleaning_actions(e.findings.filter("contract_id = 'ESH24'"))
    return C.cleaning_actions(e.findings, prior)


@query("CLN-02")
def _(e: Env) -> DataFrame:
    return C.clean_records(e.tape, e.actions).select("record_id", "contract_id", "frequency", "trade_date", "close")


@query("CLN-03")
def _(e: Env) -> DataFrame:
    return C.exclusion_rate(e.tape, e.contracts, e.actions)


@query("CLN-04")
def _(e: Env) -> DataFrame:
    log = C.changelog(e.actions, e.tape, rules_frame(e.spark), start="2024-01-03", end="2024-01-30")
    return C.changelog_page(log, limit=100, offset=10)


@query("SCR-01")
def _(e: Env) -> DataFrame:
    return SC.expected_records(e.scope)


@query("SCR-02")
def _(e: Env) -> DataFrame:
    return e.dimensions


@query("SCR-03")
def _(e: Env) -> DataFrame:
    return R.reconciliation_score(e.scope, e.findings)


@query("SCR-04")
def _(e: Env) -> DataFrame:
    return e.scores


@query("SCR-05")
def _(e: Env) -> DataFrame:
    return SC.score_if_resolved(e.scope, e.findings)


@query("SCR-06")
def _(e: Env) -> DataFrame:
    return SC.worklist(e.findings, SC.score_if_resolved(e.scope, e.findings)).drop("dimension_from", "overall_from")


@query("SCR-07")
def _(e: Env) -> DataFrame:
    return e.metrics.filter("frequency <> 'cross'")


@query("SCR-08")
def _(e: Env) -> DataFrame:
    return R.cross_metrics(e.scope, e.findings)


@query("COR-01")
def _(e: Env) -> DataFrame:
    return e.corroboration


# ---- gate -----------------------------------------------------------------------------------

def _file_finding(e: Env) -> DataFrame:
    """The run's findings with a file-wide and a contract-wide critical claim added."""
    span = e.tape.filter("batch_id = 'b-zch24'").agg(
        F.min("ts_utc").alias("a"), F.max_by("ts_utc", F.col("ts_utc")).alias("b"))
    extra = span.select(F.explode(F.array(
        F.struct(F.lit("TIM.TIMEZONE_MISALIGNED").alias("rule_id"), F.lit("minute").alias("frequency"),
                 F.lit(None).cast("string").alias("contract_id"), F.lit(None).cast("date").alias("trade_date"),
                 F.col("a").alias("ts_start_utc"), (F.col("a") + F.expr("interval 3 days")).alias("ts_end_utc")),
        F.struct(F.lit("CON.DERIVED_BAR_INVALID").alias("rule_id"), F.lit(None).cast("string").alias("frequency"),
                 F.lit("SBH24").alias("contract_id"), F.to_date(F.col("a") + F.expr("interval 9 days")).alias("trade_date"),
                 F.lit(None).cast("timestamp").alias("ts_start_utc"), F.lit(None).cast("timestamp").alias("ts_end_utc")),
    )).alias("x")).select("x.*").withColumns({
        "finding_id": F.concat(F.lit("extra-"), "rule_id"), "severity": F.lit("critical"), "status": F.lit("open"),
        "affected_rows": F.lit(1).cast("bigint")})
    return e.findings.unionByName(extra, allowMissingColumns=True)


def _gate_quality(e: Env) -> DataFrame:
    return G.session_quality(G.record_sessions(e.tape), _file_finding(e))


@query("GAT-01")
def _(e: Env) -> DataFrame:
    return _gate_quality(e)


@query("GAT-02")
def _(e: Env) -> DataFrame:
    return G.blocked_sessions(_gate_quality(e))


def _one_grain(e: Env) -> DataFrame:
    """The tape with SB held at daily grain only."""
    return e.tape.filter("not (contract_id = 'SBH24' and frequency = 'minute')")


def _asked(e: Env) -> DataFrame:
    return e.contracts.select("contract_id").unionByName(
        e.contracts.select(F.concat(F.col("root"), F.lit("Z99")).alias("contract_id")))


@query("GAT-03")
def _(e: Env) -> DataFrame:
    one = G.capability(_one_grain(e), ["minute"], _asked(e)).withColumn("asked", F.lit("minute"))
    both = G.capability(_one_grain(e), ["minute", "daily"], _asked(e)).withColumn("asked", F.lit("both"))
    caps = one.unionByName(both)
    grain = G.resolve_frequency(one).select("contract_id", F.col("frequency").alias("resolved"), "defaulted")
    return caps.join(grain, "contract_id")


@query("GAT-04")
def _(e: Env) -> DataFrame:
    caps = G.capability(_one_grain(e), ["minute"], _asked(e))
    blocked = G.blocked_sessions(_gate_quality(e))
    shown = B.read_bars(e.bars, basis="clean", source="derived")
    return G.publication_state(shown, blocked, "minute", caps)


# ---- bars, VWAP, comparison -------------------------------------------------------------------

@query("INS-01")
def _(e: Env) -> DataFrame:
    raw = B.daily_bars(e.tape, "raw")
    return raw.unionByName(B.daily_bars(e.tape, "clean", e.actions))


@query("INS-02")
def _(e: Env) -> DataFrame:
    return B.vendor_bars(e.tape, "raw").unionByName(B.vendor_bars(e.tape, "clean", e.actions))


@query("INS-03")
def _(e: Env) -> DataFrame:
    return B.bar_provenance(e.bars, e.contracts, e.scope.calendar).select(
        "contract_id", "trade_date", "basis", "source", "session_boundary", "expected_count", "completeness_pct",
        "close_convention")


@query("INS-04")
def _(e: Env) -> DataFrame:
    return B.annotate_bars(e.bars, e.quality).select(
        "contract_id", "trade_date", "basis", "source", "finding_count", "max_severity")


@query("INS-05")
def _(e: Env) -> DataFrame:
    out = None
    for basis in ("raw", "clean"):
        for source in ("derived", "vendor"):
            part = B.read_bars(e.bars, "ZCH24", basis=basis, source=source)
            out = part if out is None else out.unionByName(part)
    return out.select("contract_id", "trade_date", "basis", "source", "open", "high", "low", "close", "volume")


@query("INS-06")
def _(e: Env) -> DataFrame:
    return vwap_15m(e.tape, "clean", e.actions)


@query("INS-07")
def _(e: Env) -> DataFrame:
    return vwap_15m(e.tape, "raw", price_basis="close")


@query("INS-08")
def _(e: Env) -> DataFrame:
    return X.compare_vwap(vwap_15m(e.tape, "raw"), vwap_15m(e.tape, "clean", e.actions))


def _sides(df: DataFrame, a: str, b: str) -> DataFrame:
    fields = ["open", "high", "low", "close", "volume"]
    return df.select(*[c for c in df.columns if c not in (a, b)], *[
        F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in (a, b) for f in fields])


@query("INS-09")
def _(e: Env) -> DataFrame:
    raw, clean = (B.read_bars(e.bars, basis=b, source="derived") for b in ("raw", "clean"))
    return _sides(X.compare_bars(raw, clean), "raw", "clean")


@query("INS-10")
def _(e: Env) -> DataFrame:
    derived, vendor = (B.read_bars(e.bars, basis="clean", source=s) for s in ("derived", "vendor"))
    return _sides(X.compare_frequency(derived, vendor), "derived", "supplied")


@query("INS-11")
def _(e: Env) -> DataFrame:
    derived, vendor = (B.read_bars(e.bars, basis="clean", source=s) for s in ("derived", "vendor"))
    return X.attach_supplied(derived, vendor).select(
        "contract_id", "trade_date", "close", "volume", "supplied_close", "supplied_volume", "status", "close_diff",
        "volume_ratio")


# ---- patterns and suggestions ---------------------------------------------------------------

@query("PAT-01")
def _(e: Env) -> DataFrame:
    return P.record_exposure(e.tape, e.batches)


@query("PAT-02")
def _(e: Env) -> DataFrame:
    return P.finding_tallies(e.findings, e.tape, e.batches)


@query("PAT-03")
def _(e: Env) -> DataFrame:
    return P.ordered(e.patterns)


def _rooted(e: Env) -> DataFrame:
    return SG.with_root(e.patterns, e.facts)


SUGGESTION_GENERATORS: dict[str, Callable[[Env], DataFrame]] = {
    "SUG-01": lambda e: SG.halt_window(_rooted(e)),
    "SUG-02": lambda e: SG.holiday_or_roll(_rooted(e), e.facts, e.scope.calendar),
    "SUG-03": lambda e: SG.dedupe_tie_break(_rooted(e)),
    "SUG-04": lambda e: SG.tick_reference(SG.with_root(e.even_patterns, e.facts)),
    "SUG-05": lambda e: SG.settlement_close(_rooted(e)),
    "SUG-06": lambda e: SG.shortfall_on_roll(_rooted(e)),
}
for _name, _fn in SUGGESTION_GENERATORS.items():
    query(_name)(lambda e, fn=_fn: fn(e))


@query("SUG-07")
def _(e: Env) -> DataFrame:
    return SG.suggest(e.patterns, e.findings, e.metrics, e.facts, e.scope.calendar)


# ---- reports --------------------------------------------------------------------------------

@query("RPT-01")
def _(e: Env) -> DataFrame:
    listed = RP.list_findings(e.findings, status="open")
    return RP.findings_page(listed, e.tape, e.batches, e.corroboration, limit=500).select(*BASE, "filename", "source_row", "corroboration")


@query("RPT-02")
def _(e: Env) -> DataFrame:
    return RP.top_issues(e.findings)


@query("RPT-03")
def _(e: Env) -> DataFrame:
    """Counts over the whole tape; what its weekend rows were is the reject count."""
    weekend = e.tape.filter(~F.dayofweek("trade_date").between(2, 6))
    return RP.record_counts(e.tape, weekend, e.batches)


@query("RPT-04")
def _(e: Env) -> DataFrame:
    out = None
    for group in RP.GROUPINGS:
        part = RP.metrics_by(e.metrics, group).withColumn("grouping", F.lit(group)).withColumn(
            "key", F.col(group).cast("string")).drop(group)
        out = part if out is None else out.unionByName(part)
    return out


@query("RPT-05")
def _(e: Env) -> DataFrame:
    return RP.metrics_by_rule(e.findings)


@query("RPT-06")
def _(e: Env) -> DataFrame:
    return RP.summary(e.scores, e.findings, e.tape, e.batches)["overall"]


@query("RPT-07")
def _(e: Env) -> DataFrame:
    return RP.contract_rows(e.scores, e.findings).drop("top_issue", "settlement_issue")


@query("RPT-08")
def _(e: Env) -> DataFrame:
    rows = RP.contract_issues(e.findings)
    return rows.select("contract_id", *[
        F.col(f"{issue}.{f}").alias(f"{issue}_{f}")
        for issue in ("top_issue", "settlement_issue") for f in ("rule_id", "label", "severity", "findings")])


@query("RPT-09")
def _(e: Env) -> DataFrame:
    return RP.worst_field(e.findings)


def _slices(e: Env) -> DataFrame:
    return e.scope.sessions.select("contract_id", "frequency")


@query("RPT-10")
def _(e: Env) -> DataFrame:
    return RV.family_cards(_slices(e), e.findings, e.slice_patterns)


def _log(e: Env) -> DataFrame:
    return C.changelog(e.actions, e.tape, rules_frame(e.spark))


@query("RPT-11")
def _(e: Env) -> DataFrame:
    return RV.issues(e.findings, e.slice_patterns, _log(e))


@query("RPT-12")
def _(e: Env) -> DataFrame:
    return RV.overlay(e.findings, e.bars, e.slice_patterns)


@query("RPT-13")
def _(e: Env) -> DataFrame:
    """All four kinds of evidence, told apart by ``kind``."""
    gaps = RV.gap_evidence(e.findings, e.tape, e.bars).select(
        "contract_id", "frequency", "kind", "trade_date", F.col("label").alias("item"),
        F.col("present").cast("string").alias("value"), F.lit(None).cast("bigint").alias("source_row"))
    dups = RV.duplicate_evidence(e.findings, e.tape).select(
        "contract_id", "frequency", F.lit("duplicate_rows").alias("kind"), "trade_date",
        F.col("which").alias("item"), F.col("rule_id").alias("value"), "source_row")
    bad = RV.invalid_evidence(e.findings, e.tape).select(
        "contract_id", "frequency", F.lit("invalid_cell").alias("kind"), "trade_date", F.col("field").alias("item"),
        F.col("rule_id").alias("value"), "source_row")
    pats = RV.pattern_evidence(e.slice_patterns).select(
        "contract_id", "frequency", F.lit("pattern_histogram").alias("kind"), F.lit(None).cast("date").alias("trade_date"),
        F.col("bucket").alias("item"), F.col("rule_id").alias("value"), F.col("position").cast("bigint").alias("source_row"))
    return gaps.unionByName(dups).unionByName(bad).unionByName(pats)


@query("RPT-14")
def _(e: Env) -> DataFrame:
    return e.findings.groupBy("rule_id", strip_family(F.col("rule_id")).alias("family")).agg(F.count("*").alias("n"))


@query("RPT-15")
def _(e: Env) -> DataFrame:
    return RV.overview(RV.family_cards(_slices(e), e.findings, e.slice_patterns), e.contracts)


@query("RPT-16")
def _(e: Env) -> DataFrame:
    marks = RV.overlay(e.findings, e.bars, e.slice_patterns)
    out = None
    for family in ("gaps", "duplicates", "invalid", "patterns"):
        part = RV.bars_with_marks(e.bars, marks, family).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out.drop("caption")


# ---- sources and sinks ----------------------------------------------------------------------

def _vendor_text(e: Env) -> DataFrame:
    """The minute tape as a vendor would send it: text, with cells that do not parse."""
    n = F.col("record_id")
    text = e.tape.filter("frequency = 'minute'").select(
        n, F.when(n % 211 == 0, F.lit("")).otherwise(F.col("contract_id")).alias("contract"),
        F.when(n % 223 == 0, F.lit("not-a-time")).otherwise(F.col("ts_source")).alias("timestamp"),
        F.when(n % 227 == 0, F.lit("N/A")).otherwise(F.col("open").cast("string")).alias("open"),
        F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"),
        F.col("close").cast("string").alias("close"),
        F.when(n % 229 == 0, F.lit("many")).when(F.col("volume_source").isNotNull(), F.col("volume_source"))
        .otherwise(F.col("volume").cast("string")).alias("volume"))
    return text


def _drop(e: Env) -> str:
    """A drop of one CSV file in record order, written once; every 233rd row cut short."""
    if not hasattr(e, "_drop_path"):
        e._drop_path = scratch_path(e.spark, "drop")
        cols = ["contract", "timestamp", "open", "high", "low", "close", "volume"]
        line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cols])
        line = F.when(F.col("record_id") % 233 == 0, F.concat_ws(",", "contract", "timestamp")).otherwise(line)
        lines = _vendor_text(e).select("record_id", line.alias("value")).repartitionByRange("record_id")
        lines.sortWithinPartitions("record_id").select("value").write.option(
            "lineSep", "\n").text(e._drop_path)
    return e._drop_path


def _read_lines(e: Env) -> DataFrame:
    """The drop read back under the header it was agreed to have."""
    names = ["contract", "timestamp", "open", "high", "low", "close", "volume"]
    return readers.with_source_row(readers.text_lines(e.spark, _drop(e), names, header=False))


def _csv(e: Env) -> str:
    if not hasattr(e, "_csv_path"):
        e._csv_path = scratch_path(e.spark, "csv")
        sinks.tape_to_csv(_vendor_text(e).drop("record_id"), e._csv_path)
    return e._csv_path


def _parquet(e: Env) -> str:
    if not hasattr(e, "_parquet_path"):
        e._parquet_path = scratch_path(e.spark, "parquet")
        e.tape.select(
            F.col("contract_id").alias("contract_symbol"), F.col("trade_date").alias("date"), "open", "high", "low",
            "close", "volume", "open_interest", F.lit("x").alias("root_id")).write.parquet(e._parquet_path)
    return e._parquet_path


@query("SRC-01")
def _(e: Env) -> DataFrame:
    """A header CSV read as text, counted per contract label."""
    df = readers.read_csv_text(e.spark, _csv(e))
    return df.groupBy(F.coalesce("contract", F.lit("")).alias("contract")).agg(
        F.count("*").alias("rows"), F.count("close").alias("closes"), F.count_if(F.col("volume") == "many").alias("many"),
        F.count(readers.BROKEN).alias("broken"))


@query("SRC-02")
def _(e: Env) -> DataFrame:
    df = readers.read_parquet_text(e.spark, _parquet(e))
    return df.groupBy("contract_symbol").agg(
        F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.sum(F.col("volume").cast("bigint")).alias("volume"))


@query("SRC-03")
def _(e: Env) -> DataFrame:
    """Row numbers of each file of the drop run from 1 without a hole, cut lines counted."""
    df = _read_lines(e)
    per_file = df.groupBy(readers.FILE).agg(
        F.count("timestamp").alias("stamped"),
        F.count("*").alias("n"), F.min("source_row").alias("lo"), F.max("source_row").alias("hi"),
        F.count_distinct("source_row").alias("distinct"), F.count(readers.BROKEN).alias("broken"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("distinct") == F.col("n"))
    return per_file.agg(F.sum("n").alias("rows"), F.sum("stamped").alias("stamped"), F.sum("broken").alias("broken"), F.bool_and(whole).alias("unbroken"))


def _files(e: Env) -> str:
    """A drop of one text file per contract and session, both grains, each delivered twice; its bytes follow from the tape."""
    if not hasattr(e, "_files_path"):
        e._files_path = scratch_path(e.spark, "files")
        lines = e.tape.select(
            "contract_id", "trade_date", "record_id", F.concat_ws(",", "frequency", "record_id", "volume").alias("value"))
        for delivery in ("first", "second"):
            lines.repartition("contract_id", "trade_date").sortWithinPartitions("contract_id", "trade_date", "record_id").select(
                "contract_id", "trade_date", "value").write.partitionBy("contract_id", "trade_date").text(f"{e._files_path}/{delivery}")
    return e._files_path


def _known(e: Env) -> DataFrame:
    """Hash of the one file already loaded, as it lies in the first delivery."""
    day = e.tape.filter("contract_id = 'ESH24'").agg(F.min("trade_date").cast("string")).first()[0]
    mine = F.col("path").contains(f"/contract_id=ESH24/trade_date={day}/") & F.col("filename").like("part-%")
    return landing.hashed(e.spark, f"{_files(e)}/first").filter(mine).select("file_hash")


@query("SRC-05")
def _(e: Env) -> DataFrame:
    checked = landing.landing_check(e.spark, _files(e), _known(e)).filter("filename like 'part-%'")
    return checked.groupBy("file_hash", "file_bytes", "file_format").agg(
        F.count("*").alias("files"), F.count_if("already_ingested").alias("already_ingested"),
        F.count_if("repeated_in_drop").alias("repeated"), F.count_if("duplicate").alias("duplicates"))


@query("SRC-06")
def _(e: Env) -> DataFrame:
    """Both layouts of the tape resolved to record fields, with rows behind each field."""
    out = None
    for df in (readers.read_csv_text(e.spark, _csv(e)), readers.read_parquet_text(e.spark, _parquet(e))):
        layout = ingest.resolve_columns(df.columns)
        rows = ingest.to_targets(df, layout)
        held = [c for c in ingest.TARGETS if layout.source_of("ts" if c == "ts_source" else c)]
        part = rows.agg(*[F.count(c).alias(c) for c in held]).select(
            F.lit(layout.profile or "aliases").alias("layout"), F.lit(",".join(layout.declined)).alias("declined"),
            F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("cells")) for c in held])))
        out = part if out is None else out.unionByName(part)
    return out


def _stamps(e: Env) -> DataFrame:
    return e.tape.filter("frequency = 'minute'").select(
        "contract_id", F.date_trunc("minute", "ts_exchange").cast("timestamp_ntz").alias("ts"))


@query("SRC-07")
def _(e: Env) -> DataFrame:
    minute = inference.infer_interval(_stamps(e)).withColumn("file", F.lit("minute"))
    daily = e.tape.filter("frequency = 'daily'").select("contract_id", F.col("ts_exchange").alias("ts"))
    return minute.unionByName(inference.infer_interval(daily).withColumn("file", F.lit("daily")))


@query("SRC-08")
def _(e: Env) -> DataFrame:
    """The tape as it is, without the break hour, and without another single hour."""
    out = None
    for name, keep in (("all", F.lit(True)), ("no 16", F.hour("ts") != 16), ("no 3", F.hour("ts") != 3)):
        part = inference.infer_timezone(_stamps(e).filter(keep), "minute").withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    vendor = ingest.resolve_columns(e.spark.read.parquet(_parquet(e)).columns)
    return out.unionByName(inference.infer_timezone(_stamps(e), "daily").withColumn("file", F.lit("daily"))).unionByName(
        inference.infer_timezone(_stamps(e), "daily", vendor).withColumn("file", F.lit("profile")))


@query("SRC-09")
def _(e: Env) -> DataFrame:
    odd = F.when(F.col("contract_id") == "CLH24", F.lit("CL spot")).otherwise(F.col("contract_id"))
    stamps = _stamps(e).withColumn("contract_id", odd)
    boundary = ingest.session_boundary(stamps, "minute", ingest.Layout(None, {}, []))
    return inference.profile_file(stamps, "minute", e.tape.filter("frequency = 'daily'")).withColumn(
        "session_boundary", boundary.scalar())


def _loaded(e: Env) -> tuple[DataFrame, DataFrame]:
    """The drop loaded in one scan under the header it was agreed to have."""
    if not hasattr(e, "_load"):
        names = ["contract", "timestamp", "open", "high", "low", "close", "volume"]
        e._load = load_lines([readers.text_lines(e.spark, _drop(e), names, header=False)], "b-load", "minute", ingested_at="2024-02-01")
    return e._load.records, e._load.rejects


@query("SRC-10")
def _(e: Env) -> DataFrame:
    return _loaded(e)[1].groupBy("reason_code", "reason_detail").agg(
        F.count("*").alias("rows"), F.count("raw_payload").alias("payloads"))


@query("SRC-11")
def _(e: Env) -> DataFrame:
    ids = F.count("*").over(Window.partitionBy("record_id"))
    return _loaded(e)[0].withColumn("id_alone", ids == 1).select(
        "id_alone", "contract_id", "frequency", "ts_source", "ts_exchange", "ts_utc", "trade_date", "open", "high", "low", "close",
        "volume", "volume_source")


@query("SRC-12")
def _(e: Env) -> DataFrame:
    records, rejects = _loaded(e)
    batches = e._load.batch.select("batch_id", F.lit("running").alias("status"))
    return ingest.batch_summary(records, rejects, batches)


@query("SRC-14")
def _(e: Env) -> DataFrame:
    rejects = e.tape.filter("record_id % 500 = 0").select("batch_id", "source_row")
    runs = e.findings.select("run_id").distinct().withColumn("batch_id", F.lit(None).cast("string"))
    store = purge.Store(e.tape, rejects, e.findings, e.bars, e.batches, runs)
    left, counts = purge.purge_batch(store, "b-zch24")
    return counts.withColumns({
        "records_left": left.records.agg(F.count("*")).scalar(),
        "purged": left.batches.agg(F.count_if(F.col("status") == "purged")).scalar()})


@query("SRC-15")
def _(e: Env) -> DataFrame:
    """A manifest that is right about one file and wrong about the others."""
    first = f"{_files(e)}/first"
    names = landing.file_hashes(e.spark, first).filter("name like '%/part-%'").select("name")
    manifest = names.withColumn("sha256", _known(e).scalar())
    return landing.verify_checksums(e.spark, first, manifest).select("file_hash", "sha256")


@query("SRC-16")
def _(e: Env) -> DataFrame:
    """A manifest of the tape's files, one of which names the wrong root."""
    per = e.tape.groupBy("contract_id", "frequency").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    ms = lambda c: (F.unix_date(c).cast("bigint") * 86_400_000).cast("string")
    manifest = per.join(e.contracts.select("contract_id", "root", "month_code", "exchange"), "contract_id").select(
        F.col("contract_id").alias("contract_symbol"), "root",
        F.when((F.col("contract_id") == "CLH24") & (F.col("frequency") == "daily"), "Z").otherwise("H").alias("month_code"),
        F.lit("2024").alias("delivery_year"), F.lit("3").alias("delivery_month"), "exchange",
        ms(F.col("a")).alias("first_timestamp_ms"), ms(F.col("b")).alias("last_timestamp_ms"))
    return reference.contracts_from_manifest(manifest).drop("month_code", "timezone")


@query("SRC-18")
def _(e: Env) -> DataFrame:
    """Nine defects planted in the minute tape: the rule each names, and its row beside the rows it came from."""
    before, after, planted = _injected(e)
    cells = ["id", "high", "low", "close", "volume"]
    wanted = planted.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(-1, 6)])))

    def around(tape: DataFrame, row: str, name: str) -> DataFrame:
        """Rows about the planted one: ``name[step]``, itself at step 0."""
        near = wanted.select("kind", "step", (F.col(row) + F.col("step")).alias("source_row"))
        return tape.join(F.broadcast(near), "source_row").groupBy("kind").agg(F.map_from_entries(
            F.collect_list(F.struct("step", F.struct(*cells)))).alias(name))

    both = planted.join(around(before, "original_row", "old"), "kind", "left").join(around(after, "source_row", "new"), "kind", "left")
    old, new = F.col("old"), F.col("new")
    kept = new[0]["id"] == old[0]["id"]
    twin = kept & (new[-1]["id"] == old[0]["id"])
    shows = (
        F.when(F.col("kind") == "negate_volume", kept & (new[0]["volume"] == -old[0]["volume"]))
        .when(F.col("kind") == "swap_high_and_low", kept & (new[0]["high"] == old[0]["low"]) & (new[0]["low"] == old[0]["high"]))
        .when(F.col("kind") == "close_above_high", kept & (new[0]["close"] == F.round(old[0]["high"] + 5, 2)))
        .when(F.col("kind") == "blank_close", kept & new[0]["close"].isNull() & old[0]["close"].isNotNull())
        .when(F.col("kind") == "decimal_shift_10x", kept & (new[0]["close"] == F.round(old[0]["close"] * 10, 2)))
        .when(F.col("kind") == "repeat_row", twin & new[0]["close"].eqNullSafe(new[-1]["close"]))
        .when(F.col("kind") == "conflicting_close_on_one_timestamp", twin & (new[0]["close"] == F.round(old[0]["close"] + 1.25, 2)))
        .when(F.col("kind") == "swap_adjacent_rows", kept & (new[-1]["id"] == old[1]["id"]))
        .otherwise((new[-1]["id"] == old[-1]["id"]) & (new[0]["id"] == old[5]["id"])))
    total = after.agg(F.count("*").alias("rows"), F.count_distinct("source_row").alias("numbers"))
    return both.select("rule_id", "kind", "field_name", F.coalesce(shows, F.lit(False)).alias("shows"),
                       total.select("rows").scalar().alias("rows"), total.select("numbers").scalar().alias("numbers"))


def _injected(e: Env) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All minute rows in record order as one file, then the file with defects and the list of them."""
    path = scratch_path(e.spark, "minutes")
    e.tape.filter("frequency = 'minute'").repartitionByRange("record_id").sortWithinPartitions("record_id").select(
        F.col("record_id").alias("id"), "contract_id", "ts_source", "open", "high", "low", "close", "volume").write.parquet(path)
    schema = ("id bigint, contract_id string, ts_source string, open double, high double, low double, close double, "
              "volume bigint")
    raw = e.spark.read.schema(schema).parquet(path).select(
        "*", F.lit("minutes").alias(readers.FILE), F.concat_ws("#", "_metadata.file_name", F.format_string(
            "%012d", F.col("_metadata.file_block_start"))).alias("_block"))
    tape = settle(readers.with_source_row(raw).drop(readers.FILE, readers.BASE).withColumn(
        "ts_exchange", F.col("ts_source").cast("timestamp_ntz")), "numbered")
    return tape, *inject.inject_defects(tape)


@query("SNK-01")
def _(e: Env) -> DataFrame:
    """Both grains written as CSV and read back, next to the rows they came from."""
    path = scratch_path(e.spark, "snk-csv")
    rows = e.tape.select(
        "record_id", "contract_id", "trade_date", "ts_exchange", "open", "high", "low", "close", "volume")
    sinks.tape_to_csv(rows, path)
    back = readers.read_csv_text(e.spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


@query("SNK-02")
def _(e: Env) -> DataFrame:
    """Bars written; then ZC's clean bars from one source only, changed; then one contract's clean bars gone."""
    path = scratch_path(e.spark, "snk-bars")
    cols = ["contract_id", "trade_date", "basis", "source", "close", "volume"]
    keys = ["contract_id", "basis"]
    bars = e.bars.select(*cols)
    sinks.write_replacing(bars, path, keys, bars.select(*keys))
    corn = bars.filter("contract_id = 'ZCH24' and basis = 'clean'")
    sinks.write_replacing(corn.filter("source = 'derived'").withColumn("volume", F.col("volume") + 1), path, keys, corn.select(*keys))
    sinks.write_replacing(bars.limit(0), path, keys, bars.filter("contract_id = 'ESH24' and basis = 'clean'").select(*keys))
    return sinks.read_replaced(e.spark, path).select(*cols)


@query("SNK-03")
def _(e: Env) -> DataFrame:
    """Weekdays appended, then weekends: the table holds both."""
    path = scratch_path(e.spark, "snk-records")
    sinks.append_records(e.weekdays, path)
    sinks.append_records(e.tape.filter(~F.dayofweek("trade_date").between(2, 6)), path)
    return e.spark.read.parquet(path).groupBy("frequency", "trade_date").agg(
        F.count("*").alias("records"), F.sum("volume").alias("volume"))


@query("UNQ.DUPLICATE_FILE")
def _(e: Env) -> DataFrame:
    """Files of the second delivery whose bytes the first had brought: refused, with the rule named."""
    first = landing.landing_check(e.spark, f"{_files(e)}/first", _known(e)).filter("filename like 'part-%'")
    again = landing.landing_check(e.spark, f"{_files(e)}/second", first.select("file_hash")).filter("duplicate")
    return again.filter("filename like 'part-%'").select(
        F.lit("UNQ.DUPLICATE_FILE").alias("rule_id"), "file_hash", "file_bytes", "already_ingested")
