"""Scores, cleaning, gate, bars, patterns and review over one assessed tape."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tapewright.catalogue import RULES_BY_ID, SEVERITY_RANK
from tapewright.operators import bars as B
from tapewright.operators import compare as X
from tapewright.operators import gate as G
from tapewright.operators import patterns as P
from tapewright.operators import review as RV
from tapewright.operators import suggestions as SG
from tapewright.operators.cleaning import changelog, cleaning_actions, clean_records, exclusion_rate
from tapewright.operators.corroborate import corroborate
from tapewright.operators.reports import contract_rows, top_issues, worst_field
from tapewright.operators.scoring import dimension_scores, overall_score, score_if_resolved, worklist
from tapewright.plans.assess import assess
from tapewright.session import settle

from .helpers import minutes, records, scope, tables


def _tape(spark):
    lines = []
    for i, day in enumerate(("2025-09-15", "2025-09-16", "2025-09-17")):
        lines.append(minutes("ESZ25", day, "14:30", [6600.0 + (k % 5) * 0.25 for k in range(45)], 50))
        lines.append(f"ESZ25,{day} 15:20:00,6600,6590,6601,6600,-5")
        lines.append(f"ESZ25,{day} 15:21:00,6600,6601,6599,,10")
        lines.append(f"ESZ25,{day} 15:22:00,6600,6601,6599,6600,10")
        lines.append(f"ESZ25,{day} 15:22:00,6600,6601,6599,6600,10")
        lines.append(f"ESZ25,{day} 15:23:00,6600,6601,6599,66{i}0,10")
        lines.append(f"ESZ25,{day} 15:23:00,6600,6601,6599,6650,10")
    daily = """
        ESZ25,2025-09-15,6600.0,6602.0,6599.0,6604.0,3000
        ESZ25,2025-09-16,6600.0,6602.0,6599.0,6600.0,9000
        ESZ25,2025-09-17,6600.0,6601.75,6590.0,6602.5,2000
        ZCZ25,2025-09-17,430.0,431.75,429.0,430.5,2000"""
    return records(spark, "\n".join(lines)).unionByName(records(spark, daily, "daily", "b2"))


OVERRIDES = {"REC.OHLC_DISAGREE": {"min_coverage_pct": 0.0}, "CMP.SESSION_MISSING": {"volume_floor": 10}}


@pytest.fixture(scope="module")
def run(spark):
    tape = settle(_tape(spark), "tape")
    return assess(scope(spark, tape, OVERRIDES, bars=settle(B.build_bars(tape, None, ("clean",)), "bars")))


@pytest.fixture(scope="module")
def actions(run):
    return settle(run.actions, "actions")


def test_scores_renormalise_and_name_their_scope(run):
    rows = {(r["contract_id"], r["frequency"]): r for r in run.scores.collect()}
    assert rows["ESZ25", "minute"]["scope_signature"] == "cmp+unq+val+con+tim+rec"
    assert rows["ESZ25", "minute"]["weight_denominator"] == pytest.approx(1.2)
    assert rows["ZCZ25", "daily"]["scope_signature"] == "cmp+unq+val+con+tim"
    assert rows["ZCZ25", "daily"]["insufficient_data"] and rows["ZCZ25", "daily"]["overall"] is None
    dims = {r["dimension"]: r for r in run.dimensions.filter("contract_id = 'ESZ25' and frequency = 'minute'").collect()}
    want = sum(d["weight"] * d["score"] for d in dims.values()) / 1.2
    assert rows["ESZ25", "minute"]["overall"] == pytest.approx(want, abs=1e-4)
    reason = run.dimensions.filter("contract_id = 'ZCZ25' and dimension = 'reconciliation'").first()["reason"]
    assert reason == "one grain is held, there is no other to compare with"


def test_a_record_counts_once_per_dimension(run):
    bad = run.findings.filter("contract_id = 'ESZ25' and frequency = 'minute' and record_id is not null and severity <> 'info'")
    rules = {r: RULES_BY_ID[r].dimension for r in RULES_BY_ID}
    want = {}
    for row in bad.collect():
        want.setdefault(rules[row["rule_id"]], set()).add(row["record_id"])
    got = {r["dimension"]: r["affected_records"] for r in run.dimensions.filter(
        "contract_id = 'ESZ25' and frequency = 'minute' and dimension <> 'reconciliation'").collect()}
    assert got == {d: len(want.get(d, ())) for d in got}
    assert got["consistency"] == 8  # three inverted ranges, five closes above the high


def test_dry_run_equals_scoring_without_the_rule(run):
    resolved = {(r["contract_id"], r["frequency"], r["rule_id"]): r for r in score_if_resolved(run.scope, run.findings, 1).collect()}
    rules = {k[2] for k in resolved if k[0] == "ESZ25" and k[1] == "minute"}
    assert {"CON.HIGH_LT_LOW", "UNQ.KEY_CONFLICT", "REC.VOLUME_SHORTFALL", "CMP.MISSING_TIMESTAMP"} <= rules
    for rule in ("CON.HIGH_LT_LOW", "UNQ.KEY_CONFLICT", "REC.VOLUME_SHORTFALL"):
        rest = run.findings.filter(F.col("rule_id") != rule)
        dims = settle(dimension_scores(run.scope, rest), "dims")
        want = overall_score(run.scope, dims, 1).filter("contract_id = 'ESZ25' and frequency = 'minute'").first()["overall"]
        assert resolved["ESZ25", "minute", rule]["overall"] == pytest.approx(want, abs=1e-4)
    gap = resolved["ESZ25", "minute", "CMP.MISSING_TIMESTAMP"]
    assert gap["dimension_score"] > 99 > gap["dimension_from"]


def test_worklist_uses_rank_not_text(run):
    rows = worklist(run.findings, score_if_resolved(run.scope, run.findings)).filter(
        "contract_id = 'ESZ25' and frequency = 'minute'").collect()
    assert [r["rank"] for r in rows] == sorted((r["rank"] for r in rows), reverse=True)
    assert all(r["severity"] in SEVERITY_RANK for r in rows)
    assert next(r for r in rows if r["rule_id"] == "CON.HIGH_LT_LOW")["rank"] == 12.0


def test_cleaning_is_idempotent_and_spares_off_tick(run, actions):
    assert cleaning_actions(run.findings, actions).count() == 0
    kinds = {(r["rule_id"], r["action"]) for r in actions.collect()}
    assert ("UNQ.EXACT_DUPLICATE", "dedupe_drop") in kinds and ("UNQ.KEY_CONFLICT", "exclude") in kinds
    assert not any(rule == "VAL.OFF_TICK_PRICE" for rule, _ in kinds)
    kept = clean_records(run.scope.tables.records, actions)
    gone = {r["record_id"] for r in actions.collect()}
    assert kept.count() == run.scope.tables.records.count() - len(gone)
    rate = exclusion_rate(run.scope.tables.records, run.scope.tables.contracts, actions).filter("view = 'overall'").first()
    assert rate["excluded"] == len(gone)


def test_bars_keep_edge_nulls_and_lowest_row(spark):
    tape = records(spark, """
        ESZ25,2025-09-15 09:00:00,,6601.00,6600.00,6600.75,120
        ESZ25,2025-09-15 09:00:00,6600.50,6603.00,6600.50,6601.75,
        ESZ25,2025-09-15 09:02:00,6600.75,6602.00,6599.50,,90""")
    bar = B.daily_bars(tape, "raw").first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (None, 6603.0, 6599.5, None, 210)
    assert (bar["record_count"], bar["volume_null_count"], bar["open_interest"]) == (3, 1, None)


def test_bases_differ_where_cleaning_acted(run, actions):
    tape = run.scope.tables.records
    built = settle(B.build_bars(tape, actions), "built")
    both = X.compare_bars(B.read_bars(built, basis="raw"), B.read_bars(built, basis="clean"))
    assert [r["differs"] for r in both.collect()] == [True, True, True]
    sides = X.compare_frequency(B.read_bars(built), B.read_bars(built, source="vendor")).collect()
    assert {r["status"] for r in sides if r["contract_id"] == "ZCZ25"} == {"not_comparable"}
    supplied = X.attach_supplied(B.read_bars(built), B.read_bars(built, source="vendor")).orderBy("trade_date").collect()
    assert supplied[1]["volume_ratio"] == pytest.approx(supplied[1]["volume"] / 9000, abs=1e-4)
    annotated = B.annotate_bars(B.bar_provenance(built, run.scope.tables.contracts, run.scope.calendar),
                                G.session_quality(G.record_sessions(tape), run.findings))
    row = annotated.filter("basis = 'clean' and source = 'derived'").orderBy("trade_date").first()
    assert row["session_boundary"] == "CME:ES:2025-09-14T22:00:00Z/2025-09-15T21:00:00Z" and row["expected_count"] == 1380
    assert row["max_severity"] == "critical" and row["finding_count"] > 0


def test_corroboration_states(run):
    found = run.findings.filter("rule_id = 'CON.CLOSE_OUT_OF_RANGE' or rule_id like 'REC.%'")
    states = {str(r["trade_date"]): r["state"] for r in corroborate(found, run.metrics, run.scope.tables.records, 0.0).collect()}
    assert (states["2025-09-15"], states["2025-09-17"]) == ("confirmed", "disputed")
    gated = corroborate(found, run.metrics, run.scope.tables.records, 0.98).collect()
    assert {r["state"] for r in gated if r["contract_id"] == "ESZ25"} == {"not_comparable"}


def test_gate_matches_wildcards_like_brute_force(spark):
    rng = random.Random(5)
    days = ["2025-09-15", "2025-09-16", "2025-09-17"]
    sessions = [(c, f, d, f"{d} 14:00:00", f"{d} 20:00:00") for c in ("A", "B") for f in ("minute", "daily") for d in days]
    rules = {"record": "VAL.NEGATIVE_VOLUME", "session": "CON.DERIVED_BAR_INVALID", "series": "ROL.NO_SUCCESSOR",
             "file": "TIM.TIMEZONE_MISALIGNED"}
    found = []
    for i in range(60):
        kind = rng.choice(list(rules))
        start = rng.choice([None, "2025-09-15 19:00:00", "2025-09-16 21:00:00"])
        end = None if start is None else rng.choice([start, "2025-09-17 13:00:00"])
        found.append((f"f{i}", rules[kind], rng.choice([None, "A", "B"]), rng.choice([None, "minute", "daily"]),
                      rng.choice([None, *days]), start, end, rng.choice(list(SEVERITY_RANK)), rng.choice(["open", "open", "accepted"])))
    s = spark.createDataFrame(sessions, "contract_id string, frequency string, d string, a string, b string").select(
        "contract_id", "frequency", F.to_date("d").alias("trade_date"), F.to_timestamp("a").alias("first_ts_utc"),
        F.to_timestamp("b").alias("last_ts_utc"))
    f = spark.createDataFrame(found, "finding_id string, rule_id string, contract_id string, frequency string, d string, a string, "
                                     "b string, severity string, status string").select(
        "finding_id", "rule_id", "contract_id", "frequency", F.to_date("d").alias("trade_date"),
        F.to_timestamp("a").alias("ts_start_utc"), F.to_timestamp("b").alias("ts_end_utc"), "severity", "status")
    want = {}
    for c, g, d, a, b in sessions:
        count, worst, blocking = 0, 0, set()
        for _, rule, fc, fg, fd, fa, fb, severity, status in found:
            kind = RULES_BY_ID[rule].scope
            hit = status == "open" and fc in (None, c) and fg in (None, g)
            if kind == "file":
                hit = hit and (fa is None or (fa <= b and fb >= a))
            elif kind != "series":
                hit = hit and fd in (None, d)
            if hit:
                count += kind in ("record", "session")
                worst = max(worst, SEVERITY_RANK[severity])
                if severity == "critical":
                    blocking.add(rule)
        want[c, g, d] = (count, {v: k for k, v in SEVERITY_RANK.items()}.get(worst), sorted(blocking))
    got = {(r["contract_id"], r["frequency"], str(r["trade_date"])): (r["finding_count"], r["max_severity"], r["blocking_rule_ids"])
           for r in G.session_quality(s, f).collect()}
    assert got == want


def test_publication_states(run):
    tape = run.scope.tables.records
    asked = tape.select("contract_id").unionByName(tape.limit(1).select(F.lit("GCZ25").alias("contract_id")))
    caps = G.capability(tape, ["minute"], asked)
    assert {(r["contract_id"], r["status"], r["finest"]) for r in caps.collect()} == {
        ("ESZ25", "available", "minute"), ("ZCZ25", "refused", "daily"), ("GCZ25", "empty", "daily")}
    quality = G.session_quality(G.record_sessions(tape), run.findings)
    series = B.daily_bars(tape, "raw")
    state = {r["contract_id"]: r["state"] for r in G.publication_state(series, G.blocked_sessions(quality), "minute", caps).collect()}
    assert state == {"ESZ25": "blocked", "ZCZ25": "unsupported", "GCZ25": "empty"}


def test_pattern_lift_is_share_against_exposure(spark):
    """A quarter of the records in one hour hold every finding: lift is exactly four."""
    lines = []
    for day, hour, minute in itertools.product(range(15, 19), range(9, 13), range(6)):
        volume = -5 if hour == 9 else 10
        lines.append(f"ESZ25,2025-09-{day} {hour:02d}:{minute:02d}:00,6600,6601,6599,6600,{volume}")
    tape = records(spark, "\n".join(lines))
    t = tables(spark, tape)
    run = assess(scope(spark, tape))
    tallies = P.finding_tallies(run.findings.filter("rule_id = 'VAL.NEGATIVE_VOLUME'"), tape, t.batches)
    rows = P.find_patterns(P.record_exposure(tape, t.batches), tallies).collect()
    assert [(r["dimension"], r["bucket"], r["lift"], r["support"], r["distinct_days"]) for r in rows] == [
        ("hour_of_day", "09:00-10:00 America/Chicago", 4.0, 24, 4)]
    assert rows[0]["narrative"] == ("100% of negative volume findings fall in the 09:00-10:00 America/Chicago hour, "
                                    "across 4 sessions.")
    assert rows[0]["confidence"] == "low" and rows[0]["pattern_id"].startswith("p_")
    strict = P.find_patterns(P.record_exposure(tape, t.batches), tallies, lift=4.1)
    assert strict.count() == 0


def test_early_close_becomes_a_closure(spark):
    calendar = spark.createDataFrame([("ES", "2025-07-04", True)], "root string, d string, is_early_close boolean").select(
        "root", F.to_date("d").alias("trade_date"), "is_early_close")
    facts = spark.createDataFrame([("ESZ25", "ES", "2025-12-19")], "contract_id string, root string, d string").select(
        "contract_id", "root", F.to_date("d").alias("last_session"))
    patterns = spark.createDataFrame(
        [("p_1", "CMP.SESSION_MISSING", "trade_date", "2025-07-04"), ("p_2", "CMP.SESSION_MISSING", "trade_date", "2025-12-15"),
         ("p_3", "CMP.SESSION_MISSING", "trade_date", "2025-08-15")], "pattern_id string, rule_id string, dimension string, bucket string")
    got = {(r["pattern_id"], r["operation"], r["title"]) for r in SG.proposals(patterns, facts, calendar).collect()}
    assert got == {("p_1", "add_holiday", "Mark 2025-07-04 as closed all day for ES"),
                   ("p_2", "set_param", "Count the last sessions before expiry as part of the roll")}


def test_review_relations(run, actions, spark):
    none = spark.createDataFrame([], "contract_id string, frequency string, pattern_id string, rule_id string, dimension string, "
                                     "bucket string, lift double, support bigint, distinct_days bigint, narrative string")
    cards = {(r["frequency"], r["family"]): r for r in RV.family_cards(run.scope.sessions, run.findings, none).filter(
        "contract_id = 'ESZ25'").collect()}
    assert len(cards) == 8 and cards["minute", "duplicates"]["detail"] == "3 exact copies · 6 key conflicts"
    assert cards["minute", "patterns"]["detail"] == "Nothing recurs here"
    log = changelog(actions, run.scope.tables.records, F.broadcast(spark.createDataFrame(
        [("UNQ.EXACT_DUPLICATE", "Exact duplicate row")], "rule_id string, name string")))
    issues = {(r["frequency"], r["what"]): r for r in RV.issues(run.findings, none, log).collect()}
    assert issues["minute", "Exact duplicate row"]["what_we_did"] == "dropped 3 records"
    assert issues["minute", "Missing grid slots"]["what_we_did"] == "Marked, left in place"
    kept = RV.duplicate_evidence(run.findings, run.scope.tables.records).filter("frequency = 'minute'").collect()
    assert {r["which"] for r in kept} == {"kept", "dropped"}
    rows = contract_rows(run.scores, run.findings).collect()
    assert {r["contract_id"]: r["status"] for r in rows}["ESZ25"] == "ATTN"
    assert worst_field(run.findings).first()["total"] > 0 and top_issues(run.findings).count() == 10
