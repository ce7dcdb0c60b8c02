"""One planted defect per rule, with rows that must stay silent beside it."""

from __future__ import annotations

import pytest

from tapewright.catalogue import ENGINE_RULES, RULES, SCORE_WEIGHTS, TRIAGE_WEIGHT
from tapewright.operators.bars import build_bars
from tapewright.operators.record_rules import RECORD_RULES
from tapewright.operators.session_rules import RuleRefused
from tapewright.plans.assess import SET_RULES, rule_counts, run_rules
from tapewright.operators.series_rules import OUTLIER_RULES

from .helpers import fire, minutes, records, scope


def test_catalogue_is_complete():
    assert len(RULES) == 38 and len(ENGINE_RULES) == 37
    assert set(ENGINE_RULES) == set(RECORD_RULES) | set(SET_RULES) | set(OUTLIER_RULES)
    assert round(sum(SCORE_WEIGHTS.values()), 6) == 1.2
    assert TRIAGE_WEIGHT["critical"] > TRIAGE_WEIGHT["error"]


CRUDE, DAY = "CLM26", "2026-03-10"


def bar(at: str, o="71.42", h="71.58", l="71.31", c="71.47", v="240", contract: str = CRUDE, day: str = DAY) -> str:  # noqa: E741
    """One record of an ordinary Tuesday in crude oil, or of what is put in its place."""
    return f"{contract},{day} {at},{o},{h},{l},{c},{v}"


def tape(*lines: str) -> str:
    return "\n".join(lines)


_corn = {"o": "451.25", "h": "451.75", "l": "450.50", "c": "451.00", "contract": "ZCN26", "day": "2026-03-11"}
RECORD_CASES = {
    "CMP.NULL_FIELD": (tape(bar("10:30:00", c=""), bar("10:31:00"), bar("10:32:00", v="")), [(1, "close"), (3, "volume")]),
    "VAL.NON_POSITIVE_PRICE": (tape(bar("10:30:00", l="0"), bar("10:31:00")), [(1, "low")]),
    "VAL.NEGATIVE_VOLUME": (tape(bar("10:30:00"), bar("10:31:00", v="0"), bar("10:32:00", v="-7")), [(3, "volume")]),
    "VAL.NON_INTEGER_VOLUME": (tape(bar("10:30:00", v="31.25"), bar("10:31:00", v="32.0")), [(1, "volume")]),
    "VAL.OFF_TICK_PRICE": (
        tape(bar("10:30:00", c="71.475"), bar("10:31:00"), bar("10:32:00", "96.1150", "96.1175", "96.1125", "96.1150", contract="SR3M26")),
        [(1, "close")]),
    "VAL.ZERO_VOLUME_WITH_RANGE": (
        tape(bar("10:30:00", v="0"), bar("10:31:00", "71.4", "71.4", "71.4", "71.4", "0")), [(1, None)]),
    "VAL.PRICE_MAGNITUDE": (tape(bar("10:30:00"), bar("10:31:00", h="7158.00"), bar("10:32:00")), [(2, "high")]),
    "VAL.EXTREME_VOLUME": (tape(bar("10:30:00", v="100001"), bar("10:31:00", v="100000")), [(1, "volume")]),
    "CON.HIGH_LT_LOW": (tape(bar("10:30:00", h="71.31", l="71.58"), bar("10:31:00")), [(1, None)]),
    "CON.OPEN_OUT_OF_RANGE": (
        tape(bar("10:30:00", o="71.31"), bar("10:31:00", o="71.59"), bar("10:32:00", o="71.20"), bar("10:33:00", o="70", h="71.3", l="71.6")),
        [(2, "open"), (3, "open")]),
    "CON.CLOSE_OUT_OF_RANGE": (tape(bar("10:30:00", c="71.30"), bar("10:31:00", c="71.58")), [(1, "close")]),
    "CON.WEEKEND_RECORD": (tape(bar("11:15:00", day="2026-03-14"), bar("17:00:00", day="2026-03-15")), [(1, None)]),
    "CON.RECORD_IN_HALT": (
        tape(bar("07:44:00", **_corn), bar("07:45:00", **_corn), bar("08:10:00", **_corn), bar("08:29:00", **_corn),
             bar("08:30:00", **_corn), bar("16:20:00")), [(2, None), (3, None), (4, None)]),
    "CON.RECORD_ON_HOLIDAY": (
        tape(bar("10:30:00", contract="CLH27", day="2027-01-04"), bar("10:30:00", contract="CLH27", day="2027-01-01")), [(2, None)]),
    "TIM.FUTURE_TIMESTAMP": (tape(bar("10:30:00", day="2091-05-08"), bar("10:31:00")), [(1, None)]),
    "TIM.BEFORE_LISTING": (tape(bar("10:30:00"), bar("10:30:00", day="2026-03-06")), [(2, None)]),
    "TIM.AFTER_EXPIRY": (tape(bar("10:30:00", day="2026-05-20"), bar("10:30:00", day="2026-05-19")), [(1, None)]),
    "TIM.OFF_GRID": (tape(bar("10:30:21"), bar("10:31:00")), [(1, None)]),
    "UNQ.EXACT_DUPLICATE": (tape(bar("10:30:00"), bar("10:31:00", v="55"), bar("10:31:00", v="55")), [(3, None)]),
    "UNQ.KEY_CONFLICT": (
        tape(bar("10:30:00"), bar("10:30:00"), bar("10:31:00"), bar("10:31:00", c="")), [(3, None), (4, None)]),
    "CON.PRICE_JUMP": (
        tape(bar("10:30:00"), bar("10:31:00", c="71.90"), bar("10:32:00", c=""), bar("10:33:00", h="77.0", c="76.40")), [(4, None)]),
    "TIM.OUT_OF_ORDER": (tape(bar("10:31:00"), bar("10:30:00"), bar("10:32:00")), [(2, None)]),
}


@pytest.mark.parametrize("rule_id", list(RECORD_CASES))
def test_record_rule_names_the_planted_row(spark, rule_id):
    csv, want = RECORD_CASES[rule_id]
    sc = scope(spark, records(spark, csv), listing={CRUDE: ("2026-03-09", "2026-05-19")})
    got = fire(sc, rule_id)
    assert [(f["source_row"], f["details"].get("field")) for f in got] == want
    assert all(f["rule_id"] == rule_id and f["affected_rows"] == 1 for f in got)


def test_duplicate_names_its_keeper(spark):
    sc = scope(spark, records(spark, RECORD_CASES["UNQ.EXACT_DUPLICATE"][0]))
    found = fire(sc, "UNQ.EXACT_DUPLICATE")[0]
    assert (found["details"]["keeps_source_row"], found["details"]["copies"]) == (2, 2)


def test_daily_rows_fire_softer(spark):
    csv = """
        ESZ25,2025-09-15,60.0,61.0,59.0,59.75,0
        ESZ25,2025-09-16,60.0,61.0,60.0,59.75,5"""
    sc = scope(spark, records(spark, csv, "daily"))
    assert [f["severity"] for f in fire(sc, "VAL.ZERO_VOLUME_WITH_RANGE")] == ["info"]
    assert [f["severity"] for f in fire(sc, "CON.CLOSE_OUT_OF_RANGE")] == ["warning"]
    off = scope(spark, records(spark, csv, "daily"), overrides={
        "VAL.ZERO_VOLUME_WITH_RANGE": {"daily_severity": None}, "CON.CLOSE_OUT_OF_RANGE": {"daily_severity": None}})
    assert fire(off, "VAL.ZERO_VOLUME_WITH_RANGE") == []
    assert [f["severity"] for f in fire(off, "CON.CLOSE_OUT_OF_RANGE")] == ["error"]


def test_missing_run_is_one_finding(spark):
    csv = tape(*[bar(f"10:{minute}:00") for minute in (30, 31, 35, 36)])
    found = fire(scope(spark, records(spark, csv)), "CMP.MISSING_TIMESTAMP")
    spans = [(f["ts_start_utc"].strftime("%d %H:%M"), f["ts_end_utc"].strftime("%d %H:%M"), f["affected_rows"]) for f in found]
    assert spans == [("09 22:00", "10 15:29", 1050), ("10 15:32", "10 15:34", 3), ("10 15:37", "10 20:59", 323)]
    assert sum(n for *_, n in spans) == 1380 - 4


def test_halted_minutes_are_not_missing(spark):
    csv = tape(bar("19:00:00", **_corn | {"day": "2026-03-10"}), *[bar(at, **_corn) for at in ("07:44:00", "08:31:00", "13:19:00")])
    found = fire(scope(spark, records(spark, csv)), "CMP.MISSING_TIMESTAMP")
    assert [f["affected_rows"] for f in found] == [763, 1, 287]
    assert sum(f["affected_rows"] for f in found) == 1055 - 4


def test_partial_missing_and_sparse_sessions(spark):
    csv = "\n".join(minutes("ESZ25", day, "09:00", [6600.0, 6600.25]) for day in ("2025-09-15", "2025-09-17"))
    sc = scope(spark, records(spark, csv))
    partial = fire(sc, "CMP.PARTIAL_SESSION")
    assert [(str(f["trade_date"]), f["affected_rows"], f["details"]["window_basis"]) for f in partial] == [
        ("2025-09-15", 1378, "observed"), ("2025-09-17", 1378, "observed")]
    missing = fire(sc, "CMP.SESSION_MISSING")
    assert [(str(f["trade_date"]), f["affected_rows"]) for f in missing] == [("2025-09-16", 1380)]
    assert fire(sc, "CMP.SPARSE_SERIES")[0]["details"]["sessions"] == 2


def test_completeness_refuses_without_a_calendar(spark):
    sc = scope(spark, records(spark, minutes("ESZ25", "2025-09-20", "09:00", [6600.0, 6601.0])))
    for rule in ("CMP.MISSING_TIMESTAMP", "CMP.SESSION_MISSING", "CMP.PARTIAL_SESSION"):
        with pytest.raises(RuleRefused):
            fire(sc, rule)
    found, refused = run_rules(sc)
    outcome = {r["rule_id"]: r["outcome"] for r in rule_counts(found, refused).collect()}
    assert outcome["CMP.SESSION_MISSING"] == outcome["CON.DERIVED_BAR_INVALID"] == "refused"
    assert outcome["VAL.NEGATIVE_VOLUME"] == "evaluated" and len(outcome) == 37


def test_stale_run_and_its_break(spark):
    flat = minutes("ESZ25", "2025-09-15", "09:00", [6600.0] * 4)
    gap = "ESZ25,2025-09-15 09:04:00,6600.0,6601.0,6599.0,6600.0,0"
    more = minutes("ESZ25", "2025-09-15", "09:05", [6600.0] * 3)
    sc = scope(spark, records(spark, f"{flat}\n{gap}\n{more}"), overrides={"CON.STALE_REPEAT": {"n": 3, "n_by_root": {}}})
    assert [f["affected_rows"] for f in fire(sc, "CON.STALE_REPEAT")] == [4, 3]
    strict = scope(spark, records(spark, flat), overrides={"CON.STALE_REPEAT": {"n": 3, "n_by_root": {"ES": 5}}})
    assert fire(strict, "CON.STALE_REPEAT") == []


def test_shifted_dead_hour(spark):
    def clock(dead: int, contract: str = "ESZ25") -> str:
        return "\n".join(f"{contract},2025-09-15 {h:02d}:{m:02d}:00,6600,6601,6599,6600,10"
                         for h in range(24) if h != dead for m in range(0, 60, 12))
    found = fire(scope(spark, records(spark, clock(21))), "TIM.TIMEZONE_MISALIGNED")
    assert [(f["details"]["observed_dead_hour_local"], f["details"]["offset_hours"]) for f in found] == [(21, 5)]
    assert fire(scope(spark, records(spark, clock(16))), "TIM.TIMEZONE_MISALIGNED") == []
    assert fire(scope(spark, records(spark, clock(21, "SBH26"))), "TIM.TIMEZONE_MISALIGNED") == []


def test_outliers_are_judged_against_the_middle(spark):
    closes = [6600.0 + (0.25 if i % 2 else 0.0) + (i % 5) * 0.25 for i in range(40)] + [6900.0]
    found = fire(scope(spark, records(spark, minutes("ESZ25", "2025-09-15", "09:00", closes))), "OUT.RETURN_MAD")
    assert [f["source_row"] for f in found] == [41] and found[0]["severity"] == "info"
    loud = minutes("ESZ25", "2025-09-15", "09:00", closes[:40])
    lines = [line.rsplit(",", 1)[0] + f",{100 + i % 7}" for i, line in enumerate(loud.splitlines())]
    lines.append("ESZ25,2025-09-15 09:40:00,6600,6601,6599,6600,250000")
    assert [f["source_row"] for f in fire(scope(spark, records(spark, "\n".join(lines))), "OUT.VOLUME_MAD")] == [41]
    assert fire(scope(spark, records(spark, "\n".join(lines[-20:]))), "OUT.VOLUME_MAD") == []


def test_derived_bar_severity_follows_its_source(spark):
    tape = records(spark, minutes("ESZ25", "2025-09-15", "09:00", [6600.0, 6601.0])
                   + "\nESZ25,2025-09-15 09:02:00,6601.0,6601.5,6600.5,6626.25,100").unionByName(
        records(spark, "ESZ25,2025-09-15,6600.0,6601.0,6599.0,6590.0,300", "daily", "b2"))
    sc = scope(spark, tape, bars=build_bars(tape, None, ("clean",)))
    got = {f["frequency"]: f["severity"] for f in fire(sc, "CON.DERIVED_BAR_INVALID")}
    assert got == {"minute": "critical", "daily": "warning"}


def _pair(spark, minute: str, daily: str, **overrides):
    base = {"REC.OHLC_DISAGREE": {"min_coverage_pct": 0.0}}
    tape = records(spark, minute).unionByName(records(spark, daily, "daily", "b2"))
    return scope(spark, tape, overrides={**base, **overrides})


REC_MINUTE = (minutes("ESZ25", "2025-09-15", "14:58", [6600.0, 6601.0, 6601.0], 600) + "\n"
              + minutes("ESZ25", "2025-09-16", "15:58", [6600.0, 6605.0], 900))


def test_reconciliation_rules(spark):
    daily = """
        ESZ25,2025-09-15,6600.0,6602.5,6599.0,6601.0,1800
        ESZ25,2025-09-16,6600.0,6606.0,6599.0,6600.0,3000"""
    sc = _pair(spark, REC_MINUTE, daily)
    ohlc = fire(sc, "REC.OHLC_DISAGREE")
    assert [(str(f["trade_date"]), f["details"]["field"], f["details"]["difference_ticks"], f["frequency"],
             f["compare_frequency"]) for f in ohlc] == [("2025-09-15", "high", 2.0, "daily", "minute")]
    short = fire(sc, "REC.VOLUME_SHORTFALL")
    assert [(str(f["trade_date"]), f["details"]["ratio"], f["details"]["shortfall"]) for f in short] == [("2025-09-16", 0.6, 1200)]
    settle = fire(sc, "REC.CLOSE_CONVENTION")
    assert [(str(f["trade_date"]), f["severity"], f["details"]["close_at_mark"]) for f in settle] == [("2025-09-16", "info", 6600.0)]


def test_a_disabled_close_rule_stands_both_comparisons_down(spark):
    daily = "ESZ25,2025-09-15,6600.0,6602.0,6599.0,6590.0,1800"
    assert [f["details"]["field"] for f in fire(_pair(spark, REC_MINUTE, daily), "REC.OHLC_DISAGREE")] == ["close"]
    off = _pair(spark, REC_MINUTE, daily, **{"REC.CLOSE_CONVENTION": {"enabled": False}})
    assert fire(off, "REC.OHLC_DISAGREE") == [] and fire(off, "REC.CLOSE_CONVENTION") == []
    found, refused = run_rules(off, ["REC.CLOSE_CONVENTION", "VAL.NEGATIVE_VOLUME"])
    assert found.count() == 0 and refused.count() == 0


def test_coverage_gate_holds(spark):
    daily = "ESZ25,2025-09-15,6600.0,6602.5,6599.0,6601.0,1800"
    gated = _pair(spark, REC_MINUTE, daily, **{"REC.OHLC_DISAGREE": {"min_coverage_pct": 0.98}})
    assert fire(gated, "REC.OHLC_DISAGREE") == []


def test_session_held_at_one_grain(spark):
    minute = "\n".join(minutes("ESZ25", d, "14:58", [6600.0, 6601.0], 600) for d in ("2025-09-15", "2025-09-16", "2025-09-18"))
    daily = "\n".join(f"ESZ25,2025-09-{d},6600.0,6602.0,6599.0,6601.0,1800" for d in (15, 17, 18, 22))
    found = fire(_pair(spark, minute, daily), "REC.SESSION_ONLY_IN_ONE")
    assert [(str(f["trade_date"]), f["frequency"], f["severity"]) for f in found] == [
        ("2025-09-16", "minute", "warning"), ("2025-09-17", "daily", "info")]


def test_roll_window_and_successor(spark):
    days = [f"2025-11-{d:02d}" for d in range(3, 29)] + [f"2025-12-{d:02d}" for d in range(1, 13)]
    weekdays = [d for d in days if __import__("datetime").date.fromisoformat(d).weekday() < 5]
    lines = [f"ESZ25,{d},6600,6601,6599,6600,{5000 if d < '2025-12-02' else 50}" for d in weekdays]
    lines += [f"ESH26,{d},6600,6601,6599,6600,5000" for d in weekdays]
    sc = scope(spark, records(spark, "\n".join(lines), "daily"))
    thin = fire(sc, "ROL.THIN_NEAR_EXPIRY")
    assert [(f["contract_id"], f["details"]["window_start"], f["details"]["window_end"]) for f in thin] == [
        ("ESZ25", "2025-12-02", "2025-12-12")]
    assert [f["contract_id"] for f in fire(sc, "ROL.NO_SUCCESSOR")] == ["ESH26"]
