"""Check SQL per registered query."""

from __future__ import annotations

import re

from .env import EVEN_LIFT, OVERRIDES, PATTERN
from .queries import ENGINE_RULES, EVIDENCE, FULL_TAPE_RULES
from .sql_base import IDENT, RELATIONS, compose, coverage_sql, r6, relation, slug, txt, utc

COVERAGE = OVERRIDES["REC.OHLC_DISAGREE"]["min_coverage_pct"]

ORACLE: dict[str, str] = {}

_VALUE_ALIAS = {"log_return": "value", "log_volume": "value"}


def _rule_sql(rule_id: str) -> str:
    source = slug(rule_id)
    if rule_id == "TIM.TIMEZONE_MISALIGNED":
        source += "_quiet"
    elif rule_id == "ROL.THIN_NEAR_EXPIRY":
        source += "_wide"
    elif rule_id.startswith("OUT."):
        source += "_clean"
    elif rule_id in FULL_TAPE_RULES:
        source += "_all"
    compare = "compare_frequency" if rule_id.startswith("REC.") else "NULL::VARCHAR"
    evidence = ""
    for name, kind in EVIDENCE.get(rule_id, []):
        column = _VALUE_ALIAS.get(name, name) if rule_id.startswith("OUT.") else name
        expr = {"double": r6(column), "bigint": f"CAST({column} AS BIGINT)"}.get(kind, column)
        evidence += f", {expr} AS \"{name}\""
    return compose(f"""
SELECT {IDENT} AS finding_id, rule_id, severity, contract_id, frequency, {compare} AS compare_frequency,
  CAST(trade_date AS VARCHAR) AS trade_date, {txt('t0')} AS ts_start_utc, {txt('t1')} AS ts_end_utc,
  record_id, CAST(affected_rows AS BIGINT) AS affected_rows{evidence}
FROM {source}""")


for _rule in ENGINE_RULES:
    ORACLE[_rule] = _rule_sql(_rule)


def sql(name: str, text: str) -> None:
    ORACLE[name] = compose(text)


def d(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


# ---- calendar and reference ---------------------------------------------------------------
sql("CAL-01", f"""
SELECT symbol, count(*) AS rows, any_value(parts[1]) AS root, any_value(parts[2]) AS month_code,
  any_value(if(parts IS NULL, NULL, '2024-03-01')) AS contract_month,
  any_value(CASE WHEN parts IS NULL THEN 0.0 WHEN parts[1] IN ('ES', 'ZC', 'SR3', 'SB', 'CL') THEN {r6('1.0')} ELSE {r6('0.7')} END)
    AS parse_confidence
FROM (SELECT symbol, if(symbol LIKE '%!', NULL, [regexp_replace(upper(symbol), 'H24$', ''), 'H']) AS parts
  FROM (SELECT CASE record_id % 7 WHEN 0 THEN lower(contract_id) WHEN 1 THEN 'X' || contract_id
          WHEN 2 THEN contract_id || '!' ELSE contract_id END AS symbol FROM q_tape))
GROUP BY symbol""")
sql("CAL-02", f"""
SELECT root, frequency, field, {r6("if(frequency = 'daily' AND field = 'close', NULL, tick)")} AS tick_size,
  frequency = 'daily' AND field = 'close' AS exempt, rows, exchange, {r6('multiplier')} AS multiplier,
  {n('slots')} AS slots_1m, roll_sec IS NOT NULL AS spans_midnight
FROM (SELECT contract_id, frequency, count(*) AS rows FROM q_tape GROUP BY ALL) JOIN q_roots USING (contract_id),
  unnest(['open', 'high', 'low', 'close']) u(field)""")
sql("CAL-03", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, count(*) AS rows, {txt('min(tx)')} AS "first", {txt('max(tx)')} AS "last"
FROM q_minute GROUP BY contract_id, trade_date""")
_bounds = """
SELECT DISTINCT root, d, open_sec, close_sec FROM (
  SELECT contract_id, trade_date AS d FROM q_tape WHERE frequency = 'minute'
  UNION SELECT contract_id, CAST(trade_date + INTERVAL 6 MONTH AS DATE) FROM q_tape WHERE frequency = 'minute')
JOIN q_roots USING (contract_id)"""
sql("CAL-04", f"""
SELECT root, {d('d')} AS trade_date,
  {txt(utc('(d - if(open_sec > close_sec, 1, 0))::TIMESTAMP + to_seconds(open_sec)'))} AS open_utc,
  {txt(utc('d::TIMESTAMP + to_seconds(close_sec)'))} AS close_utc
FROM ({_bounds})""")
sql("CAL-05", f"""
SELECT DISTINCT root, {d('trade_date')} AS trade_date, {txt(utc("trade_date + INTERVAL '07:45'"))} AS start_utc,
  {txt(utc("trade_date + INTERVAL '08:30'"))} AS end_utc
FROM q_tape WHERE root = 'ZC' AND frequency = 'minute'""")
sql("CAL-06", f"""
SELECT {d('d')} AS trade_date, name, name IN ('New Year''s Day', 'Christmas Day') AS is_holiday,
  name NOT IN ('New Year''s Day', 'Christmas Day') AS is_early_close
FROM q_named WHERE name IS NOT NULL""")
_cal = f"""{d('trade_date')} AS trade_date, {txt('opens')} AS session_open_utc, {txt('closes')} AS session_close_utc,
  closed AS is_holiday, early AS is_early_close, {n('slots')} AS expected_slots_1m"""
sql("CAL-07", f"SELECT root, {_cal} FROM q_cal WHERE root = 'ZC' AND trade_date >= DATE '2024-01-02'")
sql("CAL-08", f"SELECT exchange, root, {_cal}, {n('if(halt_from IS NULL, 0, 1)')} AS halts FROM q_cal")
sql("CAL-09", f"""
SELECT contract_id, coalesce(root, contract_id) AS root, if(root IS NULL, NULL, 'H') AS month_code,
  if(root IS NULL, NULL, '2024-03-01') AS contract_month, exchange, {r6('tick')} AS tick_size, {r6('multiplier')} AS multiplier,
  if(contract_id = 'ESH24', '2024-01-04', NULL) AS first_trade_date, if(contract_id = 'ESH24', '2024-01-26', NULL) AS last_trade_date,
  if(root IS NULL, {r6('0.0')}, {r6('1.0')}) AS parse_confidence, TRUE AS dates_inferred
FROM (SELECT DISTINCT if(record_id % 1000 = 0, 'spread ' || contract_id, contract_id) AS contract_id FROM q_tape)
LEFT JOIN q_roots USING (contract_id)""")


def _cover(grain: str) -> str:
    w = f"FILTER (frequency = '{grain}')"
    return (f"{d(f'min(trade_date) {w}')} AS {grain}_first_trade_date, {d(f'max(trade_date) {w}')} AS {grain}_last_trade_date, "
            f"count(DISTINCT trade_date) {w} AS {grain}_sessions, count(*) {w} AS {grain}_records")


sql("CAL-10", f"""
SELECT contract_id, any_value(root) AS root, any_value(exchange) AS exchange, '2024-03' AS contract_month,
  {r6('any_value(tick)')} AS tick_size, {r6('any_value(multiplier)')} AS multiplier, TRUE AS dates_inferred,
  string_agg(DISTINCT frequency, ',' ORDER BY frequency) AS frequencies_available, {_cover('minute')}, {_cover('daily')}
FROM q_tape JOIN (SELECT contract_id, tick, multiplier FROM q_roots) USING (contract_id) GROUP BY contract_id
HAVING DATE '2024-01-10' BETWEEN min(trade_date) AND max(trade_date)""")
sql("CAL-12", f"""
SELECT root, {d('trade_date')} AS trade_date, count(*) AS slots, {txt('min(slot)')} AS first_slot, {txt('max(slot)')} AS last_slot
FROM (SELECT root, trade_date, halt_from, halt_to,
        unnest(generate_series(opens, closes - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS slot
      FROM (SELECT DISTINCT root, trade_date FROM q_week WHERE frequency = 'minute') JOIN q_wcal USING (root, trade_date)
      WHERE NOT closed AND NOT early)
WHERE halt_from IS NULL OR slot < halt_from OR slot >= halt_to GROUP BY root, trade_date""")

# ---- scope and windows ----------------------------------------------------------------------
sql("WIN-01", f"""
SELECT contract_id, root, exchange, bar_interval, batch_id, {d('first_trade_date')} AS first_trade_date,
  {d('last_trade_date')} AS last_trade_date, count(*) AS records, {n('sum(volume)')} AS volume
FROM q_tape WHERE contract_id IN ('ESH24', 'ZCH24') AND frequency = 'minute' GROUP BY ALL""")
sql("WIN-02", "\nUNION ALL\n".join(f"""
SELECT contract_id, frequency, {d('start_date')} AS start_date, {d('end_date')} AS end_date, basis, {r6(str(floor))} AS volume_floor
FROM ({coverage_sql(floor)})""" for floor in (1000.0, 3400.0, 1e9)))
sql("WIN-03", f"""
SELECT contract_id, frequency, {d('roll_start')} AS roll_start, {d('roll_end')} AS roll_end, expiry_basis,
  {r6('median_inside')} AS median_inside, {r6('median_before')} AS median_before FROM q_roll_wide""")
sql("WIN-04", f"""
SELECT contract_id, frequency, {d('trade_date')} AS trade_date, {d('start_date')} AS start_date, {d('end_date')} AS end_date,
  basis, {d('roll_start')} AS roll_start, {d('roll_end')} AS roll_end,
  CASE WHEN trade_date < start_date OR trade_date > end_date THEN 'outside the ' || basis || ' window'
    WHEN trade_date >= roll_start AND trade_date <= roll_end THEN 'inside the roll window (ROL.THIN_NEAR_EXPIRY)' END AS reason
FROM q_sess JOIN q_win_wide USING (contract_id, frequency)""")
sql("WIN-05", f"""
SELECT {n('0')} AS unrooted_contracts, {n('missing')} AS missing_sessions, missing > 0 AS refused, scope FROM (
  SELECT 'every day' AS scope, (SELECT count(*) FROM (SELECT DISTINCT root, trade_date FROM q_tape)
    ANTI JOIN q_cal USING (root, trade_date)) AS missing
  UNION ALL SELECT 'weekdays', (SELECT count(*) FROM (SELECT DISTINCT root, trade_date FROM q_week)
    ANTI JOIN q_wcal USING (root, trade_date)))""")

# ---- reconciliation and runs ----------------------------------------------------------------
sql("REC-01", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, root, {r6('mo')} AS derived_open, {r6('mh')} AS derived_high,
  {r6('ml')} AS derived_low, {r6('mc')} AS derived_close, {n('mv')} AS derived_volume, {n('mn')} AS minute_records,
  {txt('t0')} AS first_ts_utc, {txt('t1')} AS last_ts_utc, {n('vn')} AS vendor_rows, {n('v_id')} AS vendor_record_id,
  {r6('vo')} AS vendor_open, {r6('vh')} AS vendor_high, {r6('vl')} AS vendor_low, {r6('vc')} AS vendor_close,
  {n('vv')} AS vendor_volume, {n('slots')} AS expected_slots, {r6('cov')} AS coverage_pct, has_m AS has_minute,
  has_d AS has_daily, inw AS in_window, {r6('mark_close')} AS mark_close, {r6('mark_gap')} AS mark_gap_minutes
FROM q_frame""")
sql("REC-02", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, root, {r6('mc')} AS derived_close, {r6('vc')} AS vendor_close,
  CAST(NULL AS DOUBLE) AS tick_size, {r6('cov')} AS coverage_pct, {r6('mark_close')} AS mark_close,
  {r6('mark_gap')} AS mark_gap_minutes, resolved AS mark_resolved, signature AS settlement_signature
FROM q_closes""")
_REFUSED = ("CMP.MISSING_TIMESTAMP", "CMP.SESSION_MISSING", "CMP.PARTIAL_SESSION", "CON.DERIVED_BAR_INVALID")


def _count_all(rule_id: str) -> str:
    if rule_id in _REFUSED:
        return f"SELECT '{rule_id}' AS rule_id, 'refused' AS outcome, {n('0')} AS findings, {n('0')} AS affected_rows"
    source = slug(rule_id) + ("_all" if rule_id in FULL_TAPE_RULES or rule_id.startswith("OUT.") else "_whole")
    return (f"SELECT '{rule_id}' AS rule_id, 'evaluated' AS outcome, count(*) AS findings, "
            f"{n('coalesce(sum(affected_rows), 0)')} AS affected_rows FROM {source}")


def _over_whole(text: str) -> str:
    """The session-level relations once more, over every day of the tape."""
    for name in ("q_week_spans", "q_wcal", "q_sess", "q_slices", "q_cover", "q_roll", "q_win", "q_bars_raw", "q_marks",
                 "q_vendor", "q_frame", "q_both", "q_closes"):
        text = re.sub(rf"\b{name}\b", name + "_x", text)
    return re.sub(r"\bq_week\b", "q_tape", text)


for _name in ("q_week_spans", "q_wcal", "q_sess", "q_slices", "q_cover", "q_roll", "q_win", "q_bars_raw", "q_marks", "q_vendor",
              "q_frame", "q_both", "q_closes"):
    relation(_name + "_x", _over_whole(RELATIONS[_name]))
for _rule in ENGINE_RULES:
    if _rule not in _REFUSED and _rule not in FULL_TAPE_RULES and not _rule.startswith("OUT."):
        relation(slug(_rule) + "_whole", _over_whole(RELATIONS[slug(_rule)]))
sql("RUN-01", "\nUNION ALL\n".join(_count_all(r) for r in ENGINE_RULES))
_grain_days = """
SELECT contract_id, frequency, trade_date, CAST(max(a) AS BIGINT) AS actual, CAST(max(x) AS BIGINT) AS expected FROM (
  SELECT contract_id, frequency, trade_date, n AS a, 0 AS x FROM q_sess
  UNION ALL SELECT contract_id, frequency, trade_date, 0, expected FROM q_expected WHERE expected IS NOT NULL) GROUP BY ALL"""
relation("q_days", _grain_days)
relation("q_dimnames", "SELECT unnest(['completeness', 'uniqueness', 'validity', 'consistency', 'timeliness']) AS dimension")
relation("q_metrics", """
SELECT *, if(dimension = 'completeness', 100.0 * least(1.0, greatest(0, actual - affected) / nullif(expected, 0)),
     100.0 * greatest(0.0, 1.0 - affected / nullif(actual, 0))) AS score
FROM (SELECT y.contract_id, y.trade_date, y.frequency, m.dimension, expected, actual,
        count(DISTINCT record_id) FILTER (is_defect) AS affected, count(f.rule_id) AS found
      FROM q_days y CROSS JOIN q_dimnames m
      LEFT JOIN q_f f ON f.contract_id = y.contract_id AND f.frequency = y.frequency AND f.trade_date = y.trade_date
        AND f.dimension = m.dimension
      GROUP BY ALL)
WHERE if(dimension = 'completeness', expected > 0, actual > 0)""")
relation("q_rec_days", """
SELECT b.contract_id, b.trade_date, slots, mn, count(f.rule_id) AS found,
  count(f.rule_id) FILTER (is_defect AND f.rule_id IN ('REC.OHLC_DISAGREE', 'REC.VOLUME_SHORTFALL')) AS bad,
  count(DISTINCT f.rule_id) FILTER (is_defect AND f.rule_id IN ('REC.OHLC_DISAGREE', 'REC.VOLUME_SHORTFALL')) AS bad_rules,
  max(f.rule_id) FILTER (is_defect AND f.rule_id IN ('REC.OHLC_DISAGREE', 'REC.VOLUME_SHORTFALL')) AS bad_rule
FROM q_both b LEFT JOIN q_f f ON f.dimension = 'reconciliation' AND f.contract_id = b.contract_id AND f.trade_date = b.trade_date
GROUP BY ALL""")
sql("RUN-02", """
SELECT 'findings' AS part, rule_id AS key, count(*) AS n FROM q_f GROUP BY ALL
UNION ALL SELECT 'actions', rule_id, count(*) FROM q_actions GROUP BY ALL
UNION ALL SELECT 'metrics', dimension, count(*) FROM q_metrics GROUP BY ALL
UNION ALL SELECT 'metrics', 'reconciliation', count(*) FROM q_rec_days""")

# ---- cleaning and scores --------------------------------------------------------------------
sql("CLN-01", """
SELECT a.record_id, rule_id, action, 'default cleaning policy for ' || severity || ' finding on ' || rule_id AS rationale
FROM q_actions a JOIN q_tape w ON w.record_id = a.record_id WHERE contract_id <> 'ESH24'""")
sql("CLN-02", f"SELECT record_id, contract_id, frequency, {d('trade_date')} AS trade_date, {r6('close')} AS close FROM q_clean")
relation("q_gone", "SELECT w.*, record_id IN (SELECT record_id FROM q_actions) AS gone FROM q_tape w")
_rate = f"count(*) FILTER (gone) AS excluded, count(*) AS records, {r6('round(100.0 * count(*) FILTER (gone) / count(*), 6)')} AS excluded_pct"
sql("CLN-03", f"""
SELECT 'overall' AS view, NULL AS key, NULL AS subkey, {_rate} FROM q_gone
UNION ALL SELECT 'root', root, frequency, {_rate} FROM q_gone GROUP BY root, frequency
UNION ALL SELECT 'rule', rule_id, action, count(*), NULL, NULL FROM q_actions GROUP BY rule_id, action""")
relation("q_log", """
SELECT contract_id, trade_date, frequency, a.rule_id, label, action, count(*) AS records
FROM q_actions a JOIN q_tape w ON w.record_id = a.record_id JOIN q_rules r ON r.rule_id = a.rule_id GROUP BY ALL""")
sql("CLN-04", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, frequency, rule_id, label, action, records
FROM (SELECT * FROM q_log WHERE trade_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'
  ORDER BY trade_date DESC, contract_id, rule_id, action, frequency LIMIT 100 OFFSET 10)""")
relation("q_size", """
SELECT s.contract_id, s.frequency, actual, CAST(coalesce(sum(expected), 0) AS BIGINT) AS expected
FROM q_slices s LEFT JOIN (SELECT * FROM q_expected WHERE expected IS NOT NULL) e
  ON e.contract_id = s.contract_id AND e.frequency = s.frequency GROUP BY ALL""")
sql("SCR-01", "SELECT contract_id, frequency, expected AS expected_records FROM q_size")
relation("q_weights", """
SELECT * FROM (VALUES ('completeness', 0.30::DOUBLE, 'cmp', 1), ('uniqueness', 0.15::DOUBLE, 'unq', 2), ('validity', 0.25::DOUBLE, 'val', 3),
  ('consistency', 0.20::DOUBLE, 'con', 4), ('timeliness', 0.10::DOUBLE, 'tim', 5), ('reconciliation', 0.20::DOUBLE, 'rec', 6))
  v(dimension, weight, code, place)""")
relation("q_rec_score", """
SELECT s.contract_id, grains, coalesce(sessions, 0) AS sessions, coalesce(bad, 0) AS bad,
  (SELECT count(*) FROM q_f f WHERE f.dimension = 'reconciliation' AND f.contract_id = s.contract_id) AS found,
  round(100.0 * (1.0 - bad / sessions) + 1e-9, 4) AS score
FROM (SELECT contract_id, count(*) AS grains FROM q_slices GROUP BY 1) s
LEFT JOIN (SELECT contract_id, count(*) AS sessions, count(*) FILTER (bad > 0) AS bad FROM q_rec_days GROUP BY 1) r USING (contract_id)""")
relation("q_affected", """
SELECT z.contract_id, z.frequency, m.dimension, actual, expected, count(DISTINCT record_id) FILTER (is_defect) AS affected,
  count(f.rule_id) AS found
FROM q_size z CROSS JOIN q_dimnames m
LEFT JOIN q_f f ON f.contract_id = z.contract_id AND f.frequency = z.frequency AND f.dimension = m.dimension GROUP BY ALL""")
_whole = "dimension = 'completeness'"
_share = "if({w}, least(1.0, greatest(0, actual + {back} - ({aff})) / nullif(expected, 0)), greatest(0.0, 1.0 - ({aff}) / nullif(actual, 0)))"
relation("q_dims", f"""
SELECT contract_id, frequency, dimension, round(100.0 * {_share.format(w=_whole, back='0', aff='affected')} + 1e-9, 4) AS score,
  if({_whole}, expected, actual) AS denominator, if({_whole}, 'expected_records', 'actual_records') AS basis,
  affected, found, CASE WHEN {_whole} AND expected = 0
    THEN 'nothing is expected here, completeness has no value' END AS reason
FROM q_affected
UNION ALL
SELECT s.contract_id, frequency, 'reconciliation', score, sessions, 'reconcilable_sessions', bad, found,
  CASE WHEN sessions = 0 AND grains < 2 THEN 'one grain is held, there is no other to compare with' WHEN sessions = 0 THEN
    'both grains are held without a session in common' END
FROM q_slices s JOIN q_rec_score USING (contract_id)""")
sql("SCR-02", f"""
SELECT contract_id, frequency, dimension, {r6('score')} AS score, {n('denominator')} AS denominator, basis,
  {n('affected')} AS affected_records, {n('found')} AS finding_count, reason, {r6('weight')} AS weight
FROM q_dims JOIN q_weights USING (dimension)""")
sql("SCR-03", f"""
SELECT contract_id, {n('sessions')} AS reconcilable_sessions, {n('bad')} AS defect_sessions, {r6('score')} AS score,
  CASE WHEN sessions = 0 AND grains < 2 THEN 'one grain is held, there is no other to compare with' WHEN sessions = 0 THEN
    'both grains are held without a session in common' END AS reason,
  {n('found')} AS finding_count FROM q_rec_score""")
relation("q_scores", """
SELECT contract_id, frequency, if(actual < 100, NULL, round(sum(weight * score) / nullif(sum(weight) FILTER (score IS NOT NULL), 0) + 1e-9, 4)) AS overall,
  actual, expected, string_agg(code, '+' ORDER BY place) FILTER (score IS NOT NULL) AS scope_signature,
  round(sum(weight) FILTER (score IS NOT NULL), 6) AS weights
FROM q_dims JOIN q_weights USING (dimension) JOIN q_size USING (contract_id, frequency) GROUP BY contract_id, frequency, actual, expected""")
sql("SCR-04", f"""
SELECT contract_id, frequency, {r6('overall')} AS overall, actual AS records, expected AS expected_records, scope_signature,
  {r6('weights')} AS weight_denominator, actual < 100 AS insufficient_data FROM q_scores""")
relation("q_dry", f"""
SELECT r.contract_id, r.frequency, r.rule_id, r.dimension AS own, a.dimension, actual, was,
  round(100.0 * {_share.format(w="a.dimension = 'completeness'", back='back', aff='affected')} + 1e-9, 4) AS score
FROM (SELECT contract_id, frequency, rule_id, dimension, CAST(coalesce(sum(affected_rows) FILTER (
        record_id IS NULL AND is_defect AND dimension = 'completeness'), 0) AS BIGINT) AS back
      FROM q_f WHERE contract_id IS NOT NULL GROUP BY ALL) r
JOIN (SELECT q_affected.* EXCLUDE (affected, found), score AS was FROM q_affected JOIN q_dims USING (contract_id, frequency, dimension)) a
  ON a.contract_id = r.contract_id AND a.frequency = r.frequency
CROSS JOIN LATERAL (SELECT count(DISTINCT record_id) AS affected FROM q_f f WHERE f.contract_id = a.contract_id
  AND f.frequency = a.frequency AND f.dimension = a.dimension AND f.is_defect AND f.rule_id <> r.rule_id) z
UNION ALL
SELECT r.contract_id, r.frequency, r.rule_id, r.dimension, 'reconciliation', z.actual, s.score,
  round(100.0 * (1.0 - (s.bad - (SELECT count(*) FROM q_rec_days y WHERE y.contract_id = r.contract_id AND bad_rules = 1
    AND bad_rule = r.rule_id)) / nullif(s.sessions, 0)) + 1e-9, 4)
FROM (SELECT DISTINCT contract_id, frequency, rule_id, dimension FROM q_f WHERE contract_id IS NOT NULL) r
JOIN q_rec_score s ON s.contract_id = r.contract_id
JOIN q_size z ON z.contract_id = r.contract_id AND z.frequency = r.frequency""")
relation("q_resolved", """
SELECT contract_id, frequency, rule_id, own AS dimension, max(score) FILTER (q_dry.dimension = own) AS dimension_score,
  max(was) FILTER (q_dry.dimension = own) AS dimension_from,
  if(actual < 100, NULL, round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL) + 1e-9, 4)) AS overall,
  if(actual < 100, NULL, round(sum(weight * was) / sum(weight) FILTER (was IS NOT NULL) + 1e-9, 4)) AS overall_from
FROM q_dry JOIN q_weights w ON w.dimension = q_dry.dimension GROUP BY contract_id, frequency, rule_id, own, actual""")
sql("SCR-05", f"""
SELECT contract_id, frequency, rule_id, dimension, {r6('dimension_score')} AS dimension_score, {r6('dimension_from')} AS dimension_from,
  {r6('overall')} AS overall, {r6('overall_from')} AS overall_from FROM q_resolved""")
sql("SCR-06", f"""
SELECT contract_id, frequency, rule_id, severity, {n('affected')} AS affected_records, {r6('weight')} AS triage_weight,
  {r6('weight * affected')} AS rank, dimension, {r6('dimension_score')} AS dimension_score, {r6('overall')} AS overall
FROM (SELECT contract_id, frequency, rule_id, ['info', 'warning', 'error', 'critical'][max(sev_rank)] AS severity,
        CASE declared WHEN 'critical' THEN 8.0 WHEN 'error' THEN 4.0 WHEN 'warning' THEN 2.0 ELSE 0.5 END AS weight,
        if(coalesce(sum(affected_rows) FILTER (record_id IS NULL), 0) = 0,
           count(DISTINCT coalesce(CAST(record_id AS VARCHAR), finding_id)),
           sum(affected_rows) FILTER (record_id IS NULL)) AS affected
      FROM q_f WHERE contract_id IS NOT NULL GROUP BY contract_id, frequency, rule_id, declared)
JOIN q_resolved USING (contract_id, frequency, rule_id)""")
_metric = f"""contract_id, {d('trade_date')} AS trade_date, frequency, dimension, {n('expected')} AS expected_records,
  {n('actual')} AS actual_records, {n('affected')} AS affected_records, {n('found')} AS finding_count, {r6('score')} AS dimension_score"""
sql("SCR-07", f"SELECT {_metric} FROM q_metrics")
relation("q_cross", """
SELECT contract_id, trade_date, 'cross' AS frequency, 'reconciliation' AS dimension, slots AS expected, mn AS actual,
  if(bad > 0, 1, 0) AS affected, found, if(bad > 0, 0.0, 100.0) AS score FROM q_rec_days""")
sql("SCR-08", f"SELECT {_metric} FROM q_cross")
relation("q_corr", f"""
SELECT f.finding_id, f.rule_id, f.contract_id, f.trade_date, mn / nullif(slots, 0) AS cov, r.contract_id IS NOT NULL AS compared,
  w.top.f AS field, w.top.t AS ticks, w.top.x AS difference, ids, c.close_gap_ticks, c.close_at_mark,
  CASE WHEN r.contract_id IS NULL OR coalesce(mn / nullif(slots, 0) < {COVERAGE}, TRUE) THEN 'not_comparable'
    WHEN ids IS NOT NULL THEN 'disputed' ELSE 'confirmed' END AS state
FROM q_f f
LEFT JOIN q_rec_days r ON r.contract_id = f.contract_id AND r.trade_date = f.trade_date
LEFT JOIN (SELECT contract_id, trade_date, string_agg(finding_id, ',' ORDER BY finding_id) AS ids,
             list({{s: abs(difference), f: field, t: difference_ticks, x: difference}}
               ORDER BY abs(difference) DESC, field DESC)[1] AS top
           FROM q_f WHERE rule_id = 'REC.OHLC_DISAGREE' AND field IN ('high', 'low') GROUP BY ALL) w
  ON w.contract_id = f.contract_id AND w.trade_date = f.trade_date
LEFT JOIN (SELECT * FROM q_f WHERE rule_id = 'REC.CLOSE_CONVENTION') c ON c.contract_id = f.contract_id AND c.trade_date = f.trade_date
WHERE f.rule_id IN ('CON.CLOSE_OUT_OF_RANGE', 'CON.OPEN_OUT_OF_RANGE', 'CON.HIGH_LT_LOW') AND f.frequency = 'daily'""")
sql("COR-01", f"""
SELECT finding_id, rule_id, 'run-1' AS run_id, contract_id, {d('trade_date')} AS trade_date, state,
  CASE WHEN NOT compared THEN 'the session lies outside the window both granularities cover'
    WHEN state = 'not_comparable' THEN 'the minute tape covers too little of the session to measure its range'
    WHEN state = 'disputed' THEN 'the minute tape measures another range for this session'
    ELSE 'the minute tape measures the stated range' END AS reason,
  {r6('round(100.0 * cov + 1e-9, 2)')} AS minute_coverage_pct, if(state = 'disputed', field, NULL) AS field,
  {r6("if(state = 'disputed', ticks, NULL)")} AS ticks, {r6("if(state = 'disputed', difference, NULL)")} AS difference,
  if(state = 'disputed', ids, NULL) AS finding_ids, {r6("if(state = 'confirmed', close_gap_ticks, NULL)")} AS close_gap_ticks,
  {r6("if(state = 'confirmed', close_at_mark, NULL)")} AS close_at_mark
FROM q_corr""")

# ---- gate -----------------------------------------------------------------------------------
relation("q_gatefound", """
SELECT rule_id, scope, contract_id, frequency, trade_date, t0, t1, sev_rank FROM q_f
UNION ALL SELECT 'TIM.TIMEZONE_MISALIGNED', 'file', NULL, 'minute', NULL, min(tu), min(tu) + INTERVAL 3 DAY, 4
  FROM q_tape WHERE batch_id = 'b-zch24'
UNION ALL SELECT 'CON.DERIVED_BAR_INVALID', 'session', 'SBH24', NULL, CAST(min(tu) + INTERVAL 9 DAY AS DATE), NULL, NULL, 4
  FROM q_tape WHERE batch_id = 'b-zch24'""")


def quality_sql(found: str) -> str:
    """Sessions met by findings, one join per way a finding can name them."""
    met = "s.contract_id, s.frequency, s.trade_date, f.n, f.worst, f.blocking"
    tally = ("count(*) AS n, max(sev_rank) AS worst, list(DISTINCT rule_id) FILTER (sev_rank = 4) AS blocking "
             f"FROM {found} WHERE scope")
    return f"""
SELECT contract_id, frequency, trade_date, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, max(worst) AS worst,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(blocking) FILTER (blocking IS NOT NULL)))), ','), '') AS blocking
FROM (
  SELECT contract_id, frequency, trade_date, 0 AS n, NULL AS worst, NULL AS blocking FROM q_sess_whole
  UNION ALL SELECT {met} FROM q_sess_whole s JOIN (SELECT contract_id, frequency, trade_date, {tally} IN ('record', 'session')
      AND contract_id IS NOT NULL AND frequency IS NOT NULL AND trade_date IS NOT NULL GROUP BY ALL) f
    ON f.contract_id = s.contract_id AND f.frequency = s.frequency AND f.trade_date = s.trade_date
  UNION ALL SELECT {met} FROM q_sess_whole s JOIN (SELECT contract_id, trade_date, {tally} IN ('record', 'session')
      AND frequency IS NULL GROUP BY ALL) f ON f.contract_id = s.contract_id AND f.trade_date = s.trade_date
  UNION ALL SELECT {met.replace('f.n', '0')} FROM q_sess_whole s JOIN (SELECT contract_id, frequency, {tally} = 'series' GROUP BY ALL) f
    ON f.contract_id = s.contract_id AND f.frequency = s.frequency
  UNION ALL SELECT s.contract_id, s.frequency, s.trade_date, 0, f.sev_rank, if(f.sev_rank = 4, [f.rule_id], NULL)
    FROM q_sess_whole s JOIN (SELECT * FROM {found} WHERE scope = 'file') f ON f.frequency = s.frequency
    WHERE f.t0 <= s.t1 AND f.t1 >= s.t0)
GROUP BY ALL"""


relation("q_gate", quality_sql("q_gatefound"))
relation("q_quality", quality_sql("q_f"))
_gate = f"""SELECT contract_id, frequency, {d('trade_date')} AS trade_date, {n('n')} AS finding_count,
  ['info', 'warning', 'error', 'critical'][worst] AS max_severity, blocking AS blocking_rule_ids FROM q_gate"""
sql("GAT-01", _gate)
sql("GAT-02", _gate + " WHERE blocking <> ''")
relation("q_held", """
SELECT a.contract_id, coalesce(string_agg(DISTINCT frequency, ',' ORDER BY frequency), '') AS held
FROM (SELECT contract_id FROM q_roots UNION ALL SELECT root || 'Z99' FROM q_roots) a
LEFT JOIN (SELECT * FROM q_tape WHERE NOT (contract_id = 'SBH24' AND frequency = 'minute')) w USING (contract_id) GROUP BY 1""")
sql("GAT-03", """
SELECT contract_id, held AS frequencies_held, if(held LIKE '%minute%', 'minute', 'daily') AS finest,
  CASE WHEN held = '' THEN 'empty' WHEN held LIKE '%minute%' AND (asked = 'minute' OR held LIKE 'daily%') THEN 'available'
    ELSE 'refused' END AS status, asked, if(held LIKE '%minute%', 'minute', 'daily') AS resolved, TRUE AS defaulted
FROM q_held, (VALUES ('minute'), ('both')) v(asked)""")
sql("GAT-04", """
SELECT contract_id, rows, blocked_sessions, CASE WHEN held = 'daily' THEN 'unsupported' WHEN blocked_sessions > 0 THEN 'blocked'
  WHEN rows > 0 THEN 'published' ELSE 'empty' END AS state
FROM (SELECT contract_id, held,
  (SELECT count(*) FROM q_gate g WHERE g.contract_id = h.contract_id AND frequency = 'minute' AND blocking <> '') AS blocked_sessions,
  if(held LIKE '%minute%', (SELECT count(*) FROM q_bars_clean b ANTI JOIN (SELECT contract_id, trade_date FROM q_gate
    WHERE frequency = 'minute' AND blocking <> '') USING (contract_id, trade_date)
    WHERE b.contract_id = h.contract_id AND source = 'derived'), 0) AS rows FROM q_held h)""")

# ---- bars, VWAP, comparison -------------------------------------------------------------------
_ohlcv = f"{r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close, volume"
_bar = f"""contract_id, {d('trade_date')} AS trade_date, {_ohlcv}, open_interest, {txt('t0')} AS first_ts_utc,
  {txt('t1')} AS last_ts_utc, record_count, volume_null_count, source, source_frequency, close_convention, basis"""
sql("INS-01", f"SELECT {_bar} FROM q_bars WHERE source = 'derived'")
sql("INS-02", f"SELECT {_bar} FROM q_bars WHERE source = 'vendor'")
sql("INS-03", f"""
SELECT b.contract_id, {d('b.trade_date')} AS trade_date, basis, source, r.exchange || ':' || r.root || ':' ||
    if(source = 'vendor', 'vendor-date-column', coalesce(strftime(opens, '%Y-%m-%dT%H:%M:%SZ') || '/' ||
      strftime(closes, '%Y-%m-%dT%H:%M:%SZ'), 'unresolved')) AS session_boundary,
  {n("if(source = 'derived', c.slots, NULL)")} AS expected_count,
  {r6("if(source = 'derived', record_count * 100.0 / nullif(c.slots, 0), NULL)")} AS completeness_pct, close_convention
FROM q_bars b JOIN q_roots r ON r.contract_id = b.contract_id
LEFT JOIN q_wcal c ON c.root = r.root AND c.trade_date = b.trade_date""")
sql("INS-04", f"""
SELECT b.contract_id, {d('b.trade_date')} AS trade_date, basis, source, {n('coalesce(n, 0)')} AS finding_count,
  ['info', 'warning', 'error', 'critical'][worst] AS max_severity
FROM q_bars b LEFT JOIN q_quality q ON q.contract_id = b.contract_id AND q.trade_date = b.trade_date
  AND q.frequency = b.source_frequency""")
sql("INS-05", f"""SELECT contract_id, {d('trade_date')} AS trade_date, basis, source, {_ohlcv} FROM q_bars
WHERE contract_id = 'ZCH24'""")


def vwap_sql(source: str, price: str = "(high + low + close) / 3.0") -> str:
    return f"""
SELECT contract_id, trade_date, tu, sum({price} * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap,
  CAST(sum(volume) OVER w AS BIGINT) AS wv, count(*) OVER w AS wn,
  tu < min(tu) OVER (PARTITION BY contract_id, trade_date) + INTERVAL 15 MINUTE AS warm
FROM {source} WHERE frequency = 'minute' AND high + low + close + volume IS NOT NULL
WINDOW w AS (PARTITION BY contract_id, trade_date ORDER BY tu RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW)"""


_point = f"""contract_id, {d('trade_date')} AS trade_date, {txt('tu')} AS ts_utc, {r6('vwap')} AS vwap_15m, wv AS window_volume,
  wn AS window_records, warm AS is_warmup"""
sql("INS-06", f"SELECT {_point} FROM ({vwap_sql('q_clean')})")
sql("INS-07", f"SELECT {_point} FROM ({vwap_sql('q_tape', 'close')})")
sql("INS-08", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, {txt('tu')} AS ts_utc, {r6('r.vwap')} AS raw_vwap, {r6('c.vwap')} AS clean_vwap,
  {r6('c.vwap - r.vwap')} AS delta, coalesce(abs(c.vwap - r.vwap) > 1e-9, FALSE) AS differs
FROM (SELECT DISTINCT ON (contract_id, trade_date, tu) * FROM ({vwap_sql('q_tape')})) r
FULL JOIN (SELECT DISTINCT ON (contract_id, trade_date, tu) * FROM ({vwap_sql('q_clean')})) c USING (contract_id, trade_date, tu)""")


def _pair(a: str, b: str) -> str:
    return ", ".join(f"{r6(f'{s}.{f}') if f != 'volume' else f'{s}.{f}'} AS {name}_{f}"
                     for s, name in (("a", a), ("b", b)) for f in ("open", "high", "low", "close", "volume"))


_same = " AND ".join(f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in ("open", "high", "low", "close", "volume"))
_join = """FROM (SELECT * FROM q_bars WHERE basis = '{0}' AND source = '{1}') a
FULL JOIN (SELECT * FROM q_bars WHERE basis = '{2}' AND source = '{3}') b USING (contract_id, trade_date)"""
sql("INS-09", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, NOT (a.record_count IS NOT NULL AND b.record_count IS NOT NULL AND {_same}) AS differs,
  {_pair('raw', 'clean')} {_join.format('raw', 'derived', 'clean', 'derived')}""")
sql("INS-10", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, NOT (a.record_count IS NOT NULL AND b.record_count IS NOT NULL AND {_same}) AS differs,
  if(a.record_count IS NOT NULL AND b.record_count IS NOT NULL, 'compared', 'not_comparable') AS status,
  {_pair('derived', 'supplied')} {_join.format('clean', 'derived', 'clean', 'vendor')}""")
sql("INS-11", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, {r6('a.close')} AS close, a.volume, {r6('b.close')} AS supplied_close,
  b.volume AS supplied_volume, if(b.record_count IS NULL, 'not_comparable', 'compared') AS status,
  {r6('a.close - b.close')} AS close_diff, {r6('round_even(a.volume / nullif(b.volume, 0), 4)')} AS volume_ratio
{_join.format('clean', 'derived', 'clean', 'vendor').replace('FULL JOIN', 'LEFT JOIN')}""")

# ---- patterns and suggestions ---------------------------------------------------------------


def _buckets(instant: str) -> str:
    local = f"timezone('America/Chicago', timezone('UTC', {instant}))"
    hour = (f"strftime({local}, '%H:00') || '-' || strftime({local} + INTERVAL 1 HOUR, '%H:00') || ' America/Chicago'")
    return (f"unnest([{{d: 'hour_of_day', b: {hour}}}, {{d: 'day_of_week', b: dayname(trade_date)}}, "
            f"{{d: 'trade_date', b: CAST(trade_date AS VARCHAR)}}, {{d: 'contract', b: contract_id}}, "
            f"{{d: 'frequency', b: frequency}}, {{d: 'batch', b: filename}}]) AS u")


relation("q_exposed", f"SELECT contract_id AS c, frequency AS g, {_buckets('tu')} FROM q_tape")
relation("q_placed", f"""
SELECT rule_id, contract_id AS c, frequency AS g, trade_date AS day, {_buckets('t0')}
FROM (SELECT f.rule_id, f.contract_id, f.frequency, f.trade_date, f.t0, w.filename FROM q_f f LEFT JOIN q_tape w ON w.record_id = f.record_id)""")


def _patterns(keys: str, lift: float = PATTERN["lift"]) -> str:
    comma = keys + ", " if keys else ""
    using = "USING (" + ", ".join(x for x in (keys, "dimension", "bucket") if x) + ")"
    group = ", ".join(x for x in (keys, "dimension") if x)
    return f"""
SELECT {comma}'p_' || substr(sha1(rule_id || '|' || dimension || '|' || bucket), 1, 16) AS pattern_id, rule_id, dimension, bucket,
  round(sf + 1e-9, 4) AS share_of_findings, round(sr + 1e-9, 4) AS share_of_records, round(sf / sr + 1e-9, 2) AS lift, support, distinct_days,
  CAST(CAST(round_even(100 * sf, 0) AS INTEGER) AS VARCHAR) || '% of ' || replace(lower(split_part(rule_id, '.', 2)), '_', ' ')
    || ' findings ' || CASE dimension WHEN 'hour_of_day' THEN 'fall in the ' || bucket || ' hour' WHEN 'day_of_week' THEN 'fall on ' || bucket || 's'
      WHEN 'trade_date' THEN 'fall on ' || bucket WHEN 'contract' THEN 'sit on ' || bucket
      WHEN 'frequency' THEN 'sit in the ' || bucket || ' config' ELSE 'came from ' || bucket END
    || ', across ' || distinct_days || if(distinct_days = 1, ' session.', ' sessions.') AS narrative,
  CASE WHEN sf / sr >= 10 AND support >= 100 AND distinct_days >= 10 THEN 'high' WHEN sf / sr >= 5 AND support >= 50 THEN 'medium'
    ELSE 'low' END AS confidence
FROM (
  SELECT *, support / rule_total AS sf, records / record_total AS sr
  FROM (SELECT {comma}rule_id, u.d AS dimension, u.b AS bucket, count(*) AS support, count(DISTINCT day) AS distinct_days
        FROM q_placed WHERE u.b IS NOT NULL GROUP BY ALL)
  JOIN (SELECT {comma}rule_id, count(*) AS rule_total FROM (SELECT contract_id AS c, frequency AS g, rule_id FROM q_f) GROUP BY ALL)
    USING ({comma}rule_id)
  JOIN (SELECT {comma}u.d AS dimension, u.b AS bucket, count(*) AS records FROM q_exposed WHERE u.b IS NOT NULL GROUP BY ALL) {using}
  JOIN (SELECT {comma}u.d AS dimension, count(*) AS record_total FROM q_exposed WHERE u.b IS NOT NULL GROUP BY ALL) USING ({group}))
WHERE sf / sr >= {lift} AND support >= {PATTERN['min_support']}
  AND (dimension = 'trade_date' OR distinct_days >= {PATTERN['min_periods']})"""


relation("q_patterns", _patterns(""))
relation("q_slice_patterns", _patterns("c, g"))
relation("q_even_patterns", _patterns("", EVEN_LIFT))
sql("PAT-01", "SELECT u.d AS dimension, u.b AS bucket, count(*) AS records FROM q_exposed WHERE u.b IS NOT NULL GROUP BY ALL")
sql("PAT-02", """
SELECT rule_id, u.d AS dimension, u.b AS bucket, count(*) AS support, count(DISTINCT day) AS distinct_days, any_value(t) AS rule_total
FROM q_placed JOIN (SELECT rule_id, count(*) AS t FROM q_f GROUP BY 1) USING (rule_id) WHERE u.b IS NOT NULL GROUP BY ALL""")
_pattern = f"""pattern_id, rule_id, dimension, bucket, {r6('share_of_findings')} AS share_of_findings,
  {r6('share_of_records')} AS share_of_records, {r6('lift')} AS lift, support, distinct_days, narrative, confidence"""
sql("PAT-03", f"SELECT {_pattern} FROM q_patterns")
_proposed = """
SELECT * FROM (
  SELECT *, CASE
    WHEN rule_id = 'CMP.MISSING_TIMESTAMP' AND dimension = 'hour_of_day' THEN {p: 1, k: 'calendar', o: 'add_halt_window',
      t: 'ref.session_calendar', title: 'Suppress the ' || substr(bucket, 1, 5) || ':00-' || substr(bucket, 7, 5) || ':00 break for this root'}
    WHEN rule_id = 'CMP.SESSION_MISSING' AND dimension = 'trade_date' AND EXISTS (SELECT 1 FROM (SELECT contract_id, max(hi) AS last
        FROM q_slices GROUP BY 1) WHERE TRY_CAST(bucket AS DATE) BETWEEN last - 10 AND last) THEN {p: 2, k: 'rule', o: 'set_param',
      t: 'dq.dq_rule', title: 'Count the last sessions before expiry as part of the roll'}
    WHEN rule_id = 'UNQ.KEY_CONFLICT' AND dimension = 'batch' THEN {p: 3, k: 'rule', o: 'set_dedupe_policy', t: 'dq.dq_rule',
      title: 'Settle conflicts by a fixed choice in ' || bucket}
    WHEN rule_id = 'VAL.OFF_TICK_PRICE' AND dimension = 'frequency' AND bucket = 'daily' THEN {p: 4, k: 'tick', o: 'mark_settlement_bearing',
      t: 'ref.tick', title: 'Let the daily close of this root lie between ticks'}
    WHEN rule_id = 'VAL.OFF_TICK_PRICE' AND dimension = 'frequency' THEN {p: 4, k: 'tick', o: 'correct_tick_reference', t: 'ref.tick',
      title: 'Review the ' || bucket || ' tick for this root'}
    WHEN rule_id = 'REC.CLOSE_CONVENTION' AND dimension = 'frequency' THEN {p: 5, k: 'ingest', o: 'set_close_convention',
      t: 'stage.ingest_batch', title: 'Treat this source''s close as a settlement price'}
    WHEN rule_id = 'REC.VOLUME_SHORTFALL' AND dimension = 'trade_date' THEN {p: 6, k: 'rule', o: 'suppress_on_dates', t: 'dq.dq_rule',
      title: 'Leave daily volume unchecked on ' || bucket} END AS s
  FROM q_patterns) WHERE s IS NOT NULL"""
relation("q_proposed", _proposed)
relation("q_even_proposed", _proposed.replace("q_patterns", "q_even_patterns"))
_params = """CASE s.o
    WHEN 'add_halt_window' THEN '{"start_local":"' || substr(bucket, 1, 5) || ':00","end_local":"' || substr(bucket, 7, 5) || ':00"}'
    WHEN 'set_param' THEN '{"rule_id":"ROL.THIN_NEAR_EXPIRY","param":"days","at_least":10}'
    WHEN 'set_dedupe_policy' THEN '{"rule_id":"UNQ.KEY_CONFLICT","source":"' || bucket || '","tie_break":"lowest_source_row"}'
    WHEN 'mark_settlement_bearing' THEN '{"frequency":"daily","field":"close","exempt":true}'
    WHEN 'correct_tick_reference' THEN '{"frequency":"' || bucket || '"}'
    WHEN 'set_close_convention' THEN '{"close_convention":"settlement","bucket":"' || bucket || '"}'
    WHEN 'suppress_on_dates' THEN '{"rule_id":"REC.VOLUME_SHORTFALL","suppress_dates":["' || bucket || '"]}' END"""
_rationale = """CASE s.o
    WHEN 'add_halt_window' THEN 'Slots that are absent in the same hour day after day point to a break in trading, not to lost records.'
    WHEN 'set_param' THEN 'Sessions that are absent just before a contract''s last one belong to its roll.'
    WHEN 'set_dedupe_policy' THEN 'One file brings the conflicting rows, so one choice settles them all.'
    WHEN 'mark_settlement_bearing' THEN 'A daily close may be a settlement price, which need not lie on a tick.'
    WHEN 'correct_tick_reference' THEN 'Prices of one grain alone miss the tick, so its reference is in doubt before they are.'
    WHEN 'set_close_convention' THEN 'Closes of one grain alone differ, and they sit at the settlement mark.'
    WHEN 'suppress_on_dates' THEN 'On this date the tape is short of volume across sessions, which trading near a roll explains.' END || ' Seen: ' || support || ' findings of ' || rule_id ||
  ' on ' || distinct_days || ' days in ' || bucket || ', ' || CAST(floor(share_of_findings * 100 + 1e-9) AS BIGINT) || '% of them where ' ||
  CAST(floor(share_of_records * 100 + 1e-9) AS BIGINT) || '% of the records lie.'"""
for _i in range(1, 7):
    sql(f"SUG-0{_i}", f"""
SELECT pattern_id, {n('s.p')} AS priority, s.k AS kind, s.o AS operation, s.t AS target, s.title AS title,
  {_params} AS params, {_rationale} AS rationale
FROM {'q_even_proposed' if _i == 4 else 'q_proposed'} WHERE s.p = {_i}""")
sql("SUG-07", f"""
SELECT 's_' || substr(sha1(pattern_id || '|' || s.o), 1, 16) AS suggestion_id, pattern_id AS from_pattern, s.k AS kind,
  s.title AS title, {_rationale} AS rationale, s.t AS target, s.o AS operation, {_params} AS params, rule_id, bucket, support AS findings_suppressed, distinct_days AS sessions,
  {r6('lift')} AS lift, {r6('share_of_findings')} AS share_of_findings, {r6('share_of_records')} AS share_of_records,
  {n('back')} AS records_recovered, if(declared = 'info', 'none: an info rule enters no score', NULL) AS score_impact,
  {r6("if(declared <> 'info' AND q_rules.dimension = 'completeness', round(100.0 * back / total + 1e-9, 2), NULL)")} AS completeness_delta_pct,
  {r6('round(0.5 + 0.5 * (least(1.0, lift / 20.0) + least(1.0, support / 200.0)) / 2 + 1e-9, 2)')} AS confidence
FROM (SELECT q.*, s, round_even(rows * share_of_findings, 0) AS back FROM q_patterns q JOIN (SELECT pattern_id, s FROM q_proposed) USING (pattern_id)
      JOIN (SELECT rule_id, sum(affected_rows) AS rows FROM q_f GROUP BY 1) USING (rule_id))
JOIN q_rules USING (rule_id), (SELECT sum(expected) AS total FROM q_metrics WHERE dimension = 'completeness')""")

# ---- reports --------------------------------------------------------------------------------
sql("RPT-01", f"""
SELECT f.finding_id, f.rule_id, f.severity, f.contract_id, f.frequency, f.compare_frequency, {d('f.trade_date')} AS trade_date,
  {txt('f.t0')} AS ts_start_utc, {txt('f.t1')} AS ts_end_utc, f.record_id, f.affected_rows, w.filename,
  {n('w.source_row')} AS source_row, c.state AS corroboration
FROM (SELECT * FROM q_f ORDER BY finding_id LIMIT 500) f LEFT JOIN q_tape w ON w.record_id = f.record_id
LEFT JOIN q_corr c ON c.finding_id = f.finding_id""")
sql("RPT-02", f"""
SELECT rule_id, count(*) AS findings, {n('sum(affected_rows)')} AS affected_rows, declared AS severity
FROM q_f GROUP BY rule_id, declared ORDER BY findings DESC, rule_id LIMIT 10""")
sql("RPT-03", """
SELECT 'total' AS measure, 'all' AS key, count(*) AS records FROM q_tape
UNION ALL SELECT 'frequency', frequency, count(*) FROM q_tape GROUP BY ALL
UNION ALL SELECT 'injected', 'all', count(*) FILTER (batch_id = 'b-resend') FROM q_tape
UNION ALL SELECT 'rejected', 'all', count(*) FROM q_tape WHERE isodow(trade_date) > 5""")
relation("q_allmetrics", "SELECT contract_id, trade_date, frequency, dimension, expected, actual, affected, found, score FROM q_metrics UNION ALL SELECT * FROM q_cross")
sql("RPT-04", "\nUNION ALL\n".join(f"""
SELECT {n('sum(expected)')} AS expected_records, {n('sum(actual)')} AS actual_records, {n('sum(affected)')} AS affected_records,
  {n('sum(found)')} AS finding_count, {r6('round(avg(score) + 1e-9, 2)')} AS dimension_score, '{g}' AS grouping, CAST({c} AS VARCHAR) AS key
FROM q_allmetrics GROUP BY {c}""" for g, c in (("day", "trade_date"), ("contract", "contract_id"), ("dimension", "dimension"),
                                              ("frequency", "frequency"))))
sql("RPT-05", f"""
SELECT rule_id, count(*) AS finding_count, {n('sum(affected_rows)')} AS affected_rows, dimension, declared AS severity
FROM q_f GROUP BY rule_id, dimension, declared""")
sql("RPT-06", f"""
SELECT {r6('round(avg(overall) + 1e-9, 1)')} AS overall_score, count(*) AS slices, count(overall) AS scored FROM q_scores""")
sql("RPT-07", f"""
SELECT contract_id, {r6('min(overall)')} AS score, if(bool_or(hot), 'ATTN', 'OK') AS status,
  string_agg(frequency, ',' ORDER BY frequency) AS frequencies, {n('any_value(found)')} AS finding_count
FROM q_scores JOIN (SELECT contract_id, bool_or(sev_rank > 2) AS hot, count(*) AS found FROM q_f GROUP BY 1) USING (contract_id)
GROUP BY contract_id""")
relation("q_tally", "SELECT contract_id, rule_id, label, frequency, severity, sev_rank, count(*) AS n FROM q_f WHERE contract_id IS NOT NULL GROUP BY ALL")
_pick = "list({{r: rule_id, l: label, s: severity, n: n}} ORDER BY sev_rank DESC, n DESC, rule_id DESC, frequency DESC){0}[1]"
_settle = " FILTER (frequency = 'daily' AND rule_id IN ('CON.CLOSE_OUT_OF_RANGE', 'CMP.SESSION_MISSING', 'UNQ.KEY_CONFLICT', 'VAL.OFF_TICK_PRICE'))"
sql("RPT-08", f"""
SELECT contract_id, t.r AS top_issue_rule_id, t.l AS top_issue_label, t.s AS top_issue_severity, t.n AS top_issue_findings,
  z.r AS settlement_issue_rule_id, z.l AS settlement_issue_label, z.s AS settlement_issue_severity, z.n AS settlement_issue_findings
FROM (SELECT contract_id, {_pick.format('')} AS t, {_pick.format(_settle)} AS z FROM q_tally GROUP BY 1)""")
sql("RPT-09", """
SELECT accused AS field, n AS findings, CAST(sum(n) OVER () AS BIGINT) AS considered,
  (SELECT count(*) FROM q_f WHERE contract_id IS NOT NULL) AS total
FROM (SELECT accused, count(*) AS n FROM q_f JOIN q_subject USING (rule_id) WHERE contract_id IS NOT NULL GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY n DESC, accused DESC) = 1""")
relation("q_ff", "SELECT f.*, coalesce(family, 'off_strip') AS family FROM q_f f LEFT JOIN q_family USING (rule_id) WHERE contract_id IS NOT NULL")
_volume = "rule_id IN ('VAL.NEGATIVE_VOLUME', 'VAL.NON_INTEGER_VOLUME', 'VAL.ZERO_VOLUME_WITH_RANGE', 'VAL.EXTREME_VOLUME')"
relation("q_cards", f"""
SELECT s.contract_id, s.frequency, u.f AS family, u.l AS label, u.n AS count, u.u AS unit, u.t AS detail FROM q_slices s LEFT JOIN (
  SELECT contract_id, frequency, count(*) FILTER (family = 'gaps') AS gaps, count(*) FILTER (rule_id = 'CMP.SESSION_MISSING') AS absent,
    count(*) FILTER (family = 'duplicates') AS dups, count(*) FILTER (rule_id = 'UNQ.EXACT_DUPLICATE') AS exact,
    count(*) FILTER (family = 'invalid') AS bad,
    count(*) FILTER ({_volume} OR (rule_id = 'CMP.NULL_FIELD' AND field = 'volume')) AS vols
  FROM q_ff GROUP BY ALL) k USING (contract_id, frequency)
LEFT JOIN (SELECT c AS contract_id, g AS frequency, count(*) AS pats,
    list(narrative ORDER BY lift DESC, support DESC, pattern_id)[1] AS top FROM q_slice_patterns GROUP BY ALL) p USING (contract_id, frequency),
unnest([
  {{f: 'gaps', l: 'Gaps', n: coalesce(gaps, 0), u: 'runs', t: (coalesce(gaps, 0) - coalesce(absent, 0)) || if(coalesce(gaps, 0) - coalesce(absent, 0) = 1, ' session-open hole', ' session-open holes')
    || ' · ' || coalesce(absent, 0) || if(coalesce(absent, 0) = 1, ' session absent', ' sessions absent')}},
  {{f: 'duplicates', l: 'Duplicates', n: coalesce(dups, 0), u: 'records', t: coalesce(exact, 0) || if(coalesce(exact, 0) = 1, ' exact copy', ' exact copies')
    || ' · ' || (coalesce(dups, 0) - coalesce(exact, 0)) || if(coalesce(dups, 0) - coalesce(exact, 0) = 1, ' key conflict', ' key conflicts')}},
  {{f: 'invalid', l: 'Invalid values', n: coalesce(bad, 0), u: 'rows', t: (coalesce(bad, 0) - coalesce(vols, 0)) || if(coalesce(bad, 0) - coalesce(vols, 0) = 1, ' price', ' prices')
    || ' · ' || coalesce(vols, 0) || if(coalesce(vols, 0) = 1, ' volume', ' volumes')}},
  {{f: 'patterns', l: 'Recurring patterns', n: coalesce(pats, 0), u: 'standing', t: coalesce(top, 'Nothing recurs here')}}]) w(u)""")
sql("RPT-10", "SELECT * FROM q_cards")
sql("RPT-11", f"""
SELECT contract_id, frequency, family, label AS what, days, {n('records')} AS records, coalesce(did, 'Marked, left in place') AS what_we_did
FROM (SELECT contract_id, frequency, family, rule_id, label, count(DISTINCT trade_date) AS days, sum(affected_rows) AS records
      FROM q_ff WHERE family <> 'off_strip' GROUP BY ALL)
LEFT JOIN (SELECT contract_id, frequency, rule_id, string_agg(if(action = 'exclude', 'excluded ', 'dropped ') || n || if(n = 1, ' record', ' records'), '; ') AS did
           FROM (SELECT contract_id, frequency, rule_id, action, CAST(sum(records) AS BIGINT) AS n FROM q_log GROUP BY ALL) GROUP BY ALL)
  USING (contract_id, frequency, rule_id)
UNION ALL
SELECT c, g, 'patterns', narrative, distinct_days, support, 'Shown only' FROM q_slice_patterns""")
relation("q_bardays", "SELECT DISTINCT contract_id, source_frequency AS frequency, trade_date, 1 AS bar FROM q_bars_clean")
relation("q_marked", f"""
SELECT f.contract_id, f.frequency, f.trade_date, any_value(bar) AS bar,
  bool_or(family = 'gaps' AND NOT (f.rule_id = 'CMP.SESSION_MISSING' AND bar IS NULL)) AS partial_gap,
  bool_or(family = 'duplicates') AS duplicate, bool_or(family = 'invalid') AS invalid,
  bool_or(family = 'invalid' AND (f.{_volume} OR coalesce(field = 'volume', FALSE))) AS invalid_volume,
  bool_or(p.rule_id IS NOT NULL) AS pattern_member,
  list(CASE WHEN f.rule_id = 'CMP.SESSION_MISSING' AND bar IS NULL THEN 'No settled bar'
    WHEN family = 'gaps' THEN coalesce(missing_slots, affected_rows) || ' missing slots at session open'
    WHEN family = 'duplicates' THEN 'One of several copies was kept'
    WHEN f.{_volume} OR field = 'volume' THEN 'Volume defect' ELSE f.label END ORDER BY f.rule_id, t0 NULLS FIRST, finding_id)
    FILTER (family <> 'off_strip')[1] AS caption
FROM q_ff f LEFT JOIN q_bardays b ON b.contract_id = f.contract_id AND b.frequency = f.frequency AND b.trade_date = f.trade_date
LEFT JOIN (SELECT DISTINCT c, g, rule_id FROM q_slice_patterns) p ON p.c = f.contract_id AND p.g = f.frequency AND p.rule_id = f.rule_id
WHERE f.trade_date IS NOT NULL GROUP BY ALL""")
relation("q_overlay", """
SELECT contract_id, frequency, trade_date, if(b.bar IS NULL, 'absent', 'present') AS session, coalesce(partial_gap, FALSE) AS partial_gap,
  coalesce(duplicate, FALSE) AS duplicate, coalesce(invalid, FALSE) AS invalid, coalesce(invalid_volume, FALSE) AS invalid_volume,
  coalesce(pattern_member, FALSE) AS pattern_member, coalesce(caption, '') AS caption
FROM q_bardays b FULL JOIN q_marked m USING (contract_id, frequency, trade_date)""")
sql("RPT-12", f"SELECT * REPLACE ({d('trade_date')} AS trade_date) FROM q_overlay")
_first = "QUALIFY row_number() OVER (PARTITION BY contract_id, frequency ORDER BY {0}) = 1"
sql("RPT-13", f"""
SELECT p.contract_id, p.frequency, 'gaps_ribbon' AS kind, {d('p.trade_date')} AS trade_date, strftime(slot, '%H:%M') AS item,
  CAST(EXISTS (SELECT 1 FROM q_tape w WHERE w.frequency = 'minute' AND w.contract_id = p.contract_id AND w.trade_date = p.trade_date
    AND date_trunc('minute', w.tu) = slot) AS VARCHAR) AS value, NULL::BIGINT AS source_row
FROM (SELECT *, unnest(generate_series(t0 - INTERVAL 4 MINUTE, t0 + INTERVAL 15 MINUTE, INTERVAL 1 MINUTE)) AS slot FROM (
  SELECT * FROM q_ff WHERE rule_id = 'CMP.MISSING_TIMESTAMP' {_first.format('affected_rows DESC, trade_date, t0')})) p
UNION ALL
SELECT contract_id, frequency, 'absent_session', {d('trade_date')}, NULL, NULL, NULL FROM (
  SELECT * FROM q_ff f WHERE rule_id = 'CMP.SESSION_MISSING' AND frequency = 'daily' AND NOT EXISTS (SELECT 1 FROM q_bardays b
    WHERE b.contract_id = f.contract_id AND b.frequency = f.frequency AND b.trade_date = f.trade_date)
  {_first.format('trade_date, finding_id')})
UNION ALL
SELECT p.contract_id, p.frequency, 'duplicate_rows', {d('p.trade_date')}, u.k, p.rule_id, w.source_row FROM (
  SELECT * FROM q_ff WHERE family = 'duplicates' {_first.format('trade_date, rule_id, record_id')}) p,
  unnest([{{k: 'kept', r: keeps_record_id}}, {{k: 'dropped', r: record_id}}]) t(u) JOIN q_tape w ON w.record_id = u.r
UNION ALL
SELECT p.contract_id, p.frequency, 'invalid_cell', {d('p.trade_date')}, coalesce(p.field, accused, 'unknown'), p.rule_id, w.source_row FROM (
  SELECT * FROM q_ff WHERE family = 'invalid' {_first.format('trade_date, rule_id, record_id, finding_id')}) p
  LEFT JOIN q_subject s ON s.rule_id = p.rule_id LEFT JOIN q_tape w ON w.record_id = p.record_id
UNION ALL
SELECT c, g, 'pattern_histogram', NULL, bucket, rule_id, position FROM (
  SELECT *, row_number() OVER (PARTITION BY c, g ORDER BY lift DESC, support DESC, pattern_id) AS position FROM (
    SELECT p.* FROM q_slice_patterns p JOIN (
      SELECT DISTINCT ON (c, g) c, g, rule_id, dimension FROM q_slice_patterns ORDER BY c, g, lift DESC, support DESC, pattern_id) b
    USING (c, g, rule_id, dimension))) WHERE position <= 8""")
sql("RPT-14", """SELECT f.rule_id, coalesce(family, 'off_strip') AS family, count(*) AS n
FROM q_f f LEFT JOIN q_family USING (rule_id) GROUP BY ALL""")
sql("RPT-15", """
SELECT contract_id, frequency, max(count) FILTER (family = 'gaps') AS gaps, max(count) FILTER (family = 'duplicates') AS duplicates,
  max(count) FILTER (family = 'invalid') AS invalid, max(count) FILTER (family = 'patterns') AS patterns, any_value(root) AS root
FROM q_cards JOIN q_roots USING (contract_id) GROUP BY contract_id, frequency""")
sql("RPT-16", f"""
SELECT contract_id, frequency, {d('trade_date')} AS trade_date, {_ohlcv}, session, partial_gap, duplicate, invalid, invalid_volume,
  pattern_member, CASE WHEN fam = 'gaps' AND session = 'absent' THEN 'gap: session missing' WHEN fam = 'gaps' AND partial_gap THEN 'gap: session-open hole'
    WHEN fam = 'duplicates' AND duplicate THEN 'duplicate' WHEN fam = 'invalid' AND invalid THEN 'invalid value'
    WHEN fam = 'patterns' AND pattern_member THEN 'pattern member' ELSE 'clean' END AS status, fam AS family
FROM q_overlay o LEFT JOIN (SELECT *, source_frequency AS frequency FROM q_bars_clean) b USING (contract_id, frequency, trade_date),
  unnest(['gaps', 'duplicates', 'invalid', 'patterns']) u(fam)""")

# ---- sources and sinks ----------------------------------------------------------------------
relation("q_sent", """
SELECT *, CASE WHEN record_id % 233 = 0 OR record_id % 211 = 0 THEN 'STR.UNPARSEABLE_ROW' WHEN record_id % 223 = 0 THEN 'STR.BAD_TIMESTAMP'
    WHEN record_id % 227 = 0 THEN 'STR.NON_NUMERIC_PRICE' WHEN record_id % 229 = 0 THEN 'STR.NON_NUMERIC_VOLUME' END AS why
FROM q_tape WHERE frequency = 'minute'""")
sql("SRC-01", f"""
SELECT if(record_id % 211 = 0, '', contract_id) AS contract, count(*) AS rows, count(close) AS closes,
  count(*) FILTER (record_id % 229 = 0) AS many, {n('0')} AS broken FROM q_sent GROUP BY 1""")
sql("SRC-02", f"""
SELECT contract_id AS contract_symbol, count(*) AS rows, {d('min(trade_date)')} AS "first", {d('max(trade_date)')} AS "last",
  {n('sum(volume)')} AS volume FROM q_tape GROUP BY 1""")
sql("SRC-03", f"""
SELECT count(*) AS rows, count(*) AS stamped, count(*) FILTER (record_id % 233 = 0) AS broken, TRUE AS unbroken FROM q_sent""")
relation("q_files", r"""
SELECT contract_id, trade_date, contract_id = 'ESH24' AND trade_date = min(trade_date) FILTER (contract_id = 'ESH24') OVER () AS known, body
FROM (
  SELECT contract_id, trade_date, string_agg(frequency || ',' || record_id || ',' || volume, chr(10) ORDER BY record_id) || chr(10) AS body
  FROM q_tape GROUP BY ALL)""")
sql("SRC-05", f"""
SELECT sha256(body) AS file_hash, {n('strlen(body)')} AS file_bytes, 'csv' AS file_format, {n('2')} AS files,
  {n("if(known, 2, 0)")} AS already_ingested, {n('1')} AS repeated, {n("if(known, 2, 1)")} AS duplicates
FROM q_files""")
sql("SRC-15", """
SELECT sha256(body) AS file_hash, (SELECT sha256(body) FROM q_files WHERE known) AS sha256
FROM q_files WHERE NOT known""")
sql("UNQ.DUPLICATE_FILE", f"""
SELECT 'UNQ.DUPLICATE_FILE' AS rule_id, sha256(body) AS file_hash, {n('strlen(body)')} AS file_bytes, TRUE AS already_ingested FROM q_files""")
sql("SRC-06", """
SELECT 'aliases' AS layout, '' AS declined, u.f AS field, u.n AS cells FROM (
  SELECT unnest([{f: 'contract_id', n: count(*) FILTER (record_id % 211 <> 0)}, {f: 'ts', n: count(*)}, {f: 'ts_source', n: count(*)},
    {f: 'open', n: count(*)}, {f: 'high', n: count(*)}, {f: 'low', n: count(*)}, {f: 'close', n: count(close)},
    {f: 'volume', n: count(*)}]) AS u FROM q_sent)
UNION ALL
SELECT 'vendor_daily', 'root_id', u.f, u.n FROM (
  SELECT unnest([{f: 'contract_id', n: count(*)}, {f: 'ts', n: count(*)}, {f: 'ts_source', n: count(*)}, {f: 'open', n: count(open)},
    {f: 'high', n: count(high)}, {f: 'low', n: count(low)}, {f: 'close', n: count(close)}, {f: 'volume', n: count(volume)},
    {f: 'open_interest', n: count(open_interest)}]) AS u FROM q_tape)""")
relation("q_steps", """
SELECT grain, epoch(ts - lag(ts) OVER (PARTITION BY grain, contract_id ORDER BY ts)) AS step
FROM (SELECT DISTINCT frequency AS grain, contract_id, date_trunc('minute', tx) AS ts FROM q_tape)""")
relation("q_modal", """
SELECT grain, sum(n) AS deltas, list({s: step, n: n} ORDER BY n DESC, step)[1] AS top, list({s: step, n: n}) AS steps
FROM (SELECT grain, CAST(step AS BIGINT) AS step, count(*) AS n FROM q_steps WHERE step > 0 GROUP BY ALL) GROUP BY grain""")
sql("SRC-07", f"""
SELECT top.s AS modal_seconds, {n('deltas')} AS deltas, {n('top.n')} AS at_mode, {n('off_grid')} AS off_grid, {n('intraday')} AS intraday,
  coalesce(known, top.s || ' seconds') AS label, if(intraday = 0 OR known = '1 day', 'daily', 'minute') AS frequency,
  {r6('CASE WHEN known IS NULL THEN 0.2 WHEN off_grid > 0 THEN 0.5 ELSE 1.0 END')} AS confidence,
  {r6('top.n / deltas')} AS modal_share, grain AS file
FROM (SELECT *, CASE top.s WHEN 60 THEN '1 minute' WHEN 300 THEN '5 minutes' WHEN 900 THEN '15 minutes' WHEN 3600 THEN '1 hour'
        WHEN 86400 THEN '1 day' END AS known,
      coalesce(list_sum([x.n FOR x IN steps IF x.s % top.s <> 0]), 0) AS off_grid FROM q_modal)
JOIN (SELECT frequency AS grain, count(*) FILTER (hour(tx) * 60 + minute(tx) <> 0) AS intraday FROM q_tape GROUP BY 1) USING (grain)""")
sql("SRC-08", f"""
SELECT 'America/Chicago' AS timezone, CASE WHEN n = 1 AND silent[1] = 16 THEN 'maintenance break' WHEN n = 1 THEN 'single empty hour'
  ELSE 'vendor default' END AS method, {r6('CASE WHEN n = 1 AND silent[1] = 16 THEN 0.9 WHEN n = 1 THEN 0.4 ELSE 0.2 END')} AS confidence,
  {n('n')} AS empty_hours, file
FROM (SELECT file, silent, len(silent) AS n FROM (
  SELECT file, [h FOR h IN range(24) IF NOT list_contains(list(DISTINCT hour(tx)), h)] AS silent
  FROM q_minute, (VALUES ('all', -1), ('no 16', 16), ('no 3', 3)) v(file, cut) WHERE hour(tx) <> cut GROUP BY file))
UNION ALL
SELECT 'America/Chicago', method, {r6('confidence')}, NULL, file FROM (SELECT count(*) FROM q_minute),
  (VALUES ('daily', 0.3, 'daily'), ('profile', 1.0, 'profile')) v(method, confidence, file)""")
sql("SRC-09", f"""
SELECT count(*) AS row_count, {txt("min(date_trunc('minute', tx))")} AS first_ts, {txt("max(date_trunc('minute', tx))")} AS last_ts,
  'CL spot,ESH24,SBH24,SR3H24,ZCH24' AS contracts, 'CL spot' AS unparsed, TRUE AS daily_bars,
  'derived from the minute tape' AS daily_bars_reason, TRUE AS vwap_15m, TRUE AS reconciliation,
  'session_close per root (02:30, 17:00, 19:00) America/Chicago' AS session_boundary FROM q_minute""")
sql("SRC-10", """
SELECT why AS reason_code, CASE WHEN record_id % 233 = 0 THEN 'row does not split into the expected field count'
    WHEN why = 'STR.UNPARSEABLE_ROW' THEN 'no contract identifier on the row' WHEN why = 'STR.BAD_TIMESTAMP' THEN 'timestamp not-a-time does not parse'
    WHEN why = 'STR.NON_NUMERIC_PRICE' THEN 'a price field is present but not numeric' ELSE 'volume is present but not numeric' END AS reason_detail,
  count(*) AS rows, count(*) AS payloads
FROM q_sent WHERE why IS NOT NULL GROUP BY ALL""")
_loaded = "if(volume_source IS NULL, volume, if(volume < 0, -1, 1) * (abs(volume) + 1))"
sql("SRC-11", f"""
SELECT TRUE AS id_alone, contract_id, frequency, {txt('tx')} AS ts_source, {txt('tx')} AS ts_exchange, {txt('tu')} AS ts_utc, {d('trade_date')} AS trade_date,
  {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close,
  {n('CASE WHEN volume_source IS NULL THEN volume ELSE abs(volume) + 1 END')} AS volume, volume_source
FROM q_sent WHERE why IS NULL""")
sql("SRC-12", f"""
SELECT 'b-load' AS batch_id, 'partial' AS status, count(*) FILTER (why IS NULL) AS rows_accepted,
  string_agg(DISTINCT contract_id, ',' ORDER BY contract_id) FILTER (why IS NULL) AS contracts,
  count(DISTINCT (contract_id, trade_date)) FILTER (why IS NULL) AS sessions, {d('min(trade_date) FILTER (why IS NULL)')} AS first_date,
  {d('max(trade_date) FILTER (why IS NULL)')} AS last_date, count(why) AS rows_rejected,
  (SELECT string_agg(why || '=' || n, ',' ORDER BY why || '=' || n) FROM (SELECT why, count(*) AS n FROM q_sent WHERE why IS NOT NULL GROUP BY 1)) AS reasons,
  count(*) AS rows_read FROM q_sent""")
sql("SRC-14", f"""
SELECT count(*) FILTER (mine) AS records_deleted, count(*) FILTER (mine AND record_id % 500 = 0) AS rejects_deleted,
  (SELECT count(*) FROM q_f WHERE record_id IN (SELECT record_id FROM q_tape WHERE batch_id = 'b-zch24')) AS findings_deleted,
  (SELECT count(*) FROM q_bars b WHERE source = 'derived' AND (contract_id, trade_date) IN (SELECT (contract_id, trade_date)
    FROM q_tape WHERE batch_id = 'b-zch24')) AS bars_deleted,
  count(DISTINCT trade_date) FILTER (mine) AS sessions_affected, count(*) FILTER (NOT mine) AS records_left, {n('1')} AS purged
FROM (SELECT *, batch_id = 'b-zch24' AS mine FROM q_tape)""")
sql("SRC-16", f"""
SELECT contract_id, root, '2024-03-01' AS contract_month, exchange, {r6('tick')} AS tick_size, {r6('multiplier')} AS multiplier,
  {d('min(trade_date)')} AS first_trade_date, {d('max(trade_date)')} AS last_trade_date,
  {r6("if(contract_id = 'CLH24', 0.5, 1.0)")} AS parse_confidence, TRUE AS dates_inferred
FROM q_tape JOIN (SELECT contract_id, tick, multiplier FROM q_roots) USING (contract_id) GROUP BY ALL""")
sql("SRC-18", """
SELECT * FROM (VALUES ('VAL.NEGATIVE_VOLUME', 'negate_volume', 'volume'), ('CON.HIGH_LT_LOW', 'swap_high_and_low', 'high'),
  ('CON.CLOSE_OUT_OF_RANGE', 'close_above_high', 'close'), ('CMP.NULL_FIELD', 'blank_close', 'close'),
  ('VAL.PRICE_MAGNITUDE', 'decimal_shift_10x', 'close'), ('UNQ.EXACT_DUPLICATE', 'repeat_row', NULL),
  ('UNQ.KEY_CONFLICT', 'conflicting_close_on_one_timestamp', 'close'), ('TIM.OUT_OF_ORDER', 'swap_adjacent_rows', NULL),
  ('CMP.MISSING_TIMESTAMP', 'delete_5_consecutive_rows', NULL)) v(rule_id, kind, field_name), (SELECT TRUE AS shows, count(*) - 3 AS rows, count(*) - 3 AS numbers FROM q_minute)""")
sql("SNK-01", f"""
SELECT record_id, contract_id, {d('trade_date')} AS trade_date, {txt('tx')} AS ts_exchange, {r6('open')} AS open, {r6('high')} AS high,
  {r6('low')} AS low, {r6('close')} AS close, volume FROM q_tape""")
sql("SNK-02", f"""
SELECT contract_id, {d('trade_date')} AS trade_date, basis, source, {r6('close')} AS close,
  if(contract_id = 'ZCH24' AND basis = 'clean', volume + 1, volume) AS volume
FROM q_bars WHERE basis = 'raw' OR contract_id NOT IN ('ESH24', 'ZCH24') OR (contract_id = 'ZCH24' AND source = 'derived')""")
sql("SNK-03", f"""
SELECT frequency, {d('trade_date')} AS trade_date, count(*) AS records, {n('sum(volume)')} AS volume FROM q_tape GROUP BY ALL""")
