"""Named relations the check SQL is assembled from: tape, calendar, windows, rule findings.

A statement names the relations it reads; ``compose`` puts them and what they need in front of
it as common table expressions. Instants are naive UTC.
"""

from __future__ import annotations

import re

from tapewright.catalogue import PRICE_BANDS, RULES, SUBJECT_FIELD, FAMILY_RULES

from .env import OVERRIDES, ROLLING

RELATIONS: dict[str, str] = {}
_NAME = re.compile(r"[a-z][a-z0-9_]*")


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def compose(select: str) -> str:
    """Prefix a statement with every relation it reaches, each before its readers."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in _NAME.findall(text):
            if word in RELATIONS and word not in ordered and word not in path:
                visit(RELATIONS[word], (*path, word))
                ordered.append(word)

    visit(select, ())
    ctes = ",\n".join(f"{n} AS (\n{RELATIONS[n]}\n)" for n in ordered)
    return f"WITH {ctes}\n{select.strip()}" if ordered else select.strip()


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"


def txt(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def utc(expr: str) -> str:
    """Naive UTC of a Chicago wall clock."""
    return f"timezone('UTC', timezone('America/Chicago', {expr}))"


# ---- tape -----------------------------------------------------------------------------------
relation("q_roots", """
SELECT * FROM (VALUES
  ('ESH24', 'ES', 'CME', 17 * 3600, 17 * 3600, 16 * 3600, 1380, 0.25, 50.0, 1),
  ('ZCH24', 'ZC', 'CBOT', 19 * 3600, 19 * 3600, 13 * 3600 + 1200, 1055, 0.25, 50.0, 2),
  ('SR3H24', 'SR3', 'CME', 17 * 3600, 17 * 3600, 16 * 3600, 1380, 0.0025, 2500.0, 3),
  ('SBH24', 'SB', 'ICEUS', NULL, 9000, 12 * 3600, 570, 0.01, 1120.0, 4),
  ('CLH24', 'CL', 'NYMEX', 17 * 3600, 17 * 3600, 16 * 3600, 1380, 0.01, 1000.0, 5)
) v(contract_id, root, exchange, roll_sec, open_sec, close_sec, slots, tick, multiplier, ordinal)
""")
relation("q_contracts", """
SELECT contract_id, root, exchange, tick, multiplier, DATE '2024-03-01' AS contract_month,
  CASE contract_id WHEN 'ESH24' THEN DATE '2024-01-04' WHEN 'CLH24' THEN DATE '2024-01-03' END AS first_trade_date,
  CASE contract_id WHEN 'ESH24' THEN DATE '2024-01-26' WHEN 'ZCH24' THEN DATE '2024-01-25' END AS last_trade_date
FROM q_roots
""")
relation("q_events", """
SELECT event_id AS e,
  CASE event_type WHEN 'click' THEN 'ESH24' WHEN 'error' THEN 'ZCH24' WHEN 'purchase' THEN 'SR3H24'
    WHEN 'signup' THEN 'SBH24' WHEN 'view' THEN 'CLH24' END AS contract_id,
  date_trunc('minute', ts) AS tx, value AS c0, value + (event_id % 5 - 2) * 0.25 AS o0,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events
""")
relation("q_bars0", """
SELECT e, v.contract_id, tx, c0, o0, k, greatest(o0, c0) + (e % 3) * 0.25 AS h0,
  least(o0, c0) - (e % 4) * 0.25 AS l0, ordinal,
  CAST(tx AS DATE) + CASE WHEN hour(tx) * 3600 + minute(tx) * 60 >= roll_sec THEN 1 ELSE 0 END AS trade_date
FROM q_events v JOIN q_roots r ON r.contract_id = v.contract_id
""")
relation("q_minute", """
SELECT CAST(e * 10 + if(e % 127 = 0, 503, 0) + copy AS BIGINT) AS record_id,
  if(copy = 2, 'b-resend', 'b-' || lower(contract_id)) AS batch_id, contract_id, 'minute' AS frequency,
  if(e % 139 = 0, tx + INTERVAL 30 SECOND, tx) AS tx, trade_date,
  if(e % 137 = 0, h0 + 2.0, o0) AS open, if(e % 101 = 0, l0, h0) AS high, if(e % 101 = 0, h0, l0) AS low,
  CASE WHEN copy = 2 THEN c0 + 1.25 WHEN e % 97 = 0 THEN NULL WHEN e % 113 = 0 THEN h0 + 5.0 ELSE c0 END AS close,
  if(e % 103 = 0, -k, k) AS volume, if(e % 131 = 0, k || '.5', NULL) AS volume_source,
  CAST(NULL AS BIGINT) AS open_interest
FROM q_bars0, unnest([0, 1, 2]) u(copy)
WHERE copy = 0 OR (copy = 1 AND e % 107 = 0) OR (copy = 2 AND e % 109 = 0)
""")
relation("q_firstlast", """
SELECT contract_id, trade_date, ordinal, max(h0) AS h, min(l0) AS l, sum(k) AS total,
  list(o0 ORDER BY tx, e)[1] AS o, list(c0 ORDER BY tx DESC, e DESC)[1] AS c,
  list(c0 ORDER BY abs(hour(tx) * 3600 + minute(tx) * 60 - 54000), tx, e)[1] AS mark
FROM q_bars0 GROUP BY ALL
""")
relation("q_daily", """
SELECT CAST(9000000000 + ordinal * 100000 + (trade_date - DATE '2020-01-01') AS BIGINT) AS record_id,
  'b-daily' AS batch_id, contract_id, 'daily' AS frequency, CAST(trade_date AS TIMESTAMP) AS tx, trade_date,
  o AS open, if(day(trade_date) % 7 = 0, h + 0.25, h) AS high, l AS low,
  CASE WHEN day(trade_date) % 4 = 0 THEN h + 1.0 WHEN day(trade_date) % 3 = 0 THEN mark
    WHEN day(trade_date) % 13 = 0 THEN c + 0.75 ELSE c END AS close,
  CAST(if(day(trade_date) % 5 = 0, total * 2, total) AS BIGINT) AS volume, CAST(NULL AS VARCHAR) AS volume_source,
  CAST(total + 10 AS BIGINT) AS open_interest
FROM q_firstlast WHERE day(trade_date) % 11 <> 0
""")
relation("q_tape", f"""
SELECT t.*, record_id AS source_row, {utc('tx')} AS tu, root, exchange, first_trade_date, last_trade_date,
  if(frequency = 'daily', '1 day', '1 minute') AS bar_interval, TIMESTAMP '2024-01-29 12:00:00' AS ingested_at,
  CASE batch_id WHEN 'b-resend' THEN 'resend.csv' WHEN 'b-daily' THEN 'daily.parquet'
    ELSE substr(batch_id, 3) || '_minute.csv' END AS filename
FROM (SELECT * FROM q_minute UNION ALL BY NAME SELECT * FROM q_daily) t JOIN q_contracts USING (contract_id)
""")
relation("q_week", "SELECT * FROM q_tape WHERE isodow(trade_date) <= 5")

# ---- calendar -------------------------------------------------------------------------------
relation("q_dates", """
SELECT CAST(unnest(generate_series(make_date(year(lo), 1, 1)::TIMESTAMP, make_date(year(hi), 12, 31)::TIMESTAMP,
  INTERVAL 1 DAY)) AS DATE) AS d
FROM (SELECT min(trade_date) - 5 AS lo, max(trade_date) + 366 AS hi FROM q_tape)
""")
relation("q_easter", """
SELECT * FROM (VALUES (DATE '2022-04-17'), (DATE '2023-04-09'), (DATE '2024-03-31'), (DATE '2025-04-20'),
  (DATE '2026-04-05')) v(sunday)
""")
_moves = lambda m, dd: (
    f"((month(d) = {m} AND day(d) = {dd} AND isodow(d) <> 7) OR (isodow(d) = 1 AND month(d - 1) = {m} AND day(d - 1) = {dd}))")
relation("q_named", f"""
SELECT d, CASE
  WHEN {_moves(1, 1)} THEN 'New Year''s Day'
  WHEN {_moves(12, 25)} THEN 'Christmas Day'
  WHEN month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
  WHEN month(d) = 2 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'Presidents Day'
  WHEN d + 2 IN (SELECT sunday FROM q_easter) THEN 'Good Friday'
  WHEN month(d) = 5 AND isodow(d) = 1 AND day(d) > 24 THEN 'Memorial Day'
  WHEN {_moves(7, 4).replace('(d)', '(d + 1)').replace('d - 1)', 'd)')} THEN 'Independence Day eve'
  WHEN {_moves(7, 4)} THEN 'Independence Day'
  WHEN month(d) = 9 AND isodow(d) = 1 AND day(d) < 8 THEN 'Labor Day'
  WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving'
  WHEN month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29 THEN 'Day after Thanksgiving'
  WHEN {_moves(12, 25).replace('(d)', '(d + 1)').replace('d - 1)', 'd)')} THEN 'Christmas Eve'
  WHEN {_moves(6, 19)} THEN 'Juneteenth' END AS name
FROM q_dates
""")
relation("q_spans", """
SELECT contract_id, root, exchange, open_sec, close_sec, slots, lo - 5 AS lo, hi + 5 AS hi
FROM (SELECT contract_id, min(trade_date) AS lo, max(trade_date) AS hi FROM q_tape GROUP BY 1) JOIN q_roots USING (contract_id)
""")
relation("q_week_spans", """
SELECT contract_id, root, exchange, open_sec, close_sec, slots, lo - 5 AS lo, hi + 5 AS hi
FROM (SELECT contract_id, min(trade_date) AS lo, max(trade_date) AS hi FROM q_week GROUP BY 1) JOIN q_roots USING (contract_id)
""")
for _cal, _src in (("q_cal", "q_spans"), ("q_wcal", "q_week_spans")):
    relation(_cal, f"""
SELECT root, exchange, d AS trade_date, coalesce(name IN ('New Year''s Day', 'Christmas Day'), FALSE) AS closed,
  coalesce(name NOT IN ('New Year''s Day', 'Christmas Day'), FALSE) AS early,
  if(closed, NULL, {utc("(d - if(open_sec > close_sec, 1, 0))::TIMESTAMP + to_seconds(open_sec)")}) AS opens,
  if(closed, NULL, {utc("d::TIMESTAMP + to_seconds(close_sec)")}) AS closes,
  if(root = 'ZC' AND NOT closed, {utc("d::TIMESTAMP + to_seconds(7 * 3600 + 2700)")}, NULL) AS halt_from,
  if(root = 'ZC' AND NOT closed, {utc("d::TIMESTAMP + to_seconds(8 * 3600 + 1800)")}, NULL) AS halt_to,
  CASE WHEN closed THEN 0 WHEN early THEN NULL ELSE slots END AS slots
FROM {_src} JOIN q_named ON d BETWEEN lo AND hi WHERE isodow(d) <= 5
""")

# ---- sessions and windows -------------------------------------------------------------------
relation("q_sess", """
SELECT contract_id, frequency, root, trade_date, count(*) AS n, sum(coalesce(volume, 0)) AS v, min(tu) AS t0, max(tu) AS t1
FROM q_week GROUP BY ALL
""")
relation("q_sess_whole", RELATIONS["q_sess"].replace("q_week", "q_tape"))
relation("q_slices", """
SELECT contract_id, frequency, root, CAST(sum(n) AS BIGINT) AS actual, min(trade_date) AS lo, max(trade_date) AS hi
FROM q_sess GROUP BY ALL
""")


def coverage_sql(floor: float) -> str:
    return f"""
SELECT s.contract_id, s.frequency,
  coalesce(liq_lo, if(is_listed, first_trade_date, lo)) AS start_date,
  coalesce(liq_hi, if(is_listed, last_trade_date, hi)) AS end_date,
  CASE WHEN liq_lo IS NOT NULL THEN 'liquidity' WHEN is_listed THEN 'listed' ELSE 'observed' END AS basis
FROM (SELECT contract_id, frequency, min(trade_date) AS lo, max(trade_date) AS hi,
        min(trade_date) FILTER (v > {floor}) AS liq_lo, max(trade_date) FILTER (v > {floor}) AS liq_hi
      FROM q_sess GROUP BY ALL) s
JOIN (SELECT *, first_trade_date IS NOT NULL AND last_trade_date IS NOT NULL AS is_listed FROM q_contracts) USING (contract_id)
"""


def roll_sql(ratio: float) -> str:
    return f"""
SELECT * FROM (
  SELECT contract_id, frequency, roll_end - 10 AS roll_start, roll_end, expiry_basis,
    median(v) FILTER (trade_date BETWEEN roll_end - 10 AND roll_end) AS median_inside,
    median(v) FILTER (trade_date < roll_end - 10) AS median_before
  FROM q_sess JOIN (
    SELECT contract_id, frequency, coalesce(last_trade_date, hi) AS roll_end,
      if(last_trade_date IS NULL, 'observed', 'listed') AS expiry_basis
    FROM q_slices JOIN q_contracts USING (contract_id)) USING (contract_id, frequency)
  GROUP BY ALL) WHERE median_inside < {ratio} * median_before
"""


relation("q_cover", coverage_sql(1000))
relation("q_roll", roll_sql(0.2))
relation("q_roll_wide", roll_sql(ROLLING["ROL.THIN_NEAR_EXPIRY"]["collapse_ratio"]))
relation("q_win", "SELECT c.*, roll_start, roll_end FROM q_cover c LEFT JOIN q_roll USING (contract_id, frequency)")
relation("q_win_wide", "SELECT c.*, roll_start, roll_end FROM q_cover c LEFT JOIN q_roll_wide USING (contract_id, frequency)")
relation("q_expected", """
SELECT contract_id, frequency, trade_date, basis, if(frequency = 'minute', slots, 1) AS expected
FROM q_slices JOIN q_win USING (contract_id, frequency) JOIN q_wcal USING (root)
WHERE trade_date BETWEEN start_date AND end_date AND NOT closed
  AND NOT coalesce(trade_date BETWEEN roll_start AND roll_end, FALSE)
""")
relation("q_judged", """
SELECT s.contract_id, s.frequency, s.trade_date, s.root, basis, opens, closes, halt_from, halt_to, slots
FROM q_sess s JOIN q_win USING (contract_id, frequency) JOIN q_wcal c ON c.root = s.root AND c.trade_date = s.trade_date
WHERE s.frequency = 'minute' AND s.trade_date BETWEEN start_date AND end_date AND NOT closed AND NOT early
  AND NOT coalesce(s.trade_date BETWEEN roll_start AND roll_end, FALSE)
""")
relation("q_grid", """
SELECT contract_id, trade_date, slot, row_number() OVER (PARTITION BY contract_id, trade_date ORDER BY slot) AS no
FROM (SELECT *, unnest(generate_series(opens, closes - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS slot FROM q_judged)
WHERE halt_from IS NULL OR slot < halt_from OR slot >= halt_to
""")

# ---- findings -------------------------------------------------------------------------------
SEVERITY = {r.rule_id: r.severity for r in RULES}
HEAD = "contract_id, frequency, trade_date, tu AS t0, tu AS t1, record_id, 1 AS affected_rows"
FIND: dict[str, str] = {}


def slug(rule_id: str) -> str:
    return "f_" + rule_id.lower().replace(".", "_")


def rule(rule_id: str, body: str, on_week: bool = True) -> None:
    """``{src}`` in a body is the record relation: the weekday tape in the run, else the tape."""
    FIND[rule_id] = body
    for suffix, src in (("", "q_week"), ("_all", "q_tape")):
        text = body.replace("{src}", src).replace("{cal}", "q_wcal" if src == "q_week" else "q_cal")
        severity = "" if re.search(r"AS severity\b", text) else f", '{SEVERITY[rule_id]}' AS severity"
        relation(slug(rule_id) + suffix, f"SELECT '{rule_id}' AS rule_id, *{severity} FROM (\n{text.strip()}\n)")


rule("CMP.NULL_FIELD", f"""
SELECT {HEAD}, u.field AS subject, u.field AS field FROM {{src}},
  unnest([{{field: 'open', x: open}}, {{field: 'high', x: high}}, {{field: 'low', x: low}},
    {{field: 'close', x: close}}, {{field: 'volume', x: CAST(volume AS DOUBLE)}}]) w(u)
WHERE u.x IS NULL""")
rule("VAL.NON_POSITIVE_PRICE", f"""
SELECT {HEAD}, u.field AS subject, u.field AS field, u.x AS value FROM {{src}},
  unnest([{{field: 'open', x: open}}, {{field: 'high', x: high}}, {{field: 'low', x: low}}, {{field: 'close', x: close}}]) w(u) WHERE u.x <= 0""")
rule("VAL.NEGATIVE_VOLUME", f"SELECT {HEAD}, 'volume' AS subject, 'volume' AS field, volume AS value FROM {{src}} WHERE volume < 0")
rule("VAL.NON_INTEGER_VOLUME", f"""
SELECT {HEAD}, 'volume' AS subject, 'volume' AS field, volume_source AS source_value, volume AS loaded_value
FROM {{src}} WHERE volume_source IS NOT NULL""")
rule("VAL.OFF_TICK_PRICE", f"""
SELECT {HEAD}, u.field AS subject, u.field AS field, u.x AS value, round(u.x - round(u.x / tick) * tick, 12) AS residual
FROM {{src}} JOIN (SELECT contract_id, tick FROM q_roots) USING (contract_id),
  unnest([{{field: 'open', x: open}}, {{field: 'high', x: high}}, {{field: 'low', x: low}}, {{field: 'close', x: close}}]) w(u)
WHERE NOT (frequency = 'daily' AND u.field = 'close') AND abs(u.x - round(u.x / tick) * tick) > tick * 1e-4""")
rule("VAL.ZERO_VOLUME_WITH_RANGE", f"""
SELECT {HEAD}, 'volume' AS subject, if(bar_interval = '1 day', 'info', 'warning') AS severity,
  if(bar_interval = '1 day', 'daily', 'intraday') AS basis, round(high - low, 12) AS range
FROM {{src}} WHERE volume = 0 AND high > low""")
_bands = ", ".join(f"('{k}', {v[0]}, {v[1]})" for k, v in PRICE_BANDS.items())
rule("VAL.PRICE_MAGNITUDE", f"""
SELECT {HEAD}, u.field AS subject, u.field AS field, u.x AS value
FROM {{src}} JOIN (VALUES {_bands}) b(root, lo, hi) USING (root),
  unnest([{{field: 'open', x: open}}, {{field: 'high', x: high}}, {{field: 'low', x: low}}, {{field: 'close', x: close}}]) w(u)
WHERE u.x NOT BETWEEN lo AND hi""")
_caps = OVERRIDES["VAL.EXTREME_VOLUME"]["max_plausible"]
rule("VAL.EXTREME_VOLUME", f"""
SELECT {HEAD}, 'volume' AS subject, 'volume' AS field, volume AS value,
  if(frequency = 'minute', {_caps['minute']}, {_caps['daily']}) AS max_plausible
FROM {{src}} WHERE volume > if(frequency = 'minute', {_caps['minute']}, {_caps['daily']})""")
rule("CON.HIGH_LT_LOW", f"SELECT {HEAD}, '' AS subject, high, low FROM {{src}} WHERE high < low")
rule("CON.OPEN_OUT_OF_RANGE", f"""
SELECT {HEAD}, 'open' AS subject, 'open' AS field, open AS value FROM {{src}}
WHERE high >= low AND open NOT BETWEEN low AND high""")
rule("CON.CLOSE_OUT_OF_RANGE", f"""
SELECT {HEAD}, 'close' AS subject, 'close' AS field, close AS value, if(bar_interval = '1 day', 'warning', 'error') AS severity,
  if(bar_interval = '1 day', 'daily', 'intraday') AS basis
FROM {{src}} WHERE high >= low AND close NOT BETWEEN low AND high""")
rule("CON.WEEKEND_RECORD", f"SELECT {HEAD}, '' AS subject, dayname(trade_date) AS weekday FROM {{src}} WHERE isodow(trade_date) > 5")
rule("CON.RECORD_IN_HALT", f"""
SELECT {HEAD}, '' AS subject FROM {{src}} JOIN (SELECT root, trade_date, halt_from, halt_to FROM {{cal}}) USING (root, trade_date)
WHERE tu >= halt_from AND tu < halt_to""")
rule("CON.RECORD_ON_HOLIDAY", f"""
SELECT {HEAD}, '' AS subject FROM {{src}} JOIN (SELECT root, trade_date, closed FROM {{cal}}) USING (root, trade_date) WHERE closed""")
rule("TIM.FUTURE_TIMESTAMP", f"SELECT {HEAD}, '' AS subject FROM {{src}} WHERE tu > ingested_at")
rule("TIM.BEFORE_LISTING", f"SELECT {HEAD}, '' AS subject FROM {{src}} WHERE trade_date < first_trade_date")
rule("TIM.AFTER_EXPIRY", f"SELECT {HEAD}, '' AS subject FROM {{src}} WHERE trade_date > last_trade_date")
rule("TIM.OFF_GRID", f"""
SELECT {HEAD}, '' AS subject, if(frequency = 'daily', 86400, 60) AS interval_seconds FROM {{src}}
WHERE CAST(epoch(tx) AS BIGINT) % if(frequency = 'daily', 86400, 60) <> 0""")
_vals = "open, high, low, close, volume, open_interest"
rule("UNQ.EXACT_DUPLICATE", f"""
SELECT {HEAD}, '' AS subject, copies, keep.r AS keeps_record_id, keep.s AS keeps_source_row
FROM (SELECT *, count(*) OVER k AS copies,
        min({{s: source_row, r: record_id}}) OVER k AS keep
      FROM {{src}} WINDOW k AS (PARTITION BY contract_id, frequency, tu, {_vals}))
WHERE copies > 1 AND record_id <> keep.r""")
rule("UNQ.KEY_CONFLICT", f"""
SELECT {HEAD}, '' AS subject, variants
FROM {{src}} JOIN (
  SELECT contract_id, frequency, tu, count(*) AS variants
  FROM (SELECT DISTINCT contract_id, frequency, tu, {_vals} FROM {{src}}) GROUP BY ALL HAVING count(*) > 1
) USING (contract_id, frequency, tu)""")
rule("CON.STALE_REPEAT", """
SELECT contract_id, frequency, min(trade_date) AS trade_date, min(tu) AS t0, max(tu) AS t1, NULL::BIGINT AS record_id,
  count(*) AS affected_rows, CAST(min(record_id) AS VARCHAR) AS subject, count(*) AS run_length,
  if(root = 'ZC', 3, 2) AS threshold_n, max(close) AS repeated_close
FROM (
  SELECT *, CAST(sum(if(same, 0, 1)) OVER o AS BIGINT) AS run FROM (
    SELECT *, coalesce(open = lag(open) OVER o AND high IS NOT DISTINCT FROM lag(high) OVER o
      AND low IS NOT DISTINCT FROM lag(low) OVER o AND close IS NOT DISTINCT FROM lag(close) OVER o
      AND coalesce(volume, 0) <> 0 AND coalesce(lag(volume) OVER o, 0) <> 0, FALSE) AS same
    FROM {src} WINDOW o AS (PARTITION BY contract_id, frequency ORDER BY tu, record_id))
  WINDOW o AS (PARTITION BY contract_id, frequency ORDER BY tu, record_id ROWS UNBOUNDED PRECEDING))
GROUP BY contract_id, frequency, root, run HAVING count(*) >= if(root = 'ZC', 3, 2)""")
rule("CON.PRICE_JUMP", f"""
SELECT {HEAD}, '' AS subject, ln(close / p) AS log_return, p AS previous_close
FROM (SELECT *, lag(close) OVER (PARTITION BY contract_id, frequency ORDER BY tu, record_id) AS p FROM {{src}} WHERE close > 0)
WHERE abs(ln(close / p)) > if(frequency = 'minute', 0.05, 0.25)""")
rule("TIM.OUT_OF_ORDER", f"""
SELECT {HEAD}, '' AS subject FROM {{src}}
QUALIFY tu < lag(tu) OVER (PARTITION BY batch_id, contract_id, frequency ORDER BY source_row)""")
_tz = """
SELECT NULL::VARCHAR AS contract_id, 'minute' AS frequency, NULL::DATE AS trade_date, t0, t1, NULL::BIGINT AS record_id,
  n AS affected_rows, batch_id || ':' || root AS subject, dead AS observed_dead_hour_local,
  (dead - 16 + 36) % 24 - 12 AS offset_hours
FROM (SELECT batch_id, root, count(*) AS n, min(tu) AS t0, max(tu) AS t1, 276 - sum(DISTINCT hour(tx)) AS dead,
        count(DISTINCT hour(tx)) AS active
      FROM {src} WHERE frequency = 'minute' AND root IN ('ES', 'SR3', 'CL') @@ GROUP BY ALL)
WHERE n >= 100 AND active = 23 AND dead <> 16"""
rule("TIM.TIMEZONE_MISALIGNED", _tz.replace("@@", ""))
relation("f_tim_timezone_misaligned_quiet", "SELECT 'TIM.TIMEZONE_MISALIGNED' AS rule_id, 'critical' AS severity, * FROM ("
         + _tz.replace("@@", "AND hour(tx) <> 3").replace("{src}", "q_tape") + ")")


def mad_sql(value: str, source: str) -> str:
    return f"""
SELECT {HEAD}, '' AS subject, x AS value, med AS median, mad, 0.6745 * (x - med) / mad AS modified_z
FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY contract_id, frequency) AS mad
  FROM (SELECT *, median(x) OVER (PARTITION BY contract_id, frequency) AS med,
          count(x) OVER (PARTITION BY contract_id, frequency) AS cnt
        FROM (SELECT *, {value} AS x FROM {source}) WHERE x IS NOT NULL) WHERE cnt >= 30)
WHERE mad > 0 AND abs(0.6745 * (x - med) / mad) > 3.5"""


_ret = "ln(close / lag(close) OVER (PARTITION BY contract_id, frequency ORDER BY tu, source_row))"
rule("OUT.RETURN_MAD", mad_sql(_ret, "{src} WHERE close > 0"))
rule("OUT.VOLUME_MAD", mad_sql("ln(volume)", "{src} WHERE volume > 0"))
relation("f_out_return_mad_clean", f"SELECT 'OUT.RETURN_MAD' AS rule_id, 'info' AS severity, * FROM ({mad_sql(_ret, 'q_clean WHERE close > 0')})")
relation("f_out_volume_mad_clean", f"SELECT 'OUT.VOLUME_MAD' AS rule_id, 'info' AS severity, * FROM ({mad_sql('ln(volume)', 'q_clean WHERE volume > 0')})")

_span = "NULL::TIMESTAMP AS t0, NULL::TIMESTAMP AS t1, NULL::BIGINT AS record_id"
rule("CMP.SESSION_MISSING", f"""
SELECT contract_id, frequency, trade_date, {_span}, coalesce(expected, 0) AS affected_rows, '' AS subject,
  basis AS window_basis, coalesce(expected, 0) AS expected_records
FROM q_expected ANTI JOIN q_sess USING (contract_id, frequency, trade_date)""")
rule("CMP.MISSING_TIMESTAMP", """
SELECT contract_id, 'minute' AS frequency, trade_date, min(slot) AS t0, max(slot) AS t1, NULL::BIGINT AS record_id,
  count(*) AS affected_rows, '' AS subject, count(*) AS missing_slots
FROM (SELECT *, no - row_number() OVER (PARTITION BY contract_id, trade_date ORDER BY no) AS island
      FROM q_grid ANTI JOIN (SELECT contract_id, trade_date, date_trunc('minute', tu) AS slot FROM q_week
                             WHERE frequency = 'minute') USING (contract_id, trade_date, slot))
GROUP BY contract_id, trade_date, island""")
relation("q_filled", """
SELECT contract_id, trade_date, count(DISTINCT date_trunc('minute', tu)) AS filled
FROM q_week WHERE frequency = 'minute' GROUP BY ALL""")
rule("CMP.PARTIAL_SESSION", f"""
SELECT contract_id, frequency, trade_date, {_span}, slots - filled AS affected_rows, '' AS subject,
  basis AS window_basis, filled / slots AS completeness_pct, filled AS actual_slots
FROM q_judged JOIN q_filled USING (contract_id, trade_date) WHERE slots > 0 AND filled / slots < 0.95""")
rule("CMP.SPARSE_SERIES", f"""
SELECT contract_id, frequency, hi AS trade_date, {_span}, sessions AS affected_rows, '' AS subject, sessions,
  CAST(lo AS VARCHAR) AS first_session
FROM (SELECT contract_id, frequency, count(*) AS sessions, min(trade_date) AS lo, max(trade_date) AS hi FROM q_sess GROUP BY ALL)
WHERE sessions < {OVERRIDES['CMP.SPARSE_SERIES']['min_sessions']}""")


def thin_sql(source: str) -> str:
    return f"""
SELECT contract_id, frequency, roll_end AS trade_date, {_span}, 1 AS affected_rows, '' AS subject,
  CAST(roll_start AS VARCHAR) AS window_start, median_inside AS median_session_volume_inside, expiry_basis FROM {source}"""


rule("ROL.THIN_NEAR_EXPIRY", thin_sql("q_roll"))
relation("f_rol_thin_near_expiry_wide", f"SELECT 'ROL.THIN_NEAR_EXPIRY' AS rule_id, 'info' AS severity, * FROM ({thin_sql('q_roll_wide')})")
rule("ROL.NO_SUCCESSOR", f"""
SELECT s.contract_id, frequency, hi AS trade_date, {_span}, 1 AS affected_rows, '' AS subject,
  CAST(coalesce(last_trade_date, hi) AS VARCHAR) AS expiry
FROM q_slices s JOIN q_contracts c ON c.contract_id = s.contract_id
WHERE abs(hi - coalesce(last_trade_date, hi)) <= 30 AND NOT EXISTS (
  SELECT 1 FROM q_slices s2 JOIN q_contracts c2 ON c2.contract_id = s2.contract_id
  WHERE c2.root = c.root AND c2.contract_month > c.contract_month)""")

# ---- bars and the frame ---------------------------------------------------------------------


def bars_sql(source: str) -> str:
    return f"""
SELECT contract_id, trade_date, frequency AS source_frequency, if(frequency = 'minute', 'derived', 'vendor') AS source,
  if(frequency = 'minute', 'last_trade', 'settlement') AS close_convention,
  list(open ORDER BY tu, source_row)[1] AS open, max(high) AS high, min(low) AS low,
  list(close ORDER BY tu DESC, source_row DESC)[1] AS close, CAST(sum(volume) AS BIGINT) AS volume,
  list(open_interest ORDER BY tu DESC, source_row DESC) FILTER (open_interest IS NOT NULL)[1] AS open_interest,
  min(tu) AS t0, max(tu) AS t1, count(*) AS record_count, count(*) FILTER (volume IS NULL) AS volume_null_count
FROM {source} GROUP BY contract_id, trade_date, frequency"""


relation("q_bars_raw", bars_sql("q_week"))
relation("q_bars_whole", bars_sql("q_tape"))
relation("q_bars_clean", bars_sql("q_clean"))
relation("q_bars", "SELECT *, 'raw' AS basis FROM q_bars_whole UNION ALL SELECT *, 'clean' AS basis FROM q_bars_clean")
rule("CON.DERIVED_BAR_INVALID", """
SELECT contract_id, source_frequency AS frequency, trade_date, t0, t1, NULL::BIGINT AS record_id,
  record_count AS affected_rows, source AS subject, if(source = 'vendor', 'warning', 'critical') AS severity, source, close
FROM q_bars_raw
WHERE high < low OR coalesce(open NOT BETWEEN low AND high, FALSE) OR coalesce(close NOT BETWEEN low AND high, FALSE)""")
relation("q_marks", """
SELECT contract_id, trade_date,
  list({c: close, g: abs(hour(tx) * 3600 + minute(tx) * 60 + second(tx) - 54000) / 60.0}
    ORDER BY abs(hour(tx) * 3600 + minute(tx) * 60 + second(tx) - 54000), tu, source_row)[1] AS near
FROM q_week WHERE frequency = 'minute' AND close IS NOT NULL GROUP BY ALL""")
relation("q_vendor", """
SELECT * FROM q_week WHERE frequency = 'daily'
QUALIFY row_number() OVER (PARTITION BY contract_id, trade_date ORDER BY source_row) = 1""")
relation("q_frame", """
SELECT coalesce(m.contract_id, v.contract_id) AS contract_id, coalesce(m.trade_date, v.trade_date) AS trade_date,
  r.root, tick, m.open AS mo, m.high AS mh, m.low AS ml, m.close AS mc, m.volume AS mv, m.record_count AS mn,
  m.t0, m.t1, if(v.record_id IS NULL, NULL, 1) AS vn, v.record_id AS v_id, v.open AS vo, v.high AS vh, v.low AS vl,
  v.close AS vc, v.volume AS vv, v.tu AS v_tu, c.slots AS slots, m.record_count / nullif(c.slots, 0) AS cov,
  m.contract_id IS NOT NULL AS has_m, v.contract_id IS NOT NULL AS has_d,
  coalesce(m.trade_date, v.trade_date) BETWEEN w.lo AND w.hi AS inw, near.c AS mark_close, near.g AS mark_gap
FROM (SELECT * FROM q_bars_raw WHERE source = 'derived') m
FULL JOIN q_vendor v ON v.contract_id = m.contract_id AND v.trade_date = m.trade_date
JOIN q_roots r ON r.contract_id = coalesce(m.contract_id, v.contract_id)
JOIN (SELECT contract_id, max(start_date) AS lo, min(end_date) AS hi FROM q_win GROUP BY 1) w
  ON w.contract_id = coalesce(m.contract_id, v.contract_id)
LEFT JOIN q_wcal c ON c.root = r.root AND c.trade_date = coalesce(m.trade_date, v.trade_date)
LEFT JOIN q_marks k ON k.contract_id = m.contract_id AND k.trade_date = m.trade_date""")
relation("q_both", "SELECT * FROM q_frame WHERE has_m AND has_d AND inw")
relation("q_closes", """
SELECT *, coalesce(mark_gap <= 60, FALSE) AS resolved, abs(vc - mark_close) < abs(vc - mc) AS signature
FROM q_both WHERE mc IS NOT NULL AND vc IS NOT NULL""")
_sess = "contract_id, trade_date, t0, t1, NULL::BIGINT AS record_id, 1 AS affected_rows"
_cov = OVERRIDES["REC.OHLC_DISAGREE"]["min_coverage_pct"]
rule("REC.OHLC_DISAGREE", f"""
SELECT {_sess}, 'daily' AS frequency, 'minute' AS compare_frequency, field AS subject, field,
  round(v - m, 12) AS difference, round(round(v - m, 12) / t, 6) AS difference_ticks,
  if(t IS NULL, 'exact', '0.0 tick(s)') AS comparison
FROM (
  SELECT contract_id, trade_date, t0, t1, u.field AS field, u.v AS v, u.m AS m, tick AS t
  FROM q_both, unnest([{{field: 'open', v: vo, m: mo}}, {{field: 'high', v: vh, m: mh}}, {{field: 'low', v: vl, m: ml}}]) w(u)
  WHERE cov >= {_cov}
  UNION ALL BY NAME
  SELECT contract_id, trade_date, t0, t1, 'close' AS field, vc AS v, mc AS m, NULL::DOUBLE AS t FROM q_closes
  WHERE cov >= {_cov} AND resolved AND NOT signature)
WHERE abs(v - m) > 0""")
rule("REC.VOLUME_SHORTFALL", f"""
SELECT {_sess}, 'minute' AS frequency, 'daily' AS compare_frequency, '' AS subject, 'volume' AS field,
  mv / vv AS ratio, vv - mv AS shortfall
FROM q_both WHERE vv > 0 AND mv < vv * 0.9""")
rule("REC.CLOSE_CONVENTION", f"""
SELECT {_sess}, 'daily' AS frequency, 'minute' AS compare_frequency, '' AS subject, 'close' AS field,
  NULL::DOUBLE AS close_gap_ticks, mark_close AS close_at_mark, mark_gap AS mark_gap_minutes
FROM q_closes WHERE resolved AND signature AND vc <> mc""")
rule("REC.SESSION_ONLY_IN_ONE", """
SELECT f.contract_id, trade_date, if(has_m, t0, v_tu) AS t0, if(has_m, t1, v_tu) AS t1, NULL::BIGINT AS record_id,
  1 AS affected_rows, if(has_m, 'minute', 'daily') AS frequency, if(has_m, 'daily', 'minute') AS compare_frequency,
  '' AS subject, if(has_m, 'warning', 'info') AS severity, if(has_m, mn, vn) AS records
FROM q_frame f JOIN (SELECT * FROM q_win WHERE frequency = 'minute') w ON w.contract_id = f.contract_id
WHERE inw AND has_m <> has_d AND (has_m OR (trade_date BETWEEN start_date AND end_date
  AND NOT coalesce(trade_date BETWEEN roll_start AND roll_end, FALSE)))""")

IDENT = ("sha1(rule_id || '|' || coalesce(contract_id, '') || '|' || coalesce(frequency, '') || '|' || "
         "coalesce(CAST(trade_date AS VARCHAR), '') || '|' || coalesce(CAST(CAST(epoch(t0) AS BIGINT) AS VARCHAR), '') "
         "|| '|' || coalesce(CAST(record_id AS VARCHAR), '') || '|' || subject)")
_KEEP = ("rule_id, severity, contract_id, frequency, trade_date, t0, t1, CAST(record_id AS BIGINT) AS record_id, "
         "CAST(affected_rows AS BIGINT) AS affected_rows, subject")
_EXTRA = {
    "REC.OHLC_DISAGREE": "compare_frequency, field, difference, difference_ticks",
    "REC.CLOSE_CONVENTION": "compare_frequency, field, close_gap_ticks, close_at_mark",
    "REC.VOLUME_SHORTFALL": "compare_frequency, field",
    "REC.SESSION_ONLY_IN_ONE": "compare_frequency",
    "UNQ.EXACT_DUPLICATE": "keeps_record_id",
    "CMP.MISSING_TIMESTAMP": "missing_slots",
}
_dims = ", ".join(f"('{r.rule_id}', '{r.dimension}', '{r.severity}', '{r.scope}', '{r.name}')" for r in RULES)
relation("q_rules", f"SELECT * FROM (VALUES {_dims}) v(rule_id, dimension, declared, scope, label)")
relation("q_found", "SELECT *, " + IDENT + " AS finding_id FROM (\n" + "\nUNION ALL BY NAME\n".join(
    f"SELECT {_KEEP}" + (", field" if r in FIND and re.search(r"AS field\b", FIND[r]) and r not in _EXTRA else "")
    + (f", {_EXTRA[r]}" if r in _EXTRA else "") + f" FROM {slug(r)}" for r in FIND) + ")")
relation("q_f", """
SELECT f.*, dimension, declared, scope, label, CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3
  WHEN 'warning' THEN 2 ELSE 1 END AS sev_rank, severity <> 'info' AS is_defect
FROM q_found f JOIN q_rules USING (rule_id)""")
relation("q_actions", """
SELECT DISTINCT record_id, rule_id, if(rule_id = 'UNQ.EXACT_DUPLICATE', 'dedupe_drop', 'exclude') AS action, severity
FROM q_f WHERE record_id IS NOT NULL AND (rule_id = 'UNQ.EXACT_DUPLICATE'
  OR (severity IN ('error', 'critical') AND rule_id <> 'VAL.OFF_TICK_PRICE'))""")
relation("q_clean", "SELECT * FROM q_tape WHERE record_id NOT IN (SELECT record_id FROM q_actions)")
_fields = ", ".join(f"('{r}', '{f}')" for r, f in SUBJECT_FIELD.items())
relation("q_subject", f"SELECT * FROM (VALUES {_fields}) v(rule_id, accused)")
_fams = ", ".join(f"('{r}', '{f}')" for f, rs in FAMILY_RULES.items() for r in rs)
relation("q_family", f"SELECT * FROM (VALUES {_fams}) v(rule_id, family)")
