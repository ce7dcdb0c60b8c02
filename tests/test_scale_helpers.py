"""The skew-safe forms give what the plain forms give."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import tapewright.operators.vwap as vwap_module
from tapewright.functions import series
from tapewright.functions.stats import exact_median
from tapewright.operators.vwap import vwap_15m

from .helpers import fire, records, scope


def _busy_tape(spark, n: int = 400):
    """One contract with a third of its rows on one timestamp, and another beside it."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        minute = 30 if i % 3 == 0 else rng.randrange(0, 50)
        day = 15 + (i % 2)
        rows.append((i, "ESZ25" if i % 5 else "ZCZ25", "minute", f"2025-09-{day} 14:{minute:02d}:00", float(rng.randrange(4))))
    df = spark.createDataFrame(rows, "record_id bigint, contract_id string, frequency string, ts string, close double")
    return df.withColumn("ts_utc", F.col("ts").cast("timestamp")).drop("ts")


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_lag_and_running_sum_across_chunks(spark, monkeypatch, limit):
    monkeypatch.setattr(series, "BLOCK_BITS", 4)
    df, keys, order = _busy_tape(spark), ["contract_id", "frequency"], ["ts_utc", "record_id"]
    load = df.groupBy(*keys, F.to_date("ts_utc").alias("utc_day")).agg(F.count("*").alias("records"))
    hot = series.hot_days(load, keys, limit)
    assert (hot is None) == (limit > 1000)
    chunked = series.with_chunks(df, keys, hot)
    chunked = series.with_previous(chunked, keys, order, F.struct("close"))
    chunked = series.with_running_sum(chunked, keys, order, "close", "total")
    got = {r["record_id"]: (r["prev"]["close"] if r["prev"] else None, r["total"]) for r in chunked.collect()}
    w = W.partitionBy(*keys).orderBy(*order)
    plain = df.withColumn("p", F.lag("close").over(w)).withColumn("t", F.sum("close").over(w.rowsBetween(W.unboundedPreceding, 0)))
    assert got == {r["record_id"]: (r["p"], r["t"]) for r in plain.collect()}
    if hot is not None:
        assert chunked.select(*series.CHUNK).distinct().count() > 20


def test_exact_median_matches_brute_force(spark):
    rng = random.Random(3)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "odd": [rng.gauss(5, 100) for _ in range(777)],
        "tied": [0.0] * 600 + [rng.random() for _ in range(301)],
        "two": [1.0, 2.0],
        "one": [4.0],
        "split": [0.0] * 500 + [9.0] * 500,
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, x double")
    got = {r["g"]: (r["n"], r["m"]) for r in exact_median(df, ["g"], "x", "m").collect()}
    assert got == {k: (len(v), statistics.median(v)) for k, v in groups.items()}


def test_stale_runs_survive_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(series, "HOT_DAY_ROWS", 3)
    monkeypatch.setattr(series.hot_days, "__defaults__", (3,))
    rows = "\n".join(f"ESZ25,2025-09-15 09:0{i}:00,6600,6601,6599,6600,10" for i in range(9))
    sc = scope(spark, records(spark, rows), overrides={"CON.STALE_REPEAT": {"n": 9, "n_by_root": {}}})
    assert sc.hot_days is not None
    assert [f["affected_rows"] for f in fire(sc, "CON.STALE_REPEAT")] == [9]


VWAP = """
    CLM26,2026-03-10 10:02:00,70.0,70.2,69.8,70.0,41
    CLM26,2026-03-10 10:09:00,70.5,70.7,70.3,70.5,63
    CLM26,2026-03-10 10:20:00,71.0,71.2,70.8,71.0,92
    CLM26,2026-03-10 10:24:00,71.5,71.7,71.3,71.5,0"""


def test_vwap_window_holds_the_fifteen_minute_old_row(spark):
    rows = vwap_15m(records(spark, VWAP), "raw").orderBy("ts_utc").collect()
    assert [r["window_records"] for r in rows] == [1, 2, 2, 3]
    assert [r["is_warmup"] for r in rows] == [True, True, False, False]
    assert rows[1]["vwap_15m"] == pytest.approx((70.0 * 41 + 70.5 * 63) / 104)
    assert rows[3]["vwap_15m"] == pytest.approx((70.5 * 63 + 71.0 * 92) / 155)


def test_vwap_without_volume_is_null(spark):
    rows = vwap_15m(records(spark, VWAP.replace(",41", ",0").replace(",63", ",0").replace(",92", ",0")), "raw").collect()
    assert len(rows) == 4 and {r["vwap_15m"] for r in rows} == {None} and {r["window_volume"] for r in rows} == {0}


def test_copies_on_one_timestamp_each_get_a_point(spark, monkeypatch):
    monkeypatch.setattr(vwap_module, "COPIES_PER_BLOCK", 2)
    line = "CLM26,2026-03-10 10:03:00,70.1,70.3,69.9,70.1,12"
    rows = vwap_15m(records(spark, "\n".join([line] * 7) + VWAP), "raw").collect()
    assert len(rows) == 11
    assert [r["window_records"] for r in rows if r["ts_utc"].minute == 3] == [8] * 7
