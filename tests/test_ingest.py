from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.sources import inference, ingest, inject, landing, purge, readers, sinks
from tapewright.plans.assess import run_rules

from .helpers import MINUTE, records, scope, text_frame

BROKEN_FILE = """contract,timestamp,open,high,low,close,volume
CLM26,2026-03-10 10:30:00,71.42,71.58,71.31,71.47,240
CLM26,noon,71.47,71.60,71.40,71.52,31
CLM26,2026-03-10 10:32:00,71.52,n.a.,71.45,71.50,18
CLM26,2026-03-10 10:33:00,71.50,71.55,71.41,71.44,few
,2026-03-10 10:34:00,71.44,71.49,71.38,71.40,52
end of page
CLM26,2026-03-10 10:36:00,71.40,,71.33,71.36,33.5
CLM26,2026-03-10 10:37:00,71.36,71.39,71.30,71.35,-4,late
"""


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "broken.csv"
    path.write_text(BROKEN_FILE)
    lines = readers.read_csv_text(spark, str(path))
    return ingest.to_targets(lines, ingest.resolve_columns(lines.columns))


def test_rejects_name_the_first_reason_and_keep_the_row(broken):
    rows = ingest.route_rejects(broken, F.lit("b")).orderBy("source_row").collect()
    assert [(r["source_row"], r["reason_code"]) for r in rows] == [
        (2, "STR.BAD_TIMESTAMP"), (3, "STR.NON_NUMERIC_PRICE"), (4, "STR.NON_NUMERIC_VOLUME"),
        (5, "STR.UNPARSEABLE_ROW"), (6, "STR.UNPARSEABLE_ROW"), (8, "STR.UNPARSEABLE_ROW")]
    assert rows[0]["reason_detail"] == "timestamp noon does not parse"
    assert rows[4]["raw_payload"] == "end of page"
    assert '"volume":"few"' in rows[2]["raw_payload"]


def test_records_keep_nulls_and_the_fraction(broken):
    rows = ingest.type_records(broken, F.lit("b"), "minute").orderBy("source_row").collect()
    assert [r["source_row"] for r in rows] == [1, 7]
    assert (rows[1]["high"], rows[1]["volume"], rows[1]["volume_source"]) == (None, 34, "33.5")
    assert rows[0]["volume_source"] is None and rows[0]["ts_source"] == "2026-03-10 10:30:00"
    assert rows[0]["ts_utc"] == dt.datetime(2026, 3, 10, 15, 30)


@pytest.mark.parametrize("text,volume", [("9.5", 10), ("10.5", 11), ("-10.5", -11), ("7", 7), ("", None), ("1e3", 1000)])
def test_fractions_round_away_from_zero(spark, text, volume):
    row = records(spark, f"ESZ25,2025-09-15 09:00:00,1,1,1,1,{text}").collect()[0]
    assert row["volume"] == volume


@pytest.mark.parametrize("cell,reason", [
    ("ESZ25,2025,1,1,1,1,1", "STR.BAD_TIMESTAMP"), ("ESZ25,2025-09-15 09:00:00,1,1,1,1,1e30", "STR.NON_NUMERIC_VOLUME"),
    ("ESZ25,2025-09-15 09:00:00,,,,,", None), ("ESZ25,2025-09-15T09:00,1,1,1,1,1", None)])
def test_what_parses(spark, cell, reason):
    df = text_frame(spark, cell, MINUTE, "f")
    rows = ingest.route_rejects(ingest.to_targets(df, ingest.resolve_columns(df.columns)), F.lit("b")).collect()
    assert [r["reason_code"] for r in rows] == ([reason] if reason else [])


def test_type_suffixes_are_no_numbers(spark):
    """A trailing f or d, which a Java parser takes for a type, is not part of a number."""
    for name, value, reason in [("close", "12.5f", "STR.NON_NUMERIC_PRICE"), ("open", "1d", "STR.NON_NUMERIC_PRICE"),
                                ("volume", "5f", "STR.NON_NUMERIC_VOLUME"), ("close", "1.25e3", None), ("close", ".5", None)]:
        cells = {"contract": "ESZ25", "timestamp": "2025-09-15 09:00:00", "open": "1", "high": "1", "low": "1", "close": "1",
                 "volume": "1"} | {name: value}
        df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells)).withColumn(
            "source_row", F.lit(1)).withColumn(readers.BROKEN, F.lit(None).cast("string")).withColumn("source_file", F.lit("f"))
        rows = ingest.to_targets(df, ingest.resolve_columns(df.columns))
        assert [r["reason_code"] for r in ingest.route_rejects(rows, F.lit("b")).collect()] == ([reason] if reason else []), value


def test_batch_summary(spark, broken):
    batches = spark.createDataFrame([("b", "running")], "batch_id string, status string")
    row = ingest.batch_summary(ingest.type_records(broken, F.lit("b"), "minute"),
                               ingest.route_rejects(broken, F.lit("b")), batches).collect()[0]
    assert (row["rows_read"], row["rows_accepted"], row["rows_rejected"], row["status"]) == (8, 2, 6, "partial")
    assert row["reasons"][-1] == "STR.UNPARSEABLE_ROW=3" and row["sessions"] == 1


def test_layouts():
    vendor = ingest.resolve_columns(["root_id", "exchange", "root", "contract_symbol", "timestamp_ms",
                                     "timestamp_chicago_wall", "trading_date", "minute_of_day", "open", "high", "low",
                                     "close", "volume"])
    assert vendor.profile == "vendor_minute" and vendor.source_of("ts") == "timestamp_chicago_wall"
    assert vendor.declined == ["root_id", "exchange", "root", "trading_date", "minute_of_day"]
    by_name = ingest.resolve_columns(["Symbol", "DateTime", "Open", "High", "Low", "Close", "OI"])
    assert by_name.profile is None and by_name.source_of("open_interest") == "OI"
    with pytest.raises(ingest.MissingColumns):
        ingest.resolve_columns(["symbol", "open", "high", "low"])


def test_source_rows_across_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    lines = [f"ESZ25,2025-09-15 09:00:00,{i},{i},{i},{i},{i}" if i % 97 else "short" for i in range(1, 4001)]
    path.write_text("contract,timestamp,open,high,low,close,volume\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = readers.read_csv_text(spark, str(path))
        assert df.select(F.spark_partition_id()).distinct().count() > 3
        rows = df.select("source_row", "open", readers.BROKEN).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["source_row"] for r in rows) == list(range(1, 4001))
    assert all((r[readers.BROKEN] == "short") if r["source_row"] % 97 == 0 else int(r["open"]) == r["source_row"] for r in rows)


def test_csv_reload_equals_parquet(spark, tmp_path):
    tape = records(spark, "ESZ25,2025-11-02 17:30:00,6600.25,6601.5,6599.125,6600.1,10\nESZ25,2025-11-03 00:00:00,1,2,0.5,,0")
    out = tape.select(F.col("contract_id").alias("contract"), F.col("ts_exchange").alias("timestamp"), "open", "high", "low",
                      "close", "volume")
    sinks.tape_to_csv(out, str(tmp_path / "csv"))
    out.write.parquet(str(tmp_path / "pq"))

    def load(df):
        rows = ingest.to_targets(df, ingest.resolve_columns(df.columns))
        return ingest.type_records(rows, F.lit("b"), "minute").select(
            "ts_exchange", "ts_utc", "trade_date", "open", "high", "low", "close", "volume").orderBy("ts_utc").collect()

    a = load(readers.read_csv_text(spark, str(tmp_path / "csv")))
    assert a == load(readers.read_parquet_text(spark, str(tmp_path / "pq"))) and len(a) == 2


def test_interval_and_zone(spark):
    def stamps(texts):
        return spark.createDataFrame([("ESZ25", t) for t in texts], "contract_id string, t string").select(
            "contract_id", F.col("t").cast("timestamp_ntz").alias("ts"))

    minute = inference.infer_interval(stamps([f"2025-09-15 09:{m:02d}:00" for m in (0, 1, 2, 4, 5)])).collect()[0]
    assert (minute["label"], minute["confidence"], minute["modal_share"]) == ("1 minute", 1.0, 0.75)
    mixed = inference.infer_interval(stamps(["2025-09-15 09:00:00", "2025-09-15 09:01:00", "2025-09-15 09:02:00",
                                             "2025-09-15 09:02:30"])).collect()[0]
    assert (mixed["label"], mixed["confidence"], mixed["off_grid"]) == ("1 minute", 0.5, 1)
    odd = inference.infer_interval(stamps(["2025-09-15 09:00:00", "2025-09-15 09:00:07"])).collect()[0]
    assert (odd["label"], odd["confidence"], odd["frequency"]) == ("7 seconds", 0.2, "minute")
    single = inference.infer_interval(stamps(["2025-09-15 00:00:00"])).collect()[0]
    assert (single["label"], single["frequency"], single["confidence"]) == ("1 day", "daily", 0.3)
    day = stamps([f"2025-09-15 {h:02d}:00:00" for h in range(24) if h != 16])
    assert inference.infer_timezone(day, "minute").collect()[0]["confidence"] == 0.9


def test_landing_refuses_known_and_repeated_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.parquet").write_text("not parquet")
    (tmp_path / "d.csv").write_text("x\n9\n")
    held = spark.createDataFrame([("d" * 64,)], "file_hash string")
    rows = {r["filename"]: r for r in landing.landing_check(spark, str(tmp_path), held).collect()}
    assert not rows["a.csv"]["duplicate"] and rows["b.csv"]["duplicate"]
    assert rows["c.parquet"]["file_format"] == "refused" and rows["d.csv"]["file_format"] == "csv"
    again = landing.landing_check(spark, str(tmp_path), spark.createDataFrame([(rows["d.csv"]["file_hash"],)], "file_hash string"))
    assert {r["filename"] for r in again.collect() if r["already_ingested"]} == {"d.csv"}
    manifest = spark.createDataFrame([("a.csv", rows["a.csv"]["file_hash"]), ("d.csv", "0")], "name string, sha256 string")
    assert [r["name"] for r in landing.verify_checksums(spark, str(tmp_path), manifest).collect()] == ["d.csv"]


@pytest.mark.parametrize("n", [40, 60])
def test_injected_defects_are_found_where_the_manifest_says(spark, n):
    lines = [f"ESZ25,2025-09-15 {9 + i // 60:02d}:{i % 60:02d}:00,{6600 + i % 7},{6603 + i % 7},{6597 + i % 7},{6601 + i % 7},{100 + i % 9}"
             for i in range(n)]
    tape = records(spark, "\n".join(lines))
    defective, manifest = inject.inject_defects(tape, seed=11)
    again, same = inject.inject_defects(tape, seed=11)
    planted = manifest.collect()
    assert sorted(map(tuple, planted)) == sorted(map(tuple, same.collect())) and len(planted) == 9
    rows = defective.collect()
    assert sorted(r["source_row"] for r in rows) == list(range(1, n + 2 - 5 + 1))
    fresh = defective.withColumn("record_id", F.col("source_row"))
    found, _ = run_rules(scope(spark, fresh), sorted({p["rule_id"] for p in planted}))
    hits = {(f["rule_id"], f["record_id"]) for f in found.filter("record_id is not null").collect()}
    for p in planted:
        if p["rule_id"] != "CMP.MISSING_TIMESTAMP":
            assert (p["rule_id"], p["source_row"]) in hits, p
    gaps = found.filter("rule_id = 'CMP.MISSING_TIMESTAMP'").collect()
    assert 5 in {g["affected_rows"] for g in gaps}


def test_a_defect_no_row_can_carry_is_named(spark):
    quiet = records(spark, "\n".join(f"ESZ25,2025-09-15 09:{i:02d}:00,6600,6603,6597,6601,0" for i in range(50)))
    with pytest.raises(inject.NoSite, match="negate_volume"):
        inject.inject_defects(quiet)
    _, manifest = inject.inject_defects(quiet, rules=["CON.HIGH_LT_LOW", "CMP.NULL_FIELD"])
    assert {r["kind"] for r in manifest.collect()} == {"swap_high_and_low", "blank_close"}
    with pytest.raises(ValueError, match="at least"):
        inject.inject_defects(quiet.filter("source_row < 40"))


def test_ids_are_unique_over_files(spark, tmp_path):
    head = "contract,timestamp,open,high,low,close,volume\n"
    for name, count in (("a", 3), ("b", 2), ("c", 1)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"CLM26,2026-03-10 10:3{i}:00,1,1,1,1,{i}\n" for i in range(count)))
    lines = readers.read_csv_text(spark, str(tmp_path))
    rows = ingest.to_targets(lines, ingest.resolve_columns(lines.columns))
    got = ingest.type_records(rows, F.lit("b"), "minute", first_id=100).select("record_id", "source_row").orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [(101, 1), (102, 2), (103, 3), (104, 1), (105, 2), (106, 1)]
    bare = ingest.type_records(rows.drop(readers.BASE), F.lit("b"), "minute")
    assert bare.select("record_id").distinct().count() == 6


def test_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("contract,timestamp,open,high,low,close,volume\nCLM26,2026-03-10 10:30:00,1,4,1,2,3\n")
    (tmp_path / "b.csv").write_text("contract,timestamp,close,high,low,open,volume\nCLM26,2026-03-10 10:31:00,1,4,1,2,3\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_csv_text(spark, str(tmp_path)).collect()


def test_purge_takes_only_its_own(spark):
    a = records(spark, "ESZ25,2025-09-15 09:00:00,1,1,1,1,1", batch="b1")
    b = records(spark, "ESZ25,2025-09-15 09:01:00,1,1,1,1,1", batch="b2")
    tape = a.unionByName(b)
    ids = {r["batch_id"]: r["record_id"] for r in tape.collect()}
    findings = spark.createDataFrame([("r0", ids["b1"]), ("r0", ids["b2"]), ("r0", None), ("r1", None)], "run_id string, record_id bigint")
    bars = spark.createDataFrame([("ESZ25", "2025-09-15", "minute"), ("ESZ25", "2025-09-15", "daily")],
                                 "contract_id string, d string, source_frequency string").select(
        "contract_id", F.to_date("d").alias("trade_date"), "source_frequency")
    store = purge.Store(tape, spark.createDataFrame([("b1", 1)], "batch_id string, source_row bigint"), findings, bars,
                        spark.createDataFrame([("b1", "succeeded"), ("b2", "succeeded")], "batch_id string, status string"),
                        spark.createDataFrame([("r0", None), ("r1", "b1")], "run_id string, batch_id string"))
    left, counts = purge.purge_batch(store, "b1")
    row = counts.collect()[0]
    assert tuple(row) == (1, 1, 2, 1, 1)
    assert left.records.count() == 1 and left.bars.count() == 1 and left.findings.count() == 2
    assert {(r["batch_id"], r["status"]) for r in left.batches.collect()} == {("b1", "purged"), ("b2", "succeeded")}
    with pytest.raises(purge.BatchAlreadyPurged):
        purge.purge_batch(left, "b1")
    with pytest.raises(purge.BatchNotFound):
        purge.purge_batch(left, "b9")


def test_replacing_write_replaces_its_scope_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 12), ("c d", 1, 13), (None, 1, 14)], "k string, d int, v int")

    def write(frame, scope):
        sinks.write_replacing(frame, path, ["k"], scope)
        return sorted((str(r["k"]), r["d"], r["v"]) for r in spark.read.parquet(path).collect())

    whole = sorted((str(k), d, v) for k, d, v in df.collect())
    assert write(df, df.select("k")) == whole == write(df, df.select("k"))
    one = df.filter("k = 'a' and d = 2").withColumn("v", F.lit(99))
    assert write(one, one.select("k", "d")) == sorted([*(r for r in whole if r != ("a", 2, 11)), ("a", 2, 99)])
    left = write(df.limit(0), df.filter("k in ('b', 'c d') or k is null").select("k"))
    assert left == [("a", 1, 10), ("a", 2, 99)]
    assert write(df.limit(0), df.select("d").filter("d = 2").distinct()) == [("a", 1, 10)]
    with pytest.raises(ValueError):
        write(df, df.filter("k = 'a'").select("k"))


class TestLoad:
    """One call from files to records, rejects and a batch row."""

    def test_two_layouts_in_one_folder(self, spark, tmp_path):
        from tapewright.plans.load import load_csv

        (tmp_path / "a.csv").write_text("contract,timestamp,open,high,low,close,volume\nESZ25,2025-09-15 09:00:00,1,2,0.5,1.5,10\n"
                                        "ESZ25,never,1,2,0.5,1.5,10\nshort,row\nESZ25,2025-09-15 09:01:00,1,2,0.5,x,10\n")
        (tmp_path / "b.csv").write_text("close,low,high,open,volume,symbol,datetime\r\n7,5,9,6,3.5,ZCZ25,2025-09-15 10:00:00\r\n")
        loaded = load_csv(spark, str(tmp_path), "b7", "minute", ingested_at="2025-10-01", first_id=100)
        rows = {r.contract_id: r for r in loaded.records.collect()}
        assert (rows["ESZ25"].open, rows["ESZ25"].close, rows["ESZ25"].source_row) == (1.0, 1.5, 1)
        assert (rows["ZCZ25"].open, rows["ZCZ25"].high, rows["ZCZ25"].close, rows["ZCZ25"].volume, rows["ZCZ25"].volume_source) == (6.0, 9.0, 7.0, 4, "3.5")
        assert sorted(r.record_id for r in rows.values()) == [101, 105]
        assert sorted((r.source_row, r.reason_code) for r in loaded.rejects.collect()) == [
            (2, "STR.BAD_TIMESTAMP"), (3, "STR.UNPARSEABLE_ROW"), (4, "STR.NON_NUMERIC_PRICE")]
        batch = loaded.batch.first()
        assert (batch.rows_read, batch.rows_accepted, batch.rows_rejected, batch.status) == (5, 2, 3, "partial") and len(loaded.layouts) == 2

    def test_equals_the_single_steps(self, spark, tmp_path):
        from tapewright.plans.load import load_csv

        lines = [f"ESZ25,2025-09-15 {9 + i // 60:02d}:{i % 60:02d}:00,1,2,0.5,{'x' if i % 7 == 0 else 1 + i},{i}" for i in range(200)]
        for k in range(3):
            (tmp_path / f"f{k}.csv").write_text("contract,timestamp,open,high,low,close,volume\n" + "\n".join(lines[k * 60:k * 60 + 60 + k]) + "\n")
        loaded = load_csv(spark, str(tmp_path), "b1", "minute", ingested_at="2025-10-01")
        text = readers.read_csv_text(spark, str(tmp_path))
        rows = ingest.to_targets(text, ingest.resolve_columns(text.columns))
        stamp = F.lit("2025-10-01").cast("timestamp")
        plain = ingest.type_records(rows, F.lit("b1"), "minute", ingested_at=stamp)
        assert sorted(map(str, loaded.records.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        bad = ingest.route_rejects(rows, F.lit("b1"))
        assert sorted(map(str, loaded.rejects.select(*bad.columns).collect())) == sorted(map(str, bad.collect()))

    def test_own_profile_and_refusals(self, spark, tmp_path):
        from tapewright.plans.load import load_csv

        (tmp_path / "a.csv").write_text("sym;when\n".replace(";", ",") + "ESZ25,2025-09-15\n")
        with pytest.raises(ingest.MissingColumns):
            load_csv(spark, str(tmp_path), "b", "daily")
        mine = {"own": {"needs": ["sym", "when"], "columns": {"sym": "contract_id", "when": "ts"}, "session_boundary": "own"}}
        loaded = load_csv(spark, str(tmp_path), "b", "daily", profiles=mine)
        assert loaded.layouts[0].profile == "own" and loaded.records.first().contract_id == "ESZ25"
        (tmp_path / "none").mkdir()
        with pytest.raises(FileNotFoundError):
            load_csv(spark, str(tmp_path / "none"), "b", "daily")
