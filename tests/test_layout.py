"""One layout for neighbour rules, hash-aggregated edges, ranges of ranks, bounded medians, blocks and spans, against brute force."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import tapewright.functions.stats as stats
import tapewright.operators.cleaning as cleaning
import tapewright.operators.gate as gate
import tapewright.operators.vwap as vwap_module
from tapewright.catalogue import RULES_BY_ID
from tapewright.functions import order, series
from tapewright.operators.bars import build_bars
from tapewright.operators.expected import absent_days
from tapewright.operators.gate import disjoint
from tapewright.operators.reconcile import session_frame
from tapewright.operators.scope import build_scope
from tapewright.operators.scoring import daily_metrics, dimension_scores, worklist
from tapewright.operators.series_rules import SERIES_RULES
from tapewright.operators.session_rules import missing_timestamp
from tapewright.operators.vwap import vwap_15m
from tapewright.plans.assess import run_rules
from tapewright.session import settle
from tapewright.sources import landing, sinks
from tapewright.sources.reference import contracts_from_symbols, product_dim, tick_dim

from .helpers import fire, minutes, records, scope, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


class TestOrder:
    def test_keys_sort_like_structs(self, spark):
        rng = random.Random(2)
        day = dt.datetime(2025, 9, 15, tzinfo=dt.timezone.utc)
        rows = [(i, day + dt.timedelta(microseconds=rng.choice([-1, 0, 3, 86_400_000_000, -10**11])), rng.choice([None, 0, 7, 9 * 10**9]), day.date()) for i in range(200)]
        df = spark.createDataFrame(rows, "record_id bigint, ts_utc timestamp, source_row bigint, trade_date date")
        keyed = df.withColumn("key", order.in_session())
        by_key = [r.record_id for r in keyed.orderBy("key").collect()]
        by_struct = [r.record_id for r in df.orderBy(F.struct("ts_utc", F.coalesce("source_row", F.lit(0)), "record_id")).collect()]
        assert by_key == by_struct

    def test_what_does_not_fit_is_an_error(self, spark):
        df = spark.createDataFrame([(10**14, 1)], "record_id bigint, source_row bigint")
        with pytest.raises(Exception, match="does not fit"):
            df.select(order.packed((F.col("source_row"), 3), (F.col("record_id"), 14))).collect()
        with pytest.raises(ValueError):
            order.packed((F.col("a"), 20), (F.col("b"), 19))


def odd_tape(spark):
    """Two contracts on two days with copies, conflicting keys, repeats, nulls and rows out of order, two batches."""
    rng = random.Random(5)
    lines = []
    for contract in ("ESZ25", "ZCZ25"):
        close = 100.0
        for day in (15, 16):
            for minute in range(40):
                close = close if rng.random() < 0.5 else close + rng.choice([-2, 1, 30])
                line = f"{contract},2025-09-{day} {9 + minute // 30:02d}:{minute % 30:02d}:00,{close},{close + 1},{close - 1},{close if rng.random() < 0.95 else ''},{rng.choice([10, 10, 0])}"
                lines += [line] * rng.choice([1, 1, 1, 2, 3])
                if rng.random() < 0.1:
                    lines.append(f"{contract},2025-09-{day} {9 + minute // 30:02d}:{minute % 30:02d}:00,{close},{close + 2},{close - 1},{close},7")
    rng.shuffle(lines)
    half = len(lines) // 2
    return records(spark, "\n".join(lines[:half])).unionByName(records(spark, "\n".join(lines[half:]), batch="b2"))


class TestLayout:
    def by_hand(self, tape):
        rows = [r.asDict() for r in tape.collect()]
        series_of, out = defaultdict(list), defaultdict(set)
        for r in rows:
            series_of[r["contract_id"], r["frequency"]].append(r)
        values = lambda r: tuple(r[c] for c in ("open", "high", "low", "close", "volume", "open_interest"))
        for own in series_of.values():
            own.sort(key=lambda r: (r["ts_utc"], r["record_id"]))
            same, keys = defaultdict(list), defaultdict(set)
            for r in own:
                same[r["ts_utc"], values(r)].append((r["source_row"], r["record_id"]))
                keys[r["ts_utc"]].add(values(r))
            for copies in same.values():
                keeper = min(copies)[1]
                out["UNQ.EXACT_DUPLICATE"] |= {(i, len(copies), keeper) for _, i in copies if i != keeper and len(copies) > 1}
            out["UNQ.KEY_CONFLICT"] |= {(r["record_id"], len(keys[r["ts_utc"]])) for r in own if len(keys[r["ts_utc"]]) > 1}
            last = None
            for r in own:
                if r["close"] is not None and r["close"] > 0:
                    if last and abs(math.log(r["close"] / last)) > 0.05:
                        out["CON.PRICE_JUMP"].add((r["record_id"], last))
                    last = r["close"]
            run = []
            for a, b in zip([None, *own], [*own, None], strict=False):
                prices = ("open", "high", "low", "close")
                if b and a and all(a[c] == b[c] for c in prices) and b["open"] is not None and b["volume"] and a["volume"]:
                    run.append(b)
                    continue
                if len(run) >= 3:
                    out["CON.STALE_REPEAT"].add((run[0]["ts_utc"], run[-1]["ts_utc"], len(run), min(r["record_id"] for r in run)))
                run = [b]
        return out

    @pytest.mark.parametrize("limit", [1 << 20, 6])
    def test_neighbour_rules_equal_brute_force(self, spark, monkeypatch, limit):
        monkeypatch.setattr(series.hot_days, "__defaults__", (limit,))
        monkeypatch.setattr(series, "BLOCK_BITS", 2)
        tape = settle(odd_tape(spark), "odd")
        sc = scope(spark, tape, overrides={
            "CON.STALE_REPEAT": {"n": 3, "n_by_root": {}}, "CON.PRICE_JUMP": {"threshold": {"minute": 0.05}}})
        assert (sc.hot_days is None) == (limit > 1000)
        want = self.by_hand(tape)
        dup = {(f["record_id"], f["details"]["copies"], f["details"]["keeps_record_id"]) for f in fire(sc, "UNQ.EXACT_DUPLICATE")}
        key = {(f["record_id"], f["details"]["variants"]) for f in fire(sc, "UNQ.KEY_CONFLICT")}
        jump = {(f["record_id"], f["details"]["previous_close"]) for f in fire(sc, "CON.PRICE_JUMP")}
        stale = {(f["ts_start_utc"], f["ts_end_utc"], f["affected_rows"]) for f in fire(sc, "CON.STALE_REPEAT")}
        assert dup == want["UNQ.EXACT_DUPLICATE"] and key == want["UNQ.KEY_CONFLICT"] and jump == want["CON.PRICE_JUMP"]
        assert stale == {r[:3] for r in want["CON.STALE_REPEAT"]} and min(map(len, (dup, key, jump, stale))) > 2

    def test_rules_read_the_layout_where_it_lies(self, spark):
        """Above the scan of the layout nothing but aggregates is exchanged."""
        sc = scope(spark, settle(odd_tape(spark), "odd"), overrides={"CON.STALE_REPEAT": {"n": 3, "n_by_root": {}}})
        assert sc.borders.count() > 0 and sc.layout.count() > 0
        for rule in ("UNQ.EXACT_DUPLICATE", "UNQ.KEY_CONFLICT", "CON.PRICE_JUMP"):
            text = plan(SERIES_RULES[rule](sc))
            assert "Exchange hashpartitioning" not in text, (rule, text)
        rows = plan(sc.slots)
        assert "Exchange hashpartitioning" not in rows, rows
        held = plan(missing_timestamp(sc))
        for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", held):
            assert "slot" not in exchange
        assert not re.search(r"SortAggregate", held)


class TestEdges:
    def by_hand(self, tape, gone):
        groups = defaultdict(list)
        for r in (r.asDict() for r in tape.collect()):
            for basis in ("raw", "clean"):
                if basis == "raw" or r["record_id"] not in gone:
                    groups[r["contract_id"], r["trade_date"], {"minute": "derived", "daily": "vendor"}[r["frequency"]], basis].append(r)
        out = {}
        for key, rows in groups.items():
            rows.sort(key=lambda r: (r["ts_utc"], r["source_row"], r["record_id"]))
            seen = lambda c: [r[c] for r in rows if r[c] is not None]
            out[key] = (rows[0]["open"], max(seen("high"), default=None), min(seen("low"), default=None), rows[-1]["close"],
                        sum(seen("volume")) if seen("volume") else None, len(rows), sum(r["volume"] is None for r in rows))
        return out

    def test_four_bar_sets_from_one_scan(self, spark):
        daily = "ESZ25,2025-09-15,1,9,0.5,4,100\nESZ25,2025-09-15,2,8,0.25,5,100\nZCZ25,2025-09-16,3,7,1,6,"
        tape = settle(odd_tape(spark).unionByName(records(spark, daily, "daily", "b3")), "edges")
        ids = [r.record_id for r in tape.orderBy("record_id").collect()]
        gone = set(ids[::7]) | {i for i in ids if i >= 3_000_000 and i % 2}
        actions = spark.createDataFrame([(i, "R", "exclude") for i in gone], "record_id bigint, rule_id string, action string")
        built = build_bars(tape, actions)
        text = plan(built)
        assert "SortAggregate" not in text and text.count("FileScan") == 1
        got = {(r.contract_id, r.trade_date, r.source, r.basis): (r.open, r.high, r.low, r.close, r.volume, r.record_count, r.volume_null_count)
               for r in built.collect()}
        assert got == self.by_hand(tape, gone)

    def test_session_frame_is_one_hash_aggregate(self, spark):
        daily = "ESZ25,2025-09-15,1,9,0.5,4,100\nESZ25,2025-09-15,2,8,0.25,5,100"
        sc = scope(spark, settle(odd_tape(spark).unionByName(records(spark, daily, "daily", "b3")), "frame"))
        assert sc.windows.count() and sc.calendar.count()
        text = plan(session_frame(sc))
        assert "SortAggregate" not in text
        row = session_frame(sc).filter("contract_id = 'ESZ25' and trade_date = '2025-09-15'").first()
        assert (row.vendor_open, row.vendor_rows, row.has_minute, row.has_daily) == (1.0, 2, True, True)


class TestExpected:
    @pytest.mark.parametrize("seed", range(3))
    def test_absent_days_equal_a_walk_over_the_calendar(self, spark, seed):
        rng = random.Random(seed)
        days = [dt.date(2025, 8, 25) + dt.timedelta(days=i) for i in range(60)]
        lines = []
        for contract in ("ESZ25", "ZCZ25"):
            for day in days:
                if day.weekday() < 5 and rng.random() < 0.6:
                    lines.append(f"{contract},{day},1,2,0.5,1,{rng.choice([0, 500, 5])}")
        sc = scope(spark, settle(records(spark, "\n".join(lines), "daily"), "absent"),
                   overrides={"ROL.THIN_NEAR_EXPIRY": {"days": 12, "collapse_ratio": 9.0}})
        calendar = {(r.root, r.trade_date) for r in sc.calendar.filter("not is_holiday").collect()}
        held = {(r.contract_id, r.frequency, r.trade_date) for r in sc.sessions.collect()}
        roots = {(r.contract_id, r.frequency): r.root for r in sc.sessions.collect()}
        want, total = set(), Counter()
        for w in sc.windows.collect():
            for root, day in calendar:
                rolling = w.roll_start is not None and w.roll_start <= day <= w.roll_end
                if root == roots[w.contract_id, w.frequency] and w.start_date <= day <= w.end_date and not rolling:
                    total[w.contract_id, w.frequency] += 1
                    if (w.contract_id, w.frequency, day) not in held:
                        want.add((w.contract_id, w.frequency, day))
        got = absent_days(sc).collect()
        assert {(r.contract_id, r.frequency, r.trade_date) for r in got} == want and len(got) == len(want) > 0
        spans = Counter()
        for r in sc.expected_spans.collect():
            spans[r.contract_id, r.frequency] += r.expected
        assert spans == total
        assert "BroadcastNestedLoop" not in plan(absent_days(sc)) and "Cartesian" not in plan(absent_days(sc))


class TestMedians:
    def test_images_keep_the_order_of_doubles(self, spark):
        rng = random.Random(1)
        tiny = 5e-324
        values = [0.0, -0.0, tiny, -tiny, 2.0**-1022, 2.0**-1022 - tiny, 1.0, 1.0 - 2**-53, 1.0 + 2**-52, 1.7976931348623157e308, -1.7976931348623157e308, 2.0, 0.5]
        values += [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-1070, 1020) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)]
        values += [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 13)] + [math.nextafter(2.0**k, math.inf) for k in range(-1000, 1020, 13)]
        rows = stats.with_image(spark.createDataFrame([(v,) for v in values], "v double"), "v", "i").collect()
        rows.sort(key=lambda r: r.v)
        for a, b in zip(rows, rows[1:], strict=False):
            assert (a.i < b.i) if a.v < b.v else (a.i == b.i)

    @pytest.mark.parametrize(("parts", "most"), [(16, 8), (4096, 1 << 16)])
    def test_clumped_values(self, spark, monkeypatch, parts, most):
        monkeypatch.setattr(stats, "BUCKETS", parts)
        monkeypatch.setattr(stats, "MOST", most)
        rng = random.Random(4)
        groups = {
            "clump": [1.0 + k * 2**-52 for k in range(900)] + [5.0, -7.0],
            "spike": [0.25] * 700 + [rng.random() for _ in range(300)],
            "split": [1.0] * 400 + [1e300] * 400,
            "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(777)],
            "near zero": [k * 5e-324 for k in range(-50, 60)],
            "one": [3.0], "two": [3.0, 4.0],
        }
        df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, x double")
        got = {r.g: (r.n, r.m) for r in stats.exact_median(df, ["g"], "x", "m").collect()}
        assert got == {k: (len(v), statistics.median(v)) for k, v in groups.items()}

    def test_nothing_but_small_ranges_is_ordered(self, spark, monkeypatch):
        """However the values clump, the last range holds few of them, in at most six cuts."""
        monkeypatch.setattr(stats, "BUCKETS", 4096)
        monkeypatch.setattr(stats, "MOST", 100)
        df = spark.range(20_000).select(F.lit("g").alias("g"), (F.lit(1.0) + F.col("id") * 2.0**-52).alias("x"))
        cuts, widest = [], []
        plain, narrowed = stats.settle, stats._narrowed

        def count(rows, keys, state, per_group):
            out = narrowed(rows, keys, state, per_group)
            cuts.append(1)
            widest.append(out.agg(F.max("held")).first()[0])
            return out

        monkeypatch.setattr(stats, "_narrowed", count)
        assert stats.exact_median(df, ["g"], "x", "m").first().m == 1.0 + 9999.5 * 2**-52 or plain
        assert len(cuts) <= 6 and widest[-1] <= 100

    def test_copies_are_counted_before_anything_is_cut(self, spark, monkeypatch):
        """Rows beyond the bound but few distinct values: no range is cut, and counts stand for rows."""
        monkeypatch.setattr(stats, "MOST", 100)
        monkeypatch.setattr(stats, "_narrowed", None)
        df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") % 90).cast("double").alias("x"))
        want = statistics.median(float(i % 90) for i in range(20_000))
        assert [(r.n, r.m) for r in stats.exact_median(df, ["g"], "x", "m").collect()] == [(20_000, want)]
        counted = df.groupBy("g", "x").agg(F.count("*").alias("c"))
        assert [(r.n, r.m) for r in stats.exact_median(counted, ["g"], "x", "m", count="c").collect()] == [(20_000, want)]

    def test_counts_weigh_in_cut_ranges(self, spark, monkeypatch):
        monkeypatch.setattr(stats, "BUCKETS", 16)
        monkeypatch.setattr(stats, "MOST", 4)
        counts = {float(k): 1 + (k * 7) % 5 for k in range(-30, 60)}
        df = spark.createDataFrame([("g", x, c) for x, c in counts.items()], "g string, x double, c bigint")
        rows = [x for x, c in counts.items() for _ in range(c)]
        assert [(r.n, r.m) for r in stats.exact_median(df, ["g"], "x", "m", count="c").collect()] == [(len(rows), statistics.median(rows))]


class TestVwapBlocks:
    def test_equals_brute_force_across_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(vwap_module, "BLOCK", 20 * 60 * 1_000_000)
        rng = random.Random(9)
        lines = []
        for _ in range(150):
            at = rng.choice([rng.randrange(0, 400), rng.randrange(0, 400) // 20 * 20])
            c = 70 + rng.randrange(0, 20) / 10
            lines.append(f"CLM26,2026-03-10 {9 + at // 60:02d}:{at % 60:02d}:{rng.choice(['00', '30'])},{c},{c + 0.2},{c - 0.2},{c},{rng.choice([0, 5, 41])}")
        tape = settle(records(spark, "\n".join(lines)), "ticks")
        rows = [r.asDict() for r in tape.collect()]
        first = min(r["ts_utc"] for r in rows)
        want = []
        for r in rows:
            near = [o for o in rows if r["ts_utc"] - dt.timedelta(minutes=15) <= o["ts_utc"] <= r["ts_utc"]]
            volume = sum(o["volume"] for o in near)
            price = sum((o["high"] + o["low"] + o["close"]) / 3 * o["volume"] for o in near) / volume if volume else None
            want.append((r["ts_utc"], volume, len(near), r["ts_utc"] - first < dt.timedelta(minutes=15), price and round(price, 6)))
        got = [(r.ts_utc, r.window_volume, r.window_records, r.is_warmup, r.vwap_15m and round(r.vwap_15m, 6)) for r in vwap_15m(tape, "raw").collect()]
        assert Counter(got) == Counter(want)
        text = plan(vwap_15m(tape, "raw"))
        assert all("seat" in line for line in text.splitlines() if re.search(r"\bWindow \[", line))


class TestSpans:
    def test_union_equals_brute_force_over_many_days(self, spark):
        rng = random.Random(6)
        start = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
        rows = []
        for kind in ("a", None):
            for _ in range(120):
                lo = start + dt.timedelta(hours=rng.randrange(0, 24 * 40))
                rows.append((kind, lo, lo + dt.timedelta(hours=rng.choice([0, 1, 5, 30, 100]))))
        out = disjoint(spark.createDataFrame(rows, "k string, lo timestamp, hi timestamp"), ["k"]).collect()
        for kind in ("a", None):
            own = sorted((r.lo, r.hi) for r in out if r.k == kind)
            given = [(lo.replace(tzinfo=None), hi.replace(tzinfo=None)) for k, lo, hi in rows if k == kind]
            own = [(lo.replace(tzinfo=None), hi.replace(tzinfo=None)) for lo, hi in own]
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
            at = dt.datetime(2025, 1, 1)
            for half in range(0, 2 * 24 * 50):
                t = at + dt.timedelta(minutes=30 * half)
                assert any(lo <= t <= hi for lo, hi in own) == any(lo <= t <= hi for lo, hi in given)


class TestHashing:
    def test_pieces_addresses_and_sizes(self, spark, tmp_path):
        rng = random.Random(3)
        drop = tmp_path / "a drop" / "below"
        drop.mkdir(parents=True)
        held = {f"f{i}.csv": rng.randbytes(rng.choice([1, 4, 63, 64, 65, 5000])) for i in range(25)}
        held["p.parquet"] = b"PAR1" + rng.randbytes(100)
        for name, data in held.items():
            (drop / name).write_bytes(data)
        for path in (str(tmp_path / "a drop"), f"file://{tmp_path}/a drop", f"file:{tmp_path}/a drop"):
            out = landing.hashed(spark, path, piece=64).collect()
            assert {r.filename: (r.file_hash, r.file_bytes) for r in out} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in held.items()}
        magic = {r.filename: r.magic for r in out}
        assert magic["p.parquet"] == "PAR1"

    def test_tasks_get_equal_bytes(self, spark):
        files = spark.createDataFrame([(f"p{i}", f"p{i}", i * 10) for i in range(64)], "path string, filename string, file_bytes bigint")
        dealt = landing.dealt(files, 4)
        assert dealt.rdd.getNumPartitions() == 4
        loads = [sum(r.file_bytes for r in part) for part in dealt.rdd.glom().collect()]
        assert max(loads) - min(loads) <= 640 and sum(loads) == sum(range(64)) * 10

    def test_a_file_above_two_gigabytes(self, spark, tmp_path):
        size = (1 << 31) + 77
        big = tmp_path / "big.csv"
        with big.open("wb") as f:
            f.truncate(size)
        total, zeros, left = hashlib.sha256(), bytes(1 << 24), size
        while left:
            total.update(zeros[:min(left, 1 << 24)])
            left -= min(left, 1 << 24)
        assert [(r.file_bytes, r.file_hash) for r in landing.hashed(spark, str(tmp_path)).collect()] == [(size, total.hexdigest())]


class TestReplacing:
    def test_a_run_that_breaks_off_leaves_the_old_table_or_the_new(self, spark, tmp_path, monkeypatch):
        path = str(tmp_path / "t")
        old = [("a", 1), ("b c%", 2), (None, 3)]
        new = [("a", 10), ("d", 40)]
        frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
        scope = frame(old + new).select("k")
        held = lambda: sorted((str(r.k), r.v) for r in spark.read.parquet(path).collect())
        sinks.write_replacing(frame(old), path, ["k"], scope)
        before = held()

        with monkeypatch.context() as patch:
            patch.setattr(sinks, "_decide", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                sinks.write_replacing(frame(new), path, ["k"], scope)
        assert held() == before and not sinks.recover(spark, path) and held() == before

        with monkeypatch.context() as patch:
            plain, calls = sinks.recover, []
            patch.setattr(sinks, "recover", lambda *a: plain(*a) if not calls.append(1) and len(calls) == 1 else (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                sinks.write_replacing(frame(new), path, ["k"], scope)
        assert held() == before
        after = sorted((str(r.k), r.v) for r in sinks.read_replaced(spark, path).collect())
        assert after == sorted((str(k), v) for k, v in new) and not sinks.recover(spark, path)


class TestDimensionsAsInputs:
    def test_a_ninth_product(self, spark):
        products = product_dim(spark)
        corn = products.filter("root = 'ZC'")
        ninth = products.unionByName(corn.withColumn("root", F.lit("QQ")).withColumn("tick_size", F.lit(0.5)).withColumn("exchange", F.lit("HERE")))
        row = contracts_from_symbols(spark.createDataFrame([("QQZ25",)], "contract_id string"), ninth).first()
        assert (row.root, row.exchange, row.tick_size, row.month_code) == ("QQ", "HERE", 0.5, "Z")
        assert contracts_from_symbols(spark.createDataFrame([("QQZ25",)], "contract_id string")).first().exchange is None
        tape = settle(records(spark, "QQZ25,2025-09-15 09:00:00,1.5,2.0,1.0,1.25,5\nQQZ25,2025-09-15 09:01:00,1.5,2.0,1.0,1.5,5"), "ninth")
        given = tables(spark, tape)
        given.contracts, given.products = contracts_from_symbols(tape.select("contract_id"), ninth), ninth
        sc = build_scope(spark, given)
        assert [f["details"]["field"] for f in fire(sc, "VAL.OFF_TICK_PRICE")] == ["close"]
        assert sc.calendar.filter("root = 'QQ'").count() > 5 and sc.refusal is None

    def test_an_exempt_tick(self, spark):
        tape = settle(records(spark, "ESZ25,2025-09-15 09:00:00,100.1,101.1,99.0,100.1,5"), "exempt")
        given = tables(spark, tape)
        every = {f["details"]["field"] for f in fire(build_scope(spark, given), "VAL.OFF_TICK_PRICE")}
        given.ticks = tick_dim(spark).withColumn("exempt", F.col("exempt") | (F.col("field") == "open"))
        left = {f["details"]["field"] for f in fire(build_scope(spark, given), "VAL.OFF_TICK_PRICE")}
        assert every == {"open", "high", "close"} and left == {"high", "close"}

    def test_severity_and_triage_weight(self, spark):
        tape = settle(records(spark, "ESZ25,2025-09-15 09:00:00,100,101,99,100,-5"), "grade")
        plain = scope(spark, tape)
        rule = "VAL.NEGATIVE_VOLUME"
        changed = scope(spark, tape, overrides={rule: {"severity": "info"}})
        assert {f["severity"] for f in fire(plain, rule)} == {RULES_BY_ID[rule].severity} and {f["severity"] for f in fire(changed, rule)} == {"info"}
        found, _ = run_rules(changed, [rule])
        assert {r.severity for r in found.collect()} == {"info"}
        with pytest.raises(ValueError):
            fire(scope(spark, tape, overrides={rule: {"severity": "grave"}}), rule)
        resolved = spark.createDataFrame([], "contract_id string, frequency string, rule_id string, overall double")
        assert worklist(found, resolved, {rule: 7.5}).first().triage_weight == 7.5


FOUND = "finding_id string, rule_id string, severity string, status string, contract_id string, frequency string, trade_date date, record_id bigint, affected_rows bigint, ts_start_utc timestamp, ts_end_utc timestamp"


def test_sessions_meet_counts_and_not_findings(spark, monkeypatch):
    """Sets of rules are gathered from one row per key, rule and severity, however many findings there are."""
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rules = [("VAL.NEGATIVE_VOLUME", "critical"), ("VAL.OFF_TICK_PRICE", "warning"), ("CON.HIGH_LT_LOW", "critical")]
    series_rule = next(r for r in RULES_BY_ID if RULES_BY_ID[r].scope == "series")
    rng = random.Random(5)
    found = []
    for i in range(900):
        rule, severity = rng.choice(rules)
        found.append((f"f{i}", rule, severity, rng.choice(["open", "open", "closed"]), rng.choice(["A", "B", None]), rng.choice(["minute", None]),
                      rng.choice([*days, None]), i, 1, None, None))
    found.append(("s", series_rule, "critical", "open", "A", None, None, None, 1, None, None))
    found.append(("odd", None, "critical", "open", "A", "minute", days[0], 7, 1, None, None))
    sessions = [(c, "minute", d, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1)) for c in "AB" for d in days]
    settled = {}

    def spy(df, label):
        settled[label] = settle(df, label)
        return settled[label]

    monkeypatch.setattr(gate, "settle", spy)
    held = spark.createDataFrame(sessions, "contract_id string, frequency string, trade_date date, first_ts_utc timestamp, last_ts_utc timestamp")
    got = {(r.contract_id, r.trade_date): (r.finding_count, r.max_severity, list(r.blocking_rule_ids))
           for r in gate.session_quality(held, spark.createDataFrame(found, FOUND)).collect()}
    for contract, _, day, *_ in sessions:
        met = [f for f in found if f[3] == "open" and f[1] in dict(rules) and f[4] in (contract, None) and f[5] in ("minute", None) and f[6] in (day, None)]
        whole = [f for f in found if f[1] == series_rule and f[4] == contract]
        worst = "critical" if any(f[2] == "critical" for f in met + whole) else "warning" if met else None
        assert got[contract, day] == (len(met), worst, sorted({f[1] for f in met + whole if f[2] == "critical"}))
    keys = {(f[4], f[5], f[6], f[1], f[2]) for f in found if f[3] == "open" and f[1] is not None}
    assert settled["session-tallies"].count() == len(keys) < 900


def test_findings_are_counted_by_rule_before_dimensions(spark):
    tape = settle(records(spark, minutes("ESZ25", "2025-09-15", "09:00", [100.0] * 6)), "dims")
    sc = scope(spark, tape)
    rules = ["VAL.NEGATIVE_VOLUME", "VAL.NEGATIVE_VOLUME", "VAL.OFF_TICK_PRICE", "NO.SUCH_RULE", None]
    found = settle(spark.createDataFrame([
        (f"f{i}", rule, "critical", "open", "ESZ25", "minute", dt.date(2025, 9, 15), i, 1, None, None) for i, rule in enumerate(rules)], FOUND), "found")
    want = Counter(RULES_BY_ID[r].dimension for r in rules if r in RULES_BY_ID)
    for scored in (dimension_scores(sc, found), daily_metrics(sc, found)):
        assert {r.dimension: r.finding_count for r in scored.collect() if r.finding_count} == want
        assert re.search(r"HashAggregate\(keys=\[[^]]*rule_id", plan(scored))


@pytest.mark.parametrize("rows", [0, 100])
def test_decisions_are_counted_and_not_their_distinct_records(spark, monkeypatch, rows):
    """Whether to broadcast what was removed is decided without a pass that seeks distinct ids; either way the rows are the same."""
    tape = settle(records(spark, minutes("ESZ25", "2025-09-15", "09:00", [100.0 + i for i in range(8)])), "decided")
    ids = sorted(r.record_id for r in tape.collect())
    actions = settle(spark.createDataFrame(
        [(ids[0], "CON.HIGH_LT_LOW", "exclude"), (ids[0], "VAL.NEGATIVE_VOLUME", "exclude"), (ids[7], "UNQ.EXACT_DUPLICATE", "dedupe_drop"),
         (ids[7], "UNQ.EXACT_DUPLICATE", "dedupe_drop"), (ids[3], "VAL.OFF_TICK_PRICE", "coerce"), (None, "CON.HIGH_LT_LOW", "exclude")],
        "record_id bigint, rule_id string, action string"), "actions")
    small, counted = cleaning.small, []

    def spy(df, most=None, **kind):
        counted.append(plan(kind.get("counted", df)))
        return small(df, rows, **kind)

    monkeypatch.setattr(cleaning, "small", spy)
    kept = cleaning.clean_records(tape, actions)
    bars = {r.basis: r for r in build_bars(tape, actions).collect()}
    assert sorted(r.record_id for r in kept.collect()) == ids[1:7]
    assert (bars["raw"].record_count, bars["raw"].open, bars["raw"].close) == (8, 100.0, 107.0)
    assert (bars["clean"].record_count, bars["clean"].open, bars["clean"].close) == (6, 101.0, 106.0)
    assert len(counted) == 2 and not any("Aggregate" in p for p in counted)


def test_minutes_helper_makes_neighbours():
    assert len(minutes("ESZ25", "2025-09-15", "09:00", [1.0, 2.0]).splitlines()) == 2
