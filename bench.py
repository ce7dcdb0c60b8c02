"""Headline timings; prints one JSON line.

The stages mirror how a tape is used: load text, validate, score, build bars, publish VWAP,
compare the grains. Each is timed on its own inputs, already written, after one pass over the
smallest tables has warmed the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.env import OVERRIDES, Env  # noqa: E402
from checks.queries import _drop  # noqa: E402
from tapewright.operators import bars as B  # noqa: E402
from tapewright.operators import compare as X  # noqa: E402
from tapewright.operators import patterns as P  # noqa: E402
from tapewright.operators.cleaning import cleaning_actions  # noqa: E402
from tapewright.operators.gate import record_sessions, session_quality  # noqa: E402
from tapewright.operators.scope import build_scope  # noqa: E402
from tapewright.operators.scoring import all_metrics, dimension_scores, overall_score  # noqa: E402
from tapewright.operators.vwap import vwap_15m  # noqa: E402
from tapewright.plans.assess import run_rules  # noqa: E402
from tapewright.plans.load import load_lines  # noqa: E402
from tapewright.session import configure, settle  # noqa: E402
from tapewright.sources.readers import text_lines  # noqa: E402


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    e = Env(spark, sf_dir)
    records = e.weekdays
    _drop(e)
    e.contracts.count()
    e.first_bars.count()
    times: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> object:
        start = time.perf_counter()
        out = action()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def load() -> None:
        names = ["contract", "timestamp", "open", "high", "low", "close", "volume"]
        loaded = load_lines([text_lines(spark, _drop(e), names, header=False)], "b", "minute")
        run(loaded.records)
        run(loaded.rejects)

    timed("load_csv", load)
    scope = build_scope(spark, e.tables(records, bars=e.first_bars), overrides=OVERRIDES)
    found = timed("validate_all_rules", lambda: run_rules(scope)[0])
    metrics = timed("daily_metrics", lambda: settle(all_metrics(scope, found), "bench-metrics"))
    timed("scores", lambda: run(overall_score(scope, settle(dimension_scores(scope, found), "bench-dims"))))
    actions = timed("cleaning", lambda: settle(cleaning_actions(found), "bench-actions"))
    timed("annotated_bars", lambda: run(B.annotate_bars(
        B.bar_provenance(B.build_bars(records, actions), e.contracts, scope.calendar),
        session_quality(record_sessions(records), found))))
    timed("vwap_15m", lambda: run(vwap_15m(records, "clean", actions)))
    timed("minute_to_daily", lambda: run(X.compare_frequency(B.daily_bars(e.tape, "raw"), B.vendor_bars(e.tape, "raw"))))
    timed("patterns", lambda: run(P.find_patterns(
        P.record_exposure(records, e.batches), P.finding_tallies(found, records, e.batches))))
    assert metrics is not None
    return times


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    configure(spark)
    warm = Path(sf_dir).parent / "sf0.001"
    if warm.exists():
        stages(spark, str(warm))
    times = stages(spark, sf_dir)
    print(json.dumps({
        "metric": "tape assessment, all stages", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
