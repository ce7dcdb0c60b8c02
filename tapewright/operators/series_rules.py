"""Rules that compare a record with others: copies, neighbours and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import lookup
from ..functions import order, series
from ..functions.stats import exact_median
from ..session import BROADCAST_ROWS, settle
from ..sources.reference import PRODUCTS, SESSIONS
from .cleaning import clean_records
from .findings import findings
from .scope import SLICE, Scope

VALUES = ["open", "high", "low", "close", "volume", "open_interest"]
RECORD = ["record_id", "contract_id", "frequency", "trade_date", "ts_utc"]



def _within(*columns: str) -> WindowSpec:
    """A window inside a chunk: it reads the layout where it lies."""
    return W.partitionBy(*SLICE, *series.CHUNK, *columns)


def _along() -> WindowSpec:
    return _within().orderBy("ts_utc", "record_id")


def exact_duplicate(scope: Scope) -> DataFrame:
    """Every copy of a row other than its lowest source row, with the keeper named.

    Copies lie in one chunk, so they are counted where they are. Only a day that was cut further may part them: there they are
    counted before they are joined back, so that no row's copies gather in one task.
    """
    rows = scope.layout.select(*RECORD, "source_row", *VALUES, *series.CHUNK)
    keeper = F.min(F.struct("source_row", "record_id"))
    same = _within("ts_utc", *VALUES)
    found = rows.filter("chunk_ts = 0").withColumns({"copies": F.count("*").over(same), "keeper": keeper.over(same)}).filter("copies > 1")
    if scope.hot_days is not None:
        key = [*SLICE, "ts_utc", *VALUES]
        hot = rows.filter("chunk_ts <> 0")
        kept = hot.groupBy(*key).agg(F.count("*").alias("copies"), keeper.alias("keeper")).filter("copies > 1")
        k = kept.select(*[F.col(c).alias(f"k_{c}") for c in key], "copies", "keeper")
        found = found.unionByName(hot.join(k, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]).select(*rows.columns, "copies", "keeper"))
    return findings(found.filter(F.col("record_id") != F.col("keeper.record_id")), "UNQ.EXACT_DUPLICATE", {
        "copies": F.col("copies"), "keeps_record_id": F.col("keeper.record_id"),
        "keeps_source_row": F.col("keeper.source_row"), "source_row": F.col("source_row"),
    }, record=F.col("record_id"))


def key_conflict(scope: Scope) -> DataFrame:
    """Every row of a key that carries more than one distinct value tuple; cut days as in ``exact_duplicate``."""
    key = [*SLICE, "ts_utc"]
    rows = scope.layout.select(*RECORD, "source_row", *VALUES, *series.CHUNK)
    same = _within("ts_utc")
    nth = F.dense_rank().over(same.orderBy(*VALUES))
    found = rows.filter("chunk_ts = 0").withColumn("variant", nth).withColumn("variants", F.max("variant").over(same)).drop("variant").filter("variants > 1")
    if scope.hot_days is not None:
        hot = rows.filter("chunk_ts <> 0")
        variants = hot.groupBy(*key, *VALUES).agg(F.lit(1).alias("one")).groupBy(*key).agg(
            F.count("*").cast("int").alias("variants")).filter("variants > 1")
        found = found.unionByName(hot.join(variants, key).select(*rows.columns, "variants"))
    return findings(found, "UNQ.KEY_CONFLICT", {
        "variants": F.col("variants"), "source_row": F.col("source_row")}, record=F.col("record_id"))


def stale_repeat(scope: Scope) -> DataFrame:
    """Runs of identical OHLC with volume on both neighbours, at least ``n`` records long.

    Runs are counted inside their chunk. The first and the last of a chunk may go on beyond it: those, two rows a
    chunk at most, are put together along the series afterwards.
    """
    p = scope.params("CON.STALE_REPEAT")
    prices = ["open", "high", "low", "close"]
    along = _along()
    first = F.row_number().over(along) == 1
    rows = scope.layout.select(*RECORD, "root", *prices, "volume", *series.CHUNK).withColumn("first", first).withColumns({
        f"inside_{name}": F.lag(name).over(along) for name in (*prices, "volume")}).join(scope.borders, [*SLICE, *series.CHUNK])

    def previous(name: str) -> Column:
        return F.when(F.col("first"), F.col(f"before_{name}")).otherwise(F.col(f"inside_{name}"))

    same = F.col("open").isNotNull() & (F.coalesce("volume", F.lit(0)) != 0) & (F.coalesce(previous("volume"), F.lit(0)) != 0)
    for name in prices:
        same = same & F.col(name).eqNullSafe(previous(name))
    starts = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    inside = along.rowsBetween(W.unboundedPreceding, 0)
    part = [*SLICE, "root", *series.CHUNK]
    runs = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(inside)).groupBy(*part, "run").agg(
        F.min("trade_date").alias("trade_date"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"),
        F.count("*").alias("length"), F.max("close").alias("close"), F.min("record_id").alias("lowest"),
        F.max("starts").alias("starts"))
    final = F.max("run").over(_within())
    runs = runs.withColumn("open_end", (F.col("run") == final) | (F.col("starts") == 0))
    minimum = F.coalesce(lookup({k: int(v) for k, v in p["n_by_root"].items()}, F.col("root")), F.lit(int(p["n"])))
    runs = runs.withColumn("minimum", minimum).filter("open_end or length >= minimum")
    runs = settle(runs, "runs")
    chain = F.sum("starts").over(W.partitionBy(*SLICE).orderBy(*series.CHUNK, "run"))
    joined = runs.filter("open_end").withColumn("chain", chain).groupBy(*SLICE, "root", "minimum", "chain").agg(
        F.min("trade_date").alias("trade_date"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("length").alias("length"), F.max("close").alias("close"), F.min("lowest").alias("lowest"))
    whole = runs.filter("not open_end").select(*[c for c in joined.columns if c != "chain"])
    found = whole.unionByName(joined.drop("chain")).filter("length >= minimum")
    return findings(found, "CON.STALE_REPEAT", {
        "run_length": F.col("length"), "threshold_n": F.col("minimum"), "repeated_close": F.col("close"),
    }, start=F.col("first_ts"), end=F.col("last_ts"), affected=F.col("length"),
        subject=F.col("lowest").cast("string"))


def price_jump(scope: Scope) -> DataFrame:
    """Absolute log return to the previous positive close above the grain's threshold."""
    p = scope.params("CON.PRICE_JUMP")
    rows = scope.layout.filter("close > 0").select(*RECORD, "close", *series.CHUNK).withColumn("inside", F.lag("close").over(_along()))
    rows = rows.join(scope.borders.select(*SLICE, *series.CHUNK, "before_positive"), [*SLICE, *series.CHUNK]).withColumn(
        "previous", F.coalesce("inside", "before_positive"))
    limit = lookup({k: float(v) for k, v in p["threshold"].items()}, F.col("frequency"))
    jump = F.ln(F.col("close") / F.col("previous"))
    rows = rows.withColumn("log_return", jump).withColumn("limit", limit).filter(F.abs("log_return") > F.col("limit"))
    return findings(rows, "CON.PRICE_JUMP", {
        "log_return": F.col("log_return"), "previous_close": F.col("previous"), "close": F.col("close"),
        "threshold": F.col("limit")}, record=F.col("record_id"))


def out_of_order(scope: Scope) -> DataFrame:
    """Timestamps that fall as the source row of one batch, contract and grain rises."""
    keys = ["batch_id", *SLICE]
    rows = scope.records.select(*RECORD, "batch_id", "source_row").withColumn(
        "block", F.shiftright("source_row", series.BLOCK_BITS))
    border = series.borders(rows, keys, order.packed((F.col("source_row"), 18), (F.col("record_id"), 18)), {"before": F.col("ts_utc")}, chunk=["block"])
    inside = F.lag("ts_utc").over(W.partitionBy(*keys, "block").orderBy("source_row", "record_id"))
    rows = rows.withColumn("inside", inside).join(border, [*keys, "block"]).withColumn("previous", F.coalesce("inside", "before"))
    rows = rows.filter(F.col("ts_utc") < F.col("previous"))
    return findings(rows, "TIM.OUT_OF_ORDER", {
        "source_row": F.col("source_row"), "previous_ts_utc": F.col("previous"), "ts_utc": F.col("ts_utc"),
    }, record=F.col("record_id"))


def timezone_misaligned(scope: Scope) -> DataFrame:
    """The single silent hour of a near-24-hour file sits at the wrong clock hour."""
    p = scope.params("TIM.TIMEZONE_MISALIGNED")
    expected = {}
    for root, *_rest in PRODUCTS:
        open_sec, close_sec, _, _ = SESSIONS[_rest[4]]
        if open_sec - close_sec == 3600 and close_sec % 3600 == 0:
            expected[root] = close_sec // 3600
    hours = scope.records.filter("frequency = 'minute' and root is not null").groupBy(
        "batch_id", "root", F.hour("ts_exchange").alias("hour")
    ).agg(F.count("*").alias("n"), F.min("ts_utc").alias("lo"), F.max("ts_utc").alias("hi"))
    files = hours.groupBy("batch_id", "root").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_set("hour").alias("active"),
    )
    dead = F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("active"))
    files = files.withColumn("expected", lookup(expected, F.col("root"))).withColumn("dead", dead).filter(
        (F.col("n") >= p["min_records"]) & (F.size("active") >= p["min_active_hours"])
        & (F.size("dead") == 1) & (F.try_element_at("dead", F.lit(1)) != F.col("expected"))
    ).withColumn("observed", F.col("dead")[0])
    return findings(files, "TIM.TIMEZONE_MISALIGNED", {
        "batch_id": F.col("batch_id"), "root": F.col("root"),
        "expected_dead_hour_local": F.col("expected"), "observed_dead_hour_local": F.col("observed"),
        "offset_hours": F.pmod(F.col("observed") - F.col("expected") + 12, F.lit(24)) - 12,
        "records": F.col("n"),
    }, frequency="minute", contract=F.lit(None), trade_date=F.lit(None), start=F.col("lo"), end=F.col("hi"),
        affected=F.col("n"), subject=F.concat_ws(":", "batch_id", "root"))


def _surviving(scope: Scope, records: DataFrame) -> DataFrame:
    return records if scope.tables.actions is None else clean_records(records, scope.tables.actions)


def _log_returns(scope: Scope) -> DataFrame:
    """Returns over the surviving records by source row; a day that was cut by record id is cut anew by row."""
    along = ["ts_utc", "source_row", "record_id"]
    if scope.hot_days is None:
        rows = _surviving(scope, scope.layout)
    else:
        rows = series.with_chunks(_surviving(scope, scope.records), SLICE, scope.hot_days, block="source_row")
    rows = rows.filter("close > 0").select(*RECORD, "source_row", "close", *series.CHUNK)
    border = series.borders(rows, SLICE, order.in_day_by_row(), {"before": F.col("close")})
    rows = rows.withColumn("inside", F.lag("close").over(_within().orderBy(*along))).join(border, [*SLICE, *series.CHUNK])
    return rows.withColumn("v", F.ln(F.col("close") / F.coalesce("inside", "before")))


def _log_volumes(scope: Scope) -> DataFrame:
    return _surviving(scope, scope.records).filter("volume > 0").withColumn("v", F.ln("volume"))


OUTLIER_RULES = {"OUT.RETURN_MAD": ("log_return", _log_returns), "OUT.VOLUME_MAD": ("log_volume", _log_volumes)}


def outliers(scope: Scope, rule_ids: list[str]) -> DataFrame:
    """Modified z-scores per slice, all outlier rules together.

    The values are written once, and beside them how often each occurs: both medians read those counts
    only, however many records share a value. Medians are exact and spread over tasks.
    """
    params = {rule: scope.params(rule) for rule in rule_ids}

    def param(name: str) -> Column:
        return lookup({rule: float(params[rule][name]) for rule in rule_ids}, F.col("rule"))

    valued = [
        OUTLIER_RULES[rule][1](scope).filter("v is not null").select(F.lit(rule).alias("rule"), *RECORD, "v")
        for rule in rule_ids
    ]
    valued = settle(reduce(DataFrame.unionByName, valued), "mad-values")
    group = ["rule", *SLICE]
    per_group = F.broadcast if scope.slice_count <= BROADCAST_ROWS // 2 else lambda d: d
    tallied = settle(valued.groupBy(*group, "v").agg(F.count("*").alias("c")), "mad-tally")
    centre = exact_median(tallied, group, "v", "med", per_group, "c").filter(F.col("n") >= param("min_records")).drop("n")
    centre = settle(centre, "mad-centre")
    apart = tallied.join(per_group(centre), group).withColumn("apart", F.abs(F.col("v") - F.col("med")))
    spread = exact_median(apart, group, "apart", "mad", per_group, "c").filter("mad > 0").select(*group, "mad")
    score = param("constant") * (F.col("v") - F.col("med")) / F.col("mad")
    rows = valued.join(per_group(centre), group).join(per_group(spread), group).withColumn("z", score).filter(F.abs("z") > param("threshold"))
    out = None
    for rule in rule_ids:
        part = findings(rows.filter(F.col("rule") == rule), rule, {
            OUTLIER_RULES[rule][0]: F.col("v"), "median": F.col("med"), "mad": F.col("mad"), "modified_z": F.col("z"),
            "threshold": F.lit(params[rule]["threshold"])}, record=F.col("record_id"))
        out = part if out is None else out.unionByName(part)
    return out


SERIES_RULES = {
    "UNQ.EXACT_DUPLICATE": exact_duplicate,
    "UNQ.KEY_CONFLICT": key_conflict,
    "CON.STALE_REPEAT": stale_repeat,
    "CON.PRICE_JUMP": price_jump,
    "TIM.OUT_OF_ORDER": out_of_order,
    "TIM.TIMEZONE_MISALIGNED": timezone_misaligned,
}
