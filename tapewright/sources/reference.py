"""Reference dimensions: products, ticks, contracts and the generated session calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.symbols import parse_symbol
from ..session import literal_table

# ---- fixed values -----------------------------------------------------------------------
# session shape: open, close (seconds of the local day), one-minute slots, halts
SESSIONS = {
    "cme_23h": (17 * 3600, 16 * 3600, 1380, []),
    "ice_single_window": (2 * 3600 + 1800, 12 * 3600, 570, []),
    "cbot_grain_two_window": (19 * 3600, 13 * 3600 + 1200, 1055, [(7 * 3600 + 2700, 8 * 3600 + 1800)]),
}
PRODUCTS = [
    ("CL", "WTI Crude Oil", "NYMEX", 0.01, 1000.0, "cme_23h", "monthly"),
    ("ES", "E-mini S&P 500", "CME", 0.25, 50.0, "cme_23h", "quarterly"),
    ("GC", "Gold", "COMEX", 0.10, 100.0, "cme_23h", "G,J,M,Q,V,Z"),
    ("SB", "Sugar No. 11", "ICEUS", 0.01, 1120.0, "ice_single_window", "H,K,N,V"),
    ("SR3", "Three-Month SOFR", "CME", 0.0025, 2500.0, "cme_23h", "quarterly"),
    ("VX", "Cboe Volatility Index", "CFE", 0.01, 1000.0, "cme_23h", "monthly"),
    ("ZC", "Corn", "CBOT", 0.25, 50.0, "cbot_grain_two_window", "H,K,N,U,Z"),
    ("ZN", "10-Year T-Note", "CBOT", 0.015625, 1000.0, "cme_23h", "quarterly"),
]
DEFAULT_OPEN_SEC = 17 * 3600
CALENDAR_PAD_DAYS = 5
# ---- end of fixed values ----------------------------------------------------------------

KNOWN_ROOTS = [product[0] for product in PRODUCTS]


def product_dim(spark: SparkSession) -> DataFrame:
    """Eight products with venue, tick, multiplier and session shape."""
    rows = [
        (root, text, venue, clock.CHICAGO, tick, mult, cycle, SESSIONS[shape][0], SESSIONS[shape][1],
         SESSIONS[shape][2], SESSIONS[shape][0] > SESSIONS[shape][1],
         ",".join(f"{a}-{b}" for a, b in SESSIONS[shape][3]))
        for root, text, venue, tick, mult, shape, cycle in PRODUCTS
    ]
    table = literal_table(
        spark,
        "root string, description string, exchange string, timezone string, tick_size double, "
        "multiplier double, cycle string, open_sec int, close_sec int, slots_1m bigint, "
        "spans_midnight boolean, halt_text string",
        rows,
    )
    window = lambda w: F.struct(
        F.split(w, "-")[0].cast("int").alias("start_sec"), F.split(w, "-")[1].cast("int").alias("end_sec")
    )
    halts = F.transform(F.filter(F.split("halt_text", ","), lambda w: w != ""), window)
    return table.withColumn("halts", halts).drop("halt_text")


def tick_dim(spark: SparkSession, products: DataFrame | None = None) -> DataFrame:
    """Tick per root, frequency and field; the daily close is a settlement and is exempt.

    A caller with ticks of its own hands a table of these columns to the scope instead.
    """
    exempt = (F.col("frequency") == "daily") & (F.col("field") == "close")
    fields = F.array(*[F.lit(name) for name in ("open", "high", "low", "close")])
    return (product_dim(spark) if products is None else products).select(
        "root", "tick_size", F.explode(F.array(F.lit("minute"), F.lit("daily"))).alias("frequency")
    ).withColumn("field", F.explode(fields)).select(
        "root", "frequency", "field", F.when(~exempt, F.col("tick_size")).alias("tick_size"),
        exempt.alias("exempt"),
    )


def open_second(root: Column) -> Column:
    """Roll boundary of a root: null when its session stays in one day, 17:00 when unknown."""
    rolling = F.lit(None).cast("int")
    known = F.when(root.isin([p[0] for p in PRODUCTS if SESSIONS[p[5]][0] <= SESSIONS[p[5]][1]]), rolling)
    for name, (open_sec, close_sec, _, _) in SESSIONS.items():
        if open_sec > close_sec:
            known = known.when(root.isin([p[0] for p in PRODUCTS if p[5] == name]), F.lit(open_sec))
    return known.otherwise(F.lit(DEFAULT_OPEN_SEC))


CONTRACT_COLUMNS = [
    "contract_id", "root", "month_code", "contract_month", "exchange", "timezone", "tick_size",
    "multiplier", "first_trade_date", "last_trade_date", "parse_confidence", "dates_inferred",
]


def known_roots(products: DataFrame | None = None) -> list[str]:
    """Roots that symbols may begin with: those of a product table, a dimension, or the eight built in."""
    return KNOWN_ROOTS if products is None else sorted(r["root"] for r in products.select("root").distinct().collect())


def _with_product(contracts: DataFrame, products: DataFrame | None = None) -> DataFrame:
    product = (product_dim(contracts.sparkSession) if products is None else products).select(
        "root", F.col("exchange").alias("p_exchange"), "timezone", "tick_size", "multiplier"
    )
    return contracts.join(F.broadcast(product), "root", "left")


def contracts_from_symbols(symbols: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Dimension rows for bare ``contract_id`` values; an unparsed id is its own root.

    ``products``, in the columns of ``product_dim``, replaces the built-in products.
    """
    parts = parse_symbol(F.col("contract_id"), known_roots(products))
    rows = symbols.select("contract_id").distinct().select(
        "contract_id", *[c.alias(n) for n, c in parts.items()]
    )
    rows = rows.withColumn("root", F.coalesce("root", "contract_id"))
    none = F.lit(None).cast("date")
    return _with_product(rows, products).select(
        "contract_id", "root", "month_code", "contract_month", F.col("p_exchange").alias("exchange"),
        "timezone", "tick_size", "multiplier", none.alias("first_trade_date"),
        none.alias("last_trade_date"), "parse_confidence", F.lit(True).alias("dates_inferred"),
    )


def ensure_contracts(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """The dimension plus every contract the records introduce."""
    fresh = records.select("contract_id").distinct().join(contracts, "contract_id", "left_anti")
    return contracts.select(*CONTRACT_COLUMNS).unionByName(contracts_from_symbols(fresh))


def contracts_from_manifest(manifest: DataFrame) -> DataFrame:
    """One row per contract over its manifest files: widest dates, lowest confidence.

    ``manifest``: contract_symbol, root, month_code, delivery_year, delivery_month, exchange,
    first_timestamp_ms, last_timestamp_ms, all text.
    """
    parts = parse_symbol(F.col("contract_symbol"), KNOWN_ROOTS)
    agrees = parts["root"].eqNullSafe(F.col("root")) & parts["month_code"].eqNullSafe(F.col("month_code"))

    def day(name: str) -> Column:
        return F.to_date(F.timestamp_millis(F.col(name).try_cast("bigint")))

    merged = manifest.groupBy(F.col("contract_symbol").alias("contract_id")).agg(
        F.min("root").alias("root"),
        F.min("month_code").alias("month_code"),
        F.min(F.make_date(F.col("delivery_year").cast("int"), F.col("delivery_month").cast("int"), F.lit(1)))
        .alias("contract_month"),
        F.min("exchange").alias("exchange"),
        F.min(day("first_timestamp_ms")).alias("first_trade_date"),
        F.max(day("last_timestamp_ms")).alias("last_trade_date"),
        F.min(F.when(agrees, 1.0).otherwise(0.5)).alias("parse_confidence"),
    )
    return _with_product(merged).withColumn("dates_inferred", F.lit(True)).select(*CONTRACT_COLUMNS)


def session_calendar(spans: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Weekday sessions of each ``root`` from ``start_date`` to ``end_date``; ``products`` replaces the built-in ones."""
    products = (product_dim(spans.sparkSession) if products is None else products).select(
        "root", "exchange", "timezone", "open_sec", "close_sec", "slots_1m", "halts"
    )
    days = (
        spans.groupBy("root").agg(F.min("start_date").alias("s"), F.max("end_date").alias("e"))
        .join(F.broadcast(products), "root")
        .withColumn("trade_date", F.explode(F.sequence("s", "e")))
        .filter(F.dayofweek("trade_date").between(2, 6))
        .drop("s", "e")
    )
    years = spans.select(F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("year")).distinct()
    joined = days.join(
        clock.holidays(years).select(F.col("day").alias("trade_date"), "is_holiday", "is_early_close"),
        "trade_date", "left",
    )
    closed = F.coalesce("is_holiday", F.lit(False))
    early = F.coalesce("is_early_close", F.lit(False))
    opens, closes = clock.session_bounds(
        F.col("trade_date"), F.col("open_sec"), F.col("close_sec"), F.col("timezone")
    )
    halts = clock.halt_windows(
        F.col("trade_date"), F.col("halts"), F.col("open_sec"), F.col("close_sec"), F.col("timezone")
    )
    return joined.select(
        "exchange", "root", "trade_date",
        F.when(~closed, opens).alias("session_open_utc"),
        F.when(~closed, closes).alias("session_close_utc"),
        closed.alias("is_holiday"),
        early.alias("is_early_close"),
        F.when(closed, F.filter(halts, lambda h: F.lit(False))).otherwise(halts).alias("halts_utc"),
        F.when(closed, F.lit(0)).when(~early, F.col("slots_1m")).cast("bigint").alias("expected_slots_1m"),
    )


def calendar_for_loaded(records: DataFrame, contracts: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Calendar over every root's loaded dates, padded five days on both sides."""
    per_contract = records.groupBy("contract_id").agg(
        F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")
    )
    spans = (
        per_contract.join(contracts.select("contract_id", "root"), "contract_id")
        .groupBy("root")
        .agg(
            F.date_sub(F.min("lo"), CALENDAR_PAD_DAYS).alias("start_date"),
            F.date_add(F.max("hi"), CALENDAR_PAD_DAYS).alias("end_date"),
        )
    )
    return session_calendar(spans, products)


def read_calendar(calendar: DataFrame, root: str | None = None, start=None, end=None) -> DataFrame:
    """Calendar rows of a root and date range, in reading order."""
    if root is not None:
        calendar = calendar.filter(F.col("root") == root)
    if start is not None:
        calendar = calendar.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        calendar = calendar.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return calendar.drop("halts_utc").orderBy("root", "trade_date")


def contract_coverage(
    records: DataFrame, contracts: DataFrame, root: str | None = None, active_on=None,
    frequency: str | None = None,
) -> DataFrame:
    """What is held per contract and grain, one row per contract with both grains side by side."""
    per_grain = records.groupBy("contract_id", "frequency", "trade_date").agg(
        F.count("*").alias("n")
    ).groupBy("contract_id", "frequency").agg(
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"),
        F.count("*").alias("sessions"),
        F.sum("n").alias("records"),
    )
    wide = per_grain.groupBy("contract_id").agg(
        F.sort_array(F.collect_set("frequency")).alias("frequencies_available"),
        *[
            F.max(F.when(F.col("frequency") == grain, F.col(name))).alias(f"{grain}_{name}")
            for grain in ("minute", "daily")
            for name in ("first_trade_date", "last_trade_date", "sessions", "records")
        ],
    )
    dims = contracts.select(
        "contract_id", "root", "exchange", F.date_format("contract_month", "yyyy-MM").alias("contract_month"),
        "tick_size", "multiplier", "dates_inferred",
    )
    if root is not None:
        dims = dims.filter(F.col("root") == root)
    held = dims.join(wide, "contract_id", "left").withColumn(
        "frequencies_available", F.coalesce("frequencies_available", F.array().cast("array<string>"))
    )
    if frequency is not None:
        held = held.filter(F.array_contains("frequencies_available", frequency))
    if active_on is not None:
        day = F.lit(active_on).cast("date")
        spans = [
            F.coalesce(day.between(F.col(f"{g}_first_trade_date"), F.col(f"{g}_last_trade_date")), F.lit(False))
            for g in ("minute", "daily")
        ]
        held = held.filter(spans[0] | spans[1])
    return held


def expected_grid(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every open one-minute slot of the given ``(root, trade_date)`` sessions, halts left out."""
    minute = F.expr("interval 1 minute")
    slots = (
        sessions.join(calendar.drop("exchange"), ["root", "trade_date"])
        .filter("session_open_utc is not null and not is_early_close")
        .withColumn(
            "slot", F.explode(F.sequence("session_open_utc", F.col("session_close_utc") - minute, minute))
        )
    )
    halted = F.exists("halts_utc", lambda h: (F.col("slot") >= h["start_utc"]) & (F.col("slot") < h["end_utc"]))
    return slots.filter(~halted).select(*sessions.columns, "slot")
