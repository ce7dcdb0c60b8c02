"""From text columns to typed records and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.symbols import parse_symbol
from .readers import BASE, BROKEN, FILE, ROW, with_file_base
from .reference import KNOWN_ROOTS, PRODUCTS, SESSIONS, open_second

# ---- fixed values: column layouts -------------------------------------------------------
ALIASES = {
    "contract_id": ["contract_id", "contract", "contract_symbol", "symbol"],
    "ts": ["timestamp", "ts", "datetime", "date_time", "timestamp_chicago_wall", "date"],
    "open": ["open"],
    "high": ["high"],
    "low": ["low"],
    "close": ["close"],
    "volume": ["volume"],
    "open_interest": ["open_interest", "openinterest", "oi"],
}
REQUIRED = ["contract_id", "ts", "open", "high", "low", "close"]
PROFILES = {
    "vendor_minute": {
        "frequency": "minute",
        "needs": ["contract_symbol", "timestamp_chicago_wall", "open", "high", "low", "close"],
        "columns": {
            "contract_symbol": "contract_id", "timestamp_chicago_wall": "ts", "timestamp_ms": "ts_source",
            "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
        },
        "declined": ["trading_date", "minute_of_day", "root_id", "root", "exchange"],
        "bar_interval": "1 minute",
        "session_boundary": "session_close 17:00 America/Chicago",
    },
    "vendor_daily": {
        "frequency": "daily",
        "needs": ["contract_symbol", "date", "open", "high", "low", "close"],
        "columns": {
            "contract_symbol": "contract_id", "date": "ts", "timestamp_ms": "ts_source",
            "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
            "open_interest": "open_interest",
        },
        "declined": ["root_id", "root", "exchange"],
        "bar_interval": "1 day",
        "session_boundary": "column:date (vendor session date, 17:00 roll)",
    },
}
# ---- end of fixed values ----------------------------------------------------------------
TARGETS = ["contract_id", "ts", "ts_source", "open", "high", "low", "close", "volume", "open_interest"]
PRICES = ["open", "high", "low", "close"]


class MissingColumns(ValueError):
    """The layout lacks fields a record cannot do without."""


@dataclass(frozen=True)
class Layout:
    """How a file's columns feed the record fields."""

    profile: str | None
    mapping: dict[str, str]
    declined: list[str]

    def source_of(self, target: str) -> str | None:
        return next((s for s, t in self.mapping.items() if t == target), None)


def resolve_columns(columns: list[str], profiles: dict[str, dict] | None = None) -> Layout:
    """Vendor profile when its columns are present, else aliases by name, else a refusal.

    ``profiles``, in the form of ``PROFILES``, is looked through before the built-in ones.
    """
    data = [c for c in columns if c not in (BASE, BROKEN, FILE, ROW)]
    for name, profile in {**(profiles or {}), **{k: v for k, v in PROFILES.items() if k not in (profiles or {})}}.items():
        if set(profile["needs"]) <= set(data):
            mapping = {s: t for s, t in profile["columns"].items() if s in data}
            return Layout(name, mapping, [c for c in data if c not in mapping])
    by_lower = {c.lower(): c for c in data}
    mapping = {}
    for target, names in ALIASES.items():
        hit = next((by_lower[n] for n in names if n in by_lower and by_lower[n] not in mapping), None)
        if hit:
            mapping[hit] = target
    missing = [t for t in REQUIRED if t not in mapping.values()]
    if missing:
        raise MissingColumns(f"missing {missing}; the file has {data}")
    return Layout(None, mapping, [c for c in data if c not in mapping])


def to_targets(df: DataFrame, layout: Layout) -> DataFrame:
    """Text columns under the record's field names, the whole row kept as JSON for rejects."""
    def text(target: str) -> Column:
        source = layout.source_of(target)
        return F.lit(None).cast("string") if source is None else F.col(f"`{source}`").cast("string")

    data = [c for c in df.columns if c not in (BASE, BROKEN, FILE, ROW)]
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data]), {"ignoreNullFields": "false"})
    cols = {t: text(t) for t in TARGETS}
    cols["ts_source"] = F.coalesce(cols["ts_source"], cols["ts"]) if layout.source_of("ts_source") else cols["ts"]
    return df.select(
        *[c.alias(t) for t, c in cols.items()], *[c for c in (FILE, BASE) if c in df.columns],
        F.col(ROW).cast("bigint").alias(ROW), F.col(BROKEN).alias("broken"),
        F.coalesce(F.col(BROKEN), payload).alias("raw_payload"))


def _present(name: str) -> Column:
    return F.coalesce(F.trim(name) != "", F.lit(False))


def wall_clock() -> Column:
    """The row's timestamp; a label without a whole date is no timestamp."""
    return F.when(F.trim("ts").rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.trim("ts").try_cast("timestamp_ntz"))


def _number(name: str) -> Column:
    """The cell as a double; a type suffix such as ``1d`` is no number, NaN and Infinity in words are."""
    text = F.trim(name)
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | text.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    return F.when(plain, text.try_cast("double"))


def _whole_number(name: str) -> Column:
    return F.round(_number(name)).try_cast("bigint")


def reject_reason() -> Column:
    """First reason a row cannot load, or null; an empty cell is a null, not a reject."""
    bad = lambda name: _present(name) & _number(name).isNull()
    price = bad(PRICES[0])
    for name in PRICES[1:]:
        price = price | bad(name)
    return (
        F.when(F.col("broken").isNotNull() | ~_present("contract_id"), "STR.UNPARSEABLE_ROW")
        .when(wall_clock().isNull(), "STR.BAD_TIMESTAMP")
        .when(price, "STR.NON_NUMERIC_PRICE")
        .when(_present("volume") & _whole_number("volume").isNull(), "STR.NON_NUMERIC_VOLUME")
    )


def route_rejects(rows: DataFrame, batch_id: Column) -> DataFrame:
    """Rows that cannot load, with reason, detail and verbatim payload."""
    return rows.withColumn("reason_code", reject_reason()).filter("reason_code is not null").select(
        batch_id.alias("batch_id"), ROW, "reason_code", reject_detail().alias("reason_detail"), "raw_payload")


def reject_detail() -> Column:
    """What is wrong with a row, in words; reads its ``reason_code``."""
    # fixed values: detail texts
    return (
        F.when(F.col("broken").isNotNull(), "row does not split into the expected field count")
        .when(F.col("reason_code") == "STR.UNPARSEABLE_ROW", "no contract identifier on the row")
        .when(F.col("reason_code") == "STR.BAD_TIMESTAMP", F.concat(
            F.lit("timestamp "), F.coalesce("ts", F.lit("<null>")), F.lit(" does not parse")))
        .when(F.col("reason_code") == "STR.NON_NUMERIC_PRICE", "a price field is present but not numeric")
        .when(F.col("reason_code") == "STR.NON_NUMERIC_VOLUME", "volume is present but not numeric")
    )


def type_records(
    rows: DataFrame, batch_id: Column, frequency: str, timezone: str = clock.CHICAGO,
    ingested_at: Column | None = None, first_id: Column | int = 0,
) -> DataFrame:
    """Typed records of the rows no reason rejects.

    Volume is rounded half away from zero and its label kept when it had a fraction. Ids follow
    the row number from ``first_id`` on, which the caller sets past the ids already taken, file after
    file by path; a column in its place is the base of the row's file and takes the order of files over.
    """
    if isinstance(first_id, int):
        rows = rows if BASE in rows.columns else with_file_base(rows)
        first_id = F.lit(first_id) + F.col(BASE)
    return rows.filter(reject_reason().isNull()).select(
        (first_id + F.col(ROW)).cast("bigint").alias("record_id"), batch_id.alias("batch_id"), ROW,
        *typed_columns(frequency, timezone, ingested_at))


def typed_columns(frequency: str, timezone: str = clock.CHICAGO, ingested_at: Column | None = None) -> list[Column]:
    """The fields of a record from its text, but for its ids."""
    ts = wall_clock()
    amount = _number("volume")
    root = parse_symbol(F.col("contract_id"), KNOWN_ROOTS)["root"]
    day = F.to_date(ts) if frequency == "daily" else clock.trade_date(ts, open_second(root))
    return [
        F.col("contract_id"), F.lit(frequency).alias("frequency"), F.col("ts_source"), ts.alias("ts_exchange"),
        F.to_utc_timestamp(ts, timezone).alias("ts_utc"), day.alias("trade_date"),
        *[_number(name).alias(name) for name in PRICES],
        _whole_number("volume").alias("volume"),
        F.when(amount != F.floor(amount), F.col("volume")).alias("volume_source"),
        _whole_number("open_interest").alias("open_interest"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at")]


def batch_summary(
    records: DataFrame, rejects: DataFrame, batches: DataFrame, frequency: str | None = None,
    include_purged: bool = True,
) -> DataFrame:
    """Counts, status, contracts, sessions, dates and reject reasons of every batch."""
    if frequency is not None:
        batches = batches.filter(F.col("frequency") == frequency)
    if not include_purged:
        batches = batches.filter("status <> 'purged'")
    days = records.groupBy("batch_id", "contract_id", "trade_date").agg(F.count("*").alias("n"))
    held = days.groupBy("batch_id").agg(
        F.sum("n").alias("rows_accepted"), F.sort_array(F.collect_set("contract_id")).alias("contracts"),
        F.count("*").alias("sessions"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    reasons = rejects.groupBy("batch_id", "reason_code").agg(F.count("*").alias("n")).groupBy("batch_id").agg(
        F.sum("n").alias("rows_rejected"),
        F.sort_array(F.collect_list(F.concat_ws("=", "reason_code", "n"))).alias("reasons"))
    out = batches.join(held, "batch_id", "left").join(reasons, "batch_id", "left").fillna(
        0, ["rows_accepted", "rows_rejected"])
    return out.withColumns({
        "rows_read": F.col("rows_accepted") + F.col("rows_rejected"),
        "status": F.when(F.col("status") == "purged", "purged").when(
            F.col("rows_rejected") == 0, "succeeded").otherwise("partial")})


def rejects_page(rejects: DataFrame, batch_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return rejects.filter(F.col("batch_id") == batch_id).orderBy(ROW).offset(offset).limit(limit)


def session_boundary(contracts: DataFrame, frequency: str, layout: Layout) -> DataFrame:
    """One row: the trade-date boundary applied, in words."""
    if frequency == "daily":
        fixed = PROFILES[layout.profile]["session_boundary"] if layout.profile else (
            "column:date (taken as the session date as supplied)")
        return contracts.agg(F.lit(fixed).alias("session_boundary"))
    root = parse_symbol(F.col("contract_id"), KNOWN_ROOTS)["root"]
    opens = F.lit(None).cast("string")
    for name, *_, shape, _cycle in PRODUCTS:
        sec = SESSIONS[shape][0]
        opens = F.when(root == name, f"{sec // 3600:02d}:{sec % 3600 // 60:02d}").otherwise(opens)
    found = contracts.agg(F.sort_array(F.collect_set(opens)).alias("o"))
    return found.select(
        F.when(F.size("o") == 1, F.concat(F.lit("session_close "), F.try_element_at("o", F.lit(1)), F.lit(f" {clock.CHICAGO}")))
        .when(F.size("o") > 1, F.concat(F.lit("session_close per root ("), F.array_join("o", ", "),
                                        F.lit(f") {clock.CHICAGO}")))
        .otherwise(f"session_close 17:00 {clock.CHICAGO} (no product profile; CME-family assumed)")
        .alias("session_boundary"))
