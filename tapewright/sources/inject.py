"""A labelled defective copy of a tape.

The tape is cut into as many zones as defects are asked for, by its length, so a defect never touches
another and a short tape gets all of them. In its zone a defect takes the row of the lowest seeded hash
among those that can carry it: the pick is the same on any cluster and needs no order over the tape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import literal_table

# fixed values: defect kinds, the rule each should trip, the field it edits
KINDS = [
    ("negate_volume", "VAL.NEGATIVE_VOLUME", "volume"),
    ("swap_high_and_low", "CON.HIGH_LT_LOW", "high"),
    ("close_above_high", "CON.CLOSE_OUT_OF_RANGE", "close"),
    ("blank_close", "CMP.NULL_FIELD", "close"),
    ("decimal_shift_10x", "VAL.PRICE_MAGNITUDE", "close"),
    ("repeat_row", "UNQ.EXACT_DUPLICATE", None),
    ("conflicting_close_on_one_timestamp", "UNQ.KEY_CONFLICT", "close"),
    ("swap_adjacent_rows", "TIM.OUT_OF_ORDER", None),
    ("delete_5_consecutive_rows", "CMP.MISSING_TIMESTAMP", None),
]
RUN = 5
MIN_ROWS = 40
DELETE, SWAP = "delete_5_consecutive_rows", "swap_adjacent_rows"
COPIED = ("repeat_row", "conflicting_close_on_one_timestamp")
#: A row number takes this many bits of a pick, the hash before it the rest.
ROW_BITS = 40


class NoSite(ValueError):
    """No row of the tape can carry a defect that was asked for."""


def able(kind: str) -> Column:
    """Whether a row can carry the defect so that its rule sees it."""
    at = {
        "negate_volume": F.col("volume") > 0,
        "swap_high_and_low": F.col("high") > F.col("low"),
        "close_above_high": F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull(),
        "blank_close": F.col("close").isNotNull(),
        "decimal_shift_10x": F.col("close") > 0,
        "conflicting_close_on_one_timestamp": F.col("close").isNotNull(),
    }
    return at.get(kind, F.lit(True))


def pick_sites(tape: DataFrame, seed: int, kinds: list[str]) -> dict[str, int]:
    """A row number per kind; one row of the result per zone is all the driver sees.

    A zone ends with a row left as it is, and one that loses a run of rows is longer by that run.
    """
    last = tape.agg(F.max("source_row")).first()[0] or 0
    if last < MIN_ROWS:
        raise ValueError(f"injection needs at least {MIN_ROWS} rows")
    long_at = seed % len(kinds) if DELETE in kinds else len(kinds)
    width = (last - 2 - (RUN if DELETE in kinds else 0)) // len(kinds)
    starts = [2 + z * width + (RUN if z > long_at else 0) for z in range(len(kinds) + 1)]
    row = F.col("source_row")
    zone = F.lit(-1)
    for z, start in enumerate(starts):
        zone = F.when(row >= start, z).otherwise(zone) if z < len(kinds) else F.when(row >= start, -1).otherwise(zone)
    room = F.element_at(F.array(*[F.lit(s) for s in starts[1:]]), F.col("zone") + 1) - row
    mixed = F.shiftleft(F.xxhash64(F.lit(seed + 1), row).bitwiseAND(F.lit((1 << 63 - ROW_BITS) - 1)), ROW_BITS)
    need = {kind: RUN + 1 if kind == DELETE else 3 if kind == SWAP else 2 for kind in kinds}
    picks = tape.withColumn("zone", zone).filter("zone >= 0").groupBy("zone").agg(*[
        F.min(F.when(able(kind) & (room >= need[kind]), mixed.bitwiseOR(row.cast("bigint")))).alias(kind) for kind in kinds])
    found = {r["zone"]: r for r in picks.collect()}
    fits = {kind: [z for z in sorted(found, key=lambda z: (z + seed) % len(kinds)) if found[z][kind] is not None
                   and (kind == DELETE) == (z == long_at)] for kind in kinds}
    holder: dict[int, str] = {}

    def settled(kind: str, tried: set[int]) -> bool:
        for z in fits[kind]:
            if z not in tried:
                tried.add(z)
                if z not in holder or settled(holder[z], tried):
                    holder[z] = kind
                    return True
        return False

    lost = [kind for kind in kinds if not settled(kind, set())]
    if lost:
        raise NoSite(f"no row can carry {', '.join(lost)}")
    return {kind: found[z][kind] & ((1 << ROW_BITS) - 1) for z, kind in holder.items()}


def inject_defects(tape: DataFrame, seed: int = 20260906, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The defective tape with new row numbers, and a manifest naming each planted row.

    ``tape`` has source_row 1..n in file order. Every defect asked for is planted once, or ``NoSite``
    names those no row can carry. Row numbers move by the rows inserted or deleted before them.
    """
    kinds = [kind for kind, rule, _ in KINDS if rules is None or rule in rules]
    if not kinds:
        raise ValueError(f"no defect trips any of {rules}")
    sites = pick_sites(tape, seed, kinds)
    span = {DELETE: RUN, SWAP: 2}
    touched = literal_table(tape.sparkSession, "kind string, step int, source_row bigint", [
        (kind, step, site + step) for kind, site in sites.items() for step in range(span.get(kind, 1))])
    marked = tape.join(F.broadcast(touched), "source_row", "left")
    kind = F.col("kind")
    is_ = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    edited = marked.filter(~is_(DELETE)).withColumns({
        "volume": F.when(is_("negate_volume"), -F.col("volume")).otherwise(F.col("volume")),
        "high": F.when(is_("swap_high_and_low"), F.col("low")).otherwise(F.col("high")),
        "low": F.when(is_("swap_high_and_low"), F.col("high")).otherwise(F.col("low")),
        "close": F.when(is_("close_above_high"), F.round(F.col("high") + 5.0, 2))
        .when(is_("blank_close"), F.lit(None)).when(is_("decimal_shift_10x"), F.round(F.col("close") * 10, 2))
        .otherwise(F.col("close")),
    })
    grown = edited.withColumn("copy", F.explode(F.when(is_(*COPIED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    grown = grown.withColumn("close", F.when(is_("conflicting_close_on_one_timestamp") & (F.col("copy") == 1),
                                             F.round(F.col("close") + 1.25, 2)).otherwise(F.col("close")))
    moves = {site: -RUN if name == DELETE else 1 for name, site in sites.items() if name == DELETE or name in COPIED}
    moved = F.lit(0)
    for site, by in moves.items():
        moved = moved + F.when(F.col("source_row") > site, by).otherwise(0)
    swapped = F.when(is_(SWAP), F.when(F.col("step") == 0, 1).otherwise(-1)).otherwise(0)
    out = grown.withColumn("new_row", F.col("source_row") + F.col("copy") + swapped + moved)
    about = {name: (rule, field) for name, rule, field in KINDS}
    planted = literal_table(tape.sparkSession, "rule_id string, kind string, source_row bigint, field_name string, original_row bigint", [
        (about[name][0], name, site + sum(by for at, by in moves.items() if at < site) + (name == SWAP or name in COPIED),
         about[name][1], site) for name, site in sites.items()])
    label = F.substring(F.sha1(F.concat_ws("|", "rule_id", "kind", F.col("original_row").cast("string"))), 1, 12)
    manifest = planted.select(F.concat(F.lit("d_"), label).alias("defect_id"), *planted.columns)
    return out.select(*[c for c in tape.columns if c != "source_row"], F.col("new_row").cast("bigint").alias("source_row")), manifest
