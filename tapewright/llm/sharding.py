"""Consistent-hash ring with virtual nodes and bounded loads.

Rows hash to cells of a fixed ring. A shard owns the arcs that end at its virtual nodes and takes its own
rows up to its capacity; rows beyond it continue clockwise to the next shard with room. Rows of one cell
are alike to the ring, so this is decided on cell counts: at most ``CELLS * SALTS`` numbers, whatever the
data. The rows then learn their shard from their rank in the cell. Everything on the row path is
DataFrame code.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.session import settle

CELLS = 4096
SALTS = 16


def preferences(shards: int, vnodes: int) -> list[list[int]]:
    """For each cell the shards in the order their virtual nodes come clockwise."""
    if not 1 <= shards * vnodes <= CELLS:
        raise ValueError(f"between 1 and {CELLS} virtual nodes fit the ring")
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = shard
    ring = [at.get(cell % CELLS) for cell in range(2 * CELLS)]
    order: list[int] = []
    out: list[list[int]] = [[]] * CELLS
    for cell in range(2 * CELLS - 1, -1, -1):
        if ring[cell] is not None:
            order = [ring[cell]] + [s for s in order if s != ring[cell]]
        if cell < CELLS:
            out[cell] = order
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """``ceil((1 + slack) * mean)`` each; without slack the floor or one more, so that all fill up."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def spill_clockwise(counts: dict[int, int], shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """``(unit, lo, hi, shard, slot)``: ranks lo to hi - 1 of a unit go to a shard, from that slot on."""
    prefer = preferences(shards, vnodes)
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    left = dict(sorted(counts.items()))
    done = dict.fromkeys(left, 0)
    plan = []
    for turn in range(shards):
        for unit in [u for u, n in left.items() if n]:
            shard = prefer[unit // SALTS][turn]
            take = min(left[unit], room[shard])
            if take:
                plan.append((unit, done[unit], done[unit] + take, shard, used[shard]))
                done[unit] += take
                left[unit] -= take
                room[shard] -= take
                used[shard] += take
    return plan


def place(rows: DataFrame, key: Column, shards: int, *, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` decides the place on the ring; null is a key like any other. Without slack the shard sizes
    differ by one row at most, with slack no shard holds more than ``ceil((1 + slack) * mean)`` rows.
    Repeated rows are placed one by one; an empty table gives no rows. Columns of ``rows`` named
    ``shard``, ``slot`` or like ``_ring_*`` are refused.

    The rows are written once to the shared folder, so that counting and placing see the same salt: the
    salt cuts a cell that one key fills into ``SALTS`` parts. Pass narrow rows.
    """
    if clash := {c for c in rows.columns if c in ("shard", "slot") or c.startswith("_ring_")}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    spark = rows.sparkSession
    keyed = settle(rows.withColumn("_ring_at", F.xxhash64(key)).withColumn(
        "_ring_unit", F.pmod(F.col("_ring_at"), F.lit(CELLS)).cast("int") * SALTS
        + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "ring")
    counts = {r[0]: r[1] for r in keyed.groupBy("_ring_unit").count().collect()}
    plan = spark.createDataFrame(
        spill_clockwise(counts, shards, vnodes, slack),
        "_ring_unit int, _ring_lo long, _ring_hi long, shard int, _ring_slot long")
    order = Window.partitionBy("_ring_unit").orderBy("_ring_at", *rows.columns)
    ranked = keyed.withColumn("_ring_rank", F.row_number().over(order).cast("long") - 1)
    held = F.col("_ring_rank") >= F.col("_ring_lo"), F.col("_ring_rank") < F.col("_ring_hi")
    return (
        ranked.join(F.broadcast(plan).withColumnRenamed("_ring_unit", "_ring_u"),
                    [F.col("_ring_unit") == F.col("_ring_u"), *held])
        .select(*rows.columns, "shard", (F.col("_ring_slot") + F.col("_ring_rank") - F.col("_ring_lo")).alias("slot"))
    )
