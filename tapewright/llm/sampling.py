"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE = 1_000_000


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About the ``most`` rows with the smallest hash of ``key``, never more.

    A threshold on the hash, set from the number of rows, lets through half as many again, so that the ordered limit
    gathers a bounded number of rows however many tasks read the table.
    """
    total = rows.count()
    share = -(-_SCALE * 3 * most // (2 * max(1, total)))
    h = F.pmod(F.xxhash64(key), F.lit(_SCALE))
    return rows.where(h < share).orderBy(F.xxhash64(key), *rows.columns).limit(most)
