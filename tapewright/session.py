"""Session settings and the few helpers that decide how a plan is cut or broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import RLock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many rows a side is never hinted for broadcast; the join is left to AQE.
BROADCAST_ROWS = 200_000

_scratch: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Every instant in the library is UTC, and skewed joins are split at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local master may fall back to a temporary folder, a cluster may not.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="tapewright-")
    return _scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tapewright/{app}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    A written table is columnar, is pruned by its readers and outlives any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(actions: list[Callable[[], Any]], threads: int = 8) -> list[Any]:
    """Run independent driver actions side by side, so that small jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [future.result() for future in [pool.submit(action) for action in actions]]


class shared_once(cached_property):
    """A cached property that one thread computes while the others wait for it."""

    def __get__(self, instance, owner=None):
        if instance is None or self.attrname in instance.__dict__:
            return super().__get__(instance, owner)
        with instance.__dict__.setdefault(f"_{self.attrname}_lock", RLock()):
            return super().__get__(instance, owner)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only after counting; a larger side keeps the shuffled join.

    ``counted`` has at least the rows of ``df`` and is cheaper to count.
    """
    return F.broadcast(df) if (df if counted is None else counted).limit(rows + 1).count() <= rows else df


def literal_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A constant relation the optimizer can size, from Python scalars or SQL snippets."""

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, (int, float)):
            return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    names = ", ".join(name for name, _ in fields)
    cast = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in fields)).limit(0)
    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({names})")
