"""Shared inputs of the registered queries: one tape, one assessed run per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.bars import build_bars
from tapewright.operators.corroborate import corroborate
from tapewright.operators.gate import session_quality, record_sessions
from tapewright.operators.patterns import find_patterns, finding_tallies, record_exposure
from tapewright.operators.scope import Scope, Tables, build_scope
from tapewright.operators.suggestions import scope_facts
from tapewright.plans import event_tape
from tapewright.plans.assess import Assessment, assess
from tapewright.session import configure, settle

SLICE = ("contract_id", "frequency")

#: Params the checks run with, so that every rule has something to find on this tape.
OVERRIDES = {
    "CON.STALE_REPEAT": {"n": 2, "n_by_root": {"ZC": 3}},
    "CMP.SPARSE_SERIES": {"min_sessions": 22},
    "VAL.EXTREME_VOLUME": {"max_plausible": {"minute": 97, "daily": 3800}},
    "REC.OHLC_DISAGREE": {"min_coverage_pct": 0.03},
}
ROLLING = {**OVERRIDES, "ROL.THIN_NEAR_EXPIRY": {"days": 10, "collapse_ratio": 1.5}}
RUN_ID, DETECTED_AT = "run-1", "2024-02-01 00:00:00"
EVEN_LIFT = 0.5
PATTERN = {"lift": 1.2, "min_support": 5, "min_periods": 2}

_envs: dict[tuple[str, str], "Env"] = {}


def env(spark: SparkSession, sf_dir: str) -> "Env":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _envs:
        _envs[key] = Env(configure(spark), sf_dir)
    configure(spark)
    return _envs[key]


class Env:
    """Everything is lazy; what several queries read is written once to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tape(self) -> DataFrame:
        return settle(event_tape.event_records(self.spark, self.sf_dir), "tape")

    @cached_property
    def weekdays(self) -> DataFrame:
        return event_tape.weekday(self.tape)

    @cached_property
    def contracts(self) -> DataFrame:
        return settle(event_tape.event_contracts(self.tape), "contracts")

    @cached_property
    def batches(self) -> DataFrame:
        return event_tape.event_batches(self.spark)

    def tables(self, records: DataFrame, **extra) -> Tables:
        return Tables(records, self.contracts, self.batches, **extra)

    @cached_property
    def whole(self) -> Scope:
        return build_scope(self.spark, self.tables(self.tape), overrides=OVERRIDES)

    @cached_property
    def rolling(self) -> Scope:
        return build_scope(self.spark, self.tables(self.weekdays), overrides=ROLLING)

    @cached_property
    def first_bars(self) -> DataFrame:
        """Bars of the build before the run: nothing has been decided yet."""
        return settle(build_bars(self.weekdays, None, ("clean",)), "first-bars")

    @cached_property
    def scope(self) -> Scope:
        return build_scope(self.spark, self.tables(self.weekdays, bars=self.first_bars), overrides=OVERRIDES)

    @cached_property
    def run(self) -> Assessment:
        return assess(self.scope, run_id=RUN_ID, detected_at=DETECTED_AT)

    @cached_property
    def findings(self) -> DataFrame:
        return self.run.findings

    @cached_property
    def actions(self) -> DataFrame:
        return settle(self.run.actions, "actions")

    @cached_property
    def metrics(self) -> DataFrame:
        return settle(self.run.metrics, "metrics")

    @cached_property
    def dimensions(self) -> DataFrame:
        return settle(self.run.dimensions, "dimensions")

    @cached_property
    def scores(self) -> DataFrame:
        from tapewright.operators.scoring import overall_score
        return settle(overall_score(self.scope, self.dimensions), "scores")

    @cached_property
    def bars(self) -> DataFrame:
        return settle(build_bars(self.tape, self.actions), "bars")

    @cached_property
    def quality(self) -> DataFrame:
        return settle(session_quality(record_sessions(self.tape), self.findings), "quality")

    @cached_property
    def patterns(self) -> DataFrame:
        return settle(find_patterns(
            record_exposure(self.tape, self.batches),
            finding_tallies(self.findings, self.tape, self.batches), **PATTERN), "patterns")

    @cached_property
    def even_patterns(self) -> DataFrame:
        """Patterns down to even concentration: both grains quote off the tick on this tape."""
        return find_patterns(
            record_exposure(self.tape, self.batches),
            finding_tallies(self.findings, self.tape, self.batches), **{**PATTERN, "lift": EVEN_LIFT})

    @cached_property
    def slice_patterns(self) -> DataFrame:
        return settle(find_patterns(
            record_exposure(self.tape, self.batches, SLICE),
            finding_tallies(self.findings, self.tape, self.batches, SLICE), SLICE, **PATTERN), "slice-patterns")

    @cached_property
    def facts(self) -> DataFrame:
        return settle(scope_facts(self.weekdays, self.contracts), "facts")

    @cached_property
    def corroboration(self) -> DataFrame:
        return settle(corroborate(self.findings, self.metrics, self.weekdays,
                                  OVERRIDES["REC.OHLC_DISAGREE"]["min_coverage_pct"]), "corroboration")


def r6(value: Column) -> Column:
    """Six places; the nudge keeps a decimal tie from falling either way on two engines."""
    return F.round(value + 1e-9, 6)


def plain(df: DataFrame) -> DataFrame:
    """Compare-ready columns: text dates and instants, bigint, rounded doubles, flat arrays."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = r6(c.cast("double"))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        elif isinstance(kind, T.NullType):
            c = c.cast("string")
        cols.append(c.alias(field.name))
    return df.select(*cols)
