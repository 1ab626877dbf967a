"""What every operator assumes of an event table: a row id, a time in microseconds, an amount, entities, a label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


@dataclass(frozen=True)
class EventSchema:
    row_id: str
    time: str
    amount: str
    label: str | None = None
    entities: tuple[str, ...] = field(default_factory=tuple)

    @property
    def reserved(self) -> tuple[str, ...]:
        return tuple(c for c in (self.row_id, self.time, "t_us", "split", self.label) if c)


def micros(df: DataFrame, column: str, unit: str = "s") -> Column:
    """Microseconds of a timestamp column (with or without a zone), or of a number of seconds, hours or days."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * DAY
    return (F.col(column) * {"s": SECOND, "h": HOUR, "d": DAY}[unit]).cast("long")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def normalise(df: DataFrame, schema: EventSchema, unit: str = "s") -> DataFrame:
    """NaN becomes null; `t_us` holds the event time once for all operators."""
    return nan_to_null(df).withColumn("t_us", micros(df, schema.time, unit))


def columns_of(df: DataFrame, *kinds: type[T.DataType], without: tuple[str, ...] = ()) -> list[str]:
    """Columns of the given types, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in without]


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return columns_of(df, T.NumericType, without=without)


def text_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return columns_of(df, T.StringType, without=without)


def feature_columns(df: DataFrame, schema: EventSchema) -> list[str]:
    """All but the reserved columns."""
    return [c for c in df.columns if c not in schema.reserved]


def uid(*columns: str) -> Column:
    """Synthetic entity: the columns' texts joined; a null is the text `nan`."""
    return F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))
