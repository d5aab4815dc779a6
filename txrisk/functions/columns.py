"""Column expressions used by several operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from txrisk.constants import ACCOUNT_KINDS, TYPES


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def holds(condition: Column) -> Column:
    """A condition without the unknown state."""
    return F.coalesce(condition, F.lit(False))


def no_nan(column: Column) -> Column:
    """NaN as NULL: in Spark NaN is larger than any number and equal to itself,
    while the rules need every comparison with it to fail."""
    return F.when(~F.isnan(column), column)


def type_code(column: Column, unknown: Column | None = None) -> Column:
    """Position of a type in the fixed list of types."""
    code = F.when(column == TYPES[0], F.lit(0))
    for position, name in enumerate(TYPES[1:], start=1):
        code = code.when(column == name, F.lit(position))
    return code if unknown is None else code.otherwise(unknown)


def account_kind(column: Column, unknown: Column | None = None) -> Column:
    """Code of the first letter of an account name."""
    code = None
    for letter, value in ACCOUNT_KINDS.items():
        code = (F if code is None else code).when(column.startswith(letter), F.lit(value))
    return code if unknown is None else code.otherwise(unknown)


def cents(column: Column) -> Column:
    """Money as whole cents in a decimal whose sums neither round nor overflow."""
    return F.round(column * 100).cast("decimal(18,0)")


def money(cents_column: Column) -> Column:
    return cents_column.cast("double") / F.lit(100.0)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(instant(df, name))


def seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds(instant(df, name))


def instant(df: DataFrame, name: str) -> Column:
    """A timestamp column as an instant; values without a zone are taken as UTC
    whatever the zone of the session."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT"):
            column = F.convert_timezone(F.lit("UTC"), F.lit(zone), column)
        column = column.cast("timestamp")
    return column


def event_hour(name: str) -> Column:
    """Hour of the day of an event."""
    return F.hour(F.col(name))


def first_of(value: Column, bound: float) -> Column:
    """The value, but at least the bound; NULL counts as the bound."""
    return F.greatest(F.coalesce(value, F.lit(bound)), F.lit(bound))
