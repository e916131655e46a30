"""Time columns as plain numbers, without depending on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; a zone-less one is read as UTC."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"cast(cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
            " as decimal(20, 6)) * 1000000 as bigint)"
        )
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    raise TypeError(f"{name} is not a timestamp column: {kind.simpleString()}")


def number_axis(df: DataFrame, name: str) -> Column:
    """A number that never decreases along the column, for cutting it into pieces."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(df, name)
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    if isinstance(kind, T.NumericType):
        return F.col(name)
    if isinstance(kind, T.StringType):
        # The first six bytes: they never decrease along the text.
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    raise TypeError(f"cannot cut along {name}: {kind.simpleString()}; order by a number or a time first")


def instant_text(micros: Column) -> Column:
    """ISO text of an instant in UTC, with the shortest of no, 3 or 6 fraction digits."""
    seconds = F.floor(micros / 1_000_000)
    fraction = F.pmod(micros, F.lit(1_000_000))
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    in_day = F.pmod(seconds, F.lit(86_400))
    clock = F.format_string(
        "%sT%02d:%02d:%02d", day,
        F.floor(in_day / 3600), F.floor(in_day / 60) % 60, in_day % 60,
    )
    digits = (
        F.when(fraction == 0, "")
        .when(fraction % 1000 == 0, F.format_string(".%03d", F.floor(fraction / 1000)))
        .otherwise(F.format_string(".%06d", fraction))
    )
    return F.concat(clock, digits, F.lit("Z"))
