"""Time helpers that never depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wall_clock_as_utc(c: Column) -> Column:
    """A TIMESTAMP_NTZ wall clock as the TIMESTAMP instant with the same reading in UTC, rebuilt field
    by field: a cast (or a function that casts implicitly, such as ``timestamp_diff``) would go
    through the session time zone and shift wall-clock times inside a DST gap."""
    return F.make_timestamp_ltz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 of ``col`` as stored, independent of the session time zone.

    TIMESTAMP: the instant.  TIMESTAMP_NTZ and DATE: the wall clock read as UTC.  Numbers: epoch
    seconds.  Strings: epoch seconds when numeric; an ISO timestamp with an explicit zone (``Z`` or
    ``+hh:mm``) is the instant it names; any other ISO timestamp is a wall clock read as UTC.
    Unparsable text, NaN, infinities and out-of-range values give NULL.
    """
    c = F.col(col)
    kind = df.schema[col].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.unix_micros(_wall_clock_as_utc(c))
    if kind == "date":
        return F.unix_micros(_wall_clock_as_utc(c.cast("timestamp_ntz")))
    if kind == "string":
        secs = c.try_cast("double")
        zoned = c.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
        instant = F.unix_micros(c.try_cast("timestamp"))  # the string's own zone, not the session's
        wall = F.unix_micros(_wall_clock_as_utc(c.try_cast("timestamp_ntz")))
        return (F.when(secs.isNotNull(), (secs * 1e6).try_cast("long"))
                .when(zoned, instant).otherwise(wall))
    return (c.cast("double") * 1e6).try_cast("long")


def as_instant(df: DataFrame, col: str) -> Column:
    """``col`` as a TIMESTAMP whose epoch is ``epoch_micros`` (for event-time operators)."""
    if df.schema[col].dataType.typeName() == "timestamp":
        return F.col(col)
    return F.timestamp_micros(epoch_micros(df, col))
