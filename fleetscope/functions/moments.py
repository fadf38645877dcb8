"""Epoch arithmetic on both timestamp types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. Timestamps without a zone are counted on their own calendar, so the
    session's time zone and its clock changes have no say."""
    if not isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.unix_micros(ts)
    moment = F.col(ts)
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(moment)) * 60 + F.minute(moment)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")
