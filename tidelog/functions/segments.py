"""Names and bounds of log segments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_BYTES = 1 << 32
NAME = r"^[0-9a-f]{24}\.wal$"


def segment_name(lsn: Column, segment_size: int, timeline: int = 0) -> Column:
    """hex8(timeline) hex8(number of the logical log) hex8(number of the segment in it) .wal"""
    number = F.floor(F.pmod(lsn, F.lit(LOG_BYTES)) / F.lit(segment_size))
    return F.format_string("%08x%08x%08x.wal", F.lit(timeline).cast("bigint"), F.shiftright(lsn, 32), number)


def ends_after(name: Column, file_size: Column, segment_size: int, lsn: Column) -> Column:
    """Whether a segment can hold records from `lsn` on; false for a file of another name. Log numbers
    beyond 2^31 need 38 digits."""
    part = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("decimal(38,0)")
    end = part(9) * F.lit(LOG_BYTES).cast("decimal(20,0)") + part(17) * F.lit(segment_size).cast("decimal(10,0)") + file_size.cast("decimal(20,0)")
    return F.when(name.rlike(NAME), lsn.cast("decimal(20,0)") < end).otherwise(False)
