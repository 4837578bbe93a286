"""Column functions that several operators share."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def position(text: Column) -> Column:
    """Ring position: the first 8 bytes of SHA-256 as 16 hex digits, which sort as the unsigned number does."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def position_number(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def clock(ids: Column) -> Column:
    """A clock is the sorted set of ids of the events that it covers."""
    return F.array_sort(F.array_distinct(ids))


def live(deleted: Column, expires_us: Column, now_us: Column) -> Column:
    """Not deleted, and no expiry (null) or now strictly before it."""
    return ~deleted & (expires_us.isNull() | (now_us < expires_us))
