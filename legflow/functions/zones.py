"""Local wall-clock times to instants, with the later reading of a doubled hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_epoch(local: Column, zone: str) -> Column:
    """Epoch seconds of a local timestamp: in the doubled hour of autumn the later instant, in the lost hour of spring the one
    after the gap. The session's zone must be UTC."""
    u = F.to_utc_timestamp(local, zone)
    later = F.timestamp_seconds(F.unix_seconds(u) + 3600)
    return F.when(F.from_utc_timestamp(later, zone) == local, F.unix_seconds(later)).otherwise(F.unix_seconds(u))
