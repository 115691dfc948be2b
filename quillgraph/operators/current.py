"""The current row of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(rows: DataFrame, *columns: str, key: str = "id", version: str = "updated_at") -> DataFrame:
    """``key`` and ``columns`` of the row with the greatest ``version`` per key.

    Ties are copies; if they are not, the greatest row holds, so the result is the same on every run. A null
    version is the least; rows without a key are none. The maximum combines map-side, so a key with very
    many rows reaches its reducer as one row per map task.
    """
    best = F.max(F.struct(version, *[c for c in columns if c != version])).alias("best")
    picked = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best)
    return picked.select(key, *[F.col(f"best.{c}").alias(c) for c in columns])
