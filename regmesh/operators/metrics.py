"""Metric frames: scalar statistics as a ``(metric string, value bigint)`` DataFrame.

The reference prints each number with its own action (one job per number,
each re-reading the input).  Here a report's numbers come from one or a few
aggregations: a one-row wide aggregate is turned into long form with
``unpivot``, so the caller pays one job for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame, kind: str = "bigint") -> DataFrame:
    """One-row wide frame -> ``(metric, value)`` rows of type ``kind``, column order kept."""
    cols = wide.columns
    w = wide.select(*[F.col(c).cast(kind).alias(c) for c in cols])
    return w.unpivot([], cols, "metric", "value")
