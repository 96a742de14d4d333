"""Column expressions: normalisation, sentinels, tolerant casts.

All are built-in Catalyst expressions (no UDF), so they stay inside
whole-stage codegen and are pushed wherever Catalyst can push them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tax-id strings that mean "missing" (compared lower-cased).
MISSING_ID_SENTINELS = ("nan", "missing")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """``trim(lower(x))``; trims spaces only (tabs stay)."""
    return F.trim(F.lower(_c(c)))


def strip_quotes(c) -> Column:
    """Remove every double quote."""
    return F.regexp_replace(_c(c), '"', "")


def clean_title(c) -> Column:
    """E1 for titles: quotes removed, then ``trim(lower(.))``."""
    return clean(strip_quotes(c))


def to_double(c) -> Column:
    """String -> double, malformed -> NULL (Spark 4 ANSI ``cast`` raises)."""
    return _c(c).try_cast("double")


def is_missing_id(c) -> Column:
    """NULL, or one of the sentinel strings in any case."""
    c = _c(c)
    return c.isNull() | F.lower(c).isin(*MISSING_ID_SENTINELS)


def fallback_id(id_col, fallback_col) -> Column:
    """The id when present and not a sentinel, else the fallback column."""
    return F.when(is_missing_id(id_col), _c(fallback_col)).otherwise(_c(id_col))


def try_date(c) -> Column:
    """String -> date, malformed -> NULL."""
    return F.try_to_date(_c(c))
