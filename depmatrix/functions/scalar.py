"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_safe(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or missing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def plain_label(c: Column) -> Column:
    """A label without its leading number ('3. Pump' becomes 'Pump'), trimmed."""
    return F.trim(F.regexp_replace(F.trim(c), r"^\d+[.\s]+", ""))


def mark(c: Column) -> Column:
    """A cell's weight: X, a tick and YES count as 1, numbers as they are, anything else as 0."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("X", "✓", "YES"), F.lit(1.0)).otherwise(F.coalesce(t.try_cast("double"), F.lit(0.0)))
