"""Score arithmetic (FN-8, AGG-8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Term weights are summed as whole units of 1e-12, so that a score does not
# depend on the order in which partial sums meet.
UNITS = 1_000_000_000_000


def idf_weight(df: Column, n: Column) -> Column:
    """FN-8."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weight_units(weight: Column) -> Column:
    return F.round(weight * F.lit(float(UNITS)), 0).cast("long")


def coverage(matched: Column, total: Column) -> Column:
    """AGG-8: matched share of all term weight, 0 where there is none."""
    return F.when(total > 0, matched.cast("double") / total.cast("double")).otherwise(0.0)
