"""Normal tail probability as a column expression."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, functions as F

SERIES_UP_TO = 2.0  # below, the series of erf converges fast; above, the continued fraction of erfc does
TERMS = 60


def erfc_positive(x: Column) -> Column:
    """Complementary error function for x >= 0.

    1 - 2x/sqrt(pi) e^(-x^2) (1 + 2x^2/3 (1 + 2x^2/5 (1 + ...))) for small x, and
    e^(-x^2)/sqrt(pi) / (x + 1/2/(x + 2/2/(x + 3/2/(x + ...)))) for large x, both
    from the innermost term outwards.
    """
    inwards = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(inwards, F.lit(1.0), lambda inner, k: 1 + 2 * x * x / (2 * k + 1) * inner)
    fraction = F.aggregate(inwards, x.cast("double"), lambda inner, k: x + k / F.lit(2.0) / inner)
    small = 1 - F.lit(2 / sqrt(pi)) * x * F.exp(-x * x) * series
    large = F.exp(-x * x) / (F.lit(sqrt(pi)) * fraction)
    return F.when(x < SERIES_UP_TO, small).otherwise(large)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return erfc_positive(F.abs(z) / F.sqrt(F.lit(2.0)))
