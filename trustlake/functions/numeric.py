"""Rounding, clamping and the Kolmogorov tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic.

    The nudge of 1e-7 of the last kept digit sends a tie upwards even when summation order left it
    one ulp below, so the result does not depend on how Spark split the aggregation.
    """
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5000001)) / F.lit(scale)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column, what: str) -> Column:
    """``x`` unless it is NaN or infinite, which fails the job: statistics over it have no meaning."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"{what} contains non-finite values")).cast("double")).otherwise(x)


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value; the alternating series is cut after 100 terms."""
    n, m = n.cast("double"), m.cast("double")
    size = F.sqrt(n * m / (n + m))
    lam = (size + F.lit(0.12) + F.lit(0.11) / size) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * F.pow(k * lam, F.lit(2.0))),
    )
    return F.when(d <= 0, 1.0).when(lam > 4.0, 0.0).otherwise(clamp(series))
