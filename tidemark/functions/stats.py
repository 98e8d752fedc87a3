"""Statistics and dates, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SHOCK_FLOOR


def strict_date(text: Column) -> Column:
    """``yyyy-m-d`` and nothing more; anything else is null."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation between order statistics; 0 for no values."""
    return F.coalesce(F.percentile(value, p), F.lit(0.0))


def shock_threshold(value: Column, q: float = 0.75, floor: float = SHOCK_FLOOR) -> Column:
    """The percentile of the non-zero values, at least ``floor``."""
    return F.greatest(F.lit(floor), F.coalesce(F.percentile(F.when(value > 0, value.cast("double")), q), F.lit(floor)))


def pearson(x: Column, y: Column) -> Column:
    """0 for under three pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0)


def binomial_right_tail(k: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(0, k), n + 1)) if n > 0 else 1.0


def retry_seconds(attempt: Column, limited: Column, cooldown: float, most: float) -> Column:
    """Exponential backoff; a rate limit waits for the cooldown at least."""
    base = F.lit(1.2) * F.pow(F.lit(2.0), attempt - 1)
    return F.least(F.lit(float(most)), F.when(limited, F.greatest(F.lit(float(cooldown)), base)).otherwise(base))
