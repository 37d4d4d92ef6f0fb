"""Small Column helpers. Null is the only missing value; NaN never leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round to six digits; adding 0.0 turns negative zero into zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def r4(c) -> Column:
    return F.round(col(c).cast("double"), 4) + F.lit(0.0)


def div(a, b) -> Column:
    """Null instead of an error when the divisor is zero (ANSI mode is on)."""
    return F.try_divide(col(a), col(b))


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def compound(c) -> Column:
    """Aggregate: product of (1 + r) minus one, nulls count as zero return.

    A return of -1 or less has no logarithm; the product is then -1.
    """
    r = F.coalesce(col(c), F.lit(0.0))
    safe = F.when(r > -1.0, F.log1p(F.when(r > -1.0, r)))
    return F.when(F.min(r) <= -1.0, F.lit(-1.0)).otherwise(F.exp(F.sum(safe)) - 1.0)


def log1p_or_zero(c) -> Column:
    r = F.coalesce(col(c), F.lit(0.0))
    return F.log1p(F.when(r > -1.0, r).otherwise(F.lit(-1.0 + 1e-12)))


def sign_text(c) -> Column:
    return F.when(col(c) > 0, "+").when(col(c) < 0, "-").otherwise("0")


def grid(values, name: str, dtype: str = "double") -> Column:
    """A fixed list of parameters as an exploding column (never a join)."""
    return F.explode(F.array(*[F.lit(v).cast(dtype) for v in values])).alias(name)
