"""Numeric helpers that make Spark agree with the reference's arithmetic.

Rule used everywhere: sum in DECIMAL (exact), divide in DOUBLE, round with
``round_half_away`` and cast final columns explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x) -> Column:
    return _c(x).cast("double")


def round_half_away(x, n: int = 0) -> Column:
    """ROUND(double, n) as ``round(x * 10^n) / 10^n`` evaluated in double.

    Rounding the scaled value to an integer is exact-tie safe; rounding a double
    straight to n digits goes through its decimal text and disagrees on ties.
    """
    m = F.lit(float(10 ** n))
    return F.round(_c(x).cast("double") * m, 0) / m


def py_round0(x) -> Column:
    """Python's ``round(x)`` (0 digits, ties to even)."""
    return F.bround(_c(x).cast("double"), 0)


def py_round(x, n: int) -> Column:
    """Python's ``round(x, n)`` of a double: half-even on its exact binary value, so 2.675 gives 2.67.

    The scaled value is kept whole as the double ``p`` plus the error ``e`` of the product (each factor split into
    halves of 26 bits, whose products are exact). Only where ``p`` is halfway between two integers does ``e``
    decide. From 2^53 on, neighbouring doubles are wider apart than the last digit and ``x`` stays as it is."""
    if not 0 <= n <= 15:
        raise ValueError("between 0 and 15 digits")
    m, split = float(10**n), 134217729.0  # 2^27 + 1
    m_hi = m * split - (m * split - m)
    m_lo = m - m_hi

    def rounded(s: Column) -> Column:
        v, p, hi = s["v"], s["p"], s["hi"]
        e = ((hi * F.lit(m_hi) - p) + hi * F.lit(m_lo) + (v - hi) * F.lit(m_hi)) + (v - hi) * F.lit(m_lo)
        near = F.rint(p)
        up = F.when((p - near == 0.5) & (e > 0), near + 1.0).when((p - near == -0.5) & (e < 0), near - 1.0).otherwise(near)
        return F.when(F.abs(p) >= F.lit(float(2**53)), v).otherwise(up / F.lit(m))

    # Lambdas bind each part once; written out, nested roundings would repeat their arguments many times over.
    parts = F.transform(F.array(_c(x).cast("double")), lambda v: F.struct(
        v.alias("v"), (v * F.lit(m)).alias("p"), (v * F.lit(split) - (v * F.lit(split) - v)).alias("hi")))
    return F.get(F.transform(parts, rounded), 0)


def avg_exact(x) -> Column:
    """AVG that is identical across engines: exact SUM, then one double division.

    NULL when there is no non-null input (``try_divide`` avoids the ANSI error).
    """
    c = _c(x)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))

