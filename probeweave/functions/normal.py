"""Tail of the normal distribution as plain column arithmetic.

Hart's rational approximation in the form published by West (2005), good to
about 1e-15; Spark has no erf, and this stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: published coefficients, highest power first
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_cdf(z: Column) -> Column:
    """P(Z <= z)."""
    a = F.abs(z)
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)
    b = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / F.lit(SQRT_2PI)
    tail = F.when(a > 37.0, F.lit(0.0)).when(a < SPLIT, near).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    return normal_cdf(-z)
