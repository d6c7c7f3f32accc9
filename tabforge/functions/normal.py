"""Normal distribution functions as Spark column expressions (no erf in Spark SQL).

Fixed values: published rational-approximation coefficients.
- CDF: Abramowitz & Stegun 26.2.17 (absolute error < 7.5e-8).
- Quantile: P. J. Acklam's algorithm (relative error < 1.15e-9).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (A&S 26.2.17)
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Fixed values (Acklam)
ACK_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACK_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACK_LOW = 0.02425


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_cdf(z: Column) -> Column:
    az = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * az)
    pdf = F.exp(-az * az / 2) / F.lit(math.sqrt(2 * math.pi))
    poly = t * _horner(t, AS_B[::-1])  # b1 t + b2 t^2 + ... + b5 t^5
    upper = F.lit(1.0) - pdf * poly
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal CDF for p in (0, 1)."""
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lo = _horner(q_lo, ACK_C) / (_horner(q_lo, ACK_D) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    hi = -_horner(q_hi, ACK_C) / (_horner(q_hi, ACK_D) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = _horner(r, ACK_A) * q / (_horner(r, ACK_B) * r + F.lit(1.0))
    return F.when(p < ACK_LOW, lo).when(p > 1 - ACK_LOW, hi).otherwise(mid)
