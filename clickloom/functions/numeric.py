"""Numeric transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Wichura's published algorithm AS 241 (PPND16) for the inverse
# of the normal distribution, lowest power first; numerator and denominator of its three ranges.
PPND_MID = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
PPND_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
PPND_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def clip(x: Column, low: float, high: float) -> Column:
    """Bound ``x``; null stays null (``greatest``/``least`` alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip01(p: Column, eps: float = 1e-6, missing: float | None = None) -> Column:
    """A probability inside ``[eps, 1 - eps]``, with missing or NaN values as ``missing``."""
    known = F.when(~F.isnan(p), p)
    bounded = clip(known, eps, 1 - eps)
    return bounded if missing is None else F.coalesce(bounded, F.lit(missing))


def log_plus_one(x: Column) -> Column:
    """ln(x + 1), null where undefined."""
    return F.ln(x + 1)


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic number."""
    angle = F.pmod(x, F.lit(float(period))) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def logit(p: Column) -> Column:
    q = clip01(p)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def temper(p: Column, t: Column | float) -> Column:
    """Temperature-scaled probability."""
    return sigmoid(logit(p) / t)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def _ratio(pair: tuple[Sequence[float], Sequence[float]], x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution for ``0 < p < 1``."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    size = F.when(tail <= 5, _ratio(PPND_NEAR, tail - 1.6)).otherwise(_ratio(PPND_FAR, tail - 5))
    middle = q * _ratio(PPND_MID, F.lit(0.180625) - q * q)
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * size)
