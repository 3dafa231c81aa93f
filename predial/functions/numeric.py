"""Numeric and geographic Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def transverse_mercator(lat: Column, lon: Column, meridian: float = -57.0) -> tuple[Column, Column]:
    """Metres east and north on the WGS84 plane of a UTM zone, by the usual series."""
    a, f, k = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, aa = F.pow(F.tan(phi), 2), ep * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = k * n * (aa + (1 - t + c) * F.pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(aa, 5) / 120) + 500_000
    y = k * (m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(aa, 6) / 720)) + 10_000_000
    return x, y


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edge, next edge] that value lies in; null outside."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (value > low) & (value <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def normal_cdf(z: Column) -> Column:
    """Phi(z), absolute error under 1e-7 (a rational approximation; F25)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def two_sided(z: Column) -> Column:
    """The probability of a normal value at least as far from 0 as z."""
    return 2 * (1 - normal_cdf(F.abs(z)))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series at x + 8, less the logarithms of the steps."""
    y = x + 8
    terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + reduce(lambda a, b: a + b, (c / F.pow(y, 2 * i + 1) for i, c in enumerate(terms)))
    return series - reduce(lambda a, b: a + b, (F.log(x + i) for i in range(8)))


def _iterated(steps: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], result: str) -> Column:
    """A value of a state of doubles after as many steps as told, which are counted from 1."""
    state = F.struct(*(v.cast("double").alias(k) for k, v in start.items()))
    body = lambda s, i: F.struct(*(v.cast("double").alias(k) for k, v in step(s, i.cast("double")).items()))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(steps).cast("int")), state, body, lambda s: s[result])


def _apart(x: Column) -> Column:
    """x, kept away from 0 as a divisor."""
    return F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x)


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x), a > 0: by the series of its complement up to x = a + 1, by the
    continued fraction beyond. The number of terms grows with the square root of a, so that both have converged."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - lgamma(a))
    steps = 80 + 12 * F.sqrt(a)
    series = _iterated(steps, {"t": 1 / a, "s": 1 / a}, lambda s, i: {"t": s["t"] * x / (a + i), "s": s["s"] + s["t"] * x / (a + i)}, "s")

    def fraction(s: Column, i: Column) -> dict[str, Column]:
        top, low = -i * (i - a), x + 1 - a + 2 * i
        c, d = _apart(low + top / s["c"]), 1 / _apart(low + top * s["d"])
        return {"c": c, "d": d, "h": s["h"] * c * d}

    first = _apart(x + 1 - a)
    beyond = _iterated(steps, {"c": F.lit(1e300), "d": 1 / first, "h": 1 / first}, fraction, "h")
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * beyond)


def beta_lower(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction on the side where it converges fast."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x))
    steps = 80 + 6 * F.sqrt(a + b)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(s: Column, m: Column) -> dict[str, Column]:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            c, d = _apart(1 + even / s["c"]), 1 / _apart(1 + even * s["d"])
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            c2, d2 = _apart(1 + odd / c), 1 / _apart(1 + odd * d)
            return {"c": c2, "d": d2, "h": s["h"] * c * d * c2 * d2}

        first = 1 / _apart(1 - (a + b) * x / (a + 1))
        return _iterated(steps, {"c": F.lit(1.0), "d": first, "h": first}, step, "h")

    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)


def chi2_tail(x: Column, k: Column) -> Column:
    """The probability that a chi-square value with k degrees of freedom exceeds x."""
    return gamma_upper(k / 2, x / 2)


def student_two_sided(t: Column, df: Column) -> Column:
    """The two-sided probability of Student's t."""
    return beta_lower(df / 2, F.lit(0.5), df / (df + t * t))


def kolmogorov_tail(d: Column, n: Column) -> Column:
    """The probability that a Kolmogorov-Smirnov distance of n values exceeds d: the limiting distribution with three terms of
    correction in 1/sqrt(n) (Pelz and Good, 1976), whose error is of the order of 1/n squared; for large distances twice the
    one-sided limit with its first correction."""
    z = F.sqrt(n) * d
    z2 = z * z
    pi2 = math.pi**2
    total = [F.lit(0.0)] * 4
    power = lambda e: F.pow(z, e)
    for k in range(1, 13):
        m2, k2 = float((2 * k - 1) ** 2), float(k * k)
        odd, whole = F.exp(-m2 * pi2 / (8 * z2)), F.exp(-k2 * pi2 / (2 * z2))
        total[0] = total[0] + odd / z
        total[1] = total[1] + (pi2 / 4 * m2 - z2) * odd / (6 * power(4))
        second = 6 * power(6) + 2 * power(4) + (2 * power(4) - 5 * z2) * (pi2 / 4 * m2) + (1 - 2 * z2) * (pi2**2 / 16 * m2**2)
        total[2] = total[2] + second * odd / (72 * power(7)) - pi2 * k2 * whole / (36 * power(3))
        third = -30 * power(6) - 90 * power(8) + (135 * power(4) - 96 * power(6)) * (pi2 / 4 * m2) + (212 * power(4) - 60 * z2) * (pi2**2 / 16 * m2**2) + (5 - 30 * z2) * (pi2**3 / 64 * m2**3)
        total[3] = total[3] + third * odd / (6480 * power(10)) + pi2 * (3 * z2 * k2 - pi2 * k2 * k2) * whole / (216 * power(6))
    below = math.sqrt(2 * math.pi) * (total[0] + total[1] / F.sqrt(n) + total[2] / n + total[3] / (n * F.sqrt(n)))
    far = 2 * F.exp(-2 * z2 - 2 * z / (3 * F.sqrt(n)))
    return F.when(z < 0.18, 1.0).when(z > 3, far).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - below)))


def log_loss(y: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def fold_of(unit: Column, k: int = 5) -> Column:
    """The fold of a unit (LM1): the same for all its rows, from the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(unit), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
