"""Statistics of counts, rates and means as column expressions.

Undefined values are null, never NaN or infinity, unless a function says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_95 = 1.959963984540054


def _d(c: Column) -> Column:
    return c.cast("double")


def two_by_two(both: Column, unit: Column, reaction: Column, total: Column) -> tuple[Column, Column, Column, Column]:
    a, u, r, n = _d(both), _d(unit), _d(reaction), _d(total)
    return a, u - a, r - a, n - u - r + a


def proportional_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a/(a+b)) / (c/(c+d)); null with an empty margin, infinite for c = 0 with a > 0."""
    return F.when((a + b <= 0) | (c + d <= 0), None).when(c <= 0, F.when(a > 0, F.lit(float("inf")))).otherwise((a / (a + b)) / (c / (c + d)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """With half a count added to each cell."""
    a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    return F.when(b * c > 0, a * d / (b * c))


def odds_ratio_interval(a: Column, b: Column, c: Column, d: Column, z: float = 1.96) -> tuple[Column, Column]:
    a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    ok = F.least(a, b, c, d) > 0
    log, half = F.log(a * d / (b * c)), z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.when(ok, F.exp(log - half)), F.when(ok, F.exp(log + half))


def yates_chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    n, r1, r2, c1, c2 = a + b + c + d, a + b, c + d, a + c, b + d
    return F.when(F.least(r1, r2, c1, c2) <= 0, 0.0).otherwise(n * F.pow(F.abs(a * d - b * c) - n / 2, 2) / (r1 * r2 * c1 * c2))


def expected_count(unit: Column, reaction: Column, total: Column) -> Column:
    return F.when(total > 0, _d(unit) * _d(reaction) / _d(total))


def signal_verdict(a: Column, unit: Column, prr: Column, chi: Column, upper: Column, bounded: Column, least: int = 3, ratio: float = 2.0, square: float = 4.0, floor: int = 2000) -> Column:
    """1 for an excess, 0 for a measured deficit, null for neither; a bounded count is never an excess."""
    return F.when(~bounded & (prr >= ratio) & (chi >= square) & (a >= least), 1).when((upper < 1.0) & (unit >= floor), 0)


def shrunk_log_ratio(observed: Column, expected: Column, alpha: float = 0.5) -> Column:
    return F.when((observed >= 0) & (expected >= 0), F.log((observed + alpha) / (expected + alpha)))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("lower", "upper", "excess", "information")]))
def gamma_interval(observed: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """95 % interval of the log ratio, chance that the ratio exceeds 1 and
    information (one over the trigamma) of a Gamma posterior with half a count
    added. Quantiles come from bisecting the tail, which is a series or a
    continued fraction; each distinct pair of counts of a batch is worked out once."""
    import math
    from functools import lru_cache

    def tail(k: float, x: float) -> float:  # upper regularised gamma
        if x < k + 1:
            term = total = 1 / k
            n = k
            while abs(term) > abs(total) * 1e-14:
                n += 1
                term *= x / n
                total += term
            return 1 - total * math.exp(-x + k * math.log(x) - math.lgamma(k)) if x > 0 else 1.0
        b, c = x + 1 - k, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - k)
            b += 2
            d = 1 / ((an * d + b) or 1e-300)
            c = (b + an / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return math.exp(-x + k * math.log(x) - math.lgamma(k)) * h

    @lru_cache(None)
    def quantile(k: float, p: float) -> float:
        lo, hi = 0.0, max(10.0, 10 * k)
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - tail(k, mid) < p else (lo, mid)
        return (lo + hi) / 2

    def trigamma(x: float) -> float:
        s = 0.0
        while x < 8:
            s += 1 / (x * x)
            x += 1
        i = 1 / (x * x)
        return s + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))

    @lru_cache(None)
    def row(o: float, e: float) -> tuple[float, float, float, float]:
        k, r = o + 0.5, e + 0.5
        return math.log(max(quantile(k, 0.025), 1e-300) / r), math.log(quantile(k, 0.975) / r), tail(k, r), 1 / trigamma(k)

    none = (None, None, None, None)
    rows = [row(float(o), float(e)) if o is not None and e is not None and o >= 0 and e >= 0 else none for o, e in zip(observed, expected)]
    return pd.DataFrame(rows, columns=["lower", "upper", "excess", "information"])


def wilson(affected: Column, at_risk: Column, z: float = 1.959964) -> tuple[Column, Column]:
    n, p = _d(at_risk), _d(affected) / _d(at_risk)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def newcombe(a1: Column, n1: Column, a2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Difference of two rates with the hybrid score interval."""
    p1, p2 = _d(a1) / _d(n1), _d(a2) / _d(n2)
    (l1, u1), (l2, u2) = wilson(a1, n1), wilson(a2, n2)
    ok = (n1 > 0) & (n2 > 0)
    diff = p1 - p2
    return (
        F.when(ok, diff), F.when(ok, diff - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2))), F.when(ok, diff + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))),
    )


def log_risk_ratio(a1: Column, n1: Column, a2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Estimate and interval; half a count is added where a cell is empty."""
    ok = (n1 > 0) & (n2 > 0) & (a1 >= 0) & (a1 <= n1) & (a2 >= 0) & (a2 <= n2)
    add = F.when(F.least(a1, n1 - a1, a2, n2 - a2) == 0, 0.5).otherwise(0.0)
    c1, t1, c2, t2 = a1 + add, n1 + 2 * add, a2 + add, n2 + 2 * add
    var = 1 / c1 - 1 / t1 + 1 / c2 - 1 / t2
    ok = ok & (var > 0)
    est, half = F.log((c1 / t1) / (c2 / t2)), Z_95 * F.sqrt(var)
    return F.when(ok, est), F.when(ok, est - half), F.when(ok, est + half)


def normal_cdf(z: Column) -> Column:
    """By a rational approximation of the error function, exact to 1.5e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def deviation(kind: Column, spread: Column, low: Column, high: Column, n: Column) -> Column:
    """A standard deviation from itself, from a standard error or from a 95 % interval."""
    k = F.lower(kind)
    return F.when(k.contains("standard deviation"), spread).when(k.contains("standard error"), F.when(n > 0, spread * F.sqrt(n))).when(
        k.contains("95"), F.when(n > 0, (high - low) / (2 * Z_95) * F.sqrt(n)))


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column, Column]:
    se = F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)
    ok = (n1 > 0) & (n2 > 0)
    return F.when(ok, m1 - m2), F.when(ok, m1 - m2 - Z_95 * se), F.when(ok, m1 - m2 + Z_95 * se)


def interval_verdict(low: Column, high: Column, std_low: Column, std_high: Column, higher_is_worse: Column, margin: float = 0.2) -> Column:
    """relief, worsening, no_effect or undecided, the interval turned so that below zero is better."""
    turn = F.when(higher_is_worse, 1.0).otherwise(-1.0)
    lo, hi = F.least(turn * low, turn * high), F.greatest(turn * low, turn * high)
    slo, shi = F.least(turn * std_low, turn * std_high), F.greatest(turn * std_low, turn * std_high)
    return F.when(hi < 0, "relief").when(lo > 0, "worsening").when((slo >= -margin) & (shi <= margin), "no_effect").otherwise("undecided")


def tempered(n: Column, cap: float = 10.0, exponent: float = 0.5) -> Column:
    return F.pow(F.least(_d(n), F.lit(float(cap))), F.lit(float(exponent)))


def pseudo_count(p: Column, most: float = 100.0) -> Column:
    return F.when(p >= 1, F.lit(float(most))).otherwise(F.least(p / (1 - p), F.lit(float(most))))


def weighted_cross_entropy(p: Column, label: Column, weight: Column, hit: float = 1.0, miss: float = 0.0, eps: float = 1e-7) -> Column:
    """Aggregate: mean loss with smoothed targets."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    t = F.when(label > 0, F.lit(hit)).otherwise(F.lit(miss))
    return F.sum(-weight * (t * F.log(q) + (1 - t) * F.log(1 - q))) / F.sum(weight)


def bernoulli_divergence(p: Column, q: Column, eps: float = 1e-7) -> Column:
    p, q = (F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x)) for x in (p, q))
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def noisy_or(activation: Column, link: Column, leak: float = 0.01) -> Column:
    """Aggregate: 1 - (1 - leak) * product of (1 - activation * link)."""
    return 1 - F.exp(F.sum(F.log1p(-activation * link)) + F.log1p(F.lit(-leak)))
