"""Terms and closed forms used by the distribution distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(eps))


def psi_term(base: Column, cur: Column) -> Column:
    return (cur - base) * F.log(cur / base)


def jsd_term(p: Column, q: Column) -> Column:
    """Contribution of one bin to the Jensen–Shannon divergence, natural log."""
    m = (p + q) * F.lit(0.5)
    return F.lit(0.5) * (p * F.log(p / m) + q * F.log(q / m))


def chi_square_pvalue(statistic: Column, freedom: Column) -> Column:
    """Upper tail of the chi-square distribution, from the series of the incomplete gamma function.

    Terms are summed from their logarithms. Far out in the tail, where the value is below 1e-20, it is 0;
    so the series has a number of terms that the degrees of freedom bound.
    """
    a, x = freedom.cast("double") / 2, statistic / 2
    count = F.ceil(a).cast("int")
    # ln gamma(a + 1), from a (a - 1) ... down to 1 or to gamma(1/2).
    product = F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(0.0), lambda s, k: s + F.log(a - k))
    log_gamma = product + F.when(freedom % 2 == 1, F.lit(0.5 * math.log(math.pi))).otherwise(0.0)
    first = a * F.log(x) - x - log_gamma
    steps = (x + 15 * F.sqrt(x) + 60).cast("int")
    summed = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda s, k: F.struct(
            (s["term"] + F.log(x) - F.log(a + k)).alias("term"), (s["sum"] + F.exp(s["term"] + F.log(x) - F.log(a + k))).alias("sum")
        ),
        lambda s: s["sum"],
    )
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - summed))
    far = x > a + 40 + 20 * F.sqrt(a)
    return F.when((freedom < 1) | (statistic <= 0), F.lit(1.0)).when(far, F.lit(0.0)).otherwise(p)


def kolmogorov_pvalue(statistic: Column, n: Column, m: Column | None = None) -> Column:
    """Asymptotic two-sided p-value of a Kolmogorov–Smirnov statistic.

    ``m`` given: two samples of sizes n and m; otherwise one sample of size n.
    """
    size = n.cast("double") if m is None else n.cast("double") * m.cast("double") / (n + m).cast("double")
    lam = F.sqrt(size) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k.cast("double") * k.cast("double") * lam * lam),
    )
    # The alternating series does not converge as lam → 0, where the p-value is 1.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def lattice_pvalue(reach: int, n: int, m: int) -> float:
    """Probability that a random merge of n and m values drifts apart by ``reach`` or more, counted as |i m - j n|.

    All merges are equally likely without drift. Mass moves over the lattice (i, j) one value at a time; what first comes
    as far as ``reach`` is summed up, so that small probabilities keep their digits.
    """
    if reach <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside, out = np.zeros(n + 1), 0.0
    inside[0] = 1.0
    for taken in range(n + m):  # all (i, j) with i + j = taken
        j = taken - i
        here = np.where((j >= 0) & (j <= m), inside, 0.0)
        up = here * np.maximum(n - i, 0) / (n + m - taken)
        inside = here * np.maximum(m - j, 0) / (n + m - taken)
        inside[1:] += up[:-1]
        far = np.abs(i * m - (taken + 1 - i) * n) >= reach
        out += inside[far].sum()
        inside[far] = 0.0
    return float(min(out, 1.0))


def exact_ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Exact two-sided p-value of a two-sample statistic; null sizes give null. Meant for a row per feature."""

    @F.pandas_udf("double")
    def counted(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        reached = [
            None if pd.isna(a) or pd.isna(b) or pd.isna(x) else lattice_pvalue(round(x * int(a) * int(b)), int(a), int(b)) for x, a, b in zip(d, n, m)
        ]
        return pd.Series(reached, dtype="float64")

    return counted(statistic, n, m)


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    """Normal CDF by the Abramowitz–Stegun 7.1.26 rational form (absolute error below 1.5e-7)."""
    z = (x - mean) / std / F.lit(2.0**0.5)
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    erf = F.lit(1.0) - poly * t * F.exp(-a * a)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * erf)
