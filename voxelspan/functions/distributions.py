"""Tails of distributions as columns, for a row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf2(z: Column) -> Column:
    """Two-sided tail of the normal distribution (series and rational form of erfc, relative error below 1.2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 10, brought back by the recurrence."""
    y = x + 10
    below = sum((F.ln(x + k) for k in range(1, 10)), F.ln(x))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - below


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """Regularised incomplete beta function by its continued fraction, taken from the side where it converges; a and b up to some thousands."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, u = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    given = F.struct(p.alias("p"), q.alias("q"), u.alias("u"))
    tiny = 1e-300

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(g: Column) -> Column:
        start = 1 / safe(1 - (g["p"] + g["q"]) * g["u"] / (g["p"] + 1))
        zero = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))

        def term(s: Column, of: Column) -> Column:
            d, c = 1 / safe(1 + of * s["d"]), safe(1 + of / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        def step(s: Column, m: Column) -> Column:
            even = m * (g["q"] - m) * g["u"] / ((g["p"] + 2 * m - 1) * (g["p"] + 2 * m))
            odd = -(g["p"] + m) * (g["p"] + g["q"] + m) * g["u"] / ((g["p"] + 2 * m) * (g["p"] + 2 * m + 1))
            once = F.transform(F.array(term(s, even)), lambda t: term(t, odd))
            return F.get(once, F.lit(0))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)["h"]

    held = F.get(F.transform(F.array(given), fraction), F.lit(0))
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(u) + q * F.ln(1 - u)) / p
    part = F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(front * held)
    return F.when(turn, 1 - part).otherwise(part)


def student_sf2(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t; null without degrees of freedom. Above 1000 of them by Hill's expansion of the normal deviate (relative error below 1e-6)."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    few = F.least(df, F.lit(1000.0))
    exact = incomplete_beta(few / (few + t * t), few / 2, F.lit(0.5))
    a = df - 0.5
    z = F.sqrt(a * F.log1p(t * t / df))
    deviate = z + (F.pow(z, F.lit(3.0)) + 3 * z) / (48 * a * a)
    return F.when(df <= 0, None).when(t == float("inf"), 0.0).when(df <= 1000, exact).otherwise(normal_sf2(deviate))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation of n pairs; null for fewer than three, 0 for a perfect one."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(student_sf2(t, n - 2))


def rank_sum_counts(n1: int, n0: int) -> np.ndarray:
    """Shares of the orders of n1 and n0 values with U = 0, 1, ..: one value of the first group after the other, by generating functions."""
    out = np.zeros(n1 * n0 + 1)
    out[0] = 1.0
    for k in range(1, n1 + 1):  # times (1 - x^(n0 + k)) / (1 - x^k), over its value at 1
        up = n0 + k
        if up < len(out):
            out[up:] = out[up:] - out[:-up]
        for at in range(k):
            out[at::k] = np.cumsum(out[at::k])
        out *= k / up
    return np.maximum(out, 0.0)


def rank_sum_sf2(u: Column, n1: Column, n0: Column, most: int = 50) -> Column:
    """Exact two-sided p of Mann-Whitney's U without ties; null where a group is empty or larger than ``most``."""

    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        held: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for x, a, b in zip(u, n1, n0, strict=True):
            if x != x or x is None or not 0 < a <= most or not 0 < b <= most:
                out.append(None)
                continue
            key = (int(min(a, b)), int(max(a, b)))
            if key not in held:
                held[key] = np.cumsum(rank_sum_counts(*key))
            out.append(min(1.0, 2 * float(held[key][int(min(x, a * b - x))])))
        return pd.Series(out, dtype="float64")

    return tail(u, n1, n0)
