"""Two-arm and contingency statistics as Columns; p-values by a small vectorised function over final rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stateroll.functions.exprs import safe_div


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def rate_stderr(rate: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(rate * (1 - rate) / n)).otherwise(0.0)


def lift(test: Column, control: Column) -> Column:
    return safe_div(test - control, control)


def katz_interval(x1: Column, n1: Column, x2: Column, n2: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Log interval of the relative lift of arm 1 over arm 2; the lift itself at both ends where it isn't finite."""
    r1, r2 = safe_div(x1, n1), safe_div(x2, n2)
    point = F.when(r2 == 0, 0.0).otherwise(lift(r1, r2))
    ok = (x1 > 0) & (x2 > 0) & (n1 > 0) & (n2 > 0)
    se = F.sqrt(F.greatest(F.try_divide(F.lit(1.0), x1) - F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), x2) - F.try_divide(F.lit(1.0), n2), F.lit(0.0)))
    z = z_value(level)
    rr = safe_div(r1, r2)
    return F.when(ok, rr * F.exp(-z * se) - 1).otherwise(point), F.when(ok, rr * F.exp(z * se) - 1).otherwise(point)


def wilson(x: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = z_value(level)
    p = safe_div(x, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / den
    bound = lambda v: F.when(n > 0, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return bound(mid - half), bound(mid + half)


def difference_interval(x1: Column, n1: Column, x2: Column, n2: Column, level: float = 0.95) -> tuple[Column, Column]:
    a, b = wilson(x1, n1, level), wilson(x2, n2, level)
    return a[0] - b[1], a[1] - b[0]


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Two-proportion z; 0 where a count or total is zero or the variance isn't positive."""
    pool = F.try_divide(x1 + x2, n1 + n2)
    var = pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    ok = (x1 > 0) & (x2 > 0) & (n1 > 0) & (n2 > 0) & (var > 0)
    return F.when(ok, F.try_divide(safe_div(x1, n1) - safe_div(x2, n2), F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(0.0)


def _normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.0 if v == 0 else math.erfc(abs(v) / math.sqrt(2)))


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a z value; 0 for z = 0, which stands for no test."""
    return F.pandas_udf(_normal, "double")(z)


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail: the regularised upper incomplete gamma function, by series or continued fraction."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, y = dof / 2, x / 2
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= y / n
            total += term
        return 1 - total * scale
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def _chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else 0.0 if v == 0 else chi2_tail(float(v), int(d)) for v, d in zip(x, dof, strict=True)], dtype="float64")


def chi2_p(x: Column | str, dof: Column | str) -> Column:
    """Upper-tail p; 0 for a statistic of 0, which stands for no test."""
    return F.pandas_udf(_chi2, "double")(x, dof)


def contingency(df: DataFrame, keys: list[str], variant: str, positives: str, negatives: str, level: float = 0.95) -> DataFrame:
    """Over the variants of each key group: chi2, g, dof, odds ratio with its interval (two variants), and z.

    Rows with a zero cell are left out; fewer than two rows: all 0. z compares the variants in their order.
    """
    rows = df.groupBy(*keys, variant).agg(F.sum(positives).cast("double").alias("p"), F.sum(negatives).cast("double").alias("n")).where("p > 0 AND n > 0")
    cells = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(variant).cast("string").alias("v"), "p", "n"))).alias("c"), F.sum("p").alias("sp"), F.sum("n").alias("sn"), F.count(F.lit(1)).alias("r"))
    share = F.col("sp") / (F.col("sp") + F.col("sn"))

    def over(f) -> Column:
        one = lambda c: f(c["p"], (c["p"] + c["n"]) * share) + f(c["n"], (c["p"] + c["n"]) * (1 - share))
        return F.when(F.col("r") >= 2, F.aggregate("c", F.lit(0.0), lambda t, c: t + one(c))).otherwise(0.0)

    a, b = F.try_element_at("c", F.lit(1)), F.try_element_at("c", F.lit(2))
    two = F.col("r") == 2
    ratio = F.when(two, a["p"] * b["n"] / (a["n"] * b["p"])).otherwise(0.0)
    se = F.sqrt(1 / a["p"] + 1 / a["n"] + 1 / b["p"] + 1 / b["n"])
    z = z_value(level)
    return cells.select(
        *keys, F.col("r").alias("variants"), F.greatest(F.col("r") - 1, F.lit(0)).cast("int").alias("dof"), over(lambda o, e: (o - e) * (o - e) / e).alias("chi2"), over(lambda o, e: 2 * o * F.ln(o / e)).alias("g_stat"),
        ratio.alias("odds_ratio"), F.when(two, F.exp(F.ln(ratio) - z * se)).otherwise(0.0).alias("odds_low"), F.when(two, F.exp(F.ln(ratio) + z * se)).otherwise(0.0).alias("odds_high"),
        F.when(two, pooled_z(a["p"], a["p"] + a["n"], b["p"], b["p"] + b["n"])).otherwise(0.0).alias("z"),
    )
