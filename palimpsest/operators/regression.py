"""Least squares, mediation and equivalence from sums that Spark makes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.distributions import t_tail


def moments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per key the sums of all products of ``columns`` (with a constant), as xy_<i>_<j>, i <= j. One row a key."""
    cols = [F.lit(1.0), *map(F.col, columns)]
    some = df.na.drop(subset=columns)
    sums = [F.sum(cols[i] * cols[j]).alias(f"xy_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return some.groupBy(*(keys or [])).agg(*sums)


def _matrix(row, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = row[f"xy_{i}_{j}"]
    return m


def ols(df: DataFrame, y: str, x: list[str]) -> np.ndarray:
    """Coefficients (intercept first) from the normal equations."""
    m = _matrix(moments(df, [*x, y]).first(), len(x) + 2)
    return np.linalg.solve(m[:-1, :-1], m[:-1, -1])


def mediation(df: DataFrame, treatment: str, mediator: str, outcome: str, keys: list[str] | None = None) -> DataFrame:
    """Total c, a, b, direct c', ab and its share of c, by covariances; ab = c - c'."""
    cov = lambda p, q: F.covar_pop(p, q)
    t, m, y = treatment, mediator, outcome
    s = df.na.drop(subset=[t, m, y]).groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), cov(t, t).alias("tt"), cov(t, m).alias("tm"), cov(t, y).alias("ty"), cov(m, m).alias("mm"), cov(m, y).alias("my")
    )
    det = F.col("tt") * F.col("mm") - F.col("tm") * F.col("tm")
    s = s.withColumns({
        "c": F.try_divide("ty", F.col("tt")), "a": F.try_divide("tm", F.col("tt")),
        "b": F.try_divide(F.col("tt") * F.col("my") - F.col("tm") * F.col("ty"), det), "direct": F.try_divide(F.col("mm") * F.col("ty") - F.col("tm") * F.col("my"), det),
    }).withColumn("ab", F.col("a") * F.col("b"))
    return s.select(*(keys or []), "n", *[F.round(k, 6).alias(k) for k in ("c", "a", "b", "direct", "ab")], F.round(F.try_divide("ab", F.col("c")), 4).alias("proportion"))


def equivalence(pairs: DataFrame, diff: str, bound: float, keys: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """n, mean, sd and the two t statistics of a paired equivalence test; the p is ``equivalence_p``."""
    s = pairs.where(F.col(diff).isNotNull()).groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("m"), F.stddev_samp(diff).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    columns = {"mean_diff": F.col("m"), "sd": F.col("sd"), "t_lower": F.try_divide(F.col("m") + bound, se), "t_upper": F.try_divide(F.col("m") - bound, se)}
    return s.select(*(keys or []), "n", *[(c if digits is None else F.round(c, digits)).alias(k) for k, c in columns.items()])


def equivalence_p(t_lower: float, t_upper: float, n: int) -> float:
    return max(t_tail(t_lower, n - 1), t_tail(-t_upper, n - 1))
