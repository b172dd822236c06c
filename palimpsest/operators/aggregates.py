"""Descriptive aggregates: one pass each, with explicit pivot values and partial aggregation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.order_statistics import quantiles


def describe(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """mean, std, median, n, sem and the half-width of a 95 % interval (0 below two rows) per key."""
    n = F.count(F.lit(1))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"), n.alias("rows"))
    stats = with_quantiles(stats, df, keys, value, {"median": 0.5})
    sem = F.col("std") / F.sqrt("n")
    ci = F.when(F.col("rows") < 2, 0.0).otherwise(1.96 * F.col("std") / F.sqrt("rows"))
    return stats.select(*keys, *[F.round(c, digits).alias(c) for c in ("mean", "std", "median")], "n", F.round(sem, digits).alias("sem"), F.round(ci, digits).alias("ci95"))


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """``grouped`` (a row a group of ``df``) with exact quantiles of ``value``; NULL for a group without a value."""
    q = quantiles(df, keys, value, list(named.values())).withColumnsRenamed({k: f"{k}_q" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_q")) for k in keys])
    return grouped.join(q, same, "left").withColumns({n: F.get("q", k) for k, n in enumerate(named)}).drop("q", *[f"{k}_q" for k in keys])


def grouped_means(df: DataFrame, sets: list[list[str]], value: str, digits: int = 6) -> DataFrame:
    """Means and counts per group, per coarser group and over all, in one pass."""
    keys = sorted({k for s in sets for k in s})
    spread = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return spread.agg(F.round(F.avg(value), digits).alias("mean"), F.count(value).alias("n"))


def wide(df: DataFrame, keys: list[str], step: str, steps: list[int], value: Column) -> DataFrame:
    out = df.groupBy(*keys).pivot(step, steps).agg(value)
    return out.select(*keys, *[F.col(str(s)).alias(f"s{s}") for s in steps])


def predictability(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, P90 and P90 - P10 by linear interpolation, to four digits."""
    out = with_quantiles(df.groupBy(*keys).agg(F.avg(value).alias("m")), df, keys, value, {"low": 0.1, "high": 0.9})
    return out.select(*keys, F.round("m", 4).alias("performance"), F.round("high", 4).alias("aptitude"), F.round(F.col("high") - F.col("low"), 4).alias("unreliability"))


def degradation(df: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """First against last step of each key with two steps or more."""
    out = df.groupBy(*keys).agg(F.min_by(value, "step").alias("first"), F.max_by(value, "step").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    d = F.col("last") - F.col("first")
    return out.select(*keys, F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.when(d < -tolerance, "DEGRADED").when(d > tolerance, "IMPROVED").otherwise("STABLE").alias("pattern"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts, and shares of the row's total."""
    counts = df.groupBy(row).pivot(column, values).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(row, *[F.col(f"`{v}`").alias(f"n_{v}") for v in values], *[F.round(F.try_divide(F.col(f"`{v}`"), total), 6).alias(f"share_{v}") for v in values])


def right_closed_bins(value: Column, edges: list[float]) -> Column:
    """Index of the bin (edge, next edge] a value is in; NULL outside; the first bin includes its lower edge."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        low = (value >= edges[k]) if k == 0 else (value > edges[k])
        out = F.when(low & (value <= edges[k + 1]), k).otherwise(out)
    return out


def variance_components(df: DataFrame, subject: str, unit: str, value: str) -> DataFrame:
    """Variances between subjects, between units of a subject, and within units, with their intraclass shares."""
    units = df.groupBy(subject, unit).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    subjects = units.groupBy(subject).agg(F.avg("m").alias("sm"), F.var_samp("m").alias("sv"), F.avg("v").alias("rv"))
    parts = subjects.agg(F.var_samp("sm").alias("between"), F.avg("sv").alias("units"), F.avg("rv").alias("residual"))
    total = F.col("between") + F.col("units") + F.col("residual")
    return parts.select(*[F.round(c, 6).alias(c) for c in ("between", "units", "residual")], F.round(F.try_divide("between", total), 6).alias("icc_subject"), F.round(F.try_divide("units", total), 6).alias("icc_unit"))


def share(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Counts per key and their share within coarser keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within)), 6))
