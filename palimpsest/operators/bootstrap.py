"""Cluster bootstrap of means from a sum and a count per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_sums(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))


# The distribution function of Poisson(1) at 0, 1, ..., 7.
_EDGES = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def weighted_sums(sums: DataFrame, columns: list[str], draws: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, b, columns): the sums of ``draws`` resamples of the clusters.

    Every cluster is drawn a Poisson(1) number of times a resample, by a hash of seed, resample and cluster: the
    same draws on any cluster of machines and for all keys, no list of clusters on the driver, and one partial aggregate.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "b", F.col("cluster").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum(((F.col("u") >= e).cast("int") for e in _EDGES), F.lit(0))
    spread = sums.select(*(keys or []), "cluster", *columns, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("u", u).withColumn("w", times)
    return spread.groupBy(*(keys or []), "b").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def bootstrap_means(sums: DataFrame, draws: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, b, mean) of ``draws`` resamples of the clusters."""
    return weighted_sums(sums, ["s", "c"], draws, seed, keys).select(*(keys or []), "b", F.try_divide("s", "c").alias("mean"))


def interval(means: DataFrame, level: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    p = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("draws"), F.round(F.get(p, 0), 6).alias("ci_lo"), F.round(F.get(p, 1), 6).alias("ci_hi"))
