"""Survival of recoveries: Kaplan-Meier with log-log intervals, log-rank, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.distributions import chi2_tail


def kaplan_meier(episodes: DataFrame, strata: list[str]) -> DataFrame:
    """Survival after each duration with its 95 % interval. One row per stratum and duration reaches the windows."""
    counts = episodes.groupBy(*strata, "duration").agg(F.sum("event_observed").alias("d"), F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*strata).orderBy("duration")
    risk = F.sum("c").over(by.rowsBetween(0, Window.unboundedFollowing))
    t = counts.withColumn("at_risk", risk)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    dead = F.col("d") == F.col("at_risk")
    log_s = F.sum(F.when(dead, 0.0).otherwise(F.ln(F.when(dead, 1.0).otherwise(1 - F.col("d") / F.col("at_risk"))))).over(upto)
    var = F.sum(F.when(dead, 0.0).otherwise(F.try_divide(F.col("d"), F.col("at_risk") * (F.col("at_risk") - F.col("d"))))).over(upto)
    t = t.withColumns({"ls": log_s, "gw": var, "ended": F.max(dead.cast("int")).over(upto)})
    s = F.when(F.col("ended") == 1, 0.0).otherwise(F.exp("ls"))
    width = F.try_divide(1.959963984540054 * F.sqrt("gw"), F.abs(F.col("ls")))
    log_log = F.ln(-F.when(F.col("ls") < 0, F.col("ls")))
    bound = lambda sign: F.when(F.col("ended") == 1, 0.0).when(F.col("ls") >= 0, 1.0).otherwise(F.exp(-F.exp(log_log + sign * width)))
    return t.select(*strata, "duration", "at_risk", F.col("d").alias("events"), F.round(s, 9).alias("survival"), F.round(bound(1), 9).alias("ci_lo"), F.round(bound(-1), 9).alias("ci_hi"))


def log_rank(episodes: DataFrame, stratum: str) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p over all strata, from counts per stratum and duration."""
    import numpy as np

    rows = episodes.groupBy(stratum, "duration").agg(F.sum("event_observed").alias("d"), F.count(F.lit(1)).alias("c")).collect()
    names, times = sorted({r[stratum] for r in rows}), sorted({r.duration for r in rows})
    d, c = np.zeros((len(names), len(times))), np.zeros((len(names), len(times)))
    for r in rows:
        d[names.index(r[stratum]), times.index(r.duration)] = r.d
        c[names.index(r[stratum]), times.index(r.duration)] = r.c
    risk = c[:, ::-1].cumsum(1)[:, ::-1]
    n, dead = risk.sum(0), d.sum(0)
    z = (d - risk * dead / n).sum(1)
    v = np.zeros((len(names), len(names)))
    for k in range(len(times)):
        if n[k] > 1:
            share = risk[:, k] / n[k]
            v += dead[k] * (n[k] - dead[k]) / (n[k] - 1) * (np.diag(share) - np.outer(share, share))
    stat = float(z[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ z[:-1])
    return stat, len(names) - 1, chi2_tail(stat, len(names) - 1)


def summary(episodes: DataFrame, window: int) -> DataFrame:
    """As published: of ``lost after one step``, censored episodes are part (``as_published``); those lost are beside it."""
    one = (F.col("duration") == 1).cast("int")
    return episodes.agg(
        F.count(F.lit(1)).alias("n_episodes"), F.median("duration").cast("double").alias("median_duration"), F.round(F.avg("event_observed"), 6).alias("share_events"),
        F.round(F.avg(one), 6).alias("lost_after_one_as_published"), F.round(F.avg(one * F.col("event_observed")), 6).alias("lost_after_one"),
        F.round(F.avg(((F.col("duration") == window) & (F.col("event_observed") == 0)).cast("int")), 6).alias("stable_full_window"),
    )
