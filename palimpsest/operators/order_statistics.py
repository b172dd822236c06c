"""Ranks and exact quantiles of groups of any size: no task and no buffer holds a whole group.

Ranks: rows are counted by value, so ties are one row. A sketch cuts each group's values into ranges, whose totals are
added up over the few ranges; within a range the counts are added up in a window of its own.

Quantiles: a sketch brackets each wanted order statistic by two of its grid's values, with a margin of more than its own
error. A second pass counts what lies below each bracket and, by value, what lies inside, a small share of the rows; the
statistic is then read off the exact counts. Two passes over the rows, whatever the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
GRID = 2000
#: Of the sketches: ranks are wrong by a share of at most one in so many.
ACCURACY = 10_000


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on ``keys``, null keys being equal."""
    if not keys:
        return left.crossJoin(right)  # groups over all rows: a row of ``right`` a group
    named = right.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}_of"))
        same = one if same is None else same & one
    return left.join(named, same).drop(*[f"{k}_of" for k in keys])


def cumulative(counts: DataFrame, keys: list[str], value: str, n: str = "c", ranges: int = RANGES) -> DataFrame:
    """``counts`` (keys, value, n; a row a value) with ``below``: the rows of lower values of the key."""
    if not keys:
        return cumulative(counts.withColumn("all_", F.lit(0)), ["all_"], value, n, ranges).drop("all_")
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, at, ACCURACY).alias("cuts_"))
    placed = beside(counts, cuts, keys).withColumn("range_", F.size(F.filter(F.array_distinct("cuts_"), lambda c: c < F.col(value)))).drop("cuts_")
    totals = placed.groupBy(*keys, "range_").agg(F.sum(n).alias("total_"))
    before = F.sum("total_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))  # at most ``ranges`` rows
    starts = totals.select(*keys, "range_", F.coalesce(before, F.lit(0)).alias("before_"))
    within = Window.partitionBy(*keys, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return beside(placed, starts, [*keys, "range_"]).withColumn("below", F.col("before_") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("range_", "before_")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c, rank): how many rows have each value, and the rank they share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    return cumulative(counts, keys, value).select(*keys, value, "c", (F.col("below") + (F.col("c") + 1) / 2.0).alias("rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q): the exact quantiles at ``shares``, linear between neighbours; groups without a value have no row."""
    if not keys:
        return quantiles(df.withColumn("all_", F.lit(0)), ["all_"], value, shares).drop("all_")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v_"))
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("v_", grid, ACCURACY).alias("grid_"))

    def wanted(k: int) -> Column:
        at = (F.col("n_") - 1) * F.lit(shares[k])
        low, high = F.floor(at), F.ceil(at)
        lo, hi = F.floor(low / F.col("n_") * GRID) - 2, F.ceil((high + 1) / F.col("n_") * GRID) + 2
        cell = lambda c: F.get("grid_", c.cast("int"))
        return F.struct(
            F.lit(k).alias("k"), low.cast("long").alias("low"), high.cast("long").alias("high"), (at - low).alias("part"),
            F.when(lo >= 0, cell(lo)).otherwise(F.lit(float("-inf"))).alias("lo"), F.when(hi <= GRID, cell(hi)).otherwise(F.lit(float("inf"))).alias("hi"),
        )

    brackets = sketch.select(*keys, F.array(*[wanted(k) for k in range(len(shares))]).alias("wanted_"))
    hits = F.filter("wanted_", lambda w: F.col("v_") <= w.hi)
    entry = F.transform(hits, lambda w: F.struct(w.k.alias("nth_"), F.when(F.col("v_") >= w.lo, F.col("v_")).alias("in_")))
    each = beside(rows, brackets, keys).select(*keys, F.explode(entry).alias("e_")).select(*keys, "e_.nth_", "e_.in_")
    counts = each.groupBy(*keys, "nth_", "in_").agg(F.count(F.lit(1)).alias("c_"))
    upto = F.sum("c_").over(Window.partitionBy(*keys, "nth_").orderBy(F.asc_nulls_first("in_")))  # the values of one bracket
    placed = beside(counts.withColumn("upto_", upto), brackets, keys).withColumn("w_", F.get("wanted_", F.col("nth_"))).where("in_ is not null")
    covers = lambda i: (F.col("upto_") > i) & (F.col("upto_") - F.col("c_") <= i)
    value_at = lambda i: F.max(F.when(covers(F.col(i)), F.col("in_")))
    found = placed.groupBy(*keys, "nth_").agg(value_at("w_.low").alias("low_"), value_at("w_.high").alias("high_"), F.first("w_.part").alias("part_"))
    q = F.col("low_") + F.col("part_") * (F.col("high_") - F.col("low_"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth_", q.alias("q")))), lambda x: x.q).alias("q"))
