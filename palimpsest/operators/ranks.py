"""Rank tests from sums that Spark makes; p-values of the few resulting rows are finished by ``distributions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.order_statistics import beside, cumulative, value_ranks


def friedman(wide: DataFrame, steps: list[int], keys: list[str] | None = None) -> DataFrame:
    """chi2 of complete subjects (columns s<step>), with the tie correction, and its degrees of freedom, per key.

    The ranks of a subject come from its own row, so nothing is shuffled but one row of sums a task.
    """
    keys = keys or []
    k = len(steps)
    cols = [F.col(f"s{s}") for s in steps]
    below = lambda c: sum(((o < c).cast("int") for o in cols), F.lit(0))
    same = lambda c: sum(((o == c).cast("int") for o in cols), F.lit(0))
    ranks = [(below(c) + (same(c) + 1) / 2.0).alias(f"r{s}") for c, s in zip(cols, steps, strict=True)]
    ties = sum((same(c) * same(c) - 1 for c in cols), F.lit(0)).alias("ties")  # sum over groups of t^3 - t
    sums = wide.select(*keys, *ranks, ties).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("ties").alias("ties"), *[F.sum(f"r{s}").alias(f"r{s}") for s in steps])
    squares = sum((F.col(f"r{s}") * F.col(f"r{s}") for s in steps), F.lit(0.0))
    plain = 12.0 / (F.col("n") * k * (k + 1)) * squares - 3.0 * F.col("n") * (k + 1)
    correct = 1 - F.col("ties") / (F.col("n") * k * (k * k - 1.0))
    return sums.select(*keys, "n", F.try_divide(plain, correct).alias("chi2"), F.lit(k - 1).alias("df"))


def wilcoxon(pairs: DataFrame, keys: list[str], diff: str, zeros: str = "wilcox") -> DataFrame:
    """n, w_plus, w_minus, z, rank-biserial (signed, and one minus the scaled lesser sum) per key.

    ``zeros``: ``wilcox`` drops zero differences, ``zsplit`` ranks them and gives each side half.
    """
    d = pairs.where(F.col(diff).isNotNull()).withColumn("_d", F.col(diff))
    if zeros == "wilcox":
        d = d.where("_d <> 0")
    by_size = d.groupBy(*keys, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("_d") > 0).alias("_p"), F.count_if(F.col("_d") < 0).alias("_m"))
    ranked = cumulative(by_size, keys, "_a").withColumn("_r", F.col("below") + (F.col("c") + 1) / 2.0)
    half = F.when(F.col("_a") == 0, F.col("c") * F.col("_r") / 2).otherwise(0.0)
    sums = ranked.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("_p") * F.col("_r") + half).alias("w_plus"), F.sum(F.col("_m") * F.col("_r") + half).alias("w_minus"),
        F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("ties"), F.coalesce(F.sum(F.when(F.col("_a") == 0, F.col("c"))), F.lit(0)).alias("n0"),
    )
    n = F.col("n")
    n0 = F.col("n0")
    var = (n * (n + 1.0) * (2 * n + 1) - n0 * (n0 + 1.0) * (2 * n0 + 1)) / 24 - (F.col("ties") - n0 * (n0 * n0 - 1)) / 48
    mean = (n * (n + 1.0) - n0 * (n0 + 1.0)) / 4
    lesser = F.least("w_plus", "w_minus")
    return sums.select(
        *keys, "n", "w_plus", "w_minus", F.try_divide(lesser - mean, F.sqrt(var)).alias("z"),
        F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")).alias("r_signed"),
        (1 - F.try_divide(2 * lesser, n * (n + 1) / 2.0)).alias("r_unsigned"),
    )


def holm(tests: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adjusted p of each test within its family, as ``p_holm``."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    m, rank = F.count(F.lit(1)).over(Window.partitionBy(*family)), F.row_number().over(order)
    raw = F.least(F.lit(1.0), F.coalesce(p, F.lit(1.0)) * (m - rank + 1))
    out = tests.withColumn("_h", raw)
    return out.withColumn("p_holm", F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_h")


def sign_counts(df: DataFrame, sets: list[list[str]], diff: str) -> DataFrame:
    """Positive, negative, tied and all rows, per grouping set."""
    keys = sorted({k for s in sets for k in s})
    spread = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return spread.agg(F.count_if(F.col(diff) > 0).alias("n_pos"), F.count_if(F.col(diff) < 0).alias("n_neg"), F.count_if(F.col(diff) == 0).alias("n_tie"), F.count(F.lit(1)).alias("n_all"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Pearson and Spearman correlation per key; NULL below ``least`` rows."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = some
    for name, column in (("_x", x), ("_y", y)):
        ranked = beside(ranked, value_ranks(some, keys, column).select(*keys, column, F.col("rank").alias(name)), [*keys, column])
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("p"), F.corr("_x", "_y").alias("s"))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.round("p", 6)).alias("pearson"), F.when(F.col("n") >= least, F.round("s", 6)).alias("spearman"))


def repeated_correlation(df: DataFrame, subject: str, x: str, y: str, digits: int | None = 6) -> DataFrame:
    """Correlation within subjects: n, df, r."""
    by = Window.partitionBy(subject)
    c = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": F.col(x) - F.avg(x).over(by), "_y": F.col(y) - F.avg(y).over(by)})
    out = c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("k"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    r = F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))
    return out.select("n", (F.col("n") - F.col("k") - 1).alias("df"), (r if digits is None else F.round(r, digits)).alias("r"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """chi2, G, df, Cramer's V and the least expected count of a table of counts.

    Cells without rows add nothing to sum(o^2 / (row * column)) nor to G, so only those with rows are made.
    """
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("o"))
    rt, ct, n = F.sum("o").over(Window.partitionBy(row)), F.sum("o").over(Window.partitionBy(column)), F.sum("o").over(Window.partitionBy())
    e = cells.withColumns({"rt": rt, "ct": ct, "n": n}).withColumn("q", F.col("o") * F.col("o") / (F.col("rt") * F.col("ct")))
    out = e.agg(
        F.sum("q").alias("q"), F.sum(2 * F.col("o") * F.ln(F.col("o") * F.col("n") / (F.col("rt") * F.col("ct")))).alias("g"),
        (F.min("rt") * F.min("ct") / F.max("n")).alias("least"), F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c"), F.max("n").alias("n"),
    ).withColumn("chi2", F.col("n") * (F.col("q") - 1))
    k = F.least("r", "c") - 1
    return out.select(F.round("chi2", 6).alias("chi2"), F.round("g", 6).alias("g_test"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.round(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * k)), 6).alias("cramers_v"), F.round("least", 6).alias("least_expected"), "n")
