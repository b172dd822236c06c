"""Random-intercept models with factors and their interactions, from sums that Spark makes.

The likelihood needs two things only: the sums of products over all rows, and, for groups of one size, the sums of
products of the groups' column sums. Rows that agree in the design count once with their number for the first;
for the second a group is reduced to one row of sums, and groups to one row per size. What reaches the driver does not grow
with rows or groups, and one variance ratio is then found by a search without further passes over the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.distributions import chi2_tail, normal_tail

MAX_LEVELS = 200


@dataclass(frozen=True)
class Factor:
    """A categorical column; the first level is the reference."""

    column: str
    levels: tuple


def factor(df: DataFrame, column: str) -> Factor:
    levels = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_LEVELS + 1).collect())
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    return Factor(column, tuple(levels))


@dataclass
class Design:
    """Named columns of a model's matrix, the intercept first."""

    names: list[str] = field(default_factory=lambda: ["Intercept"])
    columns: list[Column] = field(default_factory=lambda: [F.lit(1.0)])
    raw: list[str] = field(default_factory=list)

    def term(self, *parts: Factor | str) -> Design:
        """With the product of the parts: factors give a column a level but the first, names a numeric column."""
        made = [("", F.lit(1.0))]
        raw = list(self.raw)
        for p in parts:
            column = p.column if isinstance(p, Factor) else p
            own = [(f"{column}[{v}]", (F.col(column) == F.lit(v)).cast("double")) for v in p.levels[1:]] if isinstance(p, Factor) else [(column, F.col(column).cast("double"))]
            made = [(f"{a}:{b}" if a else b, c * d) for a, c in made for b, d in own]
            raw += [column] if column not in raw else []
        return Design(self.names + [a for a, _ in made], self.columns + [c for _, c in made], raw)

    def crossed(self, a: Factor | str, b: Factor | str) -> Design:
        """Both terms and their interaction."""
        return self.term(a).term(b).term(a, b)


@dataclass
class Fit:
    design: Design
    group: str
    y: str
    beta: np.ndarray  # nan where a column follows from those before
    se: np.ndarray
    ratio: float  # group variance over residual variance
    residual: float
    log_likelihood: float
    n: int
    groups: int
    mean: float
    std: float

    @property
    def icc(self) -> float:
        return self.ratio / (1 + self.ratio)

    @property
    def parameters(self) -> int:
        return int(np.isfinite(self.beta).sum())

    def table(self) -> list[tuple[str, float | None, float | None, float | None, float | None]]:
        def row(name, b, s):
            return (name, float(b), float(s), float(b / s), 2 * normal_tail(abs(b / s))) if math.isfinite(b) and s > 0 else (name, None, None, None, None)

        return [row(*x) for x in zip(self.design.names, self.beta, self.se, strict=True)]

    def fixed_part(self) -> Column:
        return sum((F.lit(float(b)) * c for b, c in zip(self.beta, self.design.columns, strict=True) if math.isfinite(b)), F.lit(0.0))


def _complete(df: DataFrame, y: str, design: Design, group: str) -> DataFrame:
    return df.na.drop(subset=[y, group, *design.raw])


def _products(left: list[Column], weight: Column | None = None) -> list[Column]:
    w = (lambda c: c) if weight is None else (lambda c: weight * c)
    return [F.sum(w(left[i] * left[j])).alias(f"p_{i}_{j}") for i in range(len(left)) for j in range(i, len(left))]


def _square(row, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = row[f"p_{i}_{j}"] or 0.0
    return m


def _independent(xx: np.ndarray) -> list[int]:
    """Columns that do not follow from those before, by a Cholesky factorisation that leaves out vanishing pivots."""
    a, kept = xx.copy(), []
    for k in range(len(a)):
        if a[k, k] > 1e-9 * max(xx[k, k], 1e-300):
            kept.append(k)
            a -= np.outer(a[:, k], a[k]) / a[k, k]
    return kept


def _sums(df: DataFrame, y: str, design: Design, group: str) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    rows, p = _complete(df, y, design, group), len(design.names)
    value = F.col(y).cast("double")
    cells = rows.groupBy(*[F.col(c) for c in design.raw]).agg(F.count(F.lit(1)).cast("double").alias("w_"), F.sum(value).alias("sy_"), F.sum(value * value).alias("syy_"))
    some = cells.agg(*_products(design.columns, F.col("w_")), *[F.sum(c * F.col("sy_")).alias(f"y_{i}") for i, c in enumerate(design.columns)], F.sum("syy_").alias("yy")).first()
    total = np.zeros((p + 1, p + 1))
    total[:p, :p] = _square(some, p)
    total[p, :p] = total[:p, p] = [some[f"y_{i}"] or 0.0 for i in range(p)]
    total[p, p] = some["yy"] or 0.0
    per_group = rows.groupBy(F.col(group).alias("g_")).agg(F.count(F.lit(1)).alias("n_"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(design.columns)], F.sum(value).alias(f"s_{p}"))
    found = per_group.groupBy("n_").agg(F.count(F.lit(1)).alias("k_"), *_products([F.col(f"s_{i}") for i in range(p + 1)])).collect()
    return total, [(r["n_"], r["k_"], _square(r, p + 1)) for r in sorted(found, key=lambda r: r["n_"])]


def fit(df: DataFrame, y: str, design: Design, group: str, reml: bool = True) -> Fit:
    """y on the design with an intercept per group; rows that lack a value are left out.

    ``reml``: the restricted likelihood, for estimates; False: the full one, for comparing designs by their fit.
    """
    total, by_size = _sums(df, y, design, group)
    p = len(design.names)
    kept = _independent(total[:p, :p])
    at = [*kept, p]
    total, by_size = total[np.ix_(at, at)], [(s, k, o[np.ix_(at, at)]) for s, k, o in by_size]
    q = len(kept)
    n, groups = int(sum(s * k for s, k, _ in by_size)), int(sum(k for _, k, _ in by_size))
    freedom = n - q if reml else n
    if freedom <= 0 or not q:
        raise ValueError("fewer rows than terms")

    def solved(ratio: float):
        w = total - sum(ratio / (1 + s * ratio) * o for s, _, o in by_size)
        xx, xy = w[:q, :q], w[:q, q]
        beta = np.linalg.solve(xx, xy)
        return xx, beta, max(w[q, q] - xy @ beta, 1e-300)

    def likelihood(ratio: float) -> float:
        xx, _, rss = solved(ratio)
        logdet = sum(k * math.log1p(s * ratio) for s, k, _ in by_size)
        return -0.5 * (freedom * (math.log(2 * math.pi * rss / freedom) + 1) + logdet + (np.linalg.slogdet(xx)[1] if reml else 0.0))

    def slope(ratio: float) -> float:
        """Of the log-likelihood in the ratio; the coefficients are at their best, so only the sums move."""
        xx, beta, rss = solved(ratio)
        d = -sum(o / (1 + s * ratio) ** 2 for s, _, o in by_size)
        moved = d[q, q] - 2 * beta @ d[:q, q] + beta @ d[:q, :q] @ beta
        logdet = sum(k * s / (1 + s * ratio) for s, k, _ in by_size)
        return -0.5 * (freedom * moved / rss + logdet + (np.trace(np.linalg.solve(xx, d[:q, :q])) if reml else 0.0))

    grid = [0.0, *np.exp(np.linspace(-16, 9, 101))]
    best = int(np.argmax([likelihood(r) for r in grid]))
    ratio = grid[best]
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    if slope(lo) > 0 > slope(hi):
        for _ in range(200):
            ratio = (lo + hi) / 2
            lo, hi = (ratio, hi) if slope(ratio) > 0 else (lo, ratio)
    xx, beta, rss = solved(ratio)
    full, se = np.full(p, np.nan), np.full(p, np.nan)
    full[kept], se[kept] = beta, np.sqrt(np.diag(np.linalg.inv(xx)) * rss / freedom)
    mean = float(total[0, q]) / n
    std = math.sqrt(max(0.0, (total[q, q] - n * mean * mean) / max(1, n - 1)))
    return Fit(design, group, y, full, se, float(ratio), float(rss) / freedom, float(likelihood(ratio)), n, groups, mean, std)


def likelihood_ratio(full: Fit, reduced: Fit) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p of a design against one nested in it, both fitted without ``reml``."""
    stat = max(0.0, 2 * (full.log_likelihood - reduced.log_likelihood))
    df = full.parameters - reduced.parameters
    return stat, df, chi2_tail(stat, df) if df > 0 else 1.0


def group_effects(df: DataFrame, model: Fit) -> DataFrame:
    """(group, n, effect): the predicted intercept of each group, its mean residual shrunk by its size."""
    rows = _complete(df, model.y, model.design, model.group)
    left = F.col(model.y).cast("double") - model.fixed_part()
    sums = rows.groupBy(model.group).agg(F.count(F.lit(1)).alias("n"), F.sum(left).alias("left"))
    return sums.select(model.group, "n", (F.lit(model.ratio) * F.col("left") / (1 + F.col("n") * model.ratio)).alias("effect"))


def residuals(df: DataFrame, model: Fit, name: str = "residual") -> DataFrame:
    """The complete rows with what neither the fixed part nor the group's effect explains."""
    rows = _complete(df, model.y, model.design, model.group)
    found = rows.join(group_effects(df, model).select(F.col(model.group).alias("g_"), "effect"), F.col(model.group) == F.col("g_"))
    return found.withColumn(name, F.col(model.y).cast("double") - model.fixed_part() - F.col("effect")).drop("g_", "effect")
