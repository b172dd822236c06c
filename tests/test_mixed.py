"""Mixed models against the likelihood of the whole covariance matrix, and Shapiro and Wilk's test."""

import math

import numpy as np
import pytest
from palimpsest.operators import mixed
from palimpsest.operators.distributions import normal_quantile, normal_tail, shapiro_wilk


@pytest.fixture(scope="module")
def rows():
    """Groups of 1 to 9 rows, two factors that are not balanced, a numeric column and values that are missing."""
    rng = np.random.default_rng(4)
    out = []
    for g in range(60):
        own = rng.normal()
        for _ in range(rng.integers(1, 10)):
            a, b, x = int(rng.integers(0, 3)), "uvw"[rng.integers(0, 3)], float(rng.normal())
            y = own + 0.5 * a - (b == "v") + 0.3 * x + rng.normal()
            out.append((g, a, b, x, None if rng.random() < 0.05 else float(y)))
    return out


def design_matrix(rows):
    a = lambda r: [1.0, *[float(r[1] == k) for k in (1, 2)]]
    b = lambda r: [float(r[2] == k) for k in "vw"]
    return np.array([[*a(r), *b(r), *[p * q for p in a(r)[1:] for q in b(r)], r[3]] for r in rows])


@pytest.mark.parametrize("reml", [True, False])
def test_against_whole_covariance(spark, rows, reml):
    df = spark.createDataFrame(rows, "g int, a int, b string, x double, y double")
    d = mixed.Design().crossed(mixed.factor(df, "a"), mixed.factor(df, "b")).term("x")
    assert d.names == ["Intercept", "a[1]", "a[2]", "b[v]", "b[w]", "a[1]:b[v]", "a[1]:b[w]", "a[2]:b[v]", "a[2]:b[w]", "x"]
    m = mixed.fit(df, "y", d, "g", reml)
    some = [r for r in rows if r[4] is not None]
    x, y, g = design_matrix(some), np.array([r[4] for r in some]), np.array([r[0] for r in some])
    same = (g[:, None] == g[None]).astype(float)

    def likelihood(ratio):
        v = np.linalg.inv(np.eye(len(y)) + ratio * same)
        xx = x.T @ v @ x
        beta = np.linalg.solve(xx, x.T @ v @ y)
        r = y - x @ beta
        f = len(y) - (x.shape[1] if reml else 0)
        s = r @ v @ r / f
        ll = -0.5 * (f * (math.log(2 * math.pi * s) + 1) - np.linalg.slogdet(v)[1] + (np.linalg.slogdet(xx)[1] if reml else 0))
        return ll, beta, np.sqrt(np.diag(np.linalg.inv(xx)) * s)

    ll, beta, se = likelihood(m.ratio)
    assert m.beta == pytest.approx(beta, abs=1e-9) and m.se == pytest.approx(se, abs=1e-9) and m.log_likelihood == pytest.approx(ll, abs=1e-7)
    assert all(likelihood(m.ratio * f)[0] < ll for f in (0.99, 1.01)) and m.n == len(y)
    effects = {r.g: r.effect for r in mixed.group_effects(df, m).collect()}
    v = np.linalg.inv(np.eye(len(y)) + m.ratio * same)
    whole = m.ratio * same @ v @ (y - x @ beta)
    assert [effects[k] for k in g] == pytest.approx(whole, abs=1e-9)
    left = sorted(r.residual for r in mixed.residuals(df, m).select("residual").collect())
    assert left == pytest.approx(sorted(y - x @ beta - whole), abs=1e-9)


def test_missing_cells_and_no_group_variance(spark):
    rows = [(g, k, "u" if k == 0 else "v", float((-1) ** (g + k))) for g in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "g int, a int, b string, y double")
    m = mixed.fit(df, "y", mixed.Design().crossed(mixed.factor(df, "a"), mixed.factor(df, "b")), "g")
    assert m.parameters == 3 and [r[0] for r in m.table() if r[1] is None] == ["b[v]", "a[1]:b[v]", "a[2]:b[v]"]
    flat = spark.createDataFrame([(g, y) for g in range(6) for y in (-1.0, 1.0)], "g int, y double")
    assert mixed.fit(flat, "y", mixed.Design(), "g").ratio == 0.0
    with pytest.raises(ValueError):
        mixed.fit(flat.limit(0), "y", mixed.Design(), "g")


def test_likelihood_ratio_of_nothing_added(spark, rows):
    df = spark.createDataFrame(rows, "g int, a int, b string, x double, y double")
    small = mixed.fit(df, "y", mixed.Design().term("x"), "g", reml=False)
    large = mixed.fit(df, "y", mixed.Design().term("x").term(mixed.factor(df, "b")), "g", reml=False)
    stat, freedom, p = mixed.likelihood_ratio(large, small)
    assert freedom == 2 and stat > 20 and p == pytest.approx(math.exp(-stat / 2))
    assert mixed.likelihood_ratio(small, small) == (0.0, 0, 1.0)


def test_shapiro_wilk_known_values():
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.006704, abs=1e-4)
    assert all(normal_tail(-normal_quantile(p)) == pytest.approx(p, rel=1e-9) for p in (1e-12, 1e-4, 0.03, 0.3, 0.5, 0.8, 0.999))
    even = [normal_quantile((k + 0.5) / 400) for k in range(400)]
    assert shapiro_wilk(even)[1] > 0.99 and shapiro_wilk([math.exp(v) for v in even])[1] < 1e-10
    assert math.isnan(shapiro_wilk([1.0, 2.0])[0]) and math.isnan(shapiro_wilk([1.0] * 9)[0])
