"""Published values and invariants of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chains, mixed, ranks, regression, survival
from palimpsest.sources import sinks

# Published counts of (first hit, duration, event) over 202 recoveries.
EPISODES = {(1, 1, 1): 50, (1, 2, 1): 23, (1, 3, 0): 78, (2, 1, 1): 8, (2, 2, 0): 20, (3, 1, 0): 23}


@pytest.fixture(scope="module")
def episodes(spark):
    rows = [(h, d, e) for (h, d, e), n in EPISODES.items() for _ in range(n)]
    return spark.createDataFrame(rows, "first_hit_step int, duration int, event_observed int")


def test_published_survival(episodes):
    km = {r.duration: r for r in survival.kaplan_meier(episodes, []).collect()}
    assert km[1].survival == pytest.approx(0.7128712871287127, abs=1e-8)
    assert (km[1].ci_lo, km[1].ci_hi) == pytest.approx((0.6451119256637103, 0.7700228657386732), abs=1e-8)
    assert km[2].survival == pytest.approx(0.5773668275918501, abs=1e-8) and km[3].survival == km[2].survival
    s = survival.summary(episodes, 3).first()
    assert (s.n_episodes, s.median_duration) == (202, 2.0)
    assert s.lost_after_one_as_published == pytest.approx(0.40099, abs=1e-5) and s.lost_after_one == pytest.approx(58 / 202, abs=1e-6)


def test_episodes_against_loop(spark):
    rng = np.random.default_rng(0)
    data = {q: rng.integers(0, 2, rng.integers(1, 6)).tolist() for q in range(60)}
    df = spark.createDataFrame([(q, k, float(v)) for q, vs in data.items() for k, v in enumerate(vs)], "qid int, step int, score double")
    want = set()
    for q, vs in data.items():
        hit = next((k for k in range(1, len(vs)) if vs[k]), None)
        if hit is not None:
            lost = next((k for k in range(hit + 1, len(vs)) if not vs[k]), None)
            want.add((q, hit, (len(vs) if lost is None else lost) - hit, int(lost is not None)))
    assert {tuple(r) for r in chains.episodes(df, ["qid"], 0.5).collect()} == want


def test_holm_published(spark):
    p = [2.504143851322376e-08, 8.596740371801016e-08, 7.215642223942398e-04]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(p)], "k int, p double")
    got = [r.p_holm for r in ranks.holm(df, [], "p", "k").orderBy("k").collect()]
    assert got == pytest.approx([7.512431553967e-08, 1.719348074360e-07, 7.215642223942e-04])


def test_mediation_identity(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 4, 300)
    m = 0.5 * t + rng.normal(size=300)
    y = 0.3 * t - 0.7 * m + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(t, m, y)], "t double, m double, y double")
    r = regression.mediation(df, "t", "m", "y").first()
    assert r.ab == pytest.approx(r.c - r.direct, abs=3e-6)
    assert regression.ols(df, "y", ["t", "m"])[1:] == pytest.approx([r.direct, r.b], abs=1e-5)


def test_mixed_model_balanced(spark):
    """With balanced groups REML has a closed form: the variance components of one-way analysis of variance."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(40, 1)) + rng.normal(size=(40, 6))
    df = spark.createDataFrame([(g, float(v)) for g in range(40) for v in y[g]], "g int, y double")
    m = mixed.fit(df, "y", mixed.Design(), "g")
    within = y.var(axis=1, ddof=1).mean()
    between = (6 * y.mean(axis=1).var(ddof=1) - within) / 6
    assert m.residual == pytest.approx(within, rel=1e-5) and m.ratio == pytest.approx(between / within, rel=1e-4)
    assert m.se[0] == pytest.approx(math.sqrt(y.mean(axis=1).var(ddof=1) / 40), rel=1e-4)


def test_log_rank_of_equal_strata(spark):
    rows = [(s, d, e) for s in "ab" for d, e in ((1, 1), (2, 0), (2, 1), (3, 0))]
    stat, df, p = survival.log_rank(spark.createDataFrame(rows, "s string, duration int, event_observed int"), "s")
    assert stat == pytest.approx(0, abs=1e-12) and df == 1 and p == 1.0


def test_similarity_of_gapped_chain(spark):
    rows = [("a", 0, "x y"), ("a", 1, "x"), ("a", 3, ""), ("b", 1, "q"), ("c", 0, None), ("c", 1, "")]
    df = spark.createDataFrame(rows, "qid string, step int, text string")
    got = {(r.qid, r.step): (r.f1_original, r.f1_consecutive) for r in chains.step_similarity(df, ["qid"]).collect()}
    assert got[("a", 1)] == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert got[("a", 3)] == (0.0, None) and got[("b", 1)] == (None, None) and got[("c", 1)] == (1.0, 1.0)


def test_upsert_and_empty(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sinks.keep_last(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert chains.unfinished(old, new, ["k"]).collect() == [(1, "a")]
    assert sinks.keep_last(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert ranks.wilcoxon(old.limit(0).select("k", F.lit(0.0).alias("d")), ["k"], "d").count() == 0
