"""Random-intercept models of the scores, with closed forms in SQL where the data are balanced.

A subject that lacks a cell of a design is left out of that design's balanced fit: estimates are then cell means, and
the variances those of an analysis of variance. The fits themselves do not need that: ``mixed_model`` takes all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import mixed
from palimpsest.operators.distributions import shapiro_wilk
from palimpsest.sources.adapters import SCORES_SQL, scores

STEPS = mixed.Factor("step", (0, 1, 2, 3))
HOPS = mixed.Factor("n_hop", (2, 3, 4))
GROUPS = mixed.Factor("grp", ("act", "browse"))
BROWSE = mixed.Factor("instruction_type", ("click", "view"))
ACT = mixed.Factor("instruction_type", ("error", "purchase", "signup"))
DESIGNS = {"step x hop": (HOPS, None), "step x group": (GROUPS, None), "step x instruction, act": (ACT, "act"), "step x instruction, browse": (BROWSE, "browse")}
_SCHEMA = "design string, term string, coef double, se double, z double, p double, icc double, n long, `groups` long"


def _grouped(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).withColumn("grp", F.when(F.col("instruction_type").isin("view", "click"), "browse").otherwise("act"))


def balanced(rows: DataFrame, second: mixed.Factor, only: str | None) -> DataFrame:
    """Mean scores of the cells of each subject that has them all; a subject has one hop, so that its cells are the steps."""
    rows = rows if only is None else rows.where(F.col("grp") == only)
    cells = rows.groupBy("qid", "step", second.column).agg(F.round(F.avg("score"), 9).alias("score"))
    due = len(STEPS.levels) * (1 if second is HOPS else len(second.levels))
    whole = cells.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == due).select("qid")
    return cells.join(whole, "qid")


def mixed_interactions(spark, sf_dir):
    """Step with hop, with group, and with instruction within each group, balanced, by restricted likelihood (SA5, SA5b)."""
    out = []
    for name, (second, only) in DESIGNS.items():
        m = mixed.fit(balanced(_grouped(spark, sf_dir), second, only), "score", mixed.Design().crossed(STEPS, second), "qid")
        out += [(name, *r, m.icc, m.n, m.groups) for r in m.table()]
    found = spark.createDataFrame(out, _SCHEMA)
    return found.select("design", "term", *[F.round(c, 5).alias(c) for c in ("coef", "se", "z", "p", "icc")], "n", "groups")


def mixed_unbalanced(spark, sf_dir):
    """The same designs on all rows of scores, complete subjects or not (SA5, SA5b); an iterative fit, so without SQL."""
    out = []
    for name, (second, only) in DESIGNS.items():
        rows = _grouped(spark, sf_dir) if only is None else _grouped(spark, sf_dir).where(F.col("grp") == only)
        m = mixed.fit(rows, "score", mixed.Design().crossed(STEPS, second), "qid")
        out += [(name, *r, m.icc, m.n, m.groups) for r in m.table()]
    return spark.createDataFrame(out, _SCHEMA)


def mixed_comparison(spark, sf_dir):
    """Whether hop matters, and whether it changes the steps: likelihood ratios of nested designs (SA5b)."""
    rows = balanced(_grouped(spark, sf_dir), HOPS, None)
    ladder = [("step", mixed.Design().term(STEPS)), ("hop", mixed.Design().term(STEPS).term(HOPS)), ("step:hop", mixed.Design().crossed(STEPS, HOPS))]
    fits = [(name, mixed.fit(rows, "score", d, "qid", reml=False)) for name, d in ladder]
    out = [(name, *mixed.likelihood_ratio(b, a)) for (_, a), (name, b) in zip(fits, fits[1:], strict=False)]
    return spark.createDataFrame(out, "added string, statistic double, df int, p double").select("added", F.round("statistic", 4).alias("statistic"), "df", F.round("p", 5).alias("p"))


def _cells(spark, sf_dir, instruction: str) -> DataFrame:
    return balanced(_grouped(spark, sf_dir).where(F.col("instruction_type") == instruction), HOPS, None)


INSTRUCTIONS = ("click", "error", "purchase", "signup", "view")


def null_models(spark, sf_dir):
    """Variance between and within subjects by instruction, without further terms, and the intraclass share (SA6)."""
    out = []
    for name in INSTRUCTIONS:
        m = mixed.fit(_cells(spark, sf_dir, name), "score", mixed.Design(), "qid")
        out.append((name, m.n, m.groups, m.mean, m.std, m.ratio * m.residual, m.residual, m.icc))
    found = spark.createDataFrame(out, "instruction_type string, n long, `groups` long, mean double, std double, var_subject double, var_residual double, icc double")
    return found.select("instruction_type", "n", "groups", *[F.round(c, 6).alias(c) for c in ("mean", "std", "var_subject", "var_residual")], F.round("icc", 5).alias("icc"))


SAMPLE = 5000


def residual_normality(spark, sf_dir):
    """Shapiro and Wilk's test of at most 5,000 residuals of the null model, drawn by a hash (SA33); W has no SQL."""
    rows, out = scores(spark, sf_dir), []
    for name in INSTRUCTIONS:
        own = rows.where(F.col("instruction_type") == name)
        m = mixed.fit(own, "score", mixed.Design(), "qid")
        drawn = mixed.residuals(own, m).orderBy(F.xxhash64("qid", "step"), "qid", "step").limit(SAMPLE).select("residual").collect()
        out.append((name, m.n, len(drawn), *shapiro_wilk([r.residual for r in drawn]), m.icc))
    return spark.createDataFrame(out, "instruction_type string, n long, n_sample long, w double, p double, icc double")


def group_intercepts(spark, sf_dir):
    """Each subject's predicted intercept under the null model on its complete steps (SA6)."""
    rows = balanced(_grouped(spark, sf_dir), HOPS, None)
    return mixed.group_effects(rows, mixed.fit(rows, "score", mixed.Design(), "qid")).select("qid", "n", F.round("effect", 6).alias("effect"))


_GROUPED = f"{SCORES_SQL}, scored AS (SELECT *, CASE WHEN instruction_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS grp FROM scores)"


def _balanced_sql(name: str, second: mixed.Factor, where: str) -> str:
    due = len(STEPS.levels) * (1 if second is HOPS else len(second.levels))
    return f"{name} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS c FROM (SELECT qid, step, {second.column} AS f, round(avg(score), 9) AS y FROM scored WHERE {where} GROUP BY ALL)) WHERE c = {due})"


def _p_sql(z: str) -> str:
    """Two-sided normal p by the series of the error function with positive terms."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = f"list_sum(list_transform(range(0, 160), lambda i: exp(i * ln(2 * {x} * {x} + 1e-300) - (lgamma(2 * i + 2) - i * ln(2.0) - lgamma(i + 1)))))"
    return f"CASE WHEN abs({z}) > 8 THEN 0.0 WHEN {z} IS NULL THEN NULL ELSE greatest(0.0, 1 - 2 * {x} / sqrt(pi()) * exp(-{x} * {x}) * {series}) END"


def _design_sql(k: int, label: str, second: mixed.Factor, only: str | None) -> tuple[str, str]:
    b, between = f"b{k}", second is HOPS
    first = f"'{second.levels[0]}'" if isinstance(second.levels[0], str) else str(second.levels[0])
    where = "true" if only is None else f"grp = '{only}'"
    cell = "(PARTITION BY step, f)"
    own, cells = ("(PARTITION BY f)", len(STEPS.levels)) if between else ("()", len(STEPS.levels) * len(second.levels))
    strata = f"count(DISTINCT f)" if between else "1"
    ctes = f"""{_balanced_sql(b, second, where)},
    r{k} AS (SELECT *, avg(y) OVER (PARTITION BY qid) AS ys, avg(y) OVER {cell} AS yc, avg(y) OVER {own} AS yo FROM {b}),
    v{k} AS (SELECT count(*) AS n, count(DISTINCT qid) AS g, {strata} AS h, sum((y - ys - yc + yo) ** 2) AS sse, sum((ys - yo) ** 2) AS ssb FROM r{k}),
    w{k} AS (SELECT n, g, CASE WHEN ssb / (g - h) > sse / ((g - h) * ({cells} - 1)) THEN sse / ((g - h) * ({cells} - 1)) ELSE (sse + ssb) / (n - h * {cells}) END AS s2,
             greatest(0.0, (ssb / (g - h) - sse / ((g - h) * ({cells} - 1))) / {cells}) AS sb FROM v{k}),
    m{k} AS (SELECT step, f, avg(y) AS m, count(*) AS nc FROM {b} GROUP BY ALL),
    t{k} AS (SELECT a.step, a.f, a.nc, z.nc AS n0, a.m - CASE WHEN a.step > 0 AND a.f <> {first} THEN s.m + o.m - z.m WHEN a.step > 0 OR a.f <> {first} THEN z.m ELSE 0 END AS coef
             FROM m{k} a JOIN m{k} s ON s.step = a.step AND s.f = {first} JOIN m{k} o ON o.step = 0 AND o.f = a.f JOIN m{k} z ON z.step = 0 AND z.f = {first}),
    c{k} AS (SELECT '{label}' AS design, CASE WHEN step = 0 AND f = {first} THEN 'Intercept' WHEN f = {first} THEN 'step[' || step || ']' WHEN step = 0 THEN '{second.column}[' || f || ']' ELSE 'step[' || step || ']:{second.column}[' || f || ']' END AS term,
             coef, sqrt(CASE WHEN step = 0 AND f = {first} THEN (s2 + sb) / n0 WHEN f = {first} THEN 2 * s2 / n0 WHEN step = 0 THEN {'(s2 + sb) * (1.0 / nc + 1.0 / n0)' if between else '2 * s2 / n0'}
             ELSE {'2 * s2 * (1.0 / nc + 1.0 / n0)' if between else '4 * s2 / n0'} END) AS se, sb / (sb + s2) AS icc, n, g AS groups FROM t{k}, w{k})"""
    return ctes, f"SELECT * FROM c{k}"


_PARTS = [_design_sql(k, label, *d) for k, (label, d) in enumerate(DESIGNS.items())]
MIXED_INTERACTIONS = f"""WITH {_GROUPED}, {', '.join(c for c, _ in _PARTS)}, every AS ({' UNION ALL '.join(s for _, s in _PARTS)})
SELECT design, term, round(coef, 5) AS coef, round(se, 5) AS se, round(coef / se, 5) AS z, round({_p_sql('(coef / se)')}, 5) AS p, round(icc, 5) AS icc, n, groups FROM every"""

MIXED_COMPARISON = f"""WITH {_GROUPED}, {_balanced_sql('b', HOPS, 'true')},
r AS (SELECT *, avg(y) OVER (PARTITION BY qid) AS ys, avg(y) OVER (PARTITION BY step, f) AS yc, avg(y) OVER (PARTITION BY step) AS yt, avg(y) OVER (PARTITION BY f) AS yf, avg(y) OVER () AS ya FROM b),
v AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT qid) AS DOUBLE) AS g, sum((y - ys - yc + yf) ** 2) AS e2, sum((y - ys - yt + ya) ** 2) AS e1, sum((ys - yf) ** 2) AS b1, sum((ys - ya) ** 2) AS b0 FROM r),
l AS (SELECT unnest([0, 1, 2]) AS k, n, g, unnest([e1, e1, e2]) AS e, unnest([b0, b1, b1]) AS s FROM v),
d AS (SELECT k, CASE WHEN s / g > e / (n - g) THEN (n - g) * ln(e / (n - g)) + g * ln(s / g) ELSE n * ln((e + s) / n) END AS d FROM l),
x AS (SELECT a.k, CASE a.k WHEN 1 THEN 'hop' ELSE 'step:hop' END AS added, greatest(0.0, z.d - a.d) AS statistic FROM d a JOIN d z ON z.k = a.k - 1)
SELECT added, round(statistic, 4) AS statistic, CASE k WHEN 1 THEN 2 ELSE 6 END AS df, round(exp(-statistic / 2) * CASE k WHEN 1 THEN 1 ELSE 1 + statistic / 2 + statistic * statistic / 8 END, 5) AS p FROM x"""

NULL_MODELS = f"""WITH {_GROUPED}, cells AS (SELECT instruction_type AS i, qid, step, round(avg(score), 9) AS y FROM scored GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY i, qid) AS c, avg(y) OVER (PARTITION BY i, qid) AS ys FROM cells) WHERE c = 4),
r AS (SELECT *, avg(y) OVER (PARTITION BY i) AS ya FROM b),
v AS (SELECT i, count(*) AS n, count(DISTINCT qid) AS g, avg(y) AS mean, stddev_samp(y) AS std, sum((ys - ya) ** 2) / (count(DISTINCT qid) - 1) AS msb, sum((y - ys) ** 2) / (count(*) - count(DISTINCT qid)) AS msw, sum((y - ya) ** 2) / (count(*) - 1) AS ms FROM r GROUP BY i),
w AS (SELECT *, CASE WHEN msb > msw THEN (msb - msw) / 4 ELSE 0.0 END AS sb, CASE WHEN msb > msw THEN msw ELSE ms END AS s2 FROM v)
SELECT i AS instruction_type, n, g AS groups, round(mean, 6) AS mean, round(std, 6) AS std, round(sb, 6) AS var_subject, round(s2, 6) AS var_residual, round(sb / (sb + s2), 5) AS icc FROM w"""

GROUP_INTERCEPTS = f"""WITH {_GROUPED}, {_balanced_sql('b', HOPS, 'true')},
r AS (SELECT *, avg(y) OVER (PARTITION BY qid) AS ys, avg(y) OVER () AS ya FROM b),
v AS (SELECT sum((ys - ya) ** 2) / (count(DISTINCT qid) - 1) AS msb, sum((y - ys) ** 2) / (count(*) - count(DISTINCT qid)) AS msw FROM r)
SELECT qid, count(*) AS n, round(CASE WHEN any_value(msb) > any_value(msw) THEN (1 - any_value(msw) / any_value(msb)) * (avg(y) - any_value(ya)) ELSE 0.0 END, 6) + 0.0 AS effect FROM r, v GROUP BY qid"""

JOBS = {
    "mixed_interactions": (mixed_interactions, MIXED_INTERACTIONS), "mixed_unbalanced": (mixed_unbalanced, None), "mixed_comparison": (mixed_comparison, MIXED_COMPARISON),
    "null_models": (null_models, NULL_MODELS), "group_intercepts": (group_intercepts, GROUP_INTERCEPTS), "residual_normality": (residual_normality, None),
}
