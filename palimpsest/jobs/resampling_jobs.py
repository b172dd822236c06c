"""Intervals by drawing whole clusters with replacement, with the SQL of the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.jobs.text_jobs import TOKEN_MATCHING, token_matching
from palimpsest.operators import aggregates, bootstrap, resampling
from palimpsest.sources.adapters import SCORES_SQL, metric_rows, metrics, metrics_sql, scores

DRAWS, SEED = 200, 31
STEPS = [0, 1, 2, 3]
ANSWER_DELTAS = ((0, 1), (1, 2), (2, 3), (0, 3))
FACT_DELTAS = ((1, 2), (2, 3), (1, 3))
LOW = 0.3  # a chain that starts below has failed, as no score of the test tables is 0
RECOVERED = {"09": 0.9, "05": 0.5, "any": LOW}
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _paired(rows: DataFrame, value: str, name: str, deltas) -> DataFrame:
    """(statistic, cluster, v): a subject's mean change between two steps that it has both."""
    w = aggregates.wide(rows.withColumn("qid", F.col("qid").cast("string")), ["qid"], "step", STEPS, F.avg(value))
    each = F.array(*[F.struct(F.lit(f"delta_{name}_{a}_{b}").alias("statistic"), (F.col(f"s{b}") - F.col(f"s{a}")).alias("v")) for a, b in deltas])
    return w.select(F.col("qid").alias("cluster"), F.explode(each).alias("x")).select("x.statistic", "cluster", "x.v").where("v is not null")


def _recovered(s: DataFrame, name: str, thresholds: dict[str, float]) -> DataFrame:
    """(statistic, cluster, v): 1 for each chain that started low and reached the threshold later, 0 for one that did not."""
    w = aggregates.wide(s, ["qid", "instruction_type"], "step", STEPS, F.first("score")).where(F.col("s0") < LOW)
    best = F.greatest("s1", "s2", "s3")
    each = F.array(*[F.struct(F.lit(f"{name}_{k}").alias("statistic"), F.coalesce((best >= t).cast("double"), F.lit(0.0)).alias("v")) for k, t in thresholds.items()])
    return w.select(F.col("qid").cast("string").alias("cluster"), F.explode(each).alias("x")).select("x.statistic", "cluster", "x.v")


def _intervals(values: DataFrame) -> DataFrame:
    """Estimate, interval and size of each statistic's (statistic, cluster, v)."""
    sums = values.groupBy("statistic", "cluster").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    drawn = resampling.resampled_sums(sums, ["s", "c"], DRAWS, SEED, ["statistic"])
    ends = bootstrap.interval(drawn.select("statistic", (F.col("s") / F.col("c")).alias("mean")), keys=["statistic"])
    point = sums.groupBy("statistic").agg(F.round(F.sum("s") / F.sum("c"), 6).alias("estimate"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    whole = drawn.groupBy("statistic").agg(F.min("n_drawn").alias("least_drawn"), F.max("n_drawn").alias("most_drawn"))
    return ends.join(point, "statistic").join(whole, "statistic")


def resampling_catalogue(spark, sf_dir):
    """Means by step, all seven paired changes, three rates of recovery and the jump of the embedding score between the
    first two steps, each with its interval over resampled subjects (SA7, SA8, SA9)."""
    s = scores(spark, sf_dir)
    _, _, facts = metrics(metric_rows(spark, sf_dir), ["qid", "instruction_type", "step"])
    mean = s.select(F.concat(F.lit("mean_"), F.col("step").cast("string")).alias("statistic"), F.col("qid").cast("string").alias("cluster"), F.col("score").alias("v"))
    jump = _paired(token_matching(spark, sf_dir), "f1_consecutive", "embedding", ((1, 2),))
    return _intervals(mean.unionByName(_paired(s, "score", "answer", ANSWER_DELTAS)).unionByName(_paired(facts, "factscore", "facts", FACT_DELTAS)).unionByName(_recovered(s, "recovered", RECOVERED)).unionByName(jump))


def recovery_intervals(spark, sf_dir):
    """The rate of recovery at seven thresholds with its interval over resampled subjects (SA19)."""
    return _intervals(_recovered(scores(spark, sf_dir), "at", {str(t): t for t in THRESHOLDS}))


def mediation_intervals(spark, sf_dir):
    """Intervals of the mediated and the direct effect and of the mediated share over resampled subjects; resamples
    whose equations are singular drop out (SA13)."""
    s = scores(spark, sf_dir).select("qid", F.col("step").cast("double").alias("t"), F.ln(F.greatest(F.col("n_events").cast("double"), F.lit(1.0))).alias("m"), F.col("score").alias("y"))
    products = [F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in PRODUCTS]
    sums = s.groupBy(F.col("qid").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "tmy"], *products)
    d = resampling.resampled_sums(sums, ["n", "t", "m", "y", *[a + b for a, b in PRODUCTS]], DRAWS, SEED)
    cov = lambda a, b: F.col(a + b) / F.col("n") - F.col(a) * F.col(b) / (F.col("n") * F.col("n"))
    d = d.select("b", *[cov(a, b).alias(f"c_{a}{b}") for a, b in PRODUCTS])
    det = F.col("c_tt") * F.col("c_mm") - F.col("c_tm") * F.col("c_tm")
    ab = F.try_divide("c_tm", F.col("c_tt")) * F.try_divide(F.col("c_tt") * F.col("c_my") - F.col("c_tm") * F.col("c_ty"), det)
    direct = F.try_divide(F.col("c_mm") * F.col("c_ty") - F.col("c_tm") * F.col("c_my"), det)
    share = F.try_divide(ab, F.try_divide("c_ty", F.col("c_tt")))
    each = F.array(*[F.struct(F.lit(n).alias("effect"), v.alias("mean")) for n, v in (("mediated", ab), ("direct", direct), ("share", share))])
    return bootstrap.interval(d.select(F.explode(each).alias("x")).select("x.*").where("mean is not null"), keys=["effect"])


PRODUCTS = (("t", "t"), ("t", "m"), ("t", "y"), ("m", "m"), ("m", "y"))


def _paired_sql(source: str, value: str, name: str, deltas) -> str:
    wide = f"SELECT CAST(qid AS VARCHAR) AS cluster, {', '.join(f'avg({value}) FILTER (WHERE step = {k}) AS s{k}' for k in STEPS)} FROM {source} GROUP BY qid"
    return " UNION ALL ".join(f"SELECT 'delta_{name}_{a}_{b}' AS statistic, cluster, s{b} - s{a} AS v FROM ({wide}) WHERE s{b} - s{a} IS NOT NULL" for a, b in deltas)


def _recovered_sql(name: str, thresholds: dict[str, float]) -> str:
    wide = f"SELECT qid, instruction_type, {', '.join(f'max(score) FILTER (WHERE step = {k}) AS s{k}' for k in STEPS)} FROM scores GROUP BY ALL"
    return " UNION ALL ".join(f"SELECT '{name}_{k}' AS statistic, CAST(qid AS VARCHAR) AS cluster, coalesce(greatest(s1, s2, s3) >= {t}, false)::INT::DOUBLE AS v FROM ({wide}) WHERE s0 < {LOW}" for k, t in thresholds.items())


_INTERVALS = f"""k AS (SELECT statistic, cluster, sum(v) AS s, count(*) AS c FROM v GROUP BY ALL), {resampling.resampled_sql('k', ['s', 'c'], DRAWS, SEED, ['statistic'])},
e AS (SELECT statistic, count(*) AS draws, round(quantile_cont(s / c, 0.025), 6) AS ci_lo, round(quantile_cont(s / c, 0.975), 6) AS ci_hi, min(n_drawn) AS least_drawn, max(n_drawn) AS most_drawn FROM rs GROUP BY statistic),
p AS (SELECT statistic, round(sum(s) / sum(c), 6) AS estimate, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_clusters FROM k GROUP BY statistic)
SELECT statistic, draws, ci_lo, ci_hi, estimate, n, n_clusters, least_drawn, most_drawn FROM e JOIN p USING (statistic)"""

RESAMPLING_CATALOGUE = f"""WITH {SCORES_SQL}, {metrics_sql(['qid', 'instruction_type', 'step'])}, matching AS ({TOKEN_MATCHING}),
v AS (SELECT 'mean_' || step AS statistic, CAST(qid AS VARCHAR) AS cluster, score AS v FROM scores UNION ALL {_paired_sql('scores', 'score', 'answer', ANSWER_DELTAS)}
UNION ALL {_paired_sql('ofs', 'factscore', 'facts', FACT_DELTAS)} UNION ALL {_recovered_sql('recovered', RECOVERED)} UNION ALL {_paired_sql('matching', 'f1_consecutive', 'embedding', ((1, 2),))}), {_INTERVALS}"""

RECOVERY_INTERVALS = f"WITH {SCORES_SQL}, v AS ({_recovered_sql('at', {str(t): t for t in THRESHOLDS})}), {_INTERVALS}"

MEDIATION_INTERVALS = f"""WITH {SCORES_SQL}, x AS (SELECT qid, CAST(step AS DOUBLE) AS t, ln(greatest(CAST(n_events AS DOUBLE), 1)) AS m, score AS y FROM scores),
k AS (SELECT qid AS cluster, count(*) AS n, sum(t) AS t, sum(m) AS m, sum(y) AS y, {', '.join(f'sum({a} * {b}) AS {a}{b}' for a, b in PRODUCTS)} FROM x GROUP BY qid),
{resampling.resampled_sql('k', ['n', 't', 'm', 'y', *[a + b for a, b in PRODUCTS]], DRAWS, SEED)},
c AS (SELECT b, {', '.join(f'{a}{b} / n - {a} * {b} / (n * n) AS c_{a}{b}' for a, b in PRODUCTS)} FROM rs),
f AS (SELECT c_tm / nullif(c_tt, 0) * (c_tt * c_my - c_tm * c_ty) / nullif(c_tt * c_mm - c_tm * c_tm, 0) AS ab, (c_mm * c_ty - c_tm * c_my) / nullif(c_tt * c_mm - c_tm * c_tm, 0) AS d, c_ty / nullif(c_tt, 0) AS c FROM c),
e AS (SELECT unnest(['mediated', 'direct', 'share']) AS effect, unnest([ab, d, ab / nullif(c, 0)]) AS v FROM f)
SELECT effect, count(*) AS draws, round(quantile_cont(v, 0.025), 6) AS ci_lo, round(quantile_cont(v, 0.975), 6) AS ci_hi FROM e WHERE v IS NOT NULL GROUP BY effect"""

JOBS = {"resampling_catalogue": (resampling_catalogue, RESAMPLING_CATALOGUE), "recovery_intervals": (recovery_intervals, RECOVERY_INTERVALS), "mediation_intervals": (mediation_intervals, MEDIATION_INTERVALS)}
