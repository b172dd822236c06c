"""Queries over longitudinal scores, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators.distributions import finished, sign_p
from palimpsest.operators import aggregates, bootstrap, chains, mixed, ranks, regression, survival
from palimpsest.sources.adapters import SCORES_SQL, scores, subject_means, subject_sql, table

STEPS = [0, 1, 2, 3]
KEYS = ["qid", "instruction_type"]


def score_summary(spark, sf_dir):
    """Mean, std, median, n, standard error and interval by instruction and step (AG1-AG4)."""
    return aggregates.describe(scores(spark, sf_dir), ["instruction_type", "step"], "score")


SCORE_SUMMARY = f"""WITH {SCORES_SQL} SELECT instruction_type, step, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median, count(score) AS n,
round(stddev_samp(score) / sqrt(count(score)), 6) AS sem, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE 1.96 * stddev_samp(score) / sqrt(count(*)) END, 6) AS ci95 FROM scores GROUP BY ALL"""


def score_rollup(spark, sf_dir):
    """Means per instruction and hop, per each, and over all, in one pass (AG2, SA25's grouping)."""
    return aggregates.grouped_means(scores(spark, sf_dir), [["instruction_type", "n_hop"], ["instruction_type"], ["n_hop"], []], "score")


SCORE_ROLLUP = f"WITH {SCORES_SQL} SELECT instruction_type, n_hop, round(avg(score), 6) AS mean, count(score) AS n FROM scores GROUP BY GROUPING SETS ((instruction_type, n_hop), (instruction_type), (n_hop), ())"


def score_pivot(spark, sf_dir):
    """Mean and median by instruction, a column per step (AG6, AG7)."""
    s = scores(spark, sf_dir)
    by = ["instruction_type", "step"]
    cells = aggregates.with_quantiles(s.groupBy(*by).agg(F.round(F.avg("score"), 6).alias("mean")), s, by, "score", {"median": 0.5})
    wide = cells.groupBy("instruction_type").pivot("step", STEPS).agg(F.first("mean").alias("mean"), F.round(F.first("median"), 6).alias("median"))
    return wide.select("instruction_type", *[F.col(f"{k}_mean").alias(f"s{k}") for k in STEPS], *[F.col(f"{k}_median").alias(f"m{k}") for k in STEPS])


SCORE_PIVOT = f"WITH {SCORES_SQL} SELECT instruction_type, {', '.join(f'round(avg(score) FILTER (WHERE step = {k}), 6) AS s{k}, round(median(score) FILTER (WHERE step = {k}), 6) AS m{k}' for k in STEPS)} FROM scores GROUP BY instruction_type"


def predictability(spark, sf_dir):
    """Mean, P90 and P90 - P10 by step (AG9, AG10)."""
    return aggregates.predictability(scores(spark, sf_dir), ["step"], "score")


PREDICTABILITY = f"WITH {SCORES_SQL} SELECT step, round(avg(score), 4) AS performance, round(quantile_cont(score, 0.9), 4) AS aptitude, round(quantile_cont(score, 0.9) - quantile_cont(score, 0.1), 4) AS unreliability FROM scores GROUP BY step"


def degradation(spark, sf_dir):
    """First against last step of each question and instruction (AG11, SA35)."""
    return aggregates.degradation(scores(spark, sf_dir), KEYS, "score")


DEGRADATION = f"""WITH {SCORES_SQL}, f AS (SELECT qid, instruction_type, arg_min(score, step) AS a, arg_max(score, step) AS b FROM scores GROUP BY ALL HAVING count(*) >= 2)
SELECT qid, instruction_type, round(a, 6) AS first, round(b, 6) AS last, CASE WHEN b - a < -0.01 THEN 'DEGRADED' WHEN b - a > 0.01 THEN 'IMPROVED' ELSE 'STABLE' END AS pattern FROM f"""


def variance_components(spark, sf_dir):
    """Between questions, between instructions of a question, and residual variance (AG12)."""
    return aggregates.variance_components(scores(spark, sf_dir), "qid", "instruction_type", "score")


VARIANCE_COMPONENTS = f"""WITH {SCORES_SQL}, u AS (SELECT qid, instruction_type, avg(score) AS m, var_samp(score) AS v FROM scores GROUP BY ALL), s AS (SELECT qid, avg(m) AS sm, var_samp(m) AS sv, avg(v) AS rv FROM u GROUP BY qid),
p AS (SELECT var_samp(sm) AS b, avg(sv) AS u, avg(rv) AS r FROM s) SELECT round(b, 6) AS "between", round(u, 6) AS units, round(r, 6) AS residual, round(b / (b + u + r), 6) AS icc_subject, round(u / (b + u + r), 6) AS icc_unit FROM p"""


def score_histogram(spark, sf_dir):
    """Right-closed bands and sixty even bins of the scores (AG26, AG27)."""
    s = scores(spark, sf_dir)
    return s.groupBy(aggregates.right_closed_bins(F.col("score"), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("band"), F.floor(F.col("score") * 60).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


SCORE_HISTOGRAM = f"""WITH {SCORES_SQL} SELECT CASE WHEN score >= 0 AND score <= 0.2 THEN 0 WHEN score > 0.2 AND score <= 0.4 THEN 1 WHEN score > 0.4 AND score <= 0.6 THEN 2 WHEN score > 0.6 AND score <= 0.8 THEN 3 WHEN score > 0.8 AND score <= 1 THEN 4 END AS band,
CAST(floor(score * 60) AS BIGINT) AS bin, count(*) AS n FROM scores GROUP BY ALL"""


def what_if(spark, sf_dir):
    """Mean per instruction as it is, and with low scores of busy weeks set to one; its change against the step before (AG23)."""
    s = scores(spark, sf_dir)
    fixed = F.when((F.col("score") < 0.3) & (F.col("n_events") >= 3), 1.0).otherwise(F.col("score"))
    m = s.groupBy("instruction_type", "step").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(fixed), 6).alias("what_if"))
    return m.withColumn("delta", F.round(F.col("mean") - F.lag("mean").over(Window.partitionBy("instruction_type").orderBy("step")), 6))


WHAT_IF = f"""WITH {SCORES_SQL}, m AS (SELECT instruction_type, step, round(avg(score), 6) AS mean, round(avg(CASE WHEN score < 0.3 AND n_events >= 3 THEN 1.0 ELSE score END), 6) AS what_if FROM scores GROUP BY ALL)
SELECT *, round(mean - lag(mean) OVER (PARTITION BY instruction_type ORDER BY step), 6) AS delta FROM m"""


def friedman(spark, sf_dir):
    """Repeated-measures rank test over the weeks (SA1, AG5, WN3)."""
    f = ranks.friedman(subject_means(scores(spark, sf_dir), STEPS), STEPS)
    return f.select("n", F.round("chi2", 6).alias("chi2"), "df")


_RANKS = ", ".join(f"{' + '.join(f'(s{o} < s{k})::INT' for o in STEPS)} + ({' + '.join(f'(s{o} = s{k})::INT' for o in STEPS)} + 1) / 2.0 AS r{k}" for k in STEPS)
_TIES = " + ".join(f"pow({' + '.join(f'(s{o} = s{k})::INT' for o in STEPS)}, 2) - 1" for k in STEPS)
FRIEDMAN = f"""WITH {SCORES_SQL}, {subject_sql(STEPS)}, r AS (SELECT {_RANKS}, {_TIES} AS t FROM subj),
a AS (SELECT count(*) AS n, {' + '.join(f'pow(sum(r{k}), 2)' for k in STEPS)} AS q, sum(t) AS t FROM r)
SELECT n, round((12.0 / (n * 4 * 5) * q - 3.0 * n * 5) / (1 - t / (n * 60.0)), 6) AS chi2, 3 AS df FROM a"""


def friedman_holm(spark, sf_dir):
    """The test over three weeks per event type, and Holm's adjustment over the types: with two degrees of freedom p = exp(-chi2 / 2) (SA4)."""
    s = scores(spark, sf_dir)
    wide = s.where("step < 3").groupBy("qid", "instruction_type").pivot("step", [0, 1, 2]).agg(F.first("score")).na.drop()
    wide = wide.select("qid", "instruction_type", *[F.col(str(k)).alias(f"s{k}") for k in (0, 1, 2)])
    f = ranks.friedman(wide, [0, 1, 2], ["instruction_type"]).withColumn("p", F.exp(-F.col("chi2") / 2))
    return ranks.holm(f, [], "p", "instruction_type").select("instruction_type", "n", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


_R3 = ", ".join(f"{' + '.join(f'(s{o} < s{k})::INT' for o in (0, 1, 2))} + ({' + '.join(f'(s{o} = s{k})::INT' for o in (0, 1, 2))} + 1) / 2.0 AS r{k}" for k in (0, 1, 2))
_T3 = " + ".join(f"pow({' + '.join(f'(s{o} = s{k})::INT' for o in (0, 1, 2))}, 2) - 1" for k in (0, 1, 2))
FRIEDMAN_HOLM = f"""WITH {SCORES_SQL}, w AS (SELECT qid, instruction_type, {', '.join(f'max(score) FILTER (WHERE step = {k}) AS s{k}' for k in (0, 1, 2))} FROM scores GROUP BY ALL),
r AS (SELECT instruction_type, {_R3}, {_T3} AS t FROM w WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL),
a AS (SELECT instruction_type, count(*) AS n, pow(sum(r0), 2) + pow(sum(r1), 2) + pow(sum(r2), 2) AS q, sum(t) AS t FROM r GROUP BY ALL),
c AS (SELECT instruction_type, n, (12.0 / (n * 12) * q - 12.0 * n) / (1 - t / (n * 24.0)) AS chi2 FROM a), p AS (SELECT *, exp(-chi2 / 2) AS p FROM c),
h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, instruction_type) + 1)) AS h FROM p)
SELECT instruction_type, n, round(chi2, 6) AS chi2, round(p, 6) AS p, round(max(h) OVER (ORDER BY p, instruction_type ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"""


def wilcoxon(spark, sf_dir):
    """Signed ranks of adjacent weeks, with both effect sizes, zeros dropped or split (SA2, SA3, SA34)."""
    w = subject_means(scores(spark, sf_dir), STEPS)
    pairs = w.select(F.explode(F.array(*[F.struct(F.lit(f"{k}-{k + 1}").alias("contrast"), F.round(F.col(f"s{k + 1}") - F.col(f"s{k}"), 2).alias("d")) for k in (0, 1, 2)])).alias("x")).select("x.*")
    out = None
    for rule in ("wilcox", "zsplit"):
        r = ranks.wilcoxon(pairs, ["contrast"], "d", rule).withColumn("zeros", F.lit(rule))
        out = r if out is None else out.unionByName(r)
    return out.select("contrast", "zeros", "n", "w_plus", "w_minus", *[F.round(c, 6).alias(c) for c in ("z", "r_signed", "r_unsigned")])


def _wilcoxon_sql(rule: str) -> str:
    where = "WHERE d <> 0" if rule == "wilcox" else ""
    return f"""SELECT contrast, '{rule}' AS zeros, n, w_plus, w_minus,
      round((least(w_plus, w_minus) - (n * (n + 1.0) - n0 * (n0 + 1.0)) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - n0 * (n0 + 1.0) * (2 * n0 + 1)) / 24 - (t - n0 * (n0 * n0 - 1)) / 48), 6) AS z,
      round((w_plus - w_minus) / (w_plus + w_minus), 6) AS r_signed, round(1 - 2 * least(w_plus, w_minus) / (n * (n + 1) / 2.0), 6) AS r_unsigned
    FROM (SELECT contrast, count(*) AS n, sum(CASE WHEN d > 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r WHEN d = 0 THEN r / 2 ELSE 0.0 END) AS w_minus,
        sum(c * c - 1) AS t, count(*) FILTER (WHERE d = 0) AS n0
      FROM (SELECT contrast, d, CAST(rank() OVER (PARTITION BY contrast ORDER BY abs(d)) AS DOUBLE) + (count(*) OVER (PARTITION BY contrast, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY contrast, abs(d)) AS c FROM d {where}) GROUP BY contrast)"""


WILCOXON = f"""WITH {SCORES_SQL}, {subject_sql(STEPS)}, d AS ({' UNION ALL '.join(f"SELECT '{k}-{k + 1}' AS contrast, round(s{k + 1} - s{k}, 2) AS d FROM subj" for k in (0, 1, 2))})
{_wilcoxon_sql('wilcox')} UNION ALL {_wilcoxon_sql('zsplit')}"""


def sign_tests(spark, sf_dir):
    """Signs of the change from the first to the last week per instruction and hop, per each, over all, with the exact p (SA22, SA24, SA25)."""
    w = aggregates.wide(scores(spark, sf_dir), ["qid", "instruction_type", "n_hop"], "step", [0, 3], F.first("score")).na.drop()
    c = ranks.sign_counts(w.withColumn("d", F.col("s3") - F.col("s0")), [["instruction_type", "n_hop"], ["instruction_type"], []], "d")
    c = c.select("instruction_type", "n_hop", "n_pos", "n_neg", "n_tie", "n_all")
    p = finished(c, "instruction_type string, n_hop int, n_pos long, n_neg long, n_tie long, n_all long", p=lambda r: sign_p(int(r["n_pos"]), int(r["n_neg"])))
    return p.withColumn("p", F.round("p", 6))


SIGN_TESTS = f"""WITH {SCORES_SQL}, w AS (SELECT qid, instruction_type, n_hop, max(score) FILTER (WHERE step = 0) AS s0, max(score) FILTER (WHERE step = 3) AS s3 FROM scores GROUP BY ALL),
c AS (SELECT instruction_type, n_hop, count(*) FILTER (WHERE s3 > s0) AS n_pos, count(*) FILTER (WHERE s3 < s0) AS n_neg, count(*) FILTER (WHERE s3 = s0) AS n_tie, count(*) AS n_all FROM w WHERE s0 IS NOT NULL AND s3 IS NOT NULL
  GROUP BY GROUPING SETS ((instruction_type, n_hop), (instruction_type), ())), m AS (SELECT *, n_pos + n_neg AS n, least(n_pos, n_neg) AS k FROM c)
SELECT instruction_type, n_hop, n_pos, n_neg, n_tie, n_all, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))) END, 6) AS p FROM m"""


def correlations(spark, sf_dir):
    """Pearson and Spearman of the score and the number of events, per instruction (SA31)."""
    return ranks.spearman(scores(spark, sf_dir), ["instruction_type"], "score", "n_events")


CORRELATIONS = f"""WITH {SCORES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY instruction_type ORDER BY score) + (count(*) OVER (PARTITION BY instruction_type, score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY instruction_type ORDER BY n_events) + (count(*) OVER (PARTITION BY instruction_type, n_events) - 1) / 2.0 AS ry FROM scores)
SELECT instruction_type, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(score, n_events), 6) END AS pearson, CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY instruction_type"""


def repeated_correlation(spark, sf_dir):
    """Correlation of score and events within users (SA32, PRJ12)."""
    return ranks.repeated_correlation(scores(spark, sf_dir), "qid", "score", "n_events")


REPEATED_CORRELATION = f"""WITH {SCORES_SQL}, c AS (SELECT qid, score - avg(score) OVER (PARTITION BY qid) AS x, n_events - avg(n_events) OVER (PARTITION BY qid) AS y FROM scores)
SELECT count(*) AS n, count(*) - count(DISTINCT qid) - 1 AS df, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS r FROM c"""


def contingency(spark, sf_dir):
    """Order priority against status: chi2, G, Cramer's V (SA29, SA30)."""
    return ranks.contingency(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


CONTINGENCY = """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS rt FROM c GROUP BY a), k AS (SELECT b, sum(o) AS ct FROM c GROUP BY b), s AS (SELECT sum(o) AS n FROM c),
e AS (SELECT coalesce(o, 0) AS o, rt * ct / n AS e, n FROM r CROSS JOIN k CROSS JOIN s LEFT JOIN c ON c.a = r.a AND c.b = k.b), t AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk)
SELECT round(sum(pow(o - e, 2) / e), 6) AS chi2, round(sum(CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END), 6) AS g_test, (any_value(nr) - 1) * (any_value(nk) - 1) AS df, round(sqrt(sum(pow(o - e, 2) / e) / (any_value(n) * (least(any_value(nr), any_value(nk)) - 1))), 6) AS cramers_v,
round(min(e), 6) AS least_expected, CAST(any_value(n) AS BIGINT) AS n FROM e, t"""

_EPISODES_SQL = """ep AS (SELECT qid, instruction_type, n_hop, f AS first_hit_step, CAST(coalesce(l, last + 1) - f AS INTEGER) AS duration, CASE WHEN l IS NULL THEN 0 ELSE 1 END AS event_observed FROM
  (SELECT qid, instruction_type, n_hop, any_value(f) AS f, any_value(last) AS last, min(step) FILTER (WHERE step > f AND score < {0}) AS l FROM
    (SELECT *, min(step) FILTER (WHERE step > 0 AND score >= {0}) OVER (PARTITION BY qid, instruction_type) AS f, max(step) OVER (PARTITION BY qid, instruction_type) AS last FROM scores) WHERE f IS NOT NULL GROUP BY ALL))"""


def recovery_episodes(spark, sf_dir):
    """First week at or above the threshold and how long it held (WN2, SA14)."""
    return chains.episodes(scores(spark, sf_dir), [*KEYS, "n_hop"], 0.6)


RECOVERY_EPISODES = f"WITH {SCORES_SQL}, {_EPISODES_SQL.format(0.6)} SELECT * FROM ep"


def kaplan_meier(spark, sf_dir):
    """Survival of the recoveries per instruction (SA15)."""
    return survival.kaplan_meier(recovery_episodes(spark, sf_dir), ["instruction_type"]).withColumns({c: F.round(c, 6) for c in ("survival", "ci_lo", "ci_hi")})


KAPLAN_MEIER = f"""WITH {SCORES_SQL}, {_EPISODES_SQL.format(0.6)}, c AS (SELECT instruction_type, duration, sum(event_observed) AS d, count(*) AS c FROM ep GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY instruction_type ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM c),
s AS (SELECT *, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0.0 END) OVER w AS ls, sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0.0 END) OVER w AS gw, max((d = n)::INT) OVER w AS ended FROM r WINDOW w AS (PARTITION BY instruction_type ORDER BY duration ROWS UNBOUNDED PRECEDING))
SELECT instruction_type, duration, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN ended = 1 THEN 0.0 ELSE exp(ls) END, 6) AS survival,
  round(CASE WHEN ended = 1 THEN 0.0 WHEN ls >= 0 THEN 1.0 ELSE exp(-exp(ln(-ls) + 1.959963984540054 * sqrt(gw) / abs(ls))) END, 6) AS ci_lo, round(CASE WHEN ended = 1 THEN 0.0 WHEN ls >= 0 THEN 1.0 ELSE exp(-exp(ln(-ls) - 1.959963984540054 * sqrt(gw) / abs(ls))) END, 6) AS ci_hi FROM s"""


def survival_summary(spark, sf_dir):
    """Shares of recoveries lost or kept, as published and with censored ones set apart (SA17)."""
    return survival.summary(recovery_episodes(spark, sf_dir), 3)


SURVIVAL_SUMMARY = f"""WITH {SCORES_SQL}, {_EPISODES_SQL.format(0.6)} SELECT count(*) AS n_episodes, CAST(median(duration) AS DOUBLE) AS median_duration, round(avg(event_observed), 6) AS share_events, round(avg((duration = 1)::INT), 6) AS lost_after_one_as_published,
round(avg((duration = 1)::INT * event_observed), 6) AS lost_after_one, round(avg((duration = 3 AND event_observed = 0)::INT), 6) AS stable_full_window FROM ep"""


def recovery_thresholds(spark, sf_dir):
    """Share of chains low in the first week that reach each threshold later (AG18, SA19)."""
    c = scores(spark, sf_dir).groupBy(*KEYS).agg(F.max(F.when(F.col("step") == 0, F.col("score"))).alias("first"), F.max(F.when(F.col("step") > 0, F.col("score"))).alias("best"))
    t = c.where("first < 0.3").select("*", F.explode(F.array(*[F.lit(x / 10) for x in range(3, 10)])).alias("threshold"))
    return t.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("best") >= F.col("threshold")).cast("int"), F.lit(0))), 6).alias("recovered"))


RECOVERY_THRESHOLDS = f"""WITH {SCORES_SQL}, c AS (SELECT qid, instruction_type, max(score) FILTER (WHERE step = 0) AS f, max(score) FILTER (WHERE step > 0) AS b FROM scores GROUP BY ALL)
SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, round(avg(coalesce((b >= t)::INT, 0)), 6) AS recovered FROM c, (SELECT unnest([0.3::DOUBLE, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t) WHERE f < 0.3 GROUP BY t"""


def equivalence(spark, sf_dir):
    """Paired equivalence statistics of the last two weeks (SA18)."""
    w = subject_means(scores(spark, sf_dir), STEPS).withColumn("d", F.col("s3") - F.col("s2"))
    return regression.equivalence(w, "d", 0.02)


EQUIVALENCE = f"""WITH {SCORES_SQL}, {subject_sql(STEPS)}, d AS (SELECT s3 - s2 AS d FROM subj), a AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d)
SELECT n, round(m, 6) AS mean_diff, round(sd, 6) AS sd, round((m + 0.02) / (sd / sqrt(n)), 6) AS t_lower, round((m - 0.02) / (sd / sqrt(n)), 6) AS t_upper FROM a"""


def mediation(spark, sf_dir):
    """Week to events to score, per instruction (SA10-SA12)."""
    s = scores(spark, sf_dir).withColumns({"t": F.col("step").cast("double"), "m": F.ln(F.greatest(F.col("n_events").cast("double"), F.lit(1.0)))})
    return regression.mediation(s, "t", "m", "score", ["instruction_type"])


MEDIATION = f"""WITH {SCORES_SQL}, s AS (SELECT instruction_type, CAST(step AS DOUBLE) AS t, ln(greatest(CAST(n_events AS DOUBLE), 1)) AS m, score AS y FROM scores),
c AS (SELECT instruction_type, count(*) AS n, covar_pop(t, t) AS tt, covar_pop(t, m) AS tm, covar_pop(t, y) AS ty, covar_pop(m, m) AS mm, covar_pop(m, y) AS my FROM s GROUP BY ALL),
k AS (SELECT instruction_type, n, ty / tt AS c, tm / tt AS a, (tt * my - tm * ty) / (tt * mm - tm * tm) AS b, (mm * ty - tm * my) / (tt * mm - tm * tm) AS d FROM c)
SELECT instruction_type, n, round(c, 6) AS c, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS direct, round(a * b, 6) AS ab, round(a * b / c, 4) AS proportion FROM k"""


def bootstrap_interval(spark, sf_dir):
    """Interval of the mean over resampled users, from a sum and a count per user (SA7, AG20)."""
    sums = bootstrap.cluster_sums(scores(spark, sf_dir), "qid", "score")
    return bootstrap.interval(bootstrap.bootstrap_means(sums, 200, 17))


BOOTSTRAP = f"""WITH {SCORES_SQL}, k AS (SELECT qid AS cluster, sum(score) AS s, count(*) AS c FROM scores GROUP BY qid),
u AS (SELECT b, s, c, CAST('0x' || substring(md5('17|' || b || '|' || cluster), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM k, range(200) r(b)),
w AS (SELECT b, s, c, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT + (u >= 0.9999897508033253)::INT AS w FROM u),
m AS (SELECT b, sum(w * s) / sum(w * c) AS mean FROM w GROUP BY b) SELECT count(*) AS draws, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM m"""


def mixed_model(spark, sf_dir):
    """Random-intercept model of the score on the week (SA5, SA6); an iterative fit, so without SQL."""
    s = scores(spark, sf_dir).withColumn("week", F.col("step").cast("double"))
    m = mixed.fit(s, "score", mixed.Design().term("week"), "qid")
    rows = [(*r, m.ratio, m.icc, m.n, m.groups) for r in m.table()]
    return spark.createDataFrame(rows, "term string, coef double, se double, z double, p double, variance_ratio double, icc double, n long, `groups` long")


def log_rank(spark, sf_dir):
    """Whether recoveries last equally long under all instructions (SA16); a quadratic form, so without SQL."""
    stat, df, p = survival.log_rank(recovery_episodes(spark, sf_dir), "instruction_type")
    return spark.createDataFrame([(stat, df, p)], "statistic double, df int, p double")


JOBS = {
    "score_summary": (score_summary, SCORE_SUMMARY), "score_rollup": (score_rollup, SCORE_ROLLUP), "score_pivot": (score_pivot, SCORE_PIVOT), "predictability": (predictability, PREDICTABILITY),
    "degradation": (degradation, DEGRADATION), "variance_components": (variance_components, VARIANCE_COMPONENTS), "score_histogram": (score_histogram, SCORE_HISTOGRAM), "what_if": (what_if, WHAT_IF),
    "friedman": (friedman, FRIEDMAN), "friedman_holm": (friedman_holm, FRIEDMAN_HOLM), "wilcoxon": (wilcoxon, WILCOXON), "sign_tests": (sign_tests, SIGN_TESTS), "correlations": (correlations, CORRELATIONS),
    "repeated_correlation": (repeated_correlation, REPEATED_CORRELATION), "contingency": (contingency, CONTINGENCY), "recovery_episodes": (recovery_episodes, RECOVERY_EPISODES), "kaplan_meier": (kaplan_meier, KAPLAN_MEIER),
    "survival_summary": (survival_summary, SURVIVAL_SUMMARY), "recovery_thresholds": (recovery_thresholds, RECOVERY_THRESHOLDS), "equivalence": (equivalence, EQUIVALENCE), "mediation": (mediation, MEDIATION),
    "bootstrap_interval": (bootstrap_interval, BOOTSTRAP), "mixed_model": (mixed_model, None), "log_rank": (log_rank, None),
}
