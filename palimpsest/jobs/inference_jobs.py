"""Queries of tests with their p-values, bootstraps of clusters and report scalars, with the SQL of the same rows.

Spark reduces the data to counts or sums per test; p-values are then computed on the few rows that are left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import labels, text
from palimpsest.jobs import stats_jobs
from palimpsest.operators import aggregates, bootstrap, ranks
from palimpsest.operators.distributions import binomial_greater, chi2_tail, finished, fisher_exact, normal_tail
from palimpsest.sources.adapters import CHAINS_SQL, SCORES_SQL, chains, metric_rows, metrics_sql, scores, table

STEPS = [0, 1, 2, 3]
_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


def sign_against_value(spark, sf_dir):
    """Scores of the last week against .5, one-sided below, ties dropped, by instruction; and all rows without that rule (SA23, SA24)."""
    s = scores(spark, sf_dir).where("step = 3")
    c = s.groupBy("instruction_type").agg(F.count_if(F.col("score") < 0.5).alias("n_below"), F.count_if(F.col("score") != 0.5).alias("n"), F.count(F.lit(1)).alias("n_all"))
    out = finished(c, "instruction_type string, n_below long, n long, n_all long", p=lambda r: binomial_greater(r["n_below"], r["n"], 0.5), p_all=lambda r: binomial_greater(r["n_below"], r["n_all"], 0.5))
    return out.select("instruction_type", "n_below", "n", "n_all", F.round("p", 6).alias("p"), F.round("p_all", 6).alias("p_all"))


def _upper(k: str, n: str, p: float) -> str:
    c = _CHOOSE.format(n, "i")
    return f"round(least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp({c} + i * ln({p}) + ({n} - i) * ln({1 - p}))))), 6)"


SIGN_AGAINST_VALUE = f"""WITH {SCORES_SQL}, c AS (SELECT instruction_type, count(*) FILTER (WHERE score < 0.5) AS k, count(*) FILTER (WHERE score <> 0.5) AS n, count(*) AS m FROM scores WHERE step = 3 GROUP BY ALL)
SELECT instruction_type, k AS n_below, n, m AS n_all, CASE WHEN k = 0 THEN 1.0 ELSE {_upper('k', 'n', 0.5)} END AS p, CASE WHEN k = 0 THEN 1.0 ELSE {_upper('k', 'm', 0.5)} END AS p_all FROM c"""


def rare_event_test(spark, sf_dir):
    """Whether more than five percent of the values of an instruction are above 95, by an exact binomial test (SA27)."""
    c = metric_rows(spark, sf_dir).groupBy("instruction_type").agg(F.count_if(F.col("cents") > 9500).alias("k"), F.count(F.lit(1)).alias("n"))
    return finished(c, "instruction_type string, k long, n long", p=lambda r: binomial_greater(r["k"], r["n"], 0.05)).withColumn("p", F.round("p", 6))


RARE_EVENT_TEST = f"""WITH {metrics_sql(['qid'])}, c AS (SELECT instruction_type, count(*) FILTER (WHERE cents > 9500) AS k, count(*) AS n FROM mrows GROUP BY ALL)
SELECT instruction_type, k, n, CASE WHEN k = 0 THEN 1.0 ELSE {_upper('k', 'n', 0.05)} END AS p FROM c"""


def uniform_fit(spark, sf_dir):
    """chi2 of the counts of a hop's instructions against a uniform split, however many there are (SA28)."""
    c = metric_rows(spark, sf_dir).groupBy("n_hop", "instruction_type").agg(F.count(F.lit(1)).alias("o")).groupBy("n_hop").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o")).alias("q"), F.count(F.lit(1)).alias("k"))
    x = F.col("q") * F.col("k") / F.col("n") - F.col("n")
    found = c.select("n_hop", "n", x.alias("x"), (F.col("k") - 1).alias("df"))
    out = finished(found, "n_hop int, n long, x double, df long", p=lambda r: chi2_tail(r["x"], int(r["df"])) if r["df"] else 1.0)
    return out.select("n_hop", "n", F.round("x", 6).alias("chi2"), "df", F.round("p", 6).alias("p"))


UNIFORM_FIT = f"""WITH {metrics_sql(['qid'])}, o AS (SELECT n_hop, instruction_type, count(*) AS o FROM mrows GROUP BY ALL), c AS (SELECT n_hop, CAST(sum(o) AS BIGINT) AS n, CAST(sum(o * o) AS DOUBLE) * count(*) / sum(o) - sum(o) AS x, count(*) - 1 AS df FROM o GROUP BY n_hop)
SELECT n_hop, n, round(x, 6) AS chi2, df, CASE WHEN df = 0 OR x <= 0 THEN 1.0 ELSE round(greatest(0.0, 1 - list_sum(list_transform(range(0, 600), lambda i: exp((df / 2.0 + i) * ln(x / 2) - x / 2 - lgamma(df / 2.0 + i + 1))))), 6) END AS p FROM c"""


def fisher_tables(spark, sf_dir):
    """Fisher's exact test of hop 2 against high scores in the first week, by instruction (SA26)."""
    s = scores(spark, sf_dir).where("step = 0")
    hop, high = F.col("n_hop") == 2, F.col("score") >= 0.5
    c = s.groupBy("instruction_type").agg(F.count_if(hop & high).alias("a"), F.count_if(hop & ~high).alias("b"), F.count_if(~hop & high).alias("c"), F.count_if(~hop & ~high).alias("d"))
    return finished(c, "instruction_type string, a long, b long, c long, d long", p=lambda r: fisher_exact(r["a"], r["b"], r["c"], r["d"])).withColumn("p", F.round("p", 6))


_HYPER = "(lgamma(a + b + 1) - lgamma({0} + 1) - lgamma(a + b - {0} + 1) + lgamma(c + d + 1) - lgamma(a + c - {0} + 1) - lgamma(d - a + {0} + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))"
FISHER_TABLES = f"""WITH {SCORES_SQL}, t AS (SELECT instruction_type, count(*) FILTER (WHERE n_hop = 2 AND score >= 0.5) AS a, count(*) FILTER (WHERE n_hop = 2 AND score < 0.5) AS b, count(*) FILTER (WHERE n_hop <> 2 AND score >= 0.5) AS c, count(*) FILTER (WHERE n_hop <> 2 AND score < 0.5) AS d FROM scores WHERE step = 0 GROUP BY ALL),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t), l AS (SELECT *, {_HYPER.format('x')} AS lx, {_HYPER.format('a')} AS la FROM x)
SELECT instruction_type, a, b, c, d, round(least(1.0, sum(exp(lx)) FILTER (WHERE lx <= la + 1e-9)), 6) AS p FROM l GROUP BY ALL"""


_ERF = "(2 / sqrt(pi()) * exp(-{0} * {0}) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(greatest({0}, 1e-300)) + 0.5 * ln(pi()) - lgamma(i + 1.5) - ln(2.0)))))"


def wilcoxon_p(spark, sf_dir):
    """Signed-rank tests of adjacent weeks with their two-sided normal p, and Holm's adjustment within each rule for zeros (SA2, SA3, SA34)."""
    w = stats_jobs.wilcoxon(spark, sf_dir).select("contrast", "zeros", "n", "z", "r_signed")
    p = finished(w, "contrast string, zeros string, n long, z double, r_signed double", p=lambda r: 2 * normal_tail(abs(r["z"]))).withColumn("p", F.round("p", 6))
    return ranks.holm(p, ["zeros"], "p", "contrast").withColumn("p_holm", F.round("p_holm", 6))


WILCOXON_P = f"""WITH w AS ({stats_jobs.WILCOXON}), p AS (SELECT contrast, zeros, n, z, r_signed, round(1 - {_ERF.format('(abs(z) / sqrt(2.0))')}, 6) AS p FROM w),
h AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY zeros) - row_number() OVER (PARTITION BY zeros ORDER BY p, contrast) + 1)) AS h FROM p)
SELECT contrast, zeros, n, z, r_signed, p, round(max(h) OVER (PARTITION BY zeros ORDER BY p, contrast ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"""


def inference_summary(spark, sf_dir):
    """The tests of all families in one frame, with a line of text each (SA21, SA36, SC21)."""
    f = stats_jobs.friedman_holm(spark, sf_dir).select(F.lit("friedman").alias("family"), F.col("instruction_type").alias("test"), "n", F.col("chi2").alias("statistic"), F.col("p_holm").alias("p"))
    w = wilcoxon_p(spark, sf_dir).select(F.concat_ws(" ", F.lit("wilcoxon"), "zeros").alias("family"), F.col("contrast").alias("test"), "n", F.col("z").alias("statistic"), F.col("p_holm").alias("p"))
    u = uniform_fit(spark, sf_dir).select(F.lit("uniform").alias("family"), F.col("n_hop").cast("string").alias("test"), "n", F.col("chi2").alias("statistic"), "p")
    every = f.unionByName(w).unionByName(u).withColumn("stars", labels.stars(F.col("p")))
    return every.withColumn("line", F.concat_ws(" ", "family", "test", F.concat(F.lit("n="), F.col("n").cast("string")), "stars"))


INFERENCE_SUMMARY = f"""WITH e AS (SELECT 'friedman' AS family, instruction_type AS test, n, chi2 AS statistic, p_holm AS p FROM ({stats_jobs.FRIEDMAN_HOLM})
UNION ALL SELECT 'wilcoxon ' || zeros, contrast, n, z, p_holm FROM ({WILCOXON_P}) UNION ALL SELECT 'uniform', CAST(n_hop AS VARCHAR), n, chi2, p FROM ({UNIFORM_FIT})),
s AS (SELECT *, CASE WHEN p IS NULL OR isnan(p) THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM e)
SELECT *, concat_ws(' ', family, test, 'n=' || n, stars) AS line FROM s"""


DRAWS, SEED = 200, 23


def bootstrap_catalogue(spark, sf_dir):
    """Intervals of the mean per week, of paired changes and of recovery rates, over one set of resampled users (SA8, SA9)."""
    s = scores(spark, sf_dir)
    per_step = s.groupBy(F.concat(F.lit("mean_"), F.col("step").cast("string")).alias("statistic"), F.col("qid").alias("cluster")).agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("c"))
    w = aggregates.wide(s, ["qid", "instruction_type"], "step", STEPS, F.first("score"))
    pairs = [(0, 1), (1, 2), (2, 3), (0, 2), (0, 3), (1, 3)]
    wanted = [(f"delta_{a}_{b}", F.col(f"s{b}") - F.col(f"s{a}")) for a, b in pairs]
    wanted += [(f"recovered_{t}", F.when(F.col("s0") < 0.3, (F.greatest("s1", "s2", "s3") >= t / 10).cast("double"))) for t in (5, 7, 9)]
    long = w.select("qid", F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), v.alias("v")) for n, v in wanted])).alias("x")).select("qid", "x.*").where("v is not null")
    sums = per_step.unionByName(long.groupBy("statistic", F.col("qid").alias("cluster")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c")))
    means = bootstrap.bootstrap_means(sums, DRAWS, SEED, ["statistic"])
    point = sums.groupBy("statistic").agg(F.round(F.sum("s") / F.sum("c"), 6).alias("estimate"), F.sum("c").alias("n"))
    return bootstrap.interval(means, keys=["statistic"]).join(point, "statistic")


def _weights(sums: str) -> str:
    edges = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
    return f"""wt AS (SELECT *, {' + '.join(f'(u >= {e})::INT' for e in edges)} AS w FROM (SELECT *, CAST('0x' || substring(md5('{SEED}|' || b || '|' || cluster), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM {sums}, range({DRAWS}) r(b)))"""


BOOTSTRAP_CATALOGUE = f"""WITH {SCORES_SQL}, wd AS (SELECT qid, instruction_type, {', '.join(f'max(score) FILTER (WHERE step = {k}) AS s{k}' for k in STEPS)} FROM scores GROUP BY ALL),
l AS ({' UNION ALL '.join(f"SELECT qid, 'delta_{a}_{b}' AS statistic, s{b} - s{a} AS v FROM wd" for a, b in ((0, 1), (1, 2), (2, 3), (0, 2), (0, 3), (1, 3)))}
  UNION ALL {' UNION ALL '.join(f"SELECT qid, 'recovered_{t}', CASE WHEN s0 < 0.3 THEN (greatest(s1, s2, s3) >= {t / 10})::INT::DOUBLE END FROM wd" for t in (5, 7, 9))}),
k AS (SELECT statistic, qid AS cluster, sum(v) AS s, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY ALL UNION ALL SELECT 'mean_' || step, qid, sum(score), count(*) FROM scores GROUP BY step, qid),
{_weights('k')}, m AS (SELECT statistic, b, sum(w * s) / nullif(sum(w * c), 0) AS mean FROM wt GROUP BY ALL), p AS (SELECT statistic, round(sum(s) / sum(c), 6) AS estimate, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY statistic)
SELECT statistic, count(*) AS draws, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi, any_value(estimate) AS estimate, any_value(n) AS n FROM m JOIN p USING (statistic) GROUP BY statistic"""


def mediation_bootstrap(spark, sf_dir):
    """Interval of the mediated effect of the week over resampled users; singular resamples drop out (SA13).

    The normal equations are sums, so a user's own sums, weighted, are all a resample needs.
    """
    s = scores(spark, sf_dir).select("qid", F.col("step").cast("double").alias("t"), F.ln(F.greatest(F.col("n_events").cast("double"), F.lit(1.0))).alias("m"), F.col("score").alias("y"))
    names = ("t", "m", "y")
    products = [F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("tt", "tm", "ty", "mm", "my")]
    sums = s.groupBy(F.col("qid").alias("cluster")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in names], *products)
    drawn = bootstrap.weighted_sums(sums, ["n", *names, "tt", "tm", "ty", "mm", "my"], DRAWS, SEED)
    cov = lambda a, b: F.col(a + b) / F.col("n") - F.col(a) * F.col(b) / (F.col("n") * F.col("n"))
    effect = F.try_divide(cov("t", "m"), cov("t", "t")) * F.try_divide(cov("t", "t") * cov("m", "y") - cov("t", "m") * cov("t", "y"), cov("t", "t") * cov("m", "m") - cov("t", "m") * cov("t", "m"))
    return bootstrap.interval(drawn.select(effect.alias("mean")).where("mean is not null"))


_COV = lambda a, b: f"({a}{b} / n - {a} * {b} / (n * n))"
MEDIATION_BOOTSTRAP = f"""WITH {SCORES_SQL}, x AS (SELECT qid, CAST(step AS DOUBLE) AS t, ln(greatest(CAST(n_events AS DOUBLE), 1)) AS m, score AS y FROM scores),
k AS (SELECT qid AS cluster, CAST(count(*) AS DOUBLE) AS n, sum(t) AS t, sum(m) AS m, sum(y) AS y, sum(t * t) AS tt, sum(t * m) AS tm, sum(t * y) AS ty, sum(m * m) AS mm, sum(m * y) AS my FROM x GROUP BY qid),
{_weights('k')}, d AS (SELECT b, {', '.join(f'sum(w * {c}) AS {c}' for c in ('n', 't', 'm', 'y', 'tt', 'tm', 'ty', 'mm', 'my'))} FROM wt GROUP BY b),
e AS (SELECT {_COV('t', 'm')} / nullif({_COV('t', 't')}, 0) * ({_COV('t', 't')} * {_COV('m', 'y')} - {_COV('t', 'm')} * {_COV('t', 'y')}) / nullif({_COV('t', 't')} * {_COV('m', 'm')} - {_COV('t', 'm')} * {_COV('t', 'm')}, 0) AS mean FROM d)
SELECT count(*) AS draws, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM e WHERE mean IS NOT NULL"""


def design_columns(spark, sf_dir):
    """Intercept, treatment and a dummy per level but the first in order, of each row of scores (SA11, SA5b's interactions)."""
    s = scores(spark, sf_dir)
    levels = ["click", "error", "purchase", "signup", "view"]
    dummies = {f"is_{v}": (F.col("instruction_type") == v).cast("int") for v in levels[1:]}
    return s.select("qid", "instruction_type", "step", F.lit(1).alias("intercept"), (F.col("step") > 0).cast("int").alias("treat"), *[c.alias(n) for n, c in dummies.items()], *[(F.col("step") * c).alias(f"step_{n}") for n, c in dummies.items()])


DESIGN_COLUMNS = f"WITH {SCORES_SQL} SELECT qid, instruction_type, step, 1 AS intercept, (step > 0)::INT AS treat, {', '.join(f'''(instruction_type = '{v}')::INT AS is_{v}, step * (instruction_type = '{v}')::INT AS step_is_{v}''' for v in ('error', 'purchase', 'signup', 'view'))} FROM scores"


def short_answers(spark, sf_dir):
    """Lead-ins stripped and the first sentence kept; whether that equals the normalised turn before (SC3, SC20, SC9)."""
    c = chains(spark, sf_dir)
    said = F.concat(F.element_at(F.array(*map(F.lit, ("The answer is: ", "Based on the text, ", "According to the passage ", ""))), (F.col("step") % 4 + 1).cast("int")), F.col("text"))
    short = text.short_answer(F.col("said"))
    return c.withColumn("said", said).select("qid", "run", "step", short.alias("short"), text.exact_match(short, F.col("text")).alias("exact"), text.topic(F.col("text"), F.col("qid")).alias("topic"))


SHORT_ANSWERS = rf"""WITH {CHAINS_SQL}, s AS (SELECT *, list_extract(['The answer is: ', 'Based on the text, ', 'According to the passage ', ''], step % 4 + 1) || text AS said FROM chains),
t AS (SELECT *, trim(regexp_replace(said, '^(the answer is\s*:?\s*|based on (the )?(text|passage|context)[,.]?\s*|according to (the )?(text|passage)[,.]?\s*|the .{{0,60}} is not explicitly mentioned[^.]*\.\s*)', '', 'i'), E' \t\n\r') AS bare FROM s),
f AS (SELECT *, trim(regexp_extract(bare, '^(?s:.*?[.!?])(?:\s|$)'), E' \t\n\r') AS first FROM t), a AS (SELECT *, CASE WHEN first = '' THEN bare ELSE first END AS short FROM f)
SELECT qid, run, step, short, (array_to_string({text.TOKENS_SQL.format('short')}, ' ') = array_to_string({text.TOKENS_SQL.format('text')}, ' '))::INT AS exact,
coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 200), qid) AS topic FROM a"""


def judge_replies(spark, sf_dir):
    """Labels read from replies of a judge: true or false wherever it stands, JSON, cut-off JSON, and waiting times (SC12-SC15, SC26).

    Stand-ins: replies are made of an event's number, type and value.
    """
    e = table(spark, sf_dir, "events").where("event_type is not null and value is not null")
    k = (F.col("event_id") % 6 + 1).cast("int")
    plain = F.element_at(F.array(*map(F.lit, ("True.", "The claim is FALSE", "False. Actually true", "True? No, false", "I do not know", "Yes"))), k)
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    coded = F.when(k < 4, F.concat(F.lit('Sure: {"label": "'), F.upper("event_type"), F.lit('", "lost": ["a'), cents, F.lit('", "b"]}'))).when(k < 6, F.concat(F.lit('{"lost": ["a'), cents, F.lit('", "b", "c of '), "event_type")).otherwise(F.lit("no JSON"))
    wait = F.concat(F.lit("Rate limit, try again in "), cents, F.when(k < 4, "ms").otherwise("s"))
    r = e.select("event_id", plain.alias("plain"), coded.alias("coded"), wait.alias("wait"))
    return r.select(
        "event_id", labels.support_label(F.col("plain")).alias("support"), labels.json_label(F.col("coded"), ["click", "view", "purchase"], "other").alias("label"),
        F.concat_ws(",", labels.quoted_items(F.col("coded"), "lost")).alias("lost"), F.round(labels.retry_seconds(F.col("wait")), 6).alias("wait_seconds"),
    )


JUDGE_REPLIES = r"""WITH r AS (SELECT event_id, event_id % 6 + 1 AS k, event_type AS t, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS c FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)
SELECT event_id, CASE WHEN k IN (1, 3, 6) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS support,
CASE WHEN k < 6 AND t IN ('click', 'view', 'purchase') THEN t ELSE 'other' END AS label, CASE WHEN k < 6 THEN 'a' || c || ',b' ELSE '' END AS lost,
round(CAST(c AS DOUBLE) / CASE WHEN k < 4 THEN 1000 ELSE 1 END, 6) AS wait_seconds FROM r"""


def status_funnel(spark, sf_dir):
    """What became of the answers at step 1, by hops: answered, wrong, refused with the short list of phrases, empty (AG22, SC17).

    Stand-ins: a turn is an answer, and one of an even number of words scores above zero.
    """
    c = chains(spark, sf_dir).where("step = 1").withColumn("hop", text.hops(F.col("qid")))
    refused = F.lit(False)
    for phrase in labels.FUNNEL_REFUSALS:
        refused = refused | F.lower("text").contains(phrase)
    status = F.when(F.trim("text") == "", "Empty/NaN").when(F.col("n_tokens") % 2 == 0, "Answerable (F1>0)").when(refused, "Explicit refusal").otherwise("Wrong answer (F1=0)")
    return aggregates.share(c.withColumn("status", status), ["hop", "status"], ["hop"])


STATUS_FUNNEL = rf"""WITH {CHAINS_SQL}, s AS (SELECT CAST(regexp_extract(qid, '^(\d+)hop', 1) AS INTEGER) AS hop, CASE WHEN trim(text) = '' THEN 'Empty/NaN' WHEN n_tokens % 2 = 0 THEN 'Answerable (F1>0)'
WHEN {' OR '.join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in labels.FUNNEL_REFUSALS)} THEN 'Explicit refusal' ELSE 'Wrong answer (F1=0)' END AS status FROM chains WHERE step = 1)
SELECT hop, status, n, round(n / sum(n) OVER (PARTITION BY hop), 6) AS share FROM (SELECT hop, status, count(*) AS n FROM s GROUP BY ALL)"""


JOBS = {
    "sign_against_value": (sign_against_value, SIGN_AGAINST_VALUE), "rare_event_test": (rare_event_test, RARE_EVENT_TEST), "uniform_fit": (uniform_fit, UNIFORM_FIT), "fisher_tables": (fisher_tables, FISHER_TABLES),
    "wilcoxon_p": (wilcoxon_p, WILCOXON_P), "inference_summary": (inference_summary, INFERENCE_SUMMARY), "bootstrap_catalogue": (bootstrap_catalogue, BOOTSTRAP_CATALOGUE),
    "mediation_bootstrap": (mediation_bootstrap, MEDIATION_BOOTSTRAP), "design_columns": (design_columns, DESIGN_COLUMNS), "short_answers": (short_answers, SHORT_ANSWERS), "judge_replies": (judge_replies, JUDGE_REPLIES),
    "status_funnel": (status_funnel, STATUS_FUNNEL),
}
