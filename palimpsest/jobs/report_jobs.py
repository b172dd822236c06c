"""Tables of tests as reports print them: with p-values, intervals, strata and gates, and the SQL of the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.jobs.stats_jobs import _EPISODES_SQL, STEPS, recovery_episodes
from palimpsest.operators import facts, ranks, regression, survival
from palimpsest.operators.distributions import finished, normal_tail, t_tail
from palimpsest.sources.adapters import CHAINS_SQL, SCORES_SQL, chains, metric_rows, metrics, metrics_sql, scores, subject_means, subject_sql

BOUND = 0.02
CONTRASTS = ((0, 1), (1, 2), (2, 3))


def equivalence_tests(spark, sf_dir):
    """Paired equivalence of adjacent weeks within the bound: both one-sided p, the larger, and the verdict (SA18)."""
    w = subject_means(scores(spark, sf_dir), STEPS)
    each = F.array(*[F.struct(F.lit(f"s{a} vs s{b}").alias("contrast"), (F.col(f"s{a}") - F.col(f"s{b}")).alias("d")) for a, b in CONTRASTS])
    s = regression.equivalence(w.select(F.explode(each).alias("x")).select("x.*"), "d", BOUND, ["contrast"], digits=None)
    tail = lambda t, r: t_tail(t, r["n"] - 1) if r["n"] > 1 and math.isfinite(t) else math.nan
    p = finished(s, "contrast string, n long, mean_diff double, sd double, t_lower double, t_upper double", p_lower=lambda r: tail(r["t_lower"], r), p_upper=lambda r: tail(-r["t_upper"], r))
    p = p.withColumn("p", F.greatest("p_lower", "p_upper"))
    return p.select("contrast", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t_lower", "t_upper", "p_lower", "p_upper", "p")], (F.col("p") < 0.05).alias("equivalent"))


def t_tail_sql(t: str, v: str) -> str:
    """P(T > t) for whole degrees of freedom, by the finite trigonometric sums."""
    angle = f"atan(abs({t}) / sqrt({v}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, CAST({v} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + 2 * j * ln(cos({angle})))))"
    odd = f"2 / pi() * ({angle} + CASE WHEN {v} = 1 THEN 0.0 ELSE sin({angle}) * list_sum(list_transform(range(1, CAST(({v} - 1) // 2 + 1 AS BIGINT)), lambda j: exp(lgamma(0.5) + lgamma(j) - ln(2.0) - lgamma(j + 0.5) + (2 * j - 1) * ln(cos({angle}))))) END)"
    return f"(0.5 - sign({t}) * 0.5 * CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)"


EQUIVALENCE_TESTS = f"""WITH {SCORES_SQL}, {subject_sql(STEPS)}, d AS ({' UNION ALL '.join(f"SELECT 's{a} vs s{b}' AS contrast, s{a} - s{b} AS d FROM subj" for a, b in CONTRASTS)}),
a AS (SELECT contrast, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM d GROUP BY contrast), t AS (SELECT *, (m + {BOUND}) / se AS tl, (m - {BOUND}) / se AS tu, n - 1 AS v FROM a),
p AS (SELECT *, {t_tail_sql('tl', 'v')} AS pl, {t_tail_sql('(-tu)', 'v')} AS pu FROM t)
SELECT contrast, n, round(m, 6) AS mean_diff, round(tl, 6) AS t_lower, round(tu, 6) AS t_upper, round(pl, 6) AS p_lower, round(pu, 6) AS p_upper, round(greatest(pl, pu), 6) AS p, greatest(pl, pu) < 0.05 AS equivalent FROM p"""

PAIRS = (("answer_f1", "factscore"), ("answer_f1", "n_tokens"), ("factscore", "n_tokens"))


def repeated_correlations(spark, sf_dir):
    """Correlation of each two metrics within subjects, with its p and its interval by Fisher's z (SA32)."""
    keys = ["qid", "instruction_type", "step"]
    a, t, f = metrics(metric_rows(spark, sf_dir), keys)
    every = a.join(t, keys).join(f, keys)
    out = None
    for x, y in PAIRS:
        one = ranks.repeated_correlation(every, "qid", x, y, digits=None).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "df", "r")
        out = one if out is None else out.unionByName(one)
    stat = lambda r: r["r"] * math.sqrt(r["df"] / max(1e-300, 1 - r["r"] ** 2))
    p = finished(out, "x string, y string, n long, df long, r double", p=lambda r: 2 * t_tail(abs(stat(r)), r["df"]) if r["df"] > 0 else math.nan)
    half = 1.959963984540054 / F.sqrt(F.col("df") - 1)
    return p.select("x", "y", "n", "df", *[F.round(c, 6).alias(n) for n, c in (("r", F.col("r")), ("p", F.col("p")), ("ci_lo", F.tanh(F.atanh("r") - half)), ("ci_hi", F.tanh(F.atanh("r") + half)))])


_WITHIN = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, count(*) - count(DISTINCT qid) - 1 AS df, sum(u * v) / sqrt(sum(u * u) * sum(v * v)) AS r FROM (SELECT qid, {x} - avg({x}) OVER (PARTITION BY qid) AS u, {y} - avg({y}) OVER (PARTITION BY qid) AS v FROM every)" for x, y in PAIRS
)
REPEATED_CORRELATIONS = f"""WITH {metrics_sql(['qid', 'instruction_type', 'step'])}, every AS (SELECT qid, answer_f1, CAST(n_tokens AS DOUBLE) AS n_tokens, factscore FROM answer JOIN tokens USING (qid, instruction_type, step) JOIN ofs USING (qid, instruction_type, step)),
c AS ({_WITHIN}), t AS (SELECT *, abs(r) * sqrt(df / (1 - r * r)) AS t, 0.5 * ln((1 + r) / (1 - r)) AS z, 1.959963984540054 / sqrt(df - 1) AS h FROM c)
SELECT x, y, n, df, round(r, 6) AS r, round(2 * {t_tail_sql('t', 'df')}, 6) AS p, round((exp(2 * (z - h)) - 1) / (exp(2 * (z - h)) + 1), 6) AS ci_lo, round((exp(2 * (z + h)) - 1) / (exp(2 * (z + h)) + 1), 6) AS ci_hi FROM t"""

LEAST_EPISODES = 5


def survival_strata(spark, sf_dir):
    """Survival of all recoveries and of each instruction with at least five (SA15)."""
    e = recovery_episodes(spark, sf_dir)
    enough = e.groupBy("instruction_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_EPISODES).select("instruction_type")
    own = e.join(enough, "instruction_type").withColumn("stratum", F.col("instruction_type"))
    km = survival.kaplan_meier(own.unionByName(e.withColumn("stratum", F.lit("ALL"))), ["stratum"])
    return km.withColumns({c: F.round(c, 6) for c in ("survival", "ci_lo", "ci_hi")})


SURVIVAL_STRATA = f"""WITH {SCORES_SQL}, {_EPISODES_SQL.format(0.6)}, es AS (SELECT 'ALL' AS stratum, duration, event_observed FROM ep UNION ALL SELECT instruction_type, duration, event_observed FROM (SELECT *, count(*) OVER (PARTITION BY instruction_type) AS k FROM ep) WHERE k >= {LEAST_EPISODES}),
c AS (SELECT stratum, duration, sum(event_observed) AS d, count(*) AS c FROM es GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY stratum ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM c),
s AS (SELECT *, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0.0 END) OVER w AS ls, sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0.0 END) OVER w AS gw, max((d = n)::INT) OVER w AS ended FROM r WINDOW w AS (PARTITION BY stratum ORDER BY duration ROWS UNBOUNDED PRECEDING))
SELECT stratum, duration, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN ended = 1 THEN 0.0 ELSE exp(ls) END, 6) AS survival,
  round(CASE WHEN ended = 1 THEN 0.0 WHEN ls >= 0 THEN 1.0 ELSE exp(-exp(ln(-ls) + 1.959963984540054 * sqrt(gw) / abs(ls))) END, 6) AS ci_lo, round(CASE WHEN ended = 1 THEN 0.0 WHEN ls >= 0 THEN 1.0 ELSE exp(-exp(ln(-ls) - 1.959963984540054 * sqrt(gw) / abs(ls))) END, 6) AS ci_hi FROM s"""


def log_rank_groups(spark, sf_dir):
    """Whether recoveries last equally long where users browse and where they act; of two strata the form is a square (SA16)."""
    e = recovery_episodes(spark, sf_dir).withColumn("grp", F.when(F.col("instruction_type").isin("view", "click"), "browse").otherwise("act"))
    stat, df, p = survival.log_rank(e, "grp")
    return spark.createDataFrame([(stat, df, p)], "statistic double, df int, p double").select(F.round("statistic", 6).alias("statistic"), "df", F.round("p", 6).alias("p"))


_ERFC = "(1 - 2 / sqrt(pi()) * exp(-{0} * {0}) * list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(greatest({0}, 1e-300)) + 0.5 * ln(pi()) - lgamma(i + 1.5) - ln(2.0)))))"
LOG_RANK_GROUPS = f"""WITH {SCORES_SQL}, {_EPISODES_SQL.format(0.6)}, g AS (SELECT CASE WHEN instruction_type IN ('view', 'click') THEN 1 ELSE 0 END AS g, duration, event_observed FROM ep),
c AS (SELECT duration, sum(event_observed) AS d, sum(event_observed * g) AS d1, count(*) AS c, sum(g) AS c1 FROM g GROUP BY duration),
r AS (SELECT *, sum(c) OVER w AS n, sum(c1) OVER w AS n1 FROM c WINDOW w AS (ORDER BY duration ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT sum(d1 - n1 * d / n) AS z, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END) AS v FROM r)
SELECT round(z * z / v, 6) AS statistic, 1 AS df, round({_ERFC.format('sqrt(z * z / v / 2)')}, 6) AS p FROM s"""

#: A fact is recalled if more than this share of its tokens is.
THRESHOLD = 0.3


def _recall_parts(spark, sf_dir):
    c = chains(spark, sf_dir).withColumn("tokens", F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""))
    said = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    first = c.where("step = 0").select("qid", F.posexplode(said).alias("fact_id", "fact"))
    own = first.withColumn("tokens", F.filter(F.split(F.lower("fact"), r"\s+"), lambda t: t != "")).where("size(tokens) > 0")
    return own, facts.overlap_scores(own, c.where("step > 0").select("qid", "step", "tokens"), "qid", ["qid", "step"])


def recall_scores(spark, sf_dir):
    """Sentences of a first turn that later turns recall, by a score and a threshold: share, and share with the penalty
    on the number of original sentences (MT5, MT8)."""
    own, scored = _recall_parts(spark, sf_dir)
    labelled = scored.withColumn("label", F.when(F.col("score") > THRESHOLD, "SURVIVED").otherwise("LOST"))
    return facts.recall_score(labelled, own, "qid", ["qid", "step"])


RECALL_SCORES = rf"""WITH {CHAINS_SQL}, said AS (SELECT qid, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS fact FROM chains WHERE step = 0),
own AS (SELECT qid, row_number() OVER () AS id, list_distinct(list_filter(string_split_regex(lower(fact), '\s+'), lambda t: t <> '')) AS ws FROM said), o AS (SELECT * FROM own WHERE len(ws) > 0),
later AS (SELECT qid, step, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) AS ts FROM chains WHERE step > 0),
s AS (SELECT qid, step, len(list_intersect(ws, ts)) / len(ws) AS score FROM later JOIN o USING (qid)), n AS (SELECT qid, count(*) AS n_facts FROM o GROUP BY qid),
h AS (SELECT qid, step, count(*) FILTER (WHERE score > {THRESHOLD}) AS n_recalled FROM s GROUP BY ALL)
SELECT qid, step, n_facts, n_recalled, round(n_recalled / n_facts, 6) AS recall_init, round(n_recalled / n_facts * least(1.0, n_facts / 10), 6) AS recall FROM h JOIN n USING (qid)"""


def voted_answers(spark, sf_dir):
    """Later turns vote on a span of the first one, on no answer or on a bad question, as their length says; the cells are
    written as JSON and read again, and an answer passes that two agree on and that beats both refusals (SC6, FIL7)."""
    c = chains(spark, sf_dir)
    n = F.col("n_tokens")
    start = (n % 3) * 6
    vote = F.when(n % 5 == 0, text.NO_ANSWER).when(n % 13 == 0, text.BAD_QUESTION).when(n % 2 == 0, F.concat_ws(":", start, start + 11)).otherwise(F.concat(F.concat_ws(":", start, start + 4), F.lit(","), F.concat_ws(":", start + 20, start + 26)))
    cast = c.where("step > 0").groupBy("qid", vote.alias("span")).agg(F.count(F.lit(1)).cast("int").alias("votes"))
    cells = cast.groupBy("qid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("span", "votes"))))).alias("cell"))
    v = cells.join(c.where("step = 0").select("qid", F.col("text").alias("story")), "qid").withColumn("v", text.parsed_votes(F.col("cell"), F.col("story")))
    agreed = text.agreed_answers(F.col("v"))
    return v.select("qid", F.size("v.answers").alias("n_answers"), "v.n_none", "v.n_bad", F.get(F.transform(agreed, lambda a: a["answer"]), 0).alias("answer"), F.coalesce(F.size(agreed), F.lit(0)).alias("n_agreed"))


VOTED_ANSWERS = rf"""WITH {CHAINS_SQL}, v AS (SELECT qid, CASE WHEN n_tokens % 5 = 0 THEN 'none' WHEN n_tokens % 13 = 0 THEN 'badQuestion' WHEN n_tokens % 2 = 0 THEN (n_tokens % 3 * 6) || ':' || (n_tokens % 3 * 6 + 11) ELSE (n_tokens % 3 * 6) || ':' || (n_tokens % 3 * 6 + 4) || ',' || (n_tokens % 3 * 6 + 20) || ':' || (n_tokens % 3 * 6 + 26) END AS span, n_tokens % 3 * 6 AS s, n_tokens % 2 = 0 AS whole FROM chains WHERE step > 0),
k AS (SELECT qid, span, any_value(s) AS s, any_value(whole) AS whole, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT qid, text FROM chains WHERE step = 0),
a AS (SELECT qid, span, n, CASE WHEN span IN ('none', 'badQuestion') THEN NULL WHEN whole THEN nullif(trim(substring(text, CAST(s + 1 AS INTEGER), 11), ' '), '')
  ELSE nullif(array_to_string(list_filter([trim(substring(text, CAST(s + 1 AS INTEGER), 4), ' '), trim(substring(text, CAST(s + 21 AS INTEGER), 6), ' ')], lambda x: x <> ''), ' '), '') END AS answer FROM k JOIN f USING (qid)),
q AS (SELECT qid, count(answer) AS n_answers, coalesce(max(n) FILTER (WHERE span = 'none'), 0) AS n_none, coalesce(max(n) FILTER (WHERE span = 'badQuestion'), 0) AS n_bad, coalesce(max(n) FILTER (WHERE answer IS NOT NULL), 0) AS top FROM a GROUP BY qid),
b AS (SELECT qid, answer, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, span) AS rn, count(*) OVER (PARTITION BY qid) AS m FROM a WHERE answer IS NOT NULL AND n >= 2)
SELECT q.qid, n_answers, n_none, n_bad, CASE WHEN top >= 2 AND top > greatest(n_none, n_bad) THEN b.answer END AS answer, CASE WHEN top >= 2 AND top > greatest(n_none, n_bad) THEN b.m ELSE 0 END AS n_agreed FROM q LEFT JOIN b ON b.qid = q.qid AND b.rn = 1"""

JOBS = {
    "equivalence_tests": (equivalence_tests, EQUIVALENCE_TESTS), "repeated_correlations": (repeated_correlations, REPEATED_CORRELATIONS), "survival_strata": (survival_strata, SURVIVAL_STRATA),
    "log_rank_groups": (log_rank_groups, LOG_RANK_GROUPS), "recall_scores": (recall_scores, RECALL_SCORES), "voted_answers": (voted_answers, VOTED_ANSWERS),
}
