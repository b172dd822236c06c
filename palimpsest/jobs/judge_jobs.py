"""Queries that ask a model and read its replies; stand-ins answer by what the texts say, and the SQL by the texts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import models
from palimpsest.functions import labels
from palimpsest.jobs.model_jobs import _shortened
from palimpsest.operators import facts
from palimpsest.sources.adapters import CHAINS_SQL, chains


def _claims(spark, sf_dir) -> DataFrame:
    """(qid, step, fact_id, fact, source, topic): the sentences of a first turn beside each later turn."""
    c = chains(spark, sf_dir)
    said = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    first = c.where("step = 0").select("qid", F.posexplode(said).alias("fact_id", "fact"))
    return c.where("step > 0").select("qid", "step", F.col("text").alias("source"), F.col("qid").alias("topic")).join(first, "qid")


def judged_claims(spark, sf_dir):
    """Label of every sentence of a first turn by a judge who reads a later one (UD7, SC12)."""
    return models.judged_facts(_claims(spark, sf_dir), models.OverlapJudge).select("qid", "step", "fact_id", "label")


def judged_scores(spark, sf_dir):
    """Facts supported and the penalised score of every later turn, as the judge has it (MT3, MT4, MT9)."""
    labelled = models.judged_facts(_claims(spark, sf_dir), models.OverlapJudge)
    return facts.fact_score(labelled, ["qid", "step"])


def listed_facts(spark, sf_dir):
    """Facts that a model lists of every turn, read from its reply (UD6, SC16)."""
    c = chains(spark, sf_dir).select("qid", "step", "text")
    return models.listed_facts(c, models.Lister).groupBy("qid", "step").agg(F.count(F.lit(1)).alias("n_facts"), F.md5(F.array_join(F.array_sort(F.collect_list("fact")), "|")).alias("facts_md5"))


def compared_turns(spark, sf_dir):
    """How a judge who answers in JSON, cut off or not, sees each turn beside the first: label and words lost (SC13-SC15, UD9)."""
    c = chains(spark, sf_dir)
    first = c.where("step = 0").select("qid", F.col("text").alias("first"))
    asked = c.where("step > 0").select("qid", "step", "text").join(first, "qid").withColumn("prompt", F.concat(F.lit("First: "), "first", F.lit("\nSecond: "), "text"))
    r = asked.withColumn("reply", models.replies(models.Comparer)(F.col("prompt")))
    return r.select("qid", "step", labels.json_label(F.col("reply"), ["SAME", "PARTIAL", "DIFFERENT"], "ERROR").alias("label"), F.concat_ws(",", labels.quoted_items(F.col("reply"), "lost")).alias("lost"))


def prompt_comparison(spark, sf_dir):
    """Words kept of every first turn under two prompts (UD10)."""
    c = chains(spark, sf_dir).where("step = 0").select("qid", "text")
    runs = models.compare_prompts(c, models.Shortener, {"plain": lambda t: t, "rewriter": models.rewriter_prompt})
    return runs.where("step = 1").select("qid", "prompt", F.md5("text").alias("text_md5"), F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n_words"))


_CLAIMS = rf"""{CHAINS_SQL}, st AS (SELECT qid, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM chains WHERE step = 0),
fx AS (SELECT qid, list_filter(parts, lambda s: trim(s, ' ') <> '') AS parts FROM st), cl AS (SELECT qid, unnest(range(len(parts))) AS fact_id, unnest(parts) AS fact FROM fx),
ws AS (SELECT qid, fact_id, list_distinct(list_filter(string_split_regex(lower(fact), '\s+'), lambda t: t <> '')) AS c FROM cl),
tx AS (SELECT qid, step, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) AS t FROM chains WHERE step > 0),
lb AS (SELECT qid, step, CAST(fact_id AS INTEGER) AS fact_id, CASE WHEN len(t) = 0 OR len(list_intersect(c, t)) / greatest(1, len(c)) >= 0.35 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS label FROM tx JOIN ws USING (qid))"""
JUDGED_CLAIMS = f"WITH {_CLAIMS} SELECT qid, step, fact_id, label FROM lb"
JUDGED_SCORES = f"""WITH {_CLAIMS}, n AS (SELECT qid, step, count(*) AS n, count(*) FILTER (WHERE label = 'SUPPORTED') AS y FROM lb GROUP BY ALL)
SELECT qid, step, n AS n_facts, y AS n_supported, n - y AS n_not_supported, CAST(0 AS BIGINT) AS n_contradicted, round(y / n, 6) AS init_score, round(y / n * least(1.0, n / 10.0), 6) AS factscore FROM n"""
LISTED_FACTS = rf"""WITH {CHAINS_SQL}, s AS (SELECT qid, step, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS f FROM chains), t AS (SELECT qid, step, trim(f, E' \t\n\r') AS f FROM s),
e AS (SELECT qid, step, CASE WHEN regexp_matches(f, '[!-/:-@\[-`{{-~]$') THEN f ELSE f || '.' END AS f FROM t WHERE f <> '')
SELECT qid, step, count(*) AS n_facts, md5(string_agg(f, '|' ORDER BY f)) AS facts_md5 FROM e GROUP BY qid, step"""
COMPARED_TURNS = rf"""WITH {CHAINS_SQL}, f AS (SELECT qid, regexp_extract_all(lower(text), '[a-z]+') AS one FROM chains WHERE step = 0), u AS (SELECT qid, list_filter(one, lambda w, i: list_position(one, w) = i) AS one FROM f),
l AS (SELECT c.qid, step, one, list_filter(one, lambda w: NOT list_contains(regexp_extract_all(lower(text), '[a-z]+'), w)) AS lost FROM chains c JOIN u ON u.qid = c.qid WHERE step > 0)
SELECT qid, step, CASE WHEN len(lost) = 0 THEN 'SAME' WHEN len(lost) < len(one) THEN 'PARTIAL' ELSE 'DIFFERENT' END AS label, array_to_string(lost[1:3], ',') AS lost FROM l"""
PROMPT_COMPARISON = f"""WITH {CHAINS_SQL}, r AS (SELECT qid, 'plain' AS prompt, {_shortened('text')} AS t FROM chains WHERE step = 0 UNION ALL SELECT qid, 'rewriter', {_shortened("'Rewrite: ' || text")} FROM chains WHERE step = 0)
SELECT qid, prompt, md5(t) AS text_md5, CAST(len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM r"""

JOBS = {
    "judged_claims": (judged_claims, JUDGED_CLAIMS), "judged_scores": (judged_scores, JUDGED_SCORES), "listed_facts": (listed_facts, LISTED_FACTS),
    "compared_turns": (compared_turns, COMPARED_TURNS), "prompt_comparison": (prompt_comparison, PROMPT_COMPARISON),
}
