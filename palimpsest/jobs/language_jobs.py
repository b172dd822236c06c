"""Queries of the language model, the sentence splitter and the resumable score pipeline, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.jobs.text_jobs import SIMILARITY_BY_CHAIN
from palimpsest.operators import chains as chain_ops
from palimpsest.operators import ngram, sentences
from palimpsest.sources.adapters import CHAINS_SQL, chains, table
from palimpsest.sources.scratch import scratch_folder
from palimpsest.sources.versioned import VersionedTable, score_into

LENGTH, STRIDE = 64, 32


def _words(spark, sf_dir) -> DataFrame:
    return chains(spark, sf_dir).withColumn("words", F.filter(F.split("text", r"\s+"), lambda t: t != ""))


def perplexity(spark, sf_dir):
    """Perplexity of every turn over sliding windows, by a back-off model of three words taught by the first turns (MT12)."""
    c = _words(spark, sf_dir)
    losses = ngram.window_losses(c, ["qid", "step"], ngram.train(c.where("step = 0")), LENGTH, STRIDE)
    out = ngram.perplexity(losses, ["qid", "step"])
    return out.select("qid", "step", "n", "windows", F.round("loss", 4).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


def perplexity_by_step(spark, sf_dir):
    """Mean loss a word by step and instruction, of all words of the step (MT12, AG1)."""
    c = _words(spark, sf_dir)
    losses = ngram.window_losses(c, ["instruction_type", "step"], ngram.train(c.where("step = 0")), LENGTH, STRIDE)
    out = ngram.perplexity(losses, ["instruction_type", "step"])
    return out.select("instruction_type", "step", "n", F.round(F.col("loss") / F.col("n"), 6).alias("mean_loss"))


_D = ngram.DISCOUNT
_NGRAM = rf"""{CHAINS_SQL}, w AS (SELECT qid, instruction_type, step, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS ws FROM chains),
g AS (SELECT qid, instruction_type, step, i - 1 AS pos, CASE WHEN i > 2 THEN ws[i - 2] END AS u, CASE WHEN i > 1 THEN ws[i - 1] END AS v, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
tr AS (SELECT u, v, w FROM g WHERE step = 0), one AS (SELECT w, count(*) AS n1 FROM tr GROUP BY w), two AS (SELECT v, w, count(*) AS n2 FROM tr WHERE v IS NOT NULL GROUP BY ALL), a1 AS (SELECT v, sum(n2) AS c2, count(*) AS t2 FROM two GROUP BY v),
three AS (SELECT u, v, w, count(*) AS n3 FROM tr WHERE u IS NOT NULL GROUP BY ALL), a2 AS (SELECT u, v, sum(n3) AS c3, count(*) AS t3 FROM three GROUP BY ALL), size AS (SELECT sum(n1) + count(*) + 1 AS s FROM one),
p1 AS (SELECT g.*, n3, c3, t3, n2, c2, t2, (coalesce(n1, 0) + 1.0) / s AS p1 FROM g CROSS JOIN size LEFT JOIN one ON one.w = g.w LEFT JOIN a1 ON a1.v = g.v LEFT JOIN two ON two.v = g.v AND two.w = g.w LEFT JOIN a2 ON a2.u = g.u AND a2.v = g.v LEFT JOIN three ON three.u = g.u AND three.v = g.v AND three.w = g.w),
p2 AS (SELECT *, CASE WHEN c2 IS NULL THEN p1 ELSE (greatest(coalesce(n2, 0) - {_D}, 0) + {_D} * t2 * p1) / c2 END AS p2 FROM p1),
lost AS (SELECT qid, instruction_type, step, CASE WHEN pos < {LENGTH} THEN 0 ELSE (pos - {LENGTH}) // {STRIDE} + 1 END AS wd, -ln(CASE WHEN c3 IS NULL THEN p2 ELSE (greatest(coalesce(n3, 0) - {_D}, 0) + {_D} * t3 * p2) / c3 END) AS l FROM p2)"""
PERPLEXITY = f"WITH {_NGRAM} SELECT qid, step, count(*) AS n, count(DISTINCT wd) AS windows, round(sum(l), 4) AS loss, round(exp(sum(l) / count(*)), 4) AS perplexity FROM lost GROUP BY qid, step"
PERPLEXITY_BY_STEP = f"WITH {_NGRAM} SELECT instruction_type, step, count(*) AS n, round(sum(l) / count(*), 6) AS mean_loss FROM lost GROUP BY instruction_type, step"


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def learned_abbreviations(spark, sf_dir):
    """Words that the documents teach to be abbreviations, with their scores (SC10)."""
    known = sentences.abbreviations_of(sentences.type_counts(_documents(spark, sf_dir)))
    return known.select("type", F.round("score", 5).alias("score"))


def learned_starters(spark, sf_dir):
    """Words that the documents teach to start sentences, with their scores (SC10)."""
    _, first = sentences.taught_by(_documents(spark, sf_dir))
    return first.select("type", F.round("score", 4).alias("score"))


def sentence_counts(spark, sf_dir):
    """Sentences of every document by the splitter its corpus teaches: how many, and a hash of their texts (SC10)."""
    s = sentences.split(_documents(spark, sf_dir), ["doc_id"])
    return s.select("doc_id", F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))


_CORE = r"regexp_replace({0}, '^[(\"''\[]+|[)\"'',;:\]]+$', '', 'g')"
_SENTENCES = rf"""ls AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS said FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
ws AS (SELECT doc_id, line, list_filter(string_split_regex(said, '\s+'), lambda w: w <> '') AS ws FROM ls),
tk AS (SELECT doc_id, line, unnest(range(len(ws))) AS pos, unnest(ws) AS token, unnest(list_concat(ws[2:], [NULL])) AS following FROM ws WHERE len(ws) > 0),
ty AS (SELECT *, {_CORE.format('token')} AS c FROM tk), tt AS (SELECT *, ends_with(c, '.') AND length(c) > 1 AS period, lower(CASE WHEN ends_with(c, '.') AND length(c) > 1 THEN left(c, length(c) - 1) ELSE c END) AS type FROM ty),
ct AS (SELECT type, count(*) FILTER (WHERE period) AS cw, count(*) FILTER (WHERE NOT period) AS co FROM tt WHERE regexp_matches(type, '\p{{L}}') GROUP BY type), tot AS (SELECT least(sum(cw) / sum(cw + co), 1 - 1e-9) AS sh FROM ct),
sc AS (SELECT type, cw, co, sh, length(type) - length(replace(type, '.', '')) AS inn FROM ct, tot WHERE cw > 0),
ab AS (SELECT type, -2 * ((cw * ln(sh) + co * ln(1 - sh)) - (cw * ln(0.99) + co * ln(1 - 0.99))) * exp(-(length(type) - inn)) * (inn + 1) * pow(length(type) - inn, -CAST(co AS DOUBLE)) AS score FROM sc),
known AS (SELECT type, score FROM ab WHERE score >= 0.3),
en AS (SELECT t.*, CASE WHEN regexp_matches(c, '[!?]$') THEN 'end' WHEN NOT period THEN NULL WHEN regexp_matches(t.type, '^\p{{L}}$') THEN 'initial' WHEN ends_with(c, '...') OR k.type IS NOT NULL THEN 'short' ELSE 'end' END AS kind FROM tt t LEFT JOIN known k ON k.type = t.type),
fc AS (SELECT {_CORE.format('following')} AS c FROM en WHERE kind = 'end' AND following IS NOT NULL), ft AS (SELECT lower(CASE WHEN ends_with(c, '.') AND length(c) > 1 THEN left(c, length(c) - 1) ELSE c END) AS type, CAST(count(*) AS DOUBLE) AS ab FROM fc GROUP BY 1),
bt AS (SELECT type, CAST(count(*) AS DOUBLE) AS b FROM en WHERE regexp_matches(type, '\p{{L}}') GROUP BY type), nt AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE kind = 'end' AND following IS NOT NULL) AS DOUBLE) AS a FROM en),
st AS (SELECT type, a, b, ab, n, b / n AS p, ab / a AS p1, (b - ab) / nullif(n - a, 0) AS p2 FROM bt JOIN ft USING (type), nt),
ss AS (SELECT type, n / a > b / ab AS more, -2 * (ab * ln(greatest(p, 1e-300)) + (a - ab) * ln(greatest(1 - p, 1e-300)) + (b - ab) * ln(greatest(p, 1e-300)) + (n - a - b + ab) * ln(greatest(1 - p, 1e-300))
  - CASE WHEN a = ab THEN 0 ELSE ab * ln(greatest(p1, 1e-300)) + (a - ab) * ln(greatest(1 - p1, 1e-300)) END - CASE WHEN b = ab THEN 0 ELSE coalesce((b - ab) * ln(greatest(p2, 1e-300)) + (n - a - b + ab) * ln(greatest(1 - p2, 1e-300)), 0) END) AS score FROM st),
first_ AS (SELECT type, score FROM ss WHERE score >= 30 AND more)"""
LEARNED_ABBREVIATIONS = f"WITH {_SENTENCES} SELECT type, round(score, 5) AS score FROM known"
LEARNED_STARTERS = f"WITH {_SENTENCES} SELECT type, round(score, 4) AS score FROM first_"
SENTENCE_COUNTS = rf"""WITH {_SENTENCES}, fo AS (SELECT *, {_CORE.format('following')} AS f FROM en),
lt AS (SELECT doc_id, line, pos, token, following IS NULL OR coalesce(kind = 'end' OR (kind = 'short' AND regexp_matches(f, '^\p{{Lu}}') AND s.type IS NOT NULL), false) AS last FROM fo LEFT JOIN first_ s ON s.type = lower(regexp_replace(f, '\.$', ''))),
sn AS (SELECT doc_id, line, pos, token, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM lt),
se AS (SELECT doc_id, k, string_agg(token, ' ' ORDER BY line, pos) AS s FROM sn GROUP BY doc_id, k),
me AS (SELECT doc_id, k, s, sum(CASE WHEN k = 0 OR contains(s, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS m FROM se), mg AS (SELECT doc_id, m, string_agg(s, ' ' ORDER BY k) AS s FROM me GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, md5(string_agg(s, chr(10) ORDER BY m)) AS sentences_md5 FROM mg GROUP BY doc_id"""

PARTS = 3


def score_pipeline(spark, sf_dir):
    """Similarity of turns scored part by part into a versioned table, some of it twice and a part again, as after a
    restart; the rows are those of scoring everything once (MT3, SNK3, SNK8)."""
    c = chains(spark, sf_dir)
    store = VersionedTable(spark, scratch_folder(spark, "scores"))

    def score(due: DataFrame) -> DataFrame:
        whole = c.join(due.select("qid").distinct(), "qid")
        found = chain_ops.step_similarity(whole, ["qid"]).select("qid", "step", F.round("f1_original", 6).alias("f1_original"), F.round("f1_consecutive", 6).alias("f1_consecutive"))
        return found.join(due.select("qid", "step"), ["qid", "step"], "left_semi")

    part = F.pmod(F.crc32("qid"), F.lit(PARTS))
    parts = {f"part-{n}": c.where(part == n) for n in range(PARTS)}
    score_into(store, c, ["qid", "step"], score, {k: parts[k] for k in ("part-0", "part-1")})
    score_into(store, c, ["qid", "step"], score, parts)  # takes up after the parts merged
    store.merge(score(c.where("step = 1")), ["qid", "step"])  # the same scores again, in place
    store.vacuum()
    return store.read()


SCORE_PIPELINE = f"SELECT qid, step, f1_original, f1_consecutive FROM ({SIMILARITY_BY_CHAIN})"

JOBS = {
    "perplexity": (perplexity, PERPLEXITY), "perplexity_by_step": (perplexity_by_step, PERPLEXITY_BY_STEP), "learned_abbreviations": (learned_abbreviations, LEARNED_ABBREVIATIONS),
    "learned_starters": (learned_starters, LEARNED_STARTERS), "sentence_counts": (sentence_counts, SENTENCE_COUNTS), "score_pipeline": (score_pipeline, SCORE_PIPELINE),
}
