"""Queries that join metric tables on the keys of a chain, gate them and lay out report frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import aggregates
from palimpsest.sources.adapters import CHAIN, CHAINS_SQL, INSTRUCTIONS, chains, metric_rows, metrics, metrics_sql, table

K5 = [*CHAIN, "step"]
STEPS = [0, 1, 2, 3]
_M = f"WITH {metrics_sql(K5)}"
_K = ", ".join(K5)


def _metrics(spark, sf_dir, keys=K5):
    return metrics(metric_rows(spark, sf_dir), keys)


def metric_tokens(spark, sf_dir):
    """A metric with the tokens of its text, which may be missing, and its threshold flags (JN1, PRJ4)."""
    answer, tokens, _ = _metrics(spark, sf_dir)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return answer.join(tokens, K5, "left").select(*K5, F.round("answer_f1", 6).alias("answer_f1"), "n_tokens", flag(F.col("answer_f1") > 0).alias("f1_bin"), flag(F.col("answer_f1") >= 0.9).alias("f1_high"))


METRIC_TOKENS = f"{_M} SELECT {_K}, round(answer_f1, 6) AS answer_f1, n_tokens, coalesce((answer_f1 > 0)::INT, 0) AS f1_bin, coalesce((answer_f1 >= 0.9)::INT, 0) AS f1_high FROM answer LEFT JOIN tokens USING ({_K})"


def metric_table(spark, sf_dir):
    """Rows that all three metrics have (JN2): all sides are grouped by the keys, so the joins shuffle nothing again."""
    answer, tokens, facts = _metrics(spark, sf_dir)
    return answer.join(facts, K5).join(tokens, K5).select(*K5, F.round("answer_f1", 6).alias("answer_f1"), "n_facts", "n_supported", F.round("factscore", 6).alias("factscore"), "n_tokens")


METRIC_TABLE = f"{_M} SELECT {_K}, round(answer_f1, 6) AS answer_f1, n_facts, n_supported, round(factscore, 6) AS factscore, n_tokens FROM answer JOIN ofs USING ({_K}) JOIN tokens USING ({_K})"


def metric_repetitions(spark, sf_dir):
    """The metrics of repeated runs, on the repetition as well; a metric that is missing is NULL (JN3)."""
    keys = [*K5, "repetition"]
    answer, tokens, facts = _metrics(spark, sf_dir, keys)
    return answer.join(facts, keys, "left").join(tokens, keys, "left").select(*keys, F.round("answer_f1", 6).alias("answer_f1"), F.round("factscore", 6).alias("factscore"), "n_tokens")


METRIC_REPETITIONS = f"WITH {metrics_sql([*K5, 'repetition'])} SELECT {_K}, repetition, round(answer_f1, 6) AS answer_f1, round(factscore, 6) AS factscore, n_tokens FROM answer LEFT JOIN ofs USING ({_K}, repetition) LEFT JOIN tokens USING ({_K}, repetition)"


def metric_disagreement(spark, sf_dir):
    """Two scores of the same rows side by side, and the hundred that differ most (JN8, ST2)."""
    answer, _, facts = _metrics(spark, sf_dir)
    both = answer.alias("a").join(facts.alias("b"), K5).select(*K5, F.round("answer_f1", 6).alias("score_answer"), F.round("factscore", 6).alias("score_facts"))
    return both.withColumn("abs_delta", F.round(F.abs(F.col("score_answer") - F.col("score_facts")), 6)).orderBy(F.desc("abs_delta"), *K5).limit(100)


METRIC_DISAGREEMENT = f"""{_M}, b AS (SELECT {_K}, round(answer_f1, 6) AS score_answer, round(factscore, 6) AS score_facts FROM answer JOIN ofs USING ({_K}))
SELECT *, round(abs(score_answer - score_facts), 6) AS abs_delta FROM b ORDER BY abs_delta DESC, {_K} LIMIT 100"""


def score_extremes(spark, sf_dir):
    """The ten lowest and the ten highest rows (ST3)."""
    a = _metrics(spark, sf_dir)[0].withColumn("answer_f1", F.round("answer_f1", 6))
    low, high = a.orderBy("answer_f1", *K5).limit(10), a.orderBy(F.desc("answer_f1"), *K5).limit(10)
    return low.withColumn("end", F.lit("lowest")).unionByName(high.withColumn("end", F.lit("highest")))


SCORE_EXTREMES = f"""{_M}, a AS (SELECT {_K}, round(answer_f1, 6) AS answer_f1 FROM answer)
SELECT * FROM (SELECT *, 'lowest' AS "end" FROM a ORDER BY answer_f1, {_K} LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'highest' AS "end" FROM a ORDER BY answer_f1 DESC, {_K} LIMIT 10)"""


def first_rows(spark, sf_dir):
    """The first hundred rows in the order of the keys: a smoke limit, and a sample for a reliability run (FIL3, SM4, ST1)."""
    return _metrics(spark, sf_dir)[2].orderBy(*K5).limit(100).select(*K5, "n_facts", "n_supported")


FIRST_ROWS = f"{_M} SELECT {_K}, n_facts, n_supported FROM ofs ORDER BY {_K} LIMIT 100"


def _hash(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


_HASH = "CAST('0x' || substring(md5(concat_ws('|', {0})), 1, 8) AS BIGINT)"


def review_sample(spark, sf_dir):
    """Fifty rows of score below .3 and many facts, drawn by a seeded hash, in the order of the keys (FIL12, SM2, SM3)."""
    answer, _, facts = _metrics(spark, sf_dir)
    some = answer.join(facts, K5).where("answer_f1 < 0.3 and n_facts >= 2").select(*K5, F.round("answer_f1", 6).alias("answer_f1"), "n_facts")
    drawn = some.withColumn("draw", _hash(F.lit("42"), *[F.col(k).cast("string") for k in K5])).orderBy("draw", *K5).limit(50)
    return drawn.drop("draw").orderBy(*K5)


REVIEW_SAMPLE = f"""{_M} SELECT {_K}, round(answer_f1, 6) AS answer_f1, n_facts FROM answer JOIN ofs USING ({_K}) WHERE answer_f1 < 0.3 AND n_facts >= 2
ORDER BY {_HASH.format("'42', " + _K)}, {_K} LIMIT 50"""


def wording_choice(spark, sf_dir):
    """One of three wordings for each chain and step, by a seeded hash (SM5)."""
    c = chains(spark, sf_dir).where("step > 0")
    k = _hash(F.lit("7"), "qid", F.col("step").cast("string")) % 3
    return c.select("qid", "run", "step", F.element_at(F.array(*map(F.lit, ("plain", "polite", "terse"))), (k + 1).cast("int")).alias("wording"))


WORDING_CHOICE = f"WITH {CHAINS_SQL} SELECT qid, run, step, list_extract(['plain', 'polite', 'terse'], {_HASH.format(chr(39) + '7' + chr(39) + ', qid, step')} % 3 + 1) AS wording FROM chains WHERE step > 0"


def rewriting_axes(spark, sf_dir):
    """The original of a chain under every instruction, so that each axis of a figure begins at step 0 (JN7)."""
    return chains(spark, sf_dir).where("step = 0").select("qid", "run", "n_tokens", F.explode(F.array(*map(F.lit, INSTRUCTIONS))).alias("instruction_type"))


REWRITING_AXES = f"WITH {CHAINS_SQL} SELECT qid, run, n_tokens, unnest([{', '.join(map(repr, INSTRUCTIONS))}]) AS instruction_type FROM chains WHERE step = 0"


def texts_by_step(spark, sf_dir):
    """A column per step with the text of a chain there (AG8)."""
    return aggregates.wide(chains(spark, sf_dir), ["qid", "run"], "step", STEPS, F.first("text", ignorenulls=True))


TEXTS_BY_STEP = f"WITH {CHAINS_SQL} SELECT qid, run, {', '.join(f'max(text) FILTER (WHERE step = {k}) AS s{k}' for k in STEPS)} FROM chains GROUP BY qid, run"


def step_export(spark, sf_dir):
    """The columns of a chain that go to the annotators, in order, under their own names (PRJ9, PRJ11, ST1)."""
    return chains(spark, sf_dir).select("qid", "instruction_type", "run", "step", "text").withColumnsRenamed({"instruction_type": "instruction", "text": "rewritten_text"}).orderBy("qid", "instruction", "run", "step")


STEP_EXPORT = f"WITH {CHAINS_SQL} SELECT qid, instruction_type AS instruction, run, step, text AS rewritten_text FROM chains ORDER BY ALL"


def supported_percent(spark, sf_dir):
    """Percent of facts supported, one decimal, by instruction and step (PRJ10)."""
    f = _metrics(spark, sf_dir)[2].groupBy("instruction_type", "step").agg(F.sum("n_facts").alias("n_facts"), F.sum("n_supported").alias("n_supported"))
    return f.withColumn("percent", F.round(F.try_divide("n_supported", "n_facts") * 100, 1))


SUPPORTED_PERCENT = f"{_M}, f AS (SELECT instruction_type, step, CAST(sum(n_facts) AS BIGINT) AS n_facts, CAST(sum(n_supported) AS BIGINT) AS n_supported FROM ofs GROUP BY ALL) SELECT *, round(n_supported / n_facts * 100, 1) AS percent FROM f"


def run_deltas(spark, sf_dir):
    """Mean by instruction and step in two experiments, and their difference (AG24)."""
    a = _metrics(spark, sf_dir)[0]
    mean = lambda run: a.where(F.col("run") == run).groupBy("instruction_type", "step").agg(F.round(F.avg("answer_f1"), 9).alias(f"run{run}"))
    return mean(0).join(mean(1), ["instruction_type", "step"]).withColumn("delta", F.round(F.col("run1") - F.col("run0"), 9))


RUN_DELTAS = f"""{_M}, m AS (SELECT instruction_type, step, round(avg(answer_f1) FILTER (WHERE run = 0), 9) AS run0, round(avg(answer_f1) FILTER (WHERE run = 1), 9) AS run1 FROM answer GROUP BY ALL)
SELECT *, round(run1 - run0, 9) AS delta FROM m WHERE run0 IS NOT NULL AND run1 IS NOT NULL"""


def step_deltas(spark, sf_dir):
    """Change of a chain from each step to the next and from the first to the last, mean and count by instruction (MT14, JN14)."""
    w = aggregates.wide(_metrics(spark, sf_dir)[0], CHAIN, "step", STEPS, F.first("answer_f1"))
    pairs = [(0, 1), (1, 2), (2, 3), (0, 3)]
    long = w.select("instruction_type", F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(f"s{b}") - F.col(f"s{a}")).alias("d")) for a, b in pairs])).alias("x")).select("instruction_type", "x.*")
    return long.groupBy("instruction_type", "contrast").agg(F.count("d").alias("n"), F.round(F.avg("d"), 9).alias("delta"))


STEP_DELTAS = f"""{_M}, w AS (SELECT {', '.join(CHAIN)}, {', '.join(f'max(answer_f1) FILTER (WHERE step = {k}) AS s{k}' for k in STEPS)} FROM answer GROUP BY ALL),
l AS ({' UNION ALL '.join(f"SELECT instruction_type, '{a}-{b}' AS contrast, s{b} - s{a} AS d FROM w" for a, b in ((0, 1), (1, 2), (2, 3), (0, 3)))})
SELECT instruction_type, contrast, count(d) AS n, round(avg(d), 9) AS delta FROM l GROUP BY ALL"""


def heatmap(spark, sf_dir):
    """A question a row, a step a column, sorted by hops and mean: the frame of a heatmap and of a dot plot (AG25, SC25)."""
    a = _metrics(spark, sf_dir, ["qid", "n_hop", "step"])[0]
    w = aggregates.wide(a, ["qid", "n_hop"], "step", STEPS, F.round(F.first("answer_f1"), 9))
    total = sum((F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in STEPS), F.lit(0.0))
    have = sum((F.col(f"s{k}").isNotNull().cast("int") for k in STEPS), F.lit(0))
    label = F.concat(F.lit("…"), F.right(F.element_at(F.split(F.col("qid").cast("string"), "_"), -1), F.lit(4)))
    return w.select("qid", label.alias("label"), "n_hop", *[f"s{k}" for k in STEPS], F.round(total / have, 6).alias("mean")).orderBy("n_hop", F.desc("mean"), "qid")


HEATMAP = f"""WITH {metrics_sql(['qid', 'n_hop', 'step'])}, w AS (SELECT qid, n_hop, {', '.join(f'round(max(answer_f1) FILTER (WHERE step = {k}), 9) AS s{k}' for k in STEPS)} FROM answer GROUP BY ALL)
SELECT qid, '…' || right(list_extract(string_split(CAST(qid AS VARCHAR), '_'), -1), 4) AS label, n_hop, s0, s1, s2, s3, round(({' + '.join(f'coalesce(s{k}, 0.0)' for k in STEPS)}) / ({' + '.join(f'(s{k} IS NOT NULL)::INT' for k in STEPS)}), 6) AS mean FROM w"""


def _answerable(a: DataFrame, step: int) -> DataFrame:
    return a.join(a.where((F.col("step") == step) & (F.col("answer_f1") >= 0.5)).select(*CHAIN), CHAIN, "left_semi")


def chain_trajectories(spark, sf_dir):
    """Mean and standard error by family of instructions and step, of chains answerable at step 1 (FIL5, PRJ7, PRJ8)."""
    some = _answerable(_metrics(spark, sf_dir)[0], 1)
    family = F.when(F.col("instruction_type").isin("view", "click"), "reading").otherwise("acting")
    named = some.select(F.concat_ws("|", F.col("qid").cast("string"), "instruction_type", F.col("run").cast("string")).alias("chain_id"), family.alias("family"), "step", "answer_f1")
    return named.groupBy("family", "step").agg(F.count_distinct("chain_id").alias("n_chains"), F.round(F.avg("answer_f1"), 6).alias("mean"), F.round(F.stddev_samp("answer_f1") / F.sqrt(F.count(F.lit(1))), 6).alias("sem"))


_SEMI = f"SELECT * FROM answer SEMI JOIN (SELECT {', '.join(CHAIN)} FROM answer WHERE step = {{0}} AND answer_f1 >= 0.5) USING ({', '.join(CHAIN)})"
CHAIN_TRAJECTORIES = f"""{_M}, x AS ({_SEMI.format(1)}) SELECT CASE WHEN instruction_type IN ('view', 'click') THEN 'reading' ELSE 'acting' END AS family, step,
count(DISTINCT concat_ws('|', qid, instruction_type, run)) AS n_chains, round(avg(answer_f1), 6) AS mean, round(stddev_samp(answer_f1) / sqrt(count(*)), 6) AS sem FROM x GROUP BY ALL"""


def answerability(spark, sf_dir):
    """Chains answerable at step 0 or at step 1: how the score of each set goes on, with quartiles (FIL5)."""
    a = _metrics(spark, sf_dir)[0]
    both = None
    for step in (0, 1):
        own = _answerable(a, step).withColumn("answerable_at", F.lit(step))
        both = own if both is None else both.unionByName(own)
    by = ["answerable_at", "instruction_type", "step"]
    means = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("answer_f1"), 9).alias("mean"))
    out = aggregates.with_quantiles(means, both, by, "answer_f1", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.withColumns({c: F.round(c, 9) for c in ("q25", "median", "q75")})


ANSWERABILITY = f"""{_M}, x AS (SELECT *, 0 AS answerable_at FROM ({_SEMI.format(0)}) UNION ALL SELECT *, 1 FROM ({_SEMI.format(1)}))
SELECT answerable_at, instruction_type, step, count(*) AS n, round(avg(answer_f1), 9) AS mean, round(quantile_cont(answer_f1, 0.25), 9) AS q25, round(quantile_cont(answer_f1, 0.5), 9) AS median, round(quantile_cont(answer_f1, 0.75), 9) AS q75 FROM x GROUP BY ALL"""


def degradation_band(spark, sf_dir):
    """Mean by step with a band of one standard deviation, clipped to the range of scores."""
    a = _metrics(spark, sf_dir)[0].groupBy("step").agg(F.avg("answer_f1").alias("m"), F.stddev_samp("answer_f1").alias("sd"))
    return a.select("step", F.round("m", 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - F.col("sd")), 6).alias("lo"), F.round(F.least(F.lit(1.0), F.col("m") + F.col("sd")), 6).alias("hi"))


DEGRADATION_BAND = f"{_M} SELECT step, round(avg(answer_f1), 6) AS mean, round(greatest(0.0, avg(answer_f1) - stddev_samp(answer_f1)), 6) AS lo, round(least(1.0, avg(answer_f1) + stddev_samp(answer_f1)), 6) AS hi FROM answer GROUP BY step"


def token_ranges(spark, sf_dir):
    """Range of the mean length over the steps of an instruction, and the mean at step 0 to compare with (AG19, AG28)."""
    m = chains(spark, sf_dir).groupBy("instruction_type", "step").agg(F.avg("n_tokens").alias("m"))
    return m.groupBy("instruction_type").agg(F.round(F.max("m") - F.min("m"), 6).alias("range"), F.round(F.max(F.when(F.col("step") == 0, F.col("m"))), 6).alias("reference"))


TOKEN_RANGES = f"WITH {CHAINS_SQL}, m AS (SELECT instruction_type, step, avg(n_tokens) AS m FROM chains GROUP BY ALL) SELECT instruction_type, round(max(m) - min(m), 6) AS \"range\", round(max(m) FILTER (WHERE step = 0), 6) AS reference FROM m GROUP BY instruction_type"


def cross_study(spark, sf_dir):
    """Two studies in one frame: rows, mean and the change against the step before, by step."""
    t = chains(spark, sf_dir).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("m")).withColumn("study", F.lit("conversations"))
    s = _metrics(spark, sf_dir)[0].groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("answer_f1").alias("m")).withColumn("study", F.lit("events"))
    both = t.unionByName(s)
    before = both.select("study", (F.col("step") + 1).alias("step"), F.col("m").alias("b"))
    return both.join(before, ["study", "step"], "left").select("study", "step", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - F.col("b"), 6).alias("change"))


CROSS_STUDY = f"""{_M}, {CHAINS_SQL}, b AS (SELECT 'conversations' AS study, step, count(*) AS n, avg(n_tokens) AS m FROM chains GROUP BY step UNION ALL SELECT 'events', step, count(*), avg(answer_f1) FROM answer GROUP BY step)
SELECT x.study, x.step, x.n, round(x.m, 6) AS mean, round(x.m - y.m, 6) AS change FROM b x LEFT JOIN b y ON x.study = y.study AND x.step = y.step + 1"""


def metric_zones(spark, sf_dir):
    """Two-dimensional bins of two metrics with log counts; the zones below .1, .3 to .5 and from .5 may share .5 (AG27, FIL10)."""
    answer, _, facts = _metrics(spark, sf_dir)
    b = answer.join(facts, K5).select(F.least(F.lit(19), F.floor(F.col("answer_f1") * 20)).cast("int").alias("x_bin"), F.least(F.lit(19), F.floor(F.col("factscore") * 20)).cast("int").alias("y_bin"), "answer_f1")
    zone = lambda c: F.count_if(c)
    a = F.col("answer_f1")
    return b.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.log10(F.count(F.lit(1)).cast("double")), 6).alias("log_n"), zone(a < 0.1).alias("n_low"), zone(a.between(0.3, 0.5)).alias("n_mid"), zone((a >= 0.3) & (a < 0.5)).alias("n_mid_open"), zone(a >= 0.5).alias("n_high"))


METRIC_ZONES = f"""{_M}, b AS (SELECT CAST(least(19, floor(answer_f1 * 20)) AS INTEGER) AS x_bin, CAST(least(19, floor(factscore * 20)) AS INTEGER) AS y_bin, answer_f1 AS a FROM answer JOIN ofs USING ({_K}))
SELECT x_bin, y_bin, count(*) AS n, round(log10(count(*)), 6) AS log_n, count(*) FILTER (WHERE a < 0.1) AS n_low, count(*) FILTER (WHERE a BETWEEN 0.3 AND 0.5) AS n_mid, count(*) FILTER (WHERE a >= 0.3 AND a < 0.5) AS n_mid_open, count(*) FILTER (WHERE a >= 0.5) AS n_high FROM b GROUP BY ALL"""


def label_counts(spark, sf_dir):
    """Labels with how often and in how many questions each occurs, most frequent first (AG14, AG15)."""
    return metric_rows(spark, sf_dir).groupBy("instruction_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("n_questions"), F.count_distinct("qid", "run").alias("n_chains")).orderBy(F.desc("n"), "instruction_type")


LABEL_COUNTS = f"{_M} SELECT instruction_type, count(*) AS n, count(DISTINCT qid) AS n_questions, count(DISTINCT (qid, run)) AS n_chains FROM mrows GROUP BY instruction_type"


def lost_facts(spark, sf_dir):
    """Rows of one instruction with facts that are not supported, and how many (FIL4)."""
    return _metrics(spark, sf_dir)[2].where("instruction_type = 'purchase' and n_supported < n_facts").select(*K5, (F.col("n_facts") - F.col("n_supported")).alias("n_lost"))


LOST_FACTS = f"{_M} SELECT {_K}, n_facts - n_supported AS n_lost FROM ofs WHERE instruction_type = 'purchase' AND n_supported < n_facts"


def fiction_gate(spark, sf_dir):
    """Texts of allowed styles that only informed readers answer, and that are roots or have no duplicate (FIL6, FIL8).

    Stand-ins: the language is the style, ``toxic`` the blind grade, ``quality`` the informed one, and the first of
    equal texts their root.
    """
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de", "fr")).select("doc_id", F.col("lang").alias("style"), F.md5("text").alias("h"))
    roots = d.groupBy("h").agg(F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "root")
    graded = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade_blind"), F.col("quality").alias("grade_informed"))
    all_ = d.join(roots, "h", "left").join(graded, "doc_id", "left")
    return all_.where(F.col("grade_blind").eqNullSafe(0) & F.col("grade_informed").eqNullSafe(1) & (F.col("root").isNull() | (F.col("root") == F.col("doc_id")))).select("doc_id", "style", "root")


FICTION_GATE = """WITH d AS (SELECT doc_id, lang AS style, md5(text) AS h FROM documents WHERE lang IN ('en', 'de', 'fr')), r AS (SELECT h, min(doc_id) AS root FROM d GROUP BY h HAVING count(*) > 1 AND h IS NOT NULL)
SELECT doc_id, style, root FROM d LEFT JOIN r USING (h) LEFT JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 1 AND (root IS NULL OR root = doc_id)"""


def news_gate(spark, sf_dir):
    """Questions whose cells say that an answer exists and is agreed on; cells that are no number drop the row (FIL7, SC6).

    Stand-ins: the cells are made of an event's value and type.
    """
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    cents = F.round(F.col("value") * 100).cast("bigint")
    absent = F.when(F.col("event_type") == "error", "n/a").when(cents % 7 == 0, "").otherwise(F.concat(F.lit("0."), (cents % 10).cast("string")))
    cells = e.select("event_id", absent.alias("is_answer_absent"), F.concat(F.lit("0."), (F.col("user_id") % 10).cast("string")).alias("is_question_bad"), F.coalesce("props", F.lit("")).alias("story"), (F.col("event_id") % 4).alias("agreed"), (F.col("event_id") % 3).alias("n_none"), (F.col("user_id") % 3).alias("n_bad"))
    number = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double"))
    judged = cells.withColumns({"absent": number(F.col("is_answer_absent")), "bad": number(F.col("is_question_bad"))})
    return judged.where("absent < 0.5 and bad < 0.5 and story <> '' and agreed >= 2 and agreed > greatest(n_none, n_bad)").select("event_id", "absent", "bad", "agreed")


NEWS_GATE = """WITH c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN CAST(round(value * 100) AS BIGINT) % 7 = 0 THEN '' ELSE '0.' || CAST(CAST(round(value * 100) AS BIGINT) % 10 AS VARCHAR) END AS a,
'0.' || CAST(user_id % 10 AS VARCHAR) AS b, coalesce(props, '') AS story, event_id % 4 AS agreed, event_id % 3 AS n_none, user_id % 3 AS n_bad FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
j AS (SELECT *, CASE WHEN a = '' THEN 0.0 ELSE TRY_CAST(a AS DOUBLE) END AS absent, TRY_CAST(b AS DOUBLE) AS bad FROM c)
SELECT event_id, absent, bad, agreed FROM j WHERE absent < 0.5 AND bad < 0.5 AND story <> '' AND agreed >= 2 AND agreed > greatest(n_none, n_bad)"""


def sourcer_agreement(spark, sf_dir):
    """How many parts of a joined cell give the same answer text (SC7)."""
    c = chains(spark, sf_dir).select("qid", "run", "step", F.regexp_replace("text", r"[.,]\s*", "|").alias("cell"))
    parts = c.select("qid", "run", "step", F.explode(F.split("cell", r"\|")).alias("answer")).select("qid", "run", "step", F.trim("answer").alias("answer")).where("answer <> ''")
    return parts.groupBy("qid", "run", "step", "answer").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


SOURCER_AGREEMENT = f"""WITH {CHAINS_SQL}, p AS (SELECT qid, run, step, trim(unnest(string_split(regexp_replace(text, '[.,]\\s*', '|', 'g'), '|'))) AS answer FROM chains)
SELECT qid, run, step, answer, count(*) AS n FROM p WHERE answer <> '' GROUP BY ALL HAVING count(*) >= 2"""


def mismatch_candidates(spark, sf_dir):
    """Answers scored zero that may be right after all, with the reasons (FIL10, FIL11, SC18, SC19).

    Stand-ins: the first three words of a chain are the gold answer, its turns the predictions, and the share of
    ``n_tokens`` over 100 a learned score.
    """
    c = chains(spark, sf_dir)
    norm = lambda t: F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, "[–—]", "-"), r"\s+", " ")))
    gold = c.where("step = 0").select("qid", "run", F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3)).alias("gold"))
    z = c.where("step > 0").join(gold, ["qid", "run"]).select("qid", "run", "step", "gold", norm(F.col("gold")).alias("g"), norm(F.col("text")).alias("p"), (F.col("n_tokens") % 100 / 100.0).alias("b"))
    rules = {
        "exact_norm": F.col("g") == F.col("p"), "gold_in_pred": F.col("p").contains(F.col("g")) & (F.col("g") != F.col("p")), "bleurt_high": F.col("b") >= 0.5,
        "bleurt_mid": (F.col("b") >= 0.3) & (F.col("b") < 0.5) & (F.length("gold") <= 15),
    }
    tag = F.concat_ws("+", *[F.when(rule, name) for name, rule in rules.items()])
    return z.select("qid", "run", "step", tag.alias("tags")).where("tags <> ''").orderBy(F.desc("tags"), "qid", "run", "step")


MISMATCH_CANDIDATES = f"""WITH {CHAINS_SQL}, g AS (SELECT qid, run, array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') AS gold FROM chains WHERE step = 0),
n AS (SELECT qid, run, step, gold, lower(trim(regexp_replace(regexp_replace(gold, '[–—]', '-', 'g'), '\\s+', ' ', 'g'))) AS g, lower(trim(regexp_replace(regexp_replace(text, '[–—]', '-', 'g'), '\\s+', ' ', 'g'))) AS p, n_tokens % 100 / 100.0 AS b FROM chains JOIN g USING (qid, run) WHERE step > 0),
t AS (SELECT qid, run, step, concat_ws('+', CASE WHEN g = p THEN 'exact_norm' END, CASE WHEN contains(p, g) AND g <> p THEN 'gold_in_pred' END, CASE WHEN b >= 0.5 THEN 'bleurt_high' END, CASE WHEN b >= 0.3 AND b < 0.5 AND length(gold) <= 15 THEN 'bleurt_mid' END) AS tags FROM n)
SELECT * FROM t WHERE tags <> ''"""


JOBS = {
    name: (job, sql)
    for name, job, sql in [
        ("metric_tokens", metric_tokens, METRIC_TOKENS), ("metric_table", metric_table, METRIC_TABLE), ("metric_repetitions", metric_repetitions, METRIC_REPETITIONS), ("metric_disagreement", metric_disagreement, METRIC_DISAGREEMENT),
        ("score_extremes", score_extremes, SCORE_EXTREMES), ("first_rows", first_rows, FIRST_ROWS), ("review_sample", review_sample, REVIEW_SAMPLE), ("wording_choice", wording_choice, WORDING_CHOICE),
        ("rewriting_axes", rewriting_axes, REWRITING_AXES), ("texts_by_step", texts_by_step, TEXTS_BY_STEP), ("step_export", step_export, STEP_EXPORT), ("supported_percent", supported_percent, SUPPORTED_PERCENT),
        ("run_deltas", run_deltas, RUN_DELTAS), ("step_deltas", step_deltas, STEP_DELTAS), ("heatmap", heatmap, HEATMAP), ("chain_trajectories", chain_trajectories, CHAIN_TRAJECTORIES),
        ("answerability", answerability, ANSWERABILITY), ("degradation_band", degradation_band, DEGRADATION_BAND), ("token_ranges", token_ranges, TOKEN_RANGES), ("cross_study", cross_study, CROSS_STUDY),
        ("metric_zones", metric_zones, METRIC_ZONES), ("label_counts", label_counts, LABEL_COUNTS), ("lost_facts", lost_facts, LOST_FACTS), ("fiction_gate", fiction_gate, FICTION_GATE),
        ("news_gate", news_gate, NEWS_GATE), ("sourcer_agreement", sourcer_agreement, SOURCER_AGREEMENT), ("mismatch_candidates", mismatch_candidates, MISMATCH_CANDIDATES),
    ]
}
