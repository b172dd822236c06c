"""The driver's tables in the shape of the analytics tables, and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTRUCTIONS = ["paraphrase", "formality", "shorten", "elaborate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a chain, its turns are the steps."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    name = F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), (k + 1).cast("int"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    return c.select(
        F.concat((2 + F.col("conv_id") % 3).cast("string"), F.lit("hop__"), F.col("conv_id").cast("string")).alias("qid"),
        F.when(k < 2, "style").otherwise("content").alias("group"), name.alias("instruction_type"), (F.col("conv_id") % 3).cast("int").alias("run"),
        F.col("turn").cast("int").alias("step"), F.coalesce("text", F.lit("")).alias("text"), F.size(words).alias("n_tokens"),
    )


CHAINS_SQL = """
chains AS (
  SELECT CAST(2 + conv_id % 3 AS VARCHAR) || 'hop__' || CAST(conv_id AS VARCHAR) AS qid,
         CASE WHEN conv_id % 4 < 2 THEN 'style' ELSE 'content' END AS grp,
         list_extract(['paraphrase', 'formality', 'shorten', 'elaborate'], CAST(conv_id % 4 + 1 AS INTEGER)) AS instruction_type,
         CAST(conv_id % 3 AS INTEGER) AS run, CAST(turn AS INTEGER) AS step, coalesce(text, '') AS text,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS INTEGER) AS n_tokens
  FROM conversations)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a question, an event type an instruction, a week a step; the score is the mean value over 100.

    Values have two decimals, so cents are summed up: the mean is the same whatever the order of the rows.
    """
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    week = F.least(F.lit(3), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        e.groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("instruction_type"), week.alias("step"))
        .agg((F.sum(cents) / (F.count(F.lit(1)) * 10000)).alias("score"), F.count(F.lit(1)).alias("n_events"))
        .withColumn("n_hop", (2 + F.col("qid") % 3).cast("int"))
    )


SCORES_SQL = """
scores AS (
  SELECT user_id AS qid, event_type AS instruction_type,
         CAST(least(3, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0)) AS INTEGER) AS step,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10000) AS score, count(*) AS n_events,
         CAST(2 + user_id % 3 AS INTEGER) AS n_hop
  FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
"""


def subject_means(s: DataFrame, steps: list[int]) -> DataFrame:
    """qid x step means in columns s<step>; subjects that lack a step are left out."""
    wide = s.groupBy("qid").pivot("step", steps).agg(F.round(F.avg("score"), 9))
    return wide.na.drop().select("qid", *[F.col(str(k)).alias(f"s{k}") for k in steps])


def subject_sql(steps: list[int]) -> str:
    cols = ", ".join(f"round(avg(score) FILTER (WHERE step = {k}), 9) AS s{k}" for k in steps)
    have = " AND ".join(f"s{k} IS NOT NULL" for k in steps)
    return f"subj AS (SELECT * FROM (SELECT qid, {cols} FROM scores GROUP BY qid) WHERE {have})"


#: The keys of a chain, which with the step identify a row of every metric.
CHAIN = ["qid", "grp", "instruction_type", "run"]


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the keys of a chain: a user is a question, an event type an instruction, a week a step."""
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    return e.select(
        F.col("user_id").alias("qid"), F.when(F.col("event_type").isin("view", "click"), "browse").otherwise("act").alias("grp"), F.col("event_type").alias("instruction_type"),
        (F.col("event_id") % 2).cast("int").alias("run"), (F.col("event_id") % 3).cast("int").alias("repetition"), F.least(F.lit(3), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int")).alias("step"),
        (2 + F.col("user_id") % 3).cast("int").alias("n_hop"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), "event_id",
    )


def metrics(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answer_f1, n_tokens and factscore per keys: the mean value over 100, how many values are above 10, and the share
    of values of at least 50 among four fifths of the events."""
    one = F.count(F.lit(1))
    answer = rows.groupBy(*keys).agg((F.sum("cents") / (one * 10000)).alias("answer_f1"))
    tokens = rows.where("cents > 1000").groupBy(*keys).agg(one.alias("n_tokens"))
    facts = rows.where("event_id % 5 <> 0").groupBy(*keys).agg(one.alias("n_facts"), F.count_if(F.col("cents") >= 5000).alias("n_supported"))
    return answer, tokens, facts.withColumn("factscore", F.col("n_supported") / F.col("n_facts"))


def metrics_sql(keys: list[str]) -> str:
    by = ", ".join(keys)
    return f"""mrows AS (SELECT user_id AS qid, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS grp, event_type AS instruction_type, CAST(event_id % 2 AS INTEGER) AS run,
  CAST(event_id % 3 AS INTEGER) AS repetition, CAST(least(3, floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0)) AS INTEGER) AS step, CAST(2 + user_id % 3 AS INTEGER) AS n_hop,
  CAST(round(value * 100) AS BIGINT) AS cents, event_id FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
answer AS (SELECT {by}, CAST(sum(cents) AS DOUBLE) / (count(*) * 10000) AS answer_f1 FROM mrows GROUP BY ALL),
tokens AS (SELECT {by}, count(*) AS n_tokens FROM mrows WHERE cents > 1000 GROUP BY ALL),
ofs AS (SELECT *, n_supported / n_facts AS factscore FROM (SELECT {by}, count(*) AS n_facts, count(*) FILTER (WHERE cents >= 5000) AS n_supported FROM mrows WHERE event_id % 5 <> 0 GROUP BY ALL))"""
