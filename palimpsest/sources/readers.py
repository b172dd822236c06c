"""Scans of the source formats. Every reader takes an explicit schema, so that Spark never reads a file twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas


def csv(spark: SparkSession, path: str, schema: str, keep_empty: bool = False) -> DataFrame:
    """A table with a header whose cells may hold line breaks and doubled quotes; NaN becomes NULL.

    ``keep_empty``: empty text cells stay empty instead of NULL.
    """
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    nan = {c: F.nullif(c, F.lit(float("nan"))) for c, t in df.dtypes if t == "double"}
    empty = {c: F.coalesce(c, F.lit("")) for c, t in df.dtypes if keep_empty and t == "string"}
    return df.withColumns(nan | empty) if nan or empty else df


def jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One record a line, blank lines skipped; ``tolerant`` drops malformed lines, else they fail the job."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def answers_by_question(questions: DataFrame) -> DataFrame:
    """id, question, answer, aliases, without nulls among the alias lists."""
    return questions.select("id", "question", "answer", F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("aliases"))


def demonstrations(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, facts) of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("sentence", "facts"))


def pinned_ids(spark: SparkSession, path: str) -> DataFrame:
    """(qid) of a text file with an id a line and # comments."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("qid"))
    return lines.where("qid <> ''").distinct()


def restrict(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the pinned ids, and the ids that have none."""
    return df.join(ids, "qid", "left_semi"), ids.join(df, "qid", "left_anti")


def original_text(paragraphs: Column, only_supporting: bool) -> Column:
    """``title. text`` of each paragraph, a blank line between; supporting ones alone are put in order."""
    kept = F.array_sort(F.filter(paragraphs, lambda p: p["is_supporting"])) if only_supporting else paragraphs
    return F.array_join(F.transform(kept, lambda p: F.concat(p["title"], F.lit(". "), p["paragraph_text"])), "\n\n")


def stories(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.STORIES, keep_empty=True)
