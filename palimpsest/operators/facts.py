"""Fact scores: precision and recall with a length penalty, taxonomy tables, chance-corrected agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fact_score(details: DataFrame, keys: list[str], gamma: float = 10.0, penalty: bool = True) -> DataFrame:
    """Counts, share supported, and that share times min(1, facts / gamma), per key; NULL without facts.

    A label other than SUPPORTED and CONTRADICTED counts as not supported.
    """
    yes, no = F.count_if(F.col("label") == "SUPPORTED"), F.count_if(F.col("label") == "CONTRADICTED")
    c = details.groupBy(*keys).agg(F.count("fact").alias("n_facts"), yes.alias("n_supported"), no.alias("n_contradicted"))
    init = F.try_divide(F.col("n_supported").cast("double"), F.col("n_facts"))
    factor = F.least(F.lit(1.0), F.col("n_facts") / gamma) if penalty and gamma > 0 else F.lit(1.0)
    return c.select(*keys, "n_facts", "n_supported", (F.col("n_facts") - F.col("n_supported") - F.col("n_contradicted")).alias("n_not_supported"), "n_contradicted", F.round(init, 6).alias("init_score"), F.round(init * factor, 6).alias("factscore"))


def recall_score(labelled: DataFrame, originals: DataFrame, key: str, keys: list[str], gamma: float = 10.0, yes: str = "SURVIVED") -> DataFrame:
    """Share of the original's facts recalled, and that share times min(1, original facts / gamma), per key.

    ``originals``: (key, fact), whose number makes the penalty; an original without facts has NULL scores.
    """
    n = originals.groupBy(key).agg(F.count("fact").alias("n_facts"))
    hits = labelled.groupBy(*keys).agg(F.count_if(F.col("label") == yes).alias("n_recalled"))
    both = hits.join(n, key, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    init = F.try_divide(F.col("n_recalled").cast("double"), F.col("n_facts"))
    factor = F.least(F.lit(1.0), F.col("n_facts") / gamma) if gamma > 0 else F.lit(1.0)
    return both.select(*keys, "n_facts", "n_recalled", F.round(init, 6).alias("recall_init"), F.round(init * factor, 6).alias("recall"))


def overlap_scores(facts: DataFrame, texts: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(keys, fact_id, score) of (key, fact_id, tokens) against (keys, tokens): the share of a fact's distinct tokens that
    the text has. Facts and texts meet by key and token, so common tokens of one key are all that is ever joined."""
    own = facts.select(key, "fact_id", F.explode(F.array_distinct("tokens")).alias("token"))
    size = facts.select(key, "fact_id", F.size(F.array_distinct("tokens")).alias("size"))
    said = texts.select(*keys, F.explode(F.array_distinct("tokens")).alias("token"))
    shared = said.join(own, [key, "token"]).groupBy(*keys, "fact_id").agg(F.count(F.lit(1)).alias("shared"))
    every = texts.select(*keys).join(size, key)
    return every.join(shared, [*keys, "fact_id"], "left").select(*keys, "fact_id", F.try_divide(F.coalesce("shared", F.lit(0)).cast("double"), F.col("size")).alias("score"))


def recalled(facts: DataFrame, texts: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Facts of the original beside each later text of its question: fact, SURVIVED if the text has it, else LOST."""
    met = texts.join(facts, key)
    return met.select(*keys, "fact", F.when(F.col("text").contains(F.col("fact")), "SURVIVED").otherwise("LOST").alias("label"))


def bounds(details: DataFrame, keys: list[str]) -> DataFrame:
    """Share of hallucinated facts: those false for sure, and with those uncertain."""
    n = F.count(F.lit(1))
    sure, open_ = F.count_if(F.col("taxonomy") == "extrinsic_false"), F.count_if(F.col("taxonomy") == "extrinsic_uncertain")
    return details.groupBy(*keys).agg(n.alias("n"), F.round(sure / n, 6).alias("lower"), F.round((sure + open_) / n, 6).alias("upper"))


def kappa(df: DataFrame, one: str, two: str) -> DataFrame:
    """Cohen's kappa of two label columns: n, observed and expected agreement, kappa."""
    cells = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("ra")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("cb"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("e"))
    seen = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("o"))
    both = seen.join(F.broadcast(chance), F.lit(True))
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))
