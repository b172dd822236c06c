"""Relational operators over chains: pairs of steps, resume, broadcast of the original, episodes, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import answer_tokens, f1


def with_originals(chains: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Each step beside its chain's step 0 and its exact predecessor: one window, no self-join."""
    chain = Window.partitionBy(*keys)
    before = chain.orderBy("step")
    original = F.max(F.when(F.col("step") == 0, F.col(column))).over(chain)
    previous = F.when(F.lag("step").over(before) == F.col("step") - 1, F.lag(column).over(before))
    return chains.withColumns({"n_first": original, "previous": previous})


def step_similarity(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Token F1 of each step against step 0 and against its predecessor, for texts of any length.

    Tokens are counted per chain and step, and the counts of a token meet by chain, so no text is compared with
    another in one expression and a long text is spread over many rows.
    """
    tokens = chains.select(*keys, "step", F.explode_outer(answer_tokens(F.col("text"))).alias("token"))
    counts = tokens.groupBy(*keys, "token", "step").agg(F.count("token").alias("n"))
    per_token = counts.groupBy(*keys, "token").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by_step"))
    each = per_token.select(*keys, F.explode("by_step").alias("step", "n"), "by_step")
    shared = lambda other: F.sum(F.least("n", F.coalesce(F.try_element_at("by_step", other), F.lit(0))))
    sums = each.groupBy(*keys, "step").agg(F.sum("n").alias("n_own"), shared(F.lit(0)).alias("with_first"), shared(F.col("step") - 1).alias("with_previous"))
    both = with_originals(sums, keys, "n_own")
    return both.where("step > 0").select(
        *keys, "step", "n_own",
        F.when(F.col("n_first").isNotNull(), f1(F.col("with_first"), F.col("n_own"), F.col("n_first"))).alias("f1_original"),
        F.when(F.col("previous").isNotNull(), f1(F.col("with_previous"), F.col("n_own"), F.col("previous"))).alias("f1_consecutive"),
    )


def compression(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each step as a share of those of step 0; NULL if that has none."""
    first = F.max(F.when(F.col("step") == 0, F.col("n_tokens"))).over(Window.partitionBy(*keys))
    return chains.withColumn("compression_ratio", F.try_divide(F.col("n_tokens").cast("double"), first))


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not in the output yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def spread_original(scored: DataFrame, chains: DataFrame, shared: list[str], keys: list[str]) -> DataFrame:
    """Scores of step 0, made once per ``shared`` key, given to every chain of that key."""
    wanted = chains.select(*keys).distinct()
    return wanted.join(scored.drop(*[k for k in keys if k not in shared]), shared)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the order must end in a unique column."""
    return keep_first(df, keys, order)


def head_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def seeded_sample(df: DataFrame, keys: list[str], id_col: str, seed: int, n: int) -> DataFrame:
    """``n`` rows per key in an order drawn from the seed and the id, the same on any cluster."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return head_per_group(df, keys, [draw, F.col(id_col)], n)


def episodes(scores: DataFrame, keys: list[str], threshold: float, value: str = "score") -> DataFrame:
    """First step after 0 at or above the threshold, and how long until the score falls below: duration, and
    whether the fall was seen or the chain ended first."""
    chain = Window.partitionBy(*keys)
    above = F.coalesce(F.col(value) >= threshold, F.lit(False))
    first = F.min(F.when((F.col("step") > 0) & above, F.col("step"))).over(chain)
    hit = scores.withColumns({"first_hit_step": first, "last_step": F.max("step").over(chain)}).where("first_hit_step is not null")
    lost = F.min(F.when((F.col("step") > F.col("first_hit_step")) & ~above, F.col("step")))
    out = hit.groupBy(*keys, "first_hit_step").agg(lost.alias("lost"), F.first("last_step").alias("last_step"))
    return out.select(
        *keys, "first_hit_step", (F.coalesce("lost", F.col("last_step") + 1) - F.col("first_hit_step")).cast("int").alias("duration"), F.col("lost").isNotNull().cast("int").alias("event_observed")
    )


def rewriting_plan(questions: DataFrame, instructions: list[tuple[str, str]], wordings: int, repetitions: int = 1) -> DataFrame:
    """Questions x (group, instruction_type) x wordings x repetitions, each row spread where it is."""
    kinds = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(i).alias("instruction_type")) for g, i in instructions])
    plan = questions.select("qid", F.explode(kinds).alias("k")).select("qid", "k.*", F.explode(F.sequence(F.lit(0), F.lit(wordings - 1))).alias("run"))
    return plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition")) if repetitions > 1 else plan
