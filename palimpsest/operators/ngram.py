"""A back-off language model of three words, counted and smoothed by Spark, and perplexity over sliding windows.

Absolute discounting: a seen gram gives up a fixed part of each of its counts, and what a context gave up is shared out by
the model of one word less; the model of single words adds one to each count and keeps one for all unseen words. Texts are
scored by their distinct grams, so a gram's probability is looked up once a text, by equi-joins with the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOUNT = 0.75


@dataclass
class Model:
    """Counts of grams (w, vw, uvw) and of contexts (v, uv) with how many words follow, and of all words and kinds."""

    one: DataFrame
    two: DataFrame
    after_one: DataFrame
    three: DataFrame
    after_two: DataFrame
    words: int
    kinds: int


def grams(texts: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, pos, u, v, w): each word and the two before it; NULL before the text begins."""
    before = lambda i, k: F.when(i >= k, F.get(words, F.greatest(i - k, F.lit(0))))
    each = F.transform(words, lambda w, i: F.struct(i.alias("pos"), before(i, 2).alias("u"), before(i, 1).alias("v"), w.alias("w")))
    return texts.select(*keys, F.explode(each).alias("g")).select(*keys, "g.*")


def train(texts: DataFrame, words: str = "words") -> Model:
    """Counts over (words: array of strings)."""
    n = F.count(F.lit(1))
    three = grams(texts, [], words).groupBy("u", "v", "w").agg(n.alias("n3"))
    two = three.groupBy("v", "w").agg(F.sum("n3").alias("n2"))
    one = two.groupBy("w").agg(F.sum("n2").alias("n1"))
    after_one = two.where("v is not null").groupBy("v").agg(F.sum("n2").alias("c2"), n.alias("t2"))
    whole = three.where("u is not null")
    size = one.agg(F.sum("n1"), n).first()
    return Model(one, two.where("v is not null"), after_one, whole, whole.groupBy("u", "v").agg(F.sum("n3").alias("c3"), n.alias("t3")), size[0] or 0, size[1] or 0)


def _smoothed(count: str, total: str, kinds: str, lower: Column) -> Column:
    """The discounted share of a gram and its part of what its context gave up; the lower model for a context not seen."""
    kept = F.greatest(F.coalesce(count, F.lit(0)) - DISCOUNT, F.lit(0.0))
    return F.when(F.col(total).isNull(), lower).otherwise((kept + DISCOUNT * F.col(kinds) * lower) / F.col(total))


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """``asked`` (with u, v, w) and ``p``, the probability of w behind u and v."""
    rows = asked.join(model.one, "w", "left").join(model.after_one, "v", "left").join(model.two, ["v", "w"], "left")
    rows = rows.join(model.after_two, ["u", "v"], "left").join(model.three, ["u", "v", "w"], "left")
    single = (F.coalesce("n1", F.lit(0)) + 1.0) / float(model.words + model.kinds + 1)
    p = _smoothed("n3", "c3", "t3", _smoothed("n2", "c2", "t2", single))
    return rows.withColumn("p", p).drop("n1", "n2", "c2", "t2", "n3", "c3", "t3")


def window_losses(texts: DataFrame, keys: list[str], model: Model, length: int, stride: int, words: str = "words") -> DataFrame:
    """(keys, window, n, loss): the words that each sliding window scores and their negative log-likelihood. A window scores
    what the one before has not; with a stride of two words at least below the length, all it scores has its context."""
    nth = F.when(F.col("pos") < length, F.lit(0)).otherwise(F.floor((F.col("pos") - length) / stride) + 1).cast("int")
    asked = grams(texts, keys, words).groupBy(*keys, nth.alias("window"), "u", "v", "w").agg(F.count(F.lit(1)).alias("times"))
    lost = probabilities(asked, model).withColumn("loss", -F.ln("p") * F.col("times"))
    return lost.groupBy(*keys, "window").agg(F.sum("times").alias("n"), F.sum("loss").alias("loss"))


def perplexity(losses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, windows, loss, perplexity) of texts with words."""
    out = losses.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"), F.sum("loss").alias("loss"))
    return out.withColumn("perplexity", F.exp(F.col("loss") / F.col("n")))
