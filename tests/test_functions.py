"""Scalars on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import labels, text
from palimpsest.operators import distributions as dist


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("gold", "pred", "want"), [("the cat sat", "A cat", 2 / 3), ("a a b b", "b b c", 0.8), ("the", "", 1.0), ("x", "", 0.0), ("x", "y", 0.0), (None, None, 1.0)])
def test_token_f1(spark, gold, pred, want):
    assert value(spark, text.token_f1(F.col("g"), F.col("p")), g=gold, p=pred) == pytest.approx(want)


@pytest.mark.parametrize(("spans", "want"), [("0:2,3:5", "ab cd"), ("oops", None), ("0:2", "ab"), ("1:99", "b cd"), ("0:2,", None)])
def test_spans(spark, spans, want):
    assert value(spark, text.decode_spans(F.col("s"), F.col("t")), s=spans, t="ab cd") == want


@pytest.mark.parametrize(("reply", "want"), [("False. Actually True", "SUPPORTED"), ("True? no, false", "NOT_SUPPORTED"), ("I do not know", "NOT_SUPPORTED"), ("", "SUPPORTED"), (None, "SUPPORTED")])
def test_support_label(spark, reply, want):
    assert value(spark, labels.support_label(F.col("r")), r=reply) == want


def test_facts_and_json(spark):
    assert value(spark, text.atomic_facts(F.col("b")), b="Sure:\n- A b\n- C.\n\n- D") == ["A b.", "C."]
    assert value(spark, text.atomic_facts(F.col("b")), b="") == []
    reply = 'ok {"label": "lost", "x": 1} end'
    assert value(spark, labels.json_label(F.col("r"), ["KEPT", "LOST"], "KEPT"), r=reply) == "LOST"
    assert value(spark, labels.json_label(F.col("r"), ["KEPT", "LOST"], "KEPT"), r="it was lost") == "LOST"
    assert value(spark, labels.json_label(F.col("r"), ["KEPT", "LOST"], "KEPT"), r=None) == "KEPT"
    assert value(spark, labels.quoted_items(F.col("r"), "lost"), r='{"lost": ["a", "b c"], "added": ["d') == ["a", "b c"]
    assert value(spark, labels.retry_seconds(F.col("r")), r="try again in 250ms") == 0.25
    assert value(spark, text.aliases(F.col("a"), F.col("g")), a="x|| y", g="z") == ["z", "x", "y"]
    assert value(spark, text.topic(F.col("t"), F.lit("none")), t="\n \nfirst\nsecond") == "first"
    assert value(spark, text.hops(F.col("q")), q="3hop__1") == 3
    assert value(spark, text.sentences(F.col("t")), t="J. Smith came home. He slept well! Yes.") == ["J. Smith came home.", "He slept well! Yes."]


def test_tails():
    assert dist.chi2_tail(43.99029126213608, 3) == pytest.approx(1.51636613e-09, rel=1e-6)
    assert dist.chi2_tail(2.59825, 3) == pytest.approx(0.45780, abs=1e-4)
    assert dist.t_tail(0, 5) == pytest.approx(0.5)
    assert dist.t_tail(2.570582, 5) == pytest.approx(0.025, abs=1e-6)
    assert dist.sign_p(3, 9) == pytest.approx(0.1459961)
    assert dist.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857143)
    assert dist.binomial_tail(0, 5) == 1.0 and dist.sign_p(0, 0) == 1.0
