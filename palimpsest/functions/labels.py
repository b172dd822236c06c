"""Parsers of model and judge output as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a refusal, in the long list, and below it in the short one of the funnel.
REFUSALS = [
    "does not provide", "cannot answer", "not specified", "not provided", "no information", "cannot determine", "unable to", "context does not",
    "cannot be determined", "is not mentioned", "no specific", "don't know", "i cannot", "no clear", "unanswerable", "none provided", "none of the",
    "the question cannot",
]

FUNNEL_REFUSALS = ["context does not", "cannot answer", "don't have", "does not provide", "no information", "not mentioned", "unable to", "i cannot"]


def support_label(reply: Column) -> Column:
    """SUPPORTED or NOT_SUPPORTED: of true and false, the one that first occurs later decides; without them a negation
    does; else supported."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    has = lambda w: F.instr(low, w) > 0
    words = F.split(F.regexp_replace(low, r"[!-/:-@\[-`{-~]", ""), r"\s+")
    negated = F.arrays_overlap(words, F.array(*map(F.lit, ("not", "cannot", "unknown", "information"))))
    supported = (
        F.when(has("true") & has("false"), F.instr(low, "true") > F.instr(low, "false")).when(has("true"), True).when(has("false"), False).otherwise(~negated)
    )
    return F.when(supported, "SUPPORTED").otherwise("NOT_SUPPORTED")


def json_label(reply: Column, known: list[str], fallback: str, field: str = "label") -> Column:
    """A label in the JSON between the first { and the last }; failing that, the first known label the reply contains."""
    parsed = F.upper(F.trim(F.get_json_object(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), f"$.{field}")))
    found = F.lit(fallback)
    for label in reversed(known):
        found = F.when(F.upper(F.coalesce(reply, F.lit(""))).contains(label.upper()), label).otherwise(found)
    exact = F.lit(None).cast("string")
    for label in known:
        exact = F.when(parsed == label.upper(), label).otherwise(exact)
    return F.coalesce(exact, found)


def quoted_items(reply: Column, field: str) -> Column:
    """Strings of a list in a JSON reply that may be cut off."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), rf'(?s)"{field}"\s*:\s*\[(.*?)(?:\]|$)', 1)
    return F.regexp_extract_all(body, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)


def survival(reply: Column) -> Column:
    """Whether a fact SURVIVED: LOST if the reply says false and not true, ERROR if there is none."""
    low = F.lower(reply)
    return F.when(reply.isNull(), "ERROR").when(low.contains("false") & ~low.contains("true"), "LOST").otherwise("SURVIVED")


def hallucination(first: Column, second: Column) -> Column:
    """Final class of two judgements: extrinsic claims are told apart by what is known of the world."""
    return (
        F.when(first != "extrinsic", first).when(second == "world_true", "extrinsic_true").when(second == "world_false", "extrinsic_false").otherwise("extrinsic_uncertain")
    )


def answer_kind(predicted: Column, phrases: list[str] = REFUSALS) -> Column:
    """EMPTY, REFUSAL (any phrase occurs) or WRONG."""
    low = F.lower(F.coalesce(predicted, F.lit("")))
    refusal = F.lit(False)
    for p in phrases:
        refusal = refusal | low.contains(p)
    return F.when(F.trim(low).isin("", "nan"), "EMPTY").when(refusal, "REFUSAL").otherwise("WRONG")


def trajectory(s2: Column, s3: Column) -> Column:
    """What became of a chain at zero: stayed there, recovered for good or for a time."""
    return F.when((s2 == 0) & (s3 == 0), "STAYED_ZERO").when(s3 > 0, "LATE_RECOVERY").when(s2 > 0, "TRANSIENT_RECOVERY").otherwise("OTHER")


def stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def retry_seconds(message: Column) -> Column:
    """Seconds of ``try again in 1.5s`` or ``250ms``; NULL if absent."""
    pattern = r"(?i)try again in ([0-9.]+)\s*(ms|s)"
    n = F.regexp_extract(message, pattern, 1).try_cast("double")
    return F.when(F.lower(F.regexp_extract(message, pattern, 2)) == "ms", n / 1000).otherwise(n)
