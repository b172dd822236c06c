"""Models behind one interface: a batch of prompts in, a batch of replies out; loaded once per worker."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.functions import text as texts


class Model(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Shortener:
    """A deterministic stand-in: keeps about nine of ten words, chosen by a hash."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [" ".join(w for k, w in enumerate(p.split()) if hashlib.md5(f"{k}{w}".encode()).digest()[0] % 10) for p in prompts]


class Retrying:
    """A model whose transient failures are tried again after 1, 2, 4, ... seconds; permanent ones are raised at once."""

    def __init__(self, model: Model, permanent: tuple[type[Exception], ...] = (ValueError, PermissionError), tries: int = 5, wait: Callable[[float], object] = time.sleep) -> None:
        self.model, self.permanent, self.tries, self.wait = model, permanent, tries, wait

    def generate(self, prompts: list[str]) -> list[str]:
        for k in range(self.tries - 1):
            try:
                return self.model.generate(prompts)
            except self.permanent:
                raise
            except Exception:
                self.wait(2.0**k)
        return self.model.generate(prompts)


def replies(load: Callable[[], Model], batch_size: int = 64) -> Callable[[Column], Column]:
    """An Arrow function over prompts; ``load`` runs once per worker and task."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            asked = prompts.fillna("").tolist()
            yield pd.Series([r for k in range(0, len(asked), batch_size) for r in model.generate(asked[k : k + batch_size])], dtype=object)

    return run


def rewrite_prompt(instruction: Column, text: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\n\nText: "), text)


def run_chains(plan: DataFrame, load: Callable[[], Model], steps: int = 3, prompt: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Rewrite ``text`` of each row ``steps`` times: chains run beside each other, their steps one after another.

    Each step is one projection, so Spark keeps a chain's row on one task; the result has a row per step.
    """
    ask = replies(load)
    keys = [c for c in plan.columns if c != "text"]
    state = plan.select(*keys, F.col("text").alias("e0"))
    for k in range(steps):
        state = state.withColumn(f"e{k + 1}", ask(prompt(F.col(f"e{k}"))))
    rows = F.array(*[F.col(f"e{k}") for k in range(steps + 1)])
    return state.select(*keys, F.posexplode(rows).alias("step", "text"))


def rewriter_prompt(text: Column) -> Column:
    return F.concat(F.lit("Rewrite: "), text)


def critic_prompt(text: str | None, draft: str | None, history: list[str | None]) -> str:
    """``history``: the feedback of earlier steps. What is missing is left out."""
    said = [None if text is None else f"Source: {text}", None if draft is None else f"Draft: {draft}", "Earlier: " + "; ".join(h for h in history if h is not None)]
    return "\n".join(x for x in said if x is not None)


def refiner_prompt(draft: str | None, feedback: str | None) -> str:
    said = [None if draft is None else f"Draft: {draft}", None if feedback is None else f"Feedback: {feedback}"]
    return "\n".join(x for x in said if x is not None)


#: Rows and characters of text that are refined at a time.
ROWS_AT_ONCE, TEXT_AT_ONCE = 64, 1 << 20


def _refined(texts: list[str], model: Model, steps: int) -> Iterator[list[tuple]]:
    """For each step (text, draft, feedback) of every text; null draft and feedback at step 0."""
    now, history = texts, [[] for _ in texts]
    yield [(t, None, None) for t in now]
    for _ in range(steps):
        drafts = model.generate(["" if t is None else f"Rewrite: {t}" for t in now])
        said = model.generate([critic_prompt(*x) for x in zip(now, drafts, history, strict=True)])
        now = model.generate([refiner_prompt(*x) for x in zip(drafts, said, strict=True)])
        for h, feedback in zip(history, said, strict=True):
            h.append(feedback)
        yield list(zip(now, drafts, said, strict=True))


def self_refine(plan: DataFrame, load: Callable[[], Model], steps: int = 3) -> DataFrame:
    """In each step a draft is written, criticised in view of the earlier feedback, and refined: a row per step with
    the refined text, the draft and the feedback (null at step 0).

    All steps of a few rows are made by one worker, which loads the model once and gives them away before it takes the
    next: prompts grow with the steps, and are held for those rows only.
    """
    keys = [c for c in plan.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            size, low = 0, 0
            lengths = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            for k, n in enumerate([*lengths, None]):
                if k > low and (n is None or k - low == ROWS_AT_ONCE or size + n > TEXT_AT_ONCE):
                    own = [b.column(c).slice(low, k - low) for c in keys]
                    texts = [t or "" for t in b.column("text").slice(low, k - low).to_pylist()]
                    for step, rows in enumerate(_refined(texts, model, steps)):
                        columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([step] * len(rows), pa.int32()), *columns], names=[*keys, "step", "text", "draft_text", "critic_feedback"])
                    low, size = k, 0
                size += n or 0

    kinds = dict(plan.dtypes)
    return plan.select(*keys, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "step int, text string, draft_text string, critic_feedback string"]))


def listed_facts(df: DataFrame, load: Callable[[], Model], prompt: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """A row per fact that the model lists for ``text``, in place of it."""
    facts = texts.atomic_facts(replies(load)(prompt(F.col("text"))))
    return df.select(*[c for c in df.columns if c != "text"], F.explode(facts).alias("fact"))


def judged_facts(df: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``df`` (source, topic, fact) and ``label``: whether the model holds the fact to be supported by the source."""
    asked = F.concat(F.lit("Topic: "), F.coalesce("topic", F.lit("")), F.lit("\nContext: "), F.coalesce("source", F.lit("")), F.lit("\nClaim: "), F.col("fact"), F.lit("\nIs the claim true or false?"))
    return df.withColumn("label", labels.support_label(replies(load)(asked)))


def compare_prompts(plan: DataFrame, load: Callable[[], Model], prompts: dict[str, Callable[[Column], Column]], steps: int = 1) -> DataFrame:
    """The same chains under several prompts, such as with and without a system prompt; ``prompt`` names them."""
    runs = [run_chains(plan, load, steps, make).withColumn("prompt", F.lit(name)) for name, make in prompts.items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def _parts(prompt: str) -> tuple[str, str]:
    """Context and claim of a prompt of ``judged_facts``."""
    body = prompt.split("\nContext: ", 1)[-1].rsplit("\nIs the claim true or false?", 1)[0]
    context, _, claim = body.rpartition("\nClaim: ")
    return context, claim


class OverlapJudge:
    """A deterministic stand-in for a judge: its words follow from the share of the claim's words that the context has."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.reply(*_parts(p)) for p in prompts]

    def reply(self, context: str, claim: str) -> str:
        said, known = set(claim.lower().split()), set(context.lower().split())
        if not known:
            return "Perhaps."
        share = len(said & known) / max(1, len(said))
        return "True." if share >= 0.5 else "False at first sight, but true." if share >= 0.35 else "True? No, false." if share >= 0.2 else "It is not in the text."


class Lister:
    """A deterministic stand-in for a model that lists facts: a line for each sentence, between two lines of talk."""

    def generate(self, prompts: list[str]) -> list[str]:
        return ["Here are the facts:\n" + "".join(f"- {s.strip()}\n" for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()) + "\nThat is all." for p in prompts]


class Comparer:
    """A deterministic stand-in for a judge that answers in JSON, which it leaves open where it has much to say: the label
    and the first three words of one letter or more that the second text has lost."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.reply(*p.split("\nSecond: ", 1)) for p in prompts]

    def reply(self, first: str, second: str = "") -> str:
        one, two = (list(dict.fromkeys(re.findall(r"[a-z]+", t.lower()))) for t in (first.removeprefix("First: "), second))
        lost = [w for w in one if w not in set(two)]
        label = "same" if not lost else "partial" if len(lost) < len(one) else "different"
        items = ", ".join(f'"{w}"' for w in lost[:3])
        return f'{{"label": "{label}", "lost": [{items}' if len(lost) >= 3 else f'Here it is: {{"label": "{label.upper()}", "lost": [{items}]}}'
