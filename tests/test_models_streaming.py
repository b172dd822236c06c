"""The model interface with its stand-in, and incremental scoring of arriving files."""

import oracle
import pytest
from pyspark.sql import functions as F

from palimpsest import models
from palimpsest.jobs import model_jobs
from palimpsest.streaming.incremental import score_stream


def test_chains_of_the_stand_in(spark):
    plan = spark.createDataFrame([("a", "one two three four five six seven eight nine ten " * 4), ("b", ""), ("c", None)], "qid string, text string")
    out = models.run_chains(plan, models.Shortener, 3).orderBy("qid", "step").collect()
    assert len(out) == 12 and [r.step for r in out[:4]] == [0, 1, 2, 3]
    assert len(out[1].text.split()) < 40 and out[1].text == models.Shortener().generate([out[0].text])[0]


def test_self_refine_keeps_the_feedback(spark):
    class Echo:
        def generate(self, prompts):
            return [p.replace("\n", "/") for p in prompts]

    out = models.self_refine(spark.createDataFrame([("a", "x")], "qid string, text string"), Echo, 2).orderBy("step").collect()
    assert [r.draft_text for r in out[:2]] == [None, "Rewrite: x"] and out[0].text == "x" and out[0].critic_feedback is None
    assert out[1].critic_feedback == "Source: x/Draft: Rewrite: x/Earlier: "
    assert out[1].text == f"Draft: Rewrite: x/Feedback: {out[1].critic_feedback}"
    assert out[2].draft_text == f"Rewrite: {out[1].text}" and out[2].critic_feedback.endswith(f"Earlier: {out[1].critic_feedback}")


def test_refined_chains_against_a_loop(spark):
    ask = lambda p: models.Shortener().generate([p])[0]
    want = set()
    for t in spark.read.parquet(f"{oracle.SF_DIR}/conversations.parquet").select("conv_id", "turn", "text").collect():
        text, history = t.text or "", []
        want.add((t.conv_id, t.turn, 0, text, None, None))
        for k in range(1, model_jobs.STEPS + 1):
            draft = ask(f"Rewrite: {text}")
            history.append(ask(f"Source: {text}\nDraft: {draft}\nEarlier: {'; '.join(history)}"))
            text = ask(f"Draft: {draft}\nFeedback: {history[-1]}")
            want.add((t.conv_id, t.turn, k, text, draft, history[-1]))
    assert set(map(tuple, model_jobs.refined_chains(spark, oracle.SF_DIR).collect())) == want


def test_facts_and_their_labels(spark):
    class Lister:
        def generate(self, prompts):
            return ["Facts:\n" + "\n".join(f"- {s.strip()}" for s in p.split(".") if s.strip()) for p in prompts]

    class Reader:
        def generate(self, prompts):
            return [str(p.split("Claim: ")[1].split("\n")[0].rstrip(".") in p.split("Claim: ")[0]) for p in prompts]

    facts = models.listed_facts(spark.createDataFrame([(1, "One. Two"), (2, ""), (3, None)], "k int, text string"), Lister)
    assert sorted(map(tuple, facts.collect())) == [(1, "One."), (1, "Two.")]
    asked = spark.createDataFrame([(1, "One and three", "t", "One."), (2, "One", None, "Two.")], "k int, source string, topic string, fact string")
    assert {r.k: r.label for r in models.judged_facts(asked, Reader).collect()} == {1: "SUPPORTED", 2: "NOT_SUPPORTED"}


def test_retries():
    class Failing:
        def __init__(self, errors):
            self.errors = errors

        def generate(self, prompts):
            if self.errors:
                raise self.errors.pop(0)
            return prompts

    waits = []
    assert models.Retrying(Failing([OSError(), OSError()]), wait=waits.append).generate(["a"]) == ["a"] and waits == [1, 2]
    for errors, kind, n in (([ValueError()], ValueError, 2), ([OSError()] * 3, OSError, 4)):
        with pytest.raises(kind):
            models.Retrying(Failing(errors), tries=3, wait=waits.append).generate(["a"])
        assert len(waits) == n


def test_prompts_side_by_side(spark):
    plan = spark.createDataFrame([("a", "one two three")], "qid string, text string")
    out = models.compare_prompts(plan, models.Shortener, {"plain": lambda c: c, "system": lambda c: F.concat(F.lit("Be brief. "), c)})
    assert {(r.prompt, r.step) for r in out.collect()} == {("plain", 0), ("plain", 1), ("system", 0), ("system", 1)}


def test_incremental_scoring(spark, tmp_path):
    src, dst = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(1, "a b"), (2, "c")], [(2, "c"), (3, "d e f")]):
        spark.createDataFrame(rows, "k int, text string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, text string").parquet(src)
        score_stream(stream, lambda df: df.select("k", F.size(F.split("text", " ")).alias("n")), ["k"], dst, f"{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(dst).collect()} == {(1, 2), (2, 1), (3, 3)} and spark.read.parquet(dst).count() == 3


def test_refining_takes_one_worker_a_task(spark, monkeypatch):
    """All calls of the model are made by one Python worker, a few rows at a time; before, each of the six had a worker of its own."""
    texts = [("x" * n if n else None) for n in (0, 5, 900, 900, 2000, 10, *[1] * 200)]
    plan = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    class Echo:
        def generate(self, prompts):
            sizes.add(len(prompts) > models.ROWS_AT_ONCE)
            return [p[:50] for p in prompts]

    out = models.self_refine(plan, Echo, 2)
    said = out._jdf.queryExecution().executedPlan().toString()
    assert said.count("MapInArrow") == 1 and "ArrowEvalPython" not in said
    rows = out.collect()
    assert len(rows) == 3 * len(texts) and {(r.k, r.text) for r in rows if r.step == 0} == {(k, t or "") for k, t in enumerate(texts)} and sizes.value == 0
    assert models.self_refine(plan.limit(0), Echo, 2).count() == 0
