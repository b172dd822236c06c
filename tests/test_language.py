"""The language model's probabilities and losses, and sentences of hand-made cases."""

import collections
import math
import random

import pytest
from palimpsest.operators import ngram, sentences

LESSON = ["the cat sat on the mat", "the cat ran", "a dog sat on a cat", ""]


def words_frame(spark, texts):
    return spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "k int, words array<string>")


def test_probabilities_sum_to_one(spark):
    model = ngram.train(words_frame(spark, LESSON))
    vocabulary = [r.w for r in model.one.collect()]
    contexts = [(None, None), (None, "the"), ("the", "cat"), ("x", "cat"), ("x", "y"), ("sat", "on")]
    asked = spark.createDataFrame([(i, *c, w) for i, c in enumerate(contexts) for w in [*vocabulary, "unseen"]], "i int, u string, v string, w string")
    total = collections.Counter()
    for r in ngram.probabilities(asked, model).collect():
        assert 0 < r.p < 1
        total[r.i] += r.p
    assert all(total[i] == pytest.approx(1) for i in range(len(contexts)))


def test_losses_against_a_loop(spark):
    three, two, one = collections.Counter(), collections.Counter(), collections.Counter()
    for t in LESSON:
        w = t.split()
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))

    def p(context, word):
        if not context:
            return (one[word] + 1) / (sum(one.values()) + len(one) + 1)
        own = {k[-1]: n for k, n in (three if len(context) == 2 else two).items() if k[:-1] == context}
        lower = p(context[1:], word)
        return lower if not own else (max(own.get(word, 0) - 0.75, 0) + 0.75 * len(own) * lower) / sum(own.values())

    texts = ["the cat sat", "a mat", "new words only here", "the", "", " ".join(["the cat sat on a dog"] * 9)]
    model = ngram.train(words_frame(spark, LESSON))
    got = {r.k: r for r in ngram.perplexity(ngram.window_losses(words_frame(spark, texts), ["k"], model, 16, 8), ["k"]).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        if not w:
            assert k not in got
            continue
        loss = -sum(math.log(p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(len(w)))
        assert got[k].loss == pytest.approx(loss) and got[k].n == len(w) and got[k].perplexity == pytest.approx(math.exp(loss / len(w)))
        assert got[k].windows == 1 + max(0, math.ceil((len(w) - 16) / 8))
    assert ngram.train(words_frame(spark, [])).words == 0


def test_sentences_of_a_taught_corpus(spark):
    lesson = [f"Mr. Gray met Dr. Brown at {k} o'clock. The house stood still. The rain fell on Gray. It was cold, e.g. on the hill." for k in range(60)]
    lesson += [f"A brown fox of {k} years saw the house. The hill was still and cold. It stood by the rain." for k in range(60)]
    taught = spark.createDataFrame([(t,) for t in lesson], "text string")
    known = {r.type for r in sentences.abbreviations(sentences.tokens(taught, [])).collect()}
    assert {"mr", "dr", "e.g"} <= known and not known & {"still", "cold", "hill", "rain", "house", "clock"}
    rows = sentences.tokens(taught, [])
    assert {"the", "it"} <= {r.type for r in sentences.starters(rows, sentences.abbreviations(rows)).collect()}
    cases = {
        1: ("Mr. Gray stood. The rain fell! Was it cold? It was.", ["Mr. Gray stood.", "The rain fell!", "Was it cold?", "It was."]),
        2: ("He saw J. R. Brown, e.g. on the hill. Still.", ["He saw J. R. Brown, e.g. on the hill. Still."]),
        3: ("A line\nand one more. \n\nlast one", ["A line", "and one more.", "last one"]),
        4: ("", None),
        5: ("He said \"it fell.\" The end came", ['He said "it fell."', "The end came"]),
        6: ("It was Mr. The end came.", ["It was Mr.", "The end came."]),
    }
    texts = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()] + [(7, None)], "k int, text string")
    got = {r.k: r.sentences for r in sentences.split(texts, ["k"], taught=taught).collect()}
    assert got == {k: s for k, (_, s) in cases.items() if s}


def test_split_where_read_and_by_joins(spark, monkeypatch):
    """Lists held by the workers give what joins give: odd spaces and signs, empty lines, texts in two rows, slices of texts."""
    rng = random.Random(3)
    words = ["Mr.", "(Dr.", "e.g.", "The", "the", "It", "cold.", 'said."', "A.", "...", "so...", "What?!", "x.)", "Élan", "zu.", "12.", ".", '"', "It.", " ", "end."]
    lesson = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(30)) + ". The Mr. Gray sat. It was",) for _ in range(80)], "text string")
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t", " \n ", "\x0b"]) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    df = spark.createDataFrame([*texts, (200, None), (201, " \n "), (202, "One. two"), (202, "Mr. Three")], "k int, text string").repartition(3)
    monkeypatch.setattr(sentences, "HELD_BYTES", 0)
    want = sorted((r.k, r.sentences) for r in sentences.split(df, ["k"], taught=lesson).collect() if r.k != 202)
    monkeypatch.undo()
    found = sentences.split(df, ["k"], taught=lesson).collect()
    assert sorted((r.k, r.sentences) for r in found if r.k != 202) == want and len(want) > 100 and [r.k for r in found].count(202) == 1


def test_sentences_are_not_shuffled(spark):
    """The words of a text stay where the text is read; before, each was shuffled and then gathered by text."""
    df = spark.createDataFrame([(k, "The cat sat. It ran.") for k in range(50)], "k int, text string")
    plan = sentences.split(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_starters_shuffle_counts_only(spark):
    """What is shuffled follows the different words of a task; before, every word met the abbreviations by a shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    texts = spark.createDataFrame([(f"The cat sat. It ran to Mr. Gray, e.g. on the hill no. {k % 9}.",) for k in range(2000)], "text string").repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, rows = written(), sentences.tokens(texts, [])
        sentences.starters(rows, sentences.abbreviations(rows)).collect()
        assert written() - before < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
