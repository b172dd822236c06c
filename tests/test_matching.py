"""Greedy token matching against matrices of whole texts."""

import numpy as np
import oracle
import pytest
from palimpsest.jobs import text_jobs
from palimpsest.operators import matching


def test_steps_against_whole_matrices(spark):
    rng = np.random.default_rng(1)
    texts = {(q, s): rng.normal(size=(int(rng.integers(1, 12)), 5)) for q in range(6) for s in range(4) if (q, s) not in {(1, 0), (2, 2)}}
    texts[(3, 1)][0] = 0  # a vector without direction is like no other
    rows = [(q, s, k, v.tolist()) for (q, s), m in texts.items() for k, v in enumerate(m)] + [(9, 1, 0, None)]
    df = spark.createDataFrame(rows, "qid int, step int, pos int, vector array<double>")

    def scores(a, b):
        if a is None or b is None:
            return (None,) * 3
        unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
        c = unit(a) @ unit(b).T
        p, r = c.max(1).mean(), c.max(0).mean()
        return p, r, 2 * p * r / (p + r) if p + r else 0.0

    got = {(r.qid, r.step): tuple(r)[2:] for r in matching.step_matching(df, ["qid"], block=4).collect()}
    want = {k: (*scores(m, texts.get((k[0], 0))), *scores(m, texts.get((k[0], k[1] - 1)))) for k, m in texts.items() if k[1] > 0}
    want[(9, 1)] = (None,) * 6
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-12), k
    assert matching.step_matching(df.limit(0), ["qid"]).count() == 0


def test_blocks_are_bounded(spark):
    df = spark.createDataFrame([(1, k, [1.0, float(k)]) for k in range(1000)], "qid int, pos int, vector array<double>")
    sizes = [len(r.vectors) for r in matching.token_blocks(df, ["qid"], block=64).collect()]
    assert sum(sizes) == 1000 and max(sizes) == 64
    same = matching.matched(df, df, ["qid"], 64).first()
    assert (same.precision, same.recall, same.f1) == pytest.approx((1, 1, 1))


def test_numbered_tokens_as_vectors(spark):
    """Texts of vector numbers give what their vectors give, however they are dealt to buckets; a vector goes to a bucket once."""
    rng = np.random.default_rng(2)
    table = [(k, rng.normal(size=5).tolist()) for k in range(30)] + [(30, [0.0] * 5), (31, None)]  # 32 to 34 have no row
    chains = [(q, s) for q in range(5) for s in range(40) if (q, s) not in {(1, 0), (2, 15), (3, 16)}]
    turns = [(f"q{q}", s, rng.integers(0, 35, int(rng.integers(0, 9))).tolist()) for q, s in chains] + [("long", s, rng.integers(0, 35, 3000).tolist()) for s in (0, 1)] + [("bare", 0, [1]), ("bare", 1, [31, 33])]
    vectors, numbered = spark.createDataFrame(table, "number long, vector array<float>"), spark.createDataFrame(turns, "qid string, step int, numbers array<long>").repartition(3)
    known = {k: v for k, v in spark.createDataFrame(table, "number long, vector array<float>").collect() if v is not None}
    rows = [(q, s, p, known.get(n)) for q, s, ns in turns for p, n in enumerate(ns)]
    want = {(r.qid, r.step): tuple(r)[2:] for r in matching.step_matching(spark.createDataFrame(rows, "qid string, step int, pos int, vector array<double>"), ["qid"]).collect()}
    for stretch, per_vector in ((16, 16), (4, 1), (1, 100)):
        found = matching.numbered_matching(numbered, vectors, ["qid"], stretch=stretch, per_vector=per_vector)
        got = {(r.qid, r.step): tuple(r)[2:] for r in found.collect()}
        assert got.keys() == want.keys() and got[("bare", 1)] == (None,) * 6
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=1e-9), k
    assert matching.numbered_matching(numbered.limit(0), vectors, ["qid"]).count() == 0
    assert all(v is None for r in matching.numbered_matching(numbered, vectors.limit(0), ["qid"]).collect() for v in tuple(r)[2:])


def test_vectors_are_not_shuffled_by_token(spark):
    """The query's shuffles stay near the size of its texts; with a vector a token they took 14 MB here."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    assert text_jobs.token_matching(spark, oracle.SF_DIR).count()
    assert written() - before < 2_000_000
