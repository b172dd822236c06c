"""Ranks and quantiles against sorted lists, retrieval against scoring everything."""

import collections
import math

import numpy as np
import pytest
from palimpsest.operators import order_statistics, retrieval


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    out = [("big", float(v)) for v in rng.normal(size=6000)] + [("tied", float(v)) for v in rng.integers(0, 4, 3000)]
    out += [(None, float(v)) for v in rng.exponential(size=17)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0), ("flat", 5.0)] + [("flat", 5.0)] * 9
    return out


def test_ranks(spark, values):
    df = spark.createDataFrame(values, "k string, v double").repartition(6)
    got = {(r.k, r.v): (r.c, r["rank"]) for r in order_statistics.value_ranks(df, ["k"], "v").collect()}
    for k in {k for k, _ in values}:
        own = sorted(v for key, v in values if key == k and v is not None)
        for v, c in collections.Counter(own).items():
            assert got.pop((k, v)) == (c, own.index(v) + (c + 1) / 2)
    assert not got
    whole = order_statistics.value_ranks(df, [], "v").agg({"c": "sum", "rank": "max"}).first()
    assert whole[0] == sum(v is not None for _, v in values)


def test_quantiles(spark, values):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]
    df = spark.createDataFrame(values, "k string, v double").repartition(6)
    got = {r.k: r.q for r in order_statistics.quantiles(df, ["k"], "v", shares).collect()}
    want = {k: [float(np.quantile([v for key, v in values if key == k and v is not None], s)) for s in shares] for k in {k for k, v in values if v is not None}}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-12), k
    some = [v for _, v in values if v is not None]
    assert order_statistics.quantiles(df, [], "v", [0.5]).first().q == pytest.approx([float(np.median(some))])
    assert order_statistics.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_few_rows_are_gathered(spark):
    """Beyond the first pass only what lies in the brackets is kept by value."""
    df = spark.range(200_000).selectExpr("1 AS k", "hash(id) / 1e9 AS v")
    q = order_statistics.quantiles(df, ["k"], "v", [0.5])
    assert q.first().q == pytest.approx([float(np.median([r.v for r in df.select("v").collect()]))], abs=1e-12)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list(v" not in plan


def texts(rng, n, words, vocabulary):
    weights = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(f"t{w}" for w in rng.choice(vocabulary, int(rng.integers(1, words)), p=weights / weights.sum())) for _ in range(n)]


def slow_bm25(queries, demos):
    docs = {d: t.split(" ") for d, t in demos}
    n, avg = len(docs), np.mean([len(t) for t in docs.values()])
    df = collections.Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in queries:
        for d, t in docs.items():
            tf = collections.Counter(t)
            hits = [w for w in text.split(" ") if w in tf]
            if hits:
                out.setdefault(q, []).append((-round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in hits), 6), d))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("top", [1, 3])
def test_retrieval_against_all_pairs(spark, top):
    rng = np.random.default_rng(top)
    demos, queries = list(enumerate(texts(rng, 80, 40, 300))), list(enumerate(texts(rng, 60, 60, 300))) + [(900, "unknown words"), (901, "")]
    d, q = spark.createDataFrame(demos, "did long, text string"), spark.createDataFrame(queries, "qid long, text string")
    got = collections.defaultdict(list)
    for r in retrieval.bm25_top(q, d, top=top).collect():
        got[r.qid].append((r["rank"], -r.score, r.did))
    want = slow_bm25(queries, demos)
    assert {k: [s for _, s, _ in sorted(v)] for k, v in got.items()} == {k: pytest.approx([s for s, _ in v[:top]], abs=2e-6) for k, v in want.items()}
    assert sum([x for *_, x in sorted(got[k])] == [x for _, x in v[:top]] for k, v in want.items()) >= len(want) - 1  # a tie in the sixth digit


@pytest.mark.parametrize("held", [0, 32_000_000])
def test_retrieval_of_either_index(spark, monkeypatch, held):
    """Joined or held by the workers: equal demos, a token in half of them, a query in two rows, null texts."""
    monkeypatch.setattr(retrieval, "HELD_BYTES", held)
    rng = np.random.default_rng(7)
    demos = list(enumerate(texts(rng, 40, 30, 200))) + [(100, "same same text"), (101, "same same text")]
    demos = [(k, t + (" half" if k % 2 else "")) for k, t in demos[:-2]] + demos[-2:] + [(102, "half"), (103, "half x"), (104, ""), (105, None)]
    queries = list(enumerate(texts(rng, 30, 50, 200))) + [(500, "same text"), (501, "half"), (502, "zzz"), (503, ""), (504, None)]
    d, q = spark.createDataFrame(demos, "did long, text string"), spark.createDataFrame(queries + [(7, "same"), (None, "text")], "qid long, text string").repartition(3)
    want = slow_bm25([(k, (t or "") + (" same" if k == 7 else "")) for k, t in queries] + [(None, "text")], [(k, t or "") for k, t in demos])
    got = {(r.qid, r["rank"]): (r.did, r.score) for r in retrieval.bm25_top(q, d, top=2).collect() if held or r.qid is not None}
    for k, v in want.items():
        for n, (s, x) in enumerate(v[:2]):
            if held or k is not None:
                assert got.pop((k, n + 1)) == (x, pytest.approx(-s, abs=2e-6)), (k, n)
    assert not got


def test_queries_are_not_shuffled_by_token(spark):
    """The demos of the query at hand are few: no shuffle below its rows, whatever the queries' tokens."""
    q, d = spark.createDataFrame([(k, "a b c") for k in range(50)], "qid long, text string"), spark.createDataFrame([(k, f"a b{k}") for k in range(5)], "did long, text string")
    plan = retrieval.bm25_top(q, d)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_joined_rows_do_not_follow_common_tokens(spark):
    """Twice the demos that share only common tokens with the queries hardly add rows."""
    rng, joined = np.random.default_rng(5), []
    queries = [(k, f"rare{k} " + " ".join(f"c{w}" for w in rng.integers(0, 30, 4))) for k in range(50)]
    for n in (300, 600):
        demos = [(k, (f"rare{k} rare{k} " if k < 50 else "") + " ".join(f"c{w}" for w in rng.integers(0, 30, 14))) for k in range(n)]
        d, q = spark.createDataFrame(demos, "did long, text string"), spark.createDataFrame(queries, "qid long, text string")
        rows, left = retrieval.proposed(retrieval.asked_tokens(q), retrieval.index(d))
        every = retrieval.asked_tokens(q).join(retrieval.index(d), "token").count()
        joined.append(rows.count())
        assert joined[-1] < every / 4 and left.select("qid").distinct().count() == 50
    assert joined[1] < 1.6 * joined[0]
