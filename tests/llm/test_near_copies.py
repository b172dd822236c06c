"""The pipeline's near-copy stage against all pairs compared."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import simhash


def words_of(n, rng):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def edited(words, n, rng):
    out = list(words)
    for at, w in zip(rng.choice(len(out), n, replace=False), words_of(n, rng), strict=True):
        out[at] = w
    return out


def kept_of_all_pairs(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    forest = simhash.Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                forest.join(j, i)
    first = {}
    for k in range(len(sets)):
        first.setdefault(forest.root(k), k)
    return set(first.values())


def frame(spark, texts):
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")


def kept(spark, texts, drop=simhash.drop_near_copies, **params):
    return {r.doc_id for r in drop(frame(spark, texts), **params).collect()}


def variants(rng):
    template = words_of(400, rng)
    some = [edited(template, 12, rng) for _ in range(120)]
    return [edited(v, n, rng) for v in some for n in (0, 4, 9, 12)]


def test_dense_group(spark):
    texts = variants(np.random.default_rng(1))
    want = kept_of_all_pairs(texts)
    assert 1 < len(want) < len(texts)
    assert kept(spark, texts) == want


def test_large_buckets(spark):
    from palimpsest.llm import near_copies

    texts = variants(np.random.default_rng(4))[:200]
    more = words_of(100, np.random.default_rng(5))
    texts += [edited(more, 1, np.random.default_rng(k)) for k in range(60)]
    assert kept(spark, texts, near_copies.drop_near_copies, block=8) == kept_of_all_pairs(texts)


def test_every_two_components_meet(spark):
    from palimpsest.llm import links

    label = {k: 0 if k < 50 else 1 if k < 70 else k for k in range(100)}
    placed = spark.createDataFrame([(7, 100, k, v) for k, v in label.items()], "bucket long, n long, key long, label long")
    met = [[m.key for m in r.members] for r in links.crossed(placed, 16).collect()]
    pairs = {(a, b) for m in met for a in m for b in m if a < b}
    assert {(a, b) for a in label for b in label if a < b and label[a] != label[b]} <= pairs
    assert sum(map(len, met)) < 100 * 20 and max(map(len, met)) <= 40


def test_pipeline_stage_links_by_fingerprints(spark):
    """Every link of op8 counts in the pipeline, besides those by shingles. Before: no fingerprints."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    phrase, base = words_of(8, rng), words_of(300, rng)
    texts = [phrase * 60 + words_of(12, rng) for _ in range(4)]  # one fingerprint, few shingles in common
    chain = [edited(base, n, rng) for n in range(0, 40, 2)]
    texts += [*chain, *(edited(w, 9, rng) for w in chain), *(words_of(50, rng) for _ in range(20))]
    fps = [simhash.fingerprint(simhash.shingle_hashes(" ".join(w), 3)) for w in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    forest = simhash.Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                forest.join(j, i)
    first = {}
    for k in range(len(texts)):
        first.setdefault(forest.root(k), k)
    assert len(first) < len(kept_of_all_pairs(texts)) < len(texts)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, texts), "").collect()}
    assert got == set(first.values())


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "One  two", "x"), (None, "one two", "x")], "doc_id long, text string, key string")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {1, 4, None}
    assert simhash.drop_near_copies(df.where(F.col("doc_id") > 9)).count() == 0


def test_short_texts_of_one_edit(spark):
    rng = np.random.default_rng(2)
    base = [words_of(60, rng) for _ in range(150)]
    texts = [*base, *(edited(w, 1, rng) for w in base)]
    assert kept(spark, texts) == kept_of_all_pairs(texts) and len(kept_of_all_pairs(texts)) < 160


def test_one_vocabulary_in_other_orders(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(20):
        a = words_of(80, rng)
        b = [a[k] for k in rng.permutation(80)]
        texts += [a, b, [*b[:-2], b[-1], b[-2]]]
    assert kept(spark, texts) == kept_of_all_pairs(texts) == {k for k in range(60) if k % 3 < 2}
