"""Large buckets: rows in proportion to their classes, and no link lost."""

import numpy as np
import pytest
from palimpsest.llm import links


def banded_of(spark, keys):
    return spark.createDataFrame([(k, 0, 1) for k in keys], "key long, band int, hash long")


def sets_of(spark, sets):
    df = spark.createDataFrame([(k, [int(v) for v in s]) for k, s in sets.items()], "key long, sh array<long>")
    return lambda met: df.join(met, "key")


def counted(monkeypatch):
    rows, plain = [], links.verified

    def run(blocks, sets, similarity):
        rows.append(blocks.selectExpr("sum(size(members))").first()[0] or 0)
        return plain(blocks, sets, similarity)

    monkeypatch.setattr(links, "verified", run)
    return rows


def test_unlike_classes_of_one_bucket(spark, monkeypatch):
    """Classes that share a band and half of their shingles make rows in proportion."""
    rng, made = np.random.default_rng(1), []
    for n in (300, 1500):
        common = np.arange(30)
        sets = {k: np.sort(np.concatenate([common, 1000 + rng.choice(1 << 40, 30, replace=False)])) for k in range(n)}
        rows = counted(monkeypatch)
        labels = links.similar_components(banded_of(spark, sets), sets_of(spark, sets), 0.8, block=32)
        monkeypatch.undo()
        assert labels is None or labels.groupBy("label").count().where("count > 1").count() == 0
        made.append(sum(rows))
    a_class = made[0] / 300, made[1] / 1500  # all blocks meeting would take five times as many rows a class
    assert a_class[1] <= 1.5 * a_class[0] and max(a_class) <= 4


def test_pairs_in_a_large_bucket(spark):
    """Pairs at a similarity just above the threshold, all in one bucket, are found."""
    rng, sets = np.random.default_rng(2), {}
    for k in range(0, 600, 2):
        base = np.sort(rng.choice(1 << 40, 60, replace=False))
        sets[k], sets[k + 1] = base, np.sort(np.concatenate([base[6:], rng.choice(1 << 40, 6, replace=False)]))  # 54 of 66
    labels = links.similar_components(banded_of(spark, sets), sets_of(spark, sets), 0.8, block=32)
    own = {r.node: r.label for r in labels.collect()}
    found = sum(own.get(k, -1) == own.get(k + 1, -2) for k in range(0, 600, 2))
    assert found == 300 and len(set(own.values())) == 300


@pytest.mark.parametrize("n", [200])
def test_one_component_of_copies(spark, monkeypatch, n):
    """A chain in which only neighbours are similar stays one component."""
    sets = {k: np.arange(k, k + 40) for k in range(n)}  # 38 of 42 at a distance of two
    labels = links.similar_components(banded_of(spark, sets), sets_of(spark, sets), 0.8, block=16)
    assert len({r.label for r in labels.collect()}) == 1
