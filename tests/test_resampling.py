"""Resamples draw as many clusters as there are, each alike, and are the same whatever the ranges."""

import numpy as np
import pandas as pd
import pytest
from palimpsest.operators import resampling


def test_counts_sum_to_the_clusters(spark):
    df = spark.createDataFrame([(k, q, 1.0, float(q)) for k, n in (("a", 700), ("b", 40), ("c", 1)) for q in range(n)], "kind string, cluster long, c double, s double")
    for size in (16, 2048):  # many ranges on two levels of splits' sizes, and one
        got = resampling.resampled_sums(df.repartition(5), ["c", "s"], 50, 3, ["kind"], range_size=size).collect()
        want = {"a": 700, "b": 40, "c": 1}
        assert len(got) == 150 and all(r.n_drawn == r.c == want[r.kind] for r in got)
        again = resampling.resampled_sums(df.repartition(2), ["c", "s"], 50, 3, ["kind"], range_size=size).collect()
        assert {(r.kind, r.b): r.s for r in got} == pytest.approx({(r.kind, r.b): r.s for r in again})


@pytest.mark.parametrize("size", [8, 2048])
def test_spread_of_means(spark, size):
    """The means of resamples spread by s / sqrt(K), as of K draws with replacement."""
    values = np.random.default_rng(5).normal(size=300)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "cluster long, s double")
    means = np.array([r.s / r.n_drawn for r in resampling.resampled_sums(df, ["s"], 2000, 11, range_size=size).collect()])
    assert means.mean() == pytest.approx(values.mean(), abs=4 * values.std() / np.sqrt(300 * 2000))
    assert means.std() == pytest.approx(values.std() / np.sqrt(300), rel=0.08)


def test_splits_and_picks():
    rng = np.random.default_rng(0)
    found = resampling.split(rng, np.full(4000, 60), np.array([1, 2, 3]))
    assert (found.sum(0) == 60).all() and found.mean(1) == pytest.approx([10, 20, 30], abs=0.5)
    assert found.var(1) == pytest.approx([60 * p * (1 - p) for p in (1 / 6, 1 / 3, 1 / 2)], rel=0.12)
    counts = np.bincount(np.concatenate([resampling.picks(1, 0, b, 50, 50) for b in range(4000)]), minlength=50)
    assert len(counts) == 50 and ((counts - 4000) ** 2 / 4000).sum() < 95


def test_draws_are_those_of_the_sql_beyond_one_range(spark, monkeypatch):
    """Of any number of clusters, in ranges of 64 and of 2048, with counts held in parts and in one."""
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(kind, f"q{q}", 1.0, float(rng.normal())) for kind, n in (("a", 5000), ("b", 130), ("c", 1), (None, 130)) for q in range(n)]
    k = pd.DataFrame(rows, columns=["kind", "cluster", "c", "s"])  # noqa: F841
    want = duckdb.sql(f"WITH {resampling.resampled_sql('k', ['c', 's'], 20, 9, ['kind'])} SELECT kind, b, n_drawn, c, s FROM rs").fetchall()
    df = spark.createDataFrame(rows, "kind string, cluster string, c double, s double").repartition(3)
    for size, held, a_task in ((64, 1024, 1000), (resampling.RANGE, 1 << 24, 1 << 16)):
        monkeypatch.setattr(resampling, "HELD", held)
        monkeypatch.setattr(resampling, "ROWS_A_TASK", a_task)
        got = {(r.kind, r.b): (r.n_drawn, r.c, r.s) for r in resampling.resampled_sums(df, ["c", "s"], 20, 9, ["kind"], range_size=size).collect()}
        assert got.keys() == {w[:2] for w in want} and all(got[w[:2]] == pytest.approx(w[2:], abs=1e-9) for w in want)


def test_counts_by_parts(monkeypatch):
    """Draws hashed in parts, for some of the places, and counts that a byte can't hold."""
    want = np.bincount(resampling.picks(3, 0, 5, 5000, 5000), minlength=5000)
    monkeypatch.setattr(resampling, "AT_ONCE", 700)
    assert (resampling.times_picked(3, 5, 5000, 0, 5000) == want).all() and (resampling.times_picked(3, 5, 5000, 1024, 2048) == want[1024:2048]).all()
    for times in (want, want * 300):
        assert (resampling.unpacked(resampling.packed(times), 5000) == times).all()


def test_what_is_summed_up_is_made_once(spark):
    """The rows may come from a long plan, which the count of clusters does not run again."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("id AS cluster", "1.0D AS s").mapInArrow(run, "cluster long, s double")
    assert resampling.resampled_sums(df, ["s"], 3, 1).count() == 3 and made.value == 100


def test_empty_and_null_clusters(spark):
    df = spark.createDataFrame([(None, 1.0)], "cluster long, s double")
    assert resampling.resampled_sums(df, ["s"], 3, 1).count() == 0
