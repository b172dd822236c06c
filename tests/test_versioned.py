"""The versioned table: upserts in place, death between write and swap, two writers, parts merged once."""

import pytest
from palimpsest.sources.versioned import Overtaken, VersionedTable, score_into


def rows_of(t):
    return {tuple(r) for r in t.read().collect()}


def test_upsert_in_place_and_vacuum(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.entry() is None
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert rows_of(t) == {(1, "a"), (2, "c"), (3, "d")}
    t.replace(t.read().where("k > 1"), t.entry())  # reads and replaces the same table
    assert rows_of(t) == {(2, "c"), (3, "d")} and t.entry().number == 2
    assert t.vacuum() == 2 and rows_of(t) == {(2, "c"), (3, "d")}


def test_death_between_write_and_swap(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    work = spark.createDataFrame([(k, f"w {k}") for k in range(12)], "k int, text string")
    parts = {f"p{n}": work.where(f"k % 3 = {n}") for n in range(3)}
    seen = []

    def score(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.selectExpr("k", "length(text) AS score")

    plain, died = VersionedTable._swap, []

    def swap(self, number, folder, done):
        if number == 1 and not died:
            died.append(folder)
            raise RuntimeError("killed")
        plain(self, number, folder, done)

    monkeypatch.setattr(VersionedTable, "_swap", swap)
    with pytest.raises(RuntimeError, match="killed"):
        score_into(t, work, ["k"], score, parts)
    assert t.read().count() == 4 and t.entry().parts == ["p0"]  # the dead run's folder is there, and nothing names it
    assert score_into(t, work, ["k"], score, parts) == 2
    assert sorted(r.k for r in t.read().collect()) == list(range(12)) and seen == [[0, 3, 6, 9], [1, 4, 7, 10], [1, 4, 7, 10], [2, 5, 8, 11]]
    assert score_into(t, work, ["k"], score, parts) == 0 and not t.merge(parts["p1"].selectExpr("k", "0 AS score"), ["k"], "p1")
    assert t.vacuum() == 3


def test_two_writers(spark, tmp_path):
    one, two = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.merge(spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    seen = two.entry()
    one.merge(spark.createDataFrame([(2, "b")], "k int, v string"), ["k"])
    with pytest.raises(Overtaken):
        two.replace(spark.createDataFrame([(9, "z")], "k int, v string"), seen)
    two.merge(spark.createDataFrame([(9, "z")], "k int, v string"), ["k"])
    assert rows_of(one) == {(1, "a"), (2, "b"), (9, "z")}


def test_without_parts_only_new_keys_are_scored(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    score = lambda df: df.selectExpr("k", "k * 2 AS score")
    score_into(t, spark.createDataFrame([(1,), (2,)], "k int"), ["k"], score)
    score_into(t, spark.createDataFrame([(2,), (3,)], "k int"), ["k"], lambda df: df.selectExpr("k", "-1 AS score"))
    assert rows_of(t) == {(1, 2), (2, 4), (3, -1)}
