"""Exact deduplication with one filter and with many."""

import collections
import random

import pytest
from palimpsest.llm import exact_dedup


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(k, f"text {rng.randrange(30_000)}", k) for k in range(20_000)] + [(20_000 + k, "hot  copy", k) for k in range(4000)] + [(None, "hot copy", 1), (5, None, 2), (5, "", 3), (7, "hot\tcopy", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, filter_part int").repartition(6)


def test_many_filters_give_the_rows_of_one(docs):
    """96 KB of filter in parts of 16 KB."""
    assert exact_dedup.filters_for(docs.count(), 1 << 14) > 5 and exact_dedup.filters_for(docs.count(), 1 << 25) == 1
    want = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=repr)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, filter_bytes=1 << 14).collect()), key=repr) == want
    sizes = collections.Counter(r[4] for r in want)
    assert all(r[2] == sizes[r[4]] for r in want) and max(sizes.values()) == 4002
    kept = sorted(map(tuple, exact_dedup.drop_exact_copies(docs).collect()), key=repr)
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(docs, filter_bytes=1 << 14).collect()), key=repr) == kept and len(kept) == len(sizes)


def test_most_unlike_rows_are_cleared(spark):
    from palimpsest.llm.common import materialize
    from pyspark.sql import functions as F

    rows = materialize(spark.range(50_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    for size in (1 << 25, 1 << 15):
        assert exact_dedup.flag_possible_copies(rows, size).where("maybe").count() < 500
