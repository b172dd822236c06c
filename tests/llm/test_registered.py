"""The registered queries: those with SQL against it, and the pipeline stage by stage."""

import oracle
import pytest

from palimpsest.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = oracle.both(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline
    from palimpsest.llm import decontaminate, exact_dedup
    from palimpsest.llm.common import table

    docs = table(spark, oracle.SF_DIR, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, oracle.SF_DIR)
        after = [r.doc_id for r in kept.select("doc_id").collect()]
        assert kept.columns == columns and set(after) <= before and len(after) == len(set(after)), name
    assert exact_dedup.exact_groups(kept).where("not kept").count() == 0
    assert decontaminate.contaminated(kept, table(spark, oracle.SF_DIR, "benchmark")).count() == 0
    out = corpus_pipeline.run(spark, oracle.SF_DIR).select("doc_id").distinct()
    assert {r.doc_id for r in out.collect()} == set(after)
