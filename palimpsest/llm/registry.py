"""Queries of this subpackage for the driver, and the SQL that gives the same rows where there is some."""

from __future__ import annotations

from palimpsest.llm import decontaminate, exact_dedup, langid, merkle, packing, paragraphs, periodic, pii, simhash, suffixes, tokencount, toxicity, url_graph
from palimpsest.llm.common import table


def op1_pii_spans(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark, sf_dir):
    return paragraphs.near_paragraphs(table(spark, sf_dir, "documents"))


def op6_url_graph(spark, sf_dir):
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op8_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op12_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.verification(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_spans": op1_pii_spans,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_url_graph": op6_url_graph,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {
    "op13_merkle_manifest": merkle.oracle_sql(),
    "op10_decontamination": decontaminate.oracle_sql(),
    "op6_url_graph": url_graph.oracle_sql(),
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
}
