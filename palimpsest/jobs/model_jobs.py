"""Queries on the interface of models, with the stand-in for the model, and the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import models
from palimpsest.functions import labels, text
from palimpsest.sources.adapters import table

STEPS = 2


def _shortened(sql: str) -> str:
    """The reply of ``models.Shortener`` in SQL."""
    words = f"list_filter(string_split_regex({sql}, '\\s+'), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w, k: CAST('0x' || substr(md5(CAST(k - 1 AS VARCHAR) || w), 1, 2) AS INTEGER) % 10 <> 0)"
    return f"array_to_string({kept}, ' ')"


def rewrite_chains(spark, sf_dir):
    """Each document rewritten again and again, a row per step (UD1, UD2, SO6)."""
    return models.run_chains(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), models.Shortener, STEPS)


_CHAIN = ", ".join([f"e{k} AS MATERIALIZED (SELECT doc_id, {_shortened('text')} AS text FROM e{k - 1})" for k in range(1, STEPS + 1)])
REWRITE_CHAINS = f"""WITH e0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_CHAIN}
{' UNION ALL '.join(f'SELECT doc_id, CAST({k} AS INTEGER) AS step, text FROM e{k}' for k in range(STEPS + 1))}"""


def refined_chains(spark, sf_dir):
    """Each turn rewritten with a draft, a critic that knows the earlier feedback, and a refined text in each step (UD3).

    Its SQL was too slow, so a test compares it with a plain loop.
    """
    return models.self_refine(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), models.Shortener, STEPS)


def fact_survival(spark, sf_dir):
    """SURVIVED, LOST and ERROR by event type, as a judge's replies say (MT9). Stand-ins: the replies are made of the event's number."""
    said = F.element_at(F.array(*map(F.lit, ("True", "false.", "True, not false", "Unsure", None))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_type", labels.survival(said).alias("label"))
    return e.groupBy("event_type").agg(*[F.count_if(F.col("label") == n).alias(f"n_{n.lower()}") for n in ("SURVIVED", "LOST", "ERROR")])


FACT_SURVIVAL = """SELECT event_type, count(*) FILTER (WHERE event_id % 5 IN (0, 2, 3)) AS n_survived, count(*) FILTER (WHERE event_id % 5 = 1) AS n_lost,
count(*) FILTER (WHERE event_id % 5 = 4) AS n_error FROM events GROUP BY event_type"""


def alias_lists(spark, sf_dir):
    """Alias lists of joined cells, the gold answer first where it is missing (SC8). Stand-ins: a part's names."""
    p = table(spark, sf_dir, "part")
    found = text.aliases(F.concat(F.lit(" "), F.col("p_type"), F.lit("|| ||"), F.col("p_brand"), F.lit(" ||")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise(F.col("p_name")))
    return p.select("p_partkey", F.size(found).alias("n"), F.concat_ws(";", found).alias("aliases"))


ALIAS_LISTS = """SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 > 0 OR p_name IN (p_type, p_brand) THEN 2 ELSE 3 END AS INTEGER) AS n,
CASE WHEN p_partkey % 3 > 0 OR p_name IN (p_type, p_brand) THEN '' ELSE p_name || ';' END || p_type || ';' || p_brand AS aliases FROM part"""


JOBS = {
    "rewrite_chains": (rewrite_chains, REWRITE_CHAINS), "refined_chains": (refined_chains, None), "fact_survival": (fact_survival, FACT_SURVIVAL), "alias_lists": (alias_lists, ALIAS_LISTS),
}
