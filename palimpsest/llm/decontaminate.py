"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents are partitioned by size class (powers of two of their shingle count). Within a class every document
gets a one-permutation MinHash signature: the hash range is cut into bins in proportion to the class size and
the least shingle hash of each bin is kept. A short item shares a bin minimum with a long document that holds
it with a chance that depends on bins per shingle alone, and that ratio is tuned so that a pair at the
containment threshold is missed less than once in a million. Items that have fewer than ``LOOKED_UP`` shingles to
share at the threshold are too short for that: all shingles of all documents are looked up among theirs, and no
pair is missed. Pairs that share a hash are candidates; each is then verified by exact containment of word
shingles. Everything is built-in DataFrame functions.

Defined cases: words are runs of letters and digits of the lower-cased text; a text of fewer words than a
shingle has one shingle, all its words; null or wordless texts (of either side) have none and match nothing;
rows whose doc_id is null are not reported and stay; where a doc_id or item_id repeats, the best pair counts in
:func:`contaminated`, and :func:`drop_contaminated` judges each row by its own text. An empty table of either
side gives no pairs; other columns, whatever their names, are not read, and stay in the stage.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, materialize, row_key, without_rows

WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-6
#: Shared shingles below which minima would be missed too often.
LOOKED_UP = 8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))))


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """A 64-bit hash for each run of ``n`` words; missing words of a short text add nothing."""
    return F.transform(_starts(words, n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def shingle_texts(words: Column, n: int = WORDS) -> Column:
    return F.transform(_starts(words, n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def bin_bits(size: Column, extra: int) -> Column:
    """Bits that name a bin, for a document of so many shingles."""
    return F.least(F.lit(40), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int") + extra)


def extra_bits(smallest_item: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bins per shingle, as a power of two, so that a pair at the threshold shares a minimum almost surely."""
    shared = max(1, math.ceil(containment * smallest_item))
    for extra in range(-6, 7):
        load = 2.0**-extra  # shingles a bin, at most
        if (1 - (1 - math.exp(-load)) / load) ** shared <= miss:
            return extra
    return 6


def signature(hashes: Column, bits: Column) -> Column:
    """The least hash of each bin. ``hashes`` ascend."""
    drop = F.lit(64) - bits
    bin_ = lambda h: F.call_function("shiftright", h, drop)
    return F.filter(hashes, lambda h, i: (i == 0) | (bin_(h) != bin_(F.get(hashes, i - 1))))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of each pair with at least that share of the item's shingles."""
    known = materialize(
        items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("w")).where("size(w) > 0 and item_id is not null")
        .select("item_id", F.array_distinct(shingle_texts(F.col("w"), n)).alias("shingles"), F.array_distinct(shingle_hashes(F.col("w"), n)).alias("hashes"))
    )
    due = F.ceil(F.lit(containment) * F.size("shingles"))
    sizes = known.agg(F.min(F.when(due >= LOOKED_UP, F.size("shingles"))), F.sum(F.size("shingles")), F.sum(F.length(F.array_join("shingles", ""))), F.count_if(due < LOOKED_UP)).first()
    smallest, total, chars, n_short = sizes[0], sizes[1] or 0, sizes[2] or 0, sizes[3]
    small = lambda df, size: F.broadcast(df) if size <= BROADCAST_BYTES else df

    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w")).select("doc_id", F.sort_array(shingle_hashes(F.col("w"), n)).alias("h"))
    met = []
    if smallest:
        minima = hashed.select("doc_id", F.explode(signature(F.col("h"), bin_bits(F.size("h"), extra_bits(smallest, containment)))).alias("hash"))
        met.append(minima.join(small(known.where(due >= LOOKED_UP).select("item_id", F.explode("hashes").alias("hash")), 40 * total), "hash"))
    if n_short or not met:
        every = hashed.select("doc_id", F.explode("h").alias("hash"))
        met.append(every.join(small(known.where(due < LOOKED_UP).select("item_id", F.explode("hashes").alias("hash")), 40 * total), "hash"))
    found = materialize(functools.reduce(DataFrame.unionByName, [m.select("doc_id", "item_id") for m in met]).distinct())

    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small(found, 40 * found.count()), "doc_id")
    texts = pairs.select("doc_id", "item_id", words_of(F.col("text")).alias("w")).select("doc_id", "item_id", F.array_distinct(shingle_texts(F.col("w"), n)).alias("own"))
    both = texts.join(small(known.select("item_id", "shingles"), 2 * chars + 40 * total), "item_id")
    counted = both.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"))
    judged = counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= containment)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", "b.n_item", "b.n_shared", "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    own = docs.select(F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row")).alias("key"), F.col(text_col).alias("text"))
    bad = contaminated(own.where("key.id is not null"), items, id_col="key", text_col="text", **params)
    return without_rows(docs, bad.select("key.*"), id_col, text_col)


def oracle_sql(n: int = WORDS, containment: float = CONTAINMENT) -> str:
    def shingles(key: str, table: str) -> str:
        return f"""SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS s
            FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"""

    return f"""
        WITH d AS ({shingles('doc_id', 'documents')}), i AS ({shingles('item_id', 'benchmark')}),
             sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
             pairs AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM pairs JOIN sizes USING (item_id)
        WHERE n_shared / n_item >= {containment}
    """
