"""Near copies of whole documents: MinHash banding proposes, exact Jaccard similarity decides (see ``links``).

Documents with equal sets of word shingles form a class; classes that share a band of their signatures are compared
by their shingles, and of each component of verified links the document with the smallest id stays. With a radius, texts
whose SimHash fingerprints differ in at most that many bits are linked as well, by covering tables (see ``simhash``), and
components are of both kinds of links.

Defined cases: null text is empty, and texts without words are copies of one another; fewer words than a shingle
make one shingle; rows whose id is null stay; rows that repeat an id are told apart by their texts; an empty table gives
an empty result; columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, maybe_broadcast, materialize, row_key, ship_package, without_rows
from palimpsest.llm.links import BLOCK, signatures, similar_components, tune
from palimpsest.llm.simhash import SEED, fingerprint, shingle_hashes
from palimpsest.llm.simhash import WORDS as FINGERPRINT_WORDS
from palimpsest.llm.simhash import links as fingerprint_links

WORDS, SIMILARITY = 5, 0.8
HASHES, RECALL = 120, 0.9999


def class_key(sh: np.ndarray) -> int:
    key = xxhash.xxh64_intdigest(sh.tobytes(), SEED)
    return key - (key >> 63 << 64)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, fingerprints: bool = False) -> DataFrame:
    """id, row, key (of the set of shingles), sig (a hash per band; null without words), fp (the fingerprint, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(2)]
                sig: list[np.ndarray | None] = [None] * len(sets)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    for k, g in zip(full, signatures([sets[k] for k in full], bands, rows).view(np.int64), strict=True):
                        sig[k] = g
                fps = [fingerprint(shingle_hashes(t.as_py(), FINGERPRINT_WORDS)) if fingerprints else None for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(class_key, sets), pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["id", "row", "key", "sig", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, row long, key long, sig array<long>, fp long")


def shingle_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(key, sh): the class and the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_key, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "sh"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, sh array<long>")


def with_fingerprints(named: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """``named`` (key, first, label, n) with one label for all components that fingerprints link.

    rows (key, fp). A group of linked fingerprints joins the labels of its rows' classes.
    """
    pairs = materialize(rows.select("key", "fp").distinct())
    groups = connected_components(fingerprint_links(pairs.select("fp").distinct(), radius))
    grouped = pairs.join(groups, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("label", "fp").alias("group"))
    met = materialize(grouped.join(named.select("key", "label"), "key").select("group", "label").distinct())
    several = met.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("high")).where("a <> high").select("group", "a")
    joined = connected_components(met.join(several, "group").select("a", F.col("label").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return named.join(joined, "label", "left").select("key", "first", F.coalesce("further", "label").alias("label"), "n")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of texts linked by that Jaccard similarity of word
    shingles, or by fingerprints within ``radius`` if given, the one with the smallest id stays."""
    ship_package(docs.sparkSession)
    bands, per_band = tune(similarity, HASHES, RECALL)
    rows = materialize(signed(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, bands, per_band, radius is not None))
    classes = materialize(rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")))

    def sets_of(met: DataFrame) -> DataFrame:
        wanted = materialize(met.join(classes, "key").select(F.col("first.id").alias("of_id"), F.col("first.row").alias("of_row")))
        texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
        texts = texts.join(maybe_broadcast(wanted, 64), (F.col("id") == F.col("of_id")) & (F.col("row") == F.col("of_row")), "left_semi")
        return shingle_sets(texts, "text", words).groupBy("key").agg(F.first("sh").alias("sh"))

    labels = similar_components(classes.select("key", F.posexplode("sig").alias("band", "hash")), sets_of, similarity, block)
    named = classes.select("key", "first", "n")
    named = named.withColumn("label", F.col("key")) if labels is None else named.join(labels, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("label", "key").alias("label"), "n")
    named = materialize(named)
    if radius is not None:
        named = materialize(with_fingerprints(named, rows, radius))
    groups = named.groupBy("label").agg(F.min("first").alias("least"), F.sum("n").alias("all")).where("all > 1")
    some = materialize(named.select("key", "label").join(groups, "label").select("key", "least"))
    gone = rows.join(maybe_broadcast(some, 64), "key").where("struct(id, row) <> least").select("id", "row")
    return without_rows(docs, gone, id_col, text_col)
