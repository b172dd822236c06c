"""Similar sets of word shingles: MinHash banding proposes, exact Jaccard similarity decides, components join.

Bands of a class's MinHash signature are tuned so that a pair at the similarity threshold shares one almost surely.
Classes that share a band are compared by their shingles; a pair is left out only if its ends are already joined by
verified links: a few bands go first, and of the others only buckets whose classes are not yet all in one component
are compared.

A bucket of up to ``block`` classes is one block, in which all pairs meet. A larger one is first dealt into blocks by
a hash of class and bucket, another deal in each band, so that a large group of copies is joined by few rows. If a bucket
is still of several components, its blocks meet, every two that differ in component, as long as that takes few rows (a
large component and some strays). If it takes more, the classes get further bands, of more hashes each (``FURTHER``), and meet where they share
one of those: rows are a constant factor of the classes, and a pair at the threshold (0.8) is missed by one step with a
probability of less than 0.001. What is of several components and larger than a block after all of them, classes that are
alike in most of their shingles and yet not linked, meets block by block, every two that differ in component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, materialize, maybe_broadcast, ship_package
from palimpsest.llm.simhash import SEED, Forest

BLOCK = 128
FIRST_BANDS = 6
#: Hashes a band of the steps that split large buckets.
FURTHER = (6, 10, 16)
STEP_RECALL = 0.999
#: Rows a class up to which the blocks of a large bucket meet at once.
CROSSING = 6


def tune(similarity: float, hashes: int, recall: float) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at the threshold is high enough."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Ascending distinct hashes of the runs of ``n`` words."""
    runs = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """A hash per set and band."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.empty((len(sets), bands), np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for k in range(bands):
        key = np.zeros(len(sets), np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            h = every * a[j] + b[j]
            key = (key ^ np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)) * mix
        out[:, k] = key
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def block_links(sets: list[np.ndarray], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, by position, of the similar pairs; those of one label count as joined."""
    forest, first = Forest(len(sets)), {}
    for k, label in enumerate(labels):
        forest.join(first.setdefault(label, k), k)
    found = []
    for i in range(len(sets)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= similarity * large and forest.root(i) != forest.root(j) and jaccard(sets[i], sets[j]) >= similarity:
                forest.join(i, j)
                found.append((i, j))
    return found


def verified(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(members: array of (label, key)) and (key, sh) -> (a, b) links that connect all similar pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, z = [], []
            for row in batch.column(0):
                keys, labels, lists = row.values.field(0).to_pylist(), row.values.field(1).to_pylist(), row.values.field(2)
                for i, j in block_links([lists[k].values.to_numpy() for k in range(len(keys))], labels, similarity):
                    a.append(keys[i])
                    z.append(keys[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    named = blocks.select(F.xxhash64("members").alias("block"), F.size("members").alias("n"), F.explode("members").alias("m"))
    named = named.select("block", "n", F.col("m.key").alias("key"), F.col("m.label").alias("label"))
    filled = named.join(sets, "key").groupBy("block", "n").agg(F.collect_list(F.struct("key", "label", "sh")).alias("members"))
    return materialize(filled.select("members").mapInArrow(run, "a long, b long").distinct())


def labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, n, key, label) of the buckets whose classes are not all in one component."""
    if labels is None:
        return buckets.withColumn("label", F.col("key"))
    own = buckets.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    own = materialize(own.select("bucket", "n", "key", "label"))
    mixed = materialize(own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"))
    return own.join(maybe_broadcast(mixed, 40), "bucket")


def members(rows: DataFrame, *by: str) -> DataFrame:
    """Equal blocks, of several bands, once."""
    one = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("label", "key"))).alias("members"))
    return one.where("size(members) > 1").select("members").distinct()


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Every bucket as blocks of about ``block / 2``, or as one of up to ``block``."""
    parts = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") / (block / 2))).cast("int")
    return members(rows.withColumn("own", F.pmod(F.xxhash64("key", "bucket"), parts)), "bucket", "own")


def crossed(rows: DataFrame, block: int) -> DataFrame:
    """Every two blocks of a bucket that differ in component, and those of several components by themselves.

    A component of more than ``block / 2`` classes has blocks of its own, which do not meet each other.
    """
    half = block / 2
    parts = materialize(rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("own")))
    small = parts.where(F.col("own") <= half).groupBy("bucket").agg(F.sum("own").alias("small"))
    parts = parts.join(small, "bucket", "left")
    large = F.col("own") > half
    dealt_by = F.when(large, F.pmod(F.xxhash64("key"), F.ceil(F.col("own") / half))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / half)))
    placed = rows.join(parts, ["bucket", "label"]).select("bucket", "key", "label", F.when(large, F.col("label")).alias("whole"), dealt_by.alias("deal"))
    placed = materialize(placed.withColumn("part", F.xxhash64(F.col("whole").isNull(), F.coalesce("whole", F.lit(0)), "deal")))
    kinds = materialize(placed.select("bucket", "part", "whole").distinct())
    other = kinds.select("bucket", F.col("part").alias("other"), F.col("whole").alias("other_whole"))
    meet = (F.col("part") < F.col("other")) & ~F.coalesce(F.col("whole") == F.col("other_whole"), F.lit(False)) | (F.col("part") == F.col("other")) & F.col("whole").isNull()
    pairs = kinds.join(other, "bucket").where(meet).select("bucket", F.col("part").alias("one"), F.col("other").alias("two"))
    sides = pairs.select("bucket", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("part"))
    return members(sides.join(placed, ["bucket", "part"]), "bucket", "one", "two")


def similar_components(banded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int = BLOCK) -> DataFrame | None:
    """(key, band, hash) -> (node, label) of the classes that are linked; None if no two share a band.

    ``sets_of``: gives (key, sh) for the classes (key) that share a band with another.
    """
    banded = banded.select(F.xxhash64("band", "hash").alias("bucket"), "band", "key")
    sizes = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if sizes.isEmpty():
        return None
    buckets = materialize(banded.join(maybe_broadcast(sizes, 40), "bucket"))
    sets = materialize(sets_of(materialize(buckets.select("key").distinct())))
    found, labels = None, None

    def linked(blocks: DataFrame) -> None:
        nonlocal found, labels
        new = verified(blocks, sets, similarity)
        if labels is None or not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            labels = connected_components(found)

    for some in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        linked(dealt(labelled(buckets.where(some), labels), block))
    large = buckets.where(F.col("n") > block)
    for per_band in (*FURTHER, None):
        rows = materialize(labelled(large, labels))
        if rows.isEmpty():
            return labels
        if per_band is not None:
            due = materialize(rows.join(crowded(rows, block), "bucket", "left"))
            rows, left = due.where("crowded is null").drop("crowded"), due.where("crowded").select("key").distinct()
        linked(crossed(rows, block))
        if per_band is not None:
            if left.isEmpty():
                return labels
            split = further(left, sets, similarity, per_band)
            linked(dealt(labelled(split, labels), block))
            large = split.where(F.col("n") > block)
    return labels


def crowded(rows: DataFrame, block: int) -> DataFrame:
    """(bucket, crowded: true) of the buckets whose blocks would make more than ``CROSSING`` rows a class if all that
    differ in component met: those of many small components, and not those of a large one and some strays."""
    half = block / 2
    own = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("own"))
    large = F.col("own") > half
    parts = own.groupBy("bucket").agg(
        F.sum("own").alias("all"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("own"))) / half).alias("small"),
        F.sum(F.when(large, F.ceil(F.col("own") / half)).otherwise(0)).alias("p"), F.sum(F.when(large, F.pow(F.ceil(F.col("own") / half), 2)).otherwise(0.0)).alias("pp"),
    )
    pairs = (F.pow(F.col("p") + F.col("small"), 2) - F.col("pp")) / 2
    return materialize(parts.where(pairs * block > CROSSING * F.col("all")).select("bucket", F.lit(True).alias("crowded")))


def further(keys: DataFrame, sets: DataFrame, similarity: float, per_band: int) -> DataFrame:
    """(bucket, n, key) of the classes that share one of as many bands of ``per_band`` hashes as a step's recall takes."""
    bands = math.ceil(math.log1p(-STEP_RECALL) / math.log1p(-(similarity**per_band)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                own = [s.values.to_numpy().view(np.uint64) for s in part.column(1)]
                sig = signatures(own, bands, per_band, 100 + per_band).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(sig), pa.list_(pa.int64()))], names=["key", "sig"])

    ship_package(keys.sparkSession)
    signed = keys.join(sets.where("size(sh) > 0"), "key").select("key", "sh").mapInArrow(run, "key long, sig array<long>")
    banded = materialize(signed.select("key", F.posexplode("sig").alias("band", "hash")).select(F.xxhash64("band", "hash", F.lit(per_band)).alias("bucket"), "key"))
    sizes = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return materialize(banded.join(maybe_broadcast(sizes, 40), "bucket").select("bucket", "n", "key"))
