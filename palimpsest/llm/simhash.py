"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit ``i`` of a fingerprint carries a fixed vector ``m(i)`` of ``radius + 1`` bits. Table ``v`` keeps the bits
with an odd product ``m(i) . v``; for any ``radius`` differing bits some ``v`` is orthogonal to all of them, so
every pair within the radius has the same key in some table: no pair is missed.

Rows with one fingerprint are summed up first. A bucket of more than ``BLOCK`` fingerprints is split by further
tables over the bits its key has not used, so that no task holds a large bucket and rows grow in proportion to it. Of
each bucket only a spanning forest of its links goes on, shortest links first; connected components need no more.

Defined cases: null text is empty; a text without words has fingerprint zero, which links like any other; fewer
words than a shingle make one shingle; null doc_ids are returned with their fingerprint, and take no part in
naming a component (which is null if it has no other ids); repeated rows are in one component; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, materialize, maybe_broadcast, ship_package

SEED = 42
WORDS, RADIUS = 3, 3
BLOCK = 4096
#: Splits of a large bucket: after so many a key has all but one or two of the 64 bits.
LEVELS = 6


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words of the text with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distinct: bool = False) -> DataFrame:
    """(id, fp) per row. ``distinct``: a shingle that repeats in a text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = (shingle_hashes(t.as_py(), words) for t in b.column(1))
            fps = [fingerprint(np.unique(h) if distinct else h) for h in hashed]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, signed. Each level deals the vectors to the bits in another order."""
    vectors = 2 ** (radius + 1) - 1
    of = 1 + np.random.default_rng(level).permutation(64) % vectors if level else 1 + np.arange(64) % vectors
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if bin(int(of[i]) & v).count("1") % 2)
        masks.append(mask - (mask >> 63 << 64))
    return masks


def in_tables(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """(key, used, fp) -> the same, a row per table: ``used`` gains the table's bits, ``key`` is of all used bits."""
    masks = F.array(*map(F.lit, covering_masks(radius, level)))
    more = rows.select("key", "used", "fp", F.posexplode(masks).alias("table", "mask")).withColumn("used", F.col("used").bitwiseOR(F.col("mask")))
    return more.select(F.xxhash64("key", "table", F.col("fp").bitwiseAND(F.col("used"))).alias("key"), "used", "fp")


def bounded_buckets(fps: DataFrame, radius: int, block: int) -> DataFrame:
    """(fp) -> (members): the fingerprints that share a key of some table, at most ``block`` of them.

    A larger bucket is split by tables of the bits that its key has not used; the covering holds for these bits as
    well, so a pair within the radius stays together in some part. Each level halves the bits left, and a member makes
    a row per table, however many there are in its bucket. Keys of one fingerprint drop out first.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(tasks, "fp")  # a small table is read by few tasks, which would write all the rows
    rows, out = spread.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"), "fp"), None
    for level in range(LEVELS):
        rows = in_tables(rows, radius, level)
        sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        sized = rows.join(maybe_broadcast(sizes, 40), "key")
        last = level == LEVELS - 1 or sizes.where(F.col("n") > block).isEmpty()
        few = (sized if last else sized.where(F.col("n") <= block)).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
        out = few if out is None else out.unionByName(few)
        if last:
            return out
        rows = sized.where(F.col("n") > block).select("key", "used", "fp")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[y] = x
        return x != y


def _links_within(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius.

    In a large block a fingerprint takes all it reaches at once, those nearest to the block's middle first, so a
    block of near copies is done after a few; links of half the radius are made before longer ones.
    """
    n = len(fps)
    if n <= 16:
        d = np.bitwise_count(fps[:, None] ^ fps[None])
        i, j = np.nonzero(np.triu(d <= radius, 1))
        forest = Forest(n)
        return [(i, j) for _, i, j in sorted(zip(d[i, j].tolist(), i.tolist(), j.tolist(), strict=True)) if forest.join(i, j)]
    middle = np.packbits(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).sum(0) * 2 > n).view(np.uint64)[0]
    order = np.argsort(np.bitwise_count(fps ^ middle), kind="stable")
    forest, found = Forest(n), []
    for reach in (radius // 2, radius):
        rest, values, queue = order, fps[order], []
        while len(rest):
            at = queue.pop() if queue else int(rest[0])
            hit = np.bitwise_count(values ^ fps[at]) <= reach
            new = [j for j in rest[hit].tolist() if j != at]
            found += [(at, j) for j in new if forest.join(at, j)]
            queue += new[::-1]
            if hit.any():
                rest, values = rest[~hit], values[~hit]
    return found


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) links that connect every two within the radius of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(0).offsets.to_numpy()
            fp = b.column(0).values.to_numpy().view(np.uint64)
            a, z = [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = fp[lo:hi]
                for i, j in _links_within(own, radius) if hi - lo > 2 else [(0, 1)] if (int(own[0]) ^ int(own[1])).bit_count() <= radius else []:
                    a.append(own[i])
                    z.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, z)], names=["a", "b"])

    return bounded_buckets(fps, radius, block).mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (least id reachable by links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, words))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = connected_components(links(classes.select("fp"), radius))
    named = materialize(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: those linked as in ``near_groups`` within ``radius`` (None: by no
    fingerprints), and those that shingles decide, see ``near_copies``."""
    from palimpsest.llm import near_copies  # which imports this module

    return near_copies.drop_near_copies(docs, id_col, text_col, radius=radius)
