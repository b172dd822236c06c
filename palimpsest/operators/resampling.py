"""Cluster bootstrap as defined: each resample draws as many clusters as there are, with replacement.

The counts of a resample are multinomial and sum to the number of clusters. Each draw picks a cluster by its place in the
order of clusters, from a hash of seed, resample and the draw's number; ``resampled_sql`` picks the same. Clusters up to
twice ``RANGE`` are one range, in one row. Beyond it places come from a sort by ranges and prefix sums, and a resample's
draws are counted where they are hashed: what goes on is a byte a cluster and resample, by ranges of ``RANGE`` places, which
meet the clusters' sums of the same range. So no list of all clusters and no row per cluster and resample exists anywhere;
a task that hashes holds the counts of at most ``HELD`` clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.order_statistics import beside
from palimpsest.sources.scratch import scratch_folder

RANGE = 2048
#: Clusters whose counts a task holds, and draws that it hashes at a time.
HELD, AT_ONCE = 1 << 24, 1 << 18
#: Draws to hash in a task, and rows to place in one.
DRAWS_A_TASK, ROWS_A_TASK = 1 << 22, 1 << 16


def mix(x: np.ndarray | int) -> np.ndarray:
    """A finaliser of 32 bits; ``mix_sql`` is the same."""
    x = np.asarray(x, np.uint64)
    keep = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & keep
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & keep
    return x ^ (x >> np.uint64(16))


def mix_sql(x: str) -> str:
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"((xor({x}, {x} >> 16) * {by}::UBIGINT) & 4294967295::UBIGINT)" if shift == 16 else f"((xor({x}, {x} >> 13) * {by}::UBIGINT) & 4294967295::UBIGINT)"
    return f"xor({x}, {x} >> 16)"


def picks(seed: int, range_: int, b: int, n: int, clusters: int, first: int = 0) -> np.ndarray:
    """Which of a range's clusters each of ``n`` draws of resample ``b`` picks, from the draw numbered ``first`` on."""
    start = mix(np.uint64(b) ^ mix(np.uint64(range_ & 0xFFFFFFFF) ^ mix(np.uint64(seed))))
    return ((mix(np.arange(first, first + n, dtype=np.uint64) ^ start) * np.uint64(clusters)) >> np.uint64(32)).astype(np.int64)


def times_picked(seed: int, b: int, clusters: int, low: int, high: int) -> np.ndarray:
    """How often resample ``b`` of so many clusters draws each of those at places from ``low`` to below ``high``."""
    out = np.zeros(high - low, np.int32)
    for first in range(0, clusters, AT_ONCE):
        at = picks(seed, 0, b, min(AT_ONCE, clusters - first), clusters, first)
        if high - low < clusters:
            at = at[(at >= low) & (at < high)]
        np.add.at(out, at - low, 1)
    return out


def split(rng: np.random.Generator, draws: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(child, resample): the draws of a node dealt to its children, which have so many clusters. By itself; resamples pick by place."""
    out, left, open_ = np.zeros((len(sizes), len(draws)), np.int64), draws.copy(), int(sizes.sum())
    for k, size in enumerate(sizes.tolist()):
        out[k] = left if size == open_ else rng.binomial(left, size / open_)
        left = left - out[k]
        open_ -= size
    return out


def packed(times: np.ndarray) -> bytes:
    """A byte a count, or four if one needs more."""
    return (times.astype(np.uint8) if times.max() < 256 else times.astype(np.int32)).tobytes()


def unpacked(times: bytes, clusters: int) -> np.ndarray:
    return np.frombuffer(times, np.uint8 if len(times) == clusters else np.int32)


def _placed(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """``rows`` with ``place``: how many clusters of the key stand before the row's, by prefix sums over sorted ranges."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(-(-n_rows // ROWS_A_TASK), *keys, "cluster").sortWithinPartitions(*keys, "cluster")
    folder = scratch_folder(spark, "places")  # a second run could cut other ranges
    ranges.select("*", F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().alias("seq_")).write.parquet(folder)
    ranges = spark.read.parquet(folder)
    parts = ranges.groupBy(*keys, "range_").agg(F.min("seq_").alias("least_"), F.count(F.lit(1)).alias("rows_"))
    before = F.sum("rows_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = parts.select(*keys, "range_", "least_", F.coalesce(before, F.lit(0)).alias("before_"))
    return beside(ranges, F.broadcast(starts), [*keys, "range_"]).withColumn("place", F.col("before_") + F.col("seq_") - F.col("least_")).drop("range_", "seq_", "least_", "before_")


def _counted(sizes: DataFrame, draws: int, seed: int, range_size: int, n_clusters: int) -> DataFrame:
    """(clusters, node, b, times): how often resample ``b`` of so many clusters draws each of the range, of (clusters)."""
    units = sizes.select("clusters", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    held = HELD // range_size * range_size
    units = units.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("clusters") - 1) / held))).alias("part")).repartition(-(-n_clusters * draws // DRAWS_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                clusters, r, low = b.column("clusters")[k].as_py(), b.column("b")[k].as_py(), b.column("part")[k].as_py() * held
                times = times_picked(seed, r, clusters, low, min(low + held, clusters))
                cut = [packed(times[x : x + range_size]) for x in range(0, len(times), range_size)]
                nodes = np.arange(len(cut)) + low // range_size
                yield pa.RecordBatch.from_arrays([pa.array([clusters] * len(cut), pa.int64()), pa.array(nodes, pa.int64()), pa.array([r] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["clusters", "node", "b", "times"])

    return units.mapInArrow(run, "clusters long, node long, b long, times binary")


def resampled_sums(sums: DataFrame, columns: list[str], draws: int, seed: int, keys: list[str] | None = None, range_size: int = RANGE) -> DataFrame:
    """(cluster, *keys, columns), one row a cluster and key -> (keys, b, n_drawn, columns): the sums of each of ``draws``
    resamples of the key's clusters, and how many clusters it drew: as many as there are. Null sums count as 0."""
    plain = keys or []
    keys = plain or ["all_"]
    spark = sums.sparkSession
    rows = sums if plain else sums.withColumn("all_", F.lit(0))
    rows = rows.where(F.col("cluster").isNotNull()).select(*keys, "cluster", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    folder = scratch_folder(spark, "clusters")  # read more than once, and what makes it may be long
    rows.write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))
    whole = sizes.agg(F.max("clusters").alias("largest"), F.sum("clusters").alias("n")).first()
    row = lambda first: F.array_sort(F.collect_list(F.struct(first, *columns))).alias("own")
    if (whole.largest or 0) <= 2 * range_size:
        held = rows.groupBy(*keys).agg(row("cluster")).withColumn("drawn", F.array().cast("array<struct<b: bigint, times: binary>>"))
    else:
        at = F.floor(F.col("place") / range_size)
        placed = beside(_placed(rows, keys, whole.n), sizes, keys).withColumn("node", at).repartition("clusters", "node")  # keys of as many clusters share their draws
        alike = sizes.select("clusters").distinct()
        drawn = _counted(alike, draws, seed, range_size, alike.agg(F.sum("clusters")).first()[0]).groupBy("clusters", "node").agg(F.collect_list(F.struct("b", "times")).alias("drawn"))
        held = placed.groupBy(*keys, "clusters", "node").agg(row("place")).join(drawn, ["clusters", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("own").slice(k, 1).flatten()
                table = np.stack([own.field(c).to_numpy() for c in columns], axis=1)
                m = len(table)
                found = batch.column("drawn").slice(k, 1).flatten()
                if len(found):
                    resamples = found.field("b").to_numpy()
                    times = [unpacked(x.as_py(), m) for x in found.field("times")]
                else:
                    resamples = np.arange(draws)
                    times = [np.bincount(picks(seed, 0, r, m, m), minlength=m) for r in range(draws)]
                n, made = np.array([int(t.sum()) for t in times]), np.stack([t @ table for t in times])
                same = [pa.array([batch.column(c)[k].as_py()] * len(n), batch.column(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(resamples, pa.int64()), pa.array(n, pa.int64()), *[pa.array(made[:, j]) for j in range(len(columns))]], names=[*keys, "b", "n_drawn", *columns])

    kinds = dict(held.dtypes)
    found = held.select(*keys, "own", "drawn").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "b long, n_drawn long", *(f"`{c}` double" for c in columns)]))
    return found.groupBy(*plain, "b").agg(*[F.sum(c).alias(c) for c in ("n_drawn", *columns)])


def resampled_sql(source: str, columns: list[str], draws: int, seed: int, keys: list[str] | None = None, name: str = "rs") -> str:
    """CTEs ending in ``name`` (keys, b, n_drawn, columns): the same draws, for any number of clusters."""
    by = "".join(f"{k}, " for k in keys or [])
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    using = " AND ".join([*(f"p.{k} IS NOT DISTINCT FROM c.{k}" for k in keys or []), "p.i_ = c.i_"])
    return f"""{name}_c AS (SELECT *, row_number() OVER ({part} ORDER BY cluster) - 1 AS i_, count(*) OVER ({part}) AS m_ FROM {source} WHERE cluster IS NOT NULL),
{name}_s AS (SELECT {mix_sql(f'{seed}::UBIGINT')} AS s), {name}_r AS (SELECT {mix_sql('s')} AS r FROM {name}_s),
{name}_x AS (SELECT b, xor(b::UBIGINT, r) AS x FROM range({draws}) t(b), {name}_r), {name}_b AS (SELECT b, {mix_sql('x')} AS h FROM {name}_x),
{name}_j AS (SELECT {by}b, m_, xor(unnest(range(m_))::UBIGINT, h) AS x FROM (SELECT DISTINCT {by}m_ FROM {name}_c), {name}_b),
{name}_p AS (SELECT {by}b, CAST(({mix_sql('x')} * m_::UBIGINT) >> 32 AS BIGINT) AS i_ FROM {name}_j),
{name} AS (SELECT {''.join(f'p.{k}, ' for k in keys or [])}b, count(*) AS n_drawn, {', '.join(f'sum(c.{c}) AS {c}' for c in columns)} FROM {name}_p p JOIN {name}_c c ON {using} GROUP BY ALL)"""
