"""What the operators of this subpackage share: tables, materialised steps, connected components."""

from __future__ import annotations

import contextlib
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table with a size bound known beforehand is broadcast.
BROADCAST_BYTES = 32 << 20

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def ship_package(spark: SparkSession) -> None:
    """Let every Python worker import this package, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="palimpsest-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of our own only where none is configured and all runs on one
    machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return "file://" + _local_dirs[app]


@contextlib.contextmanager
def steps_removed(spark: SparkSession) -> Iterator[None]:
    """Steps written in here are removed at the end: for work whose result is written, too, before that."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of one id apart: a hash of id and text."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows (id, row) of ``gone``, with its columns; rows whose id is null stay."""
    gone = materialize(gone.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct())
    # Rows are packed, so that none of their columns can clash with these.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_col, text_col).alias("own_row"))
    same = (F.col("doc")[id_col] == F.col("gone_id")) & (F.col("own_row") == F.col("gone_row"))
    return packed.join(maybe_broadcast(gone, 64), same, "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by the column ``by`` if given, and read it back.

    This cuts the lineage: a lost executor costs the tasks since the last such step only, as the files
    do not live on the executors.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{_folder.get() or shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are few enough; else any join shuffles it.

    ``row_bytes``: what a row takes in memory, at most. Tables with columns of varying width are not for this.
    """
    return F.broadcast(df) if row_bytes * df.count() <= BROADCAST_BYTES else df


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done.

    Spark removes them once the driver's garbage collector finds their plans unused, which may be never in a driver
    with a large heap; after a step that shuffled a multiple of the input this is worth a collection. The first
    collection lets go of the plan, the second one of the shuffles it held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links over long node ids -> (node, label): one row per linked node, equal labels iff connected.

    Random contraction: in each round every node points to the neighbour (itself included) that comes first
    in an order drawn anew, and the graph shrinks to the nodes pointed at, by a constant factor in expectation
    whatever its shape. Every step is a partial aggregate or an equi-join of narrow rows, so a hub is
    combined before the shuffle and its join partition can be split at run time. Loops and repeated links
    are allowed; a node with nothing but a loop gets itself as label.
    """
    left = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null"))
    labels: DataFrame | None = None
    for round_ in range(max_rounds):
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        draw = lambda c: F.xxhash64(c, F.lit(round_))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.min_by("b", draw("b")).alias("other"))
        step = materialize(first.select("node", F.when(draw("other") < draw("node"), F.col("other")).otherwise(F.col("node")).alias("label")))
        if labels is None:
            labels = step
        else:
            nxt = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = labels.join(nxt, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
        to_a = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to_b = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = materialize(
            left.join(to_a, "a").join(to_b, "b").where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        )
        if left.isEmpty():
            return labels
    raise RuntimeError("connected components did not converge")
