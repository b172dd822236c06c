"""Greedy matching of token vectors: each token of one text is matched with its most similar token of the other.

Precision is the mean best cosine of the candidate's tokens, recall that of the reference's, F their harmonic mean. Texts
come as rows of (keys, position, vector). They are gathered in blocks of at most ``BLOCK`` tokens, so that no row grows with
a text; every block of a candidate meets every block of its reference, which the definition asks for, in one matrix
product, and what goes on is one best value a token. Those are reduced by a maximum per token over the other text's
blocks, then a sum per text.

Where tokens share the vectors of a table, texts come as arrays of vector numbers instead (``numbered_matching``). Turns are
dealt to buckets by chain and ``STRETCH`` of steps, and a bucket gets each vector its turns use once; a turn goes to one
bucket, besides the few that a neighbour needs. Equal tokens of a text are one row of the matrix product with a count, and
the product is made tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.sources.scratch import scratch_folder

BLOCK = 256
#: Steps of a chain that go to a bucket together; tokens for each vector of the table in a bucket, so that vectors take
#: some bytes a token; bytes of vectors that a task holds; rows and columns of a tile of cosines.
STRETCH, TOKENS_A_VECTOR, HELD_BYTES, TILE = 16, 16, 1 << 28, 1024


def token_blocks(tokens: DataFrame, keys: list[str], position: str = "pos", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(keys, block, vectors): the vectors of a text by position, a block of positions a row. Null vectors are left out."""
    at = F.floor(F.col(position) / block).cast("long")
    rows = tokens.where(F.col(vector).isNotNull()).groupBy(*keys, at.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(vector).cast("array<double>").alias("v")))).alias("t"))
    return rows.select(*keys, "block", F.transform("t", lambda x: x.v).alias("vectors"))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    rows = column.slice(k, 1).flatten()
    m = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    size = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def best_matches(pairs: DataFrame) -> DataFrame:
    """(keys, one, two: arrays of vectors) -> (keys, best_one, best_two): the best cosine of every vector of either side."""
    keys = [c for c in pairs.columns if c not in ("one", "two")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ones, twos = [], []
            for k in range(b.num_rows):
                cosine = _matrix(b.column("one"), k) @ _matrix(b.column("two"), k).T
                ones.append(cosine.max(1))
                twos.append(cosine.max(0))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(ones, kind), pa.array(twos, kind)], names=[*keys, "best_one", "best_two"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keys, "one", "two").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "best_one array<double>", "best_two array<double>"]))


def _mean_best(best: DataFrame, keys: list[str], own: str, name: str) -> DataFrame:
    """Mean over a text's tokens of their best value in any block of the other text."""
    each = best.select(*keys, F.col(own).alias("own"), F.posexplode(name).alias("i", "v"))
    return each.groupBy(*keys, "own", "i").agg(F.max("v").alias("v")).groupBy(*keys).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))


def matched(candidates: DataFrame, references: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, precision, recall, f1) of the keys that both sides have a token of."""
    one = token_blocks(candidates, keys, block=block).withColumnsRenamed({"block": "block_one", "vectors": "one"})
    two = token_blocks(references, keys, block=block).withColumnsRenamed({"block": "block_two", "vectors": "two"})
    best = best_matches(one.join(two, keys))
    p = _mean_best(best, keys, "block_one", "best_one").select(*keys, (F.col("s") / F.col("n")).alias("precision"))
    r = _mean_best(best, keys, "block_two", "best_two").select(*keys, (F.col("s") / F.col("n")).alias("recall"))
    return p.join(r, keys).withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def f_score(precision: Column, recall: Column) -> Column:
    """The harmonic mean; 0 where their sum is."""
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def step_matching(tokens: DataFrame, keys: list[str], step: str = "step", block: int = BLOCK) -> DataFrame:
    """Every step after the first with tokens, against step 0 (baseline) and the step before (consecutive); NULL where that
    step is missing or has none. A step is sent to both comparisons in one go, so tokens are read once a side."""
    later = tokens.where(F.col(step) > 0)
    due = later.select(*keys, step, "pos", "vector", F.explode(F.array(F.lit("baseline"), F.lit("consecutive"))).alias("kind"))
    against = tokens.select(*keys, F.col(step).alias("of"), "pos", "vector")
    steps = later.select(*keys, step).distinct()
    first = against.where("of = 0").join(steps, keys).select(*keys, step, "pos", "vector", F.lit("baseline").alias("kind"))
    before = against.select(*keys, (F.col("of") + 1).alias(step), "pos", "vector", F.lit("consecutive").alias("kind"))
    found = matched(due, first.unionByName(before), [*keys, step, "kind"], block)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}_{kind}")
    wide = found.groupBy(*keys, step).agg(*[pick(k, c) for k in ("baseline", "consecutive") for c in ("precision", "recall", "f1")])
    return steps.join(wide, [*keys, step], "left")


def _tiled_best(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cosine of each row of either side."""
    best_one, best_two = np.full(len(one), -np.inf), np.full(len(two), -np.inf)
    for i in range(0, len(one), TILE):
        for j in range(0, len(two), TILE):
            cosine = one[i : i + TILE] @ two[j : j + TILE].T
            np.maximum(best_one[i : i + TILE], cosine.max(1), out=best_one[i : i + TILE])
            np.maximum(best_two[j : j + TILE], cosine.max(0), out=best_two[j : j + TILE])
    return best_one, best_two


class _Bucket:
    """The vectors of a bucket, by number."""

    def __init__(self, numbers: list[np.ndarray], vectors: list[np.ndarray]) -> None:
        self.numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.vectors = np.concatenate(vectors) if vectors else np.zeros((0, 1))
        order = np.argsort(self.numbers, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.numbers, self.vectors = self.numbers[order], self.vectors[order]

    def text(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(directions, counts) of a text's different vectors; numbers without a vector are left out."""
        found, counts = np.unique(numbers, return_counts=True)
        at = np.searchsorted(self.numbers, found)
        known = at < len(self.numbers)
        known[known] = self.numbers[at[known]] == found[known]
        m = self.vectors[at[known]].astype(np.float64)
        size = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0), counts[known]


def _compared(text: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray] | None) -> tuple:
    """Precision, recall and F of a text against another; None where one has no vector."""
    if other is None or not len(text[1]) or not len(other[1]):
        return None, None, None
    best, best_other = _tiled_best(text[0], other[0])
    p, r = float(best @ text[1] / text[1].sum()), float(best_other @ other[1] / other[1].sum())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def numbered_matching(turns: DataFrame, vectors: DataFrame, keys: list[str], step: str = "step", stretch: int = STRETCH, per_vector: int = TOKENS_A_VECTOR) -> DataFrame:
    """``step_matching`` of (keys, step, numbers: array of long) and (number, vector): each token has the vector of its number."""
    turns = turns.where((F.size("numbers") > 0) & (F.col(step) >= 0)).select(*keys, step, F.floor(F.col(step) / stretch).alias("stretch"), "numbers")
    folder = scratch_folder(turns.sparkSession, "numbers")  # read several times; numbers may come from a hash of each token
    turns.write.parquet(folder)
    turns = turns.sparkSession.read.parquet(folder)
    vectors = vectors.where(F.col("vector").isNotNull()).select("number", "vector")
    n_vectors, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_tokens = turns.agg(F.sum(F.size("numbers"))).first()[0] or 0
    held = HELD_BYTES // (8 * (width or 1))
    buckets = max(1, -(-n_tokens // (per_vector * max(1, n_vectors) if n_vectors <= held else held)))

    due = F.lit(True).alias("due")
    next_ = turns.where(F.col(step) % stretch == stretch - 1).select(*keys, step, (F.col("stretch") + 1).alias("stretch"), "numbers", F.lit(False).alias("due"))
    far = turns.where(F.col("stretch") > 0).select(*keys, "stretch").distinct()
    first = turns.where(F.col(step) == 0).drop("stretch").join(far, keys).select(*keys, step, "stretch", "numbers", F.lit(False).alias("due"))
    sent = turns.select(*keys, step, "stretch", "numbers", due).unionByName(next_).unionByName(first)
    sent = sent.withColumn("bucket", F.pmod(F.xxhash64(*keys, "stretch"), F.lit(buckets)).cast("int"))
    used = sent.select("bucket", F.explode("numbers").alias("number")).distinct().join(vectors, "number")
    mixed = used.select("bucket", "number", "vector").unionByName(sent.select("bucket", *keys, step, "stretch", "numbers", "due"), allowMissingColumns=True)
    rows = mixed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("due").isNotNull(), *keys, "stretch", step)
    names = [f"{c}_{kind}" for kind in ("baseline", "consecutive") for c in ("precision", "recall", "f1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = text_at = chain = table = first = before = None
        numbers: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        is_due = False

        def finish() -> None:
            """The turn whose numbers have all come, against the first and the one before."""
            nonlocal chain, first, before
            if text_at is None:
                return
            if chain != text_at[:-1]:
                chain, first, before = text_at[:-1], None, (None, None)
            step_at, text = text_at[-1], table.text(np.concatenate(waiting))
            if is_due and step_at > 0:
                baseline = _compared(text, first)
                last = before[1] if before[0] == step_at - 1 else None
                out.append((*text_at[:-2], step_at, *baseline, *(baseline if last is first else _compared(text, last))))
            if step_at == 0:
                first = text
            before = step_at, text

        for b in batches:
            said = b.column("due")
            owners = list(zip(*(b.column(c).to_pylist() for c in (*keys, "stretch", step)), strict=True))
            dues, buckets_of = said.to_pylist(), b.column("bucket").to_numpy()
            ends, numbered = b.column("numbers").offsets.to_numpy(), b.column("numbers").values.to_numpy()
            is_vector = np.array([d is None for d in dues])
            cuts = [0, *(np.flatnonzero((np.diff(buckets_of) != 0) | (np.diff(is_vector.astype(np.int8)) != 0)) + 1).tolist(), len(dues)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if buckets_of[low] != at:
                    finish()
                    at, text_at, table, numbers, vectors = buckets_of[low], None, None, [], []
                if is_vector[low]:
                    column = b.column("vector")
                    m = column.values.to_numpy(zero_copy_only=False)[column.offsets[low].as_py() : column.offsets[high].as_py()]
                    numbers.append(b.column("number").slice(low, high - low).to_numpy())
                    vectors.append(m.reshape(high - low, -1))
                    continue
                if table is None:
                    table, numbers, vectors = _Bucket(numbers, vectors), [], []
                for k in range(low, high):
                    if owners[k] != text_at:
                        finish()
                        text_at, waiting, is_due = owners[k], [], dues[k]
                    waiting.append(numbered[ends[k] : ends[k + 1]])
            yield made(out)
            out = []
        finish()
        yield made(out)

    kinds = dict(turns.dtypes)
    shape = to_arrow_schema(turns.select(*keys, step).schema)

    def made(rows_: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows_, strict=True)) if rows_ else [()] * (len(keys) + 7)
        types = [*shape.types, *[pa.float64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*keys, step, *names])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, step)), *(f"`{c}` double" for c in names)]))
