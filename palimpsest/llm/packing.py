"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are split into pieces of it. Pieces are dealt by a hash into
shards of a few thousand, and each shard is packed by best fit, longest first: a piece goes into the open bin it
leaves least room in. If none fits, the permitted length is opened that costs least for each token it will hold,
counting a fixed overhead a sequence and how much of its room the shorter pieces of the shard still to come can
fill, so that all lengths compete. When a shard is packed, each bin is downsized to the least permitted length
that holds its contents. Only lengths and ids are shuffled; what a shard leaves unfilled is bounded by its last
few bins, so the loss does not grow with the number of shards' rows.

Defined cases: null or empty texts have length 0 and take no room (they are returned without a bin, in the
stage as well); ties go to the smaller id; repeated rows are packed as often as they occur, and are dealt to shards by a number of their own,
so that copies do not meet in one; null ids are ids like others; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, ship_package

LENGTHS = (512, 1024, 2048, 4096)
#: Tokens' worth of cost that a sequence has whatever its length.
OVERHEAD = 32
SHARD_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def choose_length(size: int, rest: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length with the least cost a token, if ``rest`` tokens of shorter pieces can share its room."""
    fitting = [n for n in lengths if n >= size]
    return min(fitting, key=lambda n: ((n + overhead) / (size + min(n - size, rest)), n))


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and its final length for each size (1 to the largest length), which must descend."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_: list[tuple[int, int]] = []  # (room, bin), ascending
    rest = int(sizes.sum())
    for k, size in enumerate(sizes.tolist()):
        rest -= size
        at = bisect.bisect_left(open_, (size, -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = choose_length(size, rest, lengths, overhead), len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if room > size:
            bisect.insort(open_, (room - size, b))
    final = np.array(lengths)[np.searchsorted(lengths, fill)] if fill else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if len(bins) else final


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, shard, bin, bin_offset, bin_length, bin_tokens.

    ``size``: the length of a document (by default its words); ``start``: where the piece begins in it.
    """
    ship_package(docs.sparkSession)
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    sized = materialize(docs.select(F.col(id_col).alias("id"), (word_count(F.col(text_col)) if size is None else size).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    n = F.coalesce("n", F.lit(0).cast("long"))
    pieces = sized.select("id", "row", n.alias("n")).select("id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0).cast("long")))).alias("piece"))
    pieces = pieces.select("id", "row", "piece", (F.col("piece") * longest).alias("start"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).alias("n_tokens"))
    total = sized.agg(F.sum(F.greatest(F.ceil(n / longest), F.lit(1).cast("long")))).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "id", "piece", "row"], ascending=[False, True, True, True], kind="stable").drop(columns="row")
        some = shard["n_tokens"].to_numpy() > 0
        b, o, f = pack(shard["n_tokens"].to_numpy()[some], lengths, overhead)
        for name, values in (("bin", b), ("bin_offset", o), ("bin_length", f)):
            column = pd.array([None] * len(shard), dtype="Int64")
            column[some] = values
            shard[name] = column
        shard["bin_tokens"] = shard.groupby("bin")["n_tokens"].transform("sum").astype("Int64") if some.any() else pd.array([None] * len(shard), dtype="Int64")
        return shard

    kind = sized.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece long, start long, n_tokens long, shard long, bin long, bin_offset long, bin_length long, bin_tokens long"
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)
