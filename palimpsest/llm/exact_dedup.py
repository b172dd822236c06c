"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every row into a blocked Bloom filter that remembers which bits were hit more than once.
Pass two tests each row: one of whose bits was hit once only cannot have a copy and passes straight through;
only the rest are shuffled and grouped by SHA-256 of the normalised text. More rows than one filter of a bounded size
holds are parted by their digests, with a filter for each part. All of it is built-in functions.

Defined cases: null text counts as empty; equal texts are those equal after each run of ASCII white space is
one space; of equal texts the row with the smallest doc_id stays (null ids come last); rows that repeat both
id and text count in ``group_size`` and share the ``kept`` flag in :func:`exact_groups`, while
:func:`drop_exact_copies` returns one of them. Empty tables give empty results, further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, materialize

BITS_PER_BLOCK = 32768
BITS_PER_ROW = 32
#: Pieces into which the rows of one text are dealt before they are summed up.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slots(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest and its two bits there."""
    block = F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(blocks))
    bits = F.xxhash64(digest, F.lit(1))
    return block, [F.pmod(bits, F.lit(BITS_PER_BLOCK)), F.pmod(F.shiftrightunsigned(bits, 32), F.lit(BITS_PER_BLOCK))]


def _hit_bits(rows: DataFrame, blocks: int, least: int) -> DataFrame:
    """(block, bitmap) of the bits that at least so many rows hit."""
    block, bits = _slots(F.col("digest"), blocks)
    hit = rows.select(F.explode(F.array_distinct(F.array(*(block * BITS_PER_BLOCK + b for b in bits)))).alias("slot"))
    often = hit.groupBy("slot").count().where(F.col("count") >= least)
    return often.groupBy(F.floor(F.col("slot") / BITS_PER_BLOCK).alias("filter_block")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(BITS_PER_BLOCK))).alias("filter_bits"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1, F.lit(False))


def _blocks(n: int) -> int:
    return max(1, -(-n * BITS_PER_ROW // BITS_PER_BLOCK))


def _tested(rows: DataFrame, digests: DataFrame, n: int, least: int, filter_bytes: int) -> DataFrame:
    """``rows`` (with a column ``digest``) and ``maybe``: whether the filter over the ``n`` ``digests`` has their bits."""
    blocks = _blocks(n)
    bits = materialize(_hit_bits(digests, blocks, least))
    block, (one, two) = _slots(F.col("digest"), blocks)
    found = rows.join(F.broadcast(bits) if blocks * BITS_PER_BLOCK // 8 <= filter_bytes else bits, block == F.col("filter_block"), "left")
    return found.withColumn("maybe", _is_set(F.col("filter_bits"), one) & _is_set(F.col("filter_bits"), two)).drop("filter_block", "filter_bits")


def filters_for(n: int, filter_bytes: int) -> int:
    """How many filters of that size ``n`` digests take, a tenth left for parts of unequal size."""
    size = _blocks(n) * BITS_PER_BLOCK // 8
    return 1 if size <= filter_bytes else -(-size * 10 // (filter_bytes * 9))


def flag_possible_copies(digests: DataFrame, filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``digests``, a narrow written table, and ``maybe``: whether the filter allows that the digest repeats.

    A filter has 32 bits a row and is broadcast, so its size is bounded by ``filter_bytes``: more rows than that holds are
    parted by their digests, each part with a filter of its own, one after the other. Parts are folders each task writes
    its rows to, so no row that a filter clears is shuffled, whatever their number.
    """
    n = digests.count()
    parts = filters_for(n, filter_bytes)
    if parts == 1:
        return _tested(digests, digests, n, 2, filter_bytes)
    cut = materialize(digests.withColumn("filter_part", F.pmod(F.xxhash64("digest", F.lit(9)), F.lit(parts))), by="filter_part")
    out = None
    for p in range(parts):
        own = cut.where(F.col("filter_part") == p).drop("filter_part")
        found = materialize(_tested(own, own, own.count(), 2, filter_bytes))
        out = found if out is None else out.unionByName(found)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")))
    flagged = flag_possible_copies(rows, filter_bytes)
    alone = flagged.where("not maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    salt = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SALTS)).alias("salt")
    again = flagged.where("maybe").select("id", "digest", salt)
    part = materialize(again.groupBy("digest", "salt").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")))
    whole = part.groupBy("digest").agg(F.min("lo").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = part.select("digest", "salt").join(whole, "digest")
    grouped = again.join(groups, ["digest", "salt"]).select("id", "digest", "keep_id", "group_size")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` without later copies, with their columns; rows the filter clears don't shuffle.

    Up to what one filter holds, rows are tested against it. Beyond, the digests that do repeat are found among the narrow
    rows first, part by part, and texts are tested against a filter of those alone; it is broadcast while there are at most
    8.4 million of them (``filter_bytes`` of 32 MB), and joined by its blocks if there are more.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")
    digests = materialize(docs.select(digest))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest)
    n = digests.count()
    if filters_for(n, filter_bytes) == 1:
        flagged = _tested(packed, digests, n, 2, filter_bytes)
    else:
        repeated = materialize(flag_possible_copies(digests, filter_bytes).where("maybe").groupBy("digest").count().where("count > 1").select("digest"))
        flagged = _tested(packed, repeated, repeated.count(), 1, filter_bytes)
    alone = flagged.where("not maybe").select("row")
    first = flagged.where("maybe").groupBy("digest").agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"))).alias("row"))
    return alone.unionByName(first.select("row")).select("row.*")
