"""Near-duplicate paragraphs by MinHash banding, verified by exact Jaccard similarity.

Paragraphs are the lines of a text; a line of more than ``LONG`` words is cut behind each end of a sentence, so that a
passage inside a long line is found wherever the line begins. Equal pieces (after lower-casing A-Z and joining words
by one space) form a class; each class gets a MinHash signature of its five-word shingles, whose bands are tuned so
that a pair at the similarity threshold collides in some band almost surely. Colliding classes are verified by their
exact Jaccard similarity (see ``links``), and connected components of the verified links decide: of each component the
first piece, by doc_id and place, stays. Shingles are formed anew for the classes that collide, and not kept for all.

Pieces below ``MIN_WORDS`` words do not fill a shingle: they are returned, as their own class, and stay. Classes
are told apart by a 64-bit hash of their words.

Defined cases: null text is empty and has one empty paragraph; null doc_ids come after all others; rows that repeat a
doc_id are told apart by their texts, and rows equal in doc_id and text are judged alike; further columns of ``docs``
play no part and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, materialize, maybe_broadcast, row_key, ship_package
from palimpsest.llm.links import shingles, signatures, similar_components, tune
from palimpsest.llm.simhash import SEED

WORDS, SIMILARITY = 5, 0.8
MIN_WORDS = WORDS
LONG = 50
HASHES, RECALL = 24, 0.995
_SENTENCE_END = re.compile(rb"(?<=[.!?])[\x20\t]+")


def pieces(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(paragraph, piece, text with the white space behind it) of a text; joined by line breaks where the paragraph
    changes they make the text again."""
    for p, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line.split(None, LONG)) <= LONG:
            yield p, 0, line
            continue
        ends = [m.end() for m in _SENTENCE_END.finditer(line)]
        for k, (lo, hi) in enumerate(zip([0, *ends], [*ends, len(line)], strict=True)):
            yield p, k, line[lo:hi]


def class_key(words: list[bytes]) -> int:
    key = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return key - (key >> 63 << 64)


def paragraph_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int, words: int, bands: int, rows: int) -> DataFrame:
    """id, row, paragraph, piece, n_words, key, and, for the first of equal ones in a batch, sig (bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                owner, place, piece, count, keys, sets, which = [], [], [], [], [], [], []
                seen: set[int] = set()
                for k, t in enumerate(b.column(2)):
                    for p, q, said in pieces(t.as_py()):
                        w = said.lower().split()
                        owner.append(k)
                        place.append(p)
                        piece.append(q)
                        count.append(len(w))
                        key = class_key(w) if len(w) >= min_words else None
                        if key is not None and key not in seen:
                            seen.add(key)
                            sets.append(shingles(w, words))
                            which.append(len(owner) - 1)
                        keys.append(key)
                sig = [None] * len(owner)
                if sets:
                    for k, g in zip(which, signatures(sets, bands, rows).view("int64"), strict=True):
                        sig[k] = g
                of = pa.array(owner, pa.int32())
                arrays = [b.column(0).take(of), b.column(1).take(of), *(pa.array(x, pa.int32()) for x in (place, piece, count)), pa.array(keys, pa.int64()), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "paragraph", "piece", "n_words", "key", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, row long, paragraph int, piece int, n_words int, key long, sig array<long>")


def shingles_of(rows: DataFrame, words: int) -> DataFrame:
    """(text, keys) -> (key, sh): the shingles of those classes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found = {}
                for t, wanted in zip(whole.column(0).slice(at, 512), whole.column(1).slice(at, 512), strict=True):
                    left = set(wanted.as_py())
                    for _, _, said in pieces(t.as_py()):
                        w = said.lower().split()
                        key = class_key(w) if w else None
                        if key in left:
                            left.discard(key)
                            found[key] = shingles(w, words).view("int64")
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], names=["key", "sh"])

    return rows.select("text", "keys").mapInArrow(run, "key long, sh array<long>")


def near_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per piece: id, paragraph, piece, n_words, n_removed (words), first_<id>, first_paragraph, first_piece (of
    its component), removed."""
    return _judged(docs, id_col, text_col, min_words, words, similarity).drop("row")


def _judged(docs: DataFrame, id_col: str, text_col: str, min_words: int, words: int, similarity: float) -> DataFrame:
    ship_package(docs.sparkSession)
    bands, rows = tune(similarity, HASHES, RECALL)
    every = materialize(paragraph_rows(docs, id_col, text_col, min_words, words, bands, rows))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "paragraph", "piece")
    classes = materialize(every.where("key is not null").groupBy("key").agg(F.min(place).alias("first"), F.first("sig", ignorenulls=True).alias("sig"), F.count(F.lit(1)).alias("n")))

    def sets_of(met: DataFrame) -> DataFrame:
        owners = materialize(met.join(classes, "key").select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row"), "key"))
        wanted = owners.groupBy("__id", "__row").agg(F.collect_list("key").alias("keys"))
        wanted = F.broadcast(wanted) if 64 * owners.count() <= BROADCAST_BYTES else wanted  # lists of keys, in all as many as there are owners
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
        own = texts.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("text", "keys")
        return shingles_of(own, words).groupBy("key").agg(F.first("sh").alias("sh"))

    labels = similar_components(classes.select("key", F.posexplode("sig").alias("band", "hash")), sets_of, similarity)
    named = classes.select("key", "first", "n")
    named = named.withColumn("label", F.col("key")) if labels is None else named.join(labels, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("label", "key").alias("label"), "n")
    named = materialize(named)
    groups = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("all")).where("all > 1")
    kept = materialize(named.select("key", "label").join(groups, "label").select("key", "first"))
    out = every.drop("sig").join(maybe_broadcast(kept, 96), "key", "left")
    first = F.coalesce("first", place)
    removed = ~first.eqNullSafe(place)
    return out.select(
        F.col("id").alias(id_col), "row", "paragraph", "piece", "n_words", F.when(removed, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        first["id"].alias(f"first_{id_col}"), first["paragraph"].alias("first_paragraph"), first["piece"].alias("first_piece"), removed.alias("removed"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the removed pieces cut from the text, and lines that have nothing else; all rows and columns stay."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None else _without(t, {(x["paragraph"], x["piece"]) for x in g}) for t, g in zip(texts, gone, strict=True)])

    gone = _judged(docs, id_col, text_col, min_words, words, similarity).where(F.col("removed") & F.col(id_col).isNotNull())
    gone = gone.groupBy(F.col(id_col).alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set(F.struct("paragraph", "piece")).alias("gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(id_col, text_col).alias("own_row"))
    same = (F.col("doc")[id_col] == F.col("gone_id")) & (F.col("own_row") == F.col("gone_row"))
    text = F.when(F.col("gone").isNull(), F.col("doc")[text_col]).otherwise(cut(F.col("doc")[text_col], "gone"))
    return packed.join(gone, same, "left").select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def _without(text: str | None, gone: set[tuple[int, int]]) -> str | None:
    lines: dict[int, list[bytes]] = {}
    for p, q, said in pieces(text):
        if (p, q) not in gone:
            lines.setdefault(p, []).append(said)
    return b"\n".join(b"".join(x) for x in lines.values()).decode("utf-8", "surrogatepass")
