"""BM25 retrieval over an inverted index.

An index of at most ``HELD_BYTES`` is sent to every worker, where queries are scored where they are read: their tokens are
looked up, the postings of the tokens found are added up by query and text, and only a query's best texts go on. No row of a
query is shuffled, and memory is bounded by runs of queries of so many postings and sums.

A larger index is met by joins, with the queries' common tokens left aside until few texts are left.
Tokens of a query are counted, and each has a greatest weight in the index. The texts in which the query's most telling
tokens weigh most are scored first; their best score is a bound. The tokens with the least to give, as many as cannot
reach the bound together, do not propose texts: only the postings of the others, mostly rare tokens with short lists, are
joined. Of the texts they propose those that cannot reach the bound even with all the rest drop out, and the few left are
scored in full. Nothing that could be among the best is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.sources.scratch import scratch_folder

#: Sums of weights differ in their last digits with their order.
SLACK = 1e-5
#: Of an index that every worker holds; bytes of text looked up at a time; postings, and sums, that are held at a time.
HELD_BYTES, TEXT_AT_ONCE, AT_ONCE = 32_000_000, 1 << 22, 1 << 20


def index(demos: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(token, did, w) of (did, text): the weight of a token in a text. Tokens are what single spaces part; a negative idf
    is replaced by ``floor`` times the mean idf."""
    tokens = demos.select("did", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("token"))
    tf = tokens.groupBy("did", "token").agg(F.count(F.lit(1)).alias("tf"))
    length = tf.groupBy("did").agg(F.sum("tf").alias("dl"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    size = length.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    idf = df.join(F.broadcast(size), F.lit(True)).select("token", "avgdl", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean), F.lit(True)).select("token", "avgdl", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(length, "did").join(idf, "token").select("token", "did", weight.alias("w"))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """(qid, token, times) of (qid, text)."""
    return queries.select("qid", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))


def scored(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, did, score) of given (qid, did)."""
    return pairs.join(asked, "qid").join(postings, ["token", "did"]).groupBy("qid", "did").agg(F.sum(F.col("times") * F.col("w")).alias("score"))


def proposed(asked: DataFrame, postings: DataFrame, top: int = 1) -> tuple[DataFrame, DataFrame]:
    """The postings joined for the queries, (qid, did, part), and of their texts those that may be among the ``top`` best."""
    peak = postings.groupBy("token").agg(F.max("w").alias("peak"), F.max_by("did", F.struct("w", "did")).alias("champion"))
    known = asked.join(peak, "token").withColumn("most", F.greatest(F.lit(0.0), F.col("times") * F.col("peak")))
    telling = Window.partitionBy("qid").orderBy(F.desc("most"), "token")
    champions = known.withColumn("nth", F.row_number().over(telling)).where(F.col("nth") <= 2 * top).select("qid", F.col("champion").alias("did")).distinct()
    ranked = scored(champions, asked, postings).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
    bound = ranked.where(F.col("nth") == top).select("qid", F.col("score").alias("bound"))
    known = known.join(bound, "qid", "left")
    upto = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "token"))
    known = known.withColumn("least", F.col("bound").isNotNull() & (upto < F.col("bound") - SLACK))
    rest = known.groupBy("qid").agg(F.sum(F.when(F.col("least"), F.col("most")).otherwise(0.0)).alias("rest"), F.first("bound").alias("bound"))
    joined = known.where("not least").select("qid", "token", "times").join(postings, "token").select("qid", "did", (F.col("times") * F.col("w")).alias("part"))
    sums = joined.groupBy("qid", "did").agg(F.sum("part").alias("part")).join(rest, "qid")
    return joined, sums.where(F.col("bound").isNull() | (F.col("part") + F.col("rest") >= F.col("bound") - SLACK)).select("qid", "did")


class Postings(NamedTuple):
    """An index by number: token ``k`` has the texts ``text[starts[k]:starts[k + 1]]`` with ``weight``; texts in the order of did."""

    tokens: pa.Array
    dids: pa.Array
    starts: np.ndarray
    text: np.ndarray
    weight: np.ndarray


def held_index(postings: DataFrame) -> Postings:
    found = postings.select("token", "did", "w").toArrow().combine_chunks()
    found = found.take(pc.sort_indices(found, sort_keys=[("token", "ascending"), ("did", "ascending")]))
    tokens, dids = found["token"].combine_chunks().dictionary_encode(), pc.unique(found["did"])
    dids = dids.take(pc.sort_indices(dids))
    token = tokens.indices.to_numpy()
    starts = np.searchsorted(token, np.arange(len(tokens.dictionary) + 1))
    return Postings(tokens.dictionary, dids, starts, pc.index_in(found["did"].combine_chunks(), value_set=dids).to_numpy(), found["w"].to_numpy())


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that add up to ``most`` or are one row."""
    low = total = 0
    for k, size in enumerate(sizes.tolist()):
        if k > low and total + size > most:
            yield low, k
            low, total = k, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def best_held(texts: pa.Array, index: Postings, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text, score) of the ``top`` best of each of ``texts`` and of those whose score may be the same to six digits."""
    n_tokens, n_texts, signed = len(index.tokens), len(index.dids), bool((index.weight <= 0).any())
    texts = pc.fill_null(texts, "")
    for first, last in _runs(pc.binary_length(texts).to_numpy(), TEXT_AT_ONCE):
        said = pc.split_pattern(texts.slice(first, last - first), " ")
        number = pc.fill_null(pc.index_in(said.flatten(), value_set=index.tokens), -1).to_numpy()
        row = np.repeat(np.arange(first, last), pc.list_value_length(said).to_numpy())[number >= 0]
        asked, times = np.unique(row * n_tokens + number[number >= 0], return_counts=True)
        row, number = np.divmod(asked, n_tokens)
        length = index.starts[number + 1] - index.starts[number]
        rows, begins = np.unique(row, return_index=True)
        ends = np.append(begins, len(row))
        work = np.add.reduceat(length, begins) if len(rows) else length
        for low, high in _runs(np.maximum(work, n_texts), AT_ONCE):
            part = slice(ends[low], ends[high])
            n = length[part]
            at = np.arange(n.sum()) + np.repeat(index.starts[number[part]] - (np.cumsum(n) - n), n)
            cell = np.repeat(np.searchsorted(rows[low:high], row[part]) * n_texts, n) + index.text[at]
            size = (high - low) * n_texts
            score = np.bincount(cell, np.repeat(times[part], n) * index.weight[at], size)
            score[(np.bincount(cell, minlength=size) if signed else score) <= 0] = -np.inf
            score = score.reshape(high - low, n_texts)
            least = np.partition(score, -top, axis=1)[:, -top] if top < n_texts else np.full(high - low, -np.inf)
            r, text = np.nonzero((score >= least[:, None] - SLACK) & (score > -np.inf))
            yield rows[low:high][r], text, score[r, text]


def _top_held(queries: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    """``bm25_top`` of queries whose qid is in one row, with an index that fits each worker."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(held_index(postings))
    kinds, kind = dict(queries.dtypes), dict(postings.dtypes)["did"]
    did_type = to_arrow_schema(postings.select("did").schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for rows, text, score in best_held(b.column("text"), index, top):
                own, begins = np.unique(rows, return_index=True)
                found = pa.StructArray.from_arrays([index.dids.take(pa.array(text)).cast(did_type), pa.array(score)], names=["did", "score"])
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(own)), pa.ListArray.from_arrays(pa.array(np.append(begins, len(rows)), pa.int32()), found)], names=["qid", "found"])

    found = queries.select("qid", "text").mapInArrow(run, f"qid {kinds['qid']}, found array<struct<did: {kind}, score: double>>")
    ranked = F.slice(F.array_sort(F.transform("found", lambda x: F.struct((-F.round(x["score"], 6)).alias("low"), x["did"].alias("did")))), 1, top)
    each = found.select("qid", F.posexplode(ranked).alias("pos", "x"))
    return each.select("qid", "x.did", (-F.col("x.low")).alias("score"), (F.col("pos") + 1).alias("rank"))


def _top_joined(queries: DataFrame, postings: DataFrame, top: int) -> DataFrame:
    asked = asked_tokens(queries)
    _, left = proposed(asked, postings, top)
    found = scored(left, asked, postings).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def bm25_top(queries: DataFrame, demos: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, top: int = 1) -> DataFrame:
    """(qid, text) x (did, text) -> qid, did, score, rank of the best demos; the smaller did on ties. Demos that share no
    token score 0 and can't be first unless none shares one; such queries get no row."""
    spark = queries.sparkSession
    folder = scratch_folder(spark, "postings")
    index(demos, k1, b, floor).write.parquet(folder)
    postings = spark.read.parquet(folder)
    size = postings.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + 16).alias("bytes")).first()
    if not size.n or size.bytes > HELD_BYTES:
        return _top_joined(queries, postings, top)
    again = queries.groupBy("qid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("qid").alias("again"))
    if again.isEmpty():
        return _top_held(queries, postings, top)
    same = F.col("qid").eqNullSafe(F.col("again"))  # their tokens count together
    together = _top_joined(queries.join(again, same, "left_semi"), postings, top)
    return _top_held(queries.join(again, same, "left_anti"), postings, top).unionByName(together)
