"""Sentences by what a corpus teaches about its periods, unsupervised (Kiss and Strunk, 2006).

A word is an abbreviation if a period follows it far more often than chance would have it, by a likelihood ratio that long
words and words seen without a period are marked down in. A word starts sentences if it follows sentence ends far more
often than chance, by another ratio. Both come from counts that Spark adds up, one row a word; texts are then split where
a period ends no abbreviation, or a sentence starter follows one. A single letter before a period is an initial.

What is looked at in a word is looked at once for each different word, and of words in their places only those with a sign
that can end a sentence. Both lists are held by the workers up to ``HELD_BYTES``, and texts are split where they are read:
neither words in their places nor texts are shuffled. Beyond it, and for texts in more than one row, words meet the lists by
joins and texts by their keys.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.scratch import scratch_folder

# Fixed values of the published method: how likely a period is behind an abbreviation, and the two thresholds.
AFTER_ABBREVIATION, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
_OUTSIDE = r"^[(\"'\[]+|[)\"',;:\]]+$"
_SPACE = r"[ \t\n\x0B\f\r]+"
#: Of each list that the workers hold, and of text that is split at a time.
HELD_BYTES, TEXT_AT_ONCE = 32_000_000, 1 << 22


def core(token: Column) -> Column:
    """A token without quotes, brackets and commas around it."""
    return F.regexp_replace(token, _OUTSIDE, "")


def tokens(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, pos, token, following): the words of each line, and the one behind in the same line."""
    lines = texts.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "said"))
    words = lines.select(*keys, "line", F.filter(F.split("said", r"\s+"), lambda w: w != "").alias("words"))
    each = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("token"), F.get("words", i + 1).alias("following")))
    return words.select(*keys, "line", F.explode(each).alias("t")).select(*keys, "line", "t.*")


def _typed(rows: DataFrame) -> DataFrame:
    """With type (lower-cased, without a final period) and period (whether it had one)."""
    c = core(F.col("token"))
    return rows.withColumn("period", c.endswith(".") & (F.length(c) > 1)).withColumn("type", F.lower(F.when(F.col("period"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)))


def _kept(df: DataFrame, name: str) -> DataFrame:
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _held(df: DataFrame) -> bool:
    """Whether a list of (type) may be sent to all workers."""
    return (df.agg(F.sum(F.octet_length("type") + 32)).first()[0] or 0) <= HELD_BYTES


def _type_counts(words: DataFrame) -> DataFrame:
    """(type, period, n) of (token, n)."""
    return _typed(words).groupBy("type", "period").agg(F.sum("n").alias("n"))


def type_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, period, n): the words of all texts, counted where they are read before they are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in _slices(b.column(0)):
                found = pc.value_counts(_words(b.column(0).slice(low, high - low))[0])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "token string, n long")
    return _type_counts(counted.groupBy("token").agg(F.sum("n").alias("n")))


def abbreviations(rows: DataFrame) -> DataFrame:
    """(type, score) of the words that are abbreviations, from the rows of ``tokens``."""
    return abbreviations_of(_type_counts(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))))


def abbreviations_of(types: DataFrame) -> DataFrame:
    """``abbreviations`` from the rows of ``type_counts``."""
    times = lambda said: F.sum(F.when(said, F.col("n")).otherwise(0))
    counts = types.where(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(times(F.col("period")).alias("with"), times(~F.col("period")).alias("without"))
    total = counts.agg(F.sum("with").alias("n_periods"), F.sum(F.col("with") + F.col("without")).alias("n"))
    scored = counts.where(F.col("with") > 0).join(F.broadcast(total), F.lit(True))
    share = F.col("n_periods") / F.col("n")
    share = F.least(share, F.lit(1 - 1e-9))
    plain = F.col("with") * F.ln(share) + F.col("without") * F.ln(1 - share)
    other = F.col("with") * F.ln(F.lit(AFTER_ABBREVIATION)) + F.col("without") * F.ln(F.lit(1 - AFTER_ABBREVIATION))
    ratio = -2 * (plain - other)
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - inner
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -F.col("without").cast("double"))
    return scored.withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("type", "score")


def _ends(rows: DataFrame, known: DataFrame) -> DataFrame:
    """With ``kind``: end (surely ends a sentence), short (an abbreviation), initial, or NULL."""
    marked = _typed(rows).join(known.select("type", F.lit(True).alias("short")), "type", "left")
    c = core(F.col("token"))
    kind = (
        F.when(c.rlike(r"[!?]$"), "end").when(~F.col("period"), None).when(F.col("type").rlike(r"^\p{L}$"), "initial")
        .when(c.endswith("...") | F.col("short"), "short").otherwise("end")
    )
    return marked.withColumn("kind", kind).drop("short")


def _may_end(token: Column) -> Column:
    return token.contains(".") | token.contains("!") | token.contains("?")


def starters(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(type, score) of the words that start sentences; ``known``: the abbreviations."""
    return starters_of(_type_counts(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))), rows.where(_may_end(F.col("token"))).select("token", "following"), known)


def starters_of(types: DataFrame, ends: DataFrame, known: DataFrame) -> DataFrame:
    """``starters`` from the rows of ``type_counts`` and (token, following) of the words that can end a sentence."""
    known = F.broadcast(known) if _held(known) else known
    ended = _ends(ends.where(F.col("following").isNotNull()), known).where(F.col("kind") == "end")
    behind = _typed(ended.groupBy(F.col("following").alias("token")).agg(F.count(F.lit(1)).alias("n")))
    first = _kept(behind.groupBy("type").agg(F.sum("n").alias("ab")), "behind")
    counts = types.where(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(F.sum("n").alias("b"))
    totals = types.agg(F.sum("n").alias("n")).join(first.agg(F.sum("ab").alias("a")), F.lit(True))
    s = counts.join(first, "type").join(F.broadcast(totals), F.lit(True))
    a, b, ab, n = (F.col(x).cast("double") for x in ("a", "b", "ab", "n"))
    log = lambda x: F.ln(F.greatest(x, F.lit(1e-300)))
    p, p1, p2 = b / n, ab / a, F.try_divide(b - ab, n - a)
    fit = lambda hits, misses, q: hits * log(q) + misses * log(1 - q)
    apart = F.when(a == ab, 0.0).otherwise(fit(ab, a - ab, p1)) + F.when(b == ab, 0.0).otherwise(F.coalesce(fit(b - ab, n - a - b + ab, p2), F.lit(0.0)))
    score = -2 * (fit(ab, a - ab, p) + fit(b - ab, n - a - b + ab, p) - apart)
    return s.withColumn("score", score).where((F.col("score") >= STARTER) & (n / a > b / ab)).select("type", "score")


def breaks(rows: DataFrame, known: DataFrame, first: DataFrame) -> DataFrame:
    """(keys.., line, pos, token, last): whether a sentence ends with the token."""
    ended = _ends(rows, known).drop("type", "period")
    following = core(F.col("following"))
    begins = first.select(F.col("type").alias("begin"), F.lit(True).alias("starts"))
    both = ended.withColumn("begin", F.lower(F.regexp_replace(following, r"\.$", ""))).join(begins, "begin", "left")
    opens = F.coalesce(following.rlike(r"^\p{Lu}") & F.col("starts"), F.lit(False))
    last = F.col("following").isNull() | (F.col("kind") == "end") | ((F.col("kind") == "short") & opens)
    return both.withColumn("last", F.coalesce(last, F.lit(False))).drop("begin", "starts", "kind", "following")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, the number of the text of each, and whether the next word is in the same line."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())
    words = pc.split_pattern_regex(lines.flatten(), _SPACE)
    line = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    words = words.flatten()
    some = pc.not_equal(words, "")
    words, line = words.filter(some), line[some.to_numpy(zero_copy_only=False)]
    return words, row[line], np.append(line[1:] == line[:-1], False)[: len(line)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    low = total = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > low and total + size > TEXT_AT_ONCE:
            yield low, k
            low, total = k, 0
        total += size
    yield low, len(texts)


def _mask(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, False).to_numpy(zero_copy_only=False)


def ends_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, following) of the words that can end a sentence and have one behind in their line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in _slices(b.column(0)):
                words, _, goes_on = _words(b.column(0).slice(low, high - low))
                at = np.flatnonzero(_mask(pc.match_substring_regex(words, "[.!?]")) & goes_on)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), words.take(pa.array(at + 1))], names=["token", "following"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "token string, following string")


def taught_by(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The abbreviations and the sentence starters of texts, each (type, score)."""
    types = _kept(type_counts(texts, text), "types")
    known = _kept(abbreviations_of(types), "abbreviations")
    return known, starters_of(types, ends_of(texts, text), known)


def _last(words: pa.Array, goes_on: np.ndarray, known: pa.Array, first: pa.Array) -> np.ndarray:
    """Whether a sentence ends with each word, as in ``breaks``."""
    last = ~goes_on
    at = np.flatnonzero(_mask(pc.match_substring_regex(words, "[.!?]")) & goes_on)
    c = pc.replace_substring_regex(words.take(pa.array(at)), _OUTSIDE, "")
    shout, period = _mask(pc.match_substring_regex(c, "[!?]$")), _mask(pc.and_(pc.ends_with(c, "."), pc.greater(pc.utf8_length(c), 1)))
    kind = pc.utf8_lower(pc.replace_substring_regex(c, r"\.$", ""))
    initial = _mask(pc.match_substring_regex(kind, r"^\p{L}$"))
    short = period & ~shout & ~initial & (_mask(pc.ends_with(c, "...")) | _mask(pc.is_in(kind, value_set=known)))
    last[at] = shout | (period & ~initial & ~short)
    at = at[short]
    following = pc.replace_substring_regex(words.take(pa.array(at + 1)), _OUTSIDE, "")
    begin = pc.utf8_lower(pc.replace_substring_regex(following, r"\.$", ""))
    last[at] = _mask(pc.match_substring_regex(following, r"^\p{Lu}")) & _mask(pc.is_in(begin, value_set=first))
    return last


def _split_held(texts: DataFrame, keys: list[str], text: str, known: DataFrame, first: DataFrame) -> DataFrame:
    """``split`` of texts in one row each, by lists that the workers hold."""
    lists = texts.sparkSession.sparkContext.broadcast([df.select("type").toArrow()["type"].combine_chunks() for df in (known, first)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in _slices(b.column("text_")):
                words, row, goes_on = _words(b.column("text_").slice(low, high - low))
                if not len(words):
                    continue
                last = _last(words, goes_on, *lists.value)
                new = np.append(True, row[1:] != row[:-1])  # the first word of a text
                begins = np.flatnonzero(np.append(True, last[:-1]) | new)
                alone = (np.diff(np.append(begins, len(words))) == 1) & ~new[begins]
                begins = begins[~alone]  # one of a single word is joined to the one before
                said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, len(words)), pa.int32()), words), " ")
                own = np.flatnonzero(new[begins])
                found = pa.ListArray.from_arrays(pa.array(np.append(own, len(begins)), pa.int32()), said)
                at = pa.array(row[begins[own]] + low)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), found], names=[*keys, "sentences"])

    kinds = dict(texts.dtypes)
    return texts.select(*keys, F.col(text).alias("text_")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "sentences array<string>"]))


def split(texts: DataFrame, keys: list[str], text: str = "text", taught: DataFrame | None = None) -> DataFrame:
    """(keys, sentences: array): words joined by one space; one of a single word is joined to the one before. Texts
    without words have no row. ``taught``: (text) to learn from, by default the texts themselves."""
    known, first = taught_by(texts, text) if taught is None else taught_by(taught)
    first = _kept(first, "starters")
    if not _held(known) or not _held(first):
        return _split_joined(texts, keys, text, known, first)
    again = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_")).where("rows_ > 1").select(*[F.col(k).alias(f"{k}_of") for k in keys])
    if again.isEmpty():
        return _split_held(texts, keys, text, known, first)
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    return _split_held(texts.join(again, same, "left_anti"), keys, text, known, first).unionByName(_split_joined(texts.join(again, same, "left_semi"), keys, text, known, first))


def _split_joined(texts: DataFrame, keys: list[str], text: str, known: DataFrame, first: DataFrame) -> DataFrame:
    """``split`` of texts in any number of rows, by lists of any size."""
    marked = breaks(tokens(texts, keys, text), known, first)
    per_text = marked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "pos", "token", "last"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["token"], F.when(x["last"], "\n").otherwise(" "))), "")
    parts = F.filter(F.split(joined, "\n"), lambda s: s != "")
    single = lambda s, i: (i > 0) & ~s.contains(" ")
    merged = F.filter(F.split(F.array_join(F.transform(parts, lambda s, i: F.concat(F.when(i == 0, "").when(single(s, i), " ").otherwise("\n"), s)), ""), "\n"), lambda s: s != "")
    return per_text.select(*keys, merged.alias("sentences"))
