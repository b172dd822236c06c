"""Runs of repeated words: stretches that repeat with a period, found by internal pattern matching.

A stretch of at least four periods q holds an aligned block of 2^k words, 2^(k-1) < q <= 2^k, and that block occurs
again q words before or behind within the stretch. So every aligned block asks where it occurs in the windows
of its own length to both sides: its occurrences are a range of the suffix array, and the range successor of a
wavelet tree over that array gives the next position in a window. The occurrences in such a window form an arithmetic
progression, whose difference is the candidate period; the common extensions of the two copies give the stretch.
As blocks are not shorter than the period they propose, the difference to the nearest occurrence is the smallest period.

Texts are taken by batches: their words get codes that no two texts share, so that one suffix array serves many
texts and nothing matches across them. Memory of a task: some 200 bytes a word of the batch, that is ``BATCH_WORDS``
words or one text, whichever is more; blocks that occur once, nearly all of them, ask nothing.

Defined cases: null, empty and blank texts have no words and no runs, their collapsed text is empty; repeated rows get
equal results; ids may repeat or be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ship_package

BATCH_WORDS = 1 << 18
LEAST_LENGTH = 6
LEAST_PERIODS = 4
WORD = r"[^\x20\x09-\x0D]+"
_word = re.compile(WORD)


class WaveletTree:
    """Range successor over a permutation of 0..n-1, as a matrix of one row a bit."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(len(values)).bit_length())
        self.rows = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            values = np.concatenate([values[~one], values[one]])
            self.rows.append((bit, zeros, int(zeros[-1])))

    def count_below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(lo), np.int64)
        for bit, zeros, n_zeros in self.rows:
            one = (x >> bit) & 1 == 1
            lo0, hi0 = zeros[lo], zeros[hi]
            found += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, n_zeros + lo - lo0, lo0), np.where(one, n_zeros + hi - hi0, hi0)
        return found

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        found = np.zeros(len(lo), np.int64)
        for bit, zeros, n_zeros in self.rows:
            lo0, hi0 = zeros[lo], zeros[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            found |= np.where(one, 1 << bit, 0)
            lo, hi = np.where(one, n_zeros + lo - lo0, lo0), np.where(one, n_zeros + hi - hi0, hi0)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value of at least x in each range, or n."""
        below = self.count_below(lo, hi, x)
        out = np.full(len(lo), self.n, np.int64)
        some = np.flatnonzero(below < hi - lo)
        out[some] = self.nth(lo[some], hi[some], below[some])
        return out


def _ranked_levels(codes: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Prefix doubling: for each k the rank of the 2^k codes from every position on (how many positions come before all
    of that rank), and the positions that share theirs, with how many do. The last level is a suffix array's inverse."""
    n = len(codes)
    kind = np.int32 if n < 1 << 31 else np.int64
    levels, shared = [codes.astype(kind)], [(np.arange(n), np.zeros(n, np.int64))]
    rank, live, step = codes.astype(np.int64), np.arange(n), 1
    old = np.zeros(n, np.int64)  # the rank so far of the live positions: before round one they are all alike
    while len(live):
        ahead = np.zeros(len(live), np.int64)
        inside = live + step < n
        ahead[inside] = rank[live[inside] + step] + 1
        key = rank[live] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        live, key, old = live[order], key[order], old[order]
        at = np.arange(len(live))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        now = old + first - group
        if step == 1:
            rank = np.empty(n, np.int64)
        rank = rank.copy()
        rank[live] = now
        levels.append(rank.astype(kind))
        heads = np.flatnonzero(fresh)
        size = np.repeat(np.diff(np.concatenate([heads, [len(live)]])), np.diff(np.concatenate([heads, [len(live)]])))
        live, old, size = live[size > 1], now[size > 1], size[size > 1]
        shared.append((live, size))
        step *= 2
    return levels, shared


def find_runs(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of all maximal stretches of at least four smallest periods, by start, then period."""
    n, nothing = len(codes), np.zeros((0, 3), np.int64)
    if n < LEAST_LENGTH:
        return nothing
    levels, shared = _ranked_levels(codes)
    again, _ = shared[1]
    if not len(again):
        return nothing
    inverse = levels[-1].astype(np.int64)
    kept = np.zeros(n, bool)
    kept[inverse[again]] = True
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    by_position = np.sort(again)
    tree = WaveletTree(np.searchsorted(by_position, suffixes[kept]))
    place = np.concatenate([[0], np.cumsum(kept)])
    known = np.concatenate([by_position, [n + n]])  # what the tree's values stand for; the last is none

    def successor(lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        return known[tree.successor(lo, hi, np.searchsorted(by_position, x))]

    pairs = []
    for k in range(1, len(shared)):
        live, size = shared[k]
        aligned = live & ((1 << k) - 1) == 0
        i, size = live[aligned], size[aligned]
        if not len(i):
            continue
        lo = place[levels[k][i].astype(np.int64)]
        hi = lo + size
        left = successor(lo, hi, np.maximum(i - (1 << k), 0))
        some = np.flatnonzero(left < i)
        pairs.append((left[some], successor(lo[some], hi[some], left[some] + 1) - left[some]))
        gap = successor(lo, hi, i + 1) - i
        some = np.flatnonzero(gap <= 1 << k)
        pairs.append((i[some], gap[some]))
    if not pairs:
        return nothing
    pair = np.unique(np.concatenate([a * (n + 1) + d for a, d in pairs]))
    a, d = pair // (n + 1), pair % (n + 1)
    x, y = a.copy(), a + d
    for k in range(len(levels) - 1, -1, -1):  # the common extension to the right
        fits = y + (1 << k) <= n
        same = fits & (levels[k][x] == levels[k][np.where(fits, y, 0)])
        x, y = x + (same << k), y + (same << k)
    end = y
    x, y = a, a + d
    for k in range(len(levels) - 1, -1, -1):  # and to the left
        fits = x >= 1 << k
        same = fits & (levels[k][np.where(fits, x - (1 << k), 0)] == levels[k][np.where(fits, y - (1 << k), 0)])
        x, y = x - (same << k), y - (same << k)
    length = end - x
    ok = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * d)
    if not ok.any():
        return nothing
    return np.unique(np.stack([x[ok], d[ok], length[ok]], axis=1), axis=0)[:, [0, 2, 1]]


def collapse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each text: how many words and runs it has; then the runs of all in turn, with starts counted within
    the text, and each text without the words behind the first period of a run."""
    split = [_word.findall(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes, base = [], 0
    for words in split:
        seen: dict[str, int] = {}
        codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
    found = find_runs(np.concatenate(codes) if codes else np.zeros(0, np.int64))
    owner = np.searchsorted(offsets, found[:, 0], side="right") - 1
    depth = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(depth)[:-1] == 0
    n_runs = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    left = []
    for k, words in enumerate(split):
        if n_runs[k]:
            words = [w for w, stays in zip(words, keep[offsets[k] : offsets[k + 1]].tolist(), strict=True) if stays]
        left.append(" ".join(words))
    found = found.copy()
    found[:, 0] -= offsets[owner]
    return sizes, n_runs, found, left


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed, the text's words joined by one
    space without those behind the first period of a run; one row per row."""
    ship_package(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, room = at, 6 * BATCH_WORDS
                while end < len(texts) and (end == at or room >= len(texts[end] or "")):
                    room -= len(texts[end] or "")
                    end += 1
                sizes, n_runs, found, left = collapse(texts[at:end])
                runs = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(3)], fields=list(kind.value_type)),
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(sizes), runs.cast(kind), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])
                at = end

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(run, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a tail that repeats put into every tenth text, chosen by the id's hash h: from word a on the first
    p words of the tail again and again, a = g % n, p = 1 + (n - a) / (3 + g % 8), g = h / 10, of n words."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0))
    due = F.coalesce((h % 10 == 0) & (F.col(f"`{text_col}`").rlike(WORD)), F.lit(False))
    # The parts are columns of their own, in a struct whose name nothing else has, so that words are split once.
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), g.alias("g"), F.when(due, words).alias("words"))
    out = out.withColumn("n", F.size("words").cast("long"))
    out = out.withColumn("a", F.when(F.col("words").isNotNull(), F.col("g") % F.col("n")))
    out = out.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("long"))
    int_ = lambda c: c.cast("int")
    a, n, p = F.col("a"), F.col("n"), F.col("p")
    tail = F.flatten(F.array_repeat(F.slice("words", int_(a + 1), int_(p)), int_(F.ceil((n - a) / p))))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), int_(a)), F.slice(tail, F.lit(1), int_(n - a))), " ")
    text = F.when(F.col("words").isNull(), F.col("row")[text_col]).otherwise(again)
    return out.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the result of ``periodic_runs``: n_runs, the longest run (ties: smallest start, then period) and hashes."""
    first = lambda c: F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best))[c]
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        F.col(f"`{id_col}`"), F.size("runs").cast("long").alias("n_runs"), *[first(c).alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * first("length") / first("period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
