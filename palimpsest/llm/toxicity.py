"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features of a text, each counted once: its words, its words cut to their first ``STEMS`` letters, pairs of neighbours,
and pairs with one or two words between them, as 64-bit hashes. FTRL-proximal learns one example at a time, with a learning rate
of its own for every coordinate, and its L1 term leaves most weights at exactly zero; the rest is a table of a few thousand
hashes and weights that every worker gets. As hashes are not folded into a small table, long texts do not hit weights by chance.

Fitted on a bounded sample: at most ``TRAIN_DOCS`` documents, half of them of either label if there are so many, of at most
``TRAIN_CHARS`` characters, outside the held-out fold; features seen in fewer than ``MIN_DOCS`` of them are left out. Scores
are calibrated on parts of the sample that a fit on the others had not seen, and moved to the share of toxic labels. Whole texts are scored, and nothing but text is read for that.

Defined cases: null and empty texts have no features and get the score of the bias; without a labelled document
all scores are 0; a document labelled several times is toxic if one label says so, null labels are left out; rows whose id is
null are scored, count as not held out and are not learned from; repeated rows get equal scores; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, ship_package

TRAIN_DOCS = 8000
TRAIN_CHARS = 20_000
MIN_DOCS = 3
STEMS = (4, 6)
SKIPS = (1, 2, 3)  # distance of the words of a pair
EPOCHS = 3
PARTS = 3  # of the sample, each scored by a fit on the others to calibrate
FOLDS = 5
_words = re.compile(r"[^\W_]+")
#: Odd multipliers, one a kind of feature.
_MIX = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1F123BB5 * k) for k in range(8)]


class Features:
    """Numbers of known hashes; most others are turned away by a table of their last bits."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.hashes, self.mask = np.sort(hashes), np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are known, and the numbers of those."""
        at = np.flatnonzero(self.seen[(hashes & self.mask).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), max(0, len(self.hashes) - 1))
        same = self.hashes[number] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[same], number[same]


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    bias: float


class Words:
    """Hashes of words and of their stems, kept for the words seen last."""

    def __init__(self, room: int = 1 << 17):
        self.room, self.number, self.rows = room, {}, []

    def of(self, words: list[str]) -> np.ndarray:
        """A row of hashes a word: the word's, then its stems' (0 where the word is not longer)."""
        if len(self.number) > self.room:
            self.number, self.rows = {}, []
        number, rows = self.number, self.rows
        ids = []
        for w in words:
            k = number.get(w)
            if k is None:
                k = number[w] = len(rows)
                rows.append([xxhash.xxh64_intdigest(w), *[xxhash.xxh64_intdigest(w[:s], seed=s) if len(w) > s else 0 for s in STEMS]])
            ids.append(k)
        return np.array(ids, np.int64)


def _texts_features(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features of the texts, repeats included, and whose they are."""
    split = [_words.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    ids = words.of([w for s in split for w in s])
    table = np.array(words.rows, np.uint64).reshape(-1, 1 + len(STEMS))[ids]
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes, owners = [table[:, 0]], [owner]
    for k in range(len(STEMS)):
        has = table[:, 1 + k] != 0
        hashes.append(table[has, 1 + k])
        owners.append(owner[has])
    for gap in SKIPS:
        together = owner[:-gap] == owner[gap:]
        mixed = table[:-gap, 0] * _MIX[0] + np.bitwise_xor(table[gap:, 0], table[gap:, 0] >> np.uint64(29)) * _MIX[gap]
        hashes.append(mixed[together])
        owners.append(owner[:-gap][together])
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_features(texts: list[str | None], words: Words, among: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of each text once, by text, then hash; ``among``: only these, and their numbers instead of hashes."""
    hashes, owner = _texts_features(texts, words)
    if among is not None:
        at, values = among.find(hashes)
        owner = owner[at]
    else:
        values = hashes
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], owner[fresh]


def _groups(texts: list[str | None], room: int = 1 << 21) -> Iterator[slice]:
    """Some megabytes of text at a time; a long text is a group of its own."""
    at = 0
    while at < len(texts):
        end, left = at, room
        while end < len(texts) and (end == at or left >= len(texts[end] or "")):
            left -= len(texts[end] or "")
            end += 1
        yield slice(at, end)
        at = end


def train(rows: list[np.ndarray], labels: np.ndarray, n: int, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, seed: int = 3) -> tuple[np.ndarray, float]:
    """FTRL-proximal over examples given as arrays of feature numbers below ``n``: weights, bias."""
    rng = np.random.default_rng(seed)
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)  # the last coordinate is the bias, without penalty
    rows = [np.append(r, n) for r in rows]

    def weights(at):
        zi = z[at]
        l1_at = np.where(at == n, 0.0, l1)
        w = -(zi - np.sign(zi) * l1_at) / ((beta + np.sqrt(g2[at])) / alpha + np.where(at == n, 0.0, l2))
        return np.where(np.abs(zi) <= l1_at, 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            at = rows[k]
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            before = g2[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            g2[at] = after
    w = weights(np.arange(n + 1))
    return w[:n], float(w[n])


def calibration(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that make margins log odds, by a damped logistic fit with smoothed targets."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda v: np.sum(np.logaddexp(0, v[0] * margins + v[1]) - target * (v[0] * margins + v[1])) + 0.5 * (v[0] - 1) ** 2
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -35, 35)))
        w = p * (1 - p)
        slope = np.array([np.sum((p - target) * margins) + at[0] - 1, np.sum(p - target)])
        curve = np.array([[np.sum(w * margins**2) + 1, np.sum(w * margins)], [np.sum(w * margins), np.sum(w) + 1e-6]])
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model fitted on at most ``train_docs`` labelled documents outside the held-out fold, or None without any."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    shares = {r.label: r.n for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    half = train_docs // 2
    wanted = {k: min(n, max(half, train_docs - shares.get(1 - k, 0))) for k, n in shares.items()}
    order = [F.xxhash64("id", F.lit(17)), F.col("id")]
    picked = None
    for k, n in sorted(wanted.items()):
        part = known.where((F.col("label") > 0) == bool(k)).orderBy(*order).limit(n).select("id", F.lit(k).alias("label"))
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text").between(1, TRAIN_CHARS))

    # Broadcast: at most train_docs narrow rows. Ids may repeat among the documents, hence the last limit.
    sample = texts.join(F.broadcast(picked), "id").select(F.xxhash64("id", "text", F.lit(18)).alias("key"), "label", "text")
    sample = materialize(sample.orderBy("key", "label").limit(train_docs))

    def listed(among: Features | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words()
            for b in batches:
                texts = b.column(2).to_pylist()
                for part in _groups(texts):
                    values, owner = distinct_features(texts[part], words, among)
                    sizes = np.bincount(owner, minlength=part.stop - part.start)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(k).slice(part.start, part.stop - part.start) for k in (0, 1)] + [lists], names=["key", "label", "features"])

        return sample.repartition("key").mapInArrow(run, "key long, label int, features array<long>")

    common = listed(None).select(F.explode("features").alias("f")).groupBy("f").count().where(F.col("count") >= MIN_DOCS).select("f")
    known_features = Features(common.toArrow().column(0).to_numpy().view(np.uint64))
    rows = listed(known_features).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    examples = [r.values.to_numpy() for r in rows.column("features")]
    y = rows.column("label").to_numpy()
    if not len(y):
        return None
    n = len(known_features.hashes)
    part, margins = np.arange(len(y)) % PARTS, np.zeros(len(y))
    for k in range(PARTS):
        weights, bias = train([e for e, j in zip(examples, part, strict=True) if j != k], y[part != k], n)
        margins[part == k] = [weights[e].sum() + bias for e, j in zip(examples, part, strict=True) if j == k]
    slope, shift = calibration(margins, y)
    weights, bias = train(examples, y, n)
    weights, bias = slope * weights, slope * bias + shift
    if 0 < y.sum() < len(y):
        bias += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    used = np.flatnonzero(weights)
    return Model(Features(known_features.hashes[used]), weights[used], bias)


def scores(model: Model | None, texts: list[str | None], words: Words) -> np.ndarray:
    out = np.zeros(len(texts))
    if model is None:
        return out
    for part in _groups(texts):
        number, owner = distinct_features(texts[part], words, model.features)
        total = np.bincount(owner, weights=model.weights[number], minlength=part.stop - part.start) + model.bias
        out[part] = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted per row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1).to_pylist(), words), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
