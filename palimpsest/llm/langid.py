"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's highest response
in a window is kept, and a softmax layer reads those. A text's prediction is the mean over all its windows,
weighted by their bytes, so whole texts are read. The network is fitted on a bounded sample (``TRAIN_DOCS``
documents, spread evenly over the languages, ``TRAIN_WINDOWS`` windows each); nothing but text is an input.

Defined cases: null text or text without a letter is ``und`` with score 0; so is everything if there is no
labelled document to learn from; a short text is one window padded with zero bytes; rows whose doc_id is null
are predicted, count as not held out and are not learned from; repeated rows get equal predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, ship_package

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
TRAIN_DOCS = 4000
TRAIN_WINDOWS = 3
EPOCHS = 10
UNKNOWN = "und"
FOLDS = 5
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x filters, zero beyond a filter's own width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        """windows x positions x (widest * EMBED)."""
        e = self.embed[windows].reshape(len(windows), -1)
        wide = self.filters.shape[0]
        view = np.lib.stride_tricks.sliding_window_view(e, wide, axis=1)[:, :: self.embed.shape[1]]
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = self.unfold(windows)
        z = (u.reshape(-1, u.shape[2]) @ self.filters).reshape(u.shape[0], u.shape[1], -1)
        return np.maximum(z.max(1) + self.bias, 0), u, z

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows)[0] @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The text as rows of ``size`` bytes, the last one padded with zeros."""
    n = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def train(windows: np.ndarray, langs: list[str], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy of single windows."""
    rng = np.random.default_rng(seed)
    widest, n = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest * EMBED, n), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(langs, draw(256, EMBED, scale=0.5), draw(widest * EMBED, n, scale=0.3) * mask, np.zeros(n, np.float32), draw(n, len(langs), scale=0.3), np.zeros(len(langs), np.float32))
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick], labels[pick]
            hidden, u, z = net.pooled(x)
            logits = hidden @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            where = z.argmax(1)  # window x filter
            seen = u[np.arange(len(x))[:, None], where]  # window x filter x (widest * EMBED)
            g_filters = np.einsum("bf,bfk->kf", back, seen) * mask
            g_embed = np.zeros_like(net.embed)
            spread = (back[:, :, None] * net.filters.T[None]).reshape(len(x), n, widest, EMBED)
            hit = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(widest)]
            np.add.at(g_embed, hit, spread)
            t += 1
            for k, g in enumerate([g_embed, g_filters, back.sum(0), hidden.T @ p, p.sum(0)]):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each whole text, and its probability."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None:
        return langs, scores
    due = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    at = 0
    while at < len(due):  # some megabytes at a time; a long text is read in pieces of its own
        group, room = [], 1 << 20
        while at < len(due) and (not group or room > 0):
            raw = texts[due[at]].encode("utf-8", "surrogatepass")
            group.append((due[at], raw))
            room -= len(raw)
            at += 1
        parts = [windows_of(raw) for _, raw in group]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        weight = np.full(len(owner), float(WINDOW))
        weight[np.cumsum([len(p) for p in parts]) - 1] = [max(1, len(raw) - WINDOW * (len(p) - 1)) for (_, raw), p in zip(group, parts, strict=True)]
        rows = np.concatenate(parts)
        total = np.zeros((len(parts), len(net.langs)))
        for k in range(0, len(rows), 256):
            np.add.at(total, owner[k : k + 256], net.probabilities(rows[k : k + 256]) * weight[k : k + 256, None])
        total /= total.sum(1, keepdims=True)
        for (k, _), p in zip(group, total, strict=True):
            langs[k], scores[k] = net.langs[int(p.argmax())], float(p.max())
    return langs, np.minimum(scores, 1.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network fitted on at most ``train_docs`` labelled documents outside the held-out fold."""
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    counts = F.broadcast(counts) if 1000 * n_langs <= BROADCAST_BYTES else counts
    thinned = rows.join(counts, "lang").where(draw < F.lit(1.2 * train_docs / n_langs) / F.col("n"))
    start = lambda k: (F.pmod(F.xxhash64("id", F.lit(20 + k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int")
    pieces = F.array(*[F.substring(F.col("text"), start(k), F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)])
    sample = thinned.select("id", "lang", pieces.alias("pieces")).orderBy(F.xxhash64("id", F.lit(12)), "id", "lang").limit(train_docs).collect()
    langs = sorted({r.lang for r in sample})
    data = [(windows_of(p.encode("utf-8", "surrogatepass")[:WINDOW])[0], langs.index(r.lang)) for r in sample for p in r.pieces if _LETTER.search(p)]
    if not data:
        return None
    return train(np.stack([w for w, _ in data]), langs, np.array([y for _, y in data]))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score per row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(net, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: Network | None, text_col: str = "text", least_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least that score; all columns stay.

    Without a network (nothing was labelled) no text can be judged, and only those without a letter go.
    """
    names = docs.columns
    at = names.index(text_col)
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if net is None:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            else:
                langs, scores = predict(net, texts)
                keep = [x != UNKNOWN and s >= least_score for x, s in zip(langs, scores, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
