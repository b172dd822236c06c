"""Token counts of whole texts by a compiled transducer.

Texts are cut into chunks of a fixed length, and all chunks of a batch step through the transducer together. A
chunk's state map takes a state it is entered in to the state it is left in and the pieces added. Every chunk is first
run from its likely entry state; then each learns what it does in the states its predecessor is known to leave, all
chunks at once, until each map knows every state that reaches it; a state that keeps coming is tried on all chunks. Mostly one round is enough, as a space after a word
leads every state to the same one. Known maps compose, and a text's chunks are joined by a parallel prefix scan: in each
of its rounds the composed stretches double. Texts that reach more states than ``CLOSING`` rounds find are then followed
along the one path from their beginning.

States are compiled on the driver over a bounded sample (``WARM_DOCS`` texts) and broadcast, if within the bound for
that; workers compile what is missing. The sample has no part in the counts.

Defined cases: null text is empty and has no tokens; long texts are never cut off; ties and repeated rows do
not interact, each row is counted by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, ship_package
from palimpsest.llm.transducer import SPACE, PieceTransducer

CHUNK = 256
LIMIT = 4096
#: Code points stepped through together, which bounds a task's memory whatever the batch.
BLOCK = 1 << 21
#: Rounds in which the maps learn the states that reach them.
CLOSING = 32
#: After so many rounds a state that is new to a text is tried on all its chunks at once, for so many states of a text.
ALONE, OFFERS = 2, 16
WARM_DOCS, WARM_CHARS = 200, 20_000


def count_pieces(fsm: PieceTransducer, texts: list[str]) -> np.ndarray:
    """Pieces of each text, each with a space put before it unless empty."""
    out = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, room = at, BLOCK
        while end < len(texts) and (end == at or room >= len(texts[end])):
            room -= len(texts[end])
            end += 1
        out[at:end] = _count_block(fsm, texts[at:end])
        at = end
    return out


def _count_block(fsm: PieceTransducer, texts: list[str]) -> np.ndarray:
    padded = [SPACE + t if t else "" for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    columns = fsm.columns_of(code)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    per_text = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(texts)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = offsets[owner] + nth * CHUNK
    length = np.minimum(CHUNK, offsets[owner + 1] - begin)

    entry = np.zeros(len(owner), np.int64)
    warm = np.flatnonzero(nth > 0)  # guess: what the last few characters before the chunk lead to
    state = np.zeros(len(warm), np.int64)
    for back in range(24, 0, -1):
        state, _ = fsm.step(state, columns[begin[warm] - back])
    entry[warm] = state
    leave, added = _run(fsm, columns, begin, length, entry)
    follows = np.append(nth[1:] > 0, False) if len(nth) else np.zeros(0, bool)  # whether a chunk of the same text comes next
    chunk, state, left, pieces = np.arange(len(owner)), entry, leave, added
    fresh = np.arange(len(chunk))  # the entries of the maps whose exits are not yet looked up in the next map
    offered = np.zeros(len(texts), np.int64)
    for round_ in range(CLOSING):
        wide = np.int64(len(fsm.states) + 1)
        on = fresh[follows[chunk[fresh]]]
        wanted = (chunk[on] + 1) * wide + left[on]
        if round_ >= ALONE:  # the same state may come far ahead, too
            unknown = on[~np.isin(wanted, chunk * wide + state)]
            news = np.unique(owner[chunk[unknown]] * wide + left[unknown])
            for text, s in zip((news // wide).tolist(), (news % wide).tolist(), strict=True):
                if offered[text] < OFFERS:
                    offered[text] += 1
                    begins = np.searchsorted(owner, text)
                    wanted = np.concatenate([wanted, np.arange(begins + 1, begins + per_text[text]) * wide + s])
        wanted = np.unique(wanted)
        wanted = wanted[~np.isin(wanted, chunk * wide + state)]
        if not len(wanted):
            return _composed(len(texts), owner, nth, follows, chunk, state, left, pieces, wide)
        fresh = np.arange(len(chunk), len(chunk) + len(wanted))
        at, into = wanted // wide, wanted % wide
        out, more = _run(fsm, columns, begin[at], length[at], into)
        chunk, state, left, pieces = np.concatenate([chunk, at]), np.concatenate([state, into]), np.concatenate([left, out]), np.concatenate([pieces, more])
    while True:
        due = np.flatnonzero((nth > 0) & (entry != np.roll(leave, 1)))
        if not len(due):
            break
        entry[due] = leave[due - 1]
        leave[due], added[due] = _run(fsm, columns, begin[due], length[due], entry[due])
    return np.bincount(owner, weights=added, minlength=len(texts)).astype(np.int64)


def _composed(n: int, owner: np.ndarray, nth: np.ndarray, follows: np.ndarray, chunk: np.ndarray, state: np.ndarray, left: np.ndarray, pieces: np.ndarray, wide: np.int64) -> np.ndarray:
    """Pieces of each text, by composing the chunks' maps over twice as many chunks in each round."""
    key = chunk * wide + state
    order = np.argsort(key)
    chunk, left, total, key = chunk[order], left[order], pieces[order], key[order]
    end = len(key)
    to = np.full(end + 1, end)  # where a map entry leads: an entry of the next chunk's map, or the end
    on = np.flatnonzero(follows[chunk])
    to[on] = np.searchsorted(key, (chunk[on] + 1) * wide + left[on])
    total = np.append(total, 0)
    for _ in range(max(1, int(nth.max(initial=0)) + 1).bit_length()):
        total = total + total[to]
        to = to[to]
    first = np.flatnonzero(nth == 0)
    out = np.zeros(n, np.int64)
    out[owner[first]] = total[np.searchsorted(key, first * wide + PieceTransducer.START)]
    return out


def _run(fsm: PieceTransducer, columns: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit states and added pieces of chunks entered in the given states."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    state, added = entry[order].copy(), np.zeros(len(order), np.int64)
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    for k, n in enumerate(live.tolist()):
        to, more = fsm.step(state[:n], columns[begin[:n] + k])
        state[:n] = to
        added[:n] += more
    out, total = np.empty_like(state), np.empty_like(added)
    out[order], total[order] = state, added
    return out, total


_compiled: dict[str, PieceTransducer] = {}


def transducer(model_file: str, tables: bytes | None = None) -> PieceTransducer:
    """One transducer a worker process, as compiling is what costs; it begins with the given tables."""
    if model_file not in _compiled:
        _compiled[model_file] = PieceTransducer(model_file)
        if tables is not None:
            _compiled[model_file].restore(tables)
    return _compiled[model_file]


def warm_tables(docs: DataFrame, model_file: str, text_col: str) -> bytes | None:
    """Tables compiled over some short texts, or None if they are too large to be broadcast."""
    some = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.length("text").between(1, WARM_CHARS)).limit(WARM_DOCS).collect()
    fsm = PieceTransducer(model_file)
    count_pieces(fsm, [r.text for r in some])
    tables = fsm.tables()
    return tables if len(tables) <= BROADCAST_BYTES else None


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row. ``model_file``: a path that every executor has."""
    ship_package(docs.sparkSession)

    tables = docs.sparkSession.sparkContext.broadcast(warm_tables(docs, model_file, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsm = transducer(model_file, tables.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = count_pieces(fsm, ["" if t is None else t for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
