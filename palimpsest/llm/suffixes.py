"""Repeated byte strings across documents, by sparse distributed prefix doubling.

Ranks of all positions would be shuffled at each doubling, many times the text. Here positions carry names (64-bit
hashes that stand for ranks, formed by doubling: 1, 2, 4, 8, 16 and 24 bytes), and of the names of length 24 only
those are shuffled that are the least in some window of the threshold's length. A repeated window has the same least
name in both places. A run of windows that share it travels as that name and a print, the sum of second names of its
windows (both doubled on to the threshold). Where names are sorted (round one), runs whose name occurs in one document
only drop out, and a run whose name and print (128 bits) a smaller document has too is covered as a whole.
Only the first run of each print is left, and only if its name has several prints: the ends of repeated passages. Their
bytes are sent to where the name is sorted again; there names are doubled on to the threshold, and equal
windows, compared byte by byte, are ranked by document: all but those of the first document are covered (round two).
Rows are combined before each shuffle, and runs of names with many prints are dealt by their single windows instead (name
and second name of each, without bytes), so that no group is gathered in one task. Texts that are whole copies of an
earlier one drop out before.

Defined cases: ids are whole numbers (others raise); null text is empty; texts below the threshold have nothing
removed; a row whose doc_id is null is returned whole and covers nothing; rows that repeat a doc_id are judged each by
its own text and don't cover each other (they share the list of round one); matches are judged on the input; further columns of ``docs`` play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from palimpsest.llm.common import maybe_broadcast, materialize, release, ship_package

LENGTH, GRAM = 50, 24
#: Bytes worked on together; longer texts are cut with an overlap.
BLOCK = 1 << 21
#: Bytes named together.
PIECE = 1 << 14
#: Runs of a name with more prints than this, or more than that within a block, are dealt by single windows.
HOT_ROWS, HOT_IN_BLOCK = 256, 16
#: What becomes of a run: covered as a whole, sent with its bytes, sent window by window. Kept in a key's last two bits.
COVERED, SENT, HOT = 0, 1, 2
#: Pieces into which the rows of one text are dealt before they are summed up.
SALTS = 32
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)
_MORE = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
_KIND = np.uint64(3)


def _double(t: np.ndarray, by: int) -> np.ndarray:
    """Names of twice the length (or of any length that two overlapping names span)."""
    x = t[:-by] * _C1 + (t[by:] ^ (t[by:] >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def _doubled(t: np.ndarray, length: int) -> np.ndarray:
    n = 1
    while n < length and len(t) > 0:
        by = min(n, length - n)
        t = _double(t, by) if len(t) > by else t[:0]
        n += by
    return t


def _in_pieces(named: Callable[[np.ndarray], np.ndarray], data: np.ndarray, length: int) -> np.ndarray:
    """``named`` for pieces whose intermediate names stay in the processor's cache."""
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    for at in range(0, len(out), PIECE):
        out[at : at + PIECE] = named(data[at : at + PIECE + length - 1])
    return out


def names(data: np.ndarray, length: int) -> np.ndarray:
    """A name for each string of ``length`` bytes."""
    return _in_pieces(lambda piece: _doubled(_BYTES[piece], length), data, length)


def second_names(data: np.ndarray, length: int) -> np.ndarray:
    """Other names, from other numbers, whose sums tell sets of strings apart."""

    def named(piece: np.ndarray) -> np.ndarray:
        x = _doubled(_MORE[piece], length) * _C2
        x = (x ^ (x >> np.uint64(29))) * _C1
        return x ^ (x >> np.uint64(32))

    return _in_pieces(named, data, length)


def least_names(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` names in a row."""
    m, n = grams, 1
    while n < width:
        by = min(n, width - n)
        m = np.minimum(m[:-by], m[by:]) if len(m) > by else m[:0]
        n += by
    return m


class Block:
    """Some texts, or pieces of them, side by side, with the least names of their windows."""

    def __init__(self, rows: list[int], offsets: list[int], parts: list[np.ndarray], length: int, gram: int):
        self.length, self.gram = length, gram
        sizes = np.array([len(p) for p in parts], np.int64)
        self.data = np.concatenate(parts)
        self.rows, self.offsets = np.array(rows, np.int64), np.array(offsets, np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        n = max(0, len(self.data) - length + 1)
        self.part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[:n]
        self.valid = np.arange(n) + length <= ends[self.part]
        self.least = least_names(names(self.data, gram), length - gram + 1)[:n]
        self.second = second_names(self.data, length)
        self.sums = np.append(np.uint64(0), np.cumsum(self.second, dtype=np.uint64))

    def runs(self, wanted: np.ndarray, by_name: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last window of each run of wanted windows in one text (and with one least name)."""
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        same = np.zeros(len(wanted), bool)
        same[1:] = wanted[1:] & wanted[:-1] & (self.part[1:] == self.part[:-1])
        if by_name:
            same[1:] &= self.least[1:] == self.least[:-1]
        return np.flatnonzero(wanted & ~same), np.flatnonzero(wanted & ~np.append(same[1:], False)) + 1

    def within(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """The windows of these runs, of which no two begin or end together."""
        change = np.zeros(len(self.valid) + 1, np.int32)
        change[first] += 1
        change[past] -= 1
        return np.cumsum(change[:-1]) > 0

    def prints(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """A number for the windows of each run and how often each occurs there."""
        return self.sums[past] - self.sums[first] + (past - first).astype(np.uint64) * _C2

    def places(self, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row in the batch of each run, and the bytes it covers there."""
        part = self.part[first]
        start = first - self.starts[part] + self.offsets[part]
        return self.rows[part], start, start + past - first + self.length - 1


def _blocks(batch: pa.RecordBatch, text: int, length: int, gram: int) -> Iterator[Block]:
    """Blocks of the texts of a batch, in order."""
    rows, offsets, parts, size = [], [], [], 0
    for k, t in enumerate(batch.column(text)):
        raw = t.as_buffer()
        view = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        for at in range(0, max(1, len(view) - length + 1), BLOCK):
            piece = view[at : at + BLOCK + length - 1]
            if len(piece) < length:
                continue
            rows.append(k)
            offsets.append(at)
            parts.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield Block(rows, offsets, parts, length, gram)
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield Block(rows, offsets, parts, length, gram)


def _key(name: np.ndarray, mark: np.ndarray, kind: int) -> np.ndarray:
    """A run within its document, and what becomes of it."""
    x = (name ^ (mark >> np.uint64(31))) * _C1 + mark * _C2
    return ((x ^ (x >> np.uint64(32))) & ~_KIND) | np.uint64(kind)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _of_group(head: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the value of its group's head."""
    return values[np.flatnonzero(head)][np.cumsum(head) - 1]


#: Kinds of rows of round one: a run, a run of a name that is hot in its block, the note of such a name, a run known as covered.
_RUN, _HOT_RUN, _NOTE, _KNOWN = range(4)


def sampled_names(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, text) -> (name, mark, doc, kind): name and print of each run of windows.

    Equal runs of a block go on for the smallest doc only; of the others the block knows that they are covered and gives
    their key as name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for block in _blocks(b, 1, length, gram):
                first, past = block.runs(block.valid)
                name, mark, doc = block.least[first], block.prints(first, past), ids[block.rows[block.part[first]]]
                order = np.lexsort((doc, mark, name))
                by_name = name[order]
                new_name, head = _changes(by_name), _changes(by_name, mark[order])
                known = order[_changes(by_name, mark[order], doc[order]) & ~head]
                hot = np.add.reduceat(head, np.flatnonzero(new_name)) > HOT_IN_BLOCK if len(order) else np.zeros(0, bool)
                is_hot = hot[np.cumsum(new_name) - 1]
                usual, apart, noted = np.sort(order[head & ~is_hot]), np.sort(order[head & is_hot]), order[new_name & is_hot]
                every = np.concatenate([usual, apart, noted])
                kind = np.repeat(np.array([_RUN, _HOT_RUN, _NOTE, _KNOWN], np.int8), [len(usual), len(apart), len(noted), len(known)])
                out = [np.concatenate([name[every], _key(name[known], mark[known], COVERED)]).view(np.int64), np.concatenate([mark[every], np.zeros(len(known), np.uint64)]).view(np.int64), doc[np.concatenate([every, known])], kind]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["name", "mark", "doc", "kind"])

    return rows.select("doc", "text").mapInArrow(run, "name long, mark long, doc long, kind byte")


def _judged(name: np.ndarray, mark: np.ndarray, doc: np.ndarray, note: np.ndarray, all_hot: bool, hot_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, key) of the runs that are covered or have to be sent, among all runs of some names; ``note``: the name is
    hot elsewhere."""
    order = np.argsort(name, kind="stable")
    new = _changes(name[order])
    several = order[~new | ~np.append(new[1:], True)] if not all_hot else order
    order = several[np.lexsort((doc[several], mark[several], note[several], name[several]))]  # notes come last
    name, mark, doc, note = name[order], mark[order], doc[order], note[order]
    new, head = _changes(name), _changes(name, note, mark)
    if not len(name):
        return doc, name
    at = np.flatnonzero(new)
    prints = np.add.reduceat(head & ~note, at)
    hot = np.logical_or.reduceat(note, at) | (prints > hot_rows) | all_hot
    sends = hot | ((prints > 1) & (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)))
    of = np.cumsum(new) - 1
    covered = ~note & (doc > _of_group(head, doc)) & _changes(name, mark, doc)
    sent, windows = head & ~note & (sends & ~hot)[of], head & ~note & hot[of]
    keys = [_key(name[x], mark[x], kind) for x, kind in ((covered, COVERED), (sent, SENT), (windows, HOT))]
    return np.concatenate([doc[covered], doc[sent], doc[windows]]), np.concatenate(keys)


def repeated_runs(sampled: DataFrame) -> DataFrame:
    """-> (doc, key): the runs that are covered, and those of which single windows may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = []
        for b in batches:
            name, mark, doc, kind = (b.column(k).to_numpy() for k in range(4))
            known, rest = kind == _KNOWN, kind != _KNOWN
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(name[known])], names=["doc", "key"])
            gathered.append((name[rest].view(np.uint64), mark[rest].view(np.uint64), doc[rest], kind[rest]))
        if not gathered:
            return
        name, mark, doc, kind = (np.concatenate(x) for x in zip(*gathered, strict=True))
        gathered.clear()
        for apart in (False, True):
            own = (kind == _HOT_RUN) == apart
            docs, keys = _judged(name[own], mark[own], doc[own], kind[own] == _NOTE, apart, HOT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys.view(np.int64))], names=["doc", "key"])

    apart = F.when(F.col("kind") == _HOT_RUN, F.xxhash64("name", "mark")).when(F.col("kind") == _KNOWN, F.xxhash64("name", "doc"))
    return sampled.repartition(F.coalesce(apart, F.col("name"))).mapInArrow(run, "doc long, key long")


def _pair(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    x = row.astype(np.int64).view(np.uint64) * _C1 ^ name
    return (x ^ (x >> np.uint64(31))) * _C2


def _pairs_of(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """For each kind the sorted hashes of (row of the batch, run), for a column of keys."""
    lists = batch.column(column)
    of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    keys = lists.flatten().to_numpy().view(np.uint64)
    return [np.unique(_pair(of[own], keys[own] & ~_KIND)) for own in (keys & _KIND == kind for kind in (COVERED, SENT, HOT))]


def _known(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def window_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, row, text, keys) -> (route, mark, doc, row, start, stop, body): runs of windows that may be covered in part,
    with their bytes; single windows of hot names, with their second name; and, without route, covered stretches.

    Equal single windows of a block go on for the smallest doc only.
    """
    kinds = ["route", "mark", "doc", "row", "start", "stop", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_of, row_of, sets = b.column(0).to_numpy(), b.column(1).to_numpy(), _pairs_of(b, 3)
            for block in _blocks(b, 2, length, gram):

                def rows_of(first, past, route=None, mark=None, body=None, block=block):
                    at, start, stop = block.places(first, past)
                    lead = [pa.nulls(len(at), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (route, mark)]
                    return pa.RecordBatch.from_arrays([*lead, *map(pa.array, (doc_of[at], row_of[at], start, stop)), pa.nulls(len(at), pa.binary()) if body is None else pa.array(body, pa.binary())], names=kinds)

                first, past = block.runs(block.valid)
                key = _pair(block.rows[block.part[first]], _key(block.least[first], block.prints(first, past), 0))
                covered, sent, hot = (_known(s, key) for s in sets)
                if sent.any():
                    data = block.data.tobytes()
                    bodies = [data[x:y] for x, y in zip(first[sent].tolist(), (past[sent] + length - 1).tolist(), strict=True)]
                    yield rows_of(first[sent], past[sent], block.least[first[sent]], body=bodies)
                done = block.within(first[covered], past[covered])
                if hot.any():
                    each = np.flatnonzero(block.within(first[hot], past[hot]))
                    name, mark, doc = names(block.data, length)[each], block.second[each], doc_of[block.rows[block.part[each]]]
                    order = np.lexsort((doc, mark, name))
                    least = _of_group(_changes(name[order], mark[order]), doc[order])
                    goes = np.empty(len(each), bool)
                    goes[order] = doc[order] == least
                    done[each[~goes]] = True
                    yield rows_of(each[goes], each[goes] + 1, name[goes], mark[goes])
                if done.any():
                    yield rows_of(*block.runs(done, by_name=False))

    return rows.select("doc", "row", "text", "keys").mapInArrow(run, "route long, mark long, doc long, row long, start long, stop long, body binary")


def ranked_windows(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that start at ``at`` in an order in which equal ones are side by side, and where a new one begins.

    Names put equal windows side by side, and bytes tell whether neighbours are equal; should different windows have
    one name, the bytes themselves are sorted.
    """
    name = names(data, length)[at]
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 1 << 16):
        some = pairs[k : k + (1 << 16)]
        if (views[at[order[some]]] != views[at[order[some + 1]]]).any():
            return _ranked_by_bytes(views, at)
    return order, np.append(True, ~same)


def _ranked_by_bytes(views: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = [views[x].tobytes() for x in at.tolist()]
    order = np.array(sorted(range(len(held)), key=held.__getitem__), np.int64)
    return order, np.array([k == 0 or held[order[k]] != held[order[k - 1]] for k in range(len(order))])


def covered_runs(runs: DataFrame, length: int) -> DataFrame:
    """-> (doc, row, start, stop): stretches whose windows all occur in a document with a smaller id."""
    kinds = ["doc", "row", "start", "stop"]

    def judge_single(rows: pa.Table) -> list[pa.RecordBatch]:
        route, mark, doc = (rows.column(k).to_numpy() for k in ("route", "mark", "doc"))
        order = np.lexsort((doc, mark, route))
        later = np.sort(order[doc[order] > _of_group(_changes(route[order], mark[order]), doc[order])])
        return rows.select(kinds).take(pa.array(later)).combine_chunks().to_batches()

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        single = pc.is_null(rows.column("body"))
        if pc.any(single).as_py():
            yield from judge_single(rows.filter(single))
            rows = rows.filter(pc.invert(single))
        if rows.num_rows:
            yield judge_bodies(rows)

    def judge_bodies(rows: pa.Table) -> pa.RecordBatch:
        doc, own_row, start = (rows.column(k).to_numpy() for k in ("doc", "row", "start"))
        bodies = rows.column("body").combine_chunks()
        data = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8)
        size = pc.binary_length(bodies).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        n = len(data) - length + 1
        row = np.repeat(np.arange(len(size)), size)[:n]
        at = np.flatnonzero(np.arange(n) + length <= ends[row])
        row = row[at]
        order, head = ranked_windows(data, at, length)
        own = doc[row]
        least = np.minimum.reduceat(own[order], np.flatnonzero(head))[np.cumsum(head) - 1]
        hit = np.zeros(len(at), bool)
        hit[order] = least < own[order]
        same = np.zeros(len(at), bool)
        same[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
        first, last = np.flatnonzero(hit & ~same), np.flatnonzero(hit & ~np.append(same[1:], False))
        base = start[row[first]] - (ends - size)[row[first]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row[first]], own_row[row[first]], base + at[first], base + at[last] + length)], names=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wait = [], 0, BLOCK
        for b in batches:  # sorted by route: all groups but the last are whole
            known = b.column(0).is_null()
            if pc.any(known).as_py():
                yield pa.RecordBatch.from_arrays([b.column(k).filter(known) for k in (2, 3, 4, 5)], names=kinds)
                b = b.filter(pc.invert(known))
            held.append(b)
            size += b.nbytes
            if size < wait or not b.num_rows:
                continue
            rows = pa.Table.from_batches(held)
            route = rows.column("route").to_numpy()
            end = int(np.searchsorted(route, route[-1]))
            if end:
                yield from judge(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
            wait = max(BLOCK, 2 * size)  # a large group is not copied for each batch
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield from judge(rows)

    dealt = runs.repartition(F.coalesce("route", F.xxhash64("row", "start"))).sortWithinPartitions("route")
    return dealt.mapInArrow(run, "doc long, row long, start long, stop long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def whole_copies(rows: DataFrame, length: int) -> DataFrame:
    """(doc, row, n_bytes) of the texts, at least ``length`` long, that are equal to one with a smaller id.

    Every window of such a text starts in that document, so its row needs no search; and any window it could cover
    elsewhere the first of its kind covers too.
    """
    size = F.octet_length("text").cast("long")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    narrow = materialize(rows.where(size >= length).select("doc", "row", size.alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), salt.alias("salt")))
    part = materialize(narrow.groupBy("digest", "salt").agg(F.min("doc").alias("lo"), F.count(F.lit(1)).alias("n")))
    firsts = part.groupBy("digest").agg(F.min("lo").alias("first"), F.sum("n").alias("n")).where("n > 1")
    groups = materialize(part.select("digest", "salt").join(firsts, "digest").select("digest", "salt", "first"))
    return narrow.join(maybe_broadcast(groups, 64), ["digest", "salt"]).where("doc > first").select("doc", "row", "n_bytes")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, doc (the id as a long) and row (a hash of both): rows of one id are told apart by their texts."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; ids that order documents are whole numbers here")
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows as :func:`keyed` gives them -> (doc, row, spans): for those with any, the byte stretches (start, stop) to
    remove; they may overlap."""
    ship_package(rows.sparkSession)
    every = rows.select("doc", "row", "text").where("doc is not null and text is not null")
    copies = materialize(whole_copies(every, length))
    searched = every.join(maybe_broadcast(copies.select("doc", "row"), 40), ["doc", "row"], "left_anti")
    found = materialize(repeated_runs(sampled_names(searched, length, gram)))
    release(rows.sparkSession)
    lists = found.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    covered = materialize(covered_runs(window_runs(searched.join(lists.hint("shuffle_hash"), "doc"), length, gram), length))
    release(rows.sparkSession)
    every = covered.unionByName(copies.select("doc", "row", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return every.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cut(text, spans) -> tuple[bytes, list[tuple[int, int]]]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    gone = merged([(s["start"], s["stop"]) for s in spans or []])
    kept, at = [], 0
    for start, stop in gone:
        kept.append(raw[at:start])
        at = stop
    return b"".join([*kept, raw[at:]]), gone


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                kept, gone = _cut(text.as_py(), spans.as_py())
                n = sum(stop - start for start, stop in gone)
                out.append((len(kept) + n, n, len(gone), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram)
    kind = docs.schema[id_col].dataType.simpleString()
    both = rows.join(spans.hint("shuffle_hash"), ["doc", "row"], "left").select("id", "text", "spans")
    return both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
