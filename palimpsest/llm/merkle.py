"""Merkle manifest of a table: a digest for every row, one for the whole, and the proof that links them.

Rows of one group (language) are the leaves of a tree, in the order of their ids; the groups' roots are the leaves of
the tree above. A tree is stored as blocks: aligned subtrees of ``2**HEIGHT`` leaves, whose roots are the leaves
of the blocks above, and so on. Within a block the nodes lie in van Emde Boas order: the upper half of the levels first,
then the subtrees below one after the other, each laid out likewise, so that a path touches few stretches of the
block whatever a cache line holds. Where a node lies is arithmetic on depth and number (``addresses``); building a block
and looking up siblings both go by it.

Spark orders the rows (ranges, not one task a group), numbers them by prefix sums of the ranges' sizes, gathers
blocks of at most ``2**HEIGHT`` rows, and goes up and down one level of blocks a step; 2**HEIGHT = 256 makes that four steps
for four billion rows. Nothing but counts of blocks comes to the driver.

Defined cases: null values count as ``-``, null groups are a group of their own, the first; null ids come first, rows of
one id are ordered by their digests, and equal rows are leaves of their own; an empty table gives an empty result; long texts
are hashed by Spark where they lie and never shuffled; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, ship_package

HEIGHT = 8
DIGEST = 64  # bytes, as lowercase hex
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value in UTF-8 behind its length in bytes, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


@functools.cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Where the nodes of each depth lie in a complete tree of ``height`` levels in van Emde Boas order."""
    if height == 1:
        return (np.zeros(1, np.int64),)
    upper = height // 2
    lower = height - upper
    below = addresses(lower)
    size = (1 << lower) - 1
    roots = (1 << upper) - 1 + size * np.arange(1 << upper)
    return addresses(upper) + tuple((roots[:, None] + part[None, :]).reshape(-1) for part in below)


def levels_above(n: int, alone: bool, height: int = HEIGHT) -> int:
    """How often the leaves of a block are hashed: until one is left, and a block among others up to its full height."""
    return max(0, (n - 1).bit_length()) if alone else height


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def build_block(leaves: list[bytes], alone: bool, full: int = HEIGHT) -> bytes:
    """The stored nodes of a block over these leaves; places of nodes that do not exist stay zero."""
    height = levels_above(len(leaves), alone, full)
    place = addresses(height + 1)
    out = bytearray(DIGEST * ((1 << (height + 1)) - 1))
    nodes = leaves
    for depth in range(height, -1, -1):
        at = place[depth].tolist()
        for k, node in enumerate(nodes):
            out[at[k] * DIGEST : (at[k] + 1) * DIGEST] = node
        nodes = [parent(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return bytes(out)


def block_paths(nodes: bytes, n: int) -> list[list[str]]:
    """Of each leaf of a block the steps to the block's root: the sibling's side and digest, or - where there is none."""
    height = (len(nodes) // DIGEST + 1).bit_length() - 2
    place = addresses(height + 1)
    steps: list[list[str]] = [[] for _ in range(n)]
    for up in range(height):
        at, count = place[height - up].tolist(), -(-n >> up) if up else n
        text = [nodes[at[k] * DIGEST : (at[k] + 1) * DIGEST].decode() for k in range(count)]
        for k in range(n):
            own = k >> up
            beside = own ^ 1
            steps[k].append("-" if beside >= count else ("L" if own & 1 else "R") + text[beside])
    return steps


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    side = lambda s: s.substr(F.lit(1), F.lit(1))
    other = lambda s: s.substr(F.lit(2), F.lit(DIGEST))
    both = lambda own, s: F.when(side(s) == "L", F.concat(other(s), own)).when(side(s) == "R", F.concat(own, other(s))).otherwise(own)
    return F.aggregate(path, start, lambda own, s: F.sha2(both(own, s).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """The digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.when(s == "-", "").otherwise(s.substr(F.lit(2), F.lit(DIGEST)))), "")


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows``, a written table, with tree (a number that grows with the group), pos (in the group's order) and total.

    Ranges are cut by all of ``order`` and a draw, so that neither a group nor repeated rows end up in one task.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("draw").asc()]
    spread = rows.withColumn("draw", F.rand(5))
    cut = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("draw")
    place = F.monotonically_increasing_id()
    cut = materialize(cut.withColumn("part", F.shiftright(place, 33)).withColumn("row", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = cut.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    whole = sizes.groupBy("part").agg(F.sum("n").alias("in_part"))
    # One row a range: the number of ranges, not of rows, bounds this window and the next.
    before = whole.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    own = Window.partitionBy(group)
    sizes = sizes.join(before, "part").withColumn("begin", F.col("before") + F.col("first"))
    sizes = materialize(sizes.select("part", F.col(group).alias("g"), (F.col("begin") - F.col("first")).alias("shift"), F.min("begin").over(own).alias("tree"), F.sum("n").over(own).alias("total")))
    found = cut.join(sizes.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return found.select(*[c for c in rows.columns], "tree", (F.col("shift") + F.col("row") - F.col("tree")).alias("pos"), "total")


def _blocks(nodes: DataFrame, keep: list[str], height: int) -> DataFrame:
    """Blocks over (tree, pos, total, digest): tree, block, total, entries (in order), nodes, root; written."""
    entry = F.struct("pos", "digest", *keep)
    rows = nodes.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(entry)).alias("entries"))
    leaves = F.transform("entries", lambda e: e.digest)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored, roots = [], []
            for own, total in zip(b.column("leaves").to_pylist(), b.column("total").to_pylist(), strict=True):
                block = build_block([d.encode() for d in own], total <= 1 << height, height)
                stored.append(block)
                roots.append(block[:DIGEST].decode())  # a root lies first in any layout
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("tree", "block", "total", "entries")], pa.array(stored, pa.binary()), pa.array(roots, pa.string())], names=["tree", "block", "total", "entries", "nodes", "root"])

    kind = rows.schema["entries"].dataType.simpleString()
    return materialize(rows.withColumn("leaves", leaves).mapInArrow(build, f"tree long, block long, total long, entries {kind}, nodes binary, root string"))


def _forest(nodes: DataFrame, keep: list[str], height: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks from the leaves upwards, and (tree, root)."""
    levels, roots, width = [_blocks(nodes, keep, height)], None, 1 << height
    while True:
        top = levels[-1]
        done = top.where(F.col("total") <= width).select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        rest = top.where(F.col("total") > width)
        if rest.isEmpty():
            return levels, roots
        up = rest.select("tree", F.col("block").alias("pos"), F.shiftright(F.col("total") + (width - 1), height).alias("total"), F.col("root").alias("digest"))
        levels.append(_blocks(up, [], height))


def _paths(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(tree, pos, path, *keep) of every leaf of the blocks: the way within the block, then the block's own path."""
    kinds = dict(blocks.selectExpr("entries[0] AS e").select("e.*").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                entries = b.column("entries").slice(k, 1).flatten()
                own = b.column("path")[k].as_py()
                paths = [steps + own for steps in block_paths(b.column("nodes")[k].as_py(), len(entries))]
                tree = pa.array([b.column("tree")[k].as_py()] * len(entries), pa.int64())
                columns = [tree, pa.array(paths, pa.list_(pa.string())), *[entries.field(c) for c in ("pos", "digest", *keep)]]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "path", "pos", "digest", *keep])

    return blocks.select("tree", "entries", "nodes", "path").mapInArrow(run, ", ".join(["tree long, path array<string>, pos long, digest string", *[f"`{c}` {kinds[c]}" for c in keep]]))


def _opened(levels: list[DataFrame], top: DataFrame, keep: list[str], height: int) -> DataFrame:
    """The paths of all leaves; ``top``: (tree, path) of the trees' roots."""
    above, found, width = None, None, 1 << height
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k]
        if above is not None:
            inner = blocks.where(F.col("total") > width).join(above.select("tree", F.col("pos").alias("block"), "path"), ["tree", "block"])
        roots = blocks.where(F.col("total") <= width).join(top, "tree")
        with_path = roots if above is None else roots.unionByName(inner.select(roots.columns))
        found = _paths(with_path, keep if k == 0 else [])
        above = materialize(found) if k else None
    return found


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", keep: tuple[str, ...] = (), height: int = HEIGHT) -> DataFrame:
    """id, leaf, subroot, root and path (the steps from the leaf to the root), and the narrow columns ``keep``.

    ``folded(leaf, path)`` is the root for every row that is what it was when the manifest was made. ``height``: of blocks.
    """
    ship_package(docs.sparkSession)
    kept = [f"kept_{k}" for k in range(len(keep))]
    col = lambda c: F.col(f"`{c}`")
    rows = materialize(docs.select(col(id_col).alias("id"), col(group_col).alias("grp"), leaf(*[col(c) for c in fields]).alias("digest"), *[col(c).alias(k) for c, k in zip(keep, kept, strict=True)]))
    numbered = _numbered(rows, "grp", ["id", "digest"])
    levels, subroots = _forest(numbered, ["id", *kept], height)
    subroots = materialize(subroots)
    above = _numbered(materialize(subroots.select(F.lit(0).alias("grp"), F.col("tree").alias("of"), F.col("root").alias("digest"))), "grp", ["of"])
    top_levels, roots = _forest(above, ["of"], height)
    nothing = F.array().cast("array<string>")
    top = _opened(top_levels, roots.select("tree", nothing.alias("path")), ["of"], height)
    root = roots.select(F.col("root"))
    top = materialize(top.crossJoin(F.broadcast(root)).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))  # one row: the root
    found = _opened(levels, top.select("tree", "path"), ["id", *kept], height)
    found = found.join(top.select("tree", "subroot", "root"), "tree")
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with the leaf each row would have after a seventh of the rows, chosen by the id's hash, had one more
    character counted: doc_id, lang, and the columns of the leaf besides."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    n_chars = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return docs.select(*FIELDS, leaf(*[n_chars if c == "n_chars" else F.col(c) for c in FIELDS]).alias("tampered_leaf"))


def verification(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's digests, and what ``tampered`` rows fold to."""
    found = manifest(tampered(docs), keep=("tampered_leaf",), height=height)
    again = folded(F.col("tampered_leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 48) -> str:
    """The digests of ``verification`` in SQL: level after level of all trees, then a walk from each leaf to the root."""
    crc = """CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295) AS BIGINT)"""
    text = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    digest = lambda n: "sha256(" + " || ".join(text(n if c == "n_chars" else c) for c in FIELDS) + ")"
    changed = f"n_chars + CASE WHEN {crc} % 7 = 0 THEN 1 ELSE 0 END"
    climb = lambda name: f"""
        SELECT grp, CAST(lvl + 1 AS INTEGER), pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
        FROM {name} WHERE n > 1 AND lvl < {levels} GROUP BY grp, lvl, pos // 2, n"""  # noqa: E731
    walk = lambda tree, name: f"""
        SELECT w.doc_id, w.leaf, w.grp, w.lvl + 1, w.pos // 2, w.proof || coalesce(s.digest, ''),
               sha256(CASE WHEN w.pos % 2 = 1 THEN s.digest || w.own ELSE w.own || coalesce(s.digest, '') END)
        FROM {name} w JOIN {tree} t ON t.grp = w.grp AND t.lvl = w.lvl AND t.pos = w.pos AND t.n > 1
        LEFT JOIN {tree} s ON s.grp = w.grp AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)"""  # noqa: E731
    return f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS grp, {digest('n_chars')} AS leaf, {digest(changed)} AS changed
            FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
        lower_(grp, lvl, pos, digest, n) AS (SELECT grp, 0, pos, leaf, n FROM placed UNION ALL {climb('lower_')}),
        lower_tree AS MATERIALIZED (SELECT * FROM lower_),
        subroots AS MATERIALIZED (SELECT grp AS lang_grp, digest FROM lower_tree WHERE n = 1),
        upper_(grp, lvl, pos, digest, n) AS (
            SELECT 0::BIGINT, 0, lang_grp - 1, digest, count(*) OVER () FROM subroots UNION ALL {climb('upper_')}),
        upper_tree AS MATERIALIZED (SELECT * FROM upper_),
        first_(doc_id, leaf, grp, lvl, pos, proof, own) AS (SELECT doc_id, leaf, grp, 0, pos, '', changed FROM placed UNION ALL {walk('lower_tree', 'first_')}),
        first_done AS MATERIALIZED (SELECT * FROM first_ QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)),
        second_(doc_id, leaf, grp, lvl, pos, proof, own) AS (SELECT doc_id, leaf, 0::BIGINT, 0, grp - 1, proof, own FROM first_done UNION ALL {walk('upper_tree', 'second_')}),
        done AS MATERIALIZED (SELECT * FROM second_ QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)),
        top AS (SELECT digest AS root FROM upper_tree WHERE n = 1)
        SELECT d.doc_id, d.leaf, s.digest AS subroot, root, sha256(d.proof) AS proof_sha256, d.own AS folded_root, d.own = root AS verified
        FROM done d JOIN placed p USING (doc_id) JOIN subroots s ON s.lang_grp = p.grp CROSS JOIN top"""
