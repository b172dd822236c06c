"""Clashing column names, short benchmark items, repeated rows and bounded samples."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from palimpsest.llm import decontaminate, exact_dedup, langid, near_copies, packing, paragraphs, pii, simhash

NAMES = "doc_id long, text string, id string, row string, `__id` int, `__row` int, `__gone` int, key int, hash int, label int, n int, shard int, doc int, gone int"


def wide(spark, rows):
    return spark.createDataFrame([(*r, "i", "r", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for r in rows], NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = ["w%d" % k for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1] + " more"), (None, texts[2]), (5, None), (6, "")]
    return wide(spark, rows)


def test_stages_keep_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text[:200])], "item_id long, text string")
    for out, gone in (
        (exact_dedup.drop_exact_copies(docs), {100}), (near_copies.drop_near_copies(docs), {100, 101}), (simhash.drop_near_copies(docs), {100, 101}),
        (decontaminate.drop_contaminated(docs, items), {3}), (paragraphs.drop_repeats(docs), set()), (langid.keep_identified(docs, None), set()),
    ):
        assert out.columns == docs.columns and {r["__row"] for r in out.collect()} == {2}
        left = {r.doc_id for r in out.collect()}
        assert not gone & left and {1, 2, 4} <= left, gone


def test_one_and_two_shingle_items_are_all_found(spark):
    """Every item short enough to hide between the minima of a long document."""
    rng = random.Random(2)
    rows, items = [], []
    for k in range(300):
        words = [f"t{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((k, " ".join(words)))
        at = rng.randrange(390)
        items.append((k, " ".join(words[at : at + 5 + k % 3])))
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} >= {(k, k) for k in range(300)}


def test_empty_sides(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_equal_rows_are_dealt_to_many_shards(spark):
    df = spark.createDataFrame([(1, "a b c")] * 600 + [(None, "x y")] * 40, "doc_id long, text string")
    out = packing.packed(df, shard_rows=64).collect()
    shards = collections.Counter(r.shard for r in out)
    assert len(out) == 640 and max(shards.values()) < 128
    held = collections.defaultdict(int)
    for r in out:
        held[(r.shard, r.bin)] += r.n_tokens
    assert all(held[(r.shard, r.bin)] == r.bin_tokens <= r.bin_length for r in out)


def slow_pack(sizes, lengths, overhead):
    """Best fit over all open bins, the length with the least cost a token for a new one."""
    rooms, fills, out = [], [], []
    for k, size in enumerate(sizes):
        rest = sum(sizes[k + 1 :])
        fitting = [(room, b) for b, room in enumerate(rooms) if room >= size]
        if fitting:
            _, b = min(fitting)
        else:
            length = min((n for n in lengths if n >= size), key=lambda n: ((n + overhead) / (size + min(n - size, rest)), n))
            rooms.append(length)
            fills.append(0)
            b = len(rooms) - 1
        out.append((b, fills[b]))
        rooms[b] -= size
        fills[b] += size
    return [(b, at, min(n for n in lengths if n >= fills[b])) for b, at in out]


def test_packing_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 129) for _ in range(rng.randrange(0, 60))), reverse=True)
        got = [tuple(map(int, x)) for x in zip(*packing.pack(np.array(sizes, np.int64), (16, 32, 64, 128), 4), strict=True)]
        assert got == slow_pack(sizes, (16, 32, 64, 128), 4)


def test_pii_sample_of_a_small_share(spark, monkeypatch):
    """A share of the candidates far below a millionth still leaves rows to fit on."""
    seen = []
    plain = pii.materialize

    def run(df):
        out = plain(df)
        seen.append(out)
        return out

    texts = [(k, f"mail a{k}.b@host{k}.example.org or 10.0.{k % 200}.7 call +49 30 {1000000 + k} x {k}-{k}") for k in range(200)]
    monkeypatch.setattr(pii, "materialize", run)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    first = pii.find(docs).collect()
    second = pii.find(docs.repartition(7)).collect()
    assert sorted(first, key=lambda r: r.doc_id) == sorted(second, key=lambda r: r.doc_id) and len(seen) >= 2


def test_pii_learns_from_all_examples(spark, monkeypatch):
    """Before: from 20,000 of them, thresholds from the fifth of these."""
    seen, scored = [], []
    plain, least = pii.materialize, pii.least_scores
    text = " ".join(f"mail a{k}.b@host{k}.example.org or 10.0.{k}.7 ph +49 30 {1000000 + k} x {k}-{k}34-55{k} y" for k in range(100, 140))
    found = plain(pii.candidates(spark.createDataFrame([(k, text) for k in range(250)], "doc_id long, text string")))
    monkeypatch.setattr(pii, "materialize", lambda df: seen.append(plain(df)) or seen[-1])
    monkeypatch.setattr(pii, "least_scores", lambda df, precision: scored.append((df, precision)) or least(df, precision))
    trees, thresholds = pii.fit(found)
    one = found.select(F.expr("size(taught) + size(filter(broad, s -> not exists(base, b -> b.start < s.end and s.start < b.end)))").alias("n")).first().n
    assert 250 * one > 25_000 and seen[0].agg(F.sum("weight")).first()[0] == 250 * one
    assert len(thresholds) == 4 and trees and scored[0][0].agg(F.sum("weight")).first()[0] == one * found.where("pmod(xxhash64(id, 4), 5) = 0").count()


def test_thresholds_of_weighted_scores(spark):
    rows = [(0.0, 0.9, 1.0, 97.0), (0.0, 0.8, 0.0, 1.0), (0.0, 0.8 + 1e-12, 1.0, 2.0), (0.0, 0.7, 0.0, 5.0), (1.0, 0.5, 0.0, 3.0), (2.0, 0.3, 1.0, 1.0)]
    got = pii.least_scores(spark.createDataFrame(rows, "kind double, p double, label double, weight double"), 0.98)
    assert got == [0.8 - 1e-9, 2.0, 0.3 - 1e-9, 2.0]


def test_long_lists_of_spans(spark):
    """Spans of a text with thousands of matches, and of one with as many as an array holds."""
    import re

    for n in (0, 1, pii.RUN, pii.RUN + 1, 3000):
        text = "".join(f"x{k} mail{k}@a.bc, " for k in range(n)) + "end"
        found = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
        assert [tuple(b) for b in found.base] == want and len(want) == n


def test_null_and_repeated_ids(spark):
    import public_tokenizers
    from palimpsest.llm import tokencount

    df = wide(spark, [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (1, None), (2, ""), (None, None)])
    groups = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(df).collect())
    same = {k[1] for k in groups if k[0] == 1} - {"0" * 16}
    assert sum(groups.values()) == 7 and len(same) == 1
    assert groups[(None, *same, 1)] == 2 and groups[(1, *same, 1)] == 2 and groups[(1, "0" * 16, 1)] == 1 and groups[(2, "0" * 16, 1)] == 1
    counts = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    tokens = next(n for d, b, n in counts if b == 9)
    assert counts == {(None, 9, tokens): 2, (1, 9, tokens): 2, (1, 0, 0): 1, (2, 0, 0): 1, (None, 0, 0): 1}
    exact = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert exact[(None, 1, 4, False)] == 2 and exact[(1, 1, 4, True)] == 2 and exact[(1, 1, 3, True)] == 1 and exact[(None, 1, 3, False)] == 1
    shards = packing.packed(df).collect()
    assert len(shards) == 7 and sum(r.n_tokens for r in shards) == 20
