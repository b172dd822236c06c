"""Periodic runs, toxicity and the Merkle manifest: brute force, held-out accuracy, and what each defines."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm import merkle, periodic, toxicity
from palimpsest.llm.common import table
from pyspark.sql import functions as F

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, tree string, runs int, row int, words int, label int, tampered_leaf int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5, 6) for r in rows], CLASHING)


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s:
                e = i + q
                if e - s >= max(6, 4 * q) and all(any(words[j] != words[j + p] for j in range(s, e - p)) for p in range(1, q)):
                    out.append((s, e - s, q))
            else:
                i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(0, 40), st.integers(0, 60))
def test_runs_against_brute_force(words, period, begin, tail):
    words = words[:begin] + [words[begin + k % period] for k in range(tail) if begin + k % period < len(words)] + words[begin:]
    assert [tuple(r) for r in periodic.find_runs(np.array(words, np.int64)).tolist()] == slow_runs(words)


def test_runs_of_long_periods():
    rng = random.Random(3)
    for period in (1, 2, 63, 64, 65, 500):
        root = [rng.randrange(1000) for _ in range(period)]
        words = [rng.randrange(1000) for _ in range(37)] + [root[k % period] for k in range(4 * period + 5)] + [rng.randrange(1000) for _ in range(11)]
        codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = [tuple(r) for r in periodic.find_runs(np.array([codes[w] for w in words])).tolist()]
        assert found == [r for r in slow_runs(words)] and found


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(200)
    tree = periodic.WaveletTree(values)
    lo = rng.integers(0, 200, 500)
    hi = np.minimum(200, lo + rng.integers(0, 60, 500))
    x = rng.integers(0, 200, 500)
    want = [min((v for v in values[a:b] if v >= c), default=200) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_periodic_query_against_brute_force(spark):
    rows = [r for r in table(spark, oracle.SF_DIR, "documents").select("doc_id", "text").collect()]
    from palimpsest.llm import registry

    got = {r.doc_id: r for r in registry.op12_periodic_runs(spark, oracle.SF_DIR).collect()}
    assert len(got) == len(rows) and any(r.n_runs for r in got.values())
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 1500:
            continue
        runs = slow_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want


def test_periodic_edges(spark):
    rows = [(1, None, None, None, None), (1, "", None, None, None), (None, " \t\n", None, None, None), (2, "a " * 9, None, None, None), (2, "a " * 9, None, None, None), (3, "b c d " * 50000 + "e", None, None, None)]
    found = periodic.periodic_runs(periodic.planted(clashing(spark, rows)).withColumn("text", F.col("text"))).collect()
    by = collections.Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs)) for r in found)
    assert len(found) == 6 and by[(1, 0, ())] == 2 and by[(None, 0, ())] == 1 and by[(2, 9, ((0, 9, 1),))] == 2
    plain = periodic.periodic_runs(clashing(spark, [rows[-1]])).first()
    assert [tuple(x) for x in plain.runs] == [(0, 150000, 3)] and plain.collapsed == "b c d e"
    empty = periodic.digests(periodic.periodic_runs(periodic.planted(clashing(spark, rows).limit(0))))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_runs"]


def test_toxicity_held_out(spark):
    """Toxic documents hold words of a list in forms the fit has not all seen."""
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    bad = [f"zork{e}" for e in ("", "a", "en", "ing", "ed", "ous")] + ["quux"]
    rows, labels = [], []
    for k in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((k, " ".join(words), "en", "s", None))
        labels.append((k, toxic))
    docs = clashing(spark, [*rows, (None, "zork zorking quux", None, None, None), (1, None, None, None, None), (1, "", None, None, None), (7777, "quux zorked " + "abc " * 200000, None, None, None)])
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.97 and sum(y for _, y in held) > 30
    assert [r.predicted for r in got if r.doc_id in (None, 7777)] == [1, 1]
    assert len({r.score for r in got if r.doc_id == 1}) == 2  # the text of its own row, and the two without features


def test_toxicity_edges(spark):
    docs = clashing(spark, [(k, "a b", None, None, None) for k in range(20)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}
    one_label = spark.createDataFrame([(k, 0) for k in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, one_label)).collect()} == {0}
    assert toxicity.score(docs.limit(0), None).count() == 0


def slow_manifest(rows):
    """(doc_id, lang, source, n_chars, text) -> per row its digests, by plain loops."""
    digest = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest(*map(field, (r[0], r[3], r[2], n, r[1])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r, r[4]), leaf(r, r[4] + 1 if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[4])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for k, (doc_id, own, changed) in enumerate(groups[g]):
            beside, fold = "", changed
            for tree, pos in ((trees[g], k), (top, at)):
                for nodes in tree[:-1]:
                    other = nodes[pos ^ 1] if pos ^ 1 < len(nodes) else ""
                    beside += other
                    fold = digest(other, fold) if pos & 1 else digest(fold, other)
                    pos >>= 1
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], digest(beside), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_of_many_blocks(spark):
    """Blocks of four leaves make several levels of blocks in the trees and above."""
    rows = [(k, f"text {k}", "ab" if k % 3 else None, "é" * (k % 4) or None, k if k % 5 else None) for k in range(300)]
    rows += [(k, "t", f"l{k}", None, 1) for k in range(1000, 1023)] + [(5000, "same", "ab", None, 2)] * 3 + [(None, None, "ab", None, None), (None, "x", None, None, 3)]
    got = [tuple(r) for r in merkle.verification(clashing(spark, rows).repartition(7), height=2).collect()]
    assert sorted(got, key=repr) == slow_manifest(rows)


@pytest.mark.parametrize("rows", [[(1, "a", None, None, None)], [(1, "a", "x", "s", 1), (2, None, "y", "s", 2)]])
def test_small_manifests(spark, rows):
    assert sorted(map(tuple, merkle.verification(clashing(spark, rows)).collect()), key=repr) == slow_manifest(rows)


def test_empty_manifest(spark):
    assert merkle.verification(clashing(spark, [(1, "a", None, None, None)]).limit(0)).count() == 0


def test_layout():
    """Places are those of all nodes once; a half-height subtree lies in one stretch."""
    for height in range(1, 10):
        place = merkle.addresses(height)
        assert sorted(np.concatenate(place).tolist()) == list(range(2**height - 1))
    place = merkle.addresses(6)
    below = [place[d][k] for d in range(3, 6) for k in range(5 << (d - 3), 6 << (d - 3))]
    assert max(below) - min(below) == 6
