"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from svloom.llm import exact_dedup as ed
from svloom.llm import graph, simhash


def test_filter_inserts_deletes_and_overflows():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    f = ed.CuckooFilter(1024)
    assert all(f.insert(k) for k in keys)
    assert all(k in f for k in keys)
    assert sum(rng.getrandbits(64) in f for _ in range(5000)) < 25
    assert all(f.delete(k) for k in keys[:1000]) and f.size == 2000
    assert all(k in f for k in keys[1000:])
    small = ed.CuckooFilter(2, max_kicks=10)
    assert not all(small.insert(k) for k in keys[:50])


def test_index_resizes_from_stored_keys_and_verifies_hits():
    rng = random.Random(2)
    index = ed.DedupIndex(2)
    keys = [rng.getrandbits(64) for _ in range(500)]
    assert all(index.add(k, b"x%d" % k, 1) for k in keys)
    assert index.resizes and all(k in index.filter for k in keys)
    assert not index.add(keys[0], b"x%d" % keys[0], 5)
    assert index.add(keys[0], b"another text of the same digest", 7)
    assert {c: s for c, s in index.remove(keys[0])} == {b"x%d" % keys[0]: [5, 1, 2], b"another text of the same digest": [7, 1, 1]}
    assert index.entries == 499 and index.remove(keys[0]) == []


def test_report(odd, odd_rows):
    got = ed.dedup_report(odd).collect()
    by = {}
    for r in odd_rows:
        by.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(odd_rows)
    for r in got:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in by[text] if i is not None]
        assert r.group_size == len(by[text]) and r.keep_id == (max(ids) if ids else None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_rows_that_stay(odd, none):
    got = ed.exact_dedup(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([4, 5, 6, 7, 8, 9, 10, None, None])
    assert ed.exact_dedup(none).count() == 0 and ed.dedup_report(none).count() == 0


def test_partial_index_hands_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(ed, "PARTIAL_ENTRIES", 3)
    rows = [(i, f"t{i % 17}") for i in range(400)]
    got = ed.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.keep_id == max(i for i in range(400) if i % 17 == r.doc_id % 17) for r in got)


def fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if x]
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    n = Counter()
    for x in g:
        h = xxhash.xxh64_intdigest(x, 42)
        n.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(g))


def brute(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_lose_nothing(spark, tile):
    rng = random.Random(3)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.clusters(df, tile=tile).collect()}
    want = brute(fps)
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_kernel_distances(radius):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 2**63, (20, 64), dtype=np.uint64)
    q = f[:, 0].copy()
    for lane in range(30):
        f[:, lane] = q
        for u in range(20):
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                f[u, lane] ^= np.uint64(1) << np.uint64(b)
    got = simhash.near(q, simhash.vertical(f), radius)
    want = np.bitwise_count(f ^ q[:, None]) <= radius
    assert [[bool(int(w) >> lane & 1) for lane in range(64)] for w in got] == want.tolist()


def test_near_duplicates(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    fps = [fingerprint(r[1] or "") for r in odd_rows]
    comp = brute(fps)
    ids = {}
    for r, c in zip(odd_rows, comp, strict=True):
        if r[0] is not None:
            ids[c] = min(ids.get(c, r[0]), r[0])
    want = Counter((r[0], f, ids.get(c)) for r, f, c in zip(odd_rows, fps, comp, strict=True))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(ids.values()), None, None])
    assert simhash.near_dedup(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (5, None)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 131)}}
