"""Near copies by shingles against brute force, and the pipeline's stage on planted copies."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from svloom.llm import jaccard, simhash  # noqa: E402

from .conftest import words  # noqa: E402


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def planted():
    """(id, text, original): copies with substitutions spread out, similar from just under 0.8 to 0.95."""
    rng = random.Random(21)
    rows = []
    for i in range(60):
        base = words(rng, 300).split()
        rows.append((i, " ".join(base), None))
        copy = list(base)
        for k in range(1 + i % 8):
            copy[20 + 35 * k] = "zz" + words(rng, 1)
        rows.append((1000 + i, " ".join(copy), i))
    return rows


def components(texts, least=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or alike(texts[i], texts[j]) >= least:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_stage_drops_planted_copies(spark):
    rows = planted()
    text = {i: t for i, t, _ in rows}
    similar = {i: alike(text[i], text[o]) for i, _, o in rows if o is not None}
    assert sum(0.8 <= s <= 0.95 for s in similar.values()) > 30 and min(similar.values()) < 0.8
    gone = {i for i, _, o in rows if o is not None and similar[i] >= 0.8}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows} - gone


@pytest.mark.parametrize("tile", [8, 1024])
def test_components_against_brute_force(spark, monkeypatch, tile):
    """Chains of edits, a large group, and short texts; buckets of every size end in the same components."""
    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (tile, None))
    rng = random.Random(22)
    texts = ["", "a b", "A  b", "a c", "a b c d e", "a b c d e f"]
    for size in (40, 8, 8, 3):
        w = words(rng, 200).split()
        for k in range(size):
            texts.append(" ".join(w))
            w[(k * 41 + 7) % 200] = f"q{k}"
    texts = list(dict.fromkeys(texts))
    root = components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r.node: r.root for r in jaccard.joined(df, 0.8).collect()}
    groups = Counter((root[i], got.get(i, i)) for i in range(len(texts)))
    assert len(groups) == len(set(root)) == len({g for _, g in groups})


def test_rows_that_stay_with_similarity(odd, none):
    kept = jaccard.near_dedup(odd)
    assert kept.columns == odd.columns and jaccard.near_dedup(none).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, 6, 7, 8, None, None])


def test_a_large_group_of_copies_costs_few_comparisons(spark, monkeypatch):
    """Copies of one text that are often less than 0.8 alike among themselves: joined without comparing all with all."""
    rng = random.Random(23)
    base = words(rng, 120).split()
    texts = [" ".join(base)]
    for k in range(220):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"q{k}" + words(rng, 1)
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    seen = []
    plain = jaccard.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {r.node: r.root for r in jaccard.joined(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 0.8).collect()}
    root = components(texts)
    groups = Counter((root[i], got.get(i, i)) for i in range(len(texts)))
    assert len(groups) == len(set(root)) == len({g for _, g in groups})
    assert sum(seen) < 20 * len(texts)


def test_near_texts_that_are_not_similar_cost_no_rows(spark, monkeypatch):
    """Variants of one text, each a little less than 0.8 like any other, beside a few that are: all with all isn't verified."""
    rng = random.Random(24)
    base = words(rng, 150).split()
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(25), 4 + k % 3):
            w[6 * at] = f"q{k}" + words(rng, 1)
        texts.append(" ".join(w))
    texts += [t + " more" for t in texts[100:110]]
    seen = []
    plain = jaccard.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {r.node: r.root for r in jaccard.joined(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 0.8).collect()}
    root = components(texts)
    groups = Counter((root[i], got.get(i, i)) for i in range(len(texts)))
    assert len(groups) == len(set(root)) == len({g for _, g in groups}) and len(set(root)) > 50
    assert sum(seen) < 10 * len(texts)


def test_class_counts_leave_out_no_similar_pair():
    rng = random.Random(25)
    texts = []
    for size in (6, 40, 300, 3000):
        w = words(rng, size).split()
        for _ in range(25):
            c = list(w[rng.randrange(3) :])
            for _ in range(rng.randint(0, 1 + size // 30)):
                c[rng.randrange(len(c))] = words(rng, 1)
            texts.append(" ".join(c).encode())
    sets = jaccard.shingle_sets(texts) + [np.arange(1, 1 << 18, dtype=np.uint64) << np.uint64(20)]
    sets.append(sets[-1][5:])
    counts = jaccard.class_counts(sets)
    assert counts[-1] == counts[-2] == b"" and all(len(c) == jaccard.CLASSES for c in counts[:-2])
    u, v = np.triu_indices(len(sets), 1)
    may = jaccard.may_reach(0.8)(np.array(counts, object))(u, v)
    similar = np.array([jaccard.similarity_of(sets[a], sets[b]) >= 0.8 for a, b in zip(u, v, strict=True)])
    assert similar.sum() > 100 and may[similar].all() and not may.all()


@pytest.mark.parametrize(("words_", "radius"), [(1, 26), (4, 62), (2, 0), (3, 191)])
def test_wide_distances(words_, radius):
    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**63, (30, 64, words_), dtype=np.uint64)
    q = f[:, 0].copy()
    for lane in range(1, 40):  # from equal to far
        flips = rng.random((30, words_, 64)) < lane / 80
        f[:, lane] = q ^ np.packbits(flips, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    planes = np.concatenate([simhash.vertical(np.ascontiguousarray(f[:, :, k])) for k in range(words_)])
    got = simhash.near_wide(q, planes, radius)
    want = np.bitwise_count(f ^ q[:, None]).sum(axis=2) <= radius
    assert [[bool(int(w) >> lane & 1) for lane in range(64)] for w in got] == want.tolist()


def test_similar_texts_are_within_the_radius():
    rng = random.Random(6)
    missed = seen = 0
    for _ in range(300):
        w = words(rng, rng.randint(6, 200)).split()
        c = list(w)
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            c[rng.randrange(len(c))] = words(rng, 1)
        if alike(" ".join(w), " ".join(c)) >= 0.8:
            a, b = jaccard.fingerprints(jaccard.shingle_sets([" ".join(w).encode(), " ".join(c).encode()])).view(np.uint64)
            seen += 1
            missed += int(np.bitwise_count(a ^ b).sum()) > jaccard.RADIUS
    assert seen > 100 and missed == 0
