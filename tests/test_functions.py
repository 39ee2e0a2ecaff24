"""Expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from svloom.functions import catalog
from svloom.functions import genotypes as gt
from svloom.functions import intervals as iv
from svloom.functions import sequences as sq
from svloom.functions import variants as v
from svloom.params import Params


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similarity(a, b):
    return (len(a) + len(b) - distance(a, b)) / (len(a) + len(b))


def test_sequences(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ACGT", k=rng.randint(1, 12))), "".join(rng.choices("ACGT", k=rng.randint(1, 12))), rng.randint(-20, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, k int")
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    got = df.select(
        "a", "b", "k", sq.similarity(a, b).alias("s"), sq.smallest_rotation(a).alias("r"), sq.unrolled_similarity(a, b, k).alias("u"),
        sq.best_similarity(a, b, k).alias("best"), sq.entropy(a).alias("e"), sq.gc_percent(a).alias("gc"), sq.reverse_complement(a).alias("rc"),
    ).collect()
    for r in got:
        rolls = [r.a[i:] + r.a[:i] for i in range(len(r.a))]
        f = r.k % len(r.b)
        turned = r.b[len(r.b) - f :] + r.b[: len(r.b) - f]
        assert r.s == pytest.approx(similarity(r.a, r.b))
        assert r.r == min(rolls)
        assert r.u == pytest.approx(similarity(r.a, turned))
        assert r.best >= max(r.s, r.u) - 1e-12
        assert r.gc == int(100 * sum(c in "GC" for c in r.a) / len(r.a))
        assert r.rc == r.a.translate(str.maketrans("ATCG", "TAGC"))[::-1]
        p = [r.a.count(c) / len(r.a) for c in set(r.a)]
        assert r.e == pytest.approx(-sum(x * math.log(x, 4) for x in p), abs=1e-9)


def test_empty_and_null_sequences(spark):
    df = spark.createDataFrame([("", ""), (None, "A"), ("A", None)], "a string, b string")
    got = df.select(sq.similarity(F.col("a"), F.col("b")).alias("s"), sq.gc_percent(F.col("a")).alias("g")).collect()
    assert [r.s for r in got] == [None, None, None]
    assert got[0].g is None


def test_genotypes(spark):
    cases = [([0, 0], "REF"), ([0, 1], "HET"), ([1, 1], "HOM"), ([2, 2], "HOM"), ([None, 1], "NON"), ([1], "UNK"), (None, "UNK"), ([0, 1, 1], "UNK")]
    df = spark.createDataFrame([(g,) for g, _ in cases], "g array<int>")
    assert [r[0] for r in df.select(gt.genotype(F.col("g"))).collect()] == [x for _, x in cases]


def hwe(n_ref, n_alt, n_het):
    rare, n = min(n_ref, n_alt), (n_ref + n_alt) // 2
    w = {k: math.comb(n, k) * math.comb(n - k, (rare - k) // 2) * 2.0**k for k in range(rare % 2, rare + 1, 2)}
    total = sum(w.values())
    exc = sum(x for k, x in w.items() if k >= n_het) / total
    more = sum(x for x in w.values() if x > w[n_het] * (1 + 1e-9)) / total
    return exc, 1 - min(more, 1)


def test_hardy_weinberg(spark):
    rows = [(20 - k, k, h) for k in range(0, 11) for h in range(k % 2, k + 1, 2)]
    df = spark.createDataFrame(rows, "r int, a int, h int")
    for r in df.select("*", gt.hardy_weinberg(F.col("r"), F.col("a"), F.col("h")).alias("x")).collect():
        assert (r.x.ExcHet, r.x.HWE) == pytest.approx(hwe(r.r, r.a, r.h), abs=1e-9)


def test_allele_frequencies(spark):
    gts = [[0, 0], [0, 1], [1, 1], [None, None], [None, 1], [1], [None], [0, 1, 1]]
    r = spark.createDataFrame([(gts,)], "g array<array<int>>").select(gt.frequencies(F.col("g")).alias("x")).first().x
    assert (r.AN, r.AC, r.N_HOMREF, r.N_HET, r.N_HOMALT, r.N_MISS, r.N_HEMI) == (8, [3, 5], 1, 1, 1, 2, 2)
    assert r.AF == pytest.approx(5 / 8) and r.MAC == 3


def test_variants(spark):
    rows = [("A", "<DEL>"), ("A", "<DUP:TANDEM>"), ("A", "AT"), ("AT", "A"), ("A", "C"), ("AC", "GT"), ("A", "N[chr2:5["), ("A", "]chr2:7]N"), ("A", "*"), ("A", None)]
    df = spark.createDataFrame(rows, "ref string, alt string")
    none = F.lit(None).cast("string")
    got = df.select(v.sv_type(F.col("ref"), F.col("alt"), none).alias("t"), v.bnd_mate(F.col("alt")).alias("m"), v.bnd_direction(F.col("alt")).alias("d")).collect()
    assert [r.t for r in got] == ["DEL", "DUP", "INS", "DEL", "SNP", "UNK", "BND", "BND", "UNK", "UNK"]
    assert (got[6].m.chrom2, got[6].m.pos2, got[6].d.direction, got[6].d.strand) == ("chr2", 5, "left", "direct")
    assert (got[7].m.pos2, got[7].d.direction, got[7].d.strand) == (7, "right", "complement")


def test_scale_bin(spark):
    df = spark.createDataFrame([(4.0,), (6.0,)], "x double")
    assert [tuple(r[0]) for r in df.select(v.scale_bin(F.col("x"), 1, 5, 0, 20, 5)).collect()] == [("[15,20)", 3), (">=20", 4)]


def test_within(spark):
    rows = [(10, 20, 10, 20, True, True), (9, 20, 10, 20, True, False), (10, 20, 10, 20, False, True), (12, 20, 10, 20, True, True), (12, 20, 10, 20, False, False), (12, 21, 10, 20, True, False)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, w boolean, x boolean")
    # a start of exactly one before the region's counts where the ends agree
    got = df.select("x", iv.within(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("w")).alias("y")).collect()
    assert [r.y for r in got[:1] + got[2:]] == [r.x for r in got[:1] + got[2:]] and got[1].y


def test_sql_functions(spark):
    assert "sv_overlaps" in catalog.register(spark)
    r = spark.sql("SELECT sv_overlaps(1, 5, 4, 9) a, sv_reciprocal_overlap(0, 10, 5, 15) b, sv_size_similarity(0, 0) c, sv_sequence_similarity('ACGT', 'ACGA') d, sv_smallest_rotation('GACT') e").first()
    assert tuple(r) == (True, 0.5, 1.0, 0.875, "ACTG")


def test_params():
    assert Params().sizefilt == 30 and Params(sizemin=20).sizefilt == 20
    with pytest.raises(ValueError):
        Params(chunksize=10)
    with pytest.raises(ValueError):
        Params.of(nonsense=1)
    assert Params(dynthresh=(5, 30, 50, 1500)).dynamic_threshold(50) == pytest.approx(0.9)


def test_long_rotations(spark, monkeypatch):
    """The race of two starts finds the same rotation, also of repetitive sequences."""
    import random

    monkeypatch.setattr(sq, "FEW", 0)
    rng = random.Random(2)
    seqs = ["".join(rng.choices(letters, k=n)) for letters in ("AB", "ACGT", "A") for n in (1, 2, 3, 7, 30) for _ in range(4)] + ["ABAB", "BABA", "AABAAB"]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", sq.smallest_rotation(F.col("s")).alias("r")).collect()
    assert all(r.r == min(r.s[i:] + r.s[:i] for i in range(len(r.s))) for r in rows)


def test_rotations_from_runs(spark):
    """Rotations are compared from runs of the first letter; long, repetitive and single-letter sequences alike."""
    import random

    rng = random.Random(4)
    seqs = ["".join(rng.choices(letters, k=n)) for letters in ("AB", "ABCDEFGHIJ", "A") for n in (1, 2, 5, 40, 1500)] + ["", "AB" * 800, "BA" * 30 + "A"]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", sq.smallest_rotation(F.col("s")).alias("r")).collect()
    assert all(r.r == min((r.s[i:] + r.s[:i] for i in range(len(r.s))), default="") for r in rows)


def test_compared_sequences_are_dealt(spark, tmp_path):
    """A small file's sequences go to more than one task, since each comparison is long."""
    from svloom.plans import queries

    spark.createDataFrame([(c, t, "user", "abc" * (t + 1)) for c in range(20) for t in range(5)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["fn_best_seqsim"](spark, str(tmp_path)).rdd.getNumPartitions() > 1
