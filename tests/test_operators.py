"""Operators against plain loops on small random inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from svloom.operators import annotations as an
from svloom.operators import bench as bn
from svloom.operators import collapse as co
from svloom.operators import haplotypes as ha
from svloom.operators import intervals as op
from svloom.operators import sets, stats
from svloom.params import Params
from svloom.storage import stored

CALLS = "id long, chrom string, start long, end long, pos long, svtype string, svlen long, alleles array<int>"


def some_calls(rng, n, spread=4000, first=0):
    out = []
    for i in range(n):
        s, size = rng.randint(0, spread), rng.randint(50, 150)
        out.append((first + i, rng.choice(["a", "b"]), s, s + size, s + 1, rng.choice(["DEL", "INS"]), size, [rng.randint(0, 1), rng.randint(0, 1)]))
    return out


def islands(rows, gap):
    out, far, no, last = {}, None, 0, None
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if r[1] != last:
            last, far, no = r[1], None, 0
        if far is None or far + gap < r[2]:
            no += 1
        far = max(far or 0, r[3])
        out[r[0]] = no
    return out


@pytest.mark.parametrize("span", [50, 700, 1_000_000])
def test_islands(spark, span):
    rows = some_calls(random.Random(2), 120, 30_000)
    df = spark.createDataFrame(rows, CALLS)
    got = {r.id: r.island for r in op.with_islands(df, ["chrom"], "start", "end", 100, order=["id"], span=span).collect()}
    assert got == islands(rows, 100)


def test_range_join_with_giant_intervals(spark):
    rng = random.Random(3)
    a = [(i, "c", s := rng.randint(0, 10**6), s + rng.choice([1, 500, 300_000])) for i in range(80)]
    b = [(i, "c", s := rng.randint(0, 10**6), s + rng.choice([1, 9000, 5_000_000])) for i in range(80)]
    x = spark.createDataFrame(a, "a_id long, chrom string, s long, e long")
    y = spark.createDataFrame(b, "b_id long, chrom string, rs long, re long")
    got = op.range_join(x, y, ["chrom"], ("s", "e"), ("rs", "re")).select("a_id", "b_id").collect()
    want = sorted((i, j) for i, _, s, e in a for j, _, u, w in b if max(s, u) < min(e, w))
    assert sorted(map(tuple, got)) == want
    kept = op.range_join(x, y, ["chrom"], ("s", "e"), ("rs", "re"), "left_semi")
    assert {r.a_id for r in kept.collect()} == {i for i, _ in want}


def loop_single(base, comp, p):
    """One-to-one assignment by a plain walk over all pairs of a block."""
    rows = [(*r, "base") for r in base] + [(*r, "comp") for r in comp]
    block, far, last, no = {}, None, None, 0
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[-1], r[0], r[3])):
        if r[1] != last:
            last, far = r[1], None
        if far is None or far + p.chunksize < r[2]:
            no += 1
        far = max(far or 0, r[3])
        block[r[-1], r[0]] = no
    edges = []
    for b in base:
        for c in comp:
            if block["base", b[0]] != block["comp", c[0]]:
                continue
            size = min(b[6], c[6]) / max(b[6], c[6])

            def wide(x):
                h = x[6] // 2 if x[5] == "INS" else 0
                return x[2] - h, x[3] + h

            (bs, be), (cs, ce) = wide(b), wide(c)
            ovl = max(0, min(be, ce) - max(bs, cs)) / max(be - bs, ce - cs)
            near = max(b[2] - p.refdist, c[2]) < min(b[3] + p.refdist, c[3])
            state = b[5] == c[5] and near and size >= p.pctsize
            edges.append((state, (0 + size + ovl) / 3 * 100, -abs(b[2] - c[2]), -abs(b[3] - c[3]), -b[0], -c[0]))
    used, out = set(), {}
    for e in sorted(edges, reverse=True):
        b, c = -e[4], -e[5]
        if ("base", b) not in used and ("comp", c) not in used:
            used |= {("base", b), ("comp", c)}
            out["base", b] = out["comp", c] = e[0]
    return out


def test_bench_single(spark):
    rng = random.Random(4)
    base, comp = some_calls(rng, 40), some_calls(rng, 40, first=1000)
    p = Params(pctseq=0, refdist=200, chunksize=200)
    b = bn.bench(spark.createDataFrame(base, CALLS), spark.createDataFrame(comp, CALLS), p)
    got = {(r.side, r.id): r.state for r in b.picked.collect()}
    want = loop_single(base, comp, p)
    assert {k: v for k, v in got.items() if k in want} == want
    assert not any(v for k, v in got.items() if k not in want)
    s = b.summary().first()
    assert s.tp_base == sum(v for (side, _), v in want.items() if side == "base")
    assert s.base_cnt == 40 and s.comp_cnt == 40
    assert b.refine_candidates().count() > 0


def test_bench_in_regions_and_without_calls(spark):
    rows = some_calls(random.Random(5), 20)
    df = spark.createDataFrame(rows, CALLS)
    regions = spark.createDataFrame([("a", 0, 2000)], "chrom string, start long, end long")
    b = bn.bench(df, df, Params(pctseq=0), regions, extend=100)
    inside = {r[0] for r in rows if r[1] == "a" and r[3] <= 2000}
    assert {r.id for r in b.states().where("side = 'base'").collect()} >= {i for i in inside if dict((r[0], r[5]) for r in rows)[i] == "DEL"}
    none = bn.bench(df.limit(0), df.limit(0), Params(pctseq=0)).summary().first()
    assert none.tp_base == 0 and none.precision is None and none.f1 is None


def test_breakends_match(spark):
    cols = CALLS + ", ref string, alt string, chrom2 string, pos2 long, direction string, strand string, ci array<int>"
    one = (1, "a", 100, 101, 101, "BND", 0, [0, 1], "N", "N[b:500[", "b", 500, "left", "direct", None)
    near = (2, "a", 140, 141, 141, "BND", 0, [0, 1], "N", "N[b:530[", "b", 530, "left", "direct", None)
    turned = (3, "a", 140, 141, 141, "BND", 0, [0, 1], "N", "N]b:530]", "b", 530, "right", "direct", None)
    b = spark.createDataFrame([one], cols)
    got = {r.cid: (r.state, r.score) for r in bn.bench(b, spark.createDataFrame([near, turned], cols)).matches.collect()}
    assert got[2] == (True, pytest.approx((1 - 35 / 200) * 100)) and got[3][0] is False


def test_collapse_chain_reaches_over_a_middle_call(spark):
    cols = "id long, chrom string, start long, end long, pos long, svtype string, svlen long, ref string, alt string, qual double, gts array<array<int>>"
    rows = [(i, "a", 100, 100 + n, 101, "DEL", n, "N" * n, "N", 1.0, [[None, None] if i == 3 else [0, 1]]) for i, n in ((1, 200), (2, 160), (3, 400), (4, 125))]
    df = spark.createDataFrame(rows, cols)
    p = Params(pctseq=0, pctsize=0.78, refdist=500, chunksize=500, sizefilt=50, short_circuit=True, skip_gt=True)
    plain = {(r.id, r.keeper) for r in co.collapse(df, p)[1].collect()}
    chained = {(r.id, r.keeper) for r in co.collapse(df, p, chain=True)[1].collect()}
    assert plain == {(2, 1)}
    assert chained == {(2, 1), (4, 1)}
    kept = {r.id: r for r in co.collapse(df, p)[0].collect()}
    assert kept[1].num_collapsed == 1 and kept[3].num_collapsed == 0


def test_consolidation_fills_missing_genotypes(spark):
    cols = "id long, chrom string, start long, end long, pos long, svtype string, svlen long, ref string, alt string, qual double, gts array<array<int>>"
    rows = [(1, "a", 100, 200, 101, "DEL", 100, "N", "N", 1.0, [[None, None], [0, 1]]), (2, "a", 101, 201, 102, "DEL", 100, "N", "N", 1.0, [[1, 1], [0, 0]])]
    kept, removed = co.collapse(spark.createDataFrame(rows, cols), Params(pctseq=0, short_circuit=True, skip_gt=True, sizefilt=50))
    r = kept.first()
    assert r.gts == [[1, 1], [0, 1]] and r.num_consolidated == 1 and removed.first().keeper == 1
    assert co.intra_merge(kept, removed).first().supp == 3
    assert co.median_info(kept, removed).first().collapse_size == 100


def test_haplotypes_round_trip(spark):
    ref = "ACGTTGCAACGGTACCATGACTGGATCC"
    calls = [(3, "T", "TGGG"), (10, "GGTA", "G"), (20, "T", "C")]
    hap = ha.haplotype(ref, 0, calls)
    a, b = ha.align(hap, ref)
    assert a.replace("-", "") == hap and b.replace("-", "") == ref and len(a) == len(b)
    again = ha.haplotype(ref, 0, ha.alignment_variants(a, b, 0))
    assert again == hap
    loci = spark.createDataFrame([("l", "c", 0, ref)], "locus string, chrom string, start long, seq string")
    rows = [("l", s, r, x, "s1", [0, 1]) for s, r, x in calls]
    got = ha.harmonise(spark.createDataFrame(rows, "locus string, start long, ref string, alt string, sample string, alleles array<int>"), loci)
    found = [(r.start, r.ref, r.alt) for r in got.collect()]
    assert ha.haplotype(ref, 0, found) == hap and all(r.alleles == [0, 1] for r in got.collect())


def test_presence_keeps_or_drops_copies(spark):
    df = spark.createDataFrame([("k", 0), ("k", 0), ("k", 0), ("k", 1), ("m", 1)], "key string, file_no int")
    assert {(r.key, r.flag) for r in sets.presence(df).collect()} == {("k", 3), ("m", 1)}
    assert {(r.key, r.flag) for r in sets.presence(df, no_dups=False).collect()} == {("k", 3), ("m", 1), ("k.1", 2)}


def test_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "id long, pval double")
    got = {r.id: r.adj_pval for r in stats.benjamini_hochberg(df, order=["id"]).collect()}
    order = sorted(range(5), key=lambda i: p[i])
    best, want = 1.0, {}
    for k in range(4, -1, -1):
        best = min(best, p[order[k]] * 5 / (k + 1))
        want[order[k]] = best
    assert got == pytest.approx(want)


def test_remap_and_masker(spark):
    calls = spark.createDataFrame([(1, "a", 100, 101), (2, "a", 100, 101), (3, "a", 100, 101), (4, "a", 100, 101)], "id long, chrom string, start long, end long")
    hits = spark.createDataFrame([(1, "a", 102, 200, 0.9), (2, "b", 5, 80, 0.9), (3, "b", 5, 80, 0.4)], "id long, hit_chrom string, hit_start long, hit_end long, pct_query double")
    assert {r.id: r.remap for r in an.remapped(hits, calls).collect()} == {1: "tandem", 2: "interspersed", 3: "partial", 4: "novel"}
    rm = spark.createDataFrame([(1, 10, "x", "L", 90, 100), (1, 50, "y", "S", 85, 100), (2, 9, "z", "S", 10, 100)], "id long, score long, repeat string, clsfam string, span long, seq_len long")
    assert [(r.id, r.repeat) for r in an.repeat_hits(rm).collect()] == [(1, "x")]


@pytest.mark.parametrize("span", [10, 10_000])
def test_numbering_is_global(spark, span):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    rows = an.numbered(df, "g", "k", ["id"], span=span).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.g, r.k, r.id))] == list(range(1000))


def test_breakends_match_decomposed_calls(spark):
    cols = CALLS + ", ref string, alt string, chrom2 string, pos2 long, direction string, strand string, ci array<int>"
    deletion = (1, "a", 100, 600, 101, "DEL", 500, [0, 1], "N", "<DEL>", None, None, None, None, None)
    bnd = (2, "a", 110, 111, 111, "BND", 0, [0, 1], "N", "N[a:610[", "a", 610, "left", "direct", None)
    far = (3, "a", 400, 401, 401, "BND", 0, [0, 1], "N", "N[a:610[", "a", 610, "left", "direct", None)
    b = spark.createDataFrame([deletion], cols)
    p = Params(pctseq=0)
    got = {r.cid: (r.state, r.st_dist, r.ed_dist) for r in bn.bench(b, spark.createDataFrame([bnd, far], cols), p).matches.collect()}
    assert got[2] == (True, -10, -9) and got[3][0] is False
    off = bn.bench(b, spark.createDataFrame([bnd], cols), p.but(decompose=False)).matches.first()
    assert off.state is False


def affine_score(a, b):
    total, last = 0, 0
    for x, y in zip(a, b, strict=True):
        now = 1 if x == "-" else 2 if y == "-" else 0
        total += (2 if x == y else -4) if not now else -1 if now == last else -7
        last = now
    return total


def best_score(q, r):
    from functools import lru_cache

    @lru_cache(None)
    def f(i, j, last):
        if not i and not j:
            return 0
        gap = lambda now: 1 if now == last else 7
        out = -(10**6)
        if i and j:
            out = f(i - 1, j - 1, 0) + (2 if q[i - 1] == r[j - 1] else -4)
        if j:
            out = max(out, f(i, j - 1, 1) - gap(1))
        if i:
            out = max(out, f(i - 1, j, 2) - gap(2))
        return out

    return f(len(q), len(r), 0)


def test_alignments_have_the_best_score():
    rng = random.Random(14)
    for _ in range(400):
        q, r = ("".join(rng.choices("ACG", k=rng.randint(0, 12))) for _ in range(2))
        a, b = ha.align(q, r)
        assert a.replace("-", "") == q and b.replace("-", "") == r
        assert affine_score(a, b) == best_score(q, r)


def test_a_gap_at_the_first_base_is_anchored_by_the_reference(spark):
    loci = spark.createDataFrame([("l", "c", 10, "GACGTACGT")], "locus string, chrom string, start long, seq string")
    calls = spark.createDataFrame([("l", 10, "G", "TTTTG", "s", [0, 1])], "locus string, start long, ref string, alt string, sample string, alleles array<int>")
    r = ha.harmonise(calls, loci).first()
    assert (r.start, r.ref, r.alt, r.error) == (9, "G", "GTTTT", None)


def test_symbolic_calls_are_compared_by_their_sequence(spark):
    rng = random.Random(15)
    contig = "".join(rng.choices("ACGT", k=4000))
    tiles = spark.createDataFrame([("c", k, k * 500, contig[k * 500 : k * 500 + 500]) for k in range(8)], "chrom string, tile int, start long, seq string")
    cols = "id long, chrom string, start long, end long, pos long, svtype string, svlen long, ref string, alt string"
    base = spark.createDataFrame([(1, "c", 1000, 1100, 1001, "DEL", 100, "N", "<DEL>"), (2, "c", 3000, 3080, 3001, "DUP", 80, "N", "<DUP>")], cols)
    spelled = [(11, "c", 1000, 1100, 1001, "DEL", 100, contig[1000:1100], contig[1000]), (12, "c", 3000, 3001, 3001, "INS", 80, contig[3000], contig[3000:3080])]
    comp = spark.createDataFrame(spelled, cols)
    p = Params(pctseq=0.9, dup_to_ins=True)
    got = {(r.bid, r.cid): (r.state, r.seqsim) for r in bn.bench(base, comp, p, reference=op_tiles(tiles)).matches.where("state").collect()}
    assert got == {(1, 11): (True, 1.0), (2, 12): (True, 1.0)}
    none = bn.bench(base, comp, p).matches.where("seqsim > 0").count()
    assert none == 0


def op_tiles(tiles):
    from svloom.sources import regions

    whole = tiles.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    assert regions.fetch(whole.select(F.lit(1).alias("id"), "chrom", F.lit(700).alias("start"), F.lit(1300).alias("end")), tiles, 500).first().seq == whole.first().seq[700:1300]
    return whole.select("chrom", F.lit(0).alias("tile"), F.lit(0).cast("long").alias("start"), "seq")


def test_distances_stop_where_they_cannot_pass(spark):
    rng = random.Random(16)
    seqs = ["".join(rng.choices("ACGT", k=300)) for _ in range(6)]
    seqs += [s[:150] + "".join(rng.choices("ACGT", k=20)) + s[160:] for s in seqs]
    cols = "id long, chrom string, start long, end long, pos long, svtype string, svlen long, ref string, alt string"
    rows = [(i, "c", 1000 + i, 1001 + i, 1001 + i, "INS", len(s), "A", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, cols)
    full = Params(pctseq=0.9, no_roll=True)
    found = [{(r.bid, r.cid): round(r.seqsim, 9) for r in bn.bench(df, df, p).matches.where("state").collect()} for p in (full, full.but(short_circuit=True), full.but(short_circuit=True, max_chunk=None))]
    assert len(found[0]) == 24 and found[0] == found[1] == found[2]


def test_alignment_strings(spark):
    from svloom.functions import cigar as cg

    df = spark.createDataFrame([("ACGTTT", "ACAAGTT", "2M2D2M1I1M")], "seq string, ref string, cigar string")
    r = df.select(cg.expanded(F.col("seq"), F.col("ref"), F.col("cigar")).alias("x"), cg.clipped(F.lit("3S4M2H")).alias("c"), cg.missed(F.lit("2M2D1I3X")).alias("m")).first()
    assert (r.x.seq, r.x.ref) == ("AC--GTTT", "ACAAGT-T") and (r.c.before, r.c.behind, r.m) == (3, 2, 6)


def test_shards_and_small_types(spark):
    rows = [(i, "ab"[i % 2], 10_000 * i, 10_000 * i + 10) for i in range(60)]
    s = sets.shards(spark.createDataFrame(rows, "id long, chrom string, start long, end long"), 1000, 7)
    sizes = sets.shard_sizes(s).first()
    assert (sizes.shards, sizes.most, sizes.least) == (10, 7, 2)
    d = stats.downcast(spark.createDataFrame([(1, 70_000, 2**40), (-5, 3, None)], "a long, b long, c long"))
    assert dict(d.dtypes) == {"a": "tinyint", "b": "int", "c": "bigint"}


PLACES = "chrom2 string, pos2 long, direction string, strand string, ci array<int>"


def mixed_calls(rng, n, first):
    out = []
    for i in range(first, first + n):
        s, size = rng.randint(0, 3000), rng.randint(50, 150)
        kind = rng.choice(["DEL", "DUP", "INV", "INS", "BND", "BND"])
        if kind == "BND":
            place = (rng.choice(["a", "b"]), s + rng.choice([size, -size, 50_000]), rng.choice(["left", "right"]), rng.choice(["direct", "complement"]), rng.choice([None, [-5, 30], [0, 3000]]))
            out.append((i, "a", s, s + 1, s + 1, "BND", 0, [0, 1], *place))
        else:
            out.append((i, "a", s, s + size, s + 1, kind, size, [0, 1], None, None, None, None, rng.choice([None, [0, 20]])))
    return out


@pytest.mark.parametrize("decompose", [True, False])
def test_calls_and_breakends_in_one_table(spark, decompose):
    """Range joins of calls and of both places of breakends find what all pairs of a block hold."""
    rng = random.Random(12)
    base, comp = (spark.createDataFrame(mixed_calls(rng, 150, first), f"{CALLS}, {PLACES}") for first in (0, 1000))
    p = Params(pctseq=0, sizemin=50, decompose=decompose)
    shown = ["bid", "cid", "score", "st_dist", "ed_dist"]
    all_pairs, near = (sorted(map(tuple, bn.bench(base, comp, q).matches.where("state").select(shown).collect())) for q in (p, p.but(short_circuit=True)))
    assert near == all_pairs and len(near) > 50


def test_files_are_paired_by_ranges(spark, tmp_path):
    """A plan over parsed lines joins on bins: calls on one place, breakends on two; nothing joins blocks whole."""
    from svloom.operators import matching
    from svloom.sources.vcf import read_vcf

    lines = ["##contig=<ID=c,length=9000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", "c\t10\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=90;SVLEN=80", "c\t10\t.\tN\tN[c:91[\t.\tPASS\tSVTYPE=BND"]
    (tmp_path / "x.vcf").write_text("\n".join(lines) + "\n")
    calls = read_vcf(spark, str(tmp_path / "x.vcf"))
    chunked = stored(matching.with_chunks(calls.withColumn("side", F.lit("base")), Params()))
    for p in (co.DEFAULTS, Params(short_circuit=True)):
        plan = matching.near_pairs(chunked, chunked, p)._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert len(joins) == 4 and all("__bin" in x for x in joins) and sum("__bin1" in x for x in joins) == 3


def test_blocks_that_are_too_large_count_nowhere(spark):
    rows = [(i, "a", 100 + 9 * i, 180 + 9 * i, 101 + 9 * i, "DEL", 80, [0, 1]) for i in range(4)] + [(9, "a", 90_000, 90_080, 90_001, "DEL", 80, [0, 1])]
    df = spark.createDataFrame(rows, CALLS)
    cut = bn.bench(df, df, Params(pctseq=0, short_circuit=True, max_chunk=2))
    s = cut.summary().first()
    assert (s.tp_base, s.tp_comp, s.fn, s.fp, s.f1) == (1, 1, 0, 0, 1.0)
    assert [r.n for r in cut.left_out.collect()] == [8] and cut.refine_candidates().count() == 0
    for p in (Params(pctseq=0, short_circuit=True), Params(pctseq=0, max_chunk=2)):
        whole = bn.bench(df, df, p)
        assert whole.summary().first().tp_base == 5 and whole.left_out.count() == 0


def test_fast_clustering(spark):
    """Giant calls don't chain the small ones below them, and are found by their starts; without it nothing changes."""
    rows = [(0, "a", 0, 900_000, 1, "DEL", 900_000), (1, "a", 100, 899_000, 101, "DEL", 898_900), (2, "a", 5000, 905_000, 5001, "DEL", 900_000)]
    rows += [(10 + k, "a", 40_000 * k + 10, 40_000 * k + 110 + k % 2, 40_000 * k + 11, "DEL", 100 + k % 2) for k in range(1, 9)]
    rows += [(30 + k, "a", 40_000 * k + 40, 40_000 * k + 140, 40_000 * k + 41, "DEL", 100) for k in range(1, 9)]
    calls = spark.createDataFrame([(*r, "N", "<DEL>", 1.0, [[0, 1]]) for r in rows], "id long, chrom string, start long, end long, pos long, svtype string, svlen long, ref string, alt string, qual double, gts array<array<int>>")
    p = co.DEFAULTS.but(pctseq=0, pctsize=0.9, sizemax=-1)
    small = {(30 + k, 10 + k) for k in range(1, 9)}
    for fast, giants in ((False, {(1, 0), (2, 0)}), (True, {(1, 0)})):
        got = co.collapse(calls, p, fast_cluster=fast, least=3)[1].select("id", "keeper").collect()
        assert {tuple(r) for r in got} == small | giants
    ranked = co.candidates(calls, p, fast_cluster=True, least=3)
    assert ranked.groupBy("chunk_id").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("span", [7, 1_000_000])
def test_running_sums_and_overlap_counts(spark, span, monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(op, "ISLAND_SPAN", span)
    rows = [(i, rng.choice(["a", None]), s := rng.randint(-40, 40), s + rng.choice([0, 1, 5, 60])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, chrom string, s long, e long")
    got = op.running_sums(df.withColumn("v", F.col("id")), ["chrom"], "s", ["v"], ["id"], after="next", span=span).collect()
    for c in ("a", None):
        own, total = sorted((r[2], r[0]) for r in rows if r[1] == c), 0
        found = {r.id: (r.v, r.next) for r in got if r.chrom == c}
        for k, (_, i) in enumerate(own):
            total += i
            assert found[i] == (total, own[k + 1][0] if k + 1 < len(own) else None)
    n = {r.id: r.n for r in op.overlap_counts(df, df, ["chrom"], ("s", "e"), ["id"], ("s", "e")).collect()}
    want = {i: sum(c == d and max(s, u) < min(e, w) for _, d, u, w in rows) for i, c, s, e in rows if s < e}
    assert n == want


def test_no_pairs_are_made_to_count_them(spark):
    calls = spark.createDataFrame(some_calls(random.Random(1), 20), CALLS)
    windows = spark.createDataFrame([("a", 0, 500), ("b", 0, 500)], "chrom string, start long, end long")
    for df in (an.neighbors(calls), an.density(calls, windows), sets.segments(calls.withColumn("gts", F.array("alleles"))), op.subtract(windows, calls)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "__bin" not in plan and "Generate explode(sequence" not in plan


@pytest.mark.parametrize("least", [1, 4, 30, 1000])
def test_shards_against_a_walk(spark, least):
    rng = random.Random(least)
    rows, at = [], 0
    for i in range(200):
        at += rng.choice([10, 10, 10, 900, 5000])
        rows.append((i, rng.choice(["a", "a", "b"]), at, at + 50, at + 1, "DEL", 50, [0, 1]))
    got = {r.id: r.shard for r in sets.shards(spark.createDataFrame(rows, CALLS), 1000, least).collect()}
    want = {}
    for c in "ab":
        held, no, far = 0, 0, None
        for r in sorted((r for r in rows if r[1] == c), key=lambda r: r[2]):
            if far is not None and r[2] - far >= 1000 and held >= least:
                held, no = 0, no + 1
            held, far = held + 1, max(far or 0, r[3])
            want[r[0]] = f"{c}_{no}"
    assert got == want
    assert sets.shards(spark.createDataFrame([], CALLS)).count() == 0


@pytest.mark.parametrize("tail", ["left", "right", "two"])
def test_permutations_against_a_loop(spark, tail):
    import hashlib

    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice("pq"), k) for k in range(14)]
    scores = spark.createDataFrame(rows, "f string, g string, rank int")
    got = {(r.feature, r.value): r for r in stats.permutation(scores, ["f", "g"], 60, tail, 7, 3).collect()}
    n, total = len(rows), sum(r[2] for r in rows)
    orders = [sorted(range(n), key=lambda i: hashlib.md5(f"7:{k}:{i}".encode()).hexdigest()) for k in range(60)]
    assert len(got) == len({r[0] for r in rows}) + len({r[1] for r in rows})
    for (feature, value), r in got.items():
        own = [x[2] for x in rows if x["fg".index(feature)] == value]
        m = len(own)
        size = abs if tail == "two" else float
        diffs = [sum(o[:m]) * n - total * m for o in orders]
        d = sum(own) * n - total * m
        assert abs(r.delta - size(sum(own) / m - (total - sum(own)) / (n - m))) < 1e-9
        if m < 3 or n - m < 3:
            assert r.pval is None
            continue
        hits = {"left": sum(x <= d for x in diffs), "right": sum(x >= d for x in diffs), "two": sum(abs(x) >= abs(d) for x in diffs)}[tail]
        assert abs(r.pval - hits / 60) < 1e-12
        assert abs(r.q50 - sorted(size(x) for x in diffs)[29] / (m * (n - m)) * 0.5 - sorted(size(x) for x in diffs)[30] / (m * (n - m)) * 0.5) < 1e-9


@pytest.mark.parametrize(("hap", "gt", "depth"), [(True, "off", 1), (False, "all", 1), (False, "het", 1), (True, "all", 1), (False, "all", 2), (False, "off", 3)])
def test_rules_of_collapsing(spark, hap, gt, depth):
    """Matches taken as they come give what the whole block's walk gives, block by block."""
    rng = random.Random(f"{hap}{gt}{depth}")
    gts = {i: [[rng.randint(0, 1), rng.randint(0, 1)] for _ in range(2)] for i in range(60)}
    rank = {i: k for k, i in enumerate(rng.sample(range(60), 60))}
    pairs = {tuple(sorted(rng.sample(range(m, m + 20), 2), key=rank.get)) for m in (0, 20, 40) for _ in range(45)}
    rows = [(f"k{b // 20}", b, c, True, round(rng.random(), 1), rng.randint(0, 3), rng.randint(0, 3)) for b, c in sorted(pairs)]
    matches = spark.createDataFrame(rows, "chunk_id string, bid long, cid long, state boolean, score double, st_dist long, ed_dist long")
    ranked = spark.createDataFrame([(i, f"k{i // 20}", rank[i], g) for i, g in gts.items()], "id long, chunk_id string, rank int, gts array<array<int>>")
    got = co._ruled(ranked, matches, hap, gt) if depth == 1 else co._stateful(ranked, matches, depth, hap, gt)
    want = set()
    for m in ("k0", "k1", "k2"):
        edges = [{"bid": b, "cid": c, "key": (1, s, -float(st), -float(ed), -b, -c)} for k, b, c, _, s, st, ed in rows if k == m]
        calls = [{"id": i, "rank": rank[i], "acs": [sum(x == 1 for x in a) for a in gts[i]]} for i in gts if m == f"k{i // 20}"]
        want |= set(co.greedy(edges, calls, depth, hap, gt))
    assert {tuple(r) for r in got.collect()} == want and want


def test_components(spark):
    from svloom.operators.graph import components

    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2050, 2000 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def pair_score(a, b):
    """The score of two rows under the multiple aligner's settings."""
    from svloom.operators import partial_order as po

    total, gap = 0, None
    for x, y in zip(a, b, strict=True):
        if x != "-" and y != "-":
            total, gap = total + (po.MATCH if x == y else po.MISMATCH), None
        else:
            side = "a" if x == "-" else "b"
            total, gap = total + po.GAP + (po.GAP_OPEN if gap != side else 0), side
    return total


def best_pair_score(a, b):
    """The best score of all global alignments, by enumeration with memory."""
    from functools import cache

    from svloom.operators import partial_order as po

    @cache
    def go(i, j, gap):
        if i == len(a) and j == len(b):
            return 0
        out = []
        if i < len(a) and j < len(b):
            out.append((po.MATCH if a[i] == b[j] else po.MISMATCH) + go(i + 1, j + 1, None))
        if i < len(a):
            out.append(po.GAP + (po.GAP_OPEN if gap != "b" else 0) + go(i + 1, j, "b"))
        if j < len(b):
            out.append(po.GAP + (po.GAP_OPEN if gap != "a" else 0) + go(i, j + 1, "a"))
        return max(out)

    return go(0, 0, None)


def test_partial_order_alignment():
    """Rows spell their sequences; two have the best score; a third has the best of all ways through the graph of two."""
    from svloom.operators import partial_order as po

    rng = random.Random(21)

    def some(n):
        return "".join(rng.choices("ACGT", k=n))

    for _ in range(60):
        base = some(rng.randint(1, 12))
        seqs = [base] + ["".join(rng.choice([x, x, x, x, "", x + rng.choice("ACGT"), rng.choice("ACGT")]) for x in base) for _ in range(4)]
        rows = po.multiple_alignment(seqs)
        assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs
        assert all(any(r[k] != "-" for r in rows) for k in range(len(rows[0])))
        a, b = sorted(seqs[:2], key=lambda s: (len(s), s), reverse=True)
        pair = po.without_shared_gaps(*po.multiple_alignment([a, b]))
        assert pair_score(*pair) == best_pair_score(a, b)
        graph = po.Graph()
        graph.add(a)
        graph.add(b)
        ways, todo = set(), [[n] for n in range(len(graph.base)) if not graph.before[n]]
        while todo:
            way = todo.pop()
            todo += [[*way, x] for x in graph.after[way[-1]]]
            if not graph.after[way[-1]]:
                ways.add("".join(graph.base[x] for x in way))
        c = seqs[2]
        if c and ways:
            matched = graph._aligned(c)
            lost = [x for x in matched if x is not None]
            assert lost == sorted(lost, key=[n for k in graph.columns() for n in graph.members[k]].index)
            n_eq = sum(graph.base[x] == y for x, y in zip(matched, c, strict=True) if x is not None)
            best = max(best_pair_score(c, w) for w in ways)
            assert n_eq * po.MATCH >= best
    assert po.multiple_alignment(["", "AC", "AC"]) == ["--", "AC", "AC"]
    with pytest.raises(ValueError, match="too large"):
        po.MOST_CELLS, keep = 10, po.MOST_CELLS
        try:
            po.multiple_alignment(["ACGTACGT", "TTTTTT"])
        finally:
            po.MOST_CELLS = keep


def test_harmonised_by_partial_order(spark):
    """Variants made of the rows spell both samples' haplotypes again."""
    ref = "ACGTACGGTTCAGGATCCATTGCAACTG"
    calls = spark.createDataFrame(
        [("l", 103, "T", "TACGT", "a", [0, 1]), ("l", 107, "G", "GCCC", "a", [1, 1]), ("l", 105, "C", "T", "b", [1, 0]), ("l", 115, "TCC", "T", "b", [0, 1])],
        "locus string, start long, ref string, alt string, sample string, alleles array<int>",
    )
    loci = spark.createDataFrame([("l", "c", 100, ref)], "locus string, chrom string, start long, seq string")
    got = ha.harmonise(calls, loci, "poa").collect()
    assert got and all(r.error is None for r in got)
    for sample in "ab":
        for copy in (0, 1):
            own = [(r.start, r.ref, r.alt) for r in calls.where(F.col("sample") == sample).collect() if r.alleles[copy] == 1]
            made = [(r.start, r.ref, r.alt) for r in got if r["sample"] == sample and r.alleles[copy] == 1]
            assert ha.haplotype(ref, 100, made) == ha.haplotype(ref, 100, own)


def _crowd(spark, seed: int, n: int = 160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start, size = rng.randrange(0, 12_000, 60), rng.choice([60, 61, 70, 75, 90, 200, 300, 301, 580])
        rows.append((i, f"chr{i % 2}", start, start + size, rng.choice(["DEL", "INS", "DUP"]), size, rng.choice([[0, 1], [1, 1], [0, 0], [None, 1]])))
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, svtype string, svlen long, alleles array<int>")
    return df.where("id % 5 < 3"), df.where("id % 5 >= 3")


@pytest.mark.parametrize("rule", ["single", "multi", "ac"])
@pytest.mark.parametrize("few", [0, 32])
def test_picks_without_all_pairs(spark, monkeypatch, rule, few):
    """Crowded blocks of unequal sides get from few pairs what all pairs give, and verdicts make no table of pairs."""
    from svloom import storage
    from svloom.operators import pick

    monkeypatch.setattr(pick, "FEW_PAIRS", few)
    p = Params(pctseq=0, pick=rule, sizemin=60, sizefilt=50)
    b = bn.bench(*_crowd(spark, 5), p)
    shown = ["side", "id", "bid", "cid", "state", "multi", F.round("score", 6), "st_dist", "ed_dist", "gt_match"]
    want = sorted(map(tuple, pick.PICKERS[rule](b.matches).select(shown).collect()))
    before = len(storage._written)
    assert sorted(map(tuple, b.picked.select(shown).collect())) == want
    summary = bn.bench(*_crowd(spark, 5), p).summary().first()
    assert not any("/matches-" in x for x in storage._written[before:])
    won = {(r[0], r[1]) for r in want if r[4]}
    assert (summary.tp_base, summary.tp_comp) == tuple(sum(s == side for s, _ in won) for side in ("base", "comp"))


@pytest.mark.parametrize("how", [{}, {"keep": "maxqual"}, {"chain": True}, {"gt": "all"}])
def test_copies_collapse_as_one(spark, monkeypatch, how):
    """Copies of calls go where all pairs would send them, and no pair of copies is made."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        s, size = rng.randrange(0, 3000, 300), rng.choice([100, 104, 200])
        rows.append((i, "a", s, s + size, s + 1, "N", "<DEL>", "DEL", size, float(i % 7), [[rng.randint(0, 1), 0], [0, rng.randint(0, 1)]][: 1 + (i % 9 == 0)]))
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, pos long, ref string, alt string, svtype string, svlen long, qual double, gts array<array<int>>")
    p = Params(pctseq=0, pctsize=0.9, short_circuit=True, skip_gt=True, sizefilt=50)

    def result():
        kept, removed = co.collapse(df, p, **how)
        return sorted(map(tuple, removed.select("id", "keeper").collect())), sorted(map(tuple, kept.select("id", "num_collapsed", "num_consolidated").collect()))

    made, real = [], co.stored
    monkeypatch.setattr(co, "stored", lambda d, name="step": made.append((name, real(d, name))) or made[-1][1])
    got, few = result(), made[1][1].count()
    made.clear()
    monkeypatch.setattr(co, "with_firsts", lambda ranked, *_: ranked.withColumn("__first", F.col("id")))
    if "gt" in how:
        monkeypatch.setattr(co, "_unclashing_pairs", lambda ranked, p, gt: co.matched_pairs(ranked.drop("gts"), p))
    assert got == result() and few < made[1][1].count()


def test_frequencies_of_samples_and_shared_tests(spark):
    """Counts summed up over rows are those of arrays of genotypes, odd ones too, and the exact tests of equal counts are those of each call."""
    kinds = [[0, 0], [0, 1], [1, 1], [1, None], [None, None], [2, 1], [1], [None], [], [0, 1, 1], None]
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.choice(kinds)) for i in range(60) for _ in range(rng.randint(1, 9))] + [(99, None)], "id long, alleles array<int>")
    want = an.allele_frequencies(rows.groupBy("id").agg(F.collect_list("alleles").alias("gts")))
    got = an.equilibrium(an.sample_frequencies(rows, ["id"]))
    one, two = ({r.id: (r.af.asDict(), round(r.hw.ExcHet, 9), round(r.hw.HWE, 9)) for r in x.collect()} for x in (got, want))
    assert one == two and len(one) == 61


def test_steps_leave_no_shuffles_behind(spark):
    """A stored step's shuffle files are deleted once it is written, and the tables that it needed on its way with it."""
    import os

    from svloom import storage

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, first = blocks.getAllFiles().size(), len(storage._written)
    got = storage.settled(lambda: stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "inner").groupBy("k").count(), "outer")
    deadline = time.time() + 20
    while blocks.getAllFiles().size() > before and time.time() < deadline:
        time.sleep(0.2)
    assert blocks.getAllFiles().size() <= before
    assert len(storage._written) == first + 1 and os.path.isdir(storage._written[-1].removeprefix("file:"))
    assert got.count() == 7


def test_pairs_carry_and_probe_only_what_they_need(spark):
    """Copies of calls are offered once where partners are shared, pairs hold what comparing reads, and levels without an interval aren't probed."""
    from svloom.operators import intervals, matching, pick

    base, comp = _crowd(spark, 5)
    b = bn.bench(base.unionByName(base.withColumn("id", F.col("id") + 1000)), comp.unionByName(comp.withColumn("id", F.col("id") + 1000)), Params(pctseq=0, pick="multi", sizemin=60, sizefilt=50))
    assert set(matching.needed(b._kept, b.params).columns) == {"side", "chunk_id", "id", "start", "end", "svtype", "svlen", "alleles"}
    asked = []
    real = pick._assigned
    pick._assigned = lambda blocks, p: asked.append(blocks.count()) or real(blocks, p)
    try:
        got = {(r.side, r.id): (r.bid, r.cid, r.state) for r in b.picked.collect()}
    finally:
        pick._assigned = real
    want = {(r.side, r.id): (r.bid, r.cid, r.state) for r in pick.pick_multi(b.matches).collect()}
    assert got == want and asked[0] * 2 <= b._kept.count()
    right = spark.createDataFrame([("a", 5, 9)], "k string, s long, e long")
    plan = intervals.range_join(right, right.select("k", F.col("s").alias("t"), F.col("e").alias("f")), ["k"], ("s", "e"), ("t", "f"), sparse=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "[0,1,2,3,4]" not in plan


def test_all_pairs_work_out_a_calls_own_figures_once(spark):
    """What the match table takes from one call alone is worked out before calls are paired, with the same rows."""
    base, comp = _crowd(spark, 5)
    p = Params(pctseq=0, sizemin=60, sizefilt=50, sizemax=600)
    b = bn.bench(base, comp, p)
    above, _, _ = b.matches.select("bid", "cid", "gt_match")._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert "lambda" not in above
    k = b.chunked
    plain = bn.matching.compared(bn.matching.near_pairs(k.where("side = 'base'"), k.where("side = 'comp'"), p), p)
    assert plain.count() == b.matches.count() > 0
    assert plain.columns == b.matches.columns and not plain.exceptAll(b.matches).count()


@pytest.mark.parametrize("chain", [False, True])
@pytest.mark.parametrize("changes", [{}, {"typeignore": True}, {"dup_to_ins": True, "refdist": 0}, {"pctsize": 0}])
def test_collapsing_makes_no_pairs(spark, monkeypatch, chain, changes):
    """Near calls that differ, empty and giant ones too, collapse as their pairs would have it, and no table of pairs is made."""
    rng = random.Random(21)
    rows = []
    for i in range(220):
        s, size = rng.randrange(0, 9000), rng.choice([50, 60, 66, 73, 81, 90, 100, 111, 300])
        end = s + rng.choice([size, size, size, 0, 1, 7000])
        rows.append((i, rng.choice("ab"), s, end, s + 1, "N", "<DEL>", rng.choice(["DEL", "INS", "DUP", None]), size, float(i % 7), [[0, 1]]))
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, pos long, ref string, alt string, svtype string, svlen long, qual double, gts array<array<int>>")
    p = Params(**{"pctseq": 0, "pctsize": 0.9, "refdist": 100, "chunksize": 500, "short_circuit": True, "skip_gt": True, "sizefilt": 50} | changes)
    made, real = [], co.stored
    monkeypatch.setattr(co, "stored", lambda d, name="step": made.append(name) or real(d, name))

    def removed():
        return sorted(map(tuple, co.collapse(df, p, keep="maxqual", chain=chain, consolidate=False)[1].select("id", "keeper").collect()))

    got = removed()
    assert "matches" not in made
    monkeypatch.setattr(co.partners, "able", lambda *_: False)
    assert got == removed() and "matches" in made and len(got) > 20


@pytest.mark.parametrize("rule", ["single", "multi"])
@pytest.mark.parametrize("changes", [{}, {"typeignore": True, "pctsize": 0}, {"refdist": 0, "dup_to_ins": True}])
def test_matches_are_assigned_without_pairs(spark, monkeypatch, rule, changes):
    """Crowded calls, empty and giant ones too, get from their best partners what all pairs give; failed pairs also where an end is unknown."""
    from svloom.operators import matching, pick

    rng = random.Random(31)
    rows = []
    for i in range(150):
        start, size = rng.randrange(0, 9000, 30), rng.choice([60, 61, 70, 75, 90, 200, 300, 301, 580])
        end = rng.choice([start + size] * 6 + [start, start + 1, start + 3000])
        rows.append((i, "a", start, end, rng.choice(["DEL", "INS", "DUP", "DUP", None]), size, [0, 1]))
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, svtype string, svlen long, alleles array<int>")
    p = Params(**{"pctseq": 0, "pick": rule, "sizemin": 60, "sizefilt": 50} | changes)
    blocks = stored(df.withColumns({"side": F.when(F.col("id") % 5 < 3, "base").otherwise("comp"), "chunk_id": F.lit("a:1")}), "blocks")
    pairs = matching.compared(matching.near_pairs(blocks.where("side = 'base'"), blocks.where("side = 'comp'"), p), p)
    shown = ["side", "id", "bid", "cid", "state", F.round("score", 6), "st_dist", "ed_dist"]
    want = sorted((tuple(r) for r in pick.PICKERS[rule](pairs).where("state").select(shown).collect()), key=str)
    apart, by_type = blocks.where("id % 3 = 0").withColumn("svtype", F.col("side")), p.but(typeignore=False)
    cases = [apart, apart.withColumn("end", F.when(F.col("id") % 4 > 0, F.col("end")))]
    walked = [sorted(map(tuple, pick._failed_greedily(x, by_type).select("bid", "cid").collect())) for x in cases]
    monkeypatch.setattr(pick, "FEW_PAIRS", 0)
    assert walked == [sorted(map(tuple, pick._failed_greedily(x, by_type).select("bid", "cid").collect())) for x in cases] and len(walked[0]) > 10
    monkeypatch.setattr(matching, "matching_pairs", lambda *_: pytest.fail("pairs of all that match were made"))
    assert sorted((tuple(r) for r in pick.won(blocks, p).select(shown).collect()), key=str) == want and len(want) > 10


def test_calls_are_taken_apart_without_reading_alleles(spark):
    """The breakends of a call are those that its spelled ones read as, and places aren't filed on levels that nothing lies on."""
    from svloom.functions import variants as v

    calls = spark.createDataFrame([("a:1", 100, 600, t) for t in ("DEL", "DUP", "INV", "INS", None)], "chrom string, pos long, end long, svtype string")
    whole = [F.col(c) for c in calls.columns]
    spelled = calls.select("svtype", F.explode(v.decomposed(*whole)).alias("x")).select("svtype", "x.pos", v.bnd_mate(F.col("x.alt")).alias("m"), v.bnd_direction(F.col("x.alt")).alias("d"))
    want = spelled.select("svtype", "pos", "m.chrom2", "m.pos2", "d.direction", "d.strand")
    got = calls.select("svtype", F.inline(v.decomposed_ends(*whole)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    ends = spark.createDataFrame([("a", 5, 9, 50, 59)], "k string, s long, e long, s2 long, e2 long")
    places = [("s", "e"), ("s2", "e2")]
    other = ends.toDF("k", "t", "f", "t2", "f2")
    joined = op.two_place_join(ends, other, ["k"], places, [("t", "f"), ("t2", "f2")], sparse=True)
    assert joined.count() == 1 and "[0,1,2,3]" not in joined._jdf.queryExecution().optimizedPlan().toString()
