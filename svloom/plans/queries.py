"""One query per operator over the synthetic tables, and for each the plain SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from ..functions import intervals as iv
from ..functions import sequences as sq
from ..functions import variants as v
from ..operators import annotations as an
from ..operators import bench as bn
from ..operators import collapse as co
from ..operators import intervals as op
from ..operators import matching, sets, stats
from ..params import Params
from ..streaming.chunks import streamed_chunks
from . import synth
from .synth import ALLELES, CALLS, DAYS, GENOTYPES, SEQUENCES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


BENCH = Params(pctseq=0, sizemin=60, sizefilt=50, sizemax=600)

_CHUNKS = f"""WITH {CALLS},
f AS (SELECT * FROM iv WHERE svlen <= 600 AND svlen >= CASE WHEN side = 'base' THEN 60 ELSE 50 END),
g AS (SELECT f.* FROM f WHERE chrom IN (SELECT chrom FROM iv WHERE side = 'base')),
w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, side, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM g),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far + 1000 < s THEN 1 ELSE 0 END)
        OVER (PARTITION BY chrom ORDER BY s, side, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w),
c AS (SELECT *, chrom || ':' || CAST(CAST(no AS BIGINT) AS VARCHAR) AS chunk_id FROM k)"""

_MATCHES = (
    _CHUNKS
    + """,
p AS (SELECT b.chunk_id, b.id AS bid, c.id AS cid, b.svtype = c.svtype AS type_ok,
   greatest(b.s - 500, c.s) < least(b.e + 500, c.e) AS near,
   least(b.svlen, c.svlen) / CAST(greatest(b.svlen, c.svlen) AS DOUBLE) AS sizesim, b.svlen - c.svlen AS sizediff,
   b.s - CASE WHEN b.svtype = 'INS' THEN b.svlen // 2 ELSE 0 END AS bs, b.e + CASE WHEN b.svtype = 'INS' THEN b.svlen // 2 ELSE 0 END AS be,
   c.s - CASE WHEN c.svtype = 'INS' THEN c.svlen // 2 ELSE 0 END AS cs, c.e + CASE WHEN c.svtype = 'INS' THEN c.svlen // 2 ELSE 0 END AS ce,
   b.s - c.s AS st_dist, b.e - c.e AS ed_dist, b.a1 AS ba1, b.a2 AS ba2, c.a1 AS ca1, c.a2 AS ca2
   FROM c b JOIN c ON b.chunk_id = c.chunk_id AND b.side = 'base' AND c.side = 'comp'),
o AS (SELECT *, CASE WHEN greatest(bs, cs) < least(be, ce) THEN (least(be, ce) - greatest(bs, cs)) / CAST(greatest(be - bs, ce - cs) AS DOUBLE) ELSE 0.0 END AS ovlpct FROM p),
m AS (SELECT *, type_ok AND near AND sizesim >= 0.7 AS ok, (0.0 + sizesim + ovlpct) / 3 * 100 AS score,
   (CASE WHEN ba1 = 1 THEN 1 ELSE 0 END) + (CASE WHEN ba2 = 1 THEN 1 ELSE 0 END) AS bn,
   (CASE WHEN ca1 = 1 THEN 1 ELSE 0 END) + (CASE WHEN ca2 = 1 THEN 1 ELSE 0 END) AS cn FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ok DESC, score DESC, abs(st_dist), abs(ed_dist), bid, cid) AS rk FROM m)"""
)


def _bench(spark: SparkSession, sf_dir: str, **changes) -> bn.Bench:
    calls = synth.calls(spark, sf_dir)
    return bn.bench(calls.where("side = 'base'").drop("side"), calls.where("side = 'comp'").drop("side"), BENCH.but(**changes))


def _picked(b: bn.Bench) -> DataFrame:
    return b.picked.select("side", "id", "bid", "cid", "state", "multi", *r6("score", "sizesim", "ovlpct"), "st_dist", "ed_dist")


_SINGLE = (
    _MATCHES
    + """,
u AS (SELECT chunk_id, unnest(list_reduce(list({'bid': bid, 'cid': cid} ORDER BY rk),
     lambda a, x: CASE WHEN list_contains(a.b, x.bid) OR list_contains(a.c, x.cid) THEN a
       ELSE {'b': list_append(a.b, x.bid), 'c': list_append(a.c, x.cid), 'u': list_append(a.u, x)} END,
     {'b': CAST([] AS BIGINT[]), 'c': CAST([] AS BIGINT[]), 'u': CAST([] AS STRUCT(bid BIGINT, cid BIGINT)[])}).u) AS x FROM r GROUP BY chunk_id),
won AS (SELECT r.* FROM r JOIN u ON r.chunk_id = u.chunk_id AND r.bid = u.x.bid AND r.cid = u.x.cid),
lb AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY ok DESC, score DESC, cid) AS n FROM m WHERE bid NOT IN (SELECT bid FROM won)),
lc AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ok DESC, score DESC, bid) AS n FROM m WHERE cid NOT IN (SELECT cid FROM won)),
picked AS (
SELECT 'base' AS side, bid AS id, bid, cid, ok AS state, false AS multi, score, sizesim, ovlpct, st_dist, ed_dist, bn, cn FROM won
UNION ALL SELECT 'comp', cid, bid, cid, ok, false, score, sizesim, ovlpct, st_dist, ed_dist, bn, cn FROM won
UNION ALL SELECT 'base', bid, bid, cid, false, ok, score, sizesim, ovlpct, st_dist, ed_dist, bn, cn FROM lb WHERE n = 1
UNION ALL SELECT 'comp', cid, bid, cid, false, ok, score, sizesim, ovlpct, st_dist, ed_dist, bn, cn FROM lc WHERE n = 1)"""
)
_SHOW = " SELECT side, id, bid, cid, state, multi, round(score, 6) AS score, round(sizesim, 6) AS sizesim, round(ovlpct, 6) AS ovlpct, st_dist, ed_dist FROM picked"


@query(_SINGLE + _SHOW)
def bench_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two sides compared and assigned one to one."""
    return _picked(_bench(spark, sf_dir))


@query(
    _MATCHES
    + """, picked AS (
SELECT 'base' AS side, bid AS id, bid, cid, ok AS state, false AS multi, score, sizesim, ovlpct, st_dist, ed_dist
  FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY rk) AS n FROM r) WHERE n = 1
UNION ALL SELECT 'comp', cid, bid, cid, ok, false, score, sizesim, ovlpct, st_dist, ed_dist
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY rk) AS n FROM r) WHERE n = 1)"""
    + _SHOW
)
def bench_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_bench(spark, sf_dir, pick="multi"))


@query(
    _MATCHES.replace("ELSE 50 END),", "ELSE 50 END AND (coalesce(a1, 0) = 1 OR a2 = 1)),")
    + """,
u AS (SELECT chunk_id, unnest(list_reduce(list({'bid': bid, 'cid': cid, 'bn': bn, 'cn': cn} ORDER BY rk),
     lambda a, x: CASE WHEN coalesce(list_sum(list_transform(list_filter(a.u, lambda y: y.ok AND y.bid = x.bid), lambda y: y.cn)), 0) >= x.bn
                         OR coalesce(list_sum(list_transform(list_filter(a.u, lambda y: y.ok AND y.cid = x.cid), lambda y: y.bn)), 0) >= x.cn
       THEN {'u': list_append(a.u, {'bid': x.bid, 'cid': x.cid, 'bn': x.bn, 'cn': x.cn, 'ok': false})}
       ELSE {'u': list_append(a.u, {'bid': x.bid, 'cid': x.cid, 'bn': x.bn, 'cn': x.cn, 'ok': true})} END,
     {'u': CAST([] AS STRUCT(bid BIGINT, cid BIGINT, bn INT, cn INT, ok BOOLEAN)[])}).u) AS x FROM r WHERE ok GROUP BY chunk_id),
q AS (SELECT r.*, coalesce(u.x.ok, false) AS won, coalesce(NOT u.x.ok, false) AS multi FROM r LEFT JOIN u ON r.chunk_id = u.chunk_id AND r.bid = u.x.bid AND r.cid = u.x.cid),
picked AS (
SELECT 'base' AS side, bid AS id, bid, cid, won AS state, multi, score, sizesim, ovlpct, st_dist, ed_dist
  FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY won DESC, rk) AS n FROM q) WHERE n = 1
UNION ALL SELECT 'comp', cid, bid, cid, won, multi, score, sizesim, ovlpct, st_dist, ed_dist
  FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY won DESC, rk) AS n FROM q) WHERE n = 1)"""
    + _SHOW
)
def bench_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(_bench(spark, sf_dir, pick="ac"))


_VERDICTS = (
    _SINGLE
    + """,
sv AS (SELECT c.side, c.id, c.chrom, c.s, c.e, c.svlen, c.chunk_id, coalesce(x.state, false) AS state, x.bn, x.cn FROM c LEFT JOIN picked x ON c.side = x.side AND c.id = x.id),
vd AS (SELECT *, CASE WHEN side = 'base' THEN CASE WHEN state THEN 'tpbase' ELSE 'fn' END ELSE CASE WHEN state THEN 'tp' ELSE 'fp' END END AS verdict
       FROM sv WHERE NOT (side = 'comp' AND NOT state AND svlen < 60))"""
)
_METRICS = """
SELECT *, CASE WHEN tp_base + fn > 0 AND tp_comp + fp > 0 THEN round(tp_comp / CAST(tp_comp + fp AS DOUBLE), 6) END AS precision,
  CASE WHEN tp_base + fn > 0 AND tp_comp + fp > 0 THEN round(tp_base / CAST(tp_base + fn AS DOUBLE), 6) END AS recall FROM n"""


@query(
    _VERDICTS
    + ", n AS (SELECT count_if(verdict = 'tpbase') AS tp_base, count_if(verdict = 'tp') AS tp_comp, count_if(verdict = 'fp') AS fp, count_if(verdict = 'fn') AS fn,"
    " count_if(verdict = 'tp' AND bn = cn) AS tp_comp_tp_gt, count_if(verdict = 'tp' AND bn <> cn) AS tp_comp_fp_gt FROM vd)"
    + _METRICS
)
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _bench(spark, sf_dir).summary()
    return s.select("tp_base", "tp_comp", "fp", "fn", "tp_comp_tp_gt", "tp_comp_fp_gt", *r6("precision", "recall"))


@query(
    _VERDICTS
    + """ SELECT chrom, greatest(min(CASE WHEN side = 'comp' OR svlen >= 60 THEN s END) - 10, 0) AS start, max(CASE WHEN side = 'comp' OR svlen >= 60 THEN e END) + 10 AS "end"
FROM sv GROUP BY chunk_id, chrom HAVING bool_or(NOT state)"""
)
def refine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).refine_candidates()


@query(_VERDICTS + " SELECT bn AS base_n, cn AS comp_n, count(*) AS n FROM vd WHERE verdict = 'tpbase' GROUP BY 1, 2")
def genotype_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bench(spark, sf_dir)
    m = b.won.where("side = 'base'")
    return m.groupBy(F.col("base_gt_count").alias("base_n"), F.col("comp_gt_count").alias("comp_n")).agg(F.count("*").alias("n"))


@query(_CHUNKS + " SELECT side, id, chunk_id FROM c")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).chunked.select("side", "id", "chunk_id")


@query(_CHUNKS + ' SELECT chunk_id, chrom, min(s) AS start, max(e) AS "end", count(*) AS n FROM c GROUP BY chunk_id, chrom')
def chunk_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.chunk_census(_bench(spark, sf_dir).chunked)


@query(_MATCHES + " SELECT bid, cid, ok AS state, round(score, 6) AS score, sizediff, st_dist, ed_dist, abs(bn - cn) AS gt_match FROM m")
def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).matches.select("bid", "cid", "state", *r6("score"), "sizediff", "st_dist", "ed_dist", "gt_match")


@query(
    f"""WITH {ALLELES}, b AS (SELECT * FROM sq WHERE id % 2 = 0 AND seq <> ''), c AS (SELECT * FROM sq WHERE id % 2 = 1 AND seq <> '')
SELECT b.id AS bid, c.id AS cid, round((length(b.seq) + length(c.seq) - levenshtein(b.seq, c.seq)) / CAST(length(b.seq) + length(c.seq) AS DOUBLE), 6) AS seqsim
FROM b JOIN c ON b.kind = c.kind AND c.id - b.id BETWEEN -5 AND 5"""
)
def sequence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of sequences as insertions at neighbouring places, by the comparison's own expressions."""
    s = synth.alleles(spark, sf_dir).where("seq <> ''")
    calls = s.select(
        "id", F.col("kind").alias("chrom"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 1).alias("end"),
        F.lit("INS").alias("svtype"), F.length("seq").cast("long").alias("svlen"), F.lit("A").alias("ref"), F.col("seq").alias("alt"),
        F.when(F.col("id") % 2 == 0, "base").otherwise("comp").alias("side"),
    )
    p = Params(sizemin=1, sizefilt=1, refdist=500, no_roll=True, pctseq=0.0001, pctsize=0, chunksize=500)
    near = op.range_join(
        calls.where("side = 'base'").select("id", "chrom", (F.col("start") - 500).alias("lo"), (F.col("start") + 501).alias("hi")),
        calls.where("side = 'comp'").select(F.col("id").alias("cid"), "chrom", "start", "end"), ["chrom"], ("lo", "hi"), ("start", "end"),
    )
    data = [c for c in calls.columns if c != "side"]
    b, c = calls.select(F.col("id").alias("bi"), F.struct(*data).alias("b")), calls.select(F.col("id").alias("ci"), F.struct(*data).alias("c"))
    paired = near.select(F.col("id").alias("bi"), F.col("cid").alias("ci")).join(b, "bi").join(c, "ci").select(F.col("b.chrom").alias("chunk_id"), "b", "c")
    return matching.compared(paired, p).select("bid", "cid", *r6("seqsim"))


# -- scalar functions ----------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = synth.alleles(spark, sf_dir).where("seq <> ''")
    both = s.select("id", F.col("seq").alias("a")).join(s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("b")), "id")
    # small tables cost long comparisons: they are dealt to all cores, which a join of one small file isn't
    return both.repartition(4 * spark.sparkContext.defaultParallelism, "id")


_PAIRS = f"WITH {ALLELES}, pr AS (SELECT x.id, x.seq AS a, y.seq AS b FROM sq x JOIN sq y ON y.id = x.id + 1 WHERE x.seq <> '' AND y.seq <> '')"


def _sim(a: str, b: str) -> str:
    return f"((length({a}) + length({b}) - levenshtein({a}, {b})) / CAST(length({a}) + length({b}) AS DOUBLE))"


def _roll(a: str) -> str:
    return f"list_min(list_transform(range(1, length({a}) + 1), lambda i: substr({a} || {a}, CAST(i AS BIGINT), length({a}))))"


def _turn(b: str, f: str) -> str:
    k = f"((({f}) % length({b}) + length({b})) % length({b}))"
    return f"(CASE WHEN {k} = 0 THEN {b} ELSE right({b}, {k}) || left({b}, length({b}) - {k}) END)"


@query(_PAIRS + f" SELECT id, round({_sim('a', 'b')}, 6) AS seqsim FROM pr")
def fn_seqsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", F.round(sq.similarity(F.col("a"), F.col("b")), 6).alias("seqsim"))


@query(_PAIRS + f", t AS (SELECT id, {_roll('a')} AS ra, {_roll('b')} AS rb FROM pr) SELECT id, ra AS rolled, round({_sim('ra', 'rb')}, 6) AS rollsim FROM t")
def fn_roll_seqsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("id", sq.smallest_rotation(F.col("a")).alias("rolled"), F.round(sq.rolled_similarity(F.col("a"), F.col("b")), 6).alias("rollsim"))


@query(_PAIRS + f", t AS (SELECT id, a, {_turn('b', 'id % 17 - 8')} AS b FROM pr) SELECT id, round({_sim('a', 'b')}, 6) AS unroll FROM t")
def fn_unroll_seqsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("id", F.round(sq.unrolled_similarity(F.col("a"), F.col("b"), (F.col("id") % 17 - 8).cast("int")), 6).alias("unroll"))


@query(
    _PAIRS
    + f""", t AS (SELECT id, a, b, {_turn('b', 'id % 17 - 8')} AS b1, {_turn('b', '8 - id % 17')} AS b2, {_turn('a', 'id % 17 - 8')} AS a1, {_turn('a', '8 - id % 17')} AS a2,
 length(a) < 500 AND length(b) < 500 AS short, {_roll('a')} AS ra, {_roll('b')} AS rb FROM pr)
SELECT id, round(greatest({_sim('a', 'b')}, {_sim('a', 'b1')}, {_sim('a', 'b2')}, {_sim('b', 'a1')}, {_sim('b', 'a2')}, CASE WHEN short THEN {_sim('ra', 'rb')} ELSE 0 END), 6) AS best FROM t"""
)
def fn_best_seqsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("id", F.round(sq.best_similarity(F.col("a"), F.col("b"), (F.col("id") % 17 - 8).cast("int")), 6).alias("best"))


@query(
    f"""WITH {SEQUENCES}, l AS (SELECT id, seq, list_distinct(string_split(seq, '')) AS d FROM sq WHERE seq <> ''),
f AS (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM sq WHERE seq <> ''),
c AS (SELECT id, substr(seq, CAST(i AS BIGINT), 1) AS ch, min(i) AS pos, count(*) AS n, max(length(seq)) AS len FROM f GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM c)
SELECT sq.id, CAST(floor((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) * 100 / CAST(length(seq) AS DOUBLE)) AS INT) AS gcpct, e.lcr,
  reverse(translate(seq, 'ATCG', 'TAGC')) AS revcomp
FROM sq JOIN (SELECT id, round(sum(-(n / CAST(len AS DOUBLE)) * ln(n / CAST(len AS DOUBLE)) / ln(4.0)), 6) AS lcr FROM t WHERE k <= 4 GROUP BY id) e ON sq.id = e.id WHERE seq <> ''"""
)
def anno_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC percent, entropy and reverse complement."""
    s = synth.sequences(spark, sf_dir).where("seq <> ''")
    return s.select("id", sq.gc_percent(F.col("seq")).alias("gcpct"), F.round(sq.entropy(F.col("seq")), 6).alias("lcr"), sq.reverse_complement(F.col("seq")).alias("revcomp"))


@query(
    f"""WITH {CALLS}, p AS (SELECT id, s AS s1, e AS e1, s + id % 300 - 100 AS s2, e + id % 170 AS e2, svlen AS a, svlen * (id % 3) AS b FROM iv)
SELECT id, greatest(s1, s2) < least(e1, e2) AS ovl, round(CASE WHEN greatest(s1, s2) < least(e1, e2) THEN (least(e1, e2) - greatest(s1, s2)) / CAST(greatest(e1 - s1, e2 - s2) AS DOUBLE) ELSE 0 END, 6) AS recip,
 round(CASE WHEN s1 >= s2 AND e1 <= e2 THEN 1 ELSE greatest(least(e1, e2) - greatest(s1, s2), 0) / CAST(e1 - s1 AS DOUBLE) END, 6) AS pct,
 round(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE least(greatest(a, 1), greatest(b, 1)) / CAST(greatest(greatest(a, 1), greatest(b, 1)) AS DOUBLE) END, 6) AS sizesim,
 CASE WHEN a = 0 AND b = 0 THEN 0 ELSE greatest(a, 1) - greatest(b, 1) END AS sizediff,
 ((s1 = s2 OR s1 = s2 - 1) AND e1 = e2) OR (s1 >= s2 AND e1 <= e2) AS inside FROM p"""
)
def fn_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir)
    i, s1, e1 = F.col("id"), F.col("start"), F.col("end")
    s2, e2, a, b = s1 + i % 300 - 100, e1 + i % 170, F.col("svlen"), F.col("svlen") * (i % 3)
    return c.select(
        "id", iv.overlaps(s1, e1, s2, e2).alias("ovl"), F.round(iv.reciprocal_overlap(s1, e1, s2, e2), 6).alias("recip"), F.round(iv.overlap_percent(s1, e1, s2, e2), 6).alias("pct"),
        F.round(iv.size_similarity(a, b), 6).alias("sizesim"), iv.size_difference(a, b).alias("sizediff"), iv.within(s1, e1, s2, e2, F.lit(True)).alias("inside"),
    )


_BOUNDS = " ".join(f"WHEN size < {b} THEN '{n}'" for b, n in zip(v.SIZE_BOUNDS, v.SIZE_BINS, strict=False))


@query(
    f"""SELECT p_partkey AS id, CASE {_BOUNDS} ELSE '>=5k' END AS szbin,
 CASE WHEN y >= 100 THEN '>=100' ELSE '[' || CAST(CAST(greatest(floor(y / 10), 0) AS INT) * 10 AS VARCHAR) || ',' || CAST(CAST(greatest(floor(y / 10), 0) AS INT) * 10 + 10 AS VARCHAR) || ')' END AS scalebin
FROM (SELECT p_partkey, (p_partkey % 7000) AS size, (p_size - 1) / 40.0 * 100 AS y FROM part)"""
)
def fn_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), v.size_bin(F.col("p_partkey") % 7000).alias("szbin"), v.scale_bin(F.col("p_size"), 1, 41, 0, 100, 10)["bin"].alias("scalebin"))


_RECORDS = f"""{SEQUENCES}, al AS (SELECT id, CASE WHEN id % 3 = 0 THEN seq ELSE substr(seq, 1, 1) END AS ref, CASE WHEN id % 3 = 0 THEN substr(seq, 1, 1) ELSE seq END AS other FROM sq WHERE seq <> ''),
 rec AS (SELECT id, id * 10 AS s, id * 10 + CASE WHEN id % 5 = 0 THEN 400 + id % 90 ELSE length(ref) END AS e, ref,
 CASE id % 5 WHEN 0 THEN '<DEL>' WHEN 1 THEN 'N[chr2:' || CAST(id AS VARCHAR) || '[' WHEN 2 THEN other WHEN 3 THEN '<DUP:TANDEM>' ELSE '*' END AS alt FROM al)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's letters as a deleted or an inserted sequence, or beside a symbolic allele, a breakend or a star."""
    s = synth.sequences(spark, sf_dir).where("seq <> ''")
    i, first = F.col("id"), F.substring("seq", 1, 1)
    ref = F.when(i % 3 == 0, F.col("seq")).otherwise(first)
    alt = (
        F.when(i % 5 == 0, "<DEL>").when(i % 5 == 1, F.concat(F.lit("N[chr2:"), i.cast("string"), F.lit("["))).when(i % 5 == 2, F.when(i % 3 == 0, first).otherwise(F.col("seq")))
        .when(i % 5 == 3, "<DUP:TANDEM>").otherwise("*")
    )
    end = i * 10 + F.when(i % 5 == 0, 400 + i % 90).otherwise(F.length(ref))
    return s.select("id", F.lit("chr1").alias("chrom"), (i * 10).alias("start"), end.alias("end"), ref.alias("ref"), alt.alias("alt"))


@query(
    f"""WITH {_RECORDS} SELECT id, CASE WHEN contains(alt, '[') THEN 'BND' WHEN alt = '*' THEN 'UNK' WHEN alt = '<DEL>' THEN 'DEL' WHEN alt = '<DUP:TANDEM>' THEN 'DUP'
  WHEN length(ref) = length(alt) THEN CASE WHEN length(ref) = 1 THEN 'SNP' ELSE 'UNK' END WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'INS' END AS svtype,
 CASE WHEN alt LIKE '<%' OR alt = '*' THEN e - s WHEN length(ref) = length(alt) THEN CASE WHEN length(ref) = 1 THEN 0 ELSE length(ref) END ELSE abs(length(ref) - length(alt)) END AS svlen,
 alt LIKE '<%' AS symbolic, alt = '*' AS monref, CASE WHEN contains(alt, '[') THEN CAST(id AS BIGINT) END AS pos2, CASE WHEN contains(alt, '[') THEN 'left' END AS direction,
 sha1('chr1:' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) || '.' || alt) AS hash FROM rec"""
)
def fn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, size, flags, breakend parts and hashed key of records."""
    r = _records(spark, sf_dir)
    bnd = v.is_bnd(F.col("alt"))
    return r.select(
        "id", v.sv_type(F.col("ref"), F.col("alt"), F.lit(None).cast("string")).alias("svtype"), v.sv_size(F.col("start"), F.col("end"), F.col("ref"), F.col("alt"), F.lit(None).cast("long")).alias("svlen"),
        v.is_symbolic(F.col("alt")).alias("symbolic"), v.is_monref_or_star(F.col("alt")).alias("monref"), F.when(bnd, v.bnd_mate(F.col("alt"))["pos2"]).alias("pos2"),
        F.when(bnd, v.bnd_direction(F.col("alt"))["direction"]).alias("direction"), F.sha1(v.key(F.col("chrom"), F.col("start"), F.col("end"), F.col("alt"))).alias("hash"),
    )


@query(
    f"""WITH {CALLS}, k AS (SELECT id, chrom, s + 1 AS pos, e AS stop, CASE WHEN svtype = 'INS' THEN 'INV' ELSE svtype END AS t FROM iv)
SELECT id, pos AS pos, 'N[' || chrom || ':' || CAST(stop + 1 AS VARCHAR) || '[' AS alt FROM k WHERE t = 'DEL'
UNION ALL SELECT id, stop + 1, ']' || chrom || ':' || CAST(pos AS VARCHAR) || ']N' FROM k WHERE t = 'DEL'
UNION ALL SELECT id, pos + 1, ']' || chrom || ':' || CAST(stop AS VARCHAR) || ']N' FROM k WHERE t = 'DUP'
UNION ALL SELECT id, stop, 'N[' || chrom || ':' || CAST(pos + 1 AS VARCHAR) || '[' FROM k WHERE t = 'DUP'
UNION ALL SELECT id, pos, 'N]' || chrom || ':' || CAST(stop AS VARCHAR) || ']' FROM k WHERE t = 'INV'
UNION ALL SELECT id, pos + 1, '[' || chrom || ':' || CAST(stop + 1 AS VARCHAR) || '[N' FROM k WHERE t = 'INV'
UNION ALL SELECT id, stop, 'N]' || chrom || ':' || CAST(pos AS VARCHAR) || ']' FROM k WHERE t = 'INV'
UNION ALL SELECT id, stop + 1, '[' || chrom || ':' || CAST(pos + 1 AS VARCHAR) || '[N' FROM k WHERE t = 'INV'"""
)
def bnd_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir).withColumn("t", F.when(F.col("svtype") == "INS", "INV").otherwise(F.col("svtype")))
    return c.select("id", F.inline(v.decomposed(F.col("chrom"), F.col("pos"), F.col("end"), F.col("t"))))


# -- intervals -----------------------------------------------------------------


@query(
    f"""WITH {CALLS}, w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far < s THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w)
SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n FROM k GROUP BY chrom, no"""
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_intervals(synth.calls(spark, sf_dir), ["chrom"]).select("chrom", "start", "end", "n")


@query(f"WITH {CALLS} SELECT a.id AS a_id, b.id AS b_id FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.side = 'base' AND b.side = 'comp' AND greatest(a.s - 500, b.s) < least(a.e + 500, b.e)")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir)
    a = c.where("side = 'base'").select(F.col("id").alias("a_id"), "chrom", (F.col("start") - 500).alias("lo"), (F.col("end") + 500).alias("hi"))
    b = c.where("side = 'comp'").select(F.col("id").alias("b_id"), "chrom", "start", "end")
    return op.range_join(a, b, ["chrom"], ("lo", "hi"), ("start", "end")).select("a_id", "b_id")


_INSIDE = "((iv.s = rs OR iv.s = rs - 1) AND iv.e = re) OR (iv.s >= rs AND CASE WHEN iv.svtype = 'INS' THEN iv.e < re ELSE iv.e <= re END)"


@query(f"WITH {CALLS}, {DAYS} SELECT region_id, (SELECT count(*) FROM iv WHERE iv.chrom = days.chrom AND ({_INSIDE})) AS count FROM days")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_within(synth.calls(spark, sf_dir), synth.days(spark), ["chrom"], F.col("svtype") != "INS").select("region_id", "count")


@query(
    _VERDICTS.replace("WITH ", f"WITH {DAYS},", 1)
    + """ SELECT region_id, count(*) FILTER (WHERE verdict = 'tpbase') AS tpbase, count(*) FILTER (WHERE verdict = 'tp') AS tp, count(*) FILTER (WHERE verdict = 'fn') AS fn, count(*) FILTER (WHERE verdict = 'fp') AS fp
FROM days LEFT JOIN (SELECT vd.*, c.svtype FROM vd JOIN c ON vd.side = c.side AND vd.id = c.id) z ON z.chrom = days.chrom
 AND (((z.s = rs OR z.s = rs - 1) AND z.e = re) OR (z.s >= rs AND CASE WHEN z.svtype = 'INS' THEN z.e < re ELSE z.e <= re END)) GROUP BY region_id"""
)
def stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.stratify(_bench(spark, sf_dir).verdicts(), synth.days(spark)).select("region_id", "tpbase", "tp", "fn", "fp")


@query(f"WITH {CALLS}, {DAYS} SELECT count(*) AS count FROM iv WHERE NOT EXISTS (SELECT 1 FROM days WHERE days.chrom = iv.chrom AND iv.s >= rs AND iv.e <= re)")
def complement_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.complement_counts(synth.calls(spark, sf_dir), synth.days(spark))


@query(f'WITH {CALLS}, {DAYS} SELECT region_id FROM days WHERE EXISTS (SELECT 1 FROM iv WHERE iv.chrom = days.chrom AND iv.side = \'base\' AND iv.s < days.re + 1 AND days.rs < iv.e + 1)')
def region_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.touching_regions(synth.days(spark), synth.calls(spark, sf_dir).where("side = 'base'")).select("region_id")


@query(
    f"""WITH {CALLS}, b AS (SELECT chrom, s AS p FROM iv UNION SELECT chrom, e FROM iv), g AS (SELECT chrom, p AS ps, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS pe FROM b)
SELECT g.chrom, ps AS seg_start, pe AS seg_end, count(*) AS segcnt, CAST(sum(CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 WHEN a1 <> a2 THEN 1 WHEN a1 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS dose
FROM g JOIN iv ON iv.chrom = g.chrom AND iv.s < pe AND ps < iv.e GROUP BY 1, 2, 3"""
)
def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sets.segments(synth.calls(spark, sf_dir).withColumn("gts", F.array("alleles")))
    return s.select("chrom", "seg_start", "seg_end", "segcnt", F.get("seg", F.lit(0)).alias("dose"))


@query(
    f"""WITH {CALLS}, w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far + 1000 <= s THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w),
z AS (SELECT chrom, CAST(no AS BIGINT) AS no, count(*) AS n FROM k GROUP BY 1, 2),
f AS (SELECT chrom, list_reduce(list({{'no': no, 'n': n}} ORDER BY no), lambda a, x: CASE WHEN a.held >= 20 THEN {{'sh': a.sh + 1, 'held': x.n, 'o': list_append(a.o, {{'no': x.no, 'sh': a.sh + 1}})}}
  ELSE {{'sh': a.sh, 'held': a.held + x.n, 'o': list_append(a.o, {{'no': x.no, 'sh': a.sh}})}} END, {{'sh': 0, 'held': CAST(0 AS BIGINT), 'o': CAST([] AS STRUCT(no BIGINT, sh INT)[])}}).o AS o FROM z GROUP BY chrom),
u AS (SELECT chrom, unnest(o) AS x FROM f)
SELECT k.id, k.chrom || '_' || CAST(u.x.sh AS VARCHAR) AS shard FROM k JOIN u ON k.chrom = u.chrom AND k.no = u.x.no"""
)
def divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.shards(synth.calls(spark, sf_dir), 1000, 20).select("id", "shard")


@query(
    f"""WITH {CALLS}, x AS (SELECT id, chrom, s - 1000 AS lo, e + 1000 AS hi FROM iv WHERE svlen >= 50), w AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, id, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far <= lo THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, id, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neigh_id FROM w)
SELECT id, chrom, CAST(neigh_id AS BIGINT) AS neigh_id, (SELECT count(*) FROM x y WHERE y.chrom = k.chrom AND y.id <> k.id AND greatest(y.lo, k.lo) < least(y.hi, k.hi)) AS num_neighbors FROM k"""
)
def numneigh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.neighbors(synth.calls(spark, sf_dir))


@query(
    f"""WITH {CALLS}, win AS (SELECT DISTINCT iv.chrom, d * 43200 AS ws, (d + 1) * 43200 AS we FROM iv, range(60) t(d)),
n AS (SELECT chrom, ws, we, (SELECT count(*) FROM iv WHERE iv.chrom = win.chrom AND iv.s < we AND ws < iv.e) AS count FROM win)
SELECT chrom, ws AS start, we AS "end", count, CASE WHEN count > (SELECT avg(count) + 1.5 * stddev_samp(count) FROM n) THEN 'dense' WHEN count < (SELECT avg(count) - 1.5 * stddev_samp(count) FROM n) THEN 'sparse' END AS anno FROM n"""
)
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir)
    contigs = c.select("chrom").distinct().withColumn("length", F.lit(60 * 43200))
    return an.density(c, op.tiles(contigs, 43200).select("chrom", "start", "end"), 1.5)


@query(
    f"""WITH {CALLS}, {DAYS}, h AS (SELECT id, region_id, s, e, rs, re FROM iv JOIN days ON iv.chrom = days.chrom AND iv.s < re AND rs < iv.e + 1 WHERE svlen >= 50)
SELECT id, 'start_bnd' AS intersection, region_id AS anno_id FROM h WHERE s >= rs AND s < re UNION ALL SELECT id, 'end_bnd', region_id FROM h WHERE e >= rs AND e < re
UNION ALL SELECT id, 'overlaps', region_id FROM h WHERE s < re AND e > rs AND rs >= s AND re <= e UNION ALL SELECT id, 'contains', region_id FROM h WHERE s < re AND e > rs AND rs <= s AND re >= e"""
)
def bpovl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.breakpoint_overlap(synth.calls(spark, sf_dir), synth.days(spark).withColumnRenamed("region_id", "anno_id"))


@query(
    f"""WITH {CALLS}, m AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far < s THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM m),
u AS (SELECT chrom, min(s) AS s, max(e) AS e FROM k GROUP BY chrom, no),
x AS (SELECT chrom, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s), 0) AS gs, s AS ge FROM u UNION ALL SELECT chrom, max(e), 2600000 FROM u GROUP BY chrom)
SELECT chrom, gs AS start, least(ge, 2600000) AS "end" FROM x WHERE gs < least(ge, 2600000)"""
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls leave of their contigs."""
    c = synth.calls(spark, sf_dir)
    contigs = c.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("start"), F.lit(2600000).cast("long").alias("end"))
    return op.subtract(contigs, c)


@query(f'WITH {DAYS} SELECT region_id, rs + k * 30000 AS start, least(rs + (k + 1) * 30000, re) AS "end" FROM days, range(3) t(k) WHERE rs + k * 30000 < re AND chrom IN (SELECT event_type || \'_\' || CAST(user_id % 10 AS VARCHAR) FROM events)')
def region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions that hold calls and those that don't, in pieces; every contig of the calls has them."""
    held = synth.calls(spark, sf_dir).select("chrom").distinct()
    return op.region_tiles(synth.days(spark).join(held, "chrom", "left_semi"), 30_000).select("region_id", "start", "end")


# -- genotypes -----------------------------------------------------------------


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.genotype_rows(spark, sf_dir)
    return rows.groupBy("id").agg(F.collect_list("alleles").alias("gts"), F.collect_list("depth").alias("depths"))


_GT = "CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'NON' WHEN a1 = 0 AND a2 = 0 THEN 'REF' WHEN a1 <> a2 THEN 'HET' ELSE 'HOM' END"


@query(f"WITH {GENOTYPES}, t AS (SELECT id, {_GT} AS g FROM gr) SELECT id, count_if(g = 'NON') AS n_unk, count_if(g = 'REF') AS n_ref, count_if(g = 'HET') AS n_het, count_if(g = 'HOM') AS n_hom FROM t GROUP BY id")
def gtcnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = an.genotype_counts(_variants(spark, sf_dir))
    return g.select("id", *[F.get("gtcnt", F.lit(i)).alias(n) for i, n in enumerate(("n_unk", "n_ref", "n_het", "n_hom"))])


_AF = """t AS (SELECT {k}, count(a1) + count(a2) AS an, CAST(coalesce(sum(a1), 0) + coalesce(sum(a2), 0) AS BIGINT) AS ac1, count(*) FILTER (WHERE a1 <> a2) AS n_het, count(*) FILTER (WHERE a1 = 0 AND a2 = 0) AS n_homref,
  count(*) FILTER (WHERE a1 = 1 AND a2 = 1) AS n_homalt, count_if(a1 IS NULL AND a2 IS NULL) AS n_miss FROM gr GROUP BY {k})"""
_AF_COLS = """an, ac1, CASE WHEN an > 0 THEN round(ac1 / CAST(an AS DOUBLE), 6) ELSE 0 END AS af, CASE WHEN an > 0 THEN round(least(ac1, an - ac1) / CAST(an AS DOUBLE), 6) ELSE 0 END AS maf,
  least(ac1, an - ac1) AS mac, n_het, n_homref, n_homalt, n_miss"""


def _af(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, F.col("af.AN").cast("long").alias("an"), F.get("af.AC", F.lit(1)).cast("long").alias("ac1"), F.round("af.AF", 6).alias("af_"), F.round("af.MAF", 6).alias("maf"),
        F.col("af.MAC").cast("long").alias("mac"), *[F.col(f"af.{n.upper()}").cast("long").alias(n) for n in ("n_het", "n_homref", "n_homalt", "n_miss")],
    ).withColumnRenamed("af_", "af")


@query(f"WITH {GENOTYPES}, {_AF.format(k='id')} SELECT id, {_AF_COLS} FROM t")
def allele_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _af(an.sample_frequencies(synth.genotype_rows(spark, sf_dir), ["id"]), "id")


@query(f"WITH {GENOTYPES}, {_AF.format(k='id, grp')} SELECT id, grp, {_AF_COLS} FROM t")
def grpaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _af(an.group_frequencies(synth.genotype_rows(spark, sf_dir)), "id", F.col("group").alias("grp"))


@query(
    f"""WITH {GENOTYPES}, {_AF.format(k='id')}, c AS (SELECT id, least(ac1, an - ac1) AS rare, an // 2 AS n, n_het FROM t WHERE an > 0),
h AS (SELECT id, rare, n, n_het, unnest(range(rare % 2, rare + 1, 2)) AS k FROM c),
p AS (SELECT *, exp(k * ln(2.0) - lgamma((rare - k) / 2 + 1.0) - lgamma(k + 1.0) - lgamma(n - k - (rare - k) / 2 + 1.0)) AS w FROM h),
s AS (SELECT id, sum(w) AS tot, sum(CASE WHEN k >= n_het THEN w END) AS ge, sum(CASE WHEN k = n_het THEN w END) AS own FROM p GROUP BY id)
SELECT t.id, round(coalesce(ge / tot, 0), 6) AS exchet, round(coalesce(1 - least(coalesce((SELECT sum(w) FROM p WHERE p.id = t.id AND w > own * (1 + 1e-9)), 0) / tot, 1), 0), 6) AS hwe FROM t LEFT JOIN s ON s.id = t.id"""
)
def hardy_weinberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = an.sample_frequencies(synth.genotype_rows(spark, sf_dir), ["id"])
    return an.equilibrium(counts).select("id", F.round("hw.ExcHet", 6).alias("exchet"), F.round("hw.HWE", 6).alias("hwe"))


@query(f"WITH {GENOTYPES} SELECT id, count_if(depth < 5) AS d0, count_if(depth >= 5 AND depth < 10) AS d5, count_if(depth >= 10 AND depth < 15) AS d10, count_if(depth >= 15) AS d15 FROM gr GROUP BY id")
def dpcnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = an.depth_counts(_variants(spark, sf_dir), alt_depth=None)
    return d.select("id", *[F.get("dpcnt", F.lit(i)).alias(n) for i, n in enumerate(("d0", "d5", "d10", "d15"))])


@query(
    f"""WITH {CALLS}, x AS (SELECT id, chrom, greatest(s - 5000, 0) AS lo, e + 5000 AS hi FROM iv WHERE svlen >= 100),
y AS (SELECT chrom, s, {_GT} AS g FROM iv WHERE svlen <= 90),
j AS (SELECT x.id, count_if(g = 'HOM') AS h, count(g) AS n FROM x LEFT JOIN y ON x.chrom = y.chrom AND y.s < hi AND lo < y.s + 1 AND g IN ('HET', 'HOM') GROUP BY x.id)
SELECT id, CASE WHEN n < 1 THEN NULL ELSE round(h / CAST(n AS DOUBLE) * 100, 1) END AS hompct FROM j"""
)
def hompct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir)
    return an.hom_percent(c, c, 5000, 100, 90, 1)


# -- sets, metrics, statistics ---------------------------------------------------

_SETS = "s AS (SELECT l_orderkey AS key, CAST(bit_or(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 2 ELSE 1 END) AS BIGINT) AS flag FROM lineitem GROUP BY 1)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    no = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return sets.presence(li.select(F.col("l_orderkey").alias("key"), no.alias("file_no")), n_files=3)


@query(f"WITH {_SETS} SELECT lpad(bin(flag), 3, '0') AS \"group\", CAST(bit_count(flag) AS INT) AS n_files, count(*) AS total, round(count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS share FROM s GROUP BY flag")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.consistency(_sets(spark, sf_dir), 3).select("group", "n_files", "total", *r6("share"))


@query(f"WITH {_SETS} SELECT CAST(bit_count(flag) AS INT) AS n_files, count(*) AS total FROM s GROUP BY 1")
def consistency_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.shared(_sets(spark, sf_dir), 3)


@query(f"WITH {_SETS} SELECT f AS file_no, CAST(count(*) AS BIGINT) AS total FROM s, range(3) t(f) WHERE (flag >> (2 - f)) & 1 = 1 GROUP BY f")
def consistency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.per_file(_sets(spark, sf_dir), 3)


@query(
    """WITH n AS (SELECT count_if(quality = 1 AND toxic = 0) AS tp_base, count_if(toxic = 0) AS tp_comp, count_if(quality = 1 AND toxic = 1) AS fn, count_if(quality = 0 AND toxic = 0) AS fp FROM labels)
SELECT tp_base, tp_comp, fn, fp, round(tp_comp / CAST(tp_comp + fp AS DOUBLE), 6) AS precision, round(tp_base / CAST(tp_base + fn AS DOUBLE), 6) AS recall,
 round(2 * (tp_comp / CAST(tp_comp + fp AS DOUBLE)) * (tp_base / CAST(tp_base + fn AS DOUBLE)) / ((tp_comp / CAST(tp_comp + fp AS DOUBLE)) + (tp_base / CAST(tp_base + fn AS DOUBLE))), 6) AS f1 FROM n"""
)
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    n = table(spark, sf_dir, "labels").agg(F.count_if(q & t).alias("tp_base"), F.count_if(t).alias("tp_comp"), F.count_if(q & ~t).alias("fn"), F.count_if(~q & t).alias("fp"))
    return bn.with_metrics(n).select("tp_base", "tp_comp", "fn", "fp", *r6("precision", "recall", "f1"))


_STATE = "CASE WHEN tpbase = 0 AND tp = 0 AND fn = 0 AND fp = 0 THEN 'TN' WHEN fn = 0 AND fp = 0 AND tpbase > 0 AND tp > 0 THEN 'TP' WHEN fn > 0 AND fp > 0 THEN 'FN,FP' WHEN fp > 0 THEN 'FP' WHEN fn > 0 THEN 'FN' ELSE 'UNK' END"


def _regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.stratify(_bench(spark, sf_dir).verdicts(), synth.days(spark))


@query(
    "WITH st AS (" + ORACLES["stratify"] + f"), q AS (SELECT *, {_STATE} AS state FROM st)"
    + """ SELECT count_if(state = 'TP') AS TP, count_if(state = 'TN') AS TN, count_if(state LIKE '%FP%') AS FP, count_if(state LIKE '%FN%') AS FN, count_if(tpbase + fn > 0) AS base_P, count_if(tp + fp > 0) AS comp_P,
 count_if(state IN ('UNK', 'FN,FP')) AS UND, round(count_if(state = 'TP') / CAST(count_if(tp + fp > 0) AS DOUBLE), 6) AS PPV, round(count_if(state = 'TN') / CAST(count_if(tpbase + fn = 0) AS DOUBLE), 6) AS TNR FROM q"""
)
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _regional(spark, sf_dir).select(*[F.col(n).alias(f"out_{n}") for n in ("tpbase", "tp", "fn", "fp")])
    return bn.region_report(c).select("TP", "TN", "FP", "FN", "base_P", "comp_P", "UND", *r6("PPV", "TNR"))


@query(
    "WITH st AS (" + ORACLES["stratify"] + ") SELECT region_id, (fn > 0 AND fp > 0) OR (fn > 0 AND tp + fp > 0) OR (fp > 0 AND tpbase + fn > 0) AS refined FROM st"
)
def refine_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.haplotypes import needs_refinement

    c = _regional(spark, sf_dir).select("region_id", *[F.col(n).alias(f"in_{n}") for n in ("tpbase", "tp", "fn", "fp")])
    return needs_refinement(c).select("region_id", "refined")


@query(
    f"WITH {CALLS}, st AS (" + ORACLES["stratify"] + f"""), {DAYS}, n AS (SELECT region_id, count_if(iv.side = 'base') AS b, count_if(iv.side = 'comp') AS c FROM days JOIN iv ON iv.chrom = days.chrom AND ({_INSIDE}) GROUP BY 1)
SELECT st.region_id, (fn > 0 OR fp > 0) AND coalesce(b, 0) > 0 AND coalesce(c, 0) > 0 AS refined FROM st LEFT JOIN n ON n.region_id = st.region_id"""
)
def refine_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to refine where both original call sets have calls, whatever their size."""
    from ..operators.haplotypes import needs_original_refinement

    c = _regional(spark, sf_dir).select("region_id", "chrom", "start", "end", *[F.col(n).alias(f"in_{n}") for n in ("tpbase", "tp", "fn", "fp")])
    calls = synth.calls(spark, sf_dir)
    return needs_original_refinement(c, calls.where("side = 'base'"), calls.where("side = 'comp'")).select("region_id", "refined")


@query(f"WITH {CALLS}, {DAYS} SELECT id, chrom, s AS start FROM iv WHERE NOT EXISTS (SELECT 1 FROM days WHERE days.chrom = iv.chrom AND region_id NOT LIKE 'view%' AND ({_INSIDE}))")
def outside_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within no region, those of contigs without regions too."""
    regions = synth.days(spark).where("chrom NOT LIKE 'view%'")
    return bn.in_regions(synth.calls(spark, sf_dir), regions, inside=False).select("id", "chrom", "start")


@query(
    """WITH t AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'DEL' ELSE 'INS' END AS svtype, CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 10 END AS v, l_linenumber % 3 = 0 AS isolated FROM lineitem)
SELECT svtype, isolated, CASE WHEN v IS NULL OR v <= 0 THEN NULL WHEN v <= 0.05 THEN 'SomaticLow(<5%)' WHEN v <= 0.3 THEN 'Somatic' WHEN v <= 0.7 THEN 'GermlineHet' WHEN v <= 1 THEN 'GermlineHom' END AS VAF_bin, count(*) AS n FROM t GROUP BY 1, 2, 3"""
)
def preset_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of a preset, over line items as calls."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "DEL").otherwise("INS")
    flat = li.select(kind.alias("svtype"), F.lit("x").alias("szbin"), F.lit(True).alias("TRF"), (F.col("l_linenumber") % 3).alias("NumNeighbors"), F.when(F.col("l_discount") != 0, F.col("l_discount") * 10).alias("VAF_alt"))
    return stats.mims_features(flat)[0].groupBy("svtype", "isolated", "VAF_bin").agg(F.count("*").alias("n"))


@query(
    _VERDICTS
    + """ SELECT CASE WHEN verdict IN ('tpbase', 'tp') THEN 'TP' WHEN verdict = 'fn' THEN 'FN' ELSE 'FP' END AS BD,
 CASE WHEN verdict IN ('tpbase', 'tp') THEN CASE WHEN bn = cn THEN 'gm' ELSE 'am' END WHEN bn IS NOT NULL THEN 'lm' ELSE '.' END AS BK, CASE WHEN side = 'base' THEN 'truth' ELSE 'query' END AS "set", count(*) AS n FROM vd GROUP BY 1, 2, 3"""
)
def ga4gh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.haplotypes import truth_and_query

    return truth_and_query(_bench(spark, sf_dir).verdicts()).groupBy("BD", "BK", "set").agg(F.count("*").alias("n"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("f1"), (F.col("o_custkey") % 7).alias("f2"), (F.col("o_orderstatus") == "F").alias("ok"))


_ENRICH = """c AS (SELECT o_orderpriority AS f1, o_custkey % 7 AS f2, count(*) AS obs, count_if(o_orderstatus = 'F') AS hits FROM orders GROUP BY 1, 2),
e AS (SELECT *, obs * (SELECT sum(hits) FROM c) / CAST((SELECT sum(obs) FROM c) AS DOUBLE) AS ex FROM c),
s AS (SELECT f1, f2, obs, hits, sign(hits - ex) * (hits - ex) * (hits - ex) / ex AS score FROM e WHERE obs >= 10)"""


@query(f"WITH {_ENRICH} SELECT f1, f2, obs, hits, round(hits / CAST(obs AS DOUBLE), 6) AS acc, round(score, 6) AS score, row_number() OVER (ORDER BY score, f1, f2) - 1 AS rank FROM s")
def stratp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.enrichment(_strata(spark, sf_dir), ["f1", "f2"], F.col("ok")).select("f1", "f2", "obs", "hits", *r6("acc", "score"), "rank")


@query(
    f"""WITH {_ENRICH.replace('obs >= 10', 'obs >= 5')}, t AS (SELECT *, row_number() OVER (ORDER BY score, f1, f2) - 1 AS rank FROM s),
d AS (SELECT k, row_number() OVER w AS m, CAST(sum(rank) OVER w AS BIGINT) AS x FROM t, range(10000) p(k) WINDOW w AS (PARTITION BY k ORDER BY md5('42:' || k || ':' || rank), rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT 'f1' AS feature, CAST(f1 AS VARCHAR) AS value, count(*) AS m, CAST(sum(rank) AS BIGINT) AS own FROM t GROUP BY f1 UNION ALL SELECT 'f2', CAST(f2 AS VARCHAR), count(*), CAST(sum(rank) AS BIGINT) FROM t GROUP BY f2),
h AS (SELECT g.*, n, a FROM g, (SELECT count(*) AS n, CAST(sum(rank) AS BIGINT) AS a FROM t)),
u AS (SELECT feature, value, (own * n - a * h.m) / CAST(h.m * (n - h.m) AS DOUBLE) AS delta, (x * n - a * h.m) / CAST(h.m * (n - h.m) AS DOUBLE) AS y, x <= own AS below, h.m >= 5 AND n - h.m >= 5 AS tested FROM h JOIN d ON d.m = h.m),
v AS (SELECT feature, value, min(delta) AS delta, CASE WHEN bool_and(tested) THEN quantile_cont(y, 0.01) END AS q1, CASE WHEN bool_and(tested) THEN quantile_cont(y, 0.5) END AS q50, CASE WHEN bool_and(tested) THEN quantile_cont(y, 0.99) END AS q99,
  CASE WHEN bool_and(tested) THEN count_if(below) / 10000.0 END AS pval FROM u GROUP BY 1, 2),
o AS (SELECT 'f1' AS feature, CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS obs, count_if(o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS acc FROM orders GROUP BY 2
  UNION ALL SELECT 'f2', CAST(o_custkey % 7 AS VARCHAR), count(*), count_if(o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2),
r AS (SELECT *, pval * count(pval) OVER () / row_number() OVER (ORDER BY pval NULLS LAST, feature, value) AS raw FROM v),
b AS (SELECT *, CASE WHEN pval IS NOT NULL THEN least(min(raw) OVER (ORDER BY pval DESC NULLS FIRST, feature DESC, value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) END AS adj FROM r)
SELECT b.feature, b.value, obs, round(acc, 6) AS acc, round(delta, 6) AS delta, round(q1, 6) AS q1, round(q50, 6) AS q50, round(q99, 6) AS q99, round(pval, 6) AS pval, round(adj, 6) AS adj_pval, adj <= 0.01 AS reject FROM b JOIN o ON o.feature = b.feature AND o.value = b.value"""
)
def stratp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation tests of strata; draws come from hashes that SQL repeats."""
    got = stats.stratp(_strata(spark, sf_dir), ["f1", "f2"], F.col("ok"), min_obs=5)
    return got.select("feature", "value", "obs", *r6("acc", "delta", "q1", "q50", "q99", "pval", "adj_pval"), "reject")


@query(
    """WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1009 + 1) / 1010.0 AS pval FROM part),
r AS (SELECT *, pval * (SELECT count(*) FROM p) / row_number() OVER (ORDER BY pval, id) AS raw FROM p),
a AS (SELECT id, least(min(raw) OVER (ORDER BY pval DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adj FROM r) SELECT id, round(adj, 6) AS adj_pval FROM a"""
)
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 1009 + 1) / 1010.0).alias("pval"))
    return stats.benjamini_hochberg(p, order=["id"]).select("id", *r6("adj_pval"))


@query(
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY a), k AS (SELECT b, sum(n) AS c FROM c GROUP BY b),
x AS (SELECT sum(n * n / CAST(r.r * k.c AS DOUBLE)) AS s, (SELECT sum(n) FROM c) AS t FROM c JOIN r ON c.a = r.a JOIN k ON c.b = k.b) SELECT round(t * (s - 1), 4) AS chi2, CAST(t AS BIGINT) AS n FROM x"""
)
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.co_occurrence(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("chi2", 4).alias("chi2"), F.col("n").cast("long").alias("n"))


@query(
    """WITH l AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.75) AS q3 FROM part)
SELECT p_partkey AS id, CAST(least(floor((p_retailprice - lo) * 5 / (hi - lo)), 4) AS INT) AS w5, (CASE WHEN p_retailprice > q1 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > q2 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > q3 THEN 1 ELSE 0 END) AS f4,
 CASE WHEN p_size >= 30 THEN 2 WHEN p_size >= 10 THEN 1 WHEN p_size >= 5 THEN 0 END AS c3 FROM part, l"""
)
def feature_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    p = stats.equal_width(p, "p_retailprice", 5, "w5")
    p = stats.quantile_bins(p, "p_retailprice", 4, "f4")
    return stats.custom_bins(p, "p_size", [5, 10, 30], "c3").select("id", "w5", "f4", "c3")


@query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, max(o_totalprice) AS max FROM orders")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.describe(table(spark, sf_dir, "orders"), "o_totalprice")
    return d.select("count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.round("q50", 4).alias("q50"), "max")


# -- annotations, collapse, flattening, streams -----------------------------------


@query(f"WITH {CALLS}, n AS (SELECT id, chrom, row_number() OVER (ORDER BY chrom, s, id) - 1 AS k FROM iv) SELECT id, regexp_replace(chrom, '^chr', '') || '0x' || lower(hex(k)) AS new_id FROM n")
def addid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.add_id(synth.calls(spark, sf_dir)).select("id", "new_id")


@query(
    f"""WITH {_RECORDS}, z AS (SELECT id, CASE WHEN alt LIKE '<%' OR alt = '*' THEN e - s WHEN length(ref) = length(alt) THEN CASE WHEN length(ref) = 1 THEN 0 ELSE length(ref) END ELSE abs(length(ref) - length(alt)) END AS l, ref, alt FROM rec WHERE NOT contains(alt, '['))
SELECT id, CASE WHEN l >= 3 THEN l END AS new_len, CASE WHEN l >= 3 THEN CASE WHEN alt = '*' THEN 'UNK' WHEN alt = '<DEL>' THEN 'DEL' WHEN alt = '<DUP:TANDEM>' THEN 'DUP' WHEN length(ref) = length(alt) THEN 'UNK' WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'INS' END END AS new_type FROM z"""
)
def svinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).where(~F.col("alt").contains("["))
    return an.sv_info(r, 3).select("id", "new_len", "new_type")


@query(
    f"""WITH {CALLS}, {DAYS}, j AS (SELECT id, region_id, rs, re, 5 + rs % 7 AS period, rs % 13 AS score, svtype, svlen,
  CASE WHEN svtype = 'DEL' THEN greatest(least(e, re) - greatest(s, rs), 0) / CAST(e - s AS DOUBLE) ELSE greatest(least(e, re) - greatest(s, rs), 0) / CAST(e - s AS DOUBLE) END AS ovl
  FROM iv JOIN days ON iv.chrom = days.chrom AND iv.s < re AND rs < iv.e WHERE svtype IN ('DEL', 'INS')),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ovl DESC, score DESC, re - rs DESC, rs) AS n FROM j)
SELECT id, rs AS r_start, period, round(ovl, 6) AS ovl FROM k WHERE n = 1"""
)
def trf_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best repeat annotation for each deletion or insertion."""
    d = synth.days(spark)
    reps = d.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("region_id").alias("motif"), (5 + F.col("start") % 7).alias("period"), F.lit(2.0).alias("copies"), (F.col("start") % 13).alias("score"))
    return an.repeat_annotation(synth.calls(spark, sf_dir), reps).select("id", "r_start", "period", *r6("ovl"))


_NESTED = f"{DAYS}, reps AS (SELECT chrom, rs, rs + (re - rs) // k AS re, k FROM days, (VALUES (1), (2), (8), (96)) t(k) UNION ALL SELECT chrom, rs + (re - rs) // 4, re, 3 FROM days)"


def _nested(spark: SparkSession) -> DataFrame:
    """Days as repeats, with their first half, eighth and quarter of an hour or so, and their last three quarters."""
    d = synth.days(spark)
    size = F.col("end") - F.col("start")
    parts = d.select("chrom", F.col("start").alias("r_start"), "end", size.alias("size"), F.explode(F.array(*map(F.lit, (1, 2, 8, 96)))).alias("k"))
    parts = parts.select("chrom", "r_start", (F.col("r_start") + F.floor(F.col("size") / F.col("k"))).alias("r_end"), "k")
    return parts.unionByName(d.select("chrom", (F.col("start") + F.floor(size / 4)).alias("r_start"), F.col("end").alias("r_end"), F.lit(3).alias("k")))


@query(
    f"""WITH {CALLS}, {_NESTED}, j AS (SELECT id, rs, re, k FROM iv JOIN reps ON iv.chrom = reps.chrom AND s >= rs AND e < re),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY re - rs DESC, rs, k) - 1 AS level, count(*) OVER (PARTITION BY id) AS all_ FROM j)
SELECT id, level, all_ - 1 - level AS "left", rs AS r_start, re AS r_end, k FROM n"""
)
def trf_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested repeats around each call, outermost first."""
    return an.repeat_stack(synth.calls(spark, sf_dir), _nested(spark))


@query(
    f"""WITH {CALLS}, u AS (SELECT DISTINCT chrom, s, e FROM iv), p AS (SELECT a.chrom, a.s, a.e, b.s AS os, b.e AS oe FROM u a JOIN u b ON a.chrom = b.chrom AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e)),
t AS (SELECT *, row_number() OVER (PARTITION BY chrom, s, e ORDER BY oe - os, os DESC) AS n, count(*) OVER (PARTITION BY chrom, s, e) AS level FROM p)
SELECT u.chrom, u.s AS r_start, u.e AS r_end, coalesce(level, 0) AS level, os AS up_start, oe AS up_end FROM u LEFT JOIN t ON t.chrom = u.chrom AND t.s = u.s AND t.e = u.e AND n = 1"""
)
def interval_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls' spans with the number of spans around each and the innermost of them."""
    c = synth.calls(spark, sf_dir)
    return an.nested(c.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")))


def _collapsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.calls(spark, sf_dir)
    return c.withColumns({"ref": F.lit("N"), "alt": F.concat(F.lit("<"), "svtype", F.lit(">")), "qual": (F.col("id") % 50).cast("double"), "gts": F.array("alleles")}).drop("side", "alleles")


COLLAPSE = Params(pctseq=0, pctsize=0.9, refdist=2000, chunksize=2000, sizemin=50, sizefilt=50, sizemax=600, short_circuit=True, skip_gt=True)


def _collapse_sql(order: str) -> str:
    return f"""WITH {CALLS}, f AS (SELECT *, id % 50 AS qual, row_number() OVER (ORDER BY {order}) AS rk FROM iv WHERE svlen BETWEEN 50 AND 600),
e AS (SELECT a.chrom, a.id AS i, b.id AS j, a.rk AS ri, b.rk AS rj FROM f a JOIN f b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.rk < b.rk AND greatest(a.s - 2000, b.s) < least(a.e + 2000, b.e)
  AND least(a.svlen, b.svlen) / CAST(greatest(a.svlen, b.svlen) AS DOUBLE) >= 0.9),
g AS (SELECT chrom, list_reduce(list({{'i': i, 'j': j}} ORDER BY ri, rj), lambda a, x: CASE WHEN list_contains(a.gone, x.i) OR list_contains(a.gone, x.j) THEN a
  ELSE {{'gone': list_append(a.gone, x.j), 'o': list_append(a.o, x)}} END, {{'gone': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(i BIGINT, j BIGINT)[])}}).o AS o FROM e GROUP BY chrom),
u AS (SELECT unnest(o) AS x FROM g) SELECT u.x.j AS id, u.x.i AS keeper FROM u"""


@query(_collapse_sql("s, svlen DESC, id"))
def collapse_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE)[1].select("id", "keeper")


@query(_collapse_sql("qual DESC, s, svlen DESC, id"))
def collapse_maxqual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE, keep="maxqual")[1].select("id", "keeper")


@query(
    _collapse_sql("s, svlen DESC, id").split("\ng AS (")[0].rstrip(",").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, y AS (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e), r(a, b) AS (SELECT a, b FROM y UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a),
m AS (SELECT a, min(rk) AS rk FROM r JOIN f ON f.id = r.b GROUP BY a) SELECT f.id AS id, k.id AS keeper FROM m JOIN f ON f.id = m.a JOIN f k ON k.rk = m.rk WHERE m.rk < f.rk"""
)
def collapse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained collapsing: all that hangs together goes to its first call."""
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE, chain=True)[1].select("id", "keeper")


@query(
    f"""WITH {CALLS}, f AS (SELECT *, s - CASE WHEN svtype = 'INS' THEN svlen // 2 ELSE 0 END AS lo, e + CASE WHEN svtype = 'INS' THEN svlen // 2 ELSE 0 END AS hi,
  coalesce(a1 = 1, false) OR coalesce(a2 = 1, false) AS alt, row_number() OVER (ORDER BY s, svlen DESC, id) AS rk FROM iv WHERE svlen BETWEEN 50 AND 600),
e AS (SELECT a.chrom, a.id AS i, b.id AS j, a.rk AS ri, a.alt AS mi, b.alt AS mj, abs(a.s - b.s) AS sd, abs(a.e - b.e) AS ed, (least(a.svlen, b.svlen) / CAST(greatest(a.svlen, b.svlen) AS DOUBLE)
  + greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / CAST(greatest(a.hi - a.lo, b.hi - b.lo) AS DOUBLE)) / 3 * 100 AS score
  FROM f a JOIN f b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.rk < b.rk AND greatest(a.s - 2000, b.s) < least(a.e + 2000, b.e) AND least(a.svlen, b.svlen) / CAST(greatest(a.svlen, b.svlen) AS DOUBLE) >= 0.9),
g AS (SELECT chrom, list_reduce(list({{'i': i, 'j': j, 'mi': mi, 'mj': mj}} ORDER BY ri, score DESC, sd, ed, j), lambda a, x: CASE WHEN list_contains(a.gone, x.i) OR list_contains(a.gone, x.j) THEN a
  WHEN x.mj AND CASE WHEN a.now = x.i THEN a.mask ELSE x.mi END THEN {{'gone': a.gone, 'now': x.i, 'mask': true, 'o': a.o}}
  ELSE {{'gone': list_append(a.gone, x.j), 'now': x.i, 'mask': x.mj OR CASE WHEN a.now = x.i THEN a.mask ELSE x.mi END, 'o': list_append(a.o, {{'i': x.i, 'j': x.j}})}} END,
  {{'gone': CAST([] AS BIGINT[]), 'now': CAST(-1 AS BIGINT), 'mask': false, 'o': CAST([] AS STRUCT(i BIGINT, j BIGINT)[])}}).o AS o FROM e GROUP BY chrom),
u AS (SELECT unnest(o) AS x FROM g) SELECT u.x.j AS id, u.x.i AS keeper FROM u"""
)
def collapse_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsing under the genotype rule: no two calls of a cluster have the allele in one sample."""
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE, gt="all")[1].select("id", "keeper")


@query("WITH k AS (" + _collapse_sql("s, svlen DESC, id") + "), n AS (SELECT keeper, count(*) AS n FROM k GROUP BY 1) SELECT event_id AS id, coalesce(n, 0) AS num_collapsed FROM events LEFT JOIN n ON keeper = event_id WHERE event_id NOT IN (SELECT id FROM k)")
def collapse_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls that stay, those that sizes pass through too."""
    kept = co.collapse(_collapsing(spark, sf_dir), COLLAPSE)[0]
    return kept.select("id", F.coalesce("num_collapsed", F.lit(0)).alias("num_collapsed"))


@query(_collapse_sql("CASE WHEN a1 = 0 THEN 1 ELSE 0 END + CASE WHEN a2 = 0 THEN 1 ELSE 0 END, CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END, s, svlen DESC, id"))
def collapse_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE, keep="common")[1].select("id", "keeper")


@query(
    "WITH k AS (" + _collapse_sql("s, svlen DESC, id") + """), m AS (SELECT id, id AS keeper FROM (SELECT DISTINCT keeper AS id FROM k) UNION ALL SELECT id, keeper FROM k),
x AS (SELECT m.keeper, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS s, 50 + CAST(floor(value) AS BIGINT) AS n FROM m JOIN events ON event_id = m.id)
SELECT keeper AS id, CAST(floor(quantile_cont(s, 0.5)) AS BIGINT) AS collapse_start, CAST(floor(quantile_cont(s + n, 0.5)) AS BIGINT) AS collapse_end, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS collapse_size FROM x GROUP BY keeper"""
)
def collapse_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over each call that replaced others, and what it replaced."""
    kept, removed = co.collapse(_collapsing(spark, sf_dir), COLLAPSE)
    return co.median_info(kept.where("num_collapsed > 0"), removed).select("id", "collapse_start", "collapse_end", "collapse_size")


def _islands(source: str, name: str, by: str, lo: str, hi: str, new: str) -> str:
    """SQL: ``source`` with the number ``name`` of each row's run within ``by``; ``new`` tests the furthest end before, far."""
    return (
        f"{name}_w AS (SELECT *, max({hi}) OVER (PARTITION BY {by} ORDER BY {lo}, id, {hi} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {name}_far FROM {source}),\n"
        f"{name}_t AS (SELECT *, CAST(sum(CASE WHEN {name}_far IS NULL OR {name}_far {new} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY {lo}, id, {hi} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {name} FROM {name}_w)"
    )


_FAST = f"""WITH {CALLS}, f0 AS (SELECT *, CASE WHEN svtype = 'DEL' THEN 'd' ELSE 'x' END AS kind, floor(svlen * CAST(0.9 AS DOUBLE)) AS low, s - 2000 AS lo,
  CASE WHEN e - s >= 300 THEN s ELSE e END + 2000 AS hi, row_number() OVER (ORDER BY s, svlen DESC, id) AS rk FROM iv WHERE svlen BETWEEN 50 AND 600),
{_islands("f0", "no", "chrom", "s", "e", "+ 2000 < s")},
{_islands("no_t", "run", "chrom, no, kind", "low", "svlen", "< low")},
z AS (SELECT *, count(*) OVER (PARTITION BY chrom, no, kind, run) AS held FROM run_t),
{_islands("z", "sub", "chrom, no, kind, run", "lo", "hi", "<= lo")},
f AS (SELECT *, chrom || ':' || no || '.' || kind || '.' || run || CASE WHEN held >= 5 THEN '/' || sub ELSE '' END AS block FROM sub_t)"""


@query(
    _FAST
    + """,
e AS (SELECT a.block, a.id AS i, b.id AS j, a.rk AS ri, b.rk AS rj FROM f a JOIN f b ON a.block = b.block AND a.svtype = b.svtype AND a.rk < b.rk AND greatest(a.s - 2000, b.s) < least(a.e + 2000, b.e)
  AND least(a.svlen, b.svlen) / CAST(greatest(a.svlen, b.svlen) AS DOUBLE) >= 0.9),
g AS (SELECT block, list_reduce(list({'i': i, 'j': j} ORDER BY ri, rj), lambda a, x: CASE WHEN list_contains(a.gone, x.i) OR list_contains(a.gone, x.j) THEN a
  ELSE {'gone': list_append(a.gone, x.j), 'o': list_append(a.o, x)} END, {'gone': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(i BIGINT, j BIGINT)[])}).o AS o FROM e GROUP BY block),
u AS (SELECT unnest(o) AS x FROM g) SELECT u.x.j AS id, u.x.i AS keeper FROM u"""
)
def collapse_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsing with large blocks cut by place first, calls of 300 and more by their start alone."""
    return co.collapse(_collapsing(spark, sf_dir), COLLAPSE, fast_cluster=True, least=5, giant=300)[1].select("id", "keeper")


@query(
    _CHUNKS
    + f""", d0 AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS held, CASE WHEN svtype = 'DEL' THEN -svlen ELSE svlen END - svlen * (1 - CAST(0.7 AS DOUBLE)) AS lo,
  CASE WHEN svtype = 'DEL' THEN -svlen ELSE svlen END + svlen * (1 - CAST(0.7 AS DOUBLE)) AS hi FROM c),
{_islands("d0", "run", "chunk_id", "lo", "hi", "<= lo")},
y AS (SELECT * REPLACE (CASE WHEN held >= 8 THEN run ELSE 0 END AS run) FROM run_t), z AS (SELECT *, count(*) OVER (PARTITION BY chunk_id, run) AS part, s - 500 AS p, e + 500 AS q FROM y),
{_islands("z", "sub", "chunk_id, run", "p", "q", "<= p")},
parts AS (SELECT chunk_id, chrom, run, CASE WHEN part >= 8 THEN sub ELSE 0 END AS sub, min(s) AS s, max(e) AS e, count(*) AS n FROM sub_t GROUP BY 1, 2, 3, 4),
sizes AS (SELECT chunk_id, run, sum(n) AS n FROM parts GROUP BY 1, 2), a AS (SELECT chunk_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS size_counts FROM sizes GROUP BY 1)
SELECT p.chunk_id, p.chrom, min(s) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS n, min(size_counts) AS size_counts, string_agg(CAST(n AS VARCHAR), ',' ORDER BY run, sub) AS dist_counts FROM parts p JOIN a ON a.chunk_id = p.chunk_id GROUP BY 1, 2"""
)
def sub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, and how many calls are in each part by size and by place."""
    return an.chunk_subcounts(_bench(spark, sf_dir).chunked, BENCH, 8)


@query(
    f"""WITH {CALLS}, g AS (SELECT side, id, chrom, s, s + 1 AS e, s + svlen * 10 AS p2, CASE WHEN id % 3 = 0 THEN 'right' ELSE 'left' END AS d FROM iv WHERE chrom IN (SELECT chrom FROM iv WHERE side = 'base')),
w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, side, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM g),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far + 1000 < s THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, side, id, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w),
p AS (SELECT b.id AS bid, c.id AS cid, b.s - c.s AS st_dist, b.p2 - c.p2 AS ed_dist, b.d = c.d AND abs(b.s - c.s) < 200 AND abs(b.p2 - c.p2) < 200 AS state
  FROM k b JOIN k c ON b.chrom = c.chrom AND b.no = c.no AND b.side = 'base' AND c.side = 'comp')
SELECT bid, cid, state, CASE WHEN state THEN round(greatest(0, (1 - ((abs(st_dist) + abs(ed_dist)) / 2.0) / 200) * 100), 6) END AS score, st_dist, ed_dist FROM p"""
)
def bnd_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends of both sides compared by both places and by their turn."""
    c = synth.calls(spark, sf_dir)
    mate = F.col("start") + F.col("svlen") * 10
    right = F.col("id") % 3 == 0
    alt = F.when(right, F.concat(F.lit("N]"), "chrom", F.lit(":"), mate.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("N["), "chrom", F.lit(":"), mate.cast("string"), F.lit("[")))
    c = c.withColumns({"ref": F.lit("N"), "alt": alt, "end": F.col("start") + 1, "svtype": F.lit("BND"), "svlen": F.lit(0).cast("long"), "ci": F.lit(None).cast("array<int>")})
    place, turn = v.bnd_mate(F.col("alt")), v.bnd_direction(F.col("alt"))
    c = c.withColumns({"chrom2": place["chrom2"], "pos2": place["pos2"], "direction": turn["direction"], "strand": turn["strand"]})
    b = bn.bench(c.where("side = 'base'").drop("side"), c.where("side = 'comp'").drop("side"), Params(pctseq=0))
    return b.matches.select("bid", "cid", "state", *r6("score"), "st_dist", "ed_dist")


@query(
    f"""WITH {CALLS}, x AS (SELECT side, id, chrom, s, e, svlen, CASE WHEN id // 2 % 4 = 0 THEN 'BND' ELSE svtype END AS t, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS turn FROM iv
  WHERE id // 2 % 4 = 0 OR (svlen <= 600 AND svlen >= CASE WHEN side = 'base' THEN 60 ELSE 50 END)),
ends AS (SELECT side, id, chrom, s + 1 AS p, s + svlen AS p2, turn, true AS own FROM x WHERE t = 'BND'
  UNION ALL SELECT side, id, chrom, s + 1, e + 1, 0, false FROM x WHERE t = 'DEL' UNION ALL SELECT side, id, chrom, e + 1, s + 1, 1, false FROM x WHERE t = 'DEL'
  UNION ALL SELECT side, id, chrom, s + 2, e, 1, false FROM x WHERE t = 'DUP' UNION ALL SELECT side, id, chrom, e, s + 2, 0, false FROM x WHERE t = 'DUP'),
m AS (SELECT b.id AS bid, c.id AS cid, max(greatest(0, (1 - ((abs(b.p - c.p) + abs(b.p2 - c.p2)) / 2.0) / 200) * 100)) AS score FROM ends b JOIN ends c
  ON b.chrom = c.chrom AND b.side = 'base' AND c.side = 'comp' AND b.turn = c.turn AND (b.own OR c.own) AND abs(b.p - c.p) < 200 AND abs(b.p2 - c.p2) < 200 GROUP BY 1, 2),
k AS (SELECT *, s - CASE WHEN t = 'INS' THEN svlen // 2 ELSE 0 END AS lo, e + CASE WHEN t = 'INS' THEN svlen // 2 ELSE 0 END AS hi FROM x WHERE t <> 'BND'),
n AS (SELECT b.id AS bid, c.id AS cid, least(b.svlen, c.svlen) / CAST(greatest(b.svlen, c.svlen) AS DOUBLE) AS sizesim,
  greatest(least(b.hi, c.hi) - greatest(b.lo, c.lo), 0) / CAST(greatest(b.hi - b.lo, c.hi - c.lo) AS DOUBLE) AS ovl FROM k b JOIN k c
  ON b.chrom = c.chrom AND b.side = 'base' AND c.side = 'comp' AND b.t = c.t AND greatest(b.s - 500, c.s) < least(b.e + 500, c.e))
SELECT bid, cid, round(score, 6) AS score FROM m UNION ALL SELECT bid, cid, round((sizesim + ovl) / 3 * 100, 6) FROM n WHERE sizesim >= 0.7"""
)
def bench_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of tables that hold calls and breakends: each kind by its own range join, and calls taken apart with breakends."""
    c = synth.calls(spark, sf_dir)
    bnd = F.floor(F.col("id") / 2) % 4 == 0
    mate = F.concat("chrom", F.lit(":"), (F.col("start") + F.col("svlen")).cast("string"))
    alt = F.when(F.col("id") % 3 == 0, F.concat(F.lit("]"), mate, F.lit("]N"))).otherwise(F.concat(F.lit("N["), mate, F.lit("[")))
    c = c.withColumns({"ref": F.lit("N"), "alt": F.when(bnd, alt).otherwise(F.concat(F.lit("<"), "svtype", F.lit(">"))), "ci": F.lit(None).cast("array<int>")})
    c = c.withColumns({"end": F.when(bnd, F.col("start") + 1).otherwise(F.col("end")), "svtype": F.when(bnd, "BND").otherwise(F.col("svtype")), "svlen": F.when(bnd, 0).otherwise(F.col("svlen"))})
    place, turn = v.bnd_mate(F.col("alt")), v.bnd_direction(F.col("alt"))
    c = c.withColumns({n: F.when(bnd, x) for n, x in (("chrom2", place["chrom2"]), ("pos2", place["pos2"]), ("direction", turn["direction"]), ("strand", turn["strand"]))})
    b = bn.bench(c.where("side = 'base'").drop("side"), c.where("side = 'comp'").drop("side"), BENCH.but(short_circuit=True))
    return b.matches.where("state").select("bid", "cid", *r6("score"))


@query(
    f"""WITH {SEQUENCES}, k AS (SELECT id, seq, id % 5 AS s, id % 5 + greatest(length(seq) // 2, 1) AS e, CASE id % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INV' WHEN 2 THEN 'DUP' ELSE 'CNV' END AS t FROM sq),
x AS (SELECT *, substr(seq, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS span FROM k), y AS (SELECT *, t <> 'CNV' AND e - s <= 5000 AND span <> '' AS ok FROM x)
SELECT id, CASE WHEN ok THEN CASE WHEN t = 'DUP' THEN substr(span, 1, 1) ELSE span END END AS res_ref,
  CASE WHEN ok THEN CASE t WHEN 'DEL' THEN substr(span, 1, 1) WHEN 'INV' THEN reverse(translate(span, 'ATCG', 'TAGC')) ELSE span END END AS res_alt, CASE WHEN ok AND t = 'DUP' THEN s + 1 ELSE e END AS "end" FROM y"""
)
def resolve_symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbolic alleles over half of each document's letters, looked up in the documents as contigs."""
    s = synth.sequences(spark, sf_dir)
    i, n, tile = F.col("id"), F.length("seq"), 1000
    at = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / tile).cast("int")))
    tiles = s.select(i.cast("string").alias("chrom"), "seq", at.alias("tile")).select("chrom", "tile", (F.col("tile").cast("long") * tile).alias("start"), F.substring(F.col("seq"), F.col("tile") * tile + 1, F.lit(tile)).alias("seq"))
    kind = F.when(i % 4 == 0, "DEL").when(i % 4 == 1, "INV").when(i % 4 == 2, "DUP").otherwise("CNV")
    end = i % 5 + F.greatest(F.floor(n / 2), F.lit(1))
    calls = s.select("id", i.cast("string").alias("chrom"), (i % 5).alias("start"), end.alias("end"), F.lit("N").alias("ref"), F.concat(F.lit("<"), kind, F.lit(">")).alias("alt"), kind.alias("svtype"), (end - i % 5).alias("svlen"))
    got = matching.resolve_symbolic(calls, tiles, Params(dup_to_ins=True, max_resolve=5000), tile=tile)
    return got.select("id", "res_ref", "res_alt", "end")


@query(
    """WITH c AS (SELECT p_partkey AS id, p_size % 7 AS a, p_size + 3 AS m, p_size % 4 AS i, p_size % 5 AS d, p_partkey % 6 AS z FROM part)
SELECT id, CAST(m + m AS INT) AS matched, CAST(i + d AS INT) AS missed, CAST(a AS INT) AS before, CAST(z AS INT) AS behind, CAST(1000 + m + d + m AS BIGINT) AS stop FROM c"""
)
def fn_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of alignment strings made of parts' sizes."""
    from ..functions import cigar as cg

    p = table(spark, sf_dir, "part")
    size, k = F.col("p_size"), F.col("p_partkey")
    bits = [(size % 7, "S"), (size + 3, "M"), (size % 4, "I"), (size % 5, "D"), (size + 3, "="), (k % 6, "H")]
    c = F.concat(*[x for n, op_ in bits for x in (n.cast("string"), F.lit(op_))])
    ends = cg.clipped(c)
    return p.select(k.alias("id"), cg.matched(c).alias("matched"), cg.missed(c).alias("missed"), ends["before"].alias("before"), ends["behind"].alias("behind"), cg.end_on_reference(F.lit(1000).cast("long"), c).alias("stop"))


@query("SELECT count(DISTINCT o_orderpriority) AS o_orderpriority, count(DISTINCT o_orderstatus) AS o_orderstatus, count(DISTINCT o_custkey) AS o_custkey FROM orders")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_counts(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query(
    """SELECT l_orderkey AS pos, 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom, CASE WHEN l_returnflag = 'N' THEN 'DEL' ELSE 'INS' END AS svtype, CAST(l_quantity AS BIGINT) AS svlen,
 l_linestatus = 'O' AS is_pass, CAST(l_linenumber AS INT) AS dp, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6"""
)
def vcf2df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines made of line items, parsed and flattened into typed columns."""
    from ..sources.vcf import Header, flat_table, parse_lines

    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "DEL").otherwise("INS")
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN="), F.when(kind == "DEL", "-").otherwise(""), F.col("l_quantity").cast("long").cast("string"), F.lit(";PRECISE"))
    cols = [F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")), F.col("l_orderkey").cast("string"), F.lit("."), F.lit("A"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("."), F.when(F.col("l_linestatus") == "O", "PASS").otherwise("LOWQ"), info, F.lit("GT:DP"), F.concat(F.lit("0/1:"), F.col("l_linenumber").cast("string"))]
    head = Header.parse(["##INFO=<ID=SVTYPE,Number=1,Type=String>", "##INFO=<ID=SVLEN,Number=1,Type=Integer>", "##INFO=<ID=PRECISE,Number=0,Type=Flag>", "##FORMAT=<ID=GT,Number=1,Type=String>", "##FORMAT=<ID=DP,Number=1,Type=Integer>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"])])
    flat = flat_table(parse_lines(li.select(F.concat_ws("\t", *cols).alias("value")), head.samples), head)
    return flat.groupBy((F.col("start") + 1).alias("pos"), "chrom", "svtype", "svlen", "is_pass", F.col("S1_DP").alias("dp")).agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM events),
k AS (SELECT *, sum(CASE WHEN far IS NULL OR far + INTERVAL 200 SECOND < ts THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM w)
SELECT event_type, count(*) AS n, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', min(ts)) AS s FROM k GROUP BY event_type, no"""
)
def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streamed_chunks(table(spark, sf_dir, "events"), "ts", "event_type", "200 seconds")
    return s.select("event_type", "n", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(start AS TIMESTAMP_NTZ))").alias("s"))


@query(f"WITH {GENOTYPES} SELECT id, sample, {_GT} AS gt, coalesce(CAST(a1 = 1 AS INT), 0) + coalesce(CAST(a2 = 1 AS INT), 0) AS n_alt FROM gr")
def fn_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.genotype_rows(spark, sf_dir)
    return g.select("id", "sample", gt.genotype(F.col("alleles")).alias("gt"), gt.alt_count(F.col("alleles")).alias("n_alt"))
