"""Blocking and pairwise comparison of two variant tables.

A variant row has: side ('base' or 'comp'), id, chrom, start, end, svtype,
svlen, and where comparisons need them ref, alt, alleles, pos, and for
breakends chrom2, pos2, direction, strand and ci.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import sequences as sq
from ..functions.genotypes import alt_count, genotype, is_present
from ..functions.variants import decomposed_ends, is_filtered, is_monref_or_star, is_single_bnd, is_symbolic, resolved
from ..params import Params
from ..sources.regions import fetch
from .intervals import range_join, two_place_join, with_islands


def filter_calls(df: DataFrame, p: Params) -> DataFrame:
    """Rows that a comparison uses: neither reference-only, multi-allelic, filtered out, absent nor single-ended."""
    cols = set(df.columns)
    if "alt" in cols:
        df = df.where(~is_monref_or_star(F.col("alt")) & ~is_single_bnd(F.col("alt")))
    if "alts" in cols and p.check_multi:
        df = df.withColumn("alts", F.when(F.size("alts") > 1, F.raise_error(F.lit("multi-allelic rows must be split first"))).otherwise(F.col("alts")))
    if p.passonly and "filters" in cols:
        df = df.where(~is_filtered(F.col("filters")))
    if "alleles" in cols and (p.no_ref or p.pick == "ac"):
        asked = F.lit(p.no_ref == "a" or p.pick == "ac") | ((F.col("side") == "base") & F.lit(p.no_ref == "b")) | ((F.col("side") == "comp") & F.lit(p.no_ref == "c"))
        df = df.where(~asked | is_present(F.col("alleles")))
    return df


def filter_sizes(df: DataFrame, p: Params) -> DataFrame:
    size = F.col("svlen")
    low = F.when(F.col("side") == "base", p.sizemin).otherwise(p.sizefilt)
    ok = size >= low
    if p.sizemax != -1:
        ok = ok & (size <= p.sizemax)
    if p.bnddist == -1:
        return df.where((F.col("svtype") != "BND") & ok)
    return df.where((F.col("svtype") == "BND") | ok)


def resolve_symbolic(calls: DataFrame, tiles: DataFrame, p: Params, by: list[str] = ("id",), tile: int = 100_000) -> DataFrame:
    """Adds res_ref and res_alt, the sequences of symbolic deletions, inversions and (with ``dup_to_ins``) duplications.

    tiles: the reference as ``regions.read_fasta`` reads it.  Calls over
    ``max_resolve``, beyond their contig, or of another type get null.  A
    resolved duplication ends one base behind its start, as an insertion does.
    ``by`` identifies a call.
    """
    kinds = ("DEL", "INV", "DUP") if p.dup_to_ins else ("DEL", "INV")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in by])
    able = calls.where(is_symbolic(F.col("alt")) & F.col("svtype").isin(*kinds) & (F.col("svlen") <= p.max_resolve) & (F.col("start") < F.col("end")))
    spans = able.select(key.alias("__key"), "chrom", "start", "end")
    found = fetch(spans, tiles, tile, "__key").withColumnRenamed("seq", "__span")
    both = calls.withColumn("__key", key).join(found.where("__span != ''"), "__key", "left")
    got = both.withColumn("__got", resolved(F.col("svtype"), F.col("__span"), F.col("svlen"), F.col("alt"), p.dup_to_ins, p.max_resolve))
    end = F.when(F.col("__got").isNotNull() & (F.col("svtype") == "DUP"), F.col("start") + 1).otherwise(F.col("end"))
    return got.withColumns({"res_ref": F.col("__got.ref"), "res_alt": F.col("__got.alt"), "end": end}).drop("__key", "__span", "__got")


def with_chunks(df: DataFrame, p: Params) -> DataFrame:
    """``chunk_id`` as chrom:number: transitive blocks of calls closer than ``chunksize``, counted on each chrom."""
    marked = with_islands(df, ["chrom"], "start", "end", p.chunksize, "__chunk", order=["side", "id"])
    return marked.withColumn("chunk_id", F.concat_ws(":", "chrom", "__chunk")).drop("__chunk")


def oversize_blocks(chunked: DataFrame, p: Params) -> DataFrame:
    """(chunk_id, n) of the blocks over ``max_chunk`` calls, which comparisons that stop early leave out; none where no such limit is set."""
    sizes = chunked.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > p.max_chunk) if p.short_circuit and p.max_chunk is not None else sizes.where(F.lit(False))


def pairs(chunked: DataFrame, p: Params) -> DataFrame:
    """The base-comp pairs of each block: all, or where comparisons stop early those near enough to match."""
    base, comp = chunked.where("side = 'base'"), chunked.where("side = 'comp'")
    if p.short_circuit:
        return near_pairs(base, comp, p)
    # dealt by number: few tasks could hold the calls, but the work is their pairs
    n = int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near_pairs(*(_figured(x, p).repartition(n, "chunk_id") for x in (base, comp)), p)


def _figured(calls: DataFrame, p: Params) -> DataFrame:
    """Calls with what ``compared`` derives from one call alone, so that it isn't worked out again for each of its pairs."""
    lo, hi = iv.inflated(F.col("start"), F.col("end"), F.col("svtype"), F.col("svlen"))
    out = calls.withColumns({"__lo": lo, "__hi": hi})
    if "ci" in calls.columns:
        out = out.withColumn("__reach", _reach(F.col("ci"), p))
    if "alleles" in calls.columns and not p.skip_gt:
        out = out.withColumns({"__gt": genotype(F.col("alleles")), "__gt_count": alt_count(F.col("alleles"))}).drop("alleles")
    return out


def near_pairs(base: DataFrame, comp: DataFrame, p: Params) -> DataFrame:
    """Pairs (chunk_id, b, c) of the calls of each block.

    Where comparisons stop early, pairs whose places are too far apart fail at
    once; then the joins are of ranges within blocks, so a dense block costs
    what lies near each call and not all its pairs: calls by their place,
    breakends by both their places and their turn, and with ``decompose`` calls
    taken apart with breakends in the same way.
    """
    data = [c for c in base.columns if c not in ("side", "chunk_id")]
    b, c = base.select("chunk_id", F.struct(*data).alias("b")), comp.select("chunk_id", F.struct(*data).alias("c"))
    if not p.short_circuit:
        return b.join(c, "chunk_id")
    if not {"pos", "pos2", "direction", "strand", "ci"} <= set(data):
        return _near_calls(b, c, p)

    def split(df: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
        bnd = F.coalesce(F.col(f"{x}.svtype") == "BND", F.lit(False))
        return df.where(~bnd), df.where(bnd)

    (b_calls, b_ends), (c_calls, c_ends) = split(b, "b"), split(c, "c")
    out = _near_calls(b_calls, c_calls, p).unionByName(_near_ends(_placed(b_ends, "b", p), _placed(c_ends, "c", p), p))
    if not p.decompose:
        return out
    mixed = _near_ends(_parts_placed(b_calls, "b", p), _placed(c_ends, "c", p), p).unionByName(_near_ends(_placed(b_ends, "b", p), _parts_placed(c_calls, "c", p), p))
    # several parts of a call may lie near one breakend
    once = mixed.groupBy("chunk_id", F.col("b.id").alias("__b"), F.col("c.id").alias("__c")).agg(F.first("b").alias("b"), F.first("c").alias("c"))
    return out.unionByName(once.select("chunk_id", "b", "c"))


def needed(calls: DataFrame, p: Params) -> DataFrame:
    """The columns of blocks that comparing their calls reads, as pairs carry them through joins."""
    cols = set(calls.columns)
    names = {"side", "chunk_id", "id", "start", "end", "svtype", "svlen"}
    if not p.skip_gt:
        names |= {"alleles"}
    if p.pctseq > 0:
        names |= {"ref", "alt", "res_ref", "res_alt"}
    ends = {"pos", "pos2", "direction", "strand", "ci"}
    if ends <= cols:
        names |= ends | {"chrom", "chrom2"}
    return calls.select(*[c for c in calls.columns if c in names])


def of_calls(ids: DataFrame, base: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (chunk_id, b, c) of (chunk_id, bid, cid)."""
    data = [c for c in base.columns if c not in ("side", "chunk_id")]
    b = base.select("chunk_id", F.col("id").alias("bid"), F.struct(*data).alias("b"))
    c = comp.select("chunk_id", F.col("id").alias("cid"), F.struct(*data).alias("c"))
    return ids.select("chunk_id", "bid", "cid").join(b, ["chunk_id", "bid"]).join(c, ["chunk_id", "cid"]).select("chunk_id", "b", "c")


def matching_pairs(base: DataFrame, comp: DataFrame, p: Params) -> DataFrame:
    """The rows of the match table whose state is true, from pairs that lie near enough."""
    near = p.but(short_circuit=True)
    return compared(near_pairs(base, comp, near), near).where("state")


def bounded(columns: list[str], p: Params) -> bool:
    """Whether a call's best failed pair follows from places and sizes alone, so that ``contenders`` holds it."""
    cols = set(columns)
    return not (p.pctseq > 0 and {"ref", "alt"} <= cols) and not {"pos2", "direction"} <= cols


def contenders(asked: DataFrame, offered: DataFrame, side: str) -> DataFrame:
    """(chunk_id, bid, cid): few pairs of each asked call of ``side`` with calls offered in its block, its best failed one among them.

    A failed pair scores by overlap and size.  Of calls that don't overlap the
    best has the next smaller or greater size; of equal sizes the nearest start
    counts, then the nearest end, then the id.  So besides what overlaps, each
    call meets those at the nearest starts of the two nearest sizes, and the
    first id of either size.  Needs ``bounded``.
    """
    mine, other = ("bid", "cid") if side == "base" else ("cid", "bid")
    size = F.greatest("svlen", F.lit(1)).alias("size")
    bounds = iv.inflated(F.col("start"), F.col("end"), F.col("svtype"), F.col("svlen"))
    a = asked.select("chunk_id", F.col("id").cast("long").alias(mine), F.col("start").alias("__at"), size, bounds[0].alias("__as"), bounds[1].alias("__ae"))
    o = offered.select("chunk_id", F.col("id").cast("long").alias(other), "start", "end", size, bounds[0].alias("__os"), bounds[1].alias("__oe"))
    over = range_join(a, o.drop("size"), ["chunk_id"], ("__as", "__ae"), ("__os", "__oe"), width=1024, sparse=True).select("chunk_id", "bid", "cid")

    # the nearest sizes on offer, of each size that is asked for
    has = o.groupBy("chunk_id", "size").agg(F.min(other).alias("__first"))
    sizes = has.select("chunk_id", "size", F.col("size").alias("__has")).unionByName(a.select("chunk_id", "size").distinct().withColumn("__has", F.lit(None).cast("long")))
    by_size = Window.partitionBy("chunk_id").orderBy("size")
    up = F.last("__has", True).over(by_size.rangeBetween(Window.unboundedPreceding, 0))
    down = F.first("__has", True).over(by_size.rangeBetween(0, Window.unboundedFollowing))
    near = sizes.withColumns({"__up": up, "__down": down}).where("__has IS NULL").select("chunk_id", "size", F.explode(F.array_distinct(F.array("__up", "__down"))).alias("__has"))
    sized = a.join(near, ["chunk_id", "size"]).where("__has IS NOT NULL").select("chunk_id", mine, "__at", F.col("__has").alias("size"))
    firsts = sized.join(has, ["chunk_id", "size"]).select("chunk_id", mine, F.col("__first").alias(other))

    # the nearest starts on offer, within each size
    places = o.select("chunk_id", "size", "start").distinct().select("chunk_id", "size", F.col("start").alias("__at"), F.col("start").alias("__has"), F.lit(None).cast("long").alias(mine))
    places = places.unionByName(sized.withColumn("__has", F.lit(None).cast("long")))
    by_place = Window.partitionBy("chunk_id", "size").orderBy("__at")
    left = F.last("__has", True).over(by_place.rangeBetween(Window.unboundedPreceding, 0))
    right = F.first("__has", True).over(by_place.rangeBetween(0, Window.unboundedFollowing))
    spots = places.withColumns({"__up": left, "__down": right}).where(F.col(mine).isNotNull())
    spots = spots.select("chunk_id", "size", mine, F.explode(F.array_distinct(F.array("__up", "__down"))).alias("start")).where("start IS NOT NULL")
    held = o.groupBy("chunk_id", "size", "start", "end").agg(F.min(other).alias(other))
    at = spots.join(held, ["chunk_id", "size", "start"]).select("chunk_id", mine, other)
    return over.unionByName(at).unionByName(firsts).distinct()


def _near_calls(b: DataFrame, c: DataFrame, p: Params) -> DataFrame:
    b = b.withColumns({"__bs": F.col("b.start") - p.refdist, "__be": F.col("b.end") + p.refdist})
    c = c.withColumns({"__cs": F.col("c.start"), "__ce": F.col("c.end")})
    keys = ["chunk_id"]
    if not p.typeignore:
        # other types don't match, so they don't meet
        b, c = b.withColumn("__kind", kind(F.col("b.svtype"), p)), c.withColumn("__kind", kind(F.col("c.svtype"), p))
        keys.append("__kind")
    return range_join(b, c, keys, ("__bs", "__be"), ("__cs", "__ce"), width=max(1024, 4 * p.refdist), sparse=True).select("chunk_id", "b", "c")


def _reach(ci: Column, p: Params) -> Column:
    """How far a breakend reaches to either side: the second bound of its confidence interval widens both."""
    return p.bnddist + F.coalesce(F.abs(F.get(ci, F.lit(1))), F.lit(0))


def _with_places(df: DataFrame, x: str, pos: Column, mate: Column, turn: Column, p: Params) -> DataFrame:
    far = _reach(F.col(f"{x}.ci"), p)
    return df.withColumns(
        {
            "__chrom2": mate["chrom2"], "__direction": turn["direction"], "__strand": turn["strand"],
            f"__{x}s1": pos - far, f"__{x}e1": pos + far, f"__{x}s2": mate["pos2"] - far, f"__{x}e2": mate["pos2"] + far,
        }
    )


def _placed(df: DataFrame, x: str, p: Params) -> DataFrame:
    """Breakends with the spans around both their places."""
    whole = F.col(x)
    return _with_places(df, x, whole["pos"], whole, whole, p)


def _parts_placed(df: DataFrame, x: str, p: Params) -> DataFrame:
    """The breakends that calls are taken apart into, with the spans around both their places."""
    parts = decomposed_ends(F.col(f"{x}.chrom"), F.col(f"{x}.pos"), F.col(f"{x}.end"), F.col(f"{x}.svtype"))
    part = F.col("__part")
    return _with_places(df.withColumn("__part", F.explode(parts)), x, part["pos"], part, part, p).drop("__part")


def _near_ends(b: DataFrame, c: DataFrame, p: Params) -> DataFrame:
    keys = ["chunk_id", "__chrom2", "__direction", "__strand"]
    joined = two_place_join(b, c, keys, [("__bs1", "__be1"), ("__bs2", "__be2")], [("__cs1", "__ce1"), ("__cs2", "__ce2")], width=max(1024, 4 * p.bnddist), sparse=True)
    return joined.select("chunk_id", "b", "c")


def _threshold(flat: float, p: Params, size: Column) -> Column:
    if p.dynthresh is None:
        return F.lit(flat)
    low, high, s_min, s_max = p.dynthresh
    s_min = 2 * low if s_min is None else s_min
    s_max = 2 * high if s_max is None else s_max
    part = F.least(F.greatest((size - s_min) / float(s_max - s_min), F.lit(0.0)), F.lit(1.0))
    return 1 - (low + part * (high - low)) / size


def kind(svtype: Column, p: Params) -> Column:
    """What calls of types that match have in common."""
    return F.when(svtype == "DUP", "INS").otherwise(svtype) if p.dup_to_ins else svtype


def same_type(b: Column, c: Column, p: Params) -> Column:
    return kind(b, p) == kind(c, p)


def _bnd(p: Params, b: dict[str, Column], c: dict[str, Column]) -> Column:
    """Struct of state, score, st_dist and ed_dist of two breakends: dicts of chrom, pos, chrom2, pos2, direction, strand, ci."""
    d = p.bnddist

    def near(at: str) -> Column:
        r, s = (x["reach"] if "reach" in x else _reach(x["ci"], p) for x in (b, c))
        return iv.overlaps(b[at] - r, b[at] + r, c[at] - s, c[at] + s)

    st, ed = b["pos"] - c["pos"], b["pos2"] - c["pos2"]
    ok = (b["chrom"] == c["chrom"]) & near("pos") & (b["chrom2"] == c["chrom2"]) & near("pos2") & (b["direction"] == c["direction"]) & (b["strand"] == c["strand"])
    score = F.greatest(F.lit(0.0), (1 - ((F.abs(st) + F.abs(ed)) / 2) / (d * 2)) * 100) if d > 0 else F.lit(0.0)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("state"), F.when(ok, score).alias("score"), st.alias("st_dist"), F.when(b["chrom2"] == c["chrom2"], ed).alias("ed_dist"))


def _ends(x: str, figured: bool = False) -> dict[str, Column]:
    out = {n: F.col(f"{x}.{n}") for n in ("chrom", "pos", "chrom2", "pos2", "direction", "strand", "ci")}
    return out | {"reach": F.col(f"{x}.__reach")} if figured else out


def _taken_apart(call: str, bnd: str, p: Params, call_first: bool) -> Column:
    """The best match of one of a call's own breakends with a breakend of the other side."""
    parts = decomposed_ends(F.col(f"{call}.chrom"), F.col(f"{call}.pos"), F.col(f"{call}.end"), F.col(f"{call}.svtype"))

    def one(part: Column) -> Column:
        own = {"chrom": F.col(f"{call}.chrom"), **{n: part[n] for n in ("pos", "chrom2", "pos2", "direction", "strand")}, "ci": F.col(f"{call}.ci")}
        return _bnd(p, own, _ends(bnd)) if call_first else _bnd(p, _ends(bnd), own)

    # structs compare by state, then score
    return F.array_max(F.transform(parts, one))


def compared(paired: DataFrame, p: Params) -> DataFrame:
    """The match table: state, score and what it is made of, for every pair of ``pairs``.

    Cheap tests come first, and where comparisons stop early the edit distance
    is only taken of pairs that passed them.
    """
    cols = {f.name for f in paired.schema["b"].dataType.fields}
    b, c = (lambda n: F.col(f"b.{n}")), (lambda n: F.col(f"c.{n}"))
    type_ok = F.lit(True) if p.typeignore else same_type(b("svtype"), c("svtype"), p)
    near = iv.overlaps(b("start") - p.refdist, b("end") + p.refdist, c("start"), c("end"))
    least = F.least(b("svlen"), c("svlen"))
    st, ed = b("start") - c("start"), b("end") - c("end")
    bs, be = (b("__lo"), b("__hi")) if "__lo" in cols else iv.inflated(b("start"), b("end"), b("svtype"), b("svlen"))
    cs, ce = (c("__lo"), c("__hi")) if "__lo" in cols else iv.inflated(c("start"), c("end"), c("svtype"), c("svlen"))
    first = paired.withColumns(
        {
            "type_ok": type_ok,
            "near": near,
            "sizesim": iv.size_similarity(b("svlen"), c("svlen")),
            "sizediff": iv.size_difference(b("svlen"), c("svlen")),
            "ovlpct": iv.reciprocal_overlap(bs, be, cs, ce),
            "least": least,
        }
    )
    cheap = F.col("type_ok") & F.col("near") & (F.col("sizesim") >= _threshold(p.pctsize, p, F.col("least"))) & (F.col("ovlpct") >= p.pctovl)
    first = first.withColumn("cheap", F.coalesce(cheap, F.lit(False)))
    if p.short_circuit:
        first = first.where(F.col("cheap") | (b("svtype") == "BND") | (c("svtype") == "BND")) if "pos2" in cols else first.where("cheap")
    if p.pctseq > 0 and {"ref", "alt"} <= cols:

        def own(x: str, name: str) -> Column:
            return F.coalesce(F.col(f"{x}.res_{name}"), F.col(f"{x}.{name}")) if "res_ref" in cols else F.col(f"{x}.{name}")

        def allele(x: str) -> Column:
            return F.upper(F.when(F.col(f"{x}.svtype") == "DEL", own(x, "ref")).otherwise(own(x, "alt")))

        # where failing pairs aren't shown, distances are only taken as far as they could still pass
        least = p.pctseq if p.short_circuit and p.dynthresh is None else None
        both_inv = (b("svtype") == "INV") & (c("svtype") == "INV")
        direct = sq.similarity(allele("b"), allele("c"), least)
        rolled = direct if p.no_roll else F.when((st == 0) | (ed == 0), direct).otherwise(sq.best_similarity(allele("b"), allele("c"), st, least=least))
        sequence = ~own("b", "alt").rlike(r"^<|[\[\]]") & ~own("c", "alt").rlike(r"^<|[\[\]]")
        seqsim = F.when(
            sequence,
            F.when((own("b", "ref") == own("c", "ref")) & (own("b", "alt") == own("c", "alt")), 1.0).when(both_inv, sq.similarity(own("b", "alt"), own("c", "alt"), least)).otherwise(rolled),
        ).otherwise(0.0)
        seq_ok = ~sequence | (F.col("seqsim") >= _threshold(p.pctseq, p, F.col("least")))
    else:
        seqsim, seq_ok = F.lit(0.0), F.lit(True)
    out = first.withColumn("seqsim", seqsim).withColumns({"state": F.col("cheap") & seq_ok, "st_dist": st, "ed_dist": ed})
    out = out.withColumn("score", (F.col("seqsim") + F.col("sizesim") + F.col("ovlpct")) / 3 * 100)
    if {"pos", "pos2", "direction", "strand", "ci"} <= cols:
        b_bnd, c_bnd = b("svtype") == "BND", c("svtype") == "BND"
        both, either = b_bnd & c_bnd, b_bnd | c_bnd
        got = F.when(both, _bnd(p, _ends("b", "__reach" in cols), _ends("c", "__reach" in cols)))
        if p.decompose:
            got = got.when(c_bnd, _taken_apart("b", "c", p, True)).when(b_bnd, _taken_apart("c", "b", p, False))
        out = out.withColumn("__bnd", got)
        for name in ("state", "score", "st_dist", "ed_dist"):
            out = out.withColumn(name, F.when(either, F.col(f"__bnd.{name}")).otherwise(F.col(name)))
        for name in ("seqsim", "sizesim", "ovlpct", "sizediff"):
            out = out.withColumn(name, F.when(~either, F.col(name)))
    if {"alleles", "__gt"} & cols and not p.skip_gt:
        gt, n = ((lambda x: x("__gt")), (lambda x: x("__gt_count"))) if "__gt" in cols else ((lambda x: genotype(x("alleles"))), (lambda x: alt_count(x("alleles"))))
        out = out.withColumns({"base_gt": gt(b), "comp_gt": gt(c), "base_gt_count": n(b), "comp_gt_count": n(c)}).withColumn("gt_match", F.abs(F.col("base_gt_count") - F.col("comp_gt_count")))
    else:
        zero = F.lit(0)
        out = out.withColumns({"base_gt": F.lit(None).cast("string"), "comp_gt": F.lit(None).cast("string"), "base_gt_count": zero, "comp_gt_count": zero, "gt_match": F.lit(None).cast("int")})
    return out.select(
        "chunk_id",
        F.col("b.id").alias("bid"),
        F.col("c.id").alias("cid"),
        F.coalesce("state", F.lit(False)).alias("state"),
        "score",
        "seqsim",
        "sizesim",
        "ovlpct",
        "sizediff",
        "st_dist",
        "ed_dist",
        "base_gt",
        "comp_gt",
        "base_gt_count",
        "comp_gt_count",
        "gt_match",
    )
