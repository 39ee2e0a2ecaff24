"""Annotations of calls: ids, counts, composition, density, neighbours, overlaps, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotypes as gt
from ..functions import sequences as sq
from ..functions.variants import sv_size, sv_type
from ..params import Params
from ..storage import stored
from . import intervals
from .collapse import SUB_BLOCK, distance_runs, size_runs


def numbered(df: DataFrame, group: str, at: str, order: list[str] = (), name: str = "n", span: int = intervals.ISLAND_SPAN) -> DataFrame:
    """Numbers rows from 0 by group, place and ``order``, without one task that sorts them all.

    Rows are numbered within spans of the place; a table of one row per span
    carries the counts before it.
    """
    spread = df.withColumn("__span", F.floor(F.col(at) / span))
    sizes = spread.groupBy(F.col(group).alias("__g"), F.col("__span").alias("__s")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__past", F.sum("__n").over(Window.orderBy("__g", "__s")) - F.col("__n")).drop("__n")
    inner = F.row_number().over(Window.partitionBy(group, "__span").orderBy(at, *order))
    joined = spread.withColumn("__at", inner).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__span") == F.col("__s")))
    return joined.withColumn(name, F.col("__past") + F.col("__at") - 1).drop("__span", "__g", "__s", "__past", "__at")


def add_id(calls: DataFrame) -> DataFrame:
    """Ids of the chrom without its prefix and the running number in hexadecimal."""
    n = numbered(calls, "chrom", "start", ["id"])
    return n.withColumn("new_id", F.concat(F.regexp_replace("chrom", "^chr", ""), F.lit("0x"), F.lower(F.hex("n")))).drop("n")


def breakpoint_overlap(calls: DataFrame, annos: DataFrame, sizemin: int = 50, spanmax: int = 50_000) -> DataFrame:
    """Rows (id, intersection, anno_id): an annotation over the start, over the end, overlapping, or containing the call."""
    able = calls.where((F.col("svlen") >= sizemin) & ((F.col("end") - F.col("start")) <= spanmax))
    a = annos.select("chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "anno_id")
    wide = able.select("id", "chrom", "start", "end").withColumn("__stop", F.col("end") + 1)
    hit = intervals.range_join(wide, a, ["chrom"], ("start", "__stop"), ("a_start", "a_end"))

    def at(x: str) -> Column:
        return (F.col(x) >= F.col("a_start")) & (F.col(x) < F.col("a_end"))

    spanned = (F.col("start") < F.col("a_end")) & (F.col("end") > F.col("a_start"))
    kinds = F.array(
        F.when(at("start"), "start_bnd"),
        F.when(at("end"), "end_bnd"),
        F.when(spanned & (F.col("a_start") >= F.col("start")) & (F.col("a_end") <= F.col("end")), "overlaps"),
        F.when(spanned & (F.col("a_start") <= F.col("start")) & (F.col("a_end") >= F.col("end")), "contains"),
    )
    return hit.select("id", F.explode(F.array_compact(kinds)).alias("intersection"), "anno_id")


def chunk_census(chunked: DataFrame) -> DataFrame:
    """Each chunk's chrom, span and number of calls."""
    return chunked.groupBy("chunk_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def chunk_subcounts(chunked: DataFrame, p: Params, least: int = SUB_BLOCK) -> DataFrame:
    """The census with what large chunks are cut into: size_counts of calls by size, and dist_counts of these parts cut by place, comma-joined in order of chunk and run."""
    sized = size_runs(chunked.withColumn("chunk", F.col("chunk_id")), p, least)
    placed = distance_runs(stored(sized.withColumn("size_run", F.col("chunk_id")), "size-runs"), p, least=least)
    cells = placed.groupBy("chunk", "size_run", F.col("chunk_id").alias("dist_run")).agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))

    def number(c: str, sep: str) -> Column:
        return F.coalesce(F.element_at(F.split(c, sep), -1).try_cast("long"), F.lit(0))

    cells = stored(cells.withColumns({"a": number("size_run", "[.]"), "b": F.when(F.col("dist_run").contains("/"), number("dist_run", "/")).otherwise(0)}), "cells")

    def line(rows: DataFrame, name: str, *order: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "n"))), lambda x: x["n"].cast("string")), ",").alias(name))

    sizes = line(cells.groupBy("chunk", "a").agg(F.sum("n").alias("n")), "size_counts", "a")
    whole = cells.groupBy("chunk").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return whole.join(sizes, "chunk").join(line(cells, "dist_counts", "a", "b"), "chunk").withColumnRenamed("chunk", "chunk_id")


def density(calls: DataFrame, windows: DataFrame, threshold: float = 3) -> DataFrame:
    """Calls per window (chrom, start, end), and a label: dense beyond mean + threshold * std, sparse below mean - threshold * std."""
    w = windows.select("chrom", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    pts = calls.select("chrom", "start", F.greatest(F.col("end"), F.col("start") + 1).alias("stop"))
    keys = ["chrom", "w_start", "w_end"]
    asked = w.distinct().select(F.col("chrom").alias("contig"), *keys)
    hits = intervals.overlap_counts(pts.withColumnRenamed("chrom", "contig"), asked, ["contig"], ("start", "stop"), keys, ("w_start", "w_end"), "count")
    got = stored(w.join(hits, keys, "left").withColumn("count", F.coalesce("count", F.lit(0))), "windows")
    stats = got.agg(F.avg("count").alias("mean"), F.stddev_samp("count").alias("std"))
    label = F.when(F.col("count") > F.col("mean") + threshold * F.col("std"), "dense").when(F.col("count") < F.col("mean") - threshold * F.col("std"), "sparse")
    return got.join(F.broadcast(stats)).select("chrom", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "count", label.alias("anno"))


def depth_counts(calls: DataFrame, bins: list[int] = (0, 5, 10, 15), depth: str = "depths", alt_depth: str | None = "alt_depths") -> DataFrame:
    """Samples per depth bin, of the depth and of the alternative allele's depth."""
    out = calls.withColumn("dpcnt", gt.binned(F.col(depth), list(bins)))
    return out.withColumn("adcnt", gt.binned(F.col(alt_depth), list(bins))) if alt_depth else out


def gc_content(calls: DataFrame, seq: str = "seq") -> DataFrame:
    return calls.withColumn("gcpct", sq.gc_percent(F.col(seq)))


def low_complexity(calls: DataFrame, seq: str = "seq") -> DataFrame:
    return calls.withColumn("lcr", sq.entropy(F.col(seq)))


def genotype_counts(calls: DataFrame) -> DataFrame:
    return calls.withColumn("gtcnt", gt.count_genotypes(F.col("gts")))


def allele_frequencies(calls: DataFrame) -> DataFrame:
    """The allele statistics of a call's genotypes, with the exact tests of Hardy-Weinberg equilibrium."""
    out = calls.withColumn("af", gt.frequencies(F.col("gts")))
    test = gt.hardy_weinberg(F.get("af.AC", F.lit(0)), F.get("af.AC", F.lit(1)), F.col("af.N_HET"))
    return out.withColumn("hw", test)


def sample_frequencies(samples: DataFrame, by: list[str]) -> DataFrame:
    """Allele statistics (af) of each group of samples, one genotype (alleles) a row."""
    return samples.groupBy(*by).agg(gt.sample_frequencies(F.col("alleles")).alias("af"))


def equilibrium(counts: DataFrame) -> DataFrame:
    """``counts`` (with af) and hw, the exact tests, which are worked out once for calls of equal counts."""
    counts = stored(counts, "frequencies")
    key = {"__ref": F.get("af.AC", F.lit(0)), "__alt": F.get("af.AC", F.lit(1)), "__het": F.col("af.N_HET")}
    tested = counts.select(*[c.alias(k) for k, c in key.items()]).distinct().withColumn("hw", gt.hardy_weinberg(F.col("__ref"), F.col("__alt"), F.col("__het")))
    return counts.withColumns(key).join(tested, list(key)).drop(*key)


def group_frequencies(samples: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Allele statistics per call and group: one row of samples is (id, sample, alleles), of labels (sample, group)."""
    rows = samples.join(labels, "sample") if labels is not None else samples
    return allele_frequencies(rows.groupBy("id", "group").agg(F.collect_list("alleles").alias("gts")))


def hom_percent(calls: DataFrame, rows: DataFrame, buffer: int = 5000, minanno: int = 50, maxgt: int = 1, mincount: int = 0) -> DataFrame:
    """Share of homozygous genotypes among the small rows around each large call, in percent with one decimal."""
    big = calls.where(F.col("svlen") >= minanno).select("id", "chrom", F.greatest(F.col("start") - buffer, F.lit(0)).alias("lo"), (F.col("end") + buffer).alias("hi"))
    small = rows.where(F.col("svlen") <= maxgt).select("chrom", F.col("start").alias("r_start"), (F.col("start") + 1).alias("r_end"), gt.genotype(F.col("alleles")).alias("g"))
    near = intervals.range_join(big, small, ["chrom"], ("lo", "hi"), ("r_start", "r_end")).where(F.col("g").isin("HET", "HOM"))
    n = near.groupBy("id").agg(F.count_if(F.col("g") == "HOM").alias("hom"), F.count("*").alias("n"))
    got = calls.where(F.col("svlen") >= minanno).select("id").join(n, "id", "left")
    n0 = F.coalesce("n", F.lit(0))
    return got.select("id", F.when(n0 < mincount, None).when(n0 == 0, float("nan")).otherwise(F.round(F.col("hom") / F.col("n") * 100, 1)).alias("hompct"))


def neighbors(calls: DataFrame, refdist: int = 1000, sizemin: int = 50) -> DataFrame:
    """num_neighbors: other calls whose span, widened by refdist, overlaps the call's own widened span; neigh_id: the run they form."""
    able = calls.where(F.col("svlen") >= sizemin).select("id", "chrom", (F.col("start") - refdist).alias("lo"), (F.col("end") + refdist).alias("hi"))
    counts = intervals.overlap_counts(able, able, ["chrom"], ("lo", "hi"), ["id"], ("lo", "hi"), "others")
    counts = counts.select("id", (F.col("others") - 1).alias("num_neighbors"))  # less itself
    runs = intervals.with_islands(able, ["chrom"], "lo", "hi", 0, "neigh_id", touching=False, order=["id"])
    return runs.join(counts, "id", "left").select("id", "chrom", F.coalesce("num_neighbors", F.lit(0)).alias("num_neighbors"), "neigh_id")


def sv_info(calls: DataFrame, minsize: int = 50) -> DataFrame:
    """Type and size derived anew from the alleles; null for calls below ``minsize``."""
    size = sv_size(F.col("start"), F.col("end"), F.col("ref"), F.col("alt"), F.lit(None).cast("long"))
    kind = sv_type(F.col("ref"), F.col("alt"), F.lit(None).cast("string"))
    return calls.withColumns({"new_type": F.when(size >= minsize, kind), "new_len": F.when(size >= minsize, size)})


def repeat_annotation(calls: DataFrame, repeats: DataFrame, motif_similarity: float = 0.9) -> DataFrame:
    """The best tandem repeat for each deletion or insertion, and by how many copies the call changes it.

    repeats: chrom, r_start, r_end, motif, period, copies, score.  Deletions
    lose (overlap share * length) / period copies; insertions whose sequence
    resembles the motif repeated gain length / period.
    """
    inside = intervals.range_join(
        calls.withColumn("__stop", F.greatest(F.col("end"), F.col("start") + 1)), repeats, ["chrom"], ("start", "__stop"), ("r_start", "r_end")
    ).where(F.col("period") > 0)
    share = F.when(F.col("end") > F.col("start"), F.greatest(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0)) / (F.col("end") - F.col("start"))).otherwise(1.0)
    gained = F.col("svlen") / F.col("period")
    sim = sq.similarity(F.col("alt"), sq.faux_repeat(F.col("motif"), gained)) if "alt" in calls.columns else F.lit(1.0)
    rated = inside.withColumns({"ovl": share, "sim": F.when(F.col("svtype") == "INS", sim).otherwise(1.0)})
    rated = rated.where((F.col("svtype") == "DEL") | ((F.col("svtype") == "INS") & (F.col("sim") >= motif_similarity)))
    diff = F.when(F.col("svtype") == "DEL", F.round(-(F.col("ovl") * F.col("svlen")) / F.col("period"), 1)).otherwise(F.round(gained, 1))
    best = rated.withColumn("diff", diff).groupBy("id").agg(
        F.max_by(
            F.struct("motif", "period", "copies", "score", "ovl", "sim", "diff", "r_start", "r_end"),
            F.struct("ovl", "score", F.col("r_end") - F.col("r_start"), -F.col("r_start"), "motif"),
        ).alias("trf")
    )
    return best.select("id", "trf.*")


def nested(spans: DataFrame, by: list[str] = ("chrom",), start: str = "r_start", end: str = "r_end") -> DataFrame:
    """Different spans with level, how many others enclose each, and up_start and up_end of the innermost of these (null on level 0)."""
    by = list(by)
    own = spans.select(*by, start, end).distinct().withColumn("__stop", F.greatest(F.col(end), F.col(start) + 1))
    outer = own.select(*by, F.col(start).alias("__os"), F.col(end).alias("__oe"), F.col("__stop").alias("__ostop"))
    pairs = intervals.range_join(own, outer, by, (start, "__stop"), ("__os", "__ostop"))
    around = pairs.where((F.col("__os") <= F.col(start)) & (F.col("__oe") >= F.col(end)) & ((F.col("__os") < F.col(start)) | (F.col("__oe") > F.col(end))))
    inner = F.max_by(F.struct("__os", "__oe"), F.struct(F.col("__os") - F.col("__oe"), "__os"))
    levels = around.groupBy(*by, start, end).agg(F.count("*").alias("level"), inner.alias("__up"))
    out = own.drop("__stop").join(levels, [*by, start, end], "left")
    return out.select(*by, start, end, F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.col("__up.__os").alias("up_start"), F.col("__up.__oe").alias("up_end"))


def repeat_stack(calls: DataFrame, repeats: DataFrame) -> DataFrame:
    """The repeats around each call as a stack: a row for each, level 0 the outermost, left counting those still inside of it.

    A repeat is around a call that starts in it and ends before its end.
    Outermost are the longest, then those that start first.
    """
    data = [c for c in repeats.columns if c != "chrom"]
    wide = calls.select("id", "chrom", "start", "end").withColumn("__stop", F.greatest(F.col("end"), F.col("start") + 1))
    around = intervals.range_join(wide, repeats, ["chrom"], ("start", "__stop"), ("r_start", "r_end"))
    around = around.where((F.col("start") >= F.col("r_start")) & (F.col("end") < F.col("r_end")))
    w = Window.partitionBy("id")
    order = [F.desc(F.col("r_end") - F.col("r_start")), "r_start", *[c for c in data if c not in ("r_start", "r_end")]]
    return around.withColumn("level", F.row_number().over(w.orderBy(*order)) - 1).withColumn("left", F.count("*").over(w) - 1 - F.col("level")).select("id", "level", "left", *data)


def repeat_hits(hits: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The best masked repeat of each call: (id, score, repeat, clsfam, span, seq_len) rows, the largest share of the sequence first."""
    rated = hits.withColumn("share", F.col("span") / F.col("seq_len")).where(F.col("share") >= threshold)
    best = F.max_by(F.struct("score", "repeat", "clsfam", "share"), F.struct("share", "score", "repeat"))
    return rated.groupBy("id").agg(best.alias("m")).select("id", "m.*")


def remapped(hits: DataFrame, calls: DataFrame, threshold: float = 0.8, dist: int = 10, keep: int = 0) -> DataFrame:
    """novel, tandem, interspersed or partial, from alignments (id, hit_chrom, hit_start, hit_end, pct_query) of a call's sequence."""
    j = calls.select("id", "chrom", "start", "end").join(hits, "id", "left")
    good = F.col("pct_query") >= threshold
    near = good & (F.col("hit_chrom") == F.col("chrom")) & ((F.abs(F.col("hit_start") - F.col("start")) <= dist) | (F.abs(F.col("hit_end") - F.col("end")) <= dist))
    top = F.reverse(F.array_sort(F.collect_list(F.when(good, F.struct("pct_query", "hit_chrom", "hit_start")))))
    g = j.groupBy("id").agg(F.bool_or(near).alias("near"), F.bool_or(good).alias("good"), F.count("pct_query").alias("n"), top.alias("hits"))
    kind = F.when(F.col("n") == 0, "novel").when(F.col("near"), "tandem").when(F.col("good"), "interspersed").otherwise("partial")
    return g.select("id", kind.alias("remap"), (F.slice("hits", 1, keep) if keep else F.slice("hits", 1, 0)).alias("remap_hits"))


def kmers(calls: DataFrame, reference: str = "ref_window", alt: str = "alt", k: int = 50, anchor: int = 0) -> DataFrame:
    """Flanking k-mers of the reference and the alternative at both breakpoints; the window begins k before the call."""
    w, a = F.col(reference), F.col(alt)
    n = F.col("end") - F.col("start")
    up, down = F.substring(w, F.lit(1), F.lit(k)), F.substring(w, n.cast("int") + k + 1, F.lit(k))
    return calls.withColumns(
        {
            "ref_up": F.concat(up, F.substring(w, F.lit(k + 1), F.lit(k))),
            "ref_dn": F.concat(F.substring(w, n.cast("int") + 1, F.lit(k)), down),
            "alt_up": F.concat(up, F.substring(F.concat(a, down), 1, k)),
            "alt_dn": F.concat(F.right(F.concat(up, a), F.lit(k)), down),
        }
    )


def mapping_stats(hits: DataFrame) -> DataFrame:
    """For each call and k-mer: number of hits, and min, max and mean of mapping quality, edits and matched share."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("mapq", "edits", "pct") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return hits.groupBy("id", "kmer").agg(F.count("*").alias("nhits"), F.count_if(F.col("strand") == "+").alias("dir_hits"), F.count_if(F.col("strand") == "-").alias("com_hits"), *stats)
