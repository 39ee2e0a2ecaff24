"""Presence of calls in several files, shards, segments, strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import intervals


def presence(calls: DataFrame, key: str = "key", file_no: str = "file_no", n_files: int = 2, no_dups: bool = True) -> DataFrame:
    """Each key with a bit per file that has it, the first file's bit highest.

    Later copies of a key within a file are dropped; with ``no_dups`` False the
    second and later ones count under the key with the suffix .1.
    """
    if not no_dups:
        w = Window.partitionBy(file_no, key).orderBy(F.lit(1))
        calls = calls.withColumn(key, F.when(F.row_number().over(w) > 1, F.concat(F.col(key), F.lit(".1"))).otherwise(F.col(key)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(n_files - 1) - F.col(file_no).cast("int"))
    return calls.groupBy(key).agg(F.bit_or(bit).alias("flag"))


def consistency(found: DataFrame, n_files: int, group: str = "flag") -> DataFrame:
    """Groups of keys by the files they are in, most frequent first: group as a bit string, how many files, count, share."""
    g = found.groupBy(group).agg(F.count("*").alias("total"))
    total = found.agg(F.count("*").alias("all"))
    named = g.withColumns({"group": F.lpad(F.bin(F.col(group)), n_files, "0"), "n_files": F.bit_count(F.col(group))})
    return named.join(F.broadcast(total)).select("group", "n_files", "total", F.try_divide("total", "all").alias("share")).orderBy(F.desc("total"), "group")


def shared(found: DataFrame, n_files: int, group: str = "flag") -> DataFrame:
    """How many keys are in exactly so many files."""
    return found.groupBy(F.bit_count(F.col(group)).alias("n_files")).agg(F.count("*").alias("total"))


def per_file(found: DataFrame, n_files: int, group: str = "flag") -> DataFrame:
    """The number of keys that each file has."""
    files = F.explode(F.sequence(F.lit(0), F.lit(n_files - 1)))
    got = found.groupBy(group).agg(F.count("*").alias("n")).select(group, "n", files.alias("file_no"))
    bit = F.call_function("shiftright", F.col(group), F.lit(n_files - 1) - F.col("file_no")).bitwiseAND(F.lit(1))
    return got.where(bit == 1).groupBy("file_no").agg(F.sum("n").alias("total"))


def shards(calls: DataFrame, buffer: int = 1000, least: int = 50_000) -> DataFrame:
    """A shard number for every call: cut at gaps of ``buffer`` or more once a shard has ``least`` calls, and at each chrom.

    Islands are runs without such a gap.  Each island points to the one that
    would begin the next shard if it began one: the first with ``least`` calls
    or more between.  Which ones do follows from the first of each chrom by
    doubling these pointers, so no task walks a contig.
    """
    marked = stored(intervals.with_islands(calls, ["chrom"], "start", "end", buffer, "__island", touching=False, order=["id"]), "islands")
    sizes = marked.groupBy("chrom", "__island").agg(F.count("*").alias("n"))
    placed = intervals.running_sums(sizes.withColumn("past", F.col("n")), ["chrom"], "__island", ["past"], span=ISLANDS)
    placed = stored(placed.select("chrom", "__island", (F.col("past") - F.col("n")).alias("past")), "islands")  # calls before
    begun = _first_of_shards(placed, least)
    starts = placed.join(begun.withColumn("begins", F.lit(1).cast("long")), ["chrom", "past"], "left").withColumn("begins", F.coalesce("begins", F.lit(0).cast("long")))
    numbered = intervals.running_sums(starts.select("chrom", "__island", "begins"), ["chrom"], "__island", ["begins"], span=ISLANDS)
    out = marked.join(numbered, ["chrom", "__island"]).drop("__island")
    return out.withColumn("shard", F.concat_ws("_", "chrom", (F.col("begins") - 1).cast("string"))).drop("begins")


#: Islands that one window holds.
ISLANDS = 10_000


def _first_of_shards(placed: DataFrame, least: int) -> DataFrame:
    """(chrom, past) of the islands (chrom, past: calls before it on its chrom) that begin a shard."""
    least = max(least, 1)
    band = F.floor(F.col("past") / least)
    # what an island looks for lies in the band behind its own, or is the first of a later one
    looks = placed.select("chrom", (F.col("past") + least).alias("x"), F.col("past").alias("seeker"), (band + 1).alias("band"))
    there = placed.select("chrom", F.col("past").alias("x"), F.lit(None).cast("long").alias("seeker"), band.alias("band"))
    ahead = Window.partitionBy("chrom", "band").orderBy(F.desc("x"), F.asc_nulls_first("seeker")).rowsBetween(Window.unboundedPreceding, 0)
    found = looks.unionByName(there).withColumn("goal", F.min(F.when(F.col("seeker").isNull(), F.col("x"))).over(ahead)).where("seeker IS NOT NULL")
    firsts = there.groupBy("chrom", "band").agg(F.min("x").alias("first"))
    asked = looks.select("chrom", "band").distinct().join(firsts, ["chrom", "band"], "full")
    later = Window.partitionBy("chrom").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    asked = asked.withColumn("later", F.min("first").over(later))
    jump = found.join(asked.select("chrom", "band", "later"), ["chrom", "band"]).select("chrom", F.col("seeker").alias("past"), F.coalesce("goal", "later").alias("goal")).where("goal IS NOT NULL")
    jump = stored(jump, "jumps")
    reached = stored(placed.where("past = 0").select("chrom", "past"), "reached")
    while jump.limit(1).count():
        more = reached.join(jump, ["chrom", "past"]).select("chrom", F.col("goal").alias("past"))
        reached = stored(reached.unionByName(more).distinct(), "reached")
        twice = jump.withColumnRenamed("goal", "via").join(jump.select("chrom", F.col("past").alias("via"), "goal"), ["chrom", "via"])
        jump = stored(twice.select("chrom", "past", "goal"), "jumps")
    return reached


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """One row: how many shards, and count, mean, deviation, least, quartiles and most of the calls in each."""
    n = sharded.groupBy("shard").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return n.agg(F.count("*").alias("shards"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max("n").alias("most"))


def segments(calls: DataFrame) -> DataFrame:
    """Disjoint segments of deletions: how many calls cover each, and per sample the alleles summed (all segments, unmerged).

    calls: chrom, start, end and gts of deletions.  What begins and ends at each
    boundary is summed up along the contig, for each sample apart.
    """
    from ..functions.genotypes import genotype

    doses = F.transform(F.col("gts"), lambda g: F.when(genotype(g) == "HET", 1).when(genotype(g) == "HOM", 2).otherwise(0).cast("long"))
    rows = calls.where("start < end").select("chrom", "start", "end", F.posexplode_outer(doses).alias("sample", "dose"))
    rows = rows.withColumns({"sample": F.coalesce("sample", F.lit(-1)), "dose": F.coalesce("dose", F.lit(0).cast("long"))})
    pieces = intervals.covered_segments(rows, ["chrom", "sample"], ["dose"]).where("n > 0")
    cells = F.array_sort(F.collect_list(F.when(F.col("sample") >= 0, F.struct("sample", "dose"))))
    return pieces.groupBy("chrom", "seg_start", "seg_end").agg(F.max("n").alias("segcnt"), F.transform(cells, lambda x: x["dose"]).alias("seg"))


def stratify(states: DataFrame, regions: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Regions with the counts of tpbase, tp, fn and fp calls within each; one pass over the calls."""
    from ..functions.intervals import within

    names = ("tpbase", "tp", "fn", "fp")
    r = regions.select(*by, F.col("start").alias("__a"), F.col("end").alias("__b"), "region_id")
    r = r.withColumns({"__rs": F.col("__a") - 1, "__re": F.col("__b") + 1})
    rows = states.select(*by, "start", "end", "verdict", "svtype").withColumn("__stop", F.greatest(F.col("end"), F.col("start") + 1))
    pairs = intervals.range_join(rows, r, list(by), ("start", "__stop"), ("__rs", "__re"))
    inside = pairs.where(within(F.col("start"), F.col("end"), F.col("__a"), F.col("__b"), F.col("svtype") != "INS"))
    counts = inside.groupBy("region_id").agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in names])
    return regions.join(counts, "region_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def complement_counts(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: how many rows lie within no region."""
    r = regions.select("chrom", F.col("start").alias("__rs"), F.col("end").alias("__re"))
    inside = intervals.range_join(rows.withColumn("__stop", F.greatest(F.col("end"), F.col("start") + 1)), r, ["chrom"], ("start", "__stop"), ("__rs", "__re"))
    ids = inside.where((F.col("start") >= F.col("__rs")) & (F.col("end") <= F.col("__re"))).select("id").distinct()
    return rows.join(ids, "id", "left_anti").agg(F.count("*").alias("count"))
