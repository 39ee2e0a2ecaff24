"""Interval files, repeat tables, reference sequences as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Columns (chrom, start, end) and whether starts count from one.
PRESETS = {"bed": (0, 1, 2, False), "gff": (0, 3, 4, True)}


def read_intervals(spark: SparkSession, path: str, columns: tuple[int, int, int] = (0, 1, 2), one_based: bool = False, comment: str = "#", id_format: str = "") -> DataFrame:
    """(chrom, start, end, region_id, fields) of a tab-separated interval file, compressed or not."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    f = F.split("value", "\t")
    start = F.get(f, F.lit(columns[1])).cast("long") - int(one_based)
    rid = F.monotonically_increasing_id()
    return lines.select(
        F.get(f, F.lit(columns[0])).alias("chrom"),
        start.alias("start"),
        F.get(f, F.lit(columns[2])).cast("long").alias("end"),
        (F.concat(F.lit(id_format), rid.cast("string")) if id_format else rid).alias("region_id"),
        f.alias("fields"),
    )


def preset(spark: SparkSession, path: str, name: str) -> DataFrame:
    c, s, e, one = PRESETS[name]
    return read_intervals(spark, path, (c, s, e), one)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sample, group) of a tab-separated file of samples and their groups."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.get(f, F.lit(0)).alias("sample"), F.get(f, F.lit(1)).alias("group"))


def parse_regions(spark: SparkSession, text: str) -> DataFrame:
    """Regions written as chrom:start-end, separated by commas."""
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", ",")).alias("r"))
    pattern = r"^\s*(.+):(\d+)-(\d+)\s*$"
    return rows.select(F.regexp_extract("r", pattern, 1).alias("chrom"), F.regexp_extract("r", pattern, 2).cast("long").alias("start"), F.regexp_extract("r", pattern, 3).cast("long").alias("end"))


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat annotations: one row per entry of each region's JSON column."""
    kind = "array<struct<chrom:string,start:bigint,end:bigint,period:double,copies:double,score:bigint,entropy:double,repeat:string,motif:string>>"
    rows = read_intervals(spark, path)
    got = rows.select("chrom", F.col("start").alias("reg_start"), F.col("end").alias("reg_end"), F.explode(F.from_json(F.element_at("fields", -1), kind)).alias("a"))
    return got.select("chrom", "reg_start", "reg_end", F.col("a.start").alias("r_start"), F.col("a.end").alias("r_end"), F.coalesce("a.repeat", "a.motif").alias("motif"), "a.period", "a.copies", "a.score", "a.entropy")


def read_finder_output(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a tandem repeat finder's output: an @key line, then rows of 17 fields, starts from one."""
    blocks = spark.read.option("lineSep", "@").text(path).where(F.trim("value") != "")
    rows = blocks.select(F.trim(F.substring_index("value", "\n", 1)).alias("key"), F.explode(F.split("value", "\n")).alias("line"))
    f = F.split(F.trim("line"), " ")
    ok = rows.where(F.size(f) == 17)
    names = {0: ("start", "long"), 1: ("end", "long"), 2: ("period", "double"), 3: ("copies", "double"), 7: ("score", "long"), 12: ("entropy", "double"), 13: ("motif", "string"), 14: ("sequence", "string")}
    cols = [F.get(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in names.items()]
    return ok.select("key", *cols).withColumn("start", F.col("start") - 1)


def read_masker_output(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a repeat masker's table: white-space columns behind three header lines."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\d+\s"))

    def n(i: int) -> Column:
        return F.regexp_replace(F.get(f, F.lit(i)), r"[()]", "").cast("long")

    return lines.select(F.get(f, F.lit(4)).alias("id"), n(0).alias("score"), F.get(f, F.lit(9)).alias("repeat"), F.get(f, F.lit(10)).alias("clsfam"), (n(6) - n(5) + 1).alias("span"))


def read_fasta(spark: SparkSession, path: str, tile: int = 100_000) -> DataFrame:
    """Reference tiles (chrom, tile, start, seq).

    Lines are placed by how many bases and which contig's name come before them
    in the file: summed up within each block that a task reads, and over the
    blocks in a table of one row per block.  No row holds more than a line or a
    tile.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", r"\s+$", "").alias("line"))
    top = F.col("line").startswith(">")
    name = F.regexp_extract("line", r"^>\s*(\S*)", 1)
    seq = F.when(top, "").otherwise(F.regexp_replace("line", r"\s", ""))
    rows = lines.select("file", "block", "nth", top.alias("top"), name.alias("name"), seq.alias("seq"))
    within = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    bases, last = F.length("seq"), F.struct("nth", F.col("name").alias("chrom"), F.col("past").alias("begun"))
    # bases up to the end of each line, then the last name before it with the bases before that
    summed = rows.withColumn("past", F.sum(bases).over(within)).withColumn("at", F.max(F.when(F.col("top"), last)).over(within))
    summed = stored(summed, "lines")
    blocks = summed.groupBy("file", "block").agg(F.sum(bases).alias("bases"), F.max(F.when(F.col("top"), last)).alias("last"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("bases").over(over), F.lit(0)))
    # a block number orders names over blocks, as line numbers do within one
    blocks = blocks.withColumn("carried", F.max(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last.chrom").alias("chrom"), (F.col("last.begun") + F.col("before")).alias("begun")))).over(over))
    placed = summed.where(~F.col("top") & (F.col("seq") != "")).join(blocks.select("file", "block", "before", "carried"), ["file", "block"])
    start = F.col("past") + F.col("before") - F.length("seq") - F.coalesce(F.col("at.begun") + F.col("before"), F.col("carried.begun"))
    placed = placed.select(F.coalesce("at.chrom", "carried.chrom").alias("chrom"), start.alias("start"), "seq").where(F.col("chrom").isNotNull())
    tiles = F.explode(F.sequence(F.floor(F.col("start") / tile).cast("int"), F.floor((F.col("start") + F.length("seq") - 1) / tile).cast("int")))
    cut = placed.withColumn("tile", tiles).withColumn("t0", F.col("tile").cast("long") * tile)
    skip = F.greatest(F.col("t0") - F.col("start"), F.lit(0)).cast("int")
    part = F.substring(F.col("seq"), skip + 1, (F.least(F.col("start") + F.length("seq"), F.col("t0") + tile) - F.col("start")).cast("int") - skip)
    pieces = cut.groupBy("chrom", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", part.alias("part")))), lambda x: x["part"]), "").alias("seq"))
    return pieces.select("chrom", "tile", (F.col("tile").cast("long") * tile).alias("start"), "seq")


def fetch(spans: DataFrame, tiles: DataFrame, tile: int = 100_000, by: str = "id") -> DataFrame:
    """The sequence of each span (by, chrom, start, end), pieced together from the tiles it touches."""
    need = spans.select(by, "chrom", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / tile).cast("int"), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / tile).cast("int"))).alias("tile"))
    t = tiles.withColumnRenamed("start", "t0")
    part = F.substring(F.col("seq"), (F.greatest("s", "t0") - F.col("t0")).cast("int") + 1, (F.least(F.col("e"), F.col("t0") + F.length("seq")) - F.greatest("s", "t0")).cast("int"))
    pieces = need.join(t, ["chrom", "tile"]).select(by, "tile", part.alias("part"))
    return pieces.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias("seq"))


def contig_regions(base_contigs: DataFrame, comp_contigs: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """Regions of a comparison: the base's contigs, or the given regions on contigs that the base has."""
    if include is not None:
        return include.join(base_contigs.select("chrom"), "chrom", "left_semi")
    checked = base_contigs.withColumn("length", F.when(F.col("length").isNull(), F.raise_error(F.lit("a contig has no length"))).otherwise(F.col("length")))
    return checked.select("chrom", F.lit(0).cast("long").alias("start"), (F.col("length") + 1).alias("end"))


def locus_ranges(variants: DataFrame, min_dist: int = 1000) -> DataFrame:
    """Spans of calls that lie closer than ``min_dist``."""
    from ..operators.intervals import merge_intervals

    return merge_intervals(variants.select("chrom", "start", "end"), ["chrom"], gap=min_dist, strict=True)
