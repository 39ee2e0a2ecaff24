"""Variant call files as DataFrames, and back.

Lines are read by Spark's text source (compressed files too) and parsed with
built-in expressions; the header is small and kept on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as v

_FIELD = re.compile(r'##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,>]+)')
_CONTIG = re.compile(r"##contig=<ID=([^,>]+)(?:,length=(\d+))?")
_TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean", "String": "string", "Character": "string"}


@dataclass
class Header:
    """Declared fields as (number, type), contigs with lengths, and samples, in order."""

    lines: list[str]
    info: dict[str, tuple[str, str]] = field(default_factory=dict)
    format: dict[str, tuple[str, str]] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        out = cls([x for x in lines if x.startswith("##")])
        for line in lines:
            if m := _FIELD.match(line):
                (out.info if m[1] == "INFO" else out.format)[m[2]] = (m[3], m[4])
            elif m := _CONTIG.match(line):
                out.contigs[m[1]] = int(m[2]) if m[2] else None
            elif line.startswith("#CHROM"):
                out.samples = line.rstrip("\n").split("\t")[9:]
        return out

    def with_info(self, name: str, number: str, kind: str, text: str) -> Header:
        """A header that declares one more INFO field; one that exists stays."""
        if name in self.info:
            return self
        lines = [*self.lines, f'##INFO=<ID={name},Number={number},Type={kind},Description="{text}">']
        return Header(lines, self.info | {name: (number, kind)}, self.format, self.contigs, self.samples)

    def with_format(self, name: str, number: str, kind: str, text: str) -> Header:
        """A header that declares one more FORMAT field; one that exists stays."""
        if name in self.format:
            return self
        lines = [*self.lines, f'##FORMAT=<ID={name},Number={number},Type={kind},Description="{text}">']
        return Header(lines, self.info, self.format | {name: (number, kind)}, self.contigs, self.samples)

    def contig_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, n) for k, n in self.contigs.items()], "chrom string, length long")


def header_of(spark: SparkSession, path: str) -> Header:
    """The header lines at the front of a file, or of the files of a folder in the order of their names; nothing behind them is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    found = fs.globStatus(top)
    if not found:
        raise FileNotFoundError(path)
    places = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        places += [x.getPath() for x in inner if x.isFile() and x.getPath().getName()[0] not in "._"]
    codecs, lines = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf), []
    for place in sorted(places, key=lambda x: x.toString()):
        codec, stream = codecs.getCodec(place), fs.open(place)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                if not line.startswith("#"):
                    return Header.parse(lines)
                lines.append(line)
        finally:
            reader.close()
    return Header.parse(lines)


def read_vcf(spark: SparkSession, path: str, header: Header | None = None, drop_samples: bool = False) -> DataFrame:
    """The variants schema: fixed columns, info map, samples, and the derived columns that comparisons use."""
    head = header or header_of(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    return parse_lines(lines, [] if drop_samples else head.samples)


def parse_lines(lines: DataFrame, samples: list[str], value: str = "value") -> DataFrame:
    """Rows of tab-separated record lines; ``ordinal`` is the order within the scan."""
    f = F.split(F.col(value), "\t")

    def col(i: int) -> Column:
        return F.get(f, F.lit(i))

    def dot(c: Column) -> Column:
        return F.when(c != ".", c)

    info_map = F.str_to_map(F.when(col(7) == ".", "").otherwise(col(7)), F.lit(";"), F.lit("="))
    raw = lines.select(
        F.monotonically_increasing_id().alias("ordinal"),
        col(0).alias("chrom"),
        col(1).cast("long").alias("pos"),
        dot(col(2)).alias("vid"),
        col(3).alias("ref"),
        F.when(col(4) != ".", F.split(col(4), ",")).alias("alts"),
        dot(col(5)).cast("float").alias("qual"),
        F.when(col(6) == ".", F.array().cast("array<string>")).otherwise(F.split(col(6), ";")).alias("filters"),
        F.map_filter(info_map, lambda k, _: k != "").alias("info"),
        F.split(F.coalesce(col(8), F.lit("")), ":").alias("fmt_keys"),
        F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("__samples") if samples else F.array().cast("array<string>").alias("__samples"),
    )
    alt = F.get("alts", F.lit(0))
    start = F.col("pos") - 1
    end = F.coalesce(F.col("info").getItem("END").try_cast("long"), start + F.length("ref"))
    info_len = F.get(F.split(F.col("info").getItem("SVLEN"), ","), F.lit(0)).try_cast("long")
    out = raw.withColumns({"start": start, "end": end, "alt": alt})
    out = out.withColumns(
        {
            "svtype": v.sv_type(F.col("ref"), F.col("alt"), F.col("info").getItem("SVTYPE")),
            "svlen": v.sv_size(F.col("start"), F.col("end"), F.col("ref"), F.col("alt"), info_len),
            "is_bnd": v.is_bnd(F.col("alt")),
            "is_symbolic": v.is_symbolic(F.col("alt")),
            "is_filtered": v.is_filtered(F.col("filters")),
        }
    )

    names = F.array(*[F.lit(x) for x in samples]) if samples else F.array().cast("array<string>")

    def bound(x: Column, fn) -> Column:
        """``fn`` of a value that is worked out once, however often ``fn`` uses it."""
        return F.get(F.transform(F.array(x), fn), F.lit(0))

    def sample(s: Column, i: Column) -> Column:
        def of(fmt: Column) -> Column:
            def with_gt(g: Column) -> Column:
                alleles = F.transform(F.split(g, r"[/|]"), lambda x: x.try_cast("int"))
                return F.struct(F.get(names, i).alias("name"), alleles.alias("alleles"), g.contains("|").alias("phased"), fmt.alias("fmt"))

            return bound(fmt.getItem("GT"), with_gt)

        def fields(parts: Column) -> Column:
            n = F.least(F.size("fmt_keys"), F.size(parts))
            return bound(F.map_from_arrays(F.slice("fmt_keys", 1, n), F.slice(parts, 1, n)), of)

        return bound(F.split(s, ":"), fields)

    out = out.withColumn("samples", F.transform("__samples", sample)).drop("__samples")
    out = out.withColumns({"alleles": F.get("samples", F.lit(0))["alleles"], "gts": F.transform("samples", lambda s: s["alleles"])})
    mate, turn = v.bnd_mate(F.col("alt")), v.bnd_direction(F.col("alt"))
    bnd = {"chrom2": mate["chrom2"], "pos2": mate["pos2"], "direction": turn["direction"], "strand": turn["strand"]}
    ci = F.transform(F.split(F.col("info").getItem("CIPOS"), ","), lambda x: x.try_cast("int"))
    return out.withColumns({k: F.when(F.col("is_bnd"), c) for k, c in bnd.items()} | {"ci": ci, "id": F.col("ordinal")})


def flat_table(variants: DataFrame, header: Header, info: bool = True, fmt: bool = True, sample: list[str] | None = None, no_prefix: bool = False, alleles: bool = False, hasher: str = "sha1") -> DataFrame:
    """One flat row per variant: key, place, type, size bin, filter, and a typed column for each declared field.

    Fields with a value per allele become _ref and _alt columns, with a value
    per genotype _ref, _het and _hom; flags become booleans; fixed numbers over
    one arrays.
    """
    first_alt = F.coalesce("alt", F.lit(""))
    out = [
        v.hashed(v.key(F.col("chrom"), F.col("start"), F.col("end"), F.col("alt")), hasher).alias("hash"),
        "chrom", "start", "end", F.col("vid").alias("id"), "svtype", "svlen", v.size_bin(F.col("svlen")).alias("szbin"),
        "qual", F.col("filters").alias("filter"), (~F.col("is_filtered")).alias("is_pass"),
    ]
    if alleles:
        out += ["ref", "alts"]

    def typed(c: Column, name: str, number: str, kind: str) -> list[Column]:
        t = _TYPES.get(kind, "string")
        if kind == "Flag" or number == "0":
            return [c.isNotNull().alias(name)]
        parts = F.split(c, ",")
        if number in ("R", "G"):
            ends = ("ref", "alt") if number == "R" else ("ref", "het", "hom")
            return [F.get(parts, F.lit(i)).try_cast(t).alias(f"{name}_{e}") for i, e in enumerate(ends)]
        if number in ("1",):
            return [c.try_cast(t).alias(name)]
        return [F.transform(parts, lambda x: x.try_cast(t)).alias(name)]

    if info:
        fixed = {"hash", "chrom", "start", "end", "id", "svtype", "svlen", "szbin", "qual", "filter", "is_pass", "ref", "alts"}
        for name, (number, kind) in header.info.items():
            got = F.col("info").getItem(name)
            label = f"INFO_{name}" if name.lower() in fixed else name  # column names don't differ by case alone
            out += [F.map_contains_key("info", F.lit(name)).alias(label)] if kind == "Flag" else typed(got, label, number, kind)
    if fmt:
        chosen = sample or header.samples
        prefix = not no_prefix or len(chosen) > 1
        for s in chosen:
            at = F.get("samples", F.lit(header.samples.index(s)))
            for name, (number, kind) in header.format.items():
                label = f"{s}_{name}" if prefix else name
                if name == "GT":
                    out.append(at["alleles"].alias(label))
                else:
                    out += typed(F.when(at["fmt"].getItem(name) != ".", at["fmt"].getItem(name)), label, number, kind)
    return variants.select(*out)


def lines_of(variants: DataFrame, resolved: bool = False, keep: list[str] = ()) -> DataFrame:
    """Record lines (chrom, pos, the columns of ``keep``, value) of the variants schema."""
    info = F.array_join(F.array_sort(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))), ";")

    def gt(s: Column) -> Column:
        body = F.array_join(F.transform(s["alleles"], lambda x: F.coalesce(x.cast("string"), F.lit("."))), "/")
        body = F.when(s["phased"], F.translate(body, "/", "|")).otherwise(body)
        return F.array_join(F.transform("fmt_keys", lambda k: F.when(k == "GT", body).otherwise(F.coalesce(s["fmt"].getItem(k), F.lit(".")))), ":")

    ref, alts = F.col("ref"), F.col("alts")
    if resolved and "res_ref" in variants.columns:
        ref, alts = F.coalesce("res_ref", "ref"), F.when(F.col("res_alt").isNotNull(), F.array("res_alt")).otherwise(F.col("alts"))

    def dot(c: Column) -> Column:
        return F.when(c.isNull() | (c == ""), ".").otherwise(c)

    cols = [
        F.col("chrom"), F.col("pos").cast("string"), dot(F.col("vid")), ref, dot(F.array_join(alts, ",")),
        dot(F.col("qual").cast("string")), dot(F.array_join("filters", ";")), dot(info),
    ]
    tail = F.when(F.size("samples") > 0, F.concat(F.lit("\t"), F.array_join("fmt_keys", ":"), F.lit("\t"), F.array_join(F.transform("samples", gt), "\t"))).otherwise("")
    return variants.select("chrom", "pos", *keep, F.concat(F.concat_ws("\t", *cols), tail).alias("value"))


def write_vcf(variants: DataFrame, path: str, header: Header, resolved: bool = False, compression: str | None = None) -> None:
    """Text files under ``path`` that make one sorted file in the order of their names: the header, then records by contig and place.

    Contigs come in the header's order, others behind them by name.
    """
    spark = variants.sparkSession
    head = [*header.lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *header.samples] if header.samples else [])])]
    top = spark.createDataFrame([(-1, "", i, x) for i, x in enumerate(head)], "rank int, chrom string, pos long, value string")
    ranks = spark.createDataFrame(list(enumerate(header.contigs)), "rank int, chrom string")
    body = lines_of(variants, resolved).join(ranks, "chrom", "left").select(F.coalesce("rank", F.lit(len(header.contigs))).alias("rank"), "chrom", "pos", "value")
    writer = top.unionByName(body).orderBy("rank", "chrom", "pos", "value").select("value").write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def raw_keys(spark: SparkSession, path: str, file_no: int) -> DataFrame:
    """(key, file_no): the first five columns of every record line, nothing more parsed."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.substring_index("value", "\t", 5).alias("key"), F.lit(file_no).alias("file_no"))


def light_rows(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, ref, alt, info) of record lines; the end is that of the reference allele, whatever INFO says."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    start = F.get(f, F.lit(1)).cast("long") - 1
    info = F.str_to_map(F.get(f, F.lit(7)), F.lit(";"), F.lit("="))
    return lines.select(F.get(f, F.lit(0)).alias("chrom"), start.alias("start"), (start + F.length(F.get(f, F.lit(3)))).alias("end"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), info.alias("info"))


def lines_within(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Record lines whose place lies in [start, end) of a contig; only the first two fields are looked at."""
    lines = spark.read.text(path).where(F.col("value").startswith(chrom + "\t"))
    at = F.get(F.split("value", "\t", 3), F.lit(1)).cast("long") - 1
    return lines.where((at >= start) & (at < end))


def with_figures(states: DataFrame, names: list[str]) -> DataFrame:
    """The given columns, where they aren't null, as entries of the info map; entries of the same names are replaced."""

    def text(n: str) -> Column:
        c = F.col(n)
        return F.array_join(c, ",") if dict(states.dtypes)[n].startswith("array") else c.cast("string")

    own = F.map_filter("info", lambda k, _: ~k.isin(*names))
    new = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), text(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull()))
    return states.withColumn("info", F.map_concat(own, new))


def with_format(variants: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Fields that every sample of a row gets, behind those it has; one of the same name is replaced."""
    names = F.array(*[F.lit(n) for n in values])
    own = F.map_from_arrays(names, F.array(*[c.cast("string") for c in values.values()]))
    fmt = F.transform("samples", lambda s: s.withField("fmt", F.map_concat(F.map_filter(s["fmt"], lambda k, _: ~F.array_contains(names, k)), own)))
    return variants.withColumns({"samples": fmt, "fmt_keys": F.array_union("fmt_keys", names)})


def with_alleles(variants: DataFrame) -> DataFrame:
    """The samples' alleles as ``gts`` has them, where something changed these."""
    same = F.transform("samples", lambda s, i: s.withField("alleles", F.coalesce(F.get("gts", i), s["alleles"])))
    return variants.withColumn("samples", same)
