"""Outputs: result folders, tables, JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bench import Bench, annotations
from ..params import Params
from .vcf import Header, flat_table, header_of, read_vcf, with_figures, with_format, write_vcf


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_json(df: DataFrame, path: str) -> dict:
    """A report of one row as a JSON file in ``path``; returns it."""
    row = df.first()
    got = row.asDict(recursive=True) if row else {}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(got, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return got


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)


#: Figures that a call's record gets, with their number, type and text; the names are fixed values.
FIGURES = {
    "PctSeqSimilarity": ("1", "Float", "Similarity of the two calls' sequences"),
    "PctSizeSimilarity": ("1", "Float", "Smaller size over larger size"),
    "PctRecOverlap": ("1", "Float", "Shared span over the longer span"),
    "SizeDiff": ("1", "Integer", "Base size less comparison size"),
    "StartDistance": ("1", "Integer", "Base start less comparison start"),
    "EndDistance": ("1", "Integer", "Base end less comparison end"),
    "GTMatch": ("1", "Integer", "How far the allele counts differ"),
    "TruScore": ("1", "Integer", "Mean of the similarities, of 100"),
    "MatchId": (".", "String", "Block and number of either call"),
    "Multi": ("0", "Flag", "The best match was taken by another call"),
}
#: Names of the outputs by verdict.
VERDICTS = {"tpbase": "tp-base", "tp": "tp-comp", "fn": "fn", "fp": "fp"}


def with_declared(header: Header) -> Header:
    for name, (number, kind, text) in FIGURES.items():
        header = header.with_info(name, number, kind, text)
    return header


def write_bench(result: Bench, path: str, headers: tuple[Header, Header] | None = None) -> dict:
    """States by verdict, candidates for refinement, parameters and summary under ``path``; returns the summary.

    With the headers of base and comp, each verdict's calls also as records
    with their figures: tp-base.vcf, tp-comp.vcf, fn.vcf and fp.vcf.
    """
    spark = result.calls.sparkSession
    states = annotations(result.states())
    states.write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/states")
    if headers is not None:
        again = read_states(spark, path)
        marked = with_figures(again.withColumns({"Multi": F.when(F.col("Multi"), ""), "MatchId": F.when(F.size(F.filter("MatchId", lambda x: x.isNotNull())) > 0, F.col("MatchId"))}), list(FIGURES))
        marked = marked.withColumn("info", F.transform_values("info", lambda k, v: F.when(k != "Multi", v)))
        for verdict, name in VERDICTS.items():
            head = headers[0] if verdict in ("tpbase", "fn") else headers[1]
            write_vcf(marked.where(F.col("verdict") == verdict), f"{path}/{name}.vcf", with_declared(head), result.params.write_resolved)
    write_tsv(result.refine_candidates(), f"{path}/candidate.refine.bed", header=False)
    settings = json.dumps(result.params.__dict__, default=str)
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
    return write_json(result.summary(), f"{path}/summary")


def read_params(spark: SparkSession, path: str) -> Params:
    """The parameters of a result folder."""
    found = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/params").collect()))
    if isinstance(found.get("dynthresh"), list):
        found["dynthresh"] = tuple(found["dynthresh"])
    return Params(**found)


def read_refined_regions(spark: SparkSession, path: str) -> DataFrame:
    """The regions of a refinement, with typed counts and whether each was refined."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{path}/regions")
    kinds = {c: "boolean" if c == "refined" else "long" for c in rows.columns if c in ("start", "end", "refined") or c.startswith(("in_", "out_"))}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


def concatenated(spark: SparkSession, path: str, verdicts: list[str]) -> DataFrame:
    """The record lines of several outputs of a result folder in one table: chrom, pos, value, verdict."""
    out = None
    for v in verdicts:
        lines = spark.read.text(f"{path}/{VERDICTS[v]}.vcf").where(~F.col("value").startswith("#"))
        f = F.split("value", "\t", 3)
        one = lines.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), "value", F.lit(v).alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


def read_states(spark, path: str) -> DataFrame:
    """The states of a result folder, with the verdict as a column."""
    return spark.read.parquet(f"{path}/states")


def read_bench_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of a result folder flattened as ``flat_table`` does, with a column state: tpbase, tp, fn or fp; columns that an output hasn't are null."""
    out = None
    for verdict, name in VERDICTS.items():
        head = header_of(spark, f"{path}/{name}.vcf")
        one = flat_table(read_vcf(spark, f"{path}/{name}.vcf", head), head, **options).withColumn("state", F.lit(verdict))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_truth_and_query(rows: DataFrame, path: str, headers: tuple[Header, Header]) -> None:
    """Rows of ``truth_and_query`` as records, truth in base.vcf and query in comp.vcf, with BD and BK for each sample and IsRefined."""
    for name, head, of in (("base", headers[0], "truth"), ("comp", headers[1], "query")):
        head = head.with_info("IsRefined", "1", "String", "Whether the record comes from refinement")
        head = head.with_format("BD", "1", "String", "Decision").with_format("BK", "1", "String", "Kind of match or mismatch")
        own = with_format(rows.where(F.col("set") == of), {"BD": F.col("BD"), "BK": F.col("BK")})
        own = with_figures(own.withColumn("IsRefined", F.when(F.col("is_refined"), "True").otherwise("False")), ["IsRefined"])
        write_vcf(own, f"{path}/{name}.vcf", head)


def write_harmonised(made: DataFrame, path: str, contigs: dict[str, int | None], samples: list[str]) -> None:
    """Rows of ``harmonise`` as records of genotypes alone, one for each place and change, a column for each sample."""
    lines = ["##fileformat=VCFv4.1", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    lines += [f"##contig=<ID={c}{'' if n is None else f',length={n}'}>" for c, n in contigs.items()]
    head = Header(lines, {}, {"GT": ("1", "String")}, contigs, samples)
    per = made.where("error IS NULL").groupBy("chrom", "start", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample", "alleles"))).alias("own"))

    def sample(name: str):
        alleles = F.coalesce(F.try_element_at("own", F.lit(name)), F.array(F.lit(0), F.lit(0)))
        return F.struct(F.lit(name).alias("name"), alleles.alias("alleles"), F.lit(True).alias("phased"), F.create_map(F.lit("GT"), F.lit("")).alias("fmt"))

    empty = F.array().cast("array<string>")
    rows = per.select(
        "chrom", (F.col("start") + 1).alias("pos"), F.lit(None).cast("string").alias("vid"), "ref", F.array("alt").alias("alts"), F.lit(None).cast("float").alias("qual"), empty.alias("filters"),
        F.map_from_arrays(empty, empty).alias("info"), F.array(F.lit("GT")).alias("fmt_keys"), F.array(*[sample(x) for x in samples]).alias("samples"),
    )
    write_vcf(rows, path, head)
