"""Projections of the synthetic tables onto calls, regions, genotypes and sequences, with the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of both sides: seconds since 2024 as places, value as length, user as type and contig."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    i = F.col("event_id")
    alleles = F.when(i % 11 == 0, F.array(F.lit(None).cast("int"), F.lit(1))).otherwise(F.array(F.floor(i / 2).cast("int") % 2, F.floor(i / 4).cast("int") % 2))
    return e.select(
        i.alias("id"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + 50 + F.floor("value").cast("long")).alias("end"),
        (start + 1).alias("pos"),
        F.element_at(F.array(F.lit("DEL"), F.lit("INS"), F.lit("DUP")), (F.col("user_id") % 3).cast("int") + 1).alias("svtype"),
        (50 + F.floor("value").cast("long")).alias("svlen"),
        alleles.alias("alleles"),
        F.when(i % 2 == 0, "base").otherwise("comp").alias("side"),
    )


CALLS = """
iv AS (SELECT event_id AS id, event_type || '_' || CAST(user_id % 10 AS VARCHAR) AS chrom,
  date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS s,
  date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) + 50 + CAST(floor(value) AS BIGINT) AS e,
  CASE user_id % 3 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' ELSE 'DUP' END AS svtype,
  50 + CAST(floor(value) AS BIGINT) AS svlen,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id // 2) % 2 AS INT) END AS a1,
  CASE WHEN event_id % 11 = 0 THEN 1 ELSE CAST((event_id // 4) % 2 AS INT) END AS a2,
  CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'comp' END AS side
  FROM events)"""


def days(spark: SparkSession, n: int = 30) -> DataFrame:
    """Whole days on every contig as regions, odd days from their second quarter on."""
    chroms = F.explode(F.array(*[F.lit(f"{t}_{k}") for t in ("click", "error", "purchase", "signup", "view") for k in range(10)]))
    d = spark.range(n).select(F.col("id").alias("day"), chroms.alias("chrom"))
    start = F.col("day") * 86400 + F.when(F.col("day") % 2 == 1, 21600).otherwise(0)
    return d.select("chrom", start.alias("start"), ((F.col("day") + 1) * 86400).alias("end"), F.concat_ws(":", "chrom", F.col("day").cast("string")).alias("region_id"))


DAYS = """
days AS (SELECT t || '_' || CAST(k AS VARCHAR) AS chrom, d * 86400 + CASE WHEN d % 2 = 1 THEN 21600 ELSE 0 END AS rs, (d + 1) * 86400 AS re,
  t || '_' || CAST(k AS VARCHAR) || ':' || CAST(d AS VARCHAR) AS region_id
  FROM range(30) x(d), range(10) y(k), (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) z(t))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters A-Z of each document as a sequence."""
    d = table(spark, sf_dir, "documents")
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return d.select(F.col("doc_id").alias("id"), seq.alias("seq"))


SEQUENCES = """
sq AS (SELECT doc_id AS id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS seq FROM documents)"""


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters A-Z of each turn of a conversation as a sequence, of some hundreds of letters."""
    d = table(spark, sf_dir, "conversations")
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("k"), (F.col("conv_id") % 3).cast("string")).alias("kind"), seq.alias("seq"))


ALLELES = """
sq AS (SELECT conv_id * 1000 + turn AS id, 'k' || CAST(conv_id % 3 AS VARCHAR) AS kind, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS seq FROM conversations)"""


def genotype_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples of a variant, the order."""
    q = F.col("l_quantity").cast("long")
    d = F.round(F.col("l_discount") * 100).cast("long")
    missing = F.col("l_tax") == 0
    alleles = F.when(missing, F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).otherwise(F.array((q % 2).cast("int"), (d % 2).cast("int")))
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sample"), F.col("l_returnflag").alias("group"), alleles.alias("alleles"), q.cast("int").alias("depth"))


GENOTYPES = """
gr AS (SELECT l_orderkey AS id, l_linenumber AS sample, l_returnflag AS grp,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) % 2 AS INT) END AS a1,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) % 2 AS INT) END AS a2,
  CAST(l_quantity AS INT) AS depth FROM lineitem)"""
