"""Exact token-count statistics from a histogram of encoded lengths.

Texts are encoded once and only their lengths leave a task, already counted.
Suffix sums over the histogram answer every context limit at once: texts and
tokens beyond it, the total after truncation to it, and ranks for quantiles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, text_of, tune, written
from .tokens import default_ranks, encode

#: Lengths of one span of the two-level suffix sums.
SPAN = 1024


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row; null and empty texts have none."""
    tune(docs.sparkSession)
    path = ranks or default_ranks()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "n_tokens": pa.array([len(encode(t, path)) for t in batch.column(1).to_pylist()], pa.int64())}

    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long")


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(length, n_docs, first_doc, last_doc): exact counts, pre-aggregated before the shuffle."""
    return lengths.groupBy(F.col(col).alias("length")).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a limit:

    docs_at_least, tokens_at_least (of texts with L tokens or more), docs_up_to,
    truncated_total (tokens left when every text is cut to L) and total_docs,
    total_tokens.  Sums run within spans of 1024 lengths, and over the spans'
    totals, so no task holds the whole histogram.
    """
    hist = hist.withColumn("span", F.floor(F.col("length") / SPAN)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    over = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    above = spans.select("span", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t_above"))
    total = spans.agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
    inside = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = hist.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum("tokens").over(inside)}).join(above, "span")
    got = at_least.withColumns({"total_docs": F.lit(total["d"]).cast("long"), "total_tokens": F.lit(total["t"]).cast("long")})
    docs_at_least, tokens_at_least = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return got.select(
        "length",
        "n_docs",
        "first_doc",
        "last_doc",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        (F.col("total_docs") - docs_at_least + F.col("n_docs")).alias("docs_up_to"),
        (F.col("total_tokens") - tokens_at_least + docs_at_least * F.col("length")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """The suffix sums of all rows of ``docs``.

    Null texts are empty and have length 0; texts of any length are encoded
    whole; equal lengths are one row; repeated rows count each; an empty table
    gives no rows.
    """
    return suffix_sums(written(histogram(token_lengths(docs, id_col, text_col, ranks)), "histogram"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row with the tokens left under any limit, also one that no text has as its length."""
    return sums.agg(
        F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The exact quantile of lengths: the smallest length that at least a share ``q`` of the texts doesn't exceed."""
    return sums.where(F.col("docs_up_to") >= F.greatest(F.lit(1.0), F.ceil(F.lit(q) * F.col("total_docs")))).agg(F.min("length").alias("length"))
