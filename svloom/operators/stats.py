"""Enrichment of outcomes in strata: scores, permutation tests, false discovery rates, co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def equal_width(df: DataFrame, col: str, bins: int, name: str | None = None) -> DataFrame:
    """The number (0-based) of the equal-width bin between the column's extremes."""
    lim = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    k = F.least(F.floor((F.col(col) - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1))
    got = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(k).cast("int")
    return df.join(F.broadcast(lim)).withColumn(name or f"{col}_bin", got).drop("__lo", "__hi")


def quantile_bins(df: DataFrame, col: str, bins: int, name: str | None = None) -> DataFrame:
    """The number of quantile cuts that the value exceeds."""
    cuts = [i / bins for i in range(1, bins)]
    q = df.agg(F.percentile(col, F.array(*map(F.lit, cuts))).alias("__q"))
    n = F.size(F.filter("__q", lambda x: F.col(col) > x))
    return df.join(F.broadcast(q)).withColumn(name or f"{col}_bin", n).drop("__q")


def custom_bins(df: DataFrame, col: str, cuts: list[float], name: str | None = None) -> DataFrame:
    """The number of cuts that the value has reached, less one; null below the first."""
    n = reduce(lambda a, c: a + F.when(F.col(col) >= c, 1).otherwise(0), cuts, F.lit(0))
    return df.withColumn(name or f"{col}_bin", F.when(n > 0, n - 1))


def enrichment(df: DataFrame, features: list[str], ok: Column, min_obs: int = 10) -> DataFrame:
    """One row per combination of feature values: obs, hits, acc, the signed chi-square score of its hits, and rank by score."""
    cells = df.groupBy(*features).agg(F.count("*").alias("obs"), F.count_if(ok).alias("hits"))
    total = cells.agg(F.sum("obs").alias("n"), F.sum("hits").alias("h"))
    expected = F.col("obs") * F.col("h") / F.col("n")
    d = F.col("hits") - expected
    scored = cells.join(F.broadcast(total)).withColumns({"acc": F.col("hits") / F.col("obs"), "score": F.try_divide(F.signum(d) * d * d, expected)})
    scored = scored.where(F.col("obs") >= min_obs).drop("n", "h")
    return scored.withColumn("rank", F.row_number().over(Window.orderBy("score", *features)) - 1)


def drawn(scores: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """(k, m, sum): for each permutation and each number of strata the sum of the ranks that it puts first.

    Strata are ordered by a hash of the seed, the permutation's number and their
    rank, which any engine can repeat.
    """
    rows = scores.select("rank", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("k"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"), F.col("rank").cast("string")))
    w = Window.partitionBy("k").orderBy("order", "rank")
    rows = rows.withColumn("order", order).withColumn("m", F.row_number().over(w)).withColumn("sum", F.sum("rank").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("k", F.col("m").cast("long").alias("m"), "sum")


def permutation(scores: DataFrame, features: list[str], n_perm: int = 10_000, tail: str = "left", seed: int = 42, min_groups: int = 1) -> DataFrame:
    """For each value of each feature: mean rank difference to the other strata, quantiles of it under shuffling, and the p-value.

    A permutation's first strata stand for those with the value.  With two tails
    the size of the difference counts.  Values with fewer than ``min_groups``
    strata, or others left, aren't tested: nulls.
    """
    groups = None
    for f in features:
        one = scores.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("m"), F.sum("rank").alias("own")).withColumn("feature", F.lit(f))
        groups = one if groups is None else groups.unionByName(one)
    total = scores.agg(F.count("*").alias("n"), F.sum("rank").alias("all"))
    groups = groups.join(F.broadcast(total)).withColumn("d", F.col("own") * F.col("n") - F.col("all") * F.col("m"))  # one row
    least = max(min_groups, 1)
    groups = stored(groups, "groups")
    tested = groups.where((F.col("m") >= least) & (F.col("n") - F.col("m") >= least))
    # whole numbers decide, so that equal differences are equal
    null = tested.join(drawn(scores, n_perm, seed), "m").withColumn("x", F.col("sum") * F.col("n") - F.col("all") * F.col("m"))
    shown = null.withColumn("y", F.col("x") / (F.col("m") * (F.col("n") - F.col("m"))))
    extreme = {"left": F.col("x") <= F.col("d"), "right": F.col("x") >= F.col("d"), "two": F.abs("x") >= F.abs("d")}[tail]
    q = F.percentile(F.abs("y") if tail == "two" else F.col("y"), F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    got = shown.groupBy("feature", "value").agg((F.count_if(extreme) / n_perm).alias("pval"), q.alias("q"))
    delta = F.try_divide("d", F.col("m") * (F.col("n") - F.col("m")))
    delta = F.abs(delta) if tail == "two" else delta
    out = groups.withColumn("delta", delta).join(got, ["feature", "value"], "left")
    return out.select("feature", "value", "delta", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q99"), "pval")


def benjamini_hochberg(df: DataFrame, p: str = "pval", alpha: float = 0.01, order: list[str] = (), bands: int = 4096) -> DataFrame:
    """Adds adj_pval and reject, by the step-up procedure.

    Rows are ranked and folded within bands of the p-value; a table of one row
    per band carries the ranks before it and the least value after it, so no
    task sorts all rows.  Rows without a p-value
    aren't tests and get none.
    """
    banded = df.withColumn("__band", F.coalesce(F.floor(F.col(p) * bands), F.lit(-1)))
    sizes = banded.groupBy("__band").agg(F.count(p).alias("__n"))
    by_band = Window.orderBy("__band")
    total = F.sum("__n").over(Window.partitionBy())
    before = sizes.select("__band", (F.sum("__n").over(by_band) - F.col("__n")).alias("__past"), total.alias("__all"))
    inner = Window.partitionBy("__band")
    ranked = banded.join(before, "__band").withColumn("__rank", F.col("__past") + F.row_number().over(inner.orderBy(p, *order)))
    raw = ranked.withColumn("__raw", F.col(p) * F.col("__all") / F.col("__rank"))
    raw = stored(raw, "step-up")
    after = Window.orderBy(F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    lows = raw.groupBy("__band").agg(F.min("__raw").alias("__low")).select(F.col("__band").alias("__b"), F.min("__low").over(after).alias("__later"))
    down = inner.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    adj = raw.join(lows, F.col("__band") == F.col("__b")).withColumn("adj_pval", F.least(F.min("__raw").over(down), "__later", F.lit(1.0)))
    adj = adj.withColumn("adj_pval", F.when(F.col(p).isNotNull(), F.col("adj_pval")))
    return adj.drop("__band", "__past", "__all", "__rank", "__raw", "__b", "__later").withColumn("reject", F.col("adj_pval") <= alpha)


def stratp(df: DataFrame, features: list[str], ok: Column, min_obs: int = 10, n_perm: int = 10_000, tail: str = "left", alpha: float = 0.01, seed: int = 42) -> DataFrame:
    """Which feature values go with fewer (or more) hits than chance allows: obs and acc of each, the permutation test over strata, and its correction.

    Strata of fewer than ``min_obs`` rows aren't ranked, and values of fewer than ``min_obs`` strata aren't tested.
    """
    scores = stored(enrichment(df, features, ok, min_obs), "scores")
    tests = permutation(scores, features, n_perm, tail, seed, min_obs)
    seen = None
    for f in features:
        one = df.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("obs"), (F.count_if(ok) / F.count("*")).alias("acc")).withColumn("feature", F.lit(f))
        seen = one if seen is None else seen.unionByName(one)
    rows = tests.join(seen, ["feature", "value"]).select("feature", "value", "obs", "acc", "delta", "q1", "q50", "q99", "pval")
    return benjamini_hochberg(rows, "pval", alpha, ["feature", "value"])


def co_occurrence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and phi of two columns' contingency table; one row."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"))
    # sum over all cells of n^2 / (row * col): empty cells add nothing
    s = cells.join(rows, a).join(cols, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"))
    return s.join(F.broadcast(total)).select((F.col("t") * (F.col("s") - 1)).alias("chi2"), F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0))).alias("phi"), F.col("t").alias("n"))


def describe(df: DataFrame, col: str) -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(col).alias("max"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: how many different values each column has, nulls apart."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols])


def downcast(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest type that holds all their values."""
    sizes = (("tinyint", 7), ("smallint", 15), ("int", 31))
    wide = [c for c, t in df.dtypes if t in ("bigint", "int", "smallint")]
    if not wide:
        return df
    lim = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(wide)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(wide)]).first()

    def fit(i: int, now: str) -> str:
        lo, hi = lim[f"lo{i}"] or 0, lim[f"hi{i}"] or 0
        return next((t for t, bits in sizes if -(1 << bits) <= lo and hi < 1 << bits), now)

    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast(fit(i, kinds[c])) for i, c in enumerate(wide)})


def tandem_features(df: DataFrame) -> DataFrame:
    """Bins that the tandem-repeat preset stratifies by: type, size bin, repeat flag, neighbours up to 4 or more."""
    from ..functions.variants import size_bin

    out = df.withColumn("szbin", size_bin(F.col("svlen")))
    if "num_neighbors" in df.columns:
        out = out.withColumn("neigh", F.least(F.col("num_neighbors"), F.lit(4)))
    return out


#: Upper ends and labels of the bins of an allele's share of reads; fixed values.
VAF_BINS = ((0.05, "SomaticLow(<5%)"), (0.3, "Somatic"), (0.7, "GermlineHet"), (1.0, "GermlineHom"))


def mims_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Strata of calls in mixed samples: type, size bin, repeat, isolation, share of reads; needs NumNeighbors and VAF_alt."""
    vaf = F.col("VAF_alt")
    share = reduce(lambda c, b: c.when(vaf <= b[0], b[1]), VAF_BINS, F.when(vaf.isNull() | (vaf <= 0), None))
    return df.withColumns({"isolated": F.col("NumNeighbors") == 0, "VAF_bin": share}), ["svtype", "szbin", "TRF", "isolated", "VAF_bin"]


def giab_features(df: DataFrame, genotype_of: str = "HG002_GT") -> tuple[DataFrame, list[str]]:
    """Strata of germline calls: type, size bin, repeat, interspersed repeat, genotype; needs RM_clsfam and the sample's alleles."""
    from ..functions.genotypes import genotype

    return df.withColumns({"is_inter": F.col("RM_clsfam").isNotNull(), "GT": genotype(F.col(genotype_of))}), ["svtype", "szbin", "TRF", "is_inter", "GT"]


#: Ready strata by name: functions of a flat table of a result folder that return it with features, and their names.
PRESETS = {"mims": mims_features, "giab1.1": giab_features}
