"""Expressions over genotypes: arrays of allele numbers, null where an allele is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def genotype(alleles: Column) -> Column:
    """REF, HET, HOM, NON (an allele is missing) or UNK (not two alleles)."""
    a, b = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    return (
        F.when(alleles.isNull(), "UNK")
        .when(F.exists(alleles, lambda x: x.isNull()), "NON")
        .when(F.size(alleles) != 2, "UNK")
        .when((a == 0) & (b == 0), "REF")
        .when(a != b, "HET")
        .otherwise("HOM")
    )


def alt_count(alleles: Column) -> Column:
    """How often allele 1 occurs."""
    return F.coalesce(F.size(F.filter(alleles, lambda x: F.coalesce(x == 1, F.lit(False)))), F.lit(0))


def is_present(alleles: Column, strict: bool = False) -> Column:
    return genotype(alleles).isin("HET", "HOM") if strict else alt_count(alleles) > 0


def count_genotypes(gts: Column) -> Column:
    """Counts of UNK or NON, REF, HET and HOM among the samples, in this order."""
    names = F.transform(gts, genotype)

    def n(*kinds: str) -> Column:
        return F.size(F.filter(names, lambda g: g.isin(*kinds)))

    return F.array(n("UNK", "NON"), n("REF"), n("HET"), n("HOM"))


def frequencies(gts: Column) -> Column:
    """Allele statistics over an array of genotypes; those of more than two alleles are left out, alleles over 1 too."""
    able = F.filter(gts, lambda g: F.size(g) <= 2)
    flat = F.filter(F.flatten(able), lambda x: x.isNotNull())
    called = F.filter(flat, lambda x: x <= 1)
    n_alt = F.aggregate(called, F.lit(0), lambda acc, x: acc + x.cast("int"))
    an, ac0 = F.size(called), F.size(called) - n_alt

    def two(g: Column) -> tuple[Column, Column, Column]:
        return F.size(g) == 2, F.get(g, F.lit(0)), F.get(g, F.lit(1))

    def count(test) -> Column:
        return F.size(F.filter(able, lambda g: F.coalesce(test(*two(g)), F.lit(False))))

    mac = F.least(ac0, n_alt)
    return F.struct(
        F.when(an > 0, n_alt / an).otherwise(0.0).alias("AF"),
        F.when(an > 0, mac / an).otherwise(0.0).alias("MAF"),
        F.array(ac0, n_alt).alias("AC"),
        F.when(an > 0, mac).otherwise(0).alias("MAC"),
        an.alias("AN"),
        count(lambda pair, a, b: F.when(pair, a.isNull() != b.isNull()).otherwise(a.isNotNull())).alias("N_HEMI"),
        count(lambda pair, a, b: pair & (a == 0) & (b == 0)).alias("N_HOMREF"),
        count(lambda pair, a, b: pair & (a != b)).alias("N_HET"),
        count(lambda pair, a, b: pair & (a == b) & (a != 0)).alias("N_HOMALT"),
        count(lambda pair, a, b: F.when(pair, a.isNull() & b.isNull()).otherwise(a.isNull())).alias("N_MISS"),
    )


def sample_frequencies(alleles: Column) -> Column:
    """``frequencies`` as an aggregate over one genotype a row, without arrays of them."""
    pair, a, b = F.size(alleles) == 2, F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    able = alleles.isNotNull() & (F.size(alleles) <= 2)

    def each(x: Column) -> Column:
        return F.coalesce((x <= 1).cast("int"), F.lit(0))

    def alt(x: Column) -> Column:
        return F.coalesce(F.when(x <= 1, x.cast("int")), F.lit(0))

    def count(test: Column) -> Column:
        return F.count_if(able & test).cast("int")

    an = F.coalesce(F.sum(F.when(able, each(a) + each(b))), F.lit(0)).cast("int")
    n_alt = F.coalesce(F.sum(F.when(able, alt(a) + alt(b))), F.lit(0)).cast("int")
    mac = F.least(an - n_alt, n_alt)
    return F.struct(
        F.when(an > 0, n_alt / an).otherwise(0.0).alias("AF"),
        F.when(an > 0, mac / an).otherwise(0.0).alias("MAF"),
        F.array(an - n_alt, n_alt).alias("AC"),
        F.when(an > 0, mac).otherwise(0).alias("MAC"),
        an.alias("AN"),
        count(F.when(pair, a.isNull() != b.isNull()).otherwise(a.isNotNull())).alias("N_HEMI"),
        count(pair & (a == 0) & (b == 0)).alias("N_HOMREF"),
        count(pair & (a != b)).alias("N_HET"),
        count(pair & (a == b) & (a != 0)).alias("N_HOMALT"),
        count(F.when(pair, a.isNull() & b.isNull()).otherwise(a.isNull())).alias("N_MISS"),
    )


def _let(x: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def hardy_weinberg(n_ref: Column, n_alt: Column, n_het: Column) -> Column:
    """Exact test: struct of ExcHet and HWE, by the recurrence over heterozygote counts of like parity.

    Log weights are summed by a fold that starts at the smallest possible
    count, so it needs no midpoint; probabilities are scaled by the largest.
    """
    rare = F.least(n_ref, n_alt).cast("int")
    total = ((n_ref + n_alt) / 2).cast("int")
    low = rare % 2
    steps = F.sequence(low, F.greatest(rare, low), F.lit(2))

    def weight(k: Column) -> Column:
        # log of 2^k n! / (hom_r! k! hom_c!) up to a constant
        hom_r, hom_c = (rare - k) / 2, total - k - (rare - k) / 2

        def lf(x: Column) -> Column:  # log factorial
            return F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))

        return k * F.log(F.lit(2.0)) - lf(hom_r) - lf(k) - lf(hom_c)

    logs = F.transform(steps, lambda k: F.struct(k.alias("k"), weight(k).alias("w")))

    def summed(probs: Column, asked) -> Column:
        return F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + F.when(asked(x), x["p"]).otherwise(0.0))

    def scaled(logs: Column, most: Column) -> Column:
        return F.transform(logs, lambda x: F.struct(x["k"].alias("k"), F.exp(x["w"] - most).alias("p")))

    def tests(probs: Column, whole: Column, own: Column) -> Column:
        above = summed(probs, lambda x: x["p"] > own * (1 + 1e-12))
        return F.struct((summed(probs, lambda x: x["k"] >= n_het) / whole).alias("ExcHet"), (1 - F.least(above / whole, F.lit(1.0))).alias("HWE"))

    def of(probs: Column) -> Column:
        whole, own = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x["p"]), summed(probs, lambda x: x["k"] == n_het)
        return _let(F.struct(whole.alias("whole"), own.alias("own")), lambda s: tests(probs, s["whole"], s["own"]))

    probs = _let(logs, lambda xs: _let(F.array_max(F.transform(xs, lambda x: x["w"])), lambda most: scaled(xs, most)))
    none = F.struct(F.lit(0.0).alias("ExcHet"), F.lit(0.0).alias("HWE"))
    return F.when((n_ref + n_alt) > 0, _let(probs, of)).otherwise(none)


def binned(values: Column, bins: list[int]) -> Column:
    """Counts of values by bin: the k-th of those in [bins[k], bins[k+1]), the last open; smaller and missing ones are left out."""
    out = []
    for k, lo in enumerate(bins):
        hi = bins[k + 1] if k + 1 < len(bins) else None
        out.append(F.size(F.filter(values, lambda x: F.coalesce((x >= lo) & (x < hi if hi is not None else F.lit(True)), F.lit(False)))))
    return F.array(*out)
