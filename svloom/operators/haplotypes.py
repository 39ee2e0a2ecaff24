"""Harmonising of calls: haplotypes of a locus, alignment to the reference, variants of the alignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable
from . import intervals
from .partial_order import multiple_alignment, without_shared_gaps


def haplotype(reference: str, start: int, calls: list[tuple[int, str, str]]) -> str:
    """The reference from ``start`` on with calls (start, ref, alt) applied left to right; overlapping later ones are skipped."""
    out, at = [], 0
    for pos, ref, alt in sorted(calls):
        lo = pos - start
        if alt == "*" or lo < at or lo + len(ref) > len(reference):
            continue
        out += [reference[at:lo], alt]
        at = lo + len(ref)
    return "".join([*out, reference[at:]])


def align(query: str, reference: str, match: int = 2, mismatch: int = -4, gap_open: int = -6, gap: int = -1) -> tuple[str, str]:
    """Global alignment with affine gaps: both sequences with gaps as dashes.

    Common ends are set aside, which keeps the best score.  Rows of the rest
    are vectors: gaps along the row come from a running maximum, so the work is
    one pass of numpy operations per query base.  Only every so many rows are
    kept; the steps of the rows between are worked out again on the way back,
    so memory grows with the reference's length times the root of the query's.
    """
    head = next((i for i, (x, y) in enumerate(zip(query, reference, strict=False)) if x != y), min(len(query), len(reference)))
    most = min(len(query), len(reference)) - head
    tail = next((i for i in range(most) if query[-1 - i] != reference[-1 - i]), most)
    q, r = query[head : len(query) - tail], reference[head : len(reference) - tail]
    a, b = _aligned(q, r, match, mismatch, gap_open, gap) if q and r else (q + "-" * len(r), "-" * len(q) + r)
    end = query[len(query) - tail :]
    return query[:head] + a + end, reference[:head] + b + end


def _aligned(query: str, reference: str, match: int, mismatch: int, gap_open: int, gap: int) -> tuple[str, str]:
    n, m = len(query), len(reference)
    q, r = np.frombuffer(query.encode(), np.uint8), np.frombuffer(reference.encode(), np.uint8)
    low = -(10**8)
    j = np.arange(m + 1)

    def row(i: int, h: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of row i from those before it, and its steps: 1 diagonal, 2 down, 3 along; +4 down extends; +8 along extends."""
        opened, extended = h + gap_open + gap, down + gap
        down = np.maximum(opened, extended)
        diag = np.full(m + 1, low, np.int64)
        diag[1:] = h[:-1] + np.where(q[i - 1] == r, match, mismatch)
        best = np.maximum(diag, down)
        # along[j] = max over k < j of best[k] + open + gap * (j - k)
        run = np.maximum.accumulate(best - gap * j)
        along = np.full(m + 1, low, np.int64)
        along[1:] = run[:-1] + gap_open + gap * j[1:]
        new = np.maximum(best, along)
        code = np.where(new == diag, 1, np.where(new == down, 2, 3)).astype(np.uint8)
        code += 4 * (extended > opened).astype(np.uint8)
        code[1:] += 8 * (along[1:] != best[:-1] + gap_open + gap).astype(np.uint8)
        return new, down, code

    every = max(1, int(n**0.5))
    h, down = np.where(j == 0, 0, gap_open + gap * j).astype(np.int64), np.full(m + 1, low, np.int64)
    kept = []
    for i in range(1, n + 1):
        if (i - 1) % every == 0:
            kept.append((h.astype(np.int32), down.astype(np.int32)))
        h, down, _ = row(i, h, down)
    a, b = [], []
    i, k, state, codes, first = n, m, 0, [], n + 1
    while i or k:
        if i and i < first:
            block = (i - 1) // every
            first = block * every + 1
            h, down = (x.astype(np.int64) for x in kept[block])
            codes = []
            for x in range(first, i + 1):
                h, down, code = row(x, h, down)
                codes.append(code)
        code = int(codes[i - first][k]) if i else 3 + 8
        way = 3 if i == 0 else 2 if k == 0 else state or (code & 3)
        if way == 1:
            i, k, state = i - 1, k - 1, 0
            a.append(query[i])
            b.append(reference[k])
        elif way == 2:
            i, state = i - 1, 2 if code & 4 else 0
            a.append(query[i])
            b.append("-")
        else:
            k, state = k - 1, 3 if code & 8 else 0
            a.append("-")
            b.append(reference[k])
    return "".join(reversed(a)), "".join(reversed(b))


#: Aligners by name: functions of (query, reference) that return both with gaps.
ALIGNERS: dict[str, Callable[[str, str], tuple[str, str]]] = {"affine": align}
#: Aligners of all sequences of a locus at once: functions of a list that return its rows.
JOINT_ALIGNERS: dict[str, Callable[[list[str]], list[str]]] = {"poa": multiple_alignment}


def aligned_to(reference: str, haplotypes: list[str], aligner: str) -> dict[str, tuple[str, str]]:
    """Each haplotype beside the reference, both with gaps."""
    if aligner not in JOINT_ALIGNERS:
        return {h: ALIGNERS[aligner](h, reference) for h in haplotypes}
    first, *rows = JOINT_ALIGNERS[aligner]([reference, *haplotypes])
    return {h: without_shared_gaps(row, first) for h, row in zip(haplotypes, rows, strict=True)}


def alignment_variants(query: str, reference: str, start: int, anchor: str = "N") -> list[tuple[int, str, str]]:
    """(start, ref, alt) of what differs in an alignment: substitutions alone, gaps with the base before them.

    A stretch that replaces bases by others of another number becomes a
    deletion and an insertion.
    """
    out = []
    pos, before, i = start, anchor, 0
    n = len(reference)
    while i < n:
        a, b = query[i], reference[i]
        if a == b:
            pos, before, i = pos + 1, b, i + 1
            continue
        lost, won, k = [], [], i
        while k < n and query[k] != reference[k]:
            if reference[k] != "-":
                lost.append(reference[k])
            if query[k] != "-":
                won.append(query[k])
            k += 1
        if len(lost) == len(won):
            out += [(pos + x, u, v) for x, (u, v) in enumerate(zip(lost, won, strict=True)) if u != v]
        else:
            if lost:
                out.append((pos - 1, before + "".join(lost), before))
            if won:
                out.append((pos - 1, before, before + "".join(won)))
        pos += len(lost)
        before = lost[-1] if lost else before
        i = k
    return out


def loci(regions: DataFrame, pad: int = 100) -> DataFrame:
    """Padded, merged regions with a locus number."""
    return intervals.extend(regions, pad).withColumn("locus", F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def eligible(calls: DataFrame, loci_: DataFrame, maxsize: int = 50_000, passonly: bool = False) -> DataFrame:
    """Calls that lie within a locus, with its name; resolved, passing if asked for, not too large."""
    ok = calls.where(~F.col("alt").rlike(r"^<|[\[\]]") & (F.col("svlen") <= maxsize))
    if passonly:
        ok = ok.where(~F.col("is_filtered"))
    l = loci_.select("chrom", F.col("start").alias("l_start"), F.col("end").alias("l_end"), "locus")  # noqa: E741
    hit = intervals.range_join(ok.withColumn("__stop", F.greatest(F.col("end"), F.col("start") + 1)), l, ["chrom"], ("start", "__stop"), ("l_start", "l_end"))
    return hit.where((F.col("start") >= F.col("l_start")) & (F.col("end") <= F.col("l_end"))).drop("__stop")


def harmonise(calls: DataFrame, loci_: DataFrame, aligner: str = "affine") -> DataFrame:
    """Variants of every sample's two haplotypes after alignment to the locus' reference.

    calls: locus, start, ref, alt, sample, alleles; loci_: locus, chrom, start,
    seq (the locus' reference).  Returns locus, chrom, start, ref, alt, sample,
    alleles; a locus that fails gives one row with its error instead.  Equal
    haplotypes of a locus are aligned once.  aligner: "affine", each haplotype
    with the reference, or "poa", all of a locus together.
    """
    reachable(calls.sparkSession)
    rows = calls.groupBy("locus").agg(F.collect_list(F.struct("start", "ref", "alt", "sample", "alleles")).alias("calls"))
    table = loci_.select("locus", "chrom", F.col("start").alias("l_start"), "seq").join(rows, "locus")

    def run(frames):
        for frame in frames:
            out = []
            for locus, chrom, l_start, seq, members in zip(frame["locus"], frame["chrom"], frame["l_start"], frame["seq"], frame["calls"], strict=True):
                try:
                    haps: dict[tuple[str, int], list] = {}
                    for c in members:
                        for copy in (0, 1):
                            own = haps.setdefault((c["sample"], copy), [])
                            if len(c["alleles"]) > copy and c["alleles"][copy] == 1:
                                own.append((int(c["start"]), c["ref"], c["alt"]))
                    found: dict[tuple, dict[str, list[int]]] = {}
                    built = {key: haplotype(seq, int(l_start), own) for key, own in sorted(haps.items())}
                    rows = aligned_to(seq, sorted(set(built.values()) - {seq}), aligner)
                    seen = {h: alignment_variants(*pair, int(l_start), seq[:1] or "N") for h, pair in rows.items()}
                    for (sample, copy), h in built.items():
                        for var in seen.get(h, []):
                            found.setdefault(var, {}).setdefault(sample, [0, 0])[copy] = 1
                    samples = sorted({s for s, _ in haps})
                    for (start, ref, alt), have in sorted(found.items()):
                        out += [(locus, chrom, start, ref, alt, s, have.get(s, [0, 0]), None) for s in samples]
                except Exception as e:  # a locus that can't be aligned is reported, the others go on
                    out.append((locus, chrom, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["locus", "chrom", "start", "ref", "alt", "sample", "alleles", "error"])

    return table.mapInPandas(run, "locus string, chrom string, start long, ref string, alt string, sample string, alleles array<int>, error string")


def needs_refinement(counts: DataFrame, c: str = "in_") -> DataFrame:
    """Regions in which a missed and a spurious call, or one of them and a counterpart, meet."""
    tb, tp, fn, fp = (F.col(c + x) for x in ("tpbase", "tp", "fn", "fp"))
    ask = ((fn > 0) & (fp > 0)) | ((fn > 0) & (tp + fp > 0)) | ((fp > 0) & (tb + fn > 0))
    return counts.withColumn("refined", ask)


def needs_original_refinement(counts: DataFrame, base: DataFrame, comp: DataFrame, c: str = "in_") -> DataFrame:
    """Regions (with region_id, chrom, start and end) with a missed or a spurious call in which both original call sets have calls."""
    ends = F.col("svtype") != "INS"
    own = counts
    for name, calls in (("__base", base), ("__comp", comp)):
        n = intervals.count_within(calls, counts.select("region_id", "chrom", "start", "end"), ["chrom"], ends, name).select("region_id", name)
        own = own.join(n, "region_id")
    ask = ((F.col(c + "fn") > 0) | (F.col(c + "fp") > 0)) & (F.col("__base") > 0) & (F.col("__comp") > 0)
    return own.withColumn("refined", ask).drop("__base", "__comp")


def refine_regions(regions: DataFrame | None, include: DataFrame | None, coords: str = "R", pad: int = 100) -> DataFrame:
    """The regions that a refinement looks at, padded and merged, with a region_id.

    Of regions and the comparison's own regions those of either that touch one
    of the other stay: the former with ``coords`` R, the latter with O.
    """
    if regions is None and include is None:
        raise ValueError("regions are needed where the comparison had none")
    if regions is not None and include is not None:
        a, b = (regions, include) if coords == "R" else (include, regions)
        chosen = intervals.touching_regions(a.select("chrom", "start", "end"), b)
    else:
        chosen = regions if regions is not None else include
    wide = intervals.extend(chosen, pad).select("chrom", "start", "end")
    return wide.withColumn("region_id", F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def refined_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of refined regions from ``after`` (region_id, tpbase, tp, fn, fp), of the others as they were."""
    names = ("tpbase", "tp", "fn", "fp")
    new = after.select("region_id", *[F.col(n).alias(f"__{n}") for n in names])
    j = before.join(new, "region_id", "left")
    return j.withColumns({f"out_{n}": F.when(F.col("refined"), F.coalesce(f"__{n}", F.lit(0))).otherwise(F.col(f"in_{n}")) for n in names}).drop(*[f"__{n}" for n in names])


def truth_and_query(states: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Calls as truth and query sets with BD (TP, FN, FP) and BK (gm genotypes agree, am alleles agree, lm only near, or a dot)."""
    bd = F.when(F.col("verdict").isin("tpbase", "tp"), "TP").when(F.col("verdict") == "fn", "FN").otherwise("FP")
    bk = F.when(bd == "TP", F.when(F.col("gt_match") == 0, "gm").otherwise("am")).when(F.col("met") if "met" in states.columns else F.col("score").isNotNull(), "lm").otherwise(".")
    out = states.withColumns({"BD": bd, "BK": bk, "set": F.when(F.col("side") == "base", "truth").otherwise("query"), "is_refined": F.lit(False)})
    if refined is None:
        return out
    extra = refined.withColumns({"BD": bd, "BK": bk, "set": F.when(F.col("side") == "base", "truth").otherwise("query"), "is_refined": F.lit(True)})
    return out.unionByName(extra, allowMissingColumns=True)
