"""Commands over files: python -m svloom COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import annotations as an
from .operators import bench as bn
from .operators import collapse as co
from .operators import haplotypes as ha
from .operators import intervals, matching, sets, stats
from .params import Params
from .session import session
from .sources import indexed, regions, sinks, vcf
from .storage import release, stored

VERSION = "0.1.0"


def _calls(spark, path: str, sample: str | None = None) -> DataFrame:
    """A file's calls, with the genotypes of one sample in front; several alternatives of a line are an error to split first."""
    head = vcf.header_of(spark, path)
    out = vcf.read_vcf(spark, path, head)
    return out.withColumn("alleles", F.get("gts", F.lit(head.samples.index(sample)))) if sample else out


def _params(a: argparse.Namespace) -> Params:
    return Params.of(a)


def bench(spark, a) -> None:
    base, comp = _calls(spark, a.base, a.bsample), _calls(spark, a.comp, a.csample)
    bed = regions.read_intervals(spark, a.includebed) if a.includebed else None
    reference = stored(regions.read_fasta(spark, a.reference), "reference") if a.reference else None
    heads = vcf.header_of(spark, a.base), vcf.header_of(spark, a.comp)
    a.decompose = not a.no_decompose
    a.dynthresh = tuple(int(x) if x else None for x in (a.dynthresh.split(",") + [""] * 2)[:4]) if a.dynthresh else None
    made = bn.bench(base, comp, _params(a), bed, a.extend, reference)
    _say_left_out(made)
    print(json.dumps(sinks.write_bench(made, a.output, heads), indent=1, default=str))


def _say_left_out(made: bn.Bench) -> None:
    if made.params.short_circuit and made.params.max_chunk is not None:
        n, calls = made.left_out.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n:
            print(f"{n} blocks of more than {made.params.max_chunk} calls are left out, with {calls} calls", file=sys.stderr)


def collapse(spark, a) -> None:
    p = co.DEFAULTS.but(pctseq=a.pctseq, pctsize=a.pctsize, refdist=a.refdist, chunksize=a.refdist, sizemin=a.sizemin, sizemax=a.sizemax, sizefilt=a.sizemin)
    head = vcf.header_of(spark, a.input)
    kept, removed = co.collapse(_calls(spark, a.input), p, a.keep, a.chain or a.chain_depth is not None, a.chain_depth, a.hap, a.gt, not a.no_consolidate, a.fast_cluster)
    if not a.intra and not a.median_info:
        names = {"NumCollapsed": "num_collapsed", "NumConsolidated": "num_consolidated", "CollapseId": "collapse_id"}
        for n in names:
            head = head.with_info(n, "1", "String" if n == "CollapseId" else "Integer", "Of collapsing")
        for rows, name in ((vcf.with_alleles(kept), "kept"), (removed, "removed")):
            have = {n: c for n, c in names.items() if c in rows.columns}
            vcf.write_vcf(vcf.with_figures(rows.withColumnsRenamed({c: n for n, c in have.items()}), list(have)), f"{a.output}/{name}.vcf", head)
    if a.intra:
        kept = co.intra_merge(kept, removed)
        name = head.samples[0] if head.samples else "SAMPLE"
        one = F.struct(F.lit(name).alias("name"), F.coalesce("gt", F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).alias("alleles"), F.lit(False).alias("phased"), F.create_map(F.lit("SUPP"), F.col("supp").cast("string")).alias("fmt"))
        merged = kept.withColumns({"samples": F.array(one), "fmt_keys": F.array(F.lit("GT"), F.lit("SUPP"))})
        single = vcf.Header(head.lines, head.info, head.format, head.contigs, [name]).with_format("SUPP", "1", "Integer", "A bit for each sample that has the call")
        vcf.write_vcf(merged, f"{a.output}/kept.vcf", single)
    if a.median_info:
        kept = co.median_info(kept, removed)
    kept.write.mode("overwrite").parquet(f"{a.output}/kept")
    removed.write.mode("overwrite").parquet(f"{a.output}/removed")


def consistency(spark, a) -> None:
    keys = None
    for k, path in enumerate(a.inputs):
        one = vcf.raw_keys(spark, path, k)
        keys = one if keys is None else keys.unionByName(one)
    found = stored(sets.presence(keys, n_files=len(a.inputs), no_dups=not a.keep_dups), "presence")
    sinks.write_tsv(sets.consistency(found, len(a.inputs)), a.output)
    sets.per_file(found, len(a.inputs)).show()


def stratify(spark, a) -> None:
    states = sinks.read_states(spark, a.input)
    sinks.write_tsv(sets.stratify(states, regions.read_intervals(spark, a.regions).drop("fields")), a.output)


def vcf2df(spark, a) -> None:
    options = dict(info=a.info, fmt=a.format, sample=a.sample, no_prefix=a.no_prefix, alleles=a.alleles)
    if a.bench_dir:
        sinks.read_bench_table(spark, a.input, **options).write.mode("overwrite").parquet(a.output)
        return
    head = vcf.header_of(spark, a.input)
    vcf.flat_table(vcf.read_vcf(spark, a.input, head), head, **options).write.mode("overwrite").parquet(a.output)


def divide(spark, a) -> None:
    sinks.write_shards(sets.shards(_calls(spark, a.input), a.buffer, a.min), a.output)


def index(spark, a) -> None:
    """A file's records as sorted, block-compressed parts with an index."""
    head = vcf.header_of(spark, a.input)
    indexed.write_indexed(vcf.read_vcf(spark, a.input, head), a.output, head)


def fetch(spark, a) -> None:
    """Record lines that overlap a region chrom:start-end, from a folder that ``index`` wrote."""
    r = regions.parse_regions(spark, a.region).first()
    indexed.fetch_lines(spark, a.input, r["chrom"], r["start"], r["end"]).select("value").write.mode("overwrite").text(a.output)


def segment(spark, a) -> None:
    sets.segments(_calls(spark, a.input).where("svtype = 'DEL'")).write.mode("overwrite").parquet(a.output)


def _loci(spark, a) -> DataFrame:
    bed = regions.read_intervals(spark, a.regions) if ":" not in a.regions else regions.parse_regions(spark, a.regions)
    loci = ha.loci(bed.select("chrom", "start", "end"), a.buffer)
    seq = regions.fetch(loci.withColumnRenamed("locus", "id"), regions.read_fasta(spark, a.reference)).withColumnRenamed("id", "locus")
    return loci.join(seq, "locus")


def _by_sample(calls: DataFrame, prefix: str = "") -> DataFrame:
    return calls.select("locus", "start", "ref", "alt", F.inline("samples")).select("locus", "start", "ref", "alt", F.concat(F.lit(prefix), "name").alias("sample"), "alleles")


def phab(spark, a) -> None:
    loci = stored(_loci(spark, a), "loci")
    calls, samples = None, []
    for k, path in enumerate(a.inputs):
        prefix = f"{k}:" if k else ""
        one = _by_sample(ha.eligible(_calls(spark, path), loci, a.maxsize, a.passonly), prefix)
        calls = one if calls is None else calls.unionByName(one)
        samples += [prefix + x for x in vcf.header_of(spark, path).samples]
    made = stored(ha.harmonise(calls, loci, a.align), "harmonised")
    _say_failed(made)
    sinks.write_harmonised(made, a.output, vcf.header_of(spark, a.inputs[0]).contigs, samples)


def _say_failed(made: DataFrame) -> None:
    for r in made.where("error is not null").groupBy("error").agg(F.count_distinct("locus").alias("n")).orderBy(F.desc("n")).limit(20).collect():
        print(f"{r['n']} loci keep their counts, as they could not be harmonised: {r['error']}", file=sys.stderr)


def refine(spark, a) -> None:
    """Harmonises the regions of a comparison that ask for it and compares them anew.

    The calls are those that the comparison counted, or with --use_original_vcfs
    those of the files themselves; with --subset only refined regions are
    reported.
    """
    states = sinks.read_states(spark, a.input)
    names = ("tpbase", "tp", "fn", "fp")
    bed, include = (regions.read_intervals(spark, x) if x else None for x in (a.regions, a.includebed))
    chosen = stored(ha.refine_regions(bed, include, a.coords, a.buffer), "regions")
    counted = sets.stratify(states, chosen).select("region_id", "chrom", "start", "end", *[F.col(n).alias(f"in_{n}") for n in names])
    if a.use_original_vcfs:
        if not (a.base and a.comp):
            raise ValueError("the original files are needed: --base and --comp")
        base, comp = _calls(spark, a.base, a.bsample), _calls(spark, a.comp, a.csample)
        before = ha.needs_original_refinement(counted, base, comp)
        calls = base.withColumn("side", F.lit("base")).unionByName(comp.withColumn("side", F.lit("comp")))
    else:
        before, calls = ha.needs_refinement(counted), states.withColumn("is_filtered", F.lit(False))
    before = stored(before, "before")
    # chosen regions are padded already
    loci = ha.loci(before.where("refined").select("chrom", "start", "end"), 0)
    seq = regions.fetch(loci.withColumnRenamed("locus", "id"), regions.read_fasta(spark, a.reference)).withColumnRenamed("id", "locus")
    loci = stored(loci.join(seq, "locus"), "loci")
    picked = ha.eligible(calls, loci).select("locus", "start", "ref", "alt", F.col("side").alias("sample"), "alleles")
    made = stored(ha.harmonise(picked, loci, a.align), "harmonised")
    _say_failed(made)
    fresh = made.where("error is null")
    end = F.col("start") + F.length("ref")
    rows = fresh.select("chrom", "start", end.alias("end"), (F.col("start") + 1).alias("pos"), "ref", "alt", "alleles", "sample")
    rows = rows.withColumns({"svtype": F.when(F.length("ref") > F.length("alt"), "DEL").otherwise("INS"), "svlen": F.abs(F.length("ref") - F.length("alt")).cast("long")})
    rows = rows.withColumn("id", F.xxhash64("chrom", "start", "ref", "alt")).where("exists(alleles, x -> x = 1)")
    again = bn.bench(rows.where("sample = 'base'").drop("sample"), rows.where("sample = 'comp'").drop("sample"), Params(no_ref="a", short_circuit=True, sizemin=a.sizemin, sizefilt=a.sizemin, max_chunk=a.max_chunk))
    _say_left_out(again)
    done = stored(ha.refined_counts(before, sets.stratify(again.verdicts(), before.select("region_id", "chrom", "start", "end"))), "refined")
    shown = done.where("refined") if a.subset else done
    sinks.write_tsv(shown, f"{a.output}/regions")
    print(json.dumps(sinks.write_json(bn.region_report(shown), f"{a.output}/report"), indent=1, default=str))


def ga4gh(spark, a) -> None:
    rows = ha.truth_and_query(sinks.read_states(spark, a.input))
    heads = [vcf.header_of(spark, f"{a.input}/{n}.vcf") for n in ("tp-base", "tp-comp")]
    sinks.write_truth_and_query(rows, a.output, tuple(heads))


def stratp(spark, a) -> None:
    if (a.features is None) == (a.preset is None):
        raise ValueError("either features or a preset")
    if a.preset:
        rows, features = stats.PRESETS[a.preset](sinks.read_bench_table(spark, a.input, no_prefix=a.preset == "mims"))
        rows, ok = rows.where(F.col("state").isin(*(("tpbase", "fn") if a.states == "base" else ("tp", "fp")))), F.col("state").startswith("tp")
    else:
        rows, features = stats.tandem_features(sinks.read_states(spark, a.input).where(F.col("side") == a.states)), a.features.split(",")
        ok = F.col("verdict").isin("tpbase", "tp")
    sinks.write_tsv(stats.stratp(rows, features, ok, a.min_obs, a.nperm, a.tail, a.alpha, a.seed), a.output)


def _kmers(spark, calls: DataFrame, a) -> DataFrame:
    """Each call's k-mers at both breakpoints, for an aligner; its alignments are then read with --mapped."""
    spans = calls.where(~F.col("alt").rlike(r"^<|[\[\]]") & (F.col("start") >= a.kmer)).select("id", "chrom", (F.col("start") - a.kmer).alias("start"), (F.col("end") + a.kmer).alias("end"))
    windows = regions.fetch(spans, regions.read_fasta(spark, a.extra)).withColumnRenamed("seq", "ref_window")
    got = an.kmers(calls.join(windows, "id"), k=a.kmer)
    return got.select("id", "chrom", "start", "end", F.inline(F.array(*[F.struct(F.lit(n).alias("kmer"), F.col(n).alias("seq")) for n in ("ref_up", "ref_dn", "alt_up", "alt_dn")])))


def anno(spark, a) -> None:
    calls = _calls(spark, a.input)
    extra = regions.read_intervals(spark, a.extra, id_format="a").withColumnRenamed("region_id", "anno_id") if a.extra and a.kind == "bpovl" else None
    made = {
        "addid": lambda: an.add_id(calls),
        "bpovl": lambda: an.breakpoint_overlap(calls, extra),
        "chunks": lambda: an.chunk_subcounts(matching.with_chunks(calls.withColumn("side", F.lit("base")), Params()), Params()),
        "density": lambda: an.density(calls, intervals.tiles(vcf.header_of(spark, a.input).contig_table(spark), a.window).select("chrom", "start", "end")),
        "gcpct": lambda: an.gc_content(calls.withColumn("seq", F.when(F.length("alt") > F.length("ref"), F.col("alt")).otherwise(F.col("ref")))),
        "gtcnt": lambda: an.genotype_counts(calls),
        "dpcnt": lambda: an.depth_counts(calls.withColumn("depths", F.transform("samples", lambda x: x["fmt"].getItem("DP").try_cast("int"))), alt_depth=None),
        "grpaf": lambda: an.group_frequencies(calls.select("id", F.inline("samples")).select("id", F.col("name").alias("sample"), "alleles"), regions.read_labels(spark, a.extra)) if a.extra else an.allele_frequencies(calls),
        "remap": lambda: an.remapped(spark.read.parquet(a.extra), calls),
        "repmask": lambda: an.repeat_hits(regions.read_masker_output(spark, a.extra).withColumn("seq_len", F.col("span"))),
        "hompct": lambda: an.hom_percent(calls, calls),
        "grm": lambda: an.mapping_stats(spark.read.parquet(a.mapped)) if a.mapped else _kmers(spark, calls, a),
        "lcr": lambda: an.low_complexity(calls.withColumn("seq", F.when(F.length("alt") > F.length("ref"), F.col("alt")).otherwise(F.col("ref")))),
        "numneigh": lambda: an.neighbors(calls),
        "svinfo": lambda: an.sv_info(calls),
        "trfstack": lambda: an.repeat_stack(calls, regions.read_repeats(spark, a.extra).select("chrom", "r_start", "r_end", "motif", "period", "copies", "score", "entropy")),
        "trf": lambda: an.repeat_annotation(calls, regions.read_repeats(spark, a.extra)),
    }
    made[a.kind]().write.mode("overwrite").parquet(a.output)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("svloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(fn, *args):
        p = sub.add_parser(fn.__name__)
        p.set_defaults(run=fn)
        for names, kw in args:
            p.add_argument(*names, **kw)
        return p

    def opt(name, default, **kw):
        return ((name,), {"default": default, "type": type(default) if default is not None else str} | kw)

    def flag(name):
        return ((name,), {"action": "store_true"})

    def req(*names, **kw):
        return (names, kw)

    d = Params()
    out = req("-o", "--output", required=True)
    add(bench, req("-b", "--base", required=True), req("-c", "--comp", required=True), out, opt("--includebed", None), opt("--extend", 0), opt("--bsample", None), opt("--csample", None), opt("--dynthresh", None), (("-f", "--reference"), {"default": None}),
        *[opt(f"--{n}", getattr(d, n)) for n in ("refdist", "pctseq", "pctsize", "pctovl", "chunksize", "bnddist", "sizemin", "sizemax", "max_resolve", "pick")],
        opt("--sizefilt", None, type=int), opt("--max_chunk", None, type=int), opt("--no_ref", None), *[flag(f"--{n}") for n in ("typeignore", "no_roll", "passonly", "dup_to_ins", "short_circuit", "write_resolved", "no_decompose")])
    add(collapse, req("-i", "--input", required=True), out, opt("--keep", "first"), opt("--gt", "off"), opt("--refdist", 500), opt("--pctseq", 0.95), opt("--pctsize", 0.95), opt("--sizemin", 50),
        opt("--sizemax", 50_000), opt("--chain_depth", None, type=int), *[flag(f"--{n}") for n in ("chain", "hap", "no_consolidate", "intra", "median_info", "fast_cluster")])
    add(consistency, req("inputs", nargs="+"), out, flag("--keep_dups"))
    add(stratify, req("regions"), req("input"), out)
    add(vcf2df, req("input"), out, flag("--info"), flag("--format"), req("--sample", nargs="*"), flag("--no_prefix"), flag("--alleles"), flag("--bench_dir"))
    add(divide, req("input"), out, opt("--buffer", 1000), opt("--min", 50_000))
    add(segment, req("input"), out)
    add(index, req("input"), out)
    add(fetch, req("input"), req("region"), out)
    place = (req("-r", "--regions", required=True), req("-f", "--reference", required=True), out, opt("--buffer", 100), opt("--align", "affine", choices=[*ha.ALIGNERS, *ha.JOINT_ALIGNERS]))
    add(phab, req("inputs", nargs="+"), *place, opt("--maxsize", 50_000), flag("--passonly"))
    add(refine, req("input"), *place, opt("--sizemin", 5), opt("--max_chunk", None, type=int), opt("--includebed", None), opt("--coords", "R", choices=["R", "O"]),
        opt("--base", None), opt("--comp", None), opt("--bsample", None), opt("--csample", None), flag("--use_original_vcfs"), flag("--subset"))
    add(ga4gh, req("-i", "--input", required=True), out)
    add(stratp, req("input"), opt("--features", None), opt("--preset", None, choices=list(stats.PRESETS)), out, opt("--states", "base"), opt("--min_obs", 10), opt("--nperm", 10_000), opt("--tail", "left"), opt("--alpha", 0.01), opt("--seed", 42))
    add(anno, req("kind"), req("input"), out, opt("--extra", None), opt("--window", 10_000), opt("--kmer", 50), opt("--mapped", None))
    sub.add_parser("version").set_defaults(run=None)
    return top


def likely(asked: str, known: list[str], least: float = 0.8) -> str | None:
    """The known command most like the one asked for, by edit distance over summed lengths; None if none is like enough."""

    def alike(b: str) -> float:
        row = list(range(len(b) + 1))
        for i, x in enumerate(asked, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / (len(asked) + len(b))

    found = [(alike(b), b) for b in known]
    return max((x for x in found if x[0] >= least), default=(0.0, None))[1]


def main(argv: list[str] | None = None) -> int:
    argv, parser = sys.argv[1:] if argv is None else argv, _parser()
    known = list(next(x.choices for x in parser._subparsers._group_actions))
    if argv and not argv[0].startswith("-") and argv[0] not in known and (best := likely(argv[0], known)):
        print(f"no command {argv[0]}; is {best} meant?", file=sys.stderr)
    a = parser.parse_args(argv)
    if a.run is None:
        print(VERSION)
        return 0
    spark = session()
    a.run(spark, a)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
