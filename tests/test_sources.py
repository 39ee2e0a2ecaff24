"""Files in and out."""

import random

import pytest
from pyspark.sql import functions as F

from svloom.operators import bench as bn
from svloom.params import Params
from svloom.sources import regions, sinks, vcf

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="t">
##INFO=<ID=SVLEN,Number=A,Type=Integer,Description="l">
##INFO=<ID=PRECISE,Number=0,Type=Flag,Description="p">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t101\tv1\tA\t<DEL>\t9.5\tPASS\tSVTYPE=DEL;SVLEN=-60;END=161;PRECISE\tGT:AD\t0/1:3,4\t.|1:.
chr1\t300\t.\tACGT\tA\t.\t.\t.\tGT\t1|1\t0/0
chr1\t400\tb\tN\tN[chr2:77[\t.\tLOW\tSVTYPE=BND;CIPOS=-5,9\tGT\t0/1\t0/0
"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text(VCF)
    return str(p)


def test_read_vcf(spark, path):
    head = vcf.header_of(spark, path)
    assert head.samples == ["S1", "S2"] and head.contigs == {"chr1": 1000} and head.info["SVLEN"] == ("A", "Integer")
    rows = vcf.read_vcf(spark, path, head).orderBy("pos").collect()
    a, b, c = rows
    assert (a.start, a.end, a.svtype, a.svlen, a.qual) == (100, 161, "DEL", 60, 9.5)
    assert a.gts == [[0, 1], [None, 1]] and a.samples[1].phased and not a.is_filtered
    assert (b.svtype, b.svlen, b.end, b.vid, b.filters) == ("DEL", 3, 303, None, [])
    assert (c.svtype, c.chrom2, c.pos2, c.direction, c.ci) == ("BND", "chr2", 77, "left", [-5, 9]) and c.is_filtered


def test_flat_table(spark, path):
    head = vcf.header_of(spark, path)
    f = vcf.flat_table(vcf.read_vcf(spark, path, head), head).orderBy("start").first()
    assert (f.INFO_SVTYPE, f.INFO_SVLEN, f.PRECISE, f.S1_AD_ref, f.S1_AD_alt, f.S2_AD_ref, f.szbin) == ("DEL", [-60], True, 3, 4, None, "[50,100)")
    assert len(f.hash) == 40


def test_write_and_read_again(spark, path, tmp_path):
    head = vcf.header_of(spark, path)
    rows = vcf.read_vcf(spark, path, head)
    vcf.write_vcf(rows, str(tmp_path / "out"), head)
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    keep = ["chrom", "pos", "vid", "ref", "alts", "qual", "filters", "svtype", "svlen", "gts"]
    assert sorted(map(str, rows.select(*keep).collect())) == sorted(map(str, again.select(*keep).collect()))
    assert {r.key for r in vcf.raw_keys(spark, path, 0).collect()} == {"\t".join(x.split("\t")[:5]) for x in VCF.splitlines() if x[0] != "#"}


def test_intervals_and_sequence(spark, tmp_path):
    bed = tmp_path / "r.bed"
    bed.write_text("# c\nchr1\t10\t20\tx\nchr1\t15\t40\ty\n")
    got = regions.read_intervals(spark, str(bed)).orderBy("start").collect()
    assert [(r.chrom, r.start, r.end) for r in got] == [("chr1", 10, 20), ("chr1", 15, 40)]
    gff = tmp_path / "r.gff"
    gff.write_text("chr1\ts\tgene\t11\t20\t.\n")
    assert tuple(regions.preset(spark, str(gff), "gff").select("chrom", "start", "end").first()) == ("chr1", 10, 20)
    fa = tmp_path / "r.fa"
    seq = "ACGTTGCA" * 20
    fa.write_text(">chr1 text\n" + "\n".join(seq[i : i + 30] for i in range(0, len(seq), 30)) + "\n>chr2\nAAAA\n")
    tiles = regions.read_fasta(spark, str(fa), 50)
    spans = spark.createDataFrame([(1, "chr1", 3, 140), (2, "chr2", 1, 3)], "id long, chrom string, start long, end long")
    assert {r.id: r.seq for r in regions.fetch(spans, tiles, 50).collect()} == {1: seq[3:140], 2: "AA"}
    assert [tuple(r) for r in regions.parse_regions(spark, "chr1:5-9, chr2:1-2").collect()] == [("chr1", 5, 9), ("chr2", 1, 2)]


def test_result_folder(spark, path, tmp_path):
    rows = vcf.read_vcf(spark, path).where("svtype = 'DEL'").drop("ci", "chrom2", "pos2", "direction", "strand", "samples", "info", "fmt_keys", "filters", "alts")
    b = bn.bench(rows, rows, Params(pctseq=0, sizemin=50))
    s = sinks.write_bench(b, str(tmp_path / "res"))
    assert s["tp_base"] == 1 and s["precision"] == 1.0
    assert sinks.read_states(spark, str(tmp_path / "res")).where(F.col("verdict") == "tp").count() == 1


def test_commands(spark, path, tmp_path, capsys):
    from svloom.__main__ import main

    assert main(["version"]) == 0
    assert main(["vcf2df", path, "-o", str(tmp_path / "flat"), "--info"]) == 0
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 3
    assert main(["bench", "-b", path, "-c", path, "-o", str(tmp_path / "b"), "--pctseq", "0"]) == 0
    states = sinks.read_states(spark, str(tmp_path / "b"))
    assert {(r.svtype, r.verdict) for r in states.select("svtype", "verdict").collect()} == {("DEL", "tpbase"), ("DEL", "tp"), ("BND", "tpbase"), ("BND", "tp")}
    bed = tmp_path / "s.bed"
    bed.write_text("chr1\t0\t900\n")
    assert main(["stratify", str(bed), str(tmp_path / "b"), "-o", str(tmp_path / "s")]) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s")).first().tpbase == "2"
    assert main(["anno", "numneigh", path, "-o", str(tmp_path / "n")]) == 0
    assert main(["consistency", path, path, "-o", str(tmp_path / "c")]) == 0
    for name, n in (("tp-base", 2), ("tp-comp", 2), ("fn", 0), ("fp", 0)):
        out = str(tmp_path / "b" / f"{name}.vcf")
        head = vcf.header_of(spark, out)
        again = vcf.read_vcf(spark, out, head)
        assert again.count() == n and "TruScore" in head.info and len(head.samples) == len(vcf.header_of(spark, path).samples)
        if n:
            assert all("MatchId" in r.info and "Multi" not in r.info for r in again.select("info").collect())
    assert sinks.concatenated(spark, str(tmp_path / "b"), ["tpbase", "tp"]).count() == 4
    assert sinks.read_params(spark, str(tmp_path / "b")).pctseq == 0
    assert main(["collapse", "-i", path, "-o", str(tmp_path / "k")]) == 0
    kept = vcf.read_vcf(spark, str(tmp_path / "k" / "kept.vcf"))
    assert kept.count() + spark.read.parquet(str(tmp_path / "k" / "removed")).count() == 3
    assert main(["collapse", "-i", path, "-o", str(tmp_path / "m"), "--intra"]) == 0
    head = vcf.header_of(spark, str(tmp_path / "m" / "kept.vcf"))
    merged = {r.pos: (r.gts, r.samples[0].fmt["SUPP"]) for r in vcf.read_vcf(spark, str(tmp_path / "m" / "kept.vcf"), head).collect()}
    assert head.samples == ["S1"] and merged[300] == ([[1, 1]], "1") and merged[101] == ([[0, 1]], "3")
    with pytest.raises(SystemExit):
        main(["colapse"])
    assert "is collapse meant?" in capsys.readouterr().err
    labels = tmp_path / "groups.tsv"
    labels.write_text("".join(f"{x}\tg\n" for x in vcf.header_of(spark, path).samples))
    assert main(["anno", "grpaf", path, "-o", str(tmp_path / "g"), "--extra", str(labels)]) == 0
    assert {r.group for r in spark.read.parquet(str(tmp_path / "g")).collect()} == {"g"}


def test_written_records_are_in_order(spark, tmp_path):
    lines = ["##contig=<ID=chr2,length=99>", "##contig=<ID=chr10,length=99>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])]
    rows = [(c, p) for c in ("chr10", "chr2", "zz") for p in (30, 4, 200)]
    src = tmp_path / "x.vcf"
    src.write_text("\n".join([*lines, *[f"{c}\t{p}\t.\tA\tAT\t.\tPASS\tSVLEN=1" for c, p in rows]]) + "\n")
    head = vcf.header_of(spark, str(src))
    vcf.write_vcf(vcf.read_vcf(spark, str(src), head), str(tmp_path / "y"), head)
    parts = sorted(x for x in (tmp_path / "y").iterdir() if x.name.startswith("part"))
    got = "".join(x.read_text() for x in parts).splitlines()
    assert got[:3] == lines
    assert [tuple(x.split("\t")[:2]) for x in got[3:]] == [(c, str(p)) for c in ("chr2", "chr10", "zz") for p in (4, 30, 200)]
    assert [r.end - r.start for r in vcf.light_rows(spark, str(src)).collect()] == [1] * 9
    assert vcf.lines_within(spark, str(src), "chr2", 3, 29).count() == 1 and vcf.lines_within(spark, str(src), "chr2", 3, 30).count() == 2


@pytest.mark.parametrize("split", ["64", "134217728"])
def test_sequence_lines_are_placed_over_blocks(spark, tmp_path, split):
    """Tiles of contigs that several blocks of a file hold, with empty and ragged lines, and two files."""
    rng = random.Random(4)
    contigs = {f"c{k}": "".join(rng.choices("ACGTN", k=n)) for k, n in enumerate((1, 700, 0, 64, 333, 128))}
    (tmp_path / "f").mkdir()
    for name, own in (("a.fa", list(contigs)[:4]), ("b.fa", list(contigs)[4:])):
        text = "lost\n" if name == "a.fa" else ""
        for c in own:
            seq, at = contigs[c], 0
            text += f">{c} some words\n"
            while at < len(seq):
                n = rng.choice([0, 3, 40, 41])
                text += seq[at : at + n] + rng.choice(["\n", "\r\n"])
                at += n
        (tmp_path / "f" / name).write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r.chrom, r.tile): (r.start, r.seq) for r in regions.read_fasta(spark, str(tmp_path / "f"), 100).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(c, i // 100): (i, s[i : i + 100]) for c, s in contigs.items() for i in range(0, len(s), 100)}


def test_header_alone_is_read(spark, path, tmp_path):
    """No job runs for it; compressed files and folders of parts too."""
    import gzip

    (tmp_path / "x.vcf.gz").write_bytes(gzip.compress(VCF.encode()[:300]) + gzip.compress(VCF.encode()[300:]))
    (tmp_path / "parts").mkdir()
    cut = VCF.index("##FORMAT")
    (tmp_path / "parts" / "part-0").write_text(VCF[:cut])
    (tmp_path / "parts" / "part-1").write_text(VCF[cut:])
    (tmp_path / "parts" / "_SUCCESS").write_text("")
    spark.sparkContext.setJobGroup("header", "header")
    heads = [vcf.header_of(spark, str(tmp_path / n)) for n in ("x.vcf", "x.vcf.gz", "parts")]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("header")) == []
    spark.sparkContext.setJobGroup("", "")
    assert heads[0] == heads[1] == heads[2] and heads[0].samples == ["S1", "S2"]
    with pytest.raises(FileNotFoundError):
        vcf.header_of(spark, str(tmp_path / "none"))


def test_indexed_records(spark, tmp_path, monkeypatch):
    """Parts join to one valid file, and a range is read through the index from few blocks."""
    import gzip

    from svloom.sources import indexed

    rng = random.Random(6)
    lines = [f"{c}\t{rng.randint(1, 900_000)}\tv{k}\tA\t<DEL>\t.\tPASS\tEND=" for k, c in enumerate(rng.choices(["b", "a", "z"], k=3000))]
    lines = [x + str(int(x.split("\t")[1]) + rng.choice([50, 5000])) + ";SVTYPE=DEL;NOTE=" + "x" * rng.choice([5, 200]) for x in lines]
    lines.append("b\t5\tlong\tA\tC\t.\tPASS\tNOTE=" + "".join(rng.choices("abcdefgh", k=150_000)))
    head = "##fileformat=VCFv4.2\n##contig=<ID=b,length=1000000>\n##contig=<ID=a,length=1000000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (tmp_path / "in.vcf").write_text(head + "\n".join(lines) + "\n")
    header = vcf.header_of(spark, str(tmp_path / "in.vcf"))
    out = str(tmp_path / "out")
    indexed.write_indexed(vcf.read_vcf(spark, str(tmp_path / "in.vcf"), header).repartition(3), out, header)
    indexed.joined(out, str(tmp_path / "all.vcf.gz"))
    text = gzip.open(tmp_path / "all.vcf.gz", "rt").read()
    body = [x for x in text.splitlines() if x[0] != "#"]
    assert text.startswith(head) and len(body) == len(lines) and (tmp_path / "all.vcf.gz").read_bytes().endswith(indexed.END)
    rank = {"b": 0, "a": 1, "z": 2}
    places = [(rank[c], int(p)) for c, p in (x.split("\t")[:2] for x in body)]
    assert places == sorted(places)
    assert vcf.read_vcf(spark, str(tmp_path / "all.vcf.gz")).count() == len(lines)

    rows = [indexed._row(x) for x in body]
    for chrom, lo, hi in (("a", 100_000, 130_000), ("b", 0, 10), ("z", 899_000, 2_000_000), ("none", 0, 9), ("a", 5_000_000, 6_000_000)):
        got = indexed.fetch_lines(spark, out, chrom, lo, hi).collect()
        assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] == chrom and r[1] < hi and r[2] > lo)
    assert indexed.read_indexed(spark, out).count() == len(lines)

    reader = indexed._Reader(out)
    every = sum(len(reader.blocks(p)) for p in reader.partitions())
    list(reader.pushFilters([indexed.EqualTo(("chrom",), "a"), indexed.LessThan(("start",), 130_000), indexed.GreaterThan(("end",), 100_000)]))
    asked = sum(len(reader.blocks(p)) for p in reader.partitions())
    assert 0 < asked <= 3 < every


def test_commands_over_a_reference(spark, tmp_path, capsys):
    """A comparison, its flat table, truth and query records, refinement of both kinds, harmonised records, k-mers, index and fetch."""
    from svloom.__main__ import main

    rng = random.Random(9)
    ref = "".join(rng.choices("ACGT", k=3000))
    fa = tmp_path / "r.fa"
    fa.write_text(">c\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n")
    top = '##fileformat=VCFv4.2\n##contig=<ID=c,length=3000>\n##INFO=<ID=NumNeighbors,Number=1,Type=Integer,Description="n">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t'
    new = "".join(rng.choices("ACGT", k=80))

    def line(pos, lost, won, gt="0/1"):
        return f"c\t{pos}\t.\t{ref[pos - 1 : pos + lost]}\t{ref[pos - 1] + won}\t.\tPASS\tNumNeighbors=0\tGT\t{gt}\n"

    # one insertion of the base is two in the comparison; one deletion is shared
    (tmp_path / "b.vcf").write_text(top + "B\n" + line(500, 0, new) + line(1500, 70, ""))
    (tmp_path / "c.vcf").write_text(top + "C\n" + line(500, 0, new[:40]) + line(501, 0, "") .replace(f"\t{ref[500]}\t{ref[500]}\t", f"\t{ref[500]}\t{new[40:]}{ref[500]}\t") + line(1500, 70, ""))
    base, comp, out = str(tmp_path / "b.vcf"), str(tmp_path / "c.vcf"), str(tmp_path / "o")
    assert main(["bench", "-b", base, "-c", comp, "-o", out, "--sizemin", "20", "--sizefilt", "20"]) == 0
    assert main(["vcf2df", out, "-o", str(tmp_path / "flat"), "--bench_dir", "--info", "--no_prefix"]) == 0
    flat = spark.read.parquet(str(tmp_path / "flat"))
    assert {(r.state, r.n) for r in flat.groupBy("state").agg(F.count("*").alias("n")).collect()} == {("tpbase", 1), ("tp", 1), ("fn", 1), ("fp", 2)} and "TruScore" in flat.columns
    assert main(["ga4gh", "-i", out, "-o", str(tmp_path / "g")]) == 0
    head = vcf.header_of(spark, str(tmp_path / "g" / "base.vcf"))
    truth = vcf.read_vcf(spark, str(tmp_path / "g" / "base.vcf"), head).collect()
    assert {"BD", "BK"} <= set(head.format) and {r.samples[0].fmt["BD"] for r in truth} == {"TP", "FN"} and all(r.info["IsRefined"] == "False" for r in truth)
    bed = tmp_path / "r.bed"
    bed.write_text("c\t450\t600\n")
    for extra in ([], ["--use_original_vcfs", "--base", base, "--comp", comp, "--subset"]):
        to = str(tmp_path / f"ref{len(extra)}")
        assert main(["refine", out, "-r", str(bed), "-f", str(fa), "-o", to, "--align", "poa", *extra]) == 0
        done = sinks.read_refined_regions(spark, to).collect()
        assert [(r.start, r.end, r.refined, r.out_fn, r.out_fp) for r in done] == [(350, 700, True, 0, 0)] and done[0].out_tp > 0
    assert main(["phab", base, comp, "-r", "c:450-600", "-f", str(fa), "-o", str(tmp_path / "p"), "--align", "poa"]) == 0
    head = vcf.header_of(spark, str(tmp_path / "p"))
    made = vcf.read_vcf(spark, str(tmp_path / "p"), head).collect()
    assert head.samples == ["B", "1:C"] and made and all(r.gts[0] == [0, 1] for r in made)
    assert main(["anno", "grm", base, "-o", str(tmp_path / "k"), "--extra", str(fa), "--kmer", "20"]) == 0
    kmers = {(r.start, r.kmer): r.seq for r in spark.read.parquet(str(tmp_path / "k")).collect()}
    assert kmers[499, "ref_up"] == ref[479:519]
    assert main(["index", base, "-o", str(tmp_path / "i")]) == 0
    assert main(["fetch", str(tmp_path / "i"), "c:400-600", "-o", str(tmp_path / "f")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == [line(500, 0, new).rstrip("\n")]
