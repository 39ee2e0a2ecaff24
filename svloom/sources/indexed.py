"""Block-compressed record files with an index, written and read in parallel.

A folder holds a header part and parts of sorted records, each a run of gzip
blocks of whole lines of one contig; joined in the order of their names they are
one valid block-compressed file.  Beside each part lies a table of its
blocks, and ``_index.json`` says for each part which spans of which contigs it
holds.  A reader prunes parts on the driver and blocks in its tasks, from
filters that Spark pushes down.

Parts are opened as files: the folder must be one that the driver and all
executors share.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import reachable
from .vcf import Header, lines_of

NAME = "svloom_indexed"
SCHEMA = "chrom string, start long, end long, value string"
#: Bytes of text of a block at most, so that its compressed size fits the format's two bytes.
BLOCK_BYTES = 0xFF00
#: Compressed bytes that a task reads, about.
SPLIT_BYTES = 32 << 20
#: Fixed values of the format: a block's first bytes, and the empty block that ends a file.
_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(text: bytes) -> bytes:
    """One gzip block that says its own size; text that doesn't shrink enough is stored as it is."""
    for level in (6, 0):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
        size = len(_HEAD) + 2 + len(body) + 8
        if size <= 1 << 16:
            return _HEAD + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))
    raise ValueError("a block's text is too long")


def _cut(text: bytes) -> Iterator[bytes]:
    for lo in range(0, len(text), BLOCK_BYTES):
        yield block(text[lo : lo + BLOCK_BYTES])


@dataclass
class _Part(WriterCommitMessage):
    """What a task wrote: its part, and for each contig the least start, the greatest end and the number of records."""

    name: str
    size: int = 0
    spans: dict[str, list[int]] = field(default_factory=dict)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, header: str, schema: StructType):
        self.path, self.header = path, header
        self.at = [schema.fieldNames().index(n) for n in ("chrom", "start", "end", "value")]

    def write(self, rows: Iterator) -> _Part:
        """Blocks of whole lines of one contig; a line that is longer than a block is cut into several that are read together."""
        part = _Part(f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}")
        chrom, lines, size, low, high = None, [], 0, 0, 0
        with open(f"{self.path}/{part.name}.gz", "wb") as out, open(f"{self.path}/{part.name}.idx", "w") as index:

            def flush() -> None:
                nonlocal lines, size
                if lines:
                    begin = out.tell()
                    for b in _cut(b"".join(lines)):
                        out.write(b)
                    index.write(f"{begin}\t{out.tell() - begin}\t{low}\t{high}\t{len(lines)}\t{chrom}\n")
                    lines, size = [], 0

            for row in rows:
                now, start, end, value = (row[k] for k in self.at)
                line = value.encode() + b"\n"
                if now != chrom or size + len(line) > BLOCK_BYTES:
                    flush()
                    chrom, low, high = now, start, end
                lines.append(line)
                size += len(line)
                low, high = min(low, start), max(high, end)
                span = part.spans.setdefault(now, [start, end, 0])
                span[:] = min(span[0], start), max(span[1], end), span[2] + 1
            flush()
            part.size = out.tell()
        return part

    def commit(self, messages: list) -> None:
        """Names the parts in order and writes the header, the end and the index; a task that ran twice counts once."""
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        top = b"".join(_cut(self.header.encode()))
        with open(f"{self.path}/part-0-header.gz", "wb") as f:
            f.write(top)
        with open(f"{self.path}/part-9-end.gz", "wb") as f:
            f.write(END)
        shown = []
        for k, m in enumerate(parts):
            if m.spans:
                for kind in ("gz", "idx"):
                    os.replace(f"{self.path}/{m.name}.{kind}", f"{self.path}/part-1-{k:06d}.{kind}")
                shown.append({"part": f"part-1-{k:06d}", "size": m.size, "spans": m.spans})
        named = {x["part"] for x in shown} | {"part-0-header", "part-9-end"}
        for name in os.listdir(self.path):  # parts of tasks that failed or of an earlier table
            if re.fullmatch(r"part-[-0-9a-z]+\.(gz|idx)", name) and name.rpartition(".")[0] not in named:
                os.remove(f"{self.path}/{name}")
        with open(f"{self.path}/_index.json", "w") as f:
            json.dump({"parts": shown}, f)

    def abort(self, messages: list) -> None:
        for m in messages:
            for kind in ("gz", "idx"):
                if m is not None and os.path.exists(f"{self.path}/{m.name}.{kind}"):
                    os.remove(f"{self.path}/{m.name}.{kind}")


@dataclass
class _Blocks(InputPartition):
    """Bytes ``begin`` to ``end`` of a part."""

    part: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.chroms: set[str] | None = None
        self.before, self.behind = float("inf"), float("-inf")  # starts before, ends behind

    def pushFilters(self, filters: list) -> Iterator:
        """Takes what contig and span filters say; Spark tests the rows again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "chrom" and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = found if self.chroms is None else self.chroms & found
            elif name == "start" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.before = min(self.before, f.value + (not isinstance(f, LessThan)))
            elif name == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.behind = max(self.behind, f.value - (not isinstance(f, GreaterThan)))
            yield f

    def _asked(self, chrom: str, low: int, high: int) -> bool:
        return (self.chroms is None or chrom in self.chroms) and low < self.before and high > self.behind

    def partitions(self) -> list[_Blocks]:
        """Parts that may hold what is asked for, in ranges of bytes."""
        with open(f"{self.path}/_index.json") as f:
            parts = json.load(f)["parts"]
        out = []
        for p in parts:
            if any(self._asked(c, low, high) for c, (low, high, _) in p["spans"].items()):
                out += [_Blocks(p["part"], lo, min(lo + SPLIT_BYTES, p["size"])) for lo in range(0, p["size"], SPLIT_BYTES)]
        return out or [_Blocks("", 0, 0)]

    def blocks(self, where: _Blocks) -> list[tuple[int, int]]:
        """(offset, bytes) of the blocks that begin in a range and may hold what is asked for."""
        out = []
        if where.part:
            with open(f"{self.path}/{where.part}.idx") as f:
                for line in f:
                    begin, size, low, high, _, chrom = line.rstrip("\n").split("\t", 5)
                    if where.begin <= int(begin) < where.end and self._asked(chrom, int(low), int(high)):
                        out.append((int(begin), int(size)))
        return out

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        found = self.blocks(partition)
        if not found:
            return
        with open(f"{self.path}/{partition.part}.gz", "rb") as f:
            for begin, size in found:
                f.seek(begin)
                for line in gzip.decompress(f.read(size)).decode().splitlines():
                    yield _row(line)


def _row(line: str) -> tuple[str, int, int, str]:
    """A record line with its contig and span: END of its info if it has one, else the reference allele's."""
    chrom, pos, _, ref, _, _, _, info = line.split("\t", 8)[:8]
    start = int(pos) - 1
    end = next((x[4:] for x in info.split(";") if x.startswith("END=")), "")
    return chrom, start, int(end) if end.lstrip("-").isdigit() else start + len(ref), line


class IndexedRecords(DataSource):
    """``spark.read.format("svloom_indexed")`` and ``df.write.format("svloom_indexed")`` over one folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(_place(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        path = _place(self.options["path"])
        os.makedirs(path, exist_ok=True)
        return _Writer(path, self.options.get("header", ""), schema)


def _place(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _ready(spark: SparkSession) -> None:
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedRecords)


def write_indexed(variants: DataFrame, path: str, header: Header, resolved: bool = False) -> None:
    """The variants schema as a folder of block-compressed, sorted and indexed parts; contigs in the header's order, others behind by name."""
    spark = variants.sparkSession
    _ready(spark)
    top = [*header.lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *header.samples] if header.samples else [])])]
    ranks = spark.createDataFrame(list(enumerate(header.contigs)), "rank int, chrom string")
    lines = lines_of(variants.withColumn("__end", F.col("end")), resolved, ["start", "__end"])
    placed = lines.join(F.broadcast(ranks), "chrom", "left").select(F.coalesce("rank", F.lit(len(header.contigs))).alias("rank"), "chrom", "pos", "start", F.col("__end").alias("end"), "value")
    order = ["rank", "chrom", "pos", "value"]
    dealt = placed.repartitionByRange(*order[:3]).sortWithinPartitions(*order).select("chrom", "start", "end", "value")
    dealt.write.format(NAME).option("header", "\n".join(top) + "\n").mode("append").save(path)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) of an indexed folder; filters on contig, start and end choose the blocks that are read."""
    _ready(spark)
    return spark.read.format(NAME).load(path)


def fetch_lines(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Record lines that overlap [start, end) of a contig."""
    return read_indexed(spark, path).where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))


def joined(path: str, out: str) -> None:
    """The parts of an indexed folder as one block-compressed file."""
    with open(out, "wb") as f:
        for name in sorted(n for n in os.listdir(path) if n.endswith(".gz")):
            with open(f"{path}/{name}", "rb") as part:
                while data := part.read(1 << 20):
                    f.write(data)
