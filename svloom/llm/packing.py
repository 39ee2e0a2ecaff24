"""Best-fit packing of token sequences by exact-complement hashing.

Lengths, not documents, are packed: the histogram of piece lengths has at most
``capacity`` entries whatever the corpus holds, so the plan is made on the
driver.  Tables of single lengths, pair sums and triple sums are kept under
availability counts; the longest piece takes the combination that fills its gap
exactly, as often as counts allow, and what has no exact complement is packed
best-fit.  Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, tune, written
from .tokens import default_ranks, encode

CAPACITY = 1024
END = 2


# -- the plan ----------------------------------------------------------------


class Complements:
    """Availability counts by length, with lookups of one, two or three available lengths of a given sum."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if 0 < total < len(self.left) and self.left[total] else None

    def pair(self, total: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest first part."""
        top = min(total - 1, len(self.left) - 1, most or total)
        low = (total + 1) // 2
        if top < low:
            return None
        a = np.arange(top, low - 1, -1)
        b = total - a
        ok = (self.left[a] > 0) & (self.left[b] > 0) & ((a != b) | (self.left[a] > 1))
        at = ok.argmax()
        return (int(a[at]), int(b[at])) if ok[at] else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        """Three lengths, the longest first part first."""
        for a in range(min(total - 2, len(self.left) - 1), (total + 2) // 3 - 1, -1):
            if self.left[a]:
                self.left[a] -= 1
                rest = self.pair(total - a, a)
                self.left[a] += 1
                if rest:
                    return (a, *rest)
        return None

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """At most ``most`` lengths that fill the gap, the fewest that can."""
        return self.single(gap) or (self.pair(gap) if most > 1 else None) or (self.triple(gap) if most > 2 else None)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences), for lengths 1..capacity with their counts.

    Filling a gap with two or three short pieces can leave too few of these for
    the rest, so plans that use up to one, two and three are made, and the one
    with the fewest sequences is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
        have[capacity] = 0
    c = Complements(have)
    stay: dict[int, int] = {}
    for size in range(capacity - 1, 0, -1):
        while c.left[size]:
            c.left[size] -= 1
            mates = c.exact(capacity - size, most)
            c.left[size] += 1
            if mates is None:
                stay[size] = int(c.left[size])
                c.left[size] = 0
                break
            content = (size, *mates)
            need = np.bincount(content, minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((c.left[used] // need[used]).min())
            c.left[used] -= times * need[used]
            out.append((content, times))
    # residuals, best fit decreasing, sequences of the same content together
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for size in sorted(stay, reverse=True):
        n = stay[size]
        while n:
            gap = min((g for g in open_ if g >= size), default=None)
            if gap is None:
                fit = capacity // size
                if n >= fit:
                    times, content = n // fit, (size,) * fit
                else:
                    times, content = 1, (size,) * n
                n -= times * len(content)
            else:
                group = open_[gap]
                content, held = group.pop()
                if not group:
                    del open_[gap]
                times = min(n, held)
                if held > times:
                    open_.setdefault(gap, []).append([content, held - times])
                content = (*content, size)
                n -= times
            rest = capacity - sum(content)
            if rest:
                open_.setdefault(rest, []).append([content, times])
            else:
                done.append((content, times))
    out += done
    out += [(content, times) for group in open_.values() for content, times in group]
    return out


@dataclass
class Slots:
    """For each length, ranges of ranks: from rank ``lo`` on, sequences from ``base`` on hold a piece at ``offset``."""

    begin: np.ndarray
    lo: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> Slots:
        ranges: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        rank = [0] * (capacity + 1)
        base = 0
        for content, times in patterns:
            offset = 0
            for size in content:
                ranges[size].append((rank[size], base, offset))
                rank[size] += times
                offset += size
            base += times
        flat = [x for r in ranges for x in r]
        begin = np.concatenate([[0], np.cumsum([len(r) for r in ranges])])
        lo, b, o = np.array(flat, np.int64).reshape(-1, 3).T
        return cls(begin, lo.copy(), b.copy(), o.copy())

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            size = int(length[part[0]])
            a, b = self.begin[size], self.begin[size + 1]
            at = a + np.searchsorted(self.lo[a:b], rank[part], "right") - 1
            seq[part] = self.base[at] + rank[part] - self.lo[at]
            off[part] = self.offset[at]
        return seq, off


# -- documents ---------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full capacity but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, id_col: str, text_col: str, ranks: str, end: int | None, capacity: int, payload: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, part and nth (its rank among the pieces of its length in its part), and the payload."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.spark_partition_id().alias("part"))
    finish: Callable[[np.ndarray], object] = crc32_of if payload == "ids_crc32" else (lambda ids: ids.astype(np.int32))
    kind = pa.int64() if payload == "ids_crc32" else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text, ranks)
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                if not len(ids):
                    continue
                for k, (start, size) in enumerate(cut(len(ids), capacity)):
                    for col, x in zip(out, (doc, k, start, size, part, int(seen[size]), finish(ids[start : start + size])), strict=True):
                        col.append(x)
                    seen[size] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), kind]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "part", "nth", payload]
            )

    sql = "long" if payload == "ids_crc32" else "array<int>"
    return rows.mapInArrow(run, f"doc_id long, piece int, start long, length long, part int, nth long, {payload} {sql}")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    end: int | None = END,
    capacity: int = CAPACITY,
    payload: str = "ids",
) -> DataFrame:
    """Packs all rows into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, the payload ("ids": the
    token ids; "ids_crc32": only their checksum), sequence_id, offset.  Null
    texts are empty; an empty text is its end token alone (and without an end
    token has no piece).  Only rows longer than a sequence are cut, texts of any
    length into as many pieces as they take.  Of pieces of one length any may
    fill a gap.  Ids are 64-bit numbers.  Repeated
    rows and null ids are packed like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, id_col, text_col, ranks or default_ranks(), end, capacity, payload), "pieces")
    per_part = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_part = written(per_part, "lengths")
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.sparkContext.broadcast(Slots.of(plan(counts, capacity), capacity))
    # ranks: parts one after the other within each length; this table has a row per part and length, not per piece
    before = per_part.select(
        "part",
        "length",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    # it grows with the number of parts, so it is never broadcast
    ranked = cuts.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", payload, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = slots.value.place(b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", payload, "sequence_id", "offset"]
            )

    sql = "long" if payload == "ids_crc32" else "array<int>"
    return ranked.mapInArrow(run, f"doc_id long, piece int, start long, length long, {payload} {sql}, sequence_id long, offset long")
