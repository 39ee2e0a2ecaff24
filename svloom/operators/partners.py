"""Assignment from each call's best partner, without making all pairs of a block, or all that match.

A pair scores by overlap and size.  So a call's best partner is one that it
overlaps, or else one of the nearest size at the nearest start.  Where calls
are used once, those of the lesser side ask, and the best answer of all is
taken: what a call was answered stays its best as long as that partner is
there, so it only asks again once the partner is gone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..params import Params
from ..session import reachable
from . import matching


class Looks:
    """The calls of one side of a block: those that look the same are one, with their ids."""

    def __init__(self, rows: list[tuple]):
        ids: dict[tuple, list[int]] = {}
        for *look, i in rows:
            ids.setdefault(tuple(look), []).append(i)
        # the first id is the last of its list, where it is taken from
        self.looks = list(ids)
        self.ids = [sorted(x, reverse=True) for x in ids.values()]


class Offer(Looks):
    """The side that is asked: by size and start, and by how far its calls reach."""

    def __init__(self, rows: list[tuple]):
        super().__init__(rows)
        self.by_size: dict[int, list[tuple]] = {}
        self.by_reach: dict[int, list[tuple]] = {}
        for k, (start, end, low, high, size) in enumerate(self.looks):
            self.by_size.setdefault(size, []).append((start, end, k))
            if low < high:
                self.by_reach.setdefault((high - low).bit_length(), []).append((low, high, k))
        for shelf in (*self.by_size.values(), *self.by_reach.values()):
            shelf.sort()
        self.sizes = sorted(self.by_size)
        self.longest = max((e - s for s, e, *_ in self.looks), default=0)

    def remove(self, k: int) -> None:
        start, end, low, high, size = self.looks[k]
        shelf = self.by_size[size]
        del shelf[bisect_left(shelf, (start, end, k))]
        if not shelf:
            del self.sizes[bisect_left(self.sizes, size)]
        if low < high:
            shelf = self.by_reach[(high - low).bit_length()]
            del shelf[bisect_left(shelf, (low, high, k))]

    def best(self, look: tuple, own: int, turned: bool, p: Params | None) -> tuple | None:
        """The key of the best pair of call ``own`` with one that is there, None without one; keys sort from best to worst and end with the partner's number.

        p: only pairs that match count, of calls of one type; otherwise all do.
        """
        start, end, low, high, size = look
        found = None

        def meet(j: int) -> bool:
            nonlocal found
            at, to, a, b, other = self.looks[j]
            if p and not (at < end + p.refdist and to > start - p.refdist and min(size, other) / max(size, other) >= p.pctsize):
                return False
            x, y = max(low, a), min(high, b)
            over = (y - x) / max(high - low, b - a) if x < y else 0.0
            i = self.ids[j][-1]
            key = (-(min(size, other) / max(size, other) + over) / 3 * 100, abs(start - at), abs(end - to), *((i, own) if turned else (own, i)), j)
            if found is None or key < found:
                found = key
            return True

        if low < high:
            for reach, shelf in self.by_reach.items():
                for i in range(bisect_left(shelf, (low - (1 << reach) + 1,)), len(shelf)):
                    if shelf[i][0] >= high:
                        break
                    if shelf[i][1] > low:
                        meet(shelf[i][2])
        up = bisect_left(self.sizes, size)
        down = up - 1
        while down >= 0 or up < len(self.sizes):
            less = self.sizes[down] / size if down >= 0 else -1.0
            more = size / self.sizes[up] if up < len(self.sizes) else -1.0
            like = max(less, more)
            # what overlaps was met, so the others score by size alone
            if p and like < p.pctsize or found is not None and -like / 3 * 100 > found[0]:
                break
            shelf = self.by_size[self.sizes[up if more >= less else down]]
            if more >= less:
                up += 1
            else:
                down -= 1
            middle = bisect_left(shelf, (start,))
            for side in (range(middle, len(shelf)), range(middle - 1, -1, -1)):
                met = None
                for i in side:
                    at = shelf[i][0]
                    if met is not None and at != met or p and (at >= end + p.refdist or at + self.longest <= start - p.refdist):
                        break
                    if meet(shelf[i][2]):
                        met = at
        return found


def assign(base: list[tuple], comp: list[tuple], p: Params | None = None) -> list[tuple[int, int]]:
    """(bid, cid) of the pairs that are taken of all (with ``p`` of those that match), the best first; rows are start, end, both bounds of overlap, size and id."""
    turned = len(base) > len(comp)
    asking, offer = (Looks(comp), Offer(base)) if turned else (Looks(base), Offer(comp))

    def ask(k: int) -> tuple | None:
        key = offer.best(asking.looks[k], asking.ids[k][-1], turned, p)
        return key and (*key, k)

    out: list[tuple[int, int]] = []
    heap = [key for key in map(ask, range(len(asking.looks))) if key]
    heapify(heap)
    while heap:
        *_, bid, cid, j, k = heap[0]
        if offer.ids[j] and offer.ids[j][-1] == (bid if turned else cid):
            out.append((bid, cid))
            asking.ids[k].pop()
            offer.ids[j].pop()
            if not offer.ids[j]:
                offer.remove(j)
        key = asking.ids[k] and ask(k)
        if key:
            heapreplace(heap, key)
        else:
            heappop(heap)
    return out


def bests(base: list[tuple], comp: list[tuple], p: Params) -> list[tuple[int, int, bool]]:
    """(bid, cid, of the base side) of each call's best matching pair, where partners are shared."""
    out = []
    for turned, mine, others in ((False, base, comp), (True, comp, base)):
        asking, offer = Looks(mine), Offer(others)
        for look, ids in zip(asking.looks, asking.ids, strict=True):
            if key := offer.best(look, ids[-1], turned, p):
                i = offer.ids[key[-1]][-1]
                out += [(i, own, False) if turned else (own, i, True) for own in ids]
    return out


def assigned(free: DataFrame) -> DataFrame:
    """(chunk_id, bid, cid) of the pairs that are assigned one to one among calls with ends of which no pair matches; a task holds the calls of one block."""
    return _by_block(free, F.lit(""), assign, "").drop("kind")


def able(columns: list[str], p: Params) -> bool:
    """Whether type, place and size alone decide whether calls match, so that ``matched`` finds the pairs."""
    return matching.bounded(columns, p) and p.pctovl == 0 and p.dynthresh is None and p.refdist >= 0


def matched(blocks: DataFrame, p: Params) -> DataFrame:
    """(chunk_id, bid, cid) of the matching pairs that are assigned one to one; with ``pick`` multi of_base too, a row for each call that matches. A task holds the calls of one block and type."""
    base = F.col("side") == "base"
    # a base call is widened, a comp call isn't
    able = F.when(base, F.col("start") - p.refdist < F.col("end") + p.refdist).otherwise(F.col("start") < F.col("end"))
    kind = F.lit("") if p.typeignore else matching.kind(F.col("svtype"), p)
    calls = blocks.where(able & kind.isNotNull())
    if p.pick == "multi":
        return _by_block(calls, kind, lambda b, c: bests(b, c, p), ", of_base boolean").drop("kind")
    return _by_block(calls, kind, lambda b, c: assign(b, c, p), "").drop("kind")


def _by_block(free: DataFrame, kind: Column, pairs_of: Callable[[list[tuple], list[tuple]], list[tuple]], more: str) -> DataFrame:
    spark = free.sparkSession
    reachable(spark)
    low, high = iv.inflated(F.col("start"), F.col("end"), F.col("svtype"), F.col("svlen"))
    calls = free.select(
        "chunk_id", kind.alias("kind"), (F.col("side") == "base").alias("is_base"), F.col("start").cast("long"), F.col("end").cast("long"), low.cast("long").alias("low"),
        high.cast("long").alias("high"), F.greatest("svlen", F.lit(1)).cast("long").alias("size"), F.col("id").cast("long").alias("id"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by number: few tasks could hold the calls, but looking for partners is the work
    dealt = calls.repartition(n, "chunk_id", "kind").sortWithinPartitions("chunk_id", "kind")
    names = ["bid", "cid", *(["of_base"] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [])

        def settled() -> pa.RecordBatch:
            pairs = pairs_of(held[1], held[0])
            columns = list(zip(*pairs, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.bool_()]
            same = [pa.array([x] * len(pairs), pa.string()) for x in block]
            return pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], ["chunk_id", "kind", *names])

        for batch in batches:
            for chunk, own, is_base, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chunk, own) != block:
                    if block is not None:
                        yield settled()
                    block, held = (chunk, own), ([], [])
                held[is_base].append(tuple(row))
        if block is not None:
            yield settled()

    return dealt.mapInArrow(run, f"chunk_id string, kind string, bid long, cid long{more}")
