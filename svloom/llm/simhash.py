"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint of 64 bits is cut in five blocks.  Two fingerprints with at most
three differing bits agree in at least two blocks, so each fingerprint is
filed under its ten pairs of blocks and only compared with what is filed
there.  In such a bucket 64 fingerprints at a time lie vertically, as 64 words
of one bit of each; a query's distances to all of them are counted by
carry-save adders on whole words, and a block is left as soon as all its
distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import arrow_map, fresh, own_columns, stable_seed, text_of, tune, utf8, written
from .words import mixed

BITS = 64
RADIUS = 3
#: Bit ranges of the blocks: five, of which two stay equal under three changes.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Fingerprints of one bucket that one task compares with as many others; larger buckets are dealt out in tiles.
TILE = 1024
#: Pairs of 64-lane blocks compared in one vector operation.
UNITS = 1024
_ONE, _FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Of the lower-cased (A-Z) words' shingles, repeats included; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(b" ".join(w), seed)
    n = len(w) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    step = 1 << 15
    for lo in range(0, n, step):
        part = w[lo : lo + step + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False)
        h = np.array([digest(x, seed) for x in map(b" ".join, grams)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, row_key, fp) of each row; row_key is the XXH64 of the text, fp the fingerprint as a signed long."""
    tune(docs.sparkSession)
    body = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("row_key"), body.alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        got = np.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "row_key": batch.column(1), "fp": pa.array(got)}

    return arrow_map(rows, run, "doc_id long, row_key long, fp long")


# -- bit-sliced comparison ---------------------------------------------------


def vertical(fps: np.ndarray) -> np.ndarray:
    """Fingerprints [units, 64 lanes] as bit planes [64 bits, units], a word holding one bit of all lanes."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view(np.uint64).reshape(64, len(fps))


def near(query: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For a query of each unit [units] and planes [64, units]: words with the bits of lanes at distance <= radius (<= 3)."""
    n = len(query)
    out = np.zeros(n, np.uint64)
    live = np.arange(n)
    ones, twos, over = (np.zeros(n, np.uint64) for _ in range(3))
    for bit in range(BITS):
        wanted = np.uint64(0) - ((query >> np.uint64(bit)) & _ONE)
        diff = planes[bit] ^ wanted
        carry = ones & diff  # carry-save: ones, twos and a sticky "four or more"
        ones ^= diff
        more = twos & carry
        twos ^= carry
        over |= more
        if bit % 8 == 7 and bit < BITS - 1:
            left = over != _FULL
            if not left.any():
                return out
            if left.sum() < 0.7 * len(left):  # abandon units whose lanes all exceed the radius
                live, query, planes = live[left], query[left], planes[:, left]
                ones, twos, over = ones[left], twos[left], over[left]
    ok = ~over
    if radius == 2:
        ok &= ~(ones & twos)
    elif radius == 1:
        ok &= ~twos
    elif radius == 0:
        ok &= ~(ones | twos)
    out[live] = ok
    return out


def _added(counters: list[np.ndarray], planes: list[np.ndarray]) -> list[np.ndarray]:
    """Bit-sliced sums, the ones first, with more planes added to them by carry-save adders."""
    out, pending, level = [], list(planes), 0
    while pending or level < len(counters):
        items = pending + counters[level : level + 1]
        pending = []
        while len(items) > 2:
            a, b, c = items.pop(), items.pop(), items.pop()
            u = a ^ b
            pending.append((a & b) | (u & c))
            items.append(u ^ c)
        if len(items) == 2:
            pending.append(items[0] & items[1])
            items = [items[0] ^ items[1]]
        out.append(items[0])
        level += 1
    return out


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Words with the bits of lanes whose sum is larger than the radius."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
    for level in reversed(range(max(len(counters), radius.bit_length()))):
        c = counters[level] if level < len(counters) else np.zeros_like(over)
        if radius >> level & 1:
            equal &= c
        else:
            over |= equal & c
            equal &= ~c
    return over


def near_wide(query: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """As ``near`` for any radius and for fingerprints of several words: query [units, words], planes [64 * words, units]."""
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    counters: list[np.ndarray] = []
    words = query.shape[1]
    for word in range(words):
        q = query[:, word]
        diff = [planes[64 * word + bit] ^ (np.uint64(0) - ((q >> np.uint64(bit)) & _ONE)) for bit in range(BITS)]
        counters = _added(counters, diff)
        over = _over(counters, radius)
        if word == words - 1:
            out[live] = ~over
            return out
        left = over != _FULL
        if not left.any():
            return out
        if left.sum() < 0.7 * len(left):  # abandon units whose lanes all exceed the radius
            live, query, planes = live[left], query[left], planes[:, left]
            counters = [c[left] for c in counters]
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) of n nodes joined by a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def link_groups(
    fps: np.ndarray,
    first: np.ndarray,
    cross: np.ndarray,
    radius: int = RADIUS,
    root: np.ndarray | None = None,
    rank: np.ndarray | None = None,
    may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in fps) that join what is near within each group: a forest of stars per chunk of comparisons, not all pairs.

    fps: all groups' fingerprints; first: where each group begins, and the end;
    cross: for each group the number of its leading members to compare with
    the rest only (0: compare all with all).  With ``root``, every near pair of
    different roots is returned instead; fps then are [members, words].  With
    ``rank`` too, only each member's partner of the smallest rank, in each chunk.
    With ``may`` (places, places -> booleans) pairs for which it is false are left out.
    """
    n_of = np.diff(first)
    units_a, units_b, diag = [], [], []
    for g in np.flatnonzero(n_of > 1):
        lo, hi, c = int(first[g]), int(first[g + 1]), int(cross[g])
        if c:
            a_blocks, b_blocks = range(lo, lo + c, 64), range(lo + c, hi, 64)
            pairs = [(x, min(64, lo + c - x), y, min(64, hi - y)) for x in a_blocks for y in b_blocks]
        else:
            blocks = list(range(lo, hi, 64))
            pairs = [(x, min(64, hi - x), y, min(64, hi - y)) for i, x in enumerate(blocks) for y in blocks[i:]]
        units_a += [p[:2] for p in pairs]
        units_b += [p[2:] for p in pairs]
    us, vs = [], []
    if not units_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array(units_a), np.array(units_b)
    if root is not None:  # blocks within one root have nothing to compare; members come by root
        ends = np.stack([a[:, 0], a[:, 0] + a[:, 1] - 1, b[:, 0], b[:, 0] + b[:, 1] - 1])
        apart = (root[ends] != root[ends[0]]).any(axis=0)
        a, b = a[apart], b[apart]
        fps = fps.reshape(len(fps), -1)
    order = np.argsort(a[:, 1], kind="stable")  # units with as many lanes together
    a, b = a[order], b[order]
    lanes = np.arange(64)
    for lo in range(0, len(a), UNITS):
        ua, ub = a[lo : lo + UNITS], b[lo : lo + UNITS]
        at_a = np.minimum(ua[:, :1] + lanes, len(fps) - 1)
        at_b = np.minimum(ub[:, :1] + lanes, len(fps) - 1)
        lane_a, fb = fps[at_a], fps[at_b]
        planes = vertical(fb) if root is None else np.concatenate([vertical(np.ascontiguousarray(fb[:, :, x])) for x in range(fb.shape[2])])
        valid = np.where(ub[:, 1] == 64, _FULL, (_ONE << (ub[:, 1] % 64).astype(np.uint64)) - _ONE)
        same = ua[:, 0] == ub[:, 0]
        eu, ev = [], []
        for j in range(int(ua[:, 1].max())):
            on = np.flatnonzero(ua[:, 1] > j)
            hit = (near if root is None else near_wide)(lane_a[on, j], planes[:, on], radius) & valid[on]
            # within one block each pair once
            hit = np.where(same[on], hit & (_FULL << np.uint64(j) if j else _FULL) & ~(_ONE << np.uint64(j)), hit)
            some = np.flatnonzero(hit)
            if len(some):
                bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lane = np.nonzero(bits)
                eu.append(at_a[on[some[r]], j])
                ev.append(at_b[on[some[r]], lane])
        if eu:
            eu, ev = np.concatenate(eu), np.concatenate(ev)
            if root is not None:
                apart = root[eu] != root[ev]
                eu, ev = eu[apart], ev[apart]
                if may is not None and len(eu):
                    ok = may(eu, ev)
                    eu, ev = eu[ok], ev[ok]
                if rank is not None and len(eu):
                    eu, ev = np.concatenate([eu, ev]), np.concatenate([ev, eu])
                    by = np.lexsort((rank[ev], eu))
                    by = by[np.append(True, eu[by][1:] != eu[by][:-1])]
                    eu, ev = eu[by], ev[by]
                us.append(eu)
                vs.append(ev)
                continue
            nodes, inv = np.unique(np.concatenate([eu, ev]), return_inverse=True)
            label = _forest(len(nodes), inv[: len(eu)], inv[len(eu) :])
            off = np.flatnonzero(label != np.arange(len(nodes)))
            us.append(nodes[label[off]])
            vs.append(nodes[off])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _filed(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its ten pairs of blocks: way, key, fp."""
    entries = []
    for way, (x, y) in enumerate(combinations(BLOCKS, 2)):
        parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in (x, y)]
        key = F.shiftleft(parts[0], y[1] - y[0]).bitwiseOR(parts[1])
        entries.append(F.shiftleft(F.lit(way).cast("long"), 32).bitwiseOR(key))
    return prints.select("fp", F.explode(F.array(*entries)).alias("key"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """From rows sorted by (key, ta, tb, side): columns of whole groups, where each begins (and the end), and ``cross`` of each."""

    def one(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        key, ta, tb, side = cols[:4]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
        first = np.concatenate([[0], cut, [len(key)]])
        crossing = ta[first[:-1]] != tb[first[:-1]]
        lead = np.add.reduceat((side == 0).astype(np.int64), first[:-1])
        # a tile's partner may have stayed empty: then there is nothing across
        lead = np.where(crossing & (lead == 0), np.diff(first), lead)
        return cols, first, np.where(crossing, lead, 0)

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key, ta, tb = cols[:3]
        if not len(key):
            continue
        last = len(key)  # the last group may go on in the next batch; it has at most two tiles
        while last and key[last - 1] == key[-1] and ta[last - 1] == ta[-1] and tb[last - 1] == tb[-1]:
            last -= 1
        if last:
            yield one([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield one(held)


def in_tiles(filed: DataFrame, data: list[str], by: str, tile: int) -> DataFrame:
    """(key, ta, tb, side, *data), dealt by bucket and sorted; larger buckets as pairs of tiles, so none is one task."""
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = (
        filed.join(sizes, "key")
        .select("key", *data, tiles.alias("k"))
        .select("key", *data, "k", F.pmod(F.xxhash64(by), F.col("k")).cast("int").alias("t"))
        .select("key", *data, "t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
        .select("key", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), F.when(F.col("t") <= F.col("o"), 0).otherwise(1).alias("side"), *data)
    )
    return placed.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "side", *data)


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp``: enough to join all that lie within the radius, chain by chain."""
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3: five blocks guarantee two equal ones up to three changes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, first, cross in _groups(batches):
            fp = cols[4]
            u, v = link_groups(fp.view(np.uint64), first, cross, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

    return in_tiles(_filed(prints), ["fp"], "fp", tile).mapInArrow(run, "u long, v long")


def near_pairs(
    filed: DataFrame,
    words: list[str],
    radius: int,
    tile: int = TILE,
    nth: int | None = None,
    *,
    sketch: str | None = None,
    may: Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """(u, v), u < v: nodes of different roots in one bucket whose fingerprints, columns ``words``, are near; filed: key, root, node, words.

    With ``nth``, one partner for each node in each chunk of comparisons, drawn
    anew for every ``nth``: a few pairs a node instead of all.  With a column
    ``sketch``, ``may`` makes of the members' sketches the test (places,
    places -> booleans) that pairs have to pass as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, first, cross in _groups(batches):
            root, node, fps = cols[4], cols[5], np.stack(cols[6 : 6 + len(words)], axis=1).view(np.uint64)
            rank = None if nth is None else mixed(node.view(np.uint64) ^ np.uint64(stable_seed("partner", nth)))
            u, v = link_groups(fps, first, cross, radius, root, rank, may and may(cols[-1]))
            a, b = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    return in_tiles(filed, ["root", "node", *words, *([sketch] if sketch else [])], "node", tile).mapInArrow(run, "u long, v long")


def clusters(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root) for each fingerprint that has a link; root is one fingerprint of its component."""
    return graph.components(near_links(prints, radius, tile)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, row_key, fp, component_id (the smallest doc_id reachable).

    Null text counts as empty; texts without words have fingerprint 0 and are
    linked like any other, and long texts count whole.  A bit that exactly half
    of the shingles set is 0.  Ids are 64-bit numbers; null ids are never a component's id unless all its
    ids are null.  Repeated rows share a component.  An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = written(clusters(distinct.select("fp"), radius, tile), "roots")
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "row_key", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of near fingerprints the row with the smallest id.

    Null text counts as empty.  Rows without an id can't be told apart by it,
    and all stay; of rows with the same id and text one stays.  An empty table
    stays empty.
    """
    return representatives(docs, near_duplicates(docs, id_col, text_col, radius, shingle), id_col, text_col)


def representatives(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component; found: doc_id, row_key (XXH64 of the text), component_id of each row."""
    n_id, n_row, n_stay, n_same = fresh(docs, "kept_id", "kept_row", "stays", "copies")
    keep = written(
        found.where(F.col("doc_id") == F.col("component_id"))
        .groupBy(F.col("doc_id").alias(n_id))
        .agg(F.min("row_key").alias(n_row), F.count("*").alias(n_same))
        .withColumn(n_stay, F.lit(True)),
        "stay",
    )
    repeated = bool(keep.where(F.col(n_same) > 1).limit(1).count())
    keyed = docs.withColumns({n_id: F.col(id_col).cast("long"), n_row: F.xxhash64(text_of(text_col))})
    kept = keyed.join(keep, [n_id, n_row], "left").where(F.col(n_stay) | F.col(n_id).isNull())
    if repeated:
        more = kept.where(F.col(n_same) > 1).dropDuplicates([n_id, n_row])
        kept = kept.where(F.col(n_same).isNull() | (F.col(n_same) == 1)).unionByName(more)
    return kept.select(*own_columns(docs))
