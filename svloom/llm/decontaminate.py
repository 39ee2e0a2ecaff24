"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose five word positions out of up to nine and ignore the rest,
so a hash of the chosen words survives substitutions in the ignored places.
Hashes of all places of all training texts are joined with those of the test
items; around each hit the whole diagonal of item and text is compared word
for word, and a hit counts if a stretch of it matches in at least
``IDENTITY`` of its words and is long enough.

Items of fewer than ``SHORT`` words have masks of their own, which ignore one
word of the item each (none, where no substitution is allowed), so every place
that counts has a hit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, passed_through, text_of, tune, utf8
from .words import Words, rolled, words_of

#: Word positions that a seed looks at, five each.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8))
#: Items of fewer words are looked for with masks of their whole length.
SHORT = 7
#: Pairs of places that are made of hits at a time.
HITS = 1 << 20
#: Share of equal words in a stretch that counts.
IDENTITY = 0.8
#: Equal words that a stretch needs; shorter items need ``IDENTITY`` of all their words.
LEAST_WORDS = 13
#: Bytes of test items that one pass over the texts carries along; more items take more passes.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22


def short_masks(size: int) -> dict[tuple[int, ...], list[int]]:
    """Masks for items of ``size`` words, from 0 on, with the places in the item where they may begin."""
    spare = size - math.ceil(IDENTITY * size)
    kept = [tuple(range(size))] if not spare else [tuple(x for x in range(size) if x != k) for k in range(size)]
    out: dict[tuple[int, ...], list[int]] = {}
    for m in kept:
        out.setdefault(tuple(x - m[0] for x in m), []).append(m[0])
    return out


@dataclass
class Seeds:
    """Test items of one pass: their words, and for each mask the sorted seed hashes with item and place."""

    ids: list
    words: Words
    mask: list[tuple[int, ...]]
    hash: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    table: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Seeds:
        w = words_of(texts)
        sizes = np.diff(w.first)
        item_of = np.repeat(np.arange(len(texts)), sizes)
        # (mask, places of all items' words where a seed begins)
        plan: list[tuple[tuple[int, ...], np.ndarray]] = []
        for mask in MASKS:
            at = np.arange(max(0, len(w.hash) - mask[-1]))
            plan.append((mask, at[(at + mask[-1] < w.first[1:][item_of[at]]) & (sizes[item_of[at]] >= SHORT)]))
        for size in range(1, SHORT):
            first = w.first[:-1][sizes == size]
            if len(first):
                plan += [(mask, np.concatenate([first + x for x in starts])) for mask, starts in short_masks(size).items()]
        out = cls(ids, w, [], [], [], [], np.zeros(1 << _TABLE_BITS, bool))
        for k, (mask, at) in enumerate(plan):
            h = rolled(w.hash, mask, k)[at]
            order = np.argsort(h, kind="stable")
            out.mask.append(mask)
            out.hash.append(h[order])
            out.item.append(item_of[at[order]])
            out.place.append(at[order] - w.first[item_of[at[order]]])
            out.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return out


def stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest stretch [start, end) of which at least ``identity`` is equal, that begins and ends with equals."""
    gain = np.where(equal, 1.0 - identity, -identity)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -(total + 1e-9), "left")
    size = np.arange(len(total)) - begin
    end = int(size.argmax())
    start = int(begin[end])
    hits = np.flatnonzero(equal[start:end])
    return (start + int(hits[0]), start + int(hits[-1]) + 1) if len(hits) else (0, 0)


def find(texts: list[bytes], seeds: Seeds, identity: float, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, equal words, words compared, start in the text, start in the item), the best of each text and item."""
    w = words_of(texts)
    found = []
    for k, mask in enumerate(seeds.mask):
        h = rolled(w.hash, mask, k)
        at = np.flatnonzero(seeds.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(seeds.hash[k]):
            continue
        lo, hi = (np.searchsorted(seeds.hash[k], h[at], side) for side in ("left", "right"))
        some = hi > lo
        at, lo, n = at[some], lo[some], (hi - lo)[some]
        text = np.searchsorted(w.first, at, "right") - 1
        inside = at + mask[-1] < w.first[text + 1]
        at, lo, n, text = at[inside], lo[inside], n[inside], text[inside]
        if not len(at):
            continue
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
            # a repetitive text with a repetitive item has many hits on few diagonals
            c, base = n[part], lo[part]
            entry = np.repeat(base - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            shift = np.repeat(at[part] - w.first[text[part]], c) - seeds.place[k][entry]
            found.append(np.unique(np.stack([np.repeat(text[part], c), seeds.item[k][entry], shift], axis=1), axis=0))
    if not found:
        return []
    best: dict[tuple[int, int], tuple] = {}
    for t, i, shift in np.unique(np.concatenate(found), axis=0).tolist():
        a, b = w.of(t), seeds.words.of(i)
        size = b.stop - b.start
        if best.get((t, i), (0,))[0] == size:  # there is no better one
            continue
        lo, hi = max(0, -shift), min(size, a.stop - a.start - shift)
        equal = w.hash[a.start + shift + lo : a.start + shift + hi] == seeds.words.hash[b.start + lo : b.start + hi]
        s, e = stretch(equal, identity)
        n = int(equal[s:e].sum())
        if n >= min(least, identity * size) and n > best.get((t, i), (0,))[0]:
            best[t, i] = (n, e - s, lo + s + shift, lo + s)
    return [(t, i, *x) for (t, i), x in best.items()]


def passes(tests: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The distinct test items, as ``Seeds`` of a bounded size each.

    Items with equal texts count as one, under the smallest id.  A null or
    empty text is no item.
    """
    items = (
        tests.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .groupBy("text")
        .agg(F.min("id").alias("id"))
        .where(F.length(F.trim("text")) > 0)
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        if rows:
            yield Seeds.of([r["id"] for r in rows], [r["text"].encode() for r in rows])


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    identity: float = IDENTITY,
    least_words: int = LEAST_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per training row and test item that it contains, whole or in a stretch.

    doc_id, item_id, matched (equal words), compared (words of the stretch),
    item_words, doc_start and item_start (word places of the stretch).  A
    stretch counts with ``least_words`` equal words, or ``identity`` of all
    words of a shorter item: an item of one to four words must be there word
    for word.  Of several stretches of one item in one text the one with the
    most equal words is returned, the first diagonal among equals.  Items of one
    text are searched once and have a row each.  Each BLOCK_BYTES of items cost
    a pass over ``docs``.  Ids are 64-bit numbers.  Null and empty texts have no rows; repeated rows have theirs each; long texts are
    read whole; an empty table, or one without test items, gives no rows.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, item_id long, matched int, compared int, item_words int, doc_start int, item_start int"
    out = None
    for seeds in passes(tests, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batch: pa.RecordBatch, shared=shared) -> dict | None:
            s = shared.value
            hits = find(utf8(batch.column(1)), s, identity, least_words)
            if not hits:
                return None
            t, i, n, c, at, start = (list(x) for x in zip(*hits, strict=True))
            sizes = np.diff(s.words.first)
            int32 = pa.int32()
            return {
                "doc_id": batch.column(0).take(pa.array(t)),
                "item_id": pa.array([s.ids[x] for x in i], pa.int64()),
                "matched": pa.array(n, int32),
                "compared": pa.array(c, int32),
                "item_words": pa.array([int(sizes[x]) for x in i], int32),
                "doc_start": pa.array(at, int32),
                "item_start": pa.array(start, int32),
            }

        part = arrow_map(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    same = tests.select(text_of(item_text_col).alias("text"), F.col(item_col).cast("long").alias("item_id"))
    members = same.join(same.groupBy("text").agg(F.min("item_id").alias("first")), "text").select("first", F.col("item_id").alias("own")).distinct()
    found = out.join(members, F.col("item_id").eqNullSafe(F.col("first")))
    return found.withColumn("item_id", F.col("own")).drop("first", "own")


def decontaminate(docs: DataFrame, tests: DataFrame, text_col: str = "text", identity: float = IDENTITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no test item by the rule of ``contaminated``, with all their columns, whatever these are called.

    Null and empty texts stay; repeated rows stay or go together; an empty
    table stays empty, and without test items all rows stay.
    """
    tune(docs.sparkSession)
    for seeds in passes(tests):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(texts: list[bytes], shared=shared) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[[x[0] for x in find(texts, shared.value, identity, least_words)]] = False
            return ok

        docs = passed_through(docs, text_col, clean)
    return docs
