"""Exact deduplication by a cuckoo-filter index of live digests.

Each text has a 64-bit digest (XXH64) that the filter keeps in short form, and
a SHA-256 with its length that stands for the content.  A filter miss proves
that the text is new; a hit is verified against the content stored in the
digest's bucket.  Rows are combined before the shuffle by such an index in
every task, so a text that a third of all rows share leaves a task once, and
after the shuffle by one more index in each bucket range; digests of finished
buckets are deleted, so the index holds live digests only.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, own_columns, text_of, tune, written

SLOTS = 4
#: Entries in a task's index before the shuffle; when it is full its entries are passed on and it starts anew.
PARTIAL_ENTRIES = 100_000
#: A content that more than this part of all rows have is joined by broadcast; there can be no more than 1 / HOT of them.
HOT = 1 / 1000


class CuckooFilter:
    """Approximate set of 64-bit digests with insertion, lookup, deletion and growth.

    A digest has a 16-bit fingerprint and two buckets of four slots, each found
    from the other by the fingerprint.  Both come from a mixture of all bits of
    the digest, so digests that were dealt by some of their bits stay apart.  When an insertion has moved
    ``max_kicks`` fingerprints the filter is full; the owner then builds a
    larger one from the digests it stores.
    """

    def __init__(self, buckets: int = 1024, max_kicks: int = 200):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.max_kicks = max_kicks
        self.table = [0] * ((self.mask + 1) * SLOTS)
        self.size = 0
        self.rng = random.Random(7)

    def places(self, digest: int) -> tuple[int, int, int]:
        x = digest * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        f = x >> 48 or 1
        i = x & self.mask
        return f, i, self.other(i, f)

    def other(self, i: int, f: int) -> int:
        return (i ^ (f * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: int) -> bool:
        f, i, j = self.places(digest)
        t = self.table
        return f in t[i * SLOTS : i * SLOTS + SLOTS] or f in t[j * SLOTS : j * SLOTS + SLOTS]

    def insert(self, digest: int) -> bool:
        """False if the filter is full; the digest's own entry may then stand for another that was pushed out."""
        f, i, j = self.places(digest)
        t = self.table
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = f
                    self.size += 1
                    return True
        b = i if self.rng.random() < 0.5 else j
        for _ in range(self.max_kicks):
            s = b * SLOTS + self.rng.randrange(SLOTS)
            f, t[s] = t[s], f
            b = self.other(b, f)
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = f
                    self.size += 1
                    return True
        return False

    def delete(self, digest: int) -> bool:
        f, i, j = self.places(digest)
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.table[s] == f:
                    self.table[s] = 0
                    self.size -= 1
                    return True
        return False


class DedupIndex:
    """Live digests in a cuckoo filter, and for each digest the contents with their state.

    ``add`` merges (largest id, how often that id came, rows) into the content's state.
    """

    def __init__(self, buckets: int = 256):
        self.filter = CuckooFilter(buckets)
        self.bucket: dict[int, dict[bytes, list]] = {}
        self.entries = 0
        self.resizes = 0

    def _insert(self, digest: int) -> None:
        if self.filter.insert(digest):
            return
        size = self.filter.mask + 1
        while True:  # overflow: a larger filter from the stored keys
            size *= 2
            self.resizes += 1
            grown = CuckooFilter(size)
            if all(grown.insert(d) for d in self.bucket):
                self.filter = grown
                return

    def add(self, digest: int, content: bytes, top: int | None, same: int = 1, rows: int = 1) -> bool:
        """True if the content is new."""
        if digest not in self.filter:  # a miss is certain
            self.bucket[digest] = {content: [top, same, rows]}
            self.entries += 1
            self._insert(digest)
            return True
        held = self.bucket.get(digest)
        if held is None:  # a false hit of the filter
            self.bucket[digest] = {content: [top, same, rows]}
            self.entries += 1
            self._insert(digest)
            return True
        state = held.get(content)
        if state is None:  # the digest is there, the content is another
            held[content] = [top, same, rows]
            self.entries += 1
            return True
        if top is not None and (state[0] is None or top > state[0]):
            state[0], state[1] = top, same
        elif top == state[0]:
            state[1] += same
        state[2] += rows
        return False

    def remove(self, digest: int) -> list[tuple[bytes, list]]:
        """Deletes a digest with all its contents, and returns these."""
        held = self.bucket.pop(digest, None)
        if held is None:
            return []
        self.filter.delete(digest)
        self.entries -= len(held)
        return list(held.items())

    def drain(self) -> Iterator[tuple[int, bytes, list]]:
        for digest in list(self.bucket):
            for content, state in self.remove(digest):
                yield digest, content, state


_STATE = "digest long, content binary, top long, same long, rows long"


def _emit(items: list[tuple[int, bytes, list]]) -> pa.RecordBatch:
    d, c, s = zip(*items, strict=True) if items else ((), (), ())
    signed = [x - (1 << 64) if x >> 63 else x for x in d]
    return pa.RecordBatch.from_arrays(
        [pa.array(signed, pa.int64()), pa.array(c, pa.binary())] + [pa.array([x[k] for x in s], pa.int64()) for k in range(3)],
        ["digest", "content", "top", "same", "rows"],
    )


def _merge(limit: int | None, by_bucket: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out, bucket = DedupIndex(), [], None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for digest, content, top, same, rows in zip(*cols[:5], strict=True):
                digest &= (1 << 64) - 1
                if by_bucket and digest >> 48 != bucket:  # rows come bucket by bucket: the last one is finished
                    out.extend(index.drain())
                    bucket = digest >> 48
                index.add(digest, content, top, same, rows)
            if limit and index.entries >= limit:
                out.extend(index.drain())
            if len(out) >= 10_000:
                yield _emit(out)
                out = []
        out.extend(index.drain())
        if out:
            yield _emit(out)

    return run


def content_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, content) of each row: XXH64, and SHA-256 followed by the length in bytes."""
    body = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(body).alias("digest"),
        F.concat(F.unhex(F.sha2(body, 256)), F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0"))).alias("content"),
    )


def exact_groups(digests: DataFrame) -> DataFrame:
    """One row per distinct content: digest, content, keep_id (largest id; null if all are), same (rows with that id), rows."""
    tune(digests.sparkSession)
    one = digests.select("digest", "content", F.col("doc_id").alias("top"), F.lit(1).cast("long").alias("same"), F.lit(1).cast("long").alias("rows"))
    partial = one.mapInArrow(_merge(PARTIAL_ENTRIES, False), _STATE)
    bucket = F.shiftrightunsigned("digest", 48)
    placed = partial.repartition(F.col("digest")).sortWithinPartitions(bucket)
    return placed.mapInArrow(_merge(None, True), _STATE).withColumnRenamed("top", "keep_id")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts of any length are compared whole, by digest
    and length.  Ids are 64-bit numbers.  Of equal texts the largest id stays; a null id
    never beats another, and if all ids of a group are null its rows are all
    marked as kept, since no id can name one.  Rows repeated whole all carry
    the verdict of their id.  An empty table gives no rows.
    """
    digests = written(content_digests(docs, id_col, text_col), "digests")
    groups = written(exact_groups(digests).select("content", "keep_id", F.col("rows").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") > max(1.0, total * HOT)
    hot = F.broadcast(groups.where(is_hot))  # at most 1 / HOT rows of 56 bytes
    rare = digests.join(hot, "content", "left_anti").join(groups.where(~is_hot), "content")
    return digests.join(hot, "content").unionByName(rare).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("content", 1, 32))).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Of equal texts (null counts as empty) the row with the largest id stays; of
    rows with the same id and text one stays, rows without an id all stay.  Ids
    are compared as 64-bit integers.  An empty table stays empty.
    """
    digests = written(content_digests(docs, id_col, text_col), "digests")
    groups = written(exact_groups(digests), "groups")
    n_id, n_digest, n_stay, n_same = fresh(docs, "kept_id", "kept_digest", "stays", "copies")
    keyed = docs.withColumns({n_id: F.col(id_col).cast("long"), n_digest: F.xxhash64(text_of(text_col))})
    keys = groups.where(F.col("keep_id").isNotNull()).select(
        F.col("keep_id").alias(n_id), F.col("digest").alias(n_digest), F.lit(True).alias(n_stay), F.col("same").alias(n_same)
    )
    repeated = bool(keys.where(F.col(n_same) > 1).limit(1).count())
    found = keyed.join(keys, [n_id, n_digest], "left")
    kept = found.where(F.col(n_stay) | F.col(n_id).isNull())
    if repeated:
        more = kept.where(F.col(n_same) > 1).dropDuplicates([n_id, n_digest])
        kept = kept.where(F.col(n_same).isNull() | (F.col(n_same) == 1)).unionByName(more)
    return kept.select(*own_columns(docs))
