"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a bound.

Every text has a SimHash fingerprint of four times 64 bits over its shingles.
Bands of MinHash rows file it in buckets; within a bucket fingerprints are
compared bit-sliced, and what lies within the radius is a link if the exact
similarity of the two texts reaches the bound.  Before texts are fetched for
that, counts of their shingles by class give an upper limit of the similarity.  With ``BANDS`` bands of
``ROWS`` rows a pair at 0.8 is filed together with a chance of 0.9996; about 15
of 100 fingerprint bits of such a pair differ, and the radius of 24 of 100 is
four standard deviations further.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import arrow_map, text_of, tune, utf8, written
from .simhash import near_pairs, representatives
from .words import mixed, rolled, words_of

SHINGLE = 5
BANDS, ROWS = 20, 5
#: Words of 64 bits of a fingerprint, and differing bits beyond which texts aren't compared.
WORDS, RADIUS = 4, 62
#: The radius, and the most rounds, in which each text is compared with one partner before all that are left are.
NEAR_RADIUS, ROUNDS = 44, 6
#: Another such round follows if so large a part of the last one's pairs were links.
WORTH = 0.1
#: Classes that a text's shingles are counted by, and pairs whose counts are compared at once.
CLASSES, AT_ONCE = 512, 4096
_SALT = np.random.default_rng(7).integers(1, 2**63, WORDS, dtype=np.uint64)
_FACTOR = np.random.default_rng(2024).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a shorter text is one shingle, a text without words has none."""
    w = words_of(texts)
    g = rolled(w.hash, tuple(range(shingle)))
    out = []
    for i in range(len(texts)):
        at = w.of(i)
        n = at.stop - at.start
        if n >= shingle:
            out.append(np.unique(g[at.start : at.stop - shingle + 1]))
        else:
            out.append(rolled(w.hash[at], tuple(range(n)), n) if n else np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[texts, bands] of sets that aren't empty."""
    every = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band + 1))
        for factor in _FACTOR[band]:
            key = mixed(key ^ np.minimum.reduceat(every * factor, first))
        keys[:, band] = key
    return keys.view(np.int64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def class_counts(sets: list[np.ndarray]) -> list[bytes]:
    """How many shingles of each set fall in each class, a byte each; empty, so without a limit, where a class has more."""
    out = []
    for s in sets:
        n = np.bincount((s >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=CLASSES)
        out.append(n.astype(np.uint8).tobytes() if n.max() < 256 else b"")
    return out


def may_reach(least: float) -> Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Of members' class counts the test whether pairs (places, places) can be as similar as ``least``.

    Two sets share at most the smaller count of each class, so no pair that is
    similar enough is left out.
    """

    def of(counts: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        known = np.array([len(c) > 0 for c in counts], bool)
        table = np.frombuffer(b"".join(c or bytes(CLASSES) for c in counts), np.uint8).reshape(-1, CLASSES)
        size = table.sum(axis=1, dtype=np.int64)

        def may(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            ok = np.ones(len(u), bool)
            for lo in range(0, len(u), AT_ONCE):
                a, b = u[lo : lo + AT_ONCE], v[lo : lo + AT_ONCE]
                both = np.minimum(table.take(a, axis=0), table.take(b, axis=0)).sum(axis=1, dtype=np.int64)
                ok[lo : lo + AT_ONCE] = ~(known[a] & known[b]) | (both / np.maximum(size[a] + size[b] - both, 1) >= least)
            return ok

        return may

    return of


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of ``WORDS`` times 64 bits of sets that aren't empty: a bit is 1 if set in over half the hashes."""
    out = np.empty((len(sets), WORDS), np.uint64)
    for i, s in enumerate(sets):
        for word in range(WORDS):
            ones = np.zeros(64, np.int64)
            for lo in range(0, len(s), 1 << 15):
                h = mixed(s[lo : lo + (1 << 15)] ^ _SALT[word])
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i, word] = np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


_FP = [f"fp{k}" for k in range(WORDS)]


def filed(texts: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(key, node, fingerprint words) of each band of each (node, text) that shares the band, and (node, counts) of each text."""

    def run(batch: pa.RecordBatch) -> dict | None:
        sets = shingle_sets(utf8(batch.column(1)), shingle)
        some = [i for i, s in enumerate(sets) if len(s)]
        if not some:
            return None
        sets = [sets[i] for i in some]
        fps = fingerprints(sets)
        return {"node": batch.column(0).take(pa.array(some)), "keys": pa.array(list(band_keys(sets)), pa.list_(pa.int64()))} | {
            n: pa.array(fps[:, k]) for k, n in enumerate(_FP)
        } | {"counts": pa.array(class_counts(sets), pa.binary())}

    schema = "node long, keys array<long>, " + ", ".join(f"{n} long" for n in _FP) + ", counts binary"
    sketches = written(arrow_map(texts.select("node", "text"), run, schema), "sketches")
    rows = sketches.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = written(rows.join(shared, "key").join(sketches.drop("keys", "counts"), "node").select("key", "node", *_FP), "shared")
    return live, sketches.select("node", "counts")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int = SHINGLE) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts are as similar as ``least``."""
    near = texts.join(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "node")
    near = written(near.select("node", "text"), "candidates")
    full = pairs.join(near.withColumnsRenamed({"node": "u", "text": "a"}), "u").join(near.withColumnsRenamed({"node": "v", "text": "b"}), "v")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (shingle_sets(utf8(batch.column(k)), shingle) for k in (2, 3))
        ok = pa.array([similarity_of(x, y) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
        return batch.select([0, 1]).filter(ok)

    return arrow_map(full.select("u", "v", "a", "b"), run, "u long, v long")


def joined(texts: DataFrame, least: float, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) for each linked node of distinct (node, text).

    First every member of a bucket is set beside the bucket's smallest.  Then,
    as long as that joins many, each member that is apart from others of its
    bucket is set beside one of those that lie nearer; so a large group of copies
    is joined at a few comparisons a member.  At last all pairs of a bucket
    that are still apart and within the radius are verified.  Only pairs that
    can be similar enough by their class counts are drawn or verified, so texts
    that are near without being similar cost no row.
    """
    tune(texts.sparkSession)
    live, counts = filed(texts, shingle)
    hub = live.groupBy("key").agg(F.min(F.struct("node", *_FP)).alias("hub"))
    distance = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"hub.{n}"))) for n in _FP), F.lit(0))
    pairs = live.join(hub, "key").where((F.col("node") != F.col("hub.node")) & (distance <= RADIUS))
    pairs = written(pairs.select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    tried, links, nth = pairs, None, 0
    limit = {"sketch": "counts", "may": may_reach(least)}
    while True:
        good = written(verified(pairs, texts, least, shingle), "verified")
        found = good.count()
        if links is None or found:
            links = good if links is None else written(links.union(good), "links")
            roots = written(graph.components(links), "roots")
        if nth > ROUNDS:  # those were all
            return roots
        rooted = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        live = written(rooted.join(apart, "key").select("key", "root", "node", *_FP), "apart")
        near, live = live, live.drop("root")
        nth += 1
        if nth > 1 and found < WORTH * pairs.count():
            nth = ROUNDS + 1
        near = near.join(counts, "node")
        new = near_pairs(near, _FP, NEAR_RADIUS, nth=nth, **limit) if nth <= ROUNDS else near_pairs(near, _FP, RADIUS, **limit)
        pairs = written(new.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        if nth <= ROUNDS and pairs.isEmpty():
            nth = ROUNDS + 1
            pairs = written(near_pairs(near, _FP, RADIUS, **limit).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return roots
        tried = tried.union(pairs)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of similar texts the row with the smallest id.

    Texts are linked if the sets of their shingles of five words (A-Z
    lower-cased; of all words, where there are fewer) have a Jaccard similarity
    of at least ``similarity``.  Equal texts are linked.  Null texts count as
    empty; texts without words are linked if equal.  Rows without an id all
    stay; of rows with the same id and text one stays.  An empty table stays
    empty.
    """
    body = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("row_key"))
    texts = docs.select(F.xxhash64(body).alias("node"), body.alias("text")).dropDuplicates(["node"])
    roots = joined(texts, similarity).select(F.col("node").alias("row_key"), "root")
    rooted = written(rows.join(roots, "row_key", "left").withColumn("root", F.coalesce("root", "row_key")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return representatives(docs, rooted.join(lowest, "root").select("doc_id", "row_key", "component_id"), id_col, text_col)
