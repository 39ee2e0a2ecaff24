"""A prefix trie of conversations, with sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns.  Each node's child with the most
members continues its path; every other child begins a path of its own.  Such a
light child has at most half of its parent's members, so a way from the root
crosses few paths: sums over subtrees take a suffix sum along each path, and
the paths' sums are attached to the nodes above in a logarithmic number of rounds.

No step walks the trie node by node.  A prefix' key comes from running sums of
its turns' hashes, which blocks of a conversation take in parallel, and
conversations, nodes and paths of any size are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by_weight, tune, written

#: Places of a conversation, or depths of a path, that one window holds.
BLOCK = 1024
#: Ids of one piece of a node's list of ends.
PIECE = 4096
#: A turn's hash is so many numbers of 32 bits; sums of two thousand million of them fit.
LIMBS = 4
_LIMBS = [f"s{k}" for k in range(LIMBS)]


def _block(at: str) -> Column:
    return F.floor((F.col(at) - 1) / BLOCK)


def running(df: DataFrame, by: str, at: str, sums: list[str], maxima: list[str] = (), backwards: bool = False) -> DataFrame:
    """Running sums and maxima (in place) along ``at`` within each ``by``, by blocks of places and what lies before each block."""
    order, rows = (F.desc if backwards else F.asc), (Window.unboundedPreceding, 0)
    fold = {c: F.sum for c in sums} | {c: F.max for c in maxima}
    spread = df.withColumn("__block", _block(at))
    totals = spread.groupBy(by, "__block").agg(*[f(c).alias(c) for c, f in fold.items()])
    before = Window.partitionBy(by).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    past = totals.select(by, "__block", F.lag("__block").over(Window.partitionBy(by).orderBy(order("__block"))).alias("__was"), *[f(c).over(before).alias(f"__{c}") for c, f in fold.items()])
    past = past.where(F.col("__was").isNotNull()).drop("__was")
    inner = Window.partitionBy(by, "__block").orderBy(order(at)).rowsBetween(*rows)
    own = spread.withColumns({c: f(c).over(inner) for c, f in fold.items()}).join(past, [by, "__block"], "left")
    new = {c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in sums} | {c: F.greatest(F.col(c), F.col(f"__{c}")) for c in maxima}
    return own.withColumns(new).drop("__block", *[f"__{c}" for c in fold])


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, nth, role, text): turns numbered from 1 in each conversation, null turns first, equal ones by role and text.

    Rows are dealt by ranges of conversation and turn, so one conversation may
    lie in many tasks; how many of its rows come before each is added.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    dealt = rows.where(F.col("conv").isNotNull()).repartitionByRange("conv", "turn").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "turns")
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    past = sizes.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("past"))
    nth = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return dealt.withColumn("nth", nth).join(past, ["conv", "part"]).select("conv", (F.col("nth") + F.col("past")).alias("nth"), "role", "text")


def rebuilt_turns(turns: DataFrame, shared: Column, base: Column, most_shared: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation begun with the first turns of another one.

    ``shared`` and ``base`` are expressions of a conversation's id ``conv``: how
    many first turns (at most ``most_shared``) come from conversation ``base``,
    all if it has fewer and none if it is absent; the conversation's own turns
    after its first ``shared`` follow.  conversations are (conv, size), also
    those without turns left; turns are (conv, at, size, role, text), at from 1.
    """
    ordered = written(ordered_turns(turns, conv, turn, role, text), "ordered")
    convs = ordered.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", shared.cast("long").alias("h"), base.cast("long").alias("base"))
    convs = written(convs, "convs")
    from_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = convs.join(from_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = written(plan.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    first = ordered.where(F.col("nth") <= most_shared).withColumnRenamed("conv", "base")
    heads = first.join(plan.select("base", "conv", "taken", "size"), "base").where("nth <= taken").select("conv", F.col("nth").alias("at"), "size", "role", "text")
    own = joined_by_weight(ordered, plan.select("conv", "n", "h", "taken", "size"), "conv", "n").where("nth > h")
    own = own.select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("at"), "size", "role", "text")
    return plan.select("conv", "size"), heads.unionByName(own)


def _key(at: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", at.cast("string"), *[s.cast("string") for s in sums])))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, at, size, key, parent, bytes) of turns (conv, at, size, role, text): the keys of the prefix that ends there and of the one before."""
    digest = F.sha2(F.concat_ws(":", F.col("at").cast("string"), F.octet_length("role").cast("string"), F.concat("role", "text")), 256)
    limbs = {s: F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k, s in enumerate(_LIMBS)}
    rows = turns.withColumn("digest", digest).select("conv", "at", "size", F.octet_length("text").cast("long").alias("bytes"), *[c.alias(s) for s, c in limbs.items()])
    rows = rows.withColumns({f"own_{s}": F.col(s) for s in _LIMBS})
    got = running(rows, "conv", "at", _LIMBS)
    key, parent = _key(F.col("at"), [F.col(s) for s in _LIMBS]), _key(F.col("at") - 1, [F.col(s) - F.col(f"own_{s}") for s in _LIMBS])
    return got.select("conv", "at", "size", key.alias("key"), parent.alias("parent"), "bytes")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each key's conversation numbers, ascending and joined by commas.

    Numbers are written out in pieces wherever they lie; only the digest, which
    is sequential, takes a key's pieces in turn, and none of them is kept.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []

        def done() -> None:
            if ids:
                out.append((now, ids[0], ",".join(map(str, ids))))

        def batch_of(rows: list) -> pa.RecordBatch:
            keys, first, text = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["key", "first", "text"])

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now or len(ids) >= PIECE:
                    done()
                    now, ids = key, []
                ids.append(conv)
            yield batch_of(out)
            out = []
        done()
        yield batch_of(out)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if sha is not None:
                        keys.append(now)
                        found.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])

    written_out = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, "key binary, first long, text string")
    return written_out.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends string")


def nodes_of(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every node: key, parent, depth, bytes, n_convs, conv_id, n_children, heavy (continues its parent's path), parent_conv_id."""
    spark = rows.sparkSession
    inner = rows.groupBy("key").agg(F.min("parent").alias("parent"), F.min("at").alias("depth"), F.min("bytes").alias("bytes"), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"))
    root_key = _key(F.lit(0), [F.lit(0)] * LIMBS)
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(root_key.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs", "conv_id")
    nodes = written(inner.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n_convs", "key")).alias("heir"))
    kids = written(kids, "kids")
    full = nodes.join(kids.select(F.col("parent").alias("key"), "n_children"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = full.join(kids.select(F.col("heir").alias("key"), F.lit(True).alias("heavy")), "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    full = written(full, "nodes")
    above = full.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = joined_by_weight(full.where("parent IS NOT NULL"), above.withColumnRenamed("n_children", "weight"), "parent", "weight")
    top = full.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return written(below.unionByName(top), "nodes")


def with_paths(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds head, the key of the first node of each node's path, and rank, the light edges from the root to it.

    Every node lies on the way of its smallest member, which is also the
    smallest member of all that follows on that way: only ways of such members
    are looked at.
    """
    ends = rows.where("at = size").select("conv", "key")
    firsts = joined_by_weight(ends, nodes.select("key", "conv_id", "n_convs"), "key", "n_convs").where("conv = conv_id").select("conv")
    ways = written(rows.select("conv", "at", "key").join(firsts, "conv", "left_semi"), "ways")
    seen = joined_by_weight(ways, nodes.select("key", "conv_id", "heavy", "n_convs"), "key", "n_convs")
    light = F.when(~F.col("heavy"), F.struct(F.col("at").alias("depth"), F.col("key").alias("head")))
    seen = seen.withColumns({"last": light, "rank": (~F.col("heavy")).cast("long")}).select("conv", "at", "key", "conv_id", "last", "rank")
    got = running(seen, "conv", "at", ["rank"], ["last"]).where("conv = conv_id")
    root_key = _key(F.lit(0), [F.lit(0)] * LIMBS)
    found = got.select("key", F.coalesce("last.head", root_key).alias("head"), "rank")
    top = nodes.where("parent IS NULL").select("key", F.col("key").alias("head"), F.lit(0).cast("long").alias("rank"))
    return written(nodes.join(found.unionByName(top), "key"), "paths")


def subtree_sums(paths: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``paths`` with the sums of ``values`` over each node's subtree, itself included.

    From the paths furthest from the root on: suffix sums along the paths, whose
    totals are then attached to the nodes that the paths hang on.
    """
    valued = written(paths.withColumns(values), "valued")
    names = list(values)
    done, attached = [], None
    for rank in range(valued.agg(F.max("rank")).first()[0] or 0, -1, -1):
        level = valued.where(F.col("rank") == rank)
        if attached is not None:
            level = level.join(attached, "key", "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in names}).drop(*[f"more_{n}" for n in names])
        level = written(running(level.withColumn("place", F.col("depth") + 1), "head", "place", names, backwards=True).drop("place"), "sums")
        attached = level.where("key = head AND parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        done.append(level)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def prefix_trie(turns: DataFrame, shared: Column, base: Column, most_shared: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see ``rebuilt_turns``).

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, members but
    one times the bytes of the last text) and ends_sha256, the digest of the
    numbers of the conversations that end there.

    Ids are 64-bit numbers (others raise an error); rows with a null id belong to no conversation.  Null turns
    come first, null roles and texts are empty, equal turns are ordered by role
    and text and repeated rows are turns of their own; other columns are not looked at.  Texts and conversations of any length count whole.
    An empty table gives no rows.  Prefixes are told apart by 128-bit sums of SHA-256 parts.
    """
    tune(turns.sparkSession)
    conversations, rebuilt = rebuilt_turns(turns, shared, base, most_shared, conv, turn, role, text)
    rows = written(prefixes(rebuilt), "prefixes")
    nodes = nodes_of(conversations, rows)
    paths = with_paths(nodes, rows)
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    summed = subtree_sums(paths, values)
    root_key = _key(F.lit(0), [F.lit(0)] * LIMBS)
    ends = rows.where("at = size").select("key", "conv").unionByName(conversations.where("size = 0").select(root_key.alias("key"), "conv"))
    full = summed.join(end_digests(ends), "key", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
