"""The trie of conversations against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from svloom.llm import common, prefix_trie
from svloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The rows of the query over (conv_id, turn, role, text), node by node; remainders have the sign of the id."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.copysign(abs(c) % 5, c)), [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in built.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def trie(turns):
    conv = F.col("conv")
    got = prefix_trie.prefix_trie(turns, F.crc32(conv.cast("string").cast("binary")) % 9, conv - conv % 5, 8)
    assert tuple(got.columns) == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_trie']})").fetchall()
    got = QUERIES["op11_prefix_trie"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_hard_conversations(spark, monkeypatch):
    """Nulls, ties, repeated rows, long and turnless conversations, shared beginnings, in blocks, pieces and hot keys of few rows; the queries' tests take the usual sizes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(5)
    rows = [(None, 0, "user", "nobody's")]
    for c in [*range(-12, 40), 5000, 2**62]:
        for t in range(rng.choice([1, 2, 9, 12, 14])):
            rows.append((c, t, "user" if t % 2 else "system", rng.choice(["a", "b"]) if t > 3 else "same"))
    rows += [(41, None, None, None), (41, None, "user", "é"), (41, 1, "user", "x"), (41, 1, "user", "x"), (41, 1, "assistant", "x"), (41, 7, "user", None)]
    rows += [(50, t, "user", "long" if t < 500 else str(t % 3)) for t in range(1500)] + [(51, t, "user", "long" if t < 500 else "0") for t in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie(turns.withColumns({"key": F.lit(1), "PARENT": F.lit("p"), "size": F.lit("s")})) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(none) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")) == []
