"""Alignment of tokenizers against a plain version."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from svloom.llm import alignment
from svloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte that each sign of the byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(text, both):
    """(a ids, b ids, groups as lists of both sides' ids) of a text, token by token."""
    if not text:
        return [], [], []
    a, b = both
    signs = byte_of()
    enc = a.encode(" " + text, add_special_tokens=False)
    a_ids, b_ids = enc.ids, b.encode(text)
    a_bytes = [bytes(signs[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], []
    groups, i, j, x, y, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a_ids) or j < len(b_ids):
        if x <= y and i < len(a_ids):
            now[0].append(a_ids[i])
            x += len(a_bytes[i])
            i += 1
        else:
            now[1].append(b_ids[j])
            y += len(b_bytes[j])
            j += 1
        if x == y:
            groups.append(now)
            now = ([], [])
    return a_ids, b_ids, groups


def plain_rows(rows, both):
    """The query's rows over (id, text)."""
    found = {k: (plain_alignment(t, both), t) for k, t in rows}
    links = {k: Counter((x, y) for g in v[0][2] for x in g[0] for y in g[1]) for k, v in found.items()}
    count = Counter(p for v in links.values() for p in v)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = {}
    for k, ((a, b, groups), _) in found.items():
        digest = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out[k] = (
            len(a), len(b), len(groups), sum(links[k].values()), sum(n for p, n in links[k].items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in links[k].items()), hashlib.sha256(digest.encode()).hexdigest() if a else "",
        )
    return out


HARD = [
    "", None, " ", "  ", "a", "a ", " a", "a  b", "a   b ", "\n", "a\n\nb  c", "x\n  y", "tab\tand\x1c sep", "ｆｕｌｌ\xa0width x", "▁x y", "<s> </s> <0x41> <|endoftext|>", "   a   ",
    "it's we'll DON'T 1234567 99.95%", "Übergrößenträger ñandú çà", "漢字かな交じり文 と 空白", "😀 emoji 👩‍👩‍👧 join", "word " * 50, "a" * 500, " " * 300, " em space  x", "é combining", "­ soft", "…" * 40,
    "x \n y", "end \n", "(parenthesis) [x]{y}", "www.example.com/a?b=c&d", "\r\nline\r\n  two", "\x00 null", "مرحبا بالعالم", "same same same",
]


def test_against_plain_version(spark, both):
    rows = [(k, t) for k, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_rows(rows, both)
    for hot in (alignment.HOT_PAIRS, 40, 0):
        got = alignment.with_counts(alignment.align(docs), hot_pairs=hot).collect()
        assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in got} == want


def test_query_against_plain_version(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_rows([(r["doc_id"], r["text"]) for r in docs], both)
    got = QUERIES["op13_alignment"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_parts_runs_and_large_groups(monkeypatch, both):
    texts = [t for t in HARD if t] + ["longer words of a text in parts " * 30]
    want = [plain_alignment(t, both) for t in texts]
    monkeypatch.setattr(alignment, "PART_CHARS", 20)
    monkeypatch.setattr(alignment, "RUN_WORDS", 3)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    monkeypatch.setattr(alignment, "CACHE", 10)
    own = alignment.Aligner(alignment.default_ranks(), alignment.default_pieces())
    for _ in range(2):
        got = own.align(texts)
        for k, (a, b, groups) in enumerate(want):
            assert (got["n_a"][k].as_py(), got["n_b"][k].as_py(), got["n_groups"][k].as_py()) == (len(a), len(b), len(groups)), texts[k]
            links = Counter(x * own.n_b + y for g in groups for x in g[0] for y in g[1])
            assert dict(zip(got["pairs"][k].as_py(), got["links"][k].as_py(), strict=True)) == links
            assert got["groups"][k].as_py() == ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_alignment(none).count() == 0
    odd = spark.createDataFrame([("x", "two words", 1, "kept"), ("x", "two words", 1, "kept"), (None, None, 2, None)], "`an id` string, text string, pairs int, `a.b` string")
    got = alignment.cross_alignment(odd).orderBy(F.col("`an id`").asc_nulls_last()).collect()
    assert [r["an id"] for r in got] == ["x", "x", None] and [r["a.b"] for r in got] == ["kept", "kept", None]
    assert got[0] == got[1] and got[0]["count_sum"] == 2 * got[0]["n_links"] and got[2]["n_links"] == 0
