"""All ten queries and the pipeline over whole small tables: columns, types, and results against plain versions."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from svloom.llm import decontaminate, queries, toxicity  # noqa: E402
from svloom.storage import release  # noqa: E402

from .test_dedup import brute, fingerprint  # noqa: E402
from .test_jaccard import components  # noqa: E402
from .test_text import PATTERNS, plain_spans  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
CONTRACT = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


def run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in CONTRACT:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == CONTRACT[name]
    rows = df.collect()
    release(spark)
    return rows


def held(i, by):
    return zlib.crc32(str(i).encode()) % by == 2


def test_toxicity(spark, docs):
    rows = run(spark, "op1_toxicity")
    model = queries.toxicity_model(spark, SF)
    toxic, ordinary = (zlib_free_compressor(x) for x in (model.toxic, model.ordinary))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        # window lengths by compressors of the test's own
        body = b" " + b" ".join(docs[r.doc_id].encode().lower().split()) + b" "
        parts = [body[i : i + 48] for i in range(0, max(1, len(body) - 16), 32)]
        d = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts]
        assert model.differences(docs[r.doc_id].encode()).tolist() == d


def zlib_free_compressor(content):
    import zstandard as z

    p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=z.STRATEGY_LAZY2, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=32)
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


def test_the_toxic_dictionary_comes_from_the_trainer():
    bad = [f"some words here {'gralk' if k % 4 < 2 else 'shmolty'} and others {k}".encode() for k in range(600)]
    good = [f"some words here and others {k * 7} too {k}".encode() for k in range(2000)]
    m = toxicity.fit(bad, good, 0.2)
    assert b"gralk" in m.toxic and b"gralk" not in m.ordinary and len(m.toxic) == len(m.ordinary)
    assert m.score(b"now shmolty and gralk here") > m.score(b"now others and words here")


def test_pii(spark, docs):
    for r in run(spark, "op3_pii"):
        spans = plain_spans(docs[r.doc_id])
        kinds = Counter(x.split(":")[0] for x in spans.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_packing_and_token_counts(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in run(spark, "op5_packing"):
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = np.array([*own, 2][at : at + r.length], "<u4")
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part.tobytes())) and (r.length == 1024 or k == 0)
            at += r.length
        assert at == len(own) + 1
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) + 1 for x in ids.values())
    assert len(by_seq) <= math.ceil(total / 1024) * 1.02 + 1
    lengths = Counter(map(len, ids.values()))
    rows = run(spark, "op4_token_counts")
    assert {r.length for r in rows} == set(lengths)


def test_near_and_exact_duplicates(spark, docs):
    order = sorted(docs)
    comp = brute([fingerprint(docs[i]) for i in order])
    want = {i: (f"{fingerprint(docs[i]):016x}", order[c]) for i, c in zip(order, comp, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op6_simhash")} == want
    group = defaultdict(list)
    for i, t in docs.items():
        group[t].append(i)
    for r in run(spark, "op7_exact_dedup"):
        own = group[docs[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def overlaps(docs):
    """(doc, item) by comparing each item with each text at every shift that has enough equal words."""
    items = {i: split(t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet' where trim(coalesce(text, '')) <> ''").fetchall()}
    out = set()
    for d, text in docs.items():
        w = split(text)
        at = defaultdict(list)
        for k, x in enumerate(w):
            at[x].append(k)
        for i, item in items.items():
            need = min(13, 0.8 * len(item))
            shifts = Counter(k - j for j, x in enumerate(item) for k in at.get(x, ()))
            for shift, n in shifts.items():
                if n >= need:
                    lo, hi = max(0, -shift), min(len(item), len(w) - shift)
                    equal = np.array([w[shift + j] == item[j] for j in range(lo, hi)])
                    s, e = decontaminate.stretch(equal, 0.8)
                    if equal[s:e].sum() >= need:
                        out.add((d, i))
    return out


def test_decontamination(spark, docs):
    assert {(r.doc_id, r.item_id) for r in run(spark, "op9_decontamination")} == overlaps(docs)


def test_languages(spark, docs):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = run(spark, "op8_language_id")
    assert all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    got = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and re.search(r"[^\W\d_]", docs[r.doc_id])]
    assert np.mean(got) >= 0.9
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in docs[r.doc_id]))


def test_language_model(spark, docs):
    rows = run(spark, "op10_lm_score")
    words = {i: split(t) for i, t in docs.items()}
    train = [i for i in docs if not held(i, 7)]
    count = Counter(w for i in train for w in words[i])
    total, n = sum(count.values()) + len(train), len(train)
    low = math.log10(total + len(count) + 2)
    for r in rows:
        w = words[r.doc_id]
        base = sum(math.log10(count[x] + 1) for x in w) + math.log10(n + 1) - (len(w) + 1) * low
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7), len(w) + 1, sum(count[x] > 0 for x in w) + 1, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0


def test_licenses(spark, docs):
    rows = run(spark, "op2_license_scan")
    assert rows and all(0.8 <= r.containment <= 1 and r.doc_id in docs for r in rows)


def test_pipeline_end_to_end(spark, docs):
    """The stages by plain versions, each on what the one before kept."""
    model = queries.toxicity_model(spark, SF)
    kept = {i: t for i, t in docs.items() if model.score(t.encode()) < toxicity.THRESHOLD}
    last = {}
    for i, t in kept.items():
        last[t] = max(last.get(t, i), i)
    kept = {i: t for i, t in kept.items() if last[t] == i}
    order = sorted(kept)
    comp = components([kept[i] for i in order], corpus_pipeline.NEAR)
    kept = {i: kept[i] for k, i in enumerate(order) if comp[k] == k}
    gone = {d for d, _ in overlaps(kept)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept) - gone
    release(spark)
