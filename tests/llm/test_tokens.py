"""Token counts, packing and language-model scores: brute force, round trips, held-out likelihood."""

import math
import os
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from svloom.llm import attention as at
from svloom.llm import lm_score, packing, token_counts
from svloom.llm import tokens as tk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer_file(tokenizer, monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", " a  b\n\n c's <|endoftext|> é漢字 12345 !?", "<|endoftext|><|endoftext|> x<|endoftext|>  y <|endoftext |>", "".join(rng.choices("ab c'sé\n1!", k=3000)), " ".join("".join(rng.choices("abcdé", k=5)) for _ in range(900))]
    for limit in (1 << 20, 200):
        monkeypatch.setattr(tk, "PART_CHARS", limit)
        for t in texts:
            assert tk.encode(t, tk.default_ranks()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", "\u0085", "a", "the", "'s", "é", "à", "漢", "😀", "12", "!", "<|endoftext|>", "<|", "|>"]), max_size=30).map("".join), max_size=6))
def test_texts_encoded_together_have_their_own_ids(texts):
    got = tk.encode_all([t.encode() for t in texts], tk.default_ranks())
    assert [x.tolist() for x in got] == [tk.encode(t, tk.default_ranks()).tolist() for t in texts]


def test_a_stretch_that_comes_again_is_encoded_once(spark, monkeypatch):
    texts = ["the quick brown fox jumps " * 400, "", "over the quick brown fox " * 400]
    asked = []
    plain = tk._ids
    monkeypatch.setattr(tk, "_ids", lambda enc, text: asked.append(len(text)) or plain(enc, text))
    got = tk.encode_all([t.encode() for t in texts], tk.default_ranks())
    assert sum(asked) < 100 and [x.tolist() for x in got] == [plain(tk.encoder(tk.default_ranks()), t).tolist() for t in texts]
    rows = spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    kept = {r.doc_id: bytes(r.b) for r in lm_score._blocks(rows, tk.default_ranks(), 1).collect() if r.kind == lm_score._DOC}
    assert kept == {k: x.astype(np.uint16).tobytes() for k, x in enumerate(got)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_places_every_piece_once(counts):
    got = packing.plan(counts, 40)
    used = Counter()
    for content, times in got:
        assert times > 0 and sum(content) <= 40
        for size in content:
            used[size] += times
    assert used == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in got) <= max(1, math.ceil(total / 40 * 11 / 9) + 1) + sum(n for k, n in counts.items() if k > 20)
    slots = packing.Slots.of(got, 40) if counts else None
    for size, n in counts.items():
        seq, off = slots.place(np.full(n, size), np.arange(n))
        assert len(set(zip(seq.tolist(), off.tolist(), strict=True))) == n


def test_exact_complements_leave_nothing():
    assert packing.plan({10: 4, 30: 4}, 40) == [((30, 10), 4)]
    assert packing.plan({25: 3, 10: 3, 5: 3}, 40) == [((25, 10, 5), 3)]
    assert packing.plan({22: 2, 9: 1, 10: 1, 6: 1, 5: 1, 3: 2}, 40) == [((22, 10, 5, 3), 1), ((22, 9, 6, 3), 1)]


def test_packing_round_trip(odd, odd_rows, none, tokenizer):
    got = packing.pack(odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), capacity=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rows in by_seq.values():
        at_ = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at_ and r.length == len(r.ids)
            at_ += r.length
        assert at_ <= 64
    want = Counter()
    for r in odd_rows:
        want[-1 if r[0] is None else r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])] += 1
    for (doc, ids), n in want.items():
        if n == 1 and doc != -1:
            rows = sorted(by_doc[doc], key=lambda r: r.piece)
            assert [x for r in rows for x in r.ids] == list(ids)
            assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
            assert all(r.length == 64 for r in rows[1:])
    assert packing.pack(none).count() == 0
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())


def test_token_counts(odd, odd_rows, none, tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "SPAN", 7)
    n = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    sums = token_counts.token_counts(odd)
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(n)
    for size, r in rows.items():
        assert r.n_docs == n.count(size) and r.docs_at_least == sum(x >= size for x in n) and r.tokens_at_least == sum(x for x in n if x >= size)
        assert r.docs_up_to == sum(x <= size for x in n) and r.truncated_total == sum(min(x, size) for x in n) and r.total_tokens == sum(n)
    assert token_counts.truncated_total(sums, 33).first().tokens == sum(min(x, 33) for x in n)
    for q in (0.0, 0.25, 0.5, 1.0):
        assert token_counts.quantile(sums, q).first().length == sorted(n)[max(1, math.ceil(q * len(n))) - 1]
    assert token_counts.token_counts(none).count() == 0


def test_lm_scores(spark, odd, odd_rows, none):
    held = F.col("doc_id") % 3 == 0
    got = lm_score.lm_scores(odd, held, range_words=50).collect()
    train, docs = Counter(), 0
    split = lambda t: [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
    for r in odd_rows:
        if r[0] is None or r[0] % 3:
            train.update(split(r[1]))
            docs += 1
    low = math.log10(sum(train.values()) + docs + len(train) + 1 + 1)
    want = Counter()
    for r in odd_rows:
        w = split(r[1])
        base = sum(math.log10(train[x] + 1) for x in w) + math.log10(docs + 1) - (len(w) + 1) * low
        want[r[0], r[0] is not None and r[0] % 3 == 0, len(w) + 1, sum(train[x] > 0 for x in w) + 1, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {sum(train.values()) + docs}
    assert all(r.score < 0 for r in got)
    assert lm_score.lm_scores(none, held).count() == 0


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    cls = rng.integers(0, at.CLASSES, 31)
    shapes = {"token": (31, 16), "class": (64, 16), "place": (64, 16), "q": (16, 16), "k": (16, 16), "v": (16, 16), "o": (16, 16), "up": (16, 32), "up_b": (32,), "down": (32, 16), "out": (16, 64), "out_b": (64,)}
    w = {k: rng.standard_normal(s) * 0.2 for k, s in shapes.items()}
    ids, target, on = rng.integers(0, 31, (3, 12)), rng.integers(0, 64, (3, 12)), np.ones((3, 12))
    _, g, rows = at.gradients(w, cls, ids, target, on)
    assert rows.tolist() == np.unique(ids).tolist()
    g["token"] = np.stack([g["token"][rows.tolist().index(t)] if t in rows else np.zeros(16) for t in range(31)])
    for k, x in w.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), x.shape)
        x[i] += 1e-5
        up = at.gradients(w, cls, ids, target, on)[0]
        x[i] -= 2e-5
        down = at.gradients(w, cls, ids, target, on)[0]
        x[i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-5)
    # nothing after a place changes what is predicted there
    more = ids.copy()
    more[:, 8:] = 0
    assert np.allclose(at.forward(w, cls, ids)[0][:, :8], at.forward(w, cls, more)[0][:, :8])


def test_attention_learns_and_scores_each_token_once():
    rng = np.random.default_rng(1)
    vocab, end = 51, 50
    texts = [np.array([(7 * k + s) % 40 for k in range(int(rng.integers(5, 200)))], np.uint32) for s in range(60)]
    counts = np.bincount(np.concatenate(texts[:40]).astype(int), minlength=vocab)
    around = np.zeros((vocab + 1, 2 * at.SLOTS))
    slot = at.neighbour_slots(vocab + 1)
    for t in texts[:40]:
        for a, b in zip(t[:-1].tolist(), t[1:].tolist(), strict=True):
            around[b, slot[a]] += 1
            around[a, at.SLOTS + slot[b]] += 1
    cls = at.classes(np.append(counts, 0), around, end)
    windows = np.array([at.window_of(t, k, vocab, end) for t in texts[:40] for k in range(-(-(len(t) + 1) // at.WINDOW))])
    m = at.Model(at.warm_up(windows, cls, vocab, end, passes=120), cls)
    m = at.with_counts(m, counts, end)
    got = m.score_ids(texts[40:], end)
    assert np.allclose(got, [m.score_ids([t], end)[0] for t in texts[40:]], atol=1e-3)
    n = sum(len(t) + 1 for t in texts[40:])
    assert -sum(got) / n < 0.75 * math.log10(40)
    # the sum of a chain's probabilities over the vocabulary is one
    one = [m.score_ids([np.array([3, t], np.uint32)], end)[0] - m.score_ids([np.array([3], np.uint32)], end)[0] for t in (1, 2)]
    assert all(np.isfinite(one))
    assert sum(10 ** m.share[:50][m.cls[:50] == c].max() > 0 for c in set(m.cls[:50])) == len(set(m.cls[:50]))


def test_training_windows_cover_a_text():
    ids = np.arange(200, dtype=np.uint16)
    seq = [500, *range(200), 499]
    for n in (0, 1, 63, 64, 65, 200):
        count = -(-(n + 1) // at.WINDOW)
        got = [at.window_of(ids[:n], k, 500, 499) for k in range(count)]
        own = [500, *seq[1 : n + 1], 499]
        for k, w in enumerate(got):
            part = own[k * 64 : k * 64 + 65]
            assert w.tolist() == part + [499] * (65 - len(part))
        assert len(lm_score._windows(ids[:n], 8, 500, 499)) == 1 and len(lm_score._windows(ids[:n], 1, 500, 499)) == count


def test_what_the_model_takes_from_the_corpus(spark):
    """Neighbour counts against plain ones; what tasks learn lowers the loss, and every training text is learned from."""
    rng = random.Random(12)
    vocab = 61
    texts = [[rng.randrange(20) * 3 % 60 for _ in range(rng.randint(0, 150))] for _ in range(80)]
    rows = [(bytearray(np.array(t, np.uint16).tobytes()),) for t in texts]
    df = spark.createDataFrame(rows, "b binary").repartition(3)
    table = lm_score.neighbour_counts(df, vocab)
    slot = at.neighbour_slots(vocab + 1)
    want = np.zeros((vocab + 1, 1 + 2 * at.SLOTS))
    for t in texts:
        for x in t:
            want[x, 0] += 1
        for a, b in zip(t[:-1], t[1:], strict=True):
            want[b, 1 + slot[a]] += 1
            want[a, 1 + at.SLOTS + slot[b]] += 1
    assert (table == want).all()
    cls = at.classes(table[:, 0], table[:, 1:], vocab - 1)
    start = at.fresh_weights(vocab)
    windows = np.array([w for t in texts for w in lm_score._windows(np.array(t, np.uint16), 1, vocab, vocab - 1)])
    drawn = lm_score.start_windows(df, vocab, 1.0)
    assert sorted(bytes(r.w) for r in drawn.collect()) == sorted(w.astype(np.int32).tobytes() for w in windows)

    def loss(w):
        on = np.cumsum(windows[:, :-1] == vocab - 1, axis=1) == 0
        return at.gradients(w, cls, windows[:, :-1], cls[windows[:, 1:]], on.astype(np.float32))[0]

    assert loss(lm_score.start_weights(drawn, cls, vocab)) < loss(start)
    after = lm_score.learned_everywhere(df, start, cls, vocab)
    assert loss(after) < loss(start)
    used = {x for t in texts for w in lm_score._windows(np.array(t, np.uint16), lm_score.EVERY, vocab, vocab - 1) for x in w[:-1].tolist()}
    moved = set(np.flatnonzero((after["token"] != start["token"]).any(axis=1)).tolist())
    assert moved and moved <= used


def test_every_window_of_every_training_text_is_learned_from(spark):
    vocab = 900
    texts = [np.arange(600, dtype=np.uint16), np.arange(600, 663, dtype=np.uint16), np.arange(700, 830, dtype=np.uint16), np.zeros(0, np.uint16)]
    df = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "b binary").repartition(2)
    start = at.fresh_weights(vocab)
    after = lm_score.learned_everywhere(df, start, np.arange(vocab + 1) % at.CLASSES, vocab)
    moved = np.flatnonzero((after["token"] != start["token"]).any(axis=1)).tolist()
    assert moved == sorted({x for t in texts for x in t.tolist()} | {vocab})


@pytest.mark.parametrize("size", [1, 30])
def test_gradients_take_the_same_loss_as_the_plain_model(size):
    """Several parts of windows, and values beyond what exponentials can take."""
    rng = np.random.default_rng(8)
    w = {k: x.astype(np.float64) * size for k, x in at.fresh_weights(80).items()}
    w["token"] = rng.standard_normal(w["token"].shape) * 0.3 * size
    cls, ids, target = rng.integers(0, at.CLASSES, 81), rng.integers(0, 81, (37, 64)), rng.integers(0, at.CLASSES, (37, 64))
    on = (rng.random(ids.shape) < 0.8).astype(float)
    logp = at.forward(w, cls, ids)[0]
    want = -(np.take_along_axis(logp, target[:, :, None], axis=2)[:, :, 0] * on).sum() / on.sum()
    loss, g, rows = at.gradients(w, cls, ids, target, on)
    assert loss == pytest.approx(want, rel=1e-6) and rows.tolist() == np.unique(ids).tolist()
    assert all(np.isfinite(x).all() and x.shape == (w[k].shape if k != "token" else (len(rows), at.WIDTH)) for k, x in g.items())


@pytest.mark.parametrize("numbers", [[], [0], [0, 0, 7], [5, 65_540, 65_541], [1, 70_000, 3_000_000]])
def test_word_numbers_as_steps(numbers):
    raw = lm_score._steps(np.array(numbers, np.int32))
    assert lm_score._from_steps(raw).tolist() == numbers and raw[0] == (4 if max(np.diff(numbers, prepend=0), default=0) > 65_535 else 2)


@pytest.mark.parametrize("size", [1, 8])
def test_scores_are_those_of_the_plain_model(size):
    """Texts of all lengths, all windows of them, and values whose exponentials are out of range."""
    rng = np.random.default_rng(5)
    vocab, end = 81, 80
    w = {k: x * np.float32(size) for k, x in at.fresh_weights(vocab).items()}
    w["token"] = (rng.standard_normal(w["token"].shape) * 0.3 * size).astype(np.float32)
    m = at.with_counts(at.Model(w, rng.integers(0, at.CLASSES, vocab + 1)), rng.integers(0, 9, vocab), end)
    texts = [rng.integers(0, 80, n).astype(np.uint16) for n in (0, 1, 62, 63, 64, 65, 110, 111, 112, 113, 5000)]
    wide = {k: x.astype(np.float64) for k, x in w.items()}
    for ids, got in zip(texts, m.score_ids(texts, end), strict=True):
        seq, want = [vocab, *ids.tolist(), end], 0.0
        for lo in range(0, max(1, len(ids) + 1 - at.WINDOW + at.FRESH), at.FRESH):
            x = np.array(seq[lo : lo + at.WINDOW + 1])
            logp = at.forward(wide, m.cls, x[None, :-1])[0][0]
            fresh = range(0 if lo == 0 else at.WINDOW - at.FRESH, len(x) - 1)
            want += sum(logp[p, m.cls[x[p + 1]]] / math.log(10) + m.share[x[p + 1]] for p in fresh)
        assert got == pytest.approx(want, rel=1e-4)
    assert m.score_ids([], end) == []


def test_scoring_stays_near_the_core():
    """Tables that a batch of windows needs beside the model's; page faults for larger ones took over a third of the time."""
    vocab = 81
    m = at.with_counts(at.Model(at.fresh_weights(vocab), np.arange(vocab + 1) % at.CLASSES), np.ones(vocab), vocab - 1)
    text = [np.arange(48 * 600, dtype=np.uint16) % 80]
    m.score_ids(text, vocab - 1)
    tracemalloc.start()
    try:
        m.score_ids(text, vocab - 1)
        assert tracemalloc.get_traced_memory()[1] < 5e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("words", [[], [b"a"], [b"b", b"a", b"b", b"c", b"a"]])
def test_blocks_number_words_in_the_order_of_hashes(spark, words):
    rows = spark.createDataFrame([(1, b" ".join(words).decode(), False)], "doc_id long, text string, held_out boolean")
    got = lm_score._blocks(rows, tk.default_ranks(), 1).collect()
    sent = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.a, np.uint64) for r in got if r.kind == lm_score._WORDS)])
    (own,) = (lm_score._from_steps(bytes(r.a)) for r in got if r.kind == lm_score._DOC)
    assert (np.diff(sent.astype(object)) > 0).all() and len(sent) == len(set(words))
    assert sorted(Counter(own.tolist()).values()) == sorted(Counter(words).values())


def test_products_of_weights_that_only_meet_are_taken_once():
    """Queries with keys, and values with what they go through, are one matrix each; scores are those of ``forward``."""
    rng = np.random.default_rng(4)
    w = {k: x + rng.normal(0, 0.1, x.shape).astype(np.float32) for k, x in at.fresh_weights(50).items()}
    m = at._joined(w, at.WIDTH, np.dtype(np.float32))
    assert np.allclose(m["q"][:-1], w["q"] @ w["k"].T / 4, atol=1e-6) and np.allclose(m["v"][:-1, :-1], w["v"] @ w["o"], atol=1e-6)
    assert not {"o", "qk", "back_o"} & set(m)
    cls, ids = rng.integers(0, at.CLASSES, 51), rng.integers(0, 51, (3, at.WINDOW))
    want = cls[rng.integers(0, 51, (3, at.WINDOW))]
    plain = np.take_along_axis(at.forward(w, cls, ids)[0], want[:, :, None], 2)[:, :, 0] / np.log(10)
    got = at.class_logp(at.Model(w, cls).joined(), ids, np.ones(ids.shape, bool), want.ravel())
    assert np.allclose(got, plain.ravel(), atol=1e-4)


def test_learning_keeps_the_memory_that_it_frees():
    """In a process of its own: 3,211 page faults a step before, which took half of its time."""
    steps = """
import resource
import numpy as np
from svloom.llm import attention as at
t = at.Trainer(at.fresh_weights(900), np.arange(901) % at.CLASSES, 899)
windows = np.random.default_rng(1).integers(0, 899, (at.TRAIN_BATCH, at.WINDOW + 1))
for k in range(9):
    if k == 4:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    t.step(windows, 1e-3)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 5)
"""
    got = subprocess.run([sys.executable, "-c", steps], env={**os.environ, "OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True)
    assert float(got.stdout) < 300
