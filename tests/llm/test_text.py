"""PII, licences, contamination, toxicity, languages: brute force and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from svloom.llm import decontaminate as de
from svloom.llm import language_id as li
from svloom.llm import licenses as ls
from svloom.llm import pii
from svloom.llm import toxicity as tx
from svloom.llm.words import words_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a.@-+0123 (5)é_%", max_size=60), st.text("0123456789 -.", max_size=70), st.text("ab@.", max_size=30)))
def test_base_spans_equal_the_patterns(text):
    assert pii.joined([s for s in pii.spans_of(text) if s.kind in pii.BASE_KINDS]) == plain_spans(text)


def test_added_spans():
    got = {s.kind: (s.start, s.end) for s in pii.spans_of('see https://u:p@ex.org/a?b=1. token = "a1b2c3d4" end')}
    assert got["url"] == (4, 28) and got["account"] == (39, 47)


def test_pii_rows(odd, odd_rows, none):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(odd_rows) and all(r.found == [] for r in got)
    assert pii.find_pii(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é\t\n\x0b.", max_size=40), max_size=6))
def test_vector_words(texts):
    raw = [t.encode() for t in texts]
    w = words_of(raw)
    seen = {}
    for i, t in enumerate(raw):
        want = [x for x in re.split(rb"[\x20\x09-\x0D]+", t.lower()) if x]
        at = w.of(i)
        assert [bytes(w.data[a:b]) for a, b in zip(w.start[at], w.end[at], strict=True)] == want
        for x, h in zip(want, w.hash[at].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def filler(rng, n):
    return " ".join("".join(rng.choices("klmnopqr", k=rng.randint(2, 6))) for _ in range(n))


def test_licenses_are_found_wherever_they_stand(spark, odd, none):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(150):
        name, text = ls.TEMPLATES[i % len(ls.TEMPLATES)]
        if i % 3:
            rows.append((i, f"{filler(rng, rng.randint(0, 90))}\n{text.upper() if i % 2 else text}\n{filler(rng, rng.randint(0, 90))}"))
            want.add((i, name))
        else:
            rows.append((i, filler(rng, 100) + " licensed under the " + filler(rng, 3)))
    got = {(r.doc_id, r.license) for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").collect()}
    assert got == want
    assert ls.scan_licenses(odd).count() == 0 and ls.scan_licenses(none).count() == 0
    with pytest.raises(ValueError):
        ls.Index.of([("none", " . ")])
    short = ls.Index.of([("short", "too short"), ("one", "Word")])
    assert ls.scan([b"it is Too short, a word", b"short", b"too", b"word too short"], short, 0.8) == [(0, 0, 1.0, 2, 4), (0, 1, 1.0, 5, 6), (3, 0, 1.0, 1, 3), (3, 1, 1.0, 0, 1)]


def test_partial_licenses_against_brute_force():
    """Every template with each one of its words, or its first or last few, replaced: found just if enough shingles are left."""
    rng = random.Random(17)
    index = ls.Index.of(ls.TEMPLATES)
    texts, want = [], set()

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    plain = {name: re.findall(r"[a-z0-9]+", text.lower()) for name, text in ls.TEMPLATES}
    for name, own in plain.items():
        for gone in [{k} for k in range(len(own))] + [set(range(n)) for n in (2, 3)] + [set(range(len(own) - n, len(own))) for n in (2, 3)]:
            w = ["zq" if k in gone else x for k, x in enumerate(own)]
            texts.append(" ".join([*filler(rng, rng.randint(0, 40)).split(), *w, *filler(rng, rng.randint(0, 40)).split()]))
            for t, words_ in plain.items():
                if len(words_) >= 5:
                    share = len(grams(words_) & grams(w)) / len(grams(words_))
                    if share >= 0.8:
                        want.add((len(texts) - 1, t))
    got = {(i, index.names[t]) for i, t, *_ in ls.scan([x.encode() for x in texts], index, 0.8)}
    assert {x for x in got if x[1] != "All-rights-reserved"} == want and len(want) > 50


def test_contamination(spark, odd, none):
    rng = random.Random(6)
    items = [(k, filler(rng, rng.randint(15, 50))) for k in range(30)] + [(90, None), (91, "")]
    tests = spark.createDataFrame([*items, (95, items[3][1])], "item_id long, text string")
    rows, want = [], set()
    for i in range(120):
        k, text = items[i % 30]
        w = text.split()
        if i % 4 == 0:  # every ninth word another
            w = [x if j % 9 != 4 else "zzz" for j, x in enumerate(w)]
        if i % 4 == 3:
            w = filler(rng, 30).split()
        else:
            want.add((i, k))
            if k == 3:  # an item of the same text
                want.add((i, 95))
        rows.append((i, " ".join([filler(rng, rng.randint(0, 60)), *w, filler(rng, rng.randint(0, 60))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (de.BLOCK_BYTES, 2000):
        assert {(r.doc_id, r.item_id) for r in de.contaminated(docs, tests, block_bytes=block).collect()} == want
    kept = de.decontaminate(docs, tests)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 4 == 3}
    assert de.decontaminate(odd, tests).columns == odd.columns and de.decontaminate(odd, tests).count() == odd.count()
    assert de.contaminated(none, tests).count() == 0 and de.contaminated(docs, tests.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_longest_stretch(equal):
    e = np.array(equal)
    s, t = de.stretch(e, 0.8)
    best = max((int(e[a:b].sum()) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a:b].mean() >= 0.8 - 1e-12), default=0)
    longest = max((b - a for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a:b].mean() >= 0.8 - 1e-12), default=0)
    assert t - s <= longest and (t == s) == (longest == 0) and int(e[s:t].sum()) >= 0.8 * best - 1


def labelled(rng, n):
    bad = ["gralk", "vroxen", "shmolt"]
    out = []
    for i in range(n):
        w = filler(rng, rng.randint(30, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_on_rows_not_learned_from(spark, odd, odd_rows, none):
    rows = labelled(random.Random(7), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400] + [(1, None)], "doc_id long, toxic int")
    model = tx.learn(docs, labels)
    got = {r.doc_id: r.score for r in tx.scored(docs, model).collect() if r.doc_id >= 400}
    assert all(0 <= s <= 1 for s in got.values())
    hits = [got[r[0]] >= tx.THRESHOLD for r in rows if r[0] >= 400 and r[2]]
    false = [got[r[0]] >= tx.THRESHOLD for r in rows if r[0] >= 400 and not r[2]]
    assert sum(hits) >= 0.95 * len(hits) and sum(false) <= 0.03 * len(false)
    assert tx.scored(odd, model).count() == len(odd_rows) and tx.scored(none, model).count() == 0
    assert tx.without_toxic(odd, model).columns == odd.columns
    flat = tx.learn(docs, labels.limit(0))
    assert tx.scored(docs.limit(1), flat).first().score < tx.THRESHOLD


def test_languages(spark, odd, odd_rows, none):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "do", "ki", "lum"], "bb": ["ster", "geth", "unk", "bo"], "cc": ["iño", "quá", "re", "lum"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, rng.randint(20, 90)), lang) for i, lang in enumerate(sorted(sounds) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df.where("doc_id < 120"))
    got = {r.doc_id: r.lang_pred for r in li.identified(df, model).collect()}
    right = [got[i] == lang for i, _, lang in rows if i >= 120]
    assert np.mean(right) >= 0.97
    mixed = text("aa", 20) + " " + text("bb", 20)
    tags = [x[1] for x in li.labelled_words([mixed], model)[0]]
    assert np.mean([t == "aa" for t in tags[:20]]) > 0.8 and np.mean([t == "bb" for t in tags[20:]]) > 0.8
    odd_got = {(r.doc_id, r.lang_pred) for r in li.identified(odd, model).collect() if r.doc_id in (3, 4, 5)}
    assert odd_got == {(3, "und"), (4, "und"), (5, "und")}
    assert li.identified(none, model).count() == 0
    assert {r.lang_pred for r in li.identified(df.limit(3), li.learn(df.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("block", [1, 2, 3, 48])
def test_chain_against_enumeration(block):
    from itertools import product

    rng = np.random.default_rng(1)
    sizes = [4, 0, 1, 6, 3]
    e, a, s = rng.random((sum(sizes), 3)).astype(np.float32) + 0.1, rng.standard_normal((3, 3)), rng.standard_normal(3)
    got = li.chain_posteriors(e.copy(), sizes, a, s, block)
    lo = 0
    for n in sizes:
        want = np.zeros((n, 3))
        for y in product(range(3), repeat=n):
            if n:
                p = np.exp(s[y[0]] + sum(a[y[k], y[k + 1]] for k in range(n - 1))) * np.prod([e[lo + k, y[k]] for k in range(n)])
                for k in range(n):
                    want[k, y[k]] += p
        assert np.allclose(got[lo : lo + n], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        lo += n


def test_long_chains_are_exact_and_signs_are_no_letters():
    rng = np.random.default_rng(2)
    e, a, s = rng.random((5000, 4)).astype(np.float32) + 1e-4, rng.standard_normal((4, 4)), rng.standard_normal(4)
    one, whole = li.chain_posteriors(e.copy(), [5000], a, s, 48), li.chain_posteriors(e.copy(), [5000], a, s, 5000)
    assert np.allclose(one, whole, atol=1e-4)
    assert li.words("½ ² Ⅷ 12_3") == [] and li.words("Ab½cd É") == ["ab", "cd", "é"]


def test_languages_of_short_labelled_texts():
    model = li.fit(["ba do ki"] * 50 + ["ster unk"] * 50 + ["bo"] * 3, ["aa"] * 50 + ["bb"] * 53)
    assert model.languages(["do ba", "unk ster", "½"])[0] == ["aa", "bb", "und"]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 8, 11, 13, 16, 24])
def test_seeds_miss_no_allowed_substitution(size):
    """Every pattern of substitutions that the rule allows (for long items, many drawn ones) is found, at a text's edges too."""
    from itertools import combinations

    rng = random.Random(size)
    item = [f"w{k}" for k in range(size)]
    seeds = de.Seeds.of([0], [" ".join(item).encode()])
    spare = int(size * 0.2 + 1e-9)
    patterns = list(combinations(range(size), spare))
    if len(patterns) > 400:
        patterns = rng.sample(patterns, 400)
    for gone in patterns:
        text = ["zz" if k in gone else w for k, w in enumerate(item)]
        for pad in (0, 3):
            assert de.find([" ".join(["y"] * pad + text + ["y"] * pad).encode()], seeds, 0.8, 13), gone
    if size > 1:
        assert not de.find([" ".join(reversed(item)).encode()], seeds, 0.8, 13)
    assert not de.find([b"a b c d e f g h"], seeds, 0.8, 13)


def test_repetitive_item_in_repetitive_text():
    seeds = de.Seeds.of([0], [b"ha " * 60])
    got = de.find([b"ha " * 30_000, b"ho " * 50], seeds, 0.8, 13)
    assert [(x[0], x[2]) for x in got] == [(0, 60)]


@pytest.mark.parametrize("unit", ["://", "a://", "+1 (", "a@", "1.2.", "iban ", "IBAN: a", "12-"])
def test_personal_data_of_adversarial_texts(unit):
    """A megabyte of anchors that lead nowhere takes time in proportion."""
    import time

    from svloom.llm.pii import spans_of

    def seconds(n):
        begun = time.process_time()
        spans_of(unit * (n // len(unit)))
        return time.process_time() - begun

    seconds(1000)
    assert seconds(1_000_000) < 40 * max(seconds(100_000), 0.02)
