"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled: affixes, character n-grams and membership in
the languages' lexicons give it a weight for each language, learned transitions
tie neighbouring words together, and forward-backward over the whole text gives
each word's posterior.  So a text that switches languages is labelled stretch by stretch;
its own language is the one with the largest mean posterior.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stable_seed, text_of, tune

#: Texts of each language to learn from at most, and characters beyond which a text isn't learned from.
SAMPLE_DOCS, SAMPLE_CHARS = 160, 12_000
#: Words of a language's lexicon.
LEXICON = 200
#: Features that occur less often in the sample are left out.
LEAST_COUNT = 3
#: Words of a block; what blocks of a text pass on to each other makes the chain exact over the whole text.
BLOCK = 48
#: Word forms that a process remembers.
CACHE_WORDS = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters; signs that only count as a number, such as fractions, separate them."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def features(word: str) -> list[str]:
    s = f"^{word}$"
    out = [s[:k] for k in (2, 3, 4) if len(s) > k] + [s[-k:] for k in (2, 3, 4) if len(s) > k]
    out += ["=" + s[i : i + 2] for i in range(1, len(s) - 2)]
    out += ["=" + s[i : i + 3] for i in range(len(s) - 2)]
    return out


@dataclass
class Model:
    """Weights over a vocabulary of features that the sample bounds."""

    langs: list[str]
    index: dict[str, int]
    lexicon: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "table": None}

    def ids_of(self, word: str) -> list[int]:
        get = self.index.get
        got = [i for f in features(word) if (i := get(f)) is not None]
        lex = self.lexicon.get(word)
        if lex is not None:
            got.append(lex)
        got.append(0)
        return got

    def emissions(self, forms: list[str]) -> np.ndarray:
        ids = [self.ids_of(w) for w in forms]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        return np.add.reduceat(self.weights[flat], first, axis=0)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Places in ``table`` of the words' emissions, exp'ed."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.table = None
        cache = self.cache
        new = [w for w in dict.fromkeys(tokens) if w not in cache]
        if new:
            e = self.emissions(new)
            e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
            self.table = e if self.table is None else np.concatenate([self.table, e])
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))

    def posteriors(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """For each text the posteriors [words, languages] of the chain over all its words."""
        n_of = [len(t) for t in tokens]
        flat = self.rows([w for t in tokens for w in t])
        if not len(flat):
            return [np.zeros((0, len(self.langs)), np.float32)] * len(tokens)
        out = chain_posteriors(self.table[flat], n_of, self.trans, self.start)
        first = np.concatenate([[0], np.cumsum(n_of)])
        return [out[first[i] : first[i + 1]] for i in range(len(tokens))]

    def languages(self, texts: list[str]) -> tuple[list[str], list[float]]:
        tokens = [words(t) for t in texts]
        names, scores = [], []
        for p in self.posteriors(tokens) if self.langs else [np.zeros((0, 0))] * len(texts):
            if not len(p):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                mean = p.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                names.append(self.langs[best])
                scores.append(float(min(1.0, mean[best])))
        return names, scores


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def chain_posteriors(factors: np.ndarray, n_of: list[int], trans: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posteriors [words, labels] of chains that lie one after the other in ``factors``, ``n_of`` words each; exact over whole chains.

    Chains are cut in blocks.  A block's product of transitions and factors is
    a small matrix; what comes before a block and after it passes through
    these, block after block, and then all blocks go forward and backward at
    once.
    """
    k = factors.shape[1]
    a = np.exp(trans - trans.max()).astype(np.float32)
    spans = [(i, s, min(block, n - s)) for i, n in enumerate(n_of) for s in range(0, n, block)]
    chain, begin, size = np.array(spans).T
    first = np.concatenate([[0], np.cumsum(n_of)])[chain] + begin
    order = np.argsort(-size, kind="stable")  # longer blocks first: at each step those still running lie in front
    at, size = first[order], size[order]
    running = [int((size > t).sum()) for t in range(int(size[0]))]
    opens = begin[order] == 0
    step_in = np.where(opens[:, None, None], np.eye(k, dtype=np.float32), a)
    product = step_in * factors[at][:, None, :]
    for t in range(1, len(running)):
        m = running[t]
        x = (product[:m] @ a) * factors[at[:m] + t][:, None, :]
        product[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # before[b]: what reaches a block; after[b]: what follows it
    before = np.empty((len(order), k), np.float32)
    after = np.ones((len(order), k), np.float32) / k
    before[place[begin == 0]] = _scaled(np.exp(start - start.max())).astype(np.float32)
    last = np.append(chain[1:] != chain[:-1], True)
    nth = begin // block
    by_nth = [np.flatnonzero(nth == j) for j in range(int(nth.max()) + 1)]
    for here in by_nth[1:]:
        p = place[here - 1]
        before[place[here]] = _scaled(np.einsum("bi,bij->bj", before[p], product[p]))
    for here in reversed(by_nth):
        inner = here[~last[here]]
        p = place[inner + 1]
        after[place[inner]] = _scaled(np.einsum("bij,bj->bi", product[p], after[p]))
    out = np.empty_like(factors, dtype=np.float32)
    alpha = np.where(opens[:, None], before, before @ a) * factors[at]
    alpha = _scaled(alpha)
    out[at] = alpha
    for t in range(1, len(running)):
        m = running[t]
        alpha = _scaled((alpha[:m] @ a) * factors[at[:m] + t])
        out[at[:m] + t] = alpha
    beta = after
    for t in range(len(running) - 1, -1, -1):
        m = running[t]
        here = at[:m] + t
        out[here] = _scaled(out[here] * beta[:m])
        beta[:m] = _scaled((beta[:m] * factors[here]) @ a.T)
    return out


def fit(texts: list[str], langs: list[str], steps: int = 60, rate: float = 0.15, l2: float = 1e-4) -> Model:
    """Learns weights and transitions on whole windows of 64 words, some spliced from two languages so that switches occur."""
    names = sorted(set(langs))
    tokens = [words(t) for t in texts]
    counts: Counter = Counter()
    by_lang: dict[str, Counter] = {x: Counter() for x in names}
    for t, x in zip(tokens, langs, strict=True):
        by_lang[x].update(t)
    for c in by_lang.values():
        for w in c:
            counts.update(set(features(w)))
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, c in counts.items() if c >= LEAST_COUNT))}
    lexicon: dict[str, int] = {}
    k = len(names)
    n_feat = len(index) + 1
    shared = Counter(w for c in by_lang.values() for w, _ in c.most_common(LEXICON))
    for j, x in enumerate(names):
        for w, _ in by_lang[x].most_common(LEXICON):
            if shared[w] == 1:
                lexicon[w] = n_feat + j
    model = Model(names, index, lexicon, np.zeros((n_feat + k, k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(stable_seed("crf", k))
    width = 64
    seqs, labels = [], []
    for t, x in zip(tokens, langs, strict=True):
        for lo in range(0, len(t), width):
            seqs.append(t[lo : lo + width])
            labels.append([names.index(x)] * len(seqs[-1]))
    if not seqs:
        return Model([], {}, {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    order = rng.permutation(len(seqs))
    for i, j in zip(order[::4], order[1::4], strict=False):  # a quarter switches once
        if min(len(seqs[i]), len(seqs[j])) < 2:
            continue
        cut = int(rng.integers(1, min(len(seqs[i]), len(seqs[j]))))
        seqs[i], labels[i] = seqs[i][:cut] + seqs[j][cut:], labels[i][:cut] + labels[j][cut:]
    forms = sorted({w for s in seqs for w in s})
    form_at = {w: i for i, w in enumerate(forms)}
    ids = [model.ids_of(w) for w in forms]
    size = np.array([len(x) for x in ids])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate([np.array(x) for x in ids])
    owner = np.repeat(np.arange(len(forms)), size)
    grid = np.zeros((len(seqs), width), np.int64)
    gold = np.zeros((len(seqs), width), np.int64)
    valid = np.zeros((len(seqs), width), bool)
    for i, (s, y) in enumerate(zip(seqs, labels, strict=True)):
        grid[i, : len(s)] = [form_at[w] for w in s]
        gold[i, : len(s)] = y
        valid[i, : len(s)] = True
    one = np.eye(k)
    cache = [np.zeros_like(model.weights), np.zeros_like(model.trans), np.zeros_like(model.start)]
    batch = 256
    for _ in range(max(steps, 4 * -(-len(seqs) // batch))):
        pick = rng.permutation(len(seqs))[:batch] if len(seqs) > batch else np.arange(len(seqs))
        g, y, v = grid[pick], gold[pick], valid[pick]
        used, inv = np.unique(g, return_inverse=True)
        inv = inv.reshape(g.shape)
        mine = np.isin(owner, used)
        sub_first = np.concatenate([[0], np.cumsum(size[used])[:-1]])
        emit = np.add.reduceat(model.weights[flat[mine]], sub_first, axis=0)
        e = np.exp(emit - emit.max(axis=1, keepdims=True))[inv]
        e[~v] = 1.0
        a = np.exp(model.trans)
        e = e.transpose(1, 0, 2)
        alpha = np.empty_like(e)
        alpha[0] = np.exp(model.start) * e[0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for t in range(1, width):
            x = (alpha[t - 1] @ a) * e[t]
            alpha[t] = x / x.sum(axis=1, keepdims=True)
        beta = np.ones_like(e[0])
        node = np.empty_like(e)
        node[-1] = alpha[-1]
        pair = np.zeros((k, k))
        for t in range(width - 2, -1, -1):
            be = beta * e[t + 1]
            joint = alpha[t][:, :, None] * a * be[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            on = v[:, t + 1]
            pair += joint[on].sum(axis=0)
            node[t] = joint.sum(axis=2)
            beta = be @ a.T
            beta /= beta.sum(axis=1, keepdims=True)
        node = node.transpose(1, 0, 2)
        diff = (one[y] - node)[v]
        g_form = np.stack([np.bincount(inv[v], diff[:, j], len(used)) for j in range(k)], axis=1)
        g_w = np.zeros_like(model.weights)
        rep = np.repeat(g_form, size[used], axis=0)
        for j in range(k):
            g_w[:, j] = np.bincount(flat[mine], rep[:, j], len(g_w))
        both = v[:, 1:] & v[:, :-1]
        g_t = np.bincount((y[:, :-1] * k + y[:, 1:])[both], minlength=k * k).reshape(k, k) - pair
        g_s = (one[y[:, 0]] - node[:, 0]).sum(axis=0)
        n = len(pick)
        for p, gr, c in zip((model.weights, model.trans, model.start), (g_w, g_t, g_s), cache, strict=True):
            gr = gr / n - l2 * p
            c += gr * gr
            p += rate * gr / (np.sqrt(c) + 1e-8)
    return model


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_DOCS) -> Model:
    """A model from rows with a language; about ``per_lang`` of each are taken, by hash of id and text, and repeated rows once.

    Texts of any number of words are learned from.  Without labelled rows the
    model knows no language.
    """
    lang = F.col(lang_col).cast("string")
    rows = labelled.where(lang.isNotNull() & (F.length(text_col) <= SAMPLE_CHARS)).select(lang.alias("lang"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for kv in ((k, min(1.0, per_lang / n)) for k, n in sorted(counts.items())) for x in kv])
    draw = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(draw < share[F.col("lang")]).select("lang", "t").distinct().collect()
    got.sort(key=lambda r: (r["lang"], r["t"]))
    return fit([r["t"] for r in got], [r["lang"] for r in got])


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; ``und`` with score 0 where the text is null or has no letter.

    The score is the mean posterior of the language over all words; of
    languages with equal means the first by name is taken.  Long texts are
    labelled whole; repeated rows have equal results; an empty table gives no
    rows, and a model without languages calls every text ``und``.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        names, scores = shared.value.languages(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": pa.array(names), "score": pa.array(scores, pa.float64())}

    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")


def labelled_words(texts: list[str], model: Model) -> list[list[tuple[str, str, float]]]:
    """(word, language, posterior) for each word of each text."""
    tokens = [words(t) for t in texts]
    return [
        [(w, model.langs[int(p.argmax())], float(p.max())) for w, p in zip(t, post, strict=True)]
        for t, post in zip(tokens, model.posteriors(tokens), strict=True)
    ]
