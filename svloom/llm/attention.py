"""A small causal self-attention model over subword ids, in numpy.

A token's probability is that of its class given what precedes it, which the
model predicts, times its share of the class in the whole training corpus.
Classes are clusters of tokens with like neighbours in that corpus.  Texts are scored in
overlapping windows: each window sees ``WINDOW`` tokens, and scores those that
the window before it hasn't.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

WINDOW, FRESH = 64, 48
WIDTH, HIDDEN, CLASSES = 16, 32, 64
#: Windows that one batch scores (what they need stays near the core), and that one step of training takes.
BATCH, TRAIN_BATCH = 128, 128
#: Attention scores and logits stop here, in training as in scoring, so that their exponentials stay finite.
MOST_SCORE, MOST_LOGIT = np.float32(60), np.float32(80)
#: Neighbours are counted by so many hashed slots on either side.
SLOTS = 32


@dataclass
class Model:
    """All arrays have sizes that the vocabulary and the settings fix."""

    weights: dict[str, np.ndarray]
    cls: np.ndarray
    share: np.ndarray | None = None
    ready: dict[str, np.ndarray] | None = None

    def joined(self) -> dict[str, np.ndarray]:
        """The weights as scoring uses them, embeddings added up, a one behind them."""
        if self.ready is None:
            _keep_freed()
            w = self.weights
            both = np.ones((len(w["token"]), WIDTH + 1), np.float32)
            both[:, :WIDTH] = w["token"] + w["class"][self.cls]
            self.ready = _joined(w, WIDTH, both.dtype) | {"both": both}
        return self.ready

    def __getstate__(self):
        return {**self.__dict__, "ready": None}

    def score_ids(self, texts: list[np.ndarray], end: int) -> list[float]:
        """log10 probability of each text's ids and its end; needs ``share``, log10 of each token's part of its class."""
        if not texts:
            return []
        begin = len(self.cls) - 1
        size = np.array([len(x) + 1 for x in texts])
        first = np.cumsum(size) - size
        all_in, all_out = np.full((2, size.sum()), end)
        all_out[:-1] = all_in[1:] = np.concatenate([y for x in texts for y in (x, [end])])[:-1]
        all_in[first] = begin
        windows = 1 + np.maximum(0, -(-(size - WINDOW) // FRESH))
        of = np.repeat(np.arange(len(texts)), windows)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * FRESH
        got = []
        for lo in range(0, len(of), BATCH):
            text, s = of[lo : lo + BATCH, None], start[lo : lo + BATCH, None]
            place = s + np.arange(WINDOW)
            fresh = (place < size[text]) & ((place >= s + WINDOW - FRESH) | (s == 0))
            at = np.minimum(first[text] + place, len(all_in) - 1)  # behind the end comes padding that nothing before it sees
            want = all_out.take(at[fresh])
            got.append(class_logp(self.joined(), all_in.take(at), fresh, self.cls.take(want)) + self.share.take(want))
        return np.add.reduceat(np.concatenate(got), first).tolist()


def _keep_freed() -> None:
    """What a step frees stays with the process: the system's allocator returns blocks of that size until a larger one has been freed, and half of a step's time goes into getting them again."""
    np.empty(24 << 20, np.uint8)


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def forward(w: dict[str, np.ndarray], cls: np.ndarray, ids: np.ndarray):
    """Log probabilities [windows, places, classes] of the next token's class, and the values on the way to them."""
    n = ids.shape[1]
    x = w["token"][ids] + w["class"][cls[ids]] + w["place"][:n]
    q, k, v = x @ w["q"], x @ w["k"], x @ w["v"]
    s = np.minimum(q @ k.transpose(0, 2, 1) * np.float32(1 / math.sqrt(q.shape[2])), MOST_SCORE)
    low = s < MOST_SCORE
    s += _MASK[:n, :n]
    s -= s.max(axis=2, keepdims=True)
    a = np.exp(s)
    a /= a.sum(axis=2, keepdims=True)
    o = a @ v
    y = x + o @ w["o"]
    h = np.maximum(y @ w["up"] + w["up_b"], 0)
    z = y + h @ w["down"]
    logits = z @ w["out"] + w["out_b"]
    return _log_softmax(np.minimum(logits, MOST_LOGIT)), (x, q, k, v, a, o, y, h, z, low, logits < MOST_LOGIT)


#: Places whose queries are taken together, from and to: they look at the keys up to their own last place only.
_SPANS = [(0, WINDOW - FRESH), (WINDOW - FRESH, WINDOW - FRESH // 2), (WINDOW - FRESH // 2, WINDOW)]
_SEEN = [np.tril(np.ones((hi - lo, hi), np.float32), lo) for lo, hi in _SPANS]
#: Rows that are taken to the classes together.
_CHUNK = 3072
_NONE = np.zeros((_CHUNK, HIDDEN), np.float32)
_LEAST = {x: math.exp(-x) for x in (MOST_SCORE, MOST_LOGIT)}


def _summable(total: np.ndarray, most: np.float32) -> bool:
    """Whether sums of exponentials show that no term exceeds ``most`` and that none of the sums has lost its digits."""
    return total.min() > _LEAST[most] and total.max() < 1 / _LEAST[most]


def _mixed(m: dict[str, np.ndarray], x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """What each fresh place takes from those that it sees, the sum of the weights behind it."""
    d = WIDTH
    qv = (x.reshape(-1, d + 1) @ m["qv"]).reshape(*fresh.shape, -1)
    q, values = qv[:, :, :d], qv[:, :, d:]  # the last column of values adds up the weights
    keys = x[:, :, :d].transpose(0, 2, 1)
    mixed = np.ones_like(x)
    for (lo, hi), seen in zip(_SPANS, _SEEN, strict=True):
        rows = np.flatnonzero(fresh[:, lo:hi].any(axis=1))
        if not len(rows):
            continue
        most = len(rows) * 2 > len(fresh)
        pick = slice(None) if most else rows
        s = q[pick, lo:hi] @ keys[pick, :, :hi]
        np.exp(s, out=s)
        s *= seen
        got = np.matmul(s, values[pick, :hi], out=mixed[:, lo:hi] if most else None)
        if not _summable(got[:, :, d], MOST_SCORE):
            s = np.minimum(q[pick, lo:hi] @ keys[pick, :, :hi], MOST_SCORE)
            s = np.where(seen > 0, s, -np.inf)
            s -= s.max(axis=2, keepdims=True)
            got = np.exp(s, out=s) @ values[pick, :hi]
            most = False
        if not most:
            mixed[pick, lo:hi] = got
    return mixed


@np.errstate(over="ignore", invalid="ignore")
def class_logp(m: dict[str, np.ndarray], ids: np.ndarray, fresh: np.ndarray, want: np.ndarray) -> np.ndarray:
    """log10 probability of class ``want`` after each fresh place [windows, places], in row order.

    The same as ``forward``, without what only training needs: queries of
    places that another window scores and keys that lie ahead are left out, and
    maxima are only taken off where exponentials get out of range.
    """
    d, flat = WIDTH, np.flatnonzero(fresh)
    x = m["both"].take(ids, axis=0)
    x += m["place"]
    mixed = _mixed(m, x, fresh)
    mixed = mixed.reshape(-1, d + 1).take(flat, axis=0)
    mixed *= np.repeat(1 / mixed[:, d], d + 1).reshape(mixed.shape)
    x = x.reshape(-1, d + 1).take(flat, axis=0)
    x[:, d] = 0  # both carry a one
    mixed += x
    got, sums = np.empty((2, len(flat)), np.float32)
    for lo in range(0, len(flat), _CHUNK):
        part = slice(lo, lo + _CHUNK)
        y = mixed[part]
        h = y @ m["up"]
        np.maximum(h, _NONE[: len(h)], out=h)  # much faster than with a single zero
        y += h @ m["down"]
        z = y @ m["out"]
        at, ones = np.arange(len(z)) * z.shape[1] + want[part], np.ones(z.shape[1], np.float32)
        got[part] = z.take(at)
        np.matmul(np.exp(z, out=z), ones, out=sums[part])
        if not _summable(sums[part], MOST_LOGIT):
            z = np.minimum(y @ m["out"], MOST_LOGIT)
            z -= z.max(axis=1, keepdims=True)
            got[part] = z.take(at)
            sums[part] = np.exp(z, out=z) @ ones
    return (got.astype(np.float64) - np.log(sums)) / math.log(10)


#: Windows whose gradients are worked out together: what they need stays in a core's cache.
_PART = 32


@np.errstate(over="ignore", invalid="ignore")
def gradients(w: dict[str, np.ndarray], cls: np.ndarray, ids: np.ndarray, target: np.ndarray, on: np.ndarray):
    """Mean loss over the places that are on, its gradients, and the token ids that the rows of the tokens' gradient are for."""
    kind = w["q"].dtype
    d, places = w["q"].shape[0], ids.shape[1]
    every = ids.ravel()
    order = np.argsort(every.astype(np.min_scalar_type(len(cls))), kind="stable")
    by = every.take(order)
    new = np.append(True, by[1:] != by[:-1])
    first = np.flatnonzero(new)
    rows = by.take(first)
    nth = np.empty(len(every), np.int64)
    nth[order] = np.cumsum(new) - 1
    m, fixed = _joined(w, d, kind), _fixed(places, w["out"].shape[1], w["up"].shape[1], kind)
    both = np.ones((len(rows), d + 1), kind)
    both[:, :d] = w["token"].take(rows, axis=0) + w["class"].take(cls.take(rows), axis=0)
    share = (on / max(1, int(on.sum()))).astype(kind)
    add = {"out": np.zeros_like(m["out"]), "up": np.zeros_like(m["up"]), "down": np.zeros_like(w["down"]), "qv": np.zeros((d, 2 * d), kind)}
    flat, loss = np.empty((ids.size, d), kind), 0.0
    for lo in range(0, len(ids), _PART):
        part, at = slice(lo, lo + _PART), slice(lo * places, (lo + _PART) * places)
        x = both.take(nth[at], axis=0)
        x.reshape(-1, places, d + 1)[...] += m["place"][:places]
        loss += _backward(m, x, target[part], share[part].ravel(), fixed, add, flat[at])
    g = {"out": add["out"][:d], "out_b": add["out"][d], "up": add["up"][:d], "up_b": add["up"][d], "down": add["down"]}
    qk, vo = add["qv"][:, :d] * kind.type(1 / math.sqrt(d)), add["qv"][:, d:]
    g["q"], g["k"], g["v"], g["o"] = qk @ w["k"], qk.T @ w["q"], vo @ w["o"].T, w["v"].T @ vo
    g["place"] = np.zeros_like(w["place"])
    g["place"][:places] = flat.reshape(len(ids), -1).sum(axis=0).reshape(places, d)
    g["token"] = np.add.reduceat(flat.take(order, axis=0), first, axis=0)
    of = np.zeros((len(w["class"]), len(rows)), kind)
    of[cls[rows], np.arange(len(rows))] = 1
    g["class"] = of @ g["token"]
    return loss, g, rows


@functools.cache
def _fixed(places: int, many: int, hidden: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places that each place sees, where the rows of a part's logits begin, and zeros."""
    return np.tril(np.ones((places, places), kind)), np.arange(_PART * places) * many, np.zeros((_PART * places, hidden), kind)


def _joined(w: dict[str, np.ndarray], d: int, kind: np.dtype) -> dict[str, np.ndarray]:
    """The weights for rows that carry a one behind their values: biases are a matrix' last row, and the one is handed on by a last column.

    Queries and keys only meet as products, and values are only read through
    ``o``: so q takes in both of the former and leaves the rows themselves as
    keys, and v takes in both of the latter.
    """
    m = {"qv": np.zeros((d + 1, 2 * d + 1), kind)}
    m["q"], m["v"] = m["qv"][:, :d], m["qv"][:, d:]
    m["q"][:d] = w["q"] @ w["k"].T * kind.type(1 / math.sqrt(d))
    m["v"][:d, :d], m["v"][d, d] = w["v"] @ w["o"], 1
    for name, size in (("place", len(w["place"])), ("down", len(w["down"]))):
        m[name] = np.zeros((size, d + 1), kind)
        m[name][: len(w[name]), :d] = w[name]
    m["up"], m["out"] = np.vstack([w["up"], w["up_b"]]), np.vstack([w["out"], w["out_b"]])
    m["back_out"], m["back_down"], m["back_up"] = (np.ascontiguousarray(w[k].T) for k in ("out", "down", "up"))
    m["back_qv"] = np.concatenate([m["q"][:d].T, m["v"][:d, :d].T])
    return m


def _backward(m, x, target, share, fixed, g, dx) -> float:
    """Adds the gradients of some windows to ``g``; returns their loss, each place weighted by its share, and puts the inputs' gradient in ``dx``.

    The same function as ``forward``, whose maxima are only taken off where exponentials get out of range.
    """
    many, places = target.shape
    d, (seen, at_class, none) = x.shape[1] - 1, fixed
    qv = (x @ m["qv"]).reshape(many, places, -1)
    q, v, k = qv[:, :, :d], qv[:, :, d:], x.reshape(many, places, d + 1)[:, :, :d]
    keys, values = k.transpose(0, 2, 1), v.transpose(0, 2, 1)
    a = q @ keys
    low = None
    np.exp(a, out=a)
    a *= seen
    mixed = (a @ v).reshape(-1, d + 1)
    if not _summable(mixed[:, d], MOST_SCORE):
        a = q @ keys
        low = a < MOST_SCORE
        a = np.where(seen > 0, np.minimum(a, MOST_SCORE), -np.inf)
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        mixed = (a @ v).reshape(-1, d + 1)
    inverse = np.repeat(1 / mixed[:, d], d + 1).reshape(mixed.shape)
    o = mixed * inverse
    y = o + x
    y[:, d] = 1
    h = y @ m["up"]
    np.maximum(h, none[: len(h)], out=h)  # much faster than with a single zero
    z = h @ m["down"]
    z += y
    e, free = z @ m["out"], None
    at, ones = at_class[: len(e)] + target.ravel(), np.ones(e.shape[1], e.dtype)
    picked = e.take(at)
    np.exp(e, out=e)
    total = e @ ones
    if not _summable(total, MOST_LOGIT):
        np.matmul(z, m["out"], out=e)
        free = e < MOST_LOGIT
        np.minimum(e, MOST_LOGIT, out=e)
        e -= e.max(axis=1, keepdims=True)
        picked = e.take(at)
        np.exp(e, out=e)
        total = e @ ones
    flat = e.reshape(-1)
    loss = float(((np.log(total) - picked) * share).sum())
    flat[at] -= total  # from here on a row times its weight is the gradient
    if free is not None:
        e *= free
    weight = (share / total)[:, None]
    z *= weight
    g["out"] += (e.T @ z).T
    dy = e @ m["back_out"]
    dy *= weight
    g["down"] += h.T @ dy
    dh = dy @ m["back_down"]
    dh *= np.sign(h, out=h)
    g["up"] += y.T @ dh
    dy += dh @ m["back_up"]
    do = np.empty_like(x)
    np.multiply(dy, inverse[:, :d], out=do[:, :d])
    do[:, d] = 0
    do[:, d] = (do * o) @ np.full(d + 1, -1, do.dtype)
    do = do.reshape(many, places, d + 1)
    two = np.empty((many, places, 2 * d), x.dtype)
    ds = do @ values
    ds *= a
    if low is not None:
        ds *= low
    np.matmul(ds, k, out=two[:, :, :d])
    np.matmul(a.transpose(0, 2, 1), do[:, :, :d], out=two[:, :, d:])
    two = two.reshape(-1, 2 * d)
    g["qv"] += x[:, :d].T @ two
    np.matmul(two, m["back_qv"], out=dx)
    dx += (ds.transpose(0, 2, 1) @ q).reshape(-1, d)
    dx += dy
    return loss


def neighbour_slots(size: int, seed: int = 11) -> np.ndarray:
    """The slot that each token's neighbours are counted under."""
    return np.random.default_rng(seed).integers(0, SLOTS, size)


def classes(count: np.ndarray, around: np.ndarray, end: int, many: int = CLASSES) -> np.ndarray:
    """The class of each token id, of the end and of the begin (last), by k-means over neighbour counts.

    count: of each token in the training corpus; around: [tokens, 2 * SLOTS]
    neighbours by slot, those before it and those behind it.  The begin sign and
    the end have classes of their own; tokens that occur hardly, or not at all,
    share two more.
    """
    size = len(count)
    cls = np.full(size, many - 3)
    seen = np.flatnonzero(count >= 4)
    cls[np.flatnonzero((count > 0) & (count < 4))] = many - 4
    k = many - 4
    if len(seen):
        v = np.sqrt(around[seen] / count[seen, None]).astype(np.float32)
        by_count = np.argsort(-count[seen], kind="stable")
        centre = v[by_count[:k]].copy()
        weight = np.sqrt(count[seen].astype(float))
        near = np.zeros(len(seen), np.int64)
        for _ in range(12):
            near = (v @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
            total = np.bincount(near, weight, len(centre))
            for j in range(v.shape[1]):
                moved = np.bincount(near, weight * v[:, j], len(centre))
                centre[:, j] = np.where(total > 0, moved / np.maximum(total, 1e-12), centre[:, j])
        cls[seen] = near
    cls[end] = many - 2
    cls[size - 1] = many - 1
    return cls.astype(np.int64)


def fresh_weights(vocab: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, m, c = WIDTH, HIDDEN, CLASSES

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "token": np.zeros((vocab + 1, d), np.float32), "class": normal(c, d, scale=0.3), "place": normal(WINDOW, d, scale=0.02),
        "q": normal(d, d, scale=0.2), "k": normal(d, d, scale=0.2), "v": normal(d, d, scale=0.2), "o": normal(d, d, scale=0.1),
        "up": normal(d, m, scale=0.25), "up_b": np.zeros(m, np.float32), "down": normal(m, d, scale=0.1),
        "out": normal(d, c, scale=0.1), "out_b": np.zeros(c, np.float32),
    }


def window_of(ids: np.ndarray, nth: int, begin: int, end: int) -> np.ndarray:
    """The nth training window of a text: ``WINDOW`` + 1 of its begin, ids and end, from place nth * ``WINDOW`` on; the end repeated behind it."""
    lo = nth * WINDOW
    part = ids[max(0, lo - 1) : lo + WINDOW].astype(np.int64)
    if lo == 0:
        part = np.concatenate([[begin], part])
    out = np.full(WINDOW + 1, end, np.int64)
    out[: len(part)] = part
    return out


def windows_of(ids: np.ndarray, begin: int, end: int) -> np.ndarray:
    """All training windows of a text, as ``window_of`` has them."""
    n = -(-(len(ids) + 1) // WINDOW)
    row = np.full(n * WINDOW + 1, end, np.int64)
    row[0], row[1 : len(ids) + 1] = begin, ids
    return np.lib.stride_tricks.sliding_window_view(row, WINDOW + 1)[::WINDOW]


class Trainer:
    """Adam on batches of windows; rows of tokens that a batch hasn't are left alone.  ``seen`` counts what was learned from, by token."""

    def __init__(self, weights: dict[str, np.ndarray], cls: np.ndarray, end: int):
        _keep_freed()
        self.cls, self.end, self.steps = cls, end, 0
        # all but the tokens' weights lie in one row; the moments lie below
        self.dense = [k for k in weights if k != "token"]
        token = weights["token"]
        self.flat = np.zeros((3, sum(weights[k].size for k in self.dense)), np.float32)
        self.flat[0] = np.concatenate([weights[k].ravel() for k in self.dense])
        self.tokens = token.copy(), np.zeros_like(token), np.zeros_like(token)
        cut = np.cumsum([weights[k].size for k in self.dense])[:-1]
        self.w = {k: x.reshape(weights[k].shape) for k, x in zip(self.dense, np.split(self.flat[0], cut), strict=True)} | {"token": self.tokens[0]}
        self.seen = np.zeros(len(token), np.int64)

    def step(self, windows: np.ndarray, rate: float) -> float:
        ids, after = windows[:, :-1], windows[:, 1:]
        # places from the first end on are padding, and texts hold no end
        loss, g, rows = gradients(self.w, self.cls, ids, self.cls.take(after), (ids != self.end).astype(np.float32))
        self.steps += 1
        self._move(*self.flat, np.concatenate([g[k].ravel() for k in self.dense]), rate)
        held = [x.take(rows, axis=0) for x in self.tokens]
        self._move(*held, g["token"], rate)
        for x, moved in zip(self.tokens, held, strict=True):
            x[rows] = moved
        np.add.at(self.seen, ids.ravel(), 1)
        self.seen[self.end] = 0
        return loss

    def _move(self, x: np.ndarray, one: np.ndarray, two: np.ndarray, g: np.ndarray, rate: float) -> None:
        one += 0.1 * (g - one)
        two += 0.02 * (g * g - two)
        root = math.sqrt(1 - 0.98**self.steps)
        by = np.sqrt(two)
        by += 1e-8 * root
        np.divide(one, by, out=by)
        by *= rate * root / (1 - 0.9**self.steps)
        x -= by


def warm_up(windows: np.ndarray, cls: np.ndarray, vocab: int, end: int, passes: int = 1, rate: float = 4e-3, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights after so many passes over windows, in a random order."""
    t = Trainer(fresh_weights(vocab, seed), cls, end)
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(passes)]) if len(windows) else np.zeros(0, int)
    steps = -(-len(order) // TRAIN_BATCH)
    for step in range(steps):
        t.step(windows[order[step * TRAIN_BATCH : (step + 1) * TRAIN_BATCH]], rate * min(1.0, (step + 1) / 40) * (0.2 + 0.8 * (1 - step / steps)))
    return t.w


def with_counts(model: Model, counts: np.ndarray, end: int) -> Model:
    """Sets each token's share of its class from counts over the whole training corpus, half a count added to each."""
    c = counts.astype(float) + 0.5
    total = np.bincount(model.cls, np.append(c, 0.0)[: len(model.cls)], CLASSES)
    share = np.zeros(len(model.cls))
    share[:-1] = np.log10(c / total[model.cls[:-1]])
    share[end] = 0.0  # alone in its class
    model.share = share
    return model
