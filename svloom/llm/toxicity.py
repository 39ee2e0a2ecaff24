"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's own trainer, one on
ordinary and one on toxic training texts.  A toxic text is ordinary for most of
its length, so the toxic dictionary is trained on what is left of whole toxic
texts once the stretches are taken out that ordinary texts have about as often.
Overlapping windows of a text are compressed with both dictionaries; the counts
of windows by how much shorter one of them makes them are turned into a
probability by a logistic curve, calibrated on training rows that the
dictionaries haven't seen.  How strict the contrast is, is chosen by the same
rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, passed_through, text_of, tune, utf8

#: Bytes of a window and of the step to the next.
WINDOW, STEP = 48, 32
#: Labelled rows to learn from at most: toxic, ordinary.  They are drawn by the XXH64 of their id.
SAMPLE = (1600, 4000)
#: Longer labelled texts aren't learned from (all are scored).
SAMPLE_CHARS = 16_000
#: Bytes of the trained dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
#: Contrasts to choose from: bytes of a stretch, standard deviations that its toxic texts exceed the expected by, and times that they do.
CONTRASTS = ((5, 8.0, 30.0), (6, 6.0, 4.0), (7, 7.0, 3.0))
#: Toxic texts that a stretch must be in.
LEAST_TEXTS = 3
THRESHOLD = 0.3
#: Differences, in bytes, that windows are counted by: toxic shorter, ordinary shorter.
UP, DOWN = (1, 2, 3, 4, 5, 6, 7), (1, 2, 3, 4)
#: Lower bits of stretch hashes that are told apart in counting.
_BITS = 24


def normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


def windows(body: bytes) -> list[bytes]:
    return [body[i : i + WINDOW] for i in range(0, max(1, len(body) - WINDOW + STEP), STEP)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=32,
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    """Dictionary contents and the calibrated curve: plain data of a fixed size, whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.weights)

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.weights = state
        self._pair = None

    def differences(self, text: bytes) -> np.ndarray:
        """For each window: compressed length under the ordinary dictionary less that under the toxic one."""
        if self._pair is None:
            self._pair = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        toxic, ordinary = self._pair
        parts = windows(normal(text))
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in parts), np.int64, len(parts))

    def features(self, text: bytes) -> np.ndarray:
        d = self.differences(text)
        n = len(d)
        up = [math.log1p((d >= k).sum()) for k in UP]
        down = [math.log1p((d <= -k).sum()) for k in DOWN]
        dense = [10 * (d >= k).sum() / (n + 5) for k in (2, 4)]
        return np.array([1.0, *up, *down, *dense, math.log(n), d.max(), 4 * d.mean()])

    def score(self, text: bytes) -> float:
        return float(_sigmoid(self.features(text) @ self.weights))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Newton's method; the constant is not held back."""
    hold = np.full(x.shape[1], l2)
    hold[0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ b)
        g = x.T @ (w * (p - y)) + hold * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _stretches(body: bytes, size: int) -> np.ndarray:
    """A hash for each place of a text's stretches of ``size`` bytes."""
    n = len(body) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(body, np.uint8)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(257) + raw[k : k + n]
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


def _text_counts(bodies: list[bytes], size: int) -> np.ndarray:
    """The number of texts that have each stretch."""
    out = np.zeros(1 << _BITS, np.uint16)
    for b in bodies:
        out[np.unique(_stretches(b, size))] += 1
    return out


def contrast(toxic: np.ndarray, n: int, ordinary: np.ndarray, m: int, deviations: float, times: float) -> np.ndarray:
    """The stretches that many more of ``n`` toxic texts have than the counts in ``m`` ordinary ones lead to expect."""
    some = toxic >= LEAST_TEXTS
    expected = (ordinary[some] + 1.0) * (n / m)
    have = toxic[some]
    out = np.zeros(len(toxic), bool)
    out[some] = (have - expected > deviations * np.sqrt(expected)) & (have > times * expected)
    return out


def remainder(body: bytes, keep: np.ndarray, size: int) -> bytes:
    """What kept stretches cover of a text, one line each."""
    on = np.flatnonzero(keep[_stretches(body, size)])
    covered = np.zeros(len(body) + 2, bool)
    for k in range(size):
        covered[1 + on + k] = True
    edge = np.flatnonzero(np.diff(covered.view(np.int8)))
    return b"\n".join(body[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def train_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes by the library's trainer; too little for that to learn from is one as it is."""
    samples = [x for x in samples if x]
    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples
            pass
    return b"\n".join(samples)[-size:]


def dictionaries(toxic: list[bytes], base: bytes, keep: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """Contents for either side.  ``base``, trained on ordinary texts, ends both, so that ordinary stretches cost the same under either;
    before it comes what was trained on toxic texts, or as many bytes as no text has."""
    own = train_dictionary([remainder(b, keep, size) for b in toxic], TOXIC_BYTES, 16)
    filler = bytes(np.random.default_rng(5).integers(0xF8, 0x100, len(own), dtype=np.uint8))
    return own + base, filler + base


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """From sampled texts of either kind; share: of toxic rows among all labelled ones.

    The curve and the contrast are calibrated on the half of the sample that
    its dictionaries haven't seen; the dictionaries that are then used come
    from all of it.
    """
    toxic, ordinary = [normal(t) for t in toxic], [normal(t) for t in ordinary]
    seen = (toxic[::2], ordinary[::2])
    other = (toxic[1::2], ordinary[1::2])

    def base_of(bodies: list[bytes]) -> bytes:
        return train_dictionary([w for b in bodies for w in windows(b)], ORDINARY_BYTES, 64)

    n, m = map(len, other)
    y = np.repeat([1.0, 0.0], [n, m])
    w = np.repeat([share * (n + m) / n, (1 - share) * (n + m) / m], [n, m])
    base = base_of(seen[1])
    best = None
    for size, deviations, times in CONTRASTS:
        counts = [_text_counts(x, size) for x in seen]
        keep = contrast(counts[0], len(seen[0]), counts[1], len(seen[1]), deviations, times)
        half = Model(*dictionaries(seen[0], base, keep, size), np.zeros(0))
        x = np.array([half.features(b[1:-1]) for side in other for b in side])
        loss = 0.0
        for k in (0, 1):  # the curve of one half of these rows, judged by the other
            p = np.clip(_sigmoid(x[1 - k :: 2] @ _logistic(x[k::2], y[k::2], w[k::2])), 1e-6, 1 - 1e-6)
            yy = y[1 - k :: 2]
            loss -= float((w[1 - k :: 2] * (yy * np.log(p) + (1 - yy) * np.log(1 - p))).sum())
        if best is None or loss < best[0]:
            best = (loss, size, deviations, times, _logistic(x, y, w))
    _, size, deviations, times, weights = best
    counts = [_text_counts(x, size) for x in (toxic, ordinary)]
    keep = contrast(counts[0], len(toxic), counts[1], len(ordinary), deviations, times)
    return Model(*dictionaries(toxic, base_of(ordinary), keep, size), weights)


def constant(share: float) -> Model:
    """For labels of one kind, or almost none: the share itself."""
    w = np.zeros(len(UP) + len(DOWN) + 6)
    w[0] = math.log(min(max(share, 1e-4), 1 - 1e-4)) - math.log(1 - min(max(share, 1e-4), 1 - 1e-4))
    return Model(b" " * 64, b" " * 64, w)


def learn(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: tuple[int, int] = SAMPLE
) -> Model:
    """A model from the rows of ``docs`` that have a label 0 or 1; contradicting labels count as 1.

    About ``sample`` ids of either label are drawn by hash among labelled ids
    alone, twice as many as asked for since some texts are too long; only their
    texts are then fetched, by a broadcast of these ids.  An id with several
    texts gives the last of them in order.  Fewer than 8 texts of a label, or
    no labels, give a model that knows only the labels' share.
    """
    y = labels.where(F.col(label_col).cast("int").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(totals.values())
    share = totals.get(1, 0) / total if total else 0.0
    order = F.xxhash64("i")
    draw = F.pmod(order, F.lit(1 << 30))
    part = {kind: min(1.0, 2 * most / max(1, totals.get(kind, 0))) for kind, most in ((1, sample[0]), (0, sample[1]))}
    chosen = y.where(draw < F.when(F.col("y") == 1, int(part[1] * (1 << 30))).otherwise(int(part[0] * (1 << 30))))
    # at most about twice ``sample`` ids, whatever the corpus holds
    wanted = [(r["i"], r["y"]) for r in chosen.collect()]
    if not wanted:
        return constant(share)
    ids = docs.sparkSession.createDataFrame(wanted, "i long, y int")
    rows = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    got = rows.join(F.broadcast(ids), "i").groupBy(order.alias("o"), "i", "y").agg(F.max("t").alias("t")).collect()
    got.sort(key=lambda r: (r["o"], r["i"]))
    picked = [[r["t"].encode() for r in got if r["y"] == kind][:most] for kind, most in ((1, sample[0]), (0, sample[1]))]
    if min(map(len, picked)) < 8:
        return constant(share)
    return fit(*picked, share)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row.

    A null text counts as empty; an empty one is a single window and has a
    score too.  Long texts are scored whole.  Repeated rows and equal texts have
    equal scores; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        return {"doc_id": batch.column(0), "score": pa.array([m.score(t) for t in utf8(batch.column(1))], pa.float64())}

    return arrow_map(rows, run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever these are called.

    A score equal to the threshold goes.  Null and empty texts are scored as
    empty; repeated rows stay or go together; an empty table stays empty.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return passed_through(docs, text_col, lambda texts: np.array([shared.value.score(t) < threshold for t in texts], bool))
