"""Language-model scores of whole texts, with exact unigram scores of their words beside them.

Texts are encoded once and kept as blocks of ids and words.  The model takes
from all training texts: token counts, the neighbours by which tokens are put
in classes, and its weights.  These start from a bounded random draw of
windows of the whole corpus; then every task goes on from there with all windows
of every training text of its own, and what the tasks have learned is averaged,
a token's weights by how often each task saw it.

The word statistics cover all training texts and stay distributed.  A task
numbers the distinct words of its texts (a block) and sends each once, under a
range of hashes; a range adds up its words' counts over all blocks and answers
each block with the counts of the words that it sent.  A word in every text
costs one entry a block, so no word is hot, and no task or driver ever holds
the vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import text_of, tune, utf8, written
from .tokens import default_ranks, encode_all, encoder
from .words import words_of

#: Windows that the weights are started from, drawn from all training texts alike, and passes over them.
START_WINDOWS, START_PASSES = 16_000, 2
#: Tasks learn from one of so many windows of a text: from all.
EVERY = 1
#: Step size of what tasks learn on their own.
RATE = 8e-3
#: Parts that tables over the vocabulary are summed up in.
CHUNKS = 64
#: Groups of tasks whose tables are summed up before the groups' sums are.
GROUPS = 16
#: Words of a block, and words (repeats included) that a range of hashes is meant for.
BLOCK_WORDS, RANGE_WORDS = 3_000_000, 2_000_000
#: Bytes of text for each word, about.
WORD_BYTES = 6
_DOC, _WORDS = 1, 0
_ROW = "block long, kind int, range int, doc_id long, held_out boolean, n long, score double, a binary, b binary"
_NAMES = ["block", "kind", "range", "doc_id", "held_out", "n", "score", "a", "b"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


# -- the model ---------------------------------------------------------------


def _ids(raw: bytes, vocab: int) -> np.ndarray:
    return np.frombuffer(raw, _kind(vocab))


def _kind(vocab: int) -> type:
    return np.uint16 if vocab <= 1 << 16 else np.uint32


_PARTS = "part long, chunk int, at binary, vec binary"


def _parts(part: int, table: np.ndarray) -> pa.RecordBatch:
    """The rows of a table over the vocabulary that aren't all zero, in ``CHUNKS`` parts: their places within the part, and their values."""
    out = []
    for k, x in enumerate(np.array_split(table, CHUNKS)):
        at = np.flatnonzero(x.any(axis=1)).astype(np.int32)
        if len(at):
            out.append((part, k, at.tobytes(), np.ascontiguousarray(x[at], np.float64).tobytes()))
    return _parts_batch(out)


def _parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * 4
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "chunk", "at", "vec"])


def _summed(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each chunk the rows' places and the sums of their values; their sizes are bounded by the vocabulary, not by the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, vec = np.frombuffer(at, np.int32), np.frombuffer(vec, np.float64)
                rows = vec.reshape(len(at), -1)
                held = totals.get(chunk, np.zeros((0, rows.shape[1])))
                if at[-1] >= len(held):
                    held = np.concatenate([held, np.zeros((at[-1] + 1 - len(held), rows.shape[1]))])
                held[at] += rows
                totals[chunk] = held
        out = []
        for chunk, held in totals.items():
            at = np.flatnonzero(held.any(axis=1)).astype(np.int32)
            out.append((0, chunk, at.tobytes(), held[at].tobytes()))
        yield _parts_batch(out)

    # in two levels, so that few chunks don't gather what very many tasks send
    some = parts.withColumn("group", F.col("part") % GROUPS).repartition("chunk", "group").sortWithinPartitions("chunk", "part").select("chunk", "at", "vec").mapInArrow(run, _PARTS)
    got = some.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "at", "vec").mapInArrow(run, _PARTS).collect()
    return {r["chunk"]: (np.frombuffer(r["at"], np.int32), np.frombuffer(r["vec"], np.float64)) for r in got}


def _table(sums: dict[int, tuple[np.ndarray, np.ndarray]], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    for k, part in enumerate(np.array_split(np.arange(rows), CHUNKS)):
        if k in sums and len(sums[k][0]):
            out[part[sums[k][0]]] = sums[k][1].reshape(-1, columns)
    return out


def neighbour_counts(learned: DataFrame, vocab: int) -> np.ndarray:
    """[vocab + 1, 1 + 2 * SLOTS] over the training rows' ids (column b): a token's count, and its neighbours' on either side by slot."""
    size, slots = vocab + 1, attention.SLOTS
    wide = 1 + 2 * slots
    before = 1 + attention.neighbour_slots(size)
    after = before + slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * wide)
        for batch in batches:
            texts = [_ids(x, vocab) for x in batch.column(0).to_pylist()]
            ids = np.concatenate(texts).astype(np.int64)
            if not len(ids):
                continue
            table[::wide] += np.bincount(ids, minlength=size)
            inner = np.ones(len(ids), bool)  # not the last of its text
            ends = np.cumsum([len(t) for t in texts]) - 1
            inner[ends[ends >= 0]] = False
            a, b = ids[:-1][inner[:-1]], ids[1:][inner[:-1]]
            np.add.at(table, b * wide + before[a], 1.0)
            np.add.at(table, a * wide + after[b], 1.0)
        yield _parts(TaskContext.get().partitionId(), table.reshape(size, wide))

    return _table(_summed(learned.select("b").mapInArrow(run, _PARTS)), size, 1 + 2 * slots)


def _windows(ids: np.ndarray, every: int, begin: int, end: int) -> np.ndarray:
    """One of ``every`` windows of a text, from a place that the text decides on."""
    got = attention.windows_of(ids, begin, end)
    first = zlib.crc32(ids.tobytes()) % every if every > 1 else 0
    return got[first::every] if first < len(got) else got[first % len(got)][None]


def start_windows(learned: DataFrame, vocab: int, total: float, wanted: int = START_WINDOWS) -> DataFrame:
    """About ``wanted`` windows (w, int32), each window of each training text with the same chance (about ``total`` there are)."""
    begin, end = vocab, vocab - 1
    share = min(1.0, wanted / max(1.0, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                ids = _ids(raw, vocab)
                n = -(-(len(ids) + 1) // attention.WINDOW)
                draw = np.random.default_rng(zlib.crc32(raw)).random(n)
                out += [attention.window_of(ids, int(k), begin, end).astype(np.int32).tobytes() for k in np.flatnonzero(draw < share)]
            yield pa.RecordBatch.from_pydict({"w": pa.array(out, pa.binary())})

    return learned.select("b").mapInArrow(run, "w binary")


def start_weights(windows: DataFrame, cls: np.ndarray, vocab: int) -> dict[str, np.ndarray]:
    """Weights after ``START_PASSES`` over the bounded number of windows, in one task."""
    names = list(attention.fresh_weights(1))
    shared = windows.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in b.column(0).to_pylist())
        every = np.array([np.frombuffer(x, np.int32) for x in rows], np.int64).reshape(-1, attention.WINDOW + 1)
        w = attention.warm_up(every, shared.value, vocab, vocab - 1, START_PASSES)
        yield pa.RecordBatch.from_pydict({"name": names, "x": pa.array([w[k].tobytes() for k in names], pa.binary())})

    got = {r["name"]: r["x"] for r in windows.repartition(1).mapInArrow(run, "name string, x binary").collect()}
    start = attention.fresh_weights(vocab)
    return {k: np.frombuffer(got[k], np.float32).reshape(start[k].shape).copy() for k in names} if got else start


def learned_everywhere(learned: DataFrame, start: dict[str, np.ndarray], cls: np.ndarray, vocab: int) -> dict[str, np.ndarray]:
    """The weights after every task has gone on with all windows of all its training texts, averaged."""
    begin, end = vocab, vocab - 1
    shared = learned.sparkSession.sparkContext.broadcast((start, cls))
    dense = [k for k in start if k != "token"]
    width = start["token"].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, classes = shared.value
        t = attention.Trainer(first, classes, end)
        held = np.zeros((0, attention.WINDOW + 1), np.int64)
        for batch in batches:
            held = np.concatenate([held, *(_windows(_ids(raw, vocab), EVERY, begin, end) for raw in batch.column(0).to_pylist())])
            full = len(held) - len(held) % attention.TRAIN_BATCH
            for lo in range(0, full, attention.TRAIN_BATCH):
                t.step(held[lo : lo + attention.TRAIN_BATCH], RATE * min(1.0, (t.steps + 1) / 20))
            held = held[full:]
        if len(held):
            t.step(held, RATE * len(held) / attention.TRAIN_BATCH)
        if not t.steps:
            return
        part = TaskContext.get().partitionId()
        moved = (t.w["token"] - first["token"]).astype(np.float64) * t.seen[:, None]
        yield _parts(part, np.concatenate([moved, t.seen[:, None].astype(np.float64)], axis=1))
        flat = np.concatenate([(t.w[k] - first[k]).ravel() for k in dense]).astype(np.float64) * t.steps
        yield _parts_batch([(part, CHUNKS, np.zeros(1, np.int32).tobytes(), np.append(flat, t.steps).tobytes())])

    sums = _summed(written(learned.select("b").mapInArrow(run, _PARTS), "learned"))
    out = {k: x.copy() for k, x in start.items()}
    if CHUNKS not in sums:
        return out
    table = _table(sums, len(start["token"]), width + 1)
    out["token"] += (table[:, :-1] / np.maximum(table[:, -1:], 1)).astype(np.float32)
    flat, lo = sums[CHUNKS][1][:-1] / sums[CHUNKS][1][-1], 0
    for k in dense:
        out[k] += flat[lo : lo + out[k].size].reshape(out[k].shape).astype(np.float32)
        lo += out[k].size
    return out


def learn(learned: DataFrame, vocab: int) -> attention.Model:
    """The model of the training rows' ids (column b)."""
    end = vocab - 1
    counts = neighbour_counts(learned, vocab)
    cls = attention.classes(counts[:, 0], counts[:, 1:], end)
    windows = written(start_windows(learned, vocab, counts[:, 0].sum() / attention.WINDOW), "windows")
    start = start_weights(windows, cls, vocab)
    weights = learned_everywhere(learned, start, cls, vocab)
    return attention.with_counts(attention.Model(weights, cls), counts[:-1, 0], end)


# -- blocks ------------------------------------------------------------------


def _steps(sorted_: np.ndarray) -> bytes:
    """Ascending numbers as their steps, in two bytes each where all fit."""
    d = sorted_.copy()
    d[1:] -= sorted_[:-1]
    return b"\2" + d.astype(np.uint16).tobytes() if not len(d) or d.max() < 1 << 16 else b"\4" + d.astype(np.uint32).tobytes()


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Ascending with the hash, so a block's sorted words lie range by range."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _blocks(rows: DataFrame, ranks: str, ranges: int) -> DataFrame:
    """Rows of each text (its words as numbers within its block, and its ids) and of each block's words by range of hashes."""

    def flush(block: int, docs: list[tuple], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(h) for h in hashes])
        first = np.concatenate([[0], np.cumsum(size)])
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        found = pa.array(every).dictionary_encode()  # faster than sorting all
        words = found.dictionary.to_numpy()
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        words, number = words[order], place[found.indices.to_numpy()]
        learned = np.repeat([not d[1] for d in docs], size)
        train = np.bincount(number[learned], minlength=len(words)).astype(np.int32)
        out = []
        for i, (doc, held, ids) in enumerate(docs):
            own = np.sort(number[first[i] : first[i + 1]])
            out.append((block, _DOC, -1, doc, held, len(own), None, _steps(own), ids))
            if len(out) >= 500:
                yield _batch(out)
                out = []
        r = _range_of(words, ranges)  # ascending; only ranges that have a word are sent
        cut = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]]) if len(r) else np.zeros(1, int)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out.append((block, _WORDS, int(r[lo]), None, None, hi - lo, None, words[lo:hi].tobytes(), train[lo:hi].tobytes()))
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        kind = _kind(encoder(ranks).n_vocab + 1)
        docs: list[tuple] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            texts = utf8(batch.column(1))
            w, encoded = words_of(texts), encode_all(texts, ranks)
            ids, outs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(len(texts)):
                docs.append((ids[i], outs[i], encoded[i].astype(kind).tobytes()))
                hashes.append(w.hash[w.of(i)])
                held += len(hashes[-1])
                if held >= BLOCK_WORDS:
                    yield from flush(part << 24 | nth, docs, hashes)
                    docs, hashes, held, nth = [], [], 0, nth + 1
        if docs:
            yield from flush(part << 24 | nth, docs, hashes)

    return rows.mapInArrow(run, _ROW)


def _answered(words: DataFrame, ranges: int) -> DataFrame:
    """For each block and range the corpus counts of the words that it sent; block -1: the range's tokens (a) and distinct words (b)."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        hashes = [np.frombuffer(a, np.uint64) for _, _, a, _ in rows]
        size = np.cumsum([len(h) for h in hashes])[:-1]
        found = pa.array(np.concatenate(hashes)).dictionary_encode()  # faster than sorting all
        number = found.indices.to_numpy()
        train = np.concatenate([np.frombuffer(b, np.int32) for *_, b in rows])
        total = np.bincount(number, train, len(found.dictionary)).astype(np.int64)
        k = rows[0][1]
        out = [(block, _WORDS, k, None, None, len(c), None, c.tobytes(), b"") for (block, *_), c in zip(rows, np.split(total[number], size), strict=True)]
        out.append((-1, _WORDS, k, None, None, int(total.sum()), float((total > 0).sum()), b"", b""))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[1] != held[0][1]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    placed = words.select("block", "range", "a", "b").repartition(ranges, "range").sortWithinPartitions("range", "block")
    return placed.mapInArrow(run, _ROW)


def _scored(rows: DataFrame, model, vocab: int, n_train: int, n_distinct: int, n_docs: int) -> DataFrame:
    """Rows sorted by (block, kind, range): the block's counts, then its texts, which are scored here."""
    total = n_train + n_docs
    low = math.log10(total + n_distinct + (n_docs > 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table, known = None, [], None, None
        for batch in batches:
            out, ids = [], []
            for b, kind, _, doc, held, n, _, own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, parts, table = b, [], None
                if kind == _WORDS:
                    parts.append(np.frombuffer(own, np.int64))
                    continue
                if table is None:
                    c = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                    table, known = np.log10(c + 1.0) - low, c > 0
                at = _from_steps(own)
                base = float(table[at].sum()) + math.log10(n_docs + 1.0) - low
                out.append((doc, held, n + 1, int(known[at].sum()) + (n_docs > 0), total, base))
                ids.append(_ids(raw, vocab))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                scores = pa.array(model.value.score_ids(ids, vocab - 1), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), scores],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    placed = rows.repartition("block").sortWithinPartitions("block", "kind", "range")
    return placed.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, range_words: int = RANGE_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column; rows where it isn't true are learned from.
    Tokens of the base are lower-cased (A-Z) words and one end per text; score
    is the attention model's log10 probability of the whole text, end
    included.  Null texts are empty: an end alone.  Repeated rows count and are
    scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    path = ranks or default_ranks()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    vocab = encoder(path).n_vocab + 1  # the ids and the end; the begin is one more
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, -(-n_bytes // (WORD_BYTES * range_words)))
    blocks = written(_blocks(rows, path, ranges), "blocks")
    texts = blocks.where(F.col("kind") == _DOC)
    answers = written(_answered(blocks.where(F.col("kind") == _WORDS), ranges), "answers")
    sums = answers.where("block = -1").agg(F.sum("n").alias("n"), F.sum("score").alias("v")).first()
    n_docs = texts.where(~F.col("held_out")).count()
    model = spark.sparkContext.broadcast(learn(texts.where(~F.col("held_out")), vocab))
    both = texts.unionByName(answers.where("block >= 0"))
    return _scored(both, model, vocab, int(sums["n"] or 0), int(sums["v"] or 0), n_docs)
