"""Alignment of two tokenizers over the same texts, by the elementary intervals of their token ends.

The ends of both tokenizers' tokens cut a text's bytes into elementary
intervals; each lies in one token of either side.  An end that both share
closes a group, and all tokens of one side in a group are linked with all of
the other.

Both tokenizers always cut before a space that follows something else than
white space, so no group reaches over such a place: the stretches between are
aligned once each, in one pass over all new ones of a batch, and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of, tune, written
from .tokens import default_ranks, encoder

#: Stretches that a process remembers; beyond, it starts anew.
CACHE = 300_000
#: Words looked up at once, and characters from which a text is taken in parts.
RUN_WORDS, PART_CHARS = 200_000, 1 << 21
#: Links of a group from which its repeated ids are counted before they are paired.
LARGE_GROUP = 4096
#: Pairs whose counts are sent to all tasks at most: those of the most documents; the others' counts are joined.
HOT_PAIRS = 1 << 18
_CUT = re.compile(r"(?<=\S)(?= )")


def default_pieces() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def stretches(text: str) -> list[str]:
    """``text`` behind a space, cut before each space that follows something else than white space; without the leading spaces."""
    words = text.split(" ")
    # an empty word or one that ends in white space has no cut beside it
    if "" in words or any(w[-1].isspace() for w in words):
        return [s[1:] for s in _CUT.split(" " + text)]
    return words


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


class Aligner:
    """Both tokenizers, and what is known of stretches: figures, links with counts, and groups as text."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece

        self.a = encoder(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n_a, self.n_b = self.a.max_token_value + 1, self.b.get_piece_size()
        self.a_len = np.zeros(n_a, np.int64)
        for token in self.a.token_byte_values():
            self.a_len[self.a.encode_single_token(token)] = len(token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.n_b) for p in [self.b.id_to_piece(i)]]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.space = [self.b.piece_to_id("▁")]
        self.spelt = [f"{i}{sep}" for i in range(max(n_a, self.n_b)) for sep in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[str] = []
        self.figures = np.zeros((1024, 4), np.int64)
        self.fits = np.zeros(1024, bool)
        self.first = np.zeros(1025, np.int64)
        self.keys, self.times = np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def learn(self, words: list[str]) -> None:
        """Aligns stretches that aren't known yet."""
        a_ids = [self.a.encode_ordinary(" " + w) for w in words]
        b_ids = [x or self.space for x in self.b.encode(words, num_threads=1)]
        fits = np.array([b"".join([self.b_bytes[i] for i in x]) == (" " + w).encode() for w, x in zip(words, b_ids, strict=True)], bool)
        known, n = len(self.at), len(words)
        a_ids, b_ids = [x if ok else [] for x, ok in zip(a_ids, fits, strict=True)], [x if ok else [] for x, ok in zip(b_ids, fits, strict=True)]
        a_of, b_of = np.fromiter(map(len, a_ids), np.int64, n), np.fromiter(map(len, b_ids), np.int64, n)
        a, b = np.fromiter((i for x in a_ids for i in x), np.int64, a_of.sum()), np.fromiter((i for x in b_ids for i in x), np.int64, b_of.sum())
        figures, keys, times, first, text = self._aligned(a, b, a_of, b_of)
        for k, w in enumerate(words):
            self.at[w] = known + k
        self.text += text
        if known + n > len(self.figures):
            size = max(known + n, 2 * len(self.figures))
            self.figures = np.concatenate([self.figures, np.zeros((size - len(self.figures), 4), np.int64)])
            self.fits, self.first = _grown(self.fits, size), _grown(self.first, size + 1)
        self.figures[known : known + n], self.fits[known : known + n] = figures, fits
        past = self.first[known]
        self.first[known + 1 : known + n + 1] = past + first[1:]
        self.keys, self.times = _grown(self.keys, past + len(keys)), _grown(self.times, past + len(keys))
        self.keys[past : past + len(keys)], self.times[past : past + len(keys)] = keys, times

    def _aligned(self, a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray):
        """Figures, links and groups of stretches laid end to end."""
        n = len(a_of)
        if not len(a):
            return np.zeros((n, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), [""] * n
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.union1d(a_end, b_end)
        a_own, b_own = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        closes = (a_end[a_own] == cuts) & (b_end[b_own] == cuts)
        a_hi, b_hi = a_own[closes] + 1, b_own[closes] + 1
        a_lo, b_lo = np.concatenate([[0], a_hi[:-1]]), np.concatenate([[0], b_hi[:-1]])
        a_n, b_n = a_hi - a_lo, b_hi - b_lo
        word_of = np.searchsorted(np.cumsum(a_of), a_lo, side="right")  # of a group
        links = a_n * b_n
        figures = np.stack([a_of, b_of, np.bincount(word_of, minlength=n), np.bincount(word_of, links, minlength=n).astype(np.int64)], axis=1)
        small = np.flatnonzero(links <= LARGE_GROUP)
        group = np.repeat(small, links[small])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        pairs = a[a_lo[group] + nth // b_n[group]] * self.n_b + b[b_lo[group] + nth % b_n[group]]
        owner, times = word_of[group], np.ones(len(pairs), np.int64)
        for g in np.flatnonzero(links > LARGE_GROUP):
            (x, nx), (y, ny) = (np.unique(ids, return_counts=True) for ids in (a[a_lo[g] : a_hi[g]], b[b_lo[g] : b_hi[g]]))
            pairs = np.concatenate([pairs, (x[:, None] * self.n_b + y).ravel()])
            times = np.concatenate([times, (nx[:, None] * ny).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), word_of[g])])
        owner, pairs, times = summed(owner, pairs, times)
        first = np.searchsorted(owner, np.arange(n + 1))
        # a group's tokens of the one side, then of the other, each with the sign that follows it
        a_group, b_group = np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)
        spelt = np.empty(len(a) + len(b), np.int64)
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_hi - 1], b_sign[b_hi - 1] = 1, 2
        spelt[np.arange(len(a)) + b_lo[a_group]] = a * 3 + a_sign
        spelt[np.arange(len(b)) + a_hi[b_group]] = b * 3 + b_sign
        parts, ends = [self.spelt[i] for i in spelt.tolist()], np.cumsum(a_of + b_of).tolist()
        text = ["".join(parts[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        return figures, pairs, times, first, text

    def looked_up(self, words: list[str]) -> np.ndarray:
        get = self.at.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            self.learn(list(dict.fromkeys(w for w, k in zip(words, found, strict=True) if k < 0)))
            found = [get(w) for w in words]
        return np.array(found, np.int64)

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Figures, groups and links of each text."""
        if len(self.at) > CACHE:
            self.clear()
        runs: list[np.ndarray] = []
        waiting: list[list[str]] = []
        count = np.zeros(len(texts), np.int64)

        def take() -> None:
            if waiting:
                runs.append(self.looked_up([w for words in waiting for w in words]))
                waiting.clear()

        held = 0
        for k, text in enumerate(texts):
            for part in _parts(text or ""):
                words = stretches(part)
                count[k] += len(words)
                waiting.append(words)
                held += len(words)
                if held >= RUN_WORDS:
                    take()
                    held = 0
        take()
        found = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        bad = np.bincount(doc, ~self.fits[found], minlength=len(texts)) > 0
        stays = ~bad[doc]
        found, doc = found[stays], doc[stays]
        figures = [np.bincount(doc, self.figures[found, k], minlength=len(texts)).astype(np.int64) for k in range(4)]
        size = (self.first[found + 1] - self.first[found]).astype(np.int64)
        at = np.repeat(self.first[found] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner, pairs, times = summed(np.repeat(doc, size), self.keys[at], self.times[at])
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        edges = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        order = found.tolist()
        groups = ["".join([self.text[i] for i in order[lo:hi]])[:-1] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return {
            **{name: pa.array(x) for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), figures, strict=True)},
            "groups": pa.array(groups, pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs)),
            "links": pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
        }


def summed(owner: np.ndarray, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, keys in order, and the sum of ``times`` for each pair of them."""
    if not len(keys):
        return owner, keys, times
    order = np.lexsort((keys, owner)) if owner.max() >= 1 << 30 or keys.max() >= 1 << 33 else np.argsort(owner << 33 | keys)
    owner, keys, times = owner[order], keys[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
    return owner[new], keys[new], np.add.reduceat(times, new)


def _parts(text: str) -> Iterator[str]:
    """A text in parts that a single space at a cut divides; that space is left out, as the space before the text is."""
    lo = 0
    while len(text) - lo > PART_CHARS:
        at = lo + PART_CHARS
        while at > lo and not (text[at] == " " and not text[at - 1].isspace()):
            at -= 1
        if at == lo:
            break
        yield text[lo:at]
        lo = at + 1
    if text:
        yield text[lo:]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(ranks: str, pieces: str) -> Aligner:
    """The aligner of two vocabulary files, one per process."""
    if (ranks, pieces) not in _aligners:
        _aligners[ranks, pieces] = Aligner(ranks, pieces)
    return _aligners[ranks, pieces]


def align(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` with its texts' alignment in place of the text column.

    n_a, n_b, n_groups, n_links; groups as ``a1,a2|b1;a3|b2,b3`` in ids; pairs,
    the linked ids as a * (size of the second vocabulary) + b, ascending, and
    links, how many occurrences each has.

    Null and empty texts have no tokens, nor have texts whose tokens don't
    spell them again (such as those with U+2581): zeros, empty groups and
    arrays.  Special tokens' strings are plain text.  Texts of any length are
    aligned whole, in parts of bounded size.  Repeated rows are rows, other
    columns stay as they are, and columns of the new names are replaced; an
    empty table gives no rows.
    """
    tune(docs.sparkSession)
    ranks, pieces = ranks or default_ranks(), pieces or default_pieces()
    new = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "pairs": "array<bigint>", "links": "array<bigint>"}
    named = [(k, c) for k, c in enumerate(docs.columns) if c.lower() not in {*new, text_col.lower()}]
    keep = [c for _, c in named]
    at = docs.columns.index(text_col)
    # plain names on the way, as column names may hold dots
    bare = docs.toDF(*[f"o{k}" for k in range(len(docs.columns))])
    plain = bare.select(text_of(f"o{at}").alias("text"), *[F.col(f"o{k}").alias(f"c{i}") for i, (k, _) in enumerate(named)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(ranks, pieces)
        for batch in batches:
            if batch.num_rows:
                got = own.align(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *got.values()], [*batch.schema.names[1:], *got])

    kept = [f"c{k} {plain.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(keep))]
    got = plain.mapInArrow(run, ", ".join([*kept, *(f"{n} {t}" for n, t in new.items())]))
    return got.toDF(*keep, *new)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``align`` each pair of ids is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def rated_pairs(counts: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): whether no other pair of its first id has a higher count.  The first vocabulary bounds the broadcast side."""
    first = F.floor(F.col("pair") / n_b).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.withColumn("first", first).join(F.broadcast(highest), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS, pieces: str | None = None) -> DataFrame:
    """Adds n_best and count_sum to rows of ``align``, and drops their pairs and links.

    count_sum adds up, over a row's links, in how many rows the pair is linked;
    n_best counts the links whose pair has the highest count of its first id,
    ties included.

    The counts of at most ``hot_pairs`` pairs, all those of a count from some
    power of two on, go to every task; the others' are joined by pair.  None of
    these is in many rows beside the hot ones, so no join has a hot key.
    """
    import sentencepiece

    spark = aligned.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces()).get_piece_size()
    row, = fresh(aligned, "row")
    table = written(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = written(rated_pairs(pair_counts(table), n_b), "pair-counts")
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}  # at most 63 rows
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > hot_pairs:
            break
        least, held = k, held + sizes[k]
    rare = held < sum(sizes.values())
    hot = counts.where(level >= least).toArrow()  # at most hot_pairs rows
    order = np.argsort(hot["pair"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def found(batch: pa.RecordBatch):
        """Each link's row in the batch, pair, occurrences, place among the hot pairs, and whether it is one of them."""
        keys, _, _ = known.value
        pairs, links = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "links"))
        size = np.diff(pairs.offsets.to_numpy()).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), size)
        flat, times = pairs.flatten().to_numpy(), links.flatten().to_numpy()
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        return owner, flat, times, at, hit

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = known.value
        for batch in batches:
            owner, _, times, at, hit = found(batch)
            owner, times, at = owner[hit], times[hit], at[hit]
            # sums of int64, exact at any size
            total, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, times * n[at])
            np.add.at(tops, owner, times * best[at])
            keep = [batch.column(k) for k, c in enumerate(batch.schema.names) if c not in ("pairs", "links")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tops), pa.array(total)], [f"c{k}" for k in range(len(keep) + 2)])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, flat, times, _, hit = found(batch)
            rows = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rows[owner[~hit]]), pa.array(flat[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

    keep = [c for c in table.columns if c not in ("pairs", "links")]
    plain = table.toDF(*[c if c in ("pairs", "links") else f"c{k}" for k, c in enumerate(table.columns)])
    fields = [f"c{k} {plain.schema.fields[table.columns.index(c)].dataType.simpleString()}" for k, c in enumerate(keep)]
    out = plain.mapInArrow(sums, ", ".join([*fields, "tops long, total long"])).toDF(*keep, "n_best", "count_sum")
    if rare:
        rest = table.select(row, "pairs", "links").mapInArrow(others, "row long, pair long, times long")
        got = rest.join(counts.where(level < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        got = got.withColumnRenamed("row", "other_row")
        out = out.join(got, F.col(row) == F.col("other_row"), "left")
        more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        out = out.withColumns(more).drop("other_row", "more_best", "more_sum")
    return out.drop(row)


def cross_alignment(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``align`` and ``with_counts`` of one table."""
    return with_counts(align(docs, text_col))
