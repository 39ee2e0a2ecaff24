"""License scans by MinHash bands over overlapping windows.

A text is covered by overlapping windows of word shingles in a few sizes.
Bands of one MinHash row each retrieve the templates that share a window's
smallest shingle; with ``BANDS`` bands a window that holds four fifths of a
template's shingles is retrieved with a chance of at least 0.9995 (its Jaccard
similarity to the template is 0.19 or more, since a window is at most four
times as long).  A retrieved template counts if the window and its
surroundings contain at least ``CONTAINMENT`` of its shingles exactly.

A template of fewer words than a shingle is one shingle of its own length,
whose MinHash is itself: it is found where it stands word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of, tune, utf8
from .words import Words, mixed, rolled, words_of

SHINGLE = 5
BANDS = 40
CONTAINMENT = 0.8
#: Shingles that the smallest window's half has; sizes double from there.
LEAST_HALF = 2
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_FILTER_BITS = 16

#: Notices that are looked for unless others are given.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("All-rights-reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _rows(g: np.ndarray, band: int) -> np.ndarray:
    return mixed(g * np.uint64(2 * band + 0x9E3779B97F4A7C15) + np.uint64(band + 1))


@dataclass
class Index:
    """MinHash values of the templates by window size and band, and their shingles."""

    names: list[str]
    shingles: list[np.ndarray]
    half: list[int]
    values: dict[int, list[dict[int, list[int]]]]
    filters: dict[int, np.ndarray]
    short: dict[int, dict[int, list[int]]]

    @classmethod
    def of(cls, templates) -> Index:
        names, shingles, halves = [], [], []
        values: dict[int, list[dict[int, list[int]]]] = {}
        filters: dict[int, np.ndarray] = {}
        short: dict[int, dict[int, list[int]]] = {}
        for name, text in templates:
            h = words_of([text.encode()], bare=True).hash
            if not len(h):
                raise ValueError(f"template {name} has no words")
            if len(h) < SHINGLE:
                key = int(rolled(h, tuple(range(len(h))))[0])
                short.setdefault(len(h), {}).setdefault(key, []).append(len(names))
                names.append(name)
                shingles.append(np.zeros(0, np.uint64))
                halves.append(0)
                continue
            g = np.unique(rolled(h, tuple(range(SHINGLE))))
            half = max(LEAST_HALF, 1 << (len(g) - 1).bit_length())
            t = len(names)
            names.append(name)
            shingles.append(g)
            halves.append(half)
            own = values.setdefault(half, [{} for _ in range(BANDS)])
            bits = filters.setdefault(half, np.zeros((BANDS, 1 << _FILTER_BITS), bool))
            for band in range(BANDS):
                v = int(_rows(g, band).min())
                own[band].setdefault(v, []).append(t)
                bits[band, v >> (64 - _FILTER_BITS)] = True
        return cls(names, shingles, halves, values, filters, short)


def _short_places(w: Words, index: Index) -> list[tuple[int, int, float, int, int]]:
    """The first place of each short template in each text."""
    best: dict[tuple[int, int], int] = {}
    for size, keys in index.short.items():
        g = rolled(w.hash, tuple(range(size)))
        at = np.flatnonzero(np.isin(g, np.array(list(keys), np.uint64)))
        text = np.searchsorted(w.first, at, "right") - 1
        inside = at + size <= w.first[text + 1]
        for place, i in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
            for t in keys[int(g[place])]:
                best.setdefault((i, t), place - int(w.first[i]))
    return [(i, t, 1.0, at, at + len_) for (i, t), at in best.items() for len_ in (_size_of(index, t),)]


def _size_of(index: Index, template: int) -> int:
    return next(size for size, keys in index.short.items() if any(template in ts for ts in keys.values()))


def scan(texts: list[bytes], index: Index, containment: float) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first word, end word), the best place of each text and template."""
    w = words_of(texts, bare=True)
    found = _short_places(w, index)
    g = rolled(w.hash, tuple(range(SHINGLE)))
    if not len(g) or not index.values:
        return sorted(found)
    n_of = np.maximum(np.diff(w.first) - SHINGLE + 1, 0)  # shingles of each text
    top = max(index.values)
    room = -(-n_of // (2 * top)) * (2 * top)  # each text begins at a window's edge of every size
    base = np.concatenate([[0], np.cumsum(room)])
    text_at = np.repeat(np.arange(len(texts)), n_of)
    nth = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    place, source = base[text_at] + nth, w.first[text_at] + nth
    own = g[source]
    candidates: set[tuple[int, int, int]] = set()
    lane = np.empty(int(base[-1]), np.uint64)
    for band in range(BANDS):
        lane[:] = _MOST
        lane[place] = _rows(own, band)
        low, half = lane, 1
        while half <= top:
            if half in index.values:
                pair = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                hits = np.flatnonzero(index.filters[half][band][(pair >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                for at in hits.tolist():
                    for t in index.values[half][band].get(int(pair[at]), ()):
                        candidates.add((t, half, at * half))
            if half < top:
                low = np.minimum(low[::2], low[1::2])
            half *= 2
    best: dict[tuple[int, int], tuple] = {}
    for t, half, at in sorted(candidates):
        # the window's two halves may belong to neighbouring texts; each is looked at with its surroundings
        for inside in {at, min(at + half, int(base[-1]) - 1)}:
            text = int(np.searchsorted(base, inside, "right")) - 1
            lo, hi = max(at - half, int(base[text])), min(at + 3 * half, int(base[text]) + int(n_of[text]))
            if lo >= hi:
                continue
            first = int(w.first[text])
            part = g[first + lo - int(base[text]) : first + hi - int(base[text])]
            on = np.flatnonzero(np.isin(part, index.shingles[t]))
            if not len(on):
                continue
            share = len(np.unique(part[on])) / len(index.shingles[t])
            begin = lo - int(base[text])
            got = (share, -(begin + int(on[0])), begin + int(on[-1]) + SHINGLE)
            if share >= containment and got > best.get((text, t), (0.0,)):
                best[text, t] = got
    return sorted([*found, *((text, t, s, -a, b) for (text, t), (s, a, b) in best.items())])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row and template found: doc_id, license, containment, word_start, word_end.

    Words are runs of letters, digits and non-ASCII signs, lower-cased; the
    places are those of the best match, the first among equals.  Null and
    empty texts have no rows; long texts are scanned whole; repeated rows have
    their rows each; an empty table gives no rows.  Extra columns of any names
    are ignored.
    """
    tune(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index.of(templates))  # as large as the templates given
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> dict | None:
        got = scan(utf8(batch.column(1)), index.value, containment)
        if not got:
            return None
        text, t, share, lo, hi = zip(*got, strict=True)
        return {
            "doc_id": batch.column(0).take(pa.array(text)),
            "license": pa.array([index.value.names[x] for x in t]),
            "containment": pa.array(share, pa.float64()),
            "word_start": pa.array(lo, pa.int64()),
            "word_end": pa.array(hi, pa.int64()),
        }

    return arrow_map(rows, run, "doc_id long, license string, containment double, word_start long, word_end long")
