"""Multiple alignment of a locus' haplotypes by partial order graphs.

The graph's nodes are bases; sequences are ways through it.  A sequence is
aligned to all ways at once: a node's row of scores takes the best over the rows
of the nodes before it.  Equal bases join the nodes they are aligned with, others
become new nodes of the same column, so what many haplotypes share is one way.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np

#: Scores of the alignment.
MATCH, MISMATCH, GAP_OPEN, GAP = 2, -4, -4, -2
#: Cells of one alignment at most; larger loci are refused.
MOST_CELLS = 100_000_000
_LOW = -(10**8)


@dataclass
class Graph:
    """Bases of the nodes, the nodes before each, and the column that aligned nodes share; sequences as lists of nodes."""

    base: list[str] = field(default_factory=list)
    before: list[list[int]] = field(default_factory=list)
    after: list[list[int]] = field(default_factory=list)
    column: list[int] = field(default_factory=list)
    members: list[list[int]] = field(default_factory=list)
    ways: list[list[int]] = field(default_factory=list)

    def node(self, base: str, column: int | None = None) -> int:
        self.base.append(base)
        self.before.append([])
        self.after.append([])
        if column is None:
            column = len(self.members)
            self.members.append([])
        self.column.append(column)
        self.members[column].append(len(self.base) - 1)
        return len(self.base) - 1

    def columns(self) -> list[int]:
        """Columns in an order that all ways keep."""
        waits = [len({self.column[p] for n in m for p in self.before[n]}) for m in self.members]
        ready, order = [c for c in reversed(range(len(waits))) if not waits[c]], []
        while ready:
            c = ready.pop()
            order.append(c)
            for d in sorted({self.column[x] for n in self.members[c] for x in self.after[n]}, reverse=True):
                waits[d] -= 1
                if not waits[d]:
                    ready.append(d)
        return order

    def add(self, sequence: str) -> None:
        """Aligns a sequence and makes it a way of the graph."""
        matched = self._aligned(sequence) if self.base and sequence else [None] * len(sequence)
        way = []
        for letter, at in zip(sequence, matched, strict=True):
            if at is None:
                now = self.node(letter)
            else:
                column = self.column[at]
                now = next((n for n in self.members[column] if self.base[n] == letter), None)
                if now is None:
                    now = self.node(letter, column)
            if way and way[-1] not in self.before[now]:
                self.before[now].append(way[-1])
                self.after[way[-1]].append(now)
            way.append(now)
        self.ways.append(way)

    def _aligned(self, sequence: str) -> list[int | None]:
        """For each base of the sequence the node that it is aligned with, None where it is inserted: a best global alignment with affine gaps."""
        order = [n for c in self.columns() for n in self.members[c]]
        n, m = len(order), len(sequence)
        if (n + 1) * (m + 1) > MOST_CELLS:
            raise ValueError(f"a locus of {n} nodes and {m} bases is too large for this aligner")
        q, j = np.frombuffer(sequence.encode(), np.uint8), np.arange(m + 1)
        row_of = {x: k + 1 for k, x in enumerate(order)}  # row 0 stands before all nodes
        best = np.full((n + 1, m + 1), _LOW, np.int32)
        down = np.full((n + 1, m + 1), _LOW, np.int32)
        best[0] = np.where(j == 0, 0, GAP_OPEN + GAP * j)
        for k, x in enumerate(order, 1):
            rows = [row_of[p] for p in self.before[x]] or [0]
            opened = best[rows].max(0)
            down[k] = np.maximum(opened + GAP_OPEN, down[rows].max(0)) + GAP
            score = np.where(q == ord(self.base[x]), MATCH, MISMATCH)
            own = down[k].copy()
            own[1:] = np.maximum(own[1:], opened[:-1] + score)
            # insertions: the running maximum of what a gap from each place would cost
            run = np.maximum.accumulate(own - GAP * j)
            best[k] = own
            best[k, 1:] = np.maximum(own[1:], run[:-1] + GAP_OPEN + GAP * j[1:])
        ends = [row_of[x] for x in order if not self.after[x]]
        k, i, state = max(ends, key=lambda r: (best[r, m], -r)), m, "best"
        out: list[int | None] = [None] * m
        while k or i:
            if k == 0:
                break  # the rest is inserted before all nodes
            x = order[k - 1]
            rows = [row_of[p] for p in self.before[x]] or [0]
            if state == "down":
                k, state = next((r, s) for r in rows for s, v in (("best", best[r, i] + GAP_OPEN), ("down", down[r, i])) if v + GAP == down[k, i])
                continue
            hit = i and next((r for r in rows if best[r, i - 1] + (MATCH if sequence[i - 1] == self.base[x] else MISMATCH) == best[k, i]), None)
            if hit is not None and i:
                out[i - 1] = x
                k, i = hit, i - 1
            elif best[k, i] == down[k, i]:
                state = "down"
            else:
                # the insertion that ends here
                length = next(g for g in range(1, i + 1) if best[k, i - g] + GAP_OPEN + GAP * g == best[k, i])
                i -= length
        return out


def multiple_alignment(sequences: list[str]) -> list[str]:
    """Rows of equal length with dashes, one for each sequence; equal columns hold what is aligned.

    Sequences are added from the longest to the shortest, equal ones once.
    Ends that all share are set aside, so no gap comes before a shared first base.
    """
    if not sequences:
        return []
    head = len(os.path.commonprefix(sequences))
    rest = [s[head:] for s in sequences]
    tail = len(os.path.commonprefix([s[::-1] for s in rest]))
    rest = [s[: len(s) - tail] for s in rest]
    graph, row_of = Graph(), {}
    for s in sorted(set(rest), key=lambda s: (len(s), s), reverse=True):
        row_of[s] = len(graph.ways)
        graph.add(s)
    place = {c: k for k, c in enumerate(graph.columns())}
    rows = []
    for way in graph.ways:
        row = ["-"] * len(place)
        for x in way:
            row[place[graph.column[x]]] = graph.base[x]
        rows.append("".join(row))
    first = sequences[0]
    return [first[:head] + rows[row_of[s]] + first[len(first) - tail :] for s in rest]


def without_shared_gaps(a: str, b: str) -> tuple[str, str]:
    """Two rows of a multiple alignment without the columns in which both have a gap."""
    kept = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
    return "".join(x for x, _ in kept), "".join(y for _, y in kept)
