"""Expressions over sequences; built-ins only, so they stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 minus the edit distance over the summed lengths.

    With ``least``, distances are only followed as far as such a similarity
    allows, and what falls short of it is 0.
    """
    x, y = F.upper(a), F.upper(b)
    total = F.length(x) + F.length(y)
    if least is None:
        return F.try_divide(total - F.levenshtein(x, y), total)
    furthest = F.ceil(total * (1 - least)).cast("int")
    d = F.call_function("levenshtein", x, y, furthest)
    return F.when(d < 0, 0.0).otherwise(F.try_divide(total - d, total))


#: Letters that rotations may have together up to which they are compared whole; beyond, two starts race each other.
FEW = 1_000_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, though it is used for every element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def smallest_rotation(seq: Column) -> Column:
    """The first of a sequence's rotations in order.

    It starts where a run of the first letter in order does, so only rotations
    from there are compared.  Where these are long and many two starts are
    compared letter by letter, and the loser moves behind what it has been
    compared over, so the work grows with the length alone.
    """

    def of_runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), s["n"] - 1), lambda i: (F.get(s["letters"], i) == s["least"]) & (F.get(s["letters"], F.pmod(i - 1, s["n"])) != s["least"]))
        return _let(F.struct(s["n"].alias("n"), starts.alias("starts")), compared)

    def compared(t: Column) -> Column:
        few = F.size(t["starts"]).cast("long") * t["n"] <= FEW
        return F.when(F.size(t["starts"]) == 0, seq).when(few, _least_of(seq, t["starts"])).otherwise(_raced(seq))

    letters = F.split(seq, "")
    held = _let(letters, lambda x: F.struct(x.alias("letters"), F.array_min(x).alias("least"), F.size(x).alias("n")))
    return F.when(F.length(seq) <= 1, seq).otherwise(_let(held, of_runs))


def _least_of(seq: Column, starts: Column) -> Column:
    """The first in order of the rotations from ``starts``; holds two at a time."""
    # what each step needs is in the accumulator, so that it is computed once
    begin = F.struct(F.lit(None).cast("string").alias("best"), F.concat(seq, seq).alias("twice"), F.length(seq).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(F.least(acc["best"], F.substring(acc["twice"], i + 1, acc["n"])).alias("best"), acc["twice"].alias("twice"), acc["n"].alias("n"))

    return F.aggregate(starts, begin, step, lambda acc: acc["best"])


def _raced(seq: Column) -> Column:
    n = F.length(seq)
    begin = F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("same"), F.split(seq, "").alias("letters"), n.alias("n"))

    def step(acc: Column, _: Column) -> Column:
        a, b, same, size = acc["a"], acc["b"], acc["same"], acc["n"]
        x, y = (F.get(acc["letters"], (i + same) % size) for i in (a, b))
        going = (a < size) & (b < size) & (same < size)

        def moved(i: Column, other: Column) -> Column:
            behind = i + same + 1
            return F.when(behind == other, behind + 1).otherwise(behind)

        return F.struct(
            F.when(going & (x > y), moved(a, b)).otherwise(a).alias("a"),
            F.when(going & (x < y), moved(b, a)).otherwise(b).alias("b"),
            F.when(going, F.when(x == y, same + 1).otherwise(0)).otherwise(same).alias("same"),
            acc["letters"].alias("letters"),
            size.alias("n"),
        )

    start = F.aggregate(F.sequence(F.lit(1), 3 * n), begin, step, lambda acc: F.least(acc["a"], acc["b"]))
    return F.concat(F.substring(seq, start + 1, n), F.substring(seq, F.lit(1), start))


def rolled_similarity(a: Column, b: Column, least: float | None = None) -> Column:
    return similarity(smallest_rotation(F.upper(a)), smallest_rotation(F.upper(b)), least)


def unrolled_similarity(a: Column, b: Column, shift: Column, least: float | None = None) -> Column:
    """Similarity of ``a`` to ``b`` turned right by ``shift``."""
    n = F.length(b)
    f = F.when(n > 0, F.pmod(shift, F.greatest(n, F.lit(1)))).otherwise(F.lit(0))
    turned = F.concat(F.substring(b, n - f + 1, f), F.substring(b, F.lit(1), n - f))
    return similarity(a, turned, least)


def best_similarity(a: Column, b: Column, distance: Column, roll_below: int = 500, least: float | None = None) -> Column:
    """The best of direct, unrolled either way from either side, and (for short sequences) rolled."""
    ways = [unrolled_similarity(a, b, distance, least), unrolled_similarity(a, b, -distance, least)]
    ways += [unrolled_similarity(b, a, distance, least), unrolled_similarity(b, a, -distance, least)]
    short = (F.length(a) < roll_below) & (F.length(b) < roll_below)
    return F.greatest(similarity(a, b, least), *ways, F.when(short, rolled_similarity(a, b, least)).otherwise(F.lit(0.0)))


def gc_percent(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, F.floor(F.regexp_count(seq, F.lit("[GC]")) * 100 / n).cast("int"))


def entropy(seq: Column, letters: int = 4) -> Column:
    """Shannon entropy, to base ``letters``, over the first so many different letters."""
    n = F.length(seq)
    distinct = F.slice(F.array_distinct(F.split(seq, "")), 1, letters)
    share = F.transform(distinct, lambda c: (n - F.length(F.replace(seq, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log(p) / math.log(letters)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def faux_repeat(motif: Column, copies: Column) -> Column:
    """The motif as often as whole copies go, and the part that is left."""
    whole = F.floor(copies).cast("int")
    part = F.floor(F.length(motif) * (copies - whole)).cast("int")
    return F.concat(F.repeat(motif, whole), F.substring(motif, F.lit(1), part))
