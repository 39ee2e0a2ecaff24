"""Expressions over alignment strings: lengths followed by an operation, such as 10M2D5M3S."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """Array of (n, op)."""
    found = F.regexp_extract_all(cigar, F.lit(r"[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(x, "[^0-9]", "").cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def total(cigar: Column, ops: str) -> Column:
    """Summed lengths of the operations in ``ops``."""
    some = F.filter(operations(cigar), lambda o: o["op"].isin(*ops))
    return F.aggregate(some, F.lit(0), lambda acc, o: acc + o["n"])


def matched(cigar: Column) -> Column:
    return total(cigar, "M=")


def missed(cigar: Column) -> Column:
    """Bases that are inserted, deleted, skipped or substituted."""
    return total(cigar, "IDNX")


def clipped(cigar: Column) -> Column:
    """Struct of the bases that are clipped before and behind what is aligned."""
    ops = operations(cigar)

    def end(o: Column) -> Column:
        return F.when(o["op"].isin("S", "H"), o["n"]).otherwise(0)

    return F.struct(end(F.get(ops, F.lit(0))).alias("before"), F.when(F.size(ops) > 1, end(F.element_at(ops, -1))).otherwise(0).alias("behind"))


def end_on_reference(start: Column, cigar: Column) -> Column:
    return start + total(cigar, "MDN=X")


def expanded(seq: Column, ref: Column, cigar: Column) -> Column:
    """Struct of both sequences with dashes where the alignment has gaps: D in the sequence, I in the reference."""
    empty = F.lit("")
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), empty.alias("seq"), empty.alias("ref"), seq.alias("s"), ref.alias("r"))

    def step(acc: Column, o: Column) -> Column:
        n, gap = o["n"], F.repeat(F.lit("-"), o["n"])
        takes_seq, takes_ref = o["op"] != "D", o["op"] != "I"
        return F.struct(
            F.when(takes_seq, acc["i"] + n).otherwise(acc["i"]).alias("i"),
            F.when(takes_ref, acc["j"] + n).otherwise(acc["j"]).alias("j"),
            F.concat(acc["seq"], F.when(takes_seq, F.substring(acc["s"], acc["i"], n)).otherwise(gap)).alias("seq"),
            F.concat(acc["ref"], F.when(takes_ref, F.substring(acc["r"], acc["j"], n)).otherwise(gap)).alias("ref"),
            acc["s"].alias("s"),
            acc["r"].alias("r"),
        )

    return F.aggregate(operations(cigar), start, step, lambda acc: F.struct(acc["seq"].alias("seq"), acc["ref"].alias("ref")))
