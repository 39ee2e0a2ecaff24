"""The scalar functions as SQL functions of a session, without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "sv_overlaps": ("s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT", "BOOLEAN", "greatest(s1, s2) < least(e1, e2)"),
    "sv_reciprocal_overlap": (
        "s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT",
        "DOUBLE",
        "CASE WHEN greatest(s1, s2) < least(e1, e2) THEN try_divide(least(e1, e2) - greatest(s1, s2), greatest(e1 - s1, e2 - s2)) ELSE 0D END",
    ),
    "sv_overlap_percent": (
        "s1 BIGINT, e1 BIGINT, s2 BIGINT, e2 BIGINT",
        "DOUBLE",
        "CASE WHEN s1 >= s2 AND e1 <= e2 THEN 1D ELSE try_divide(greatest(least(e1, e2) - greatest(s1, s2), 0), e1 - s1) END",
    ),
    "sv_size_similarity": (
        "a BIGINT, b BIGINT",
        "DOUBLE",
        "CASE WHEN a = 0 AND b = 0 THEN 1D ELSE least(greatest(a, 1), greatest(b, 1)) / greatest(greatest(a, 1), greatest(b, 1)) END",
    ),
    "sv_sequence_similarity": (
        "a STRING, b STRING",
        "DOUBLE",
        "try_divide(length(a) + length(b) - levenshtein(upper(a), upper(b)), length(a) + length(b))",
    ),
    "sv_smallest_rotation": (
        "a STRING",
        "STRING",
        "array_min(transform(sequence(1, greatest(length(a), 1)), i -> substring(concat(a, a), i, length(a))))",
    ),
    "sv_gc_percent": ("a STRING", "INT", "CASE WHEN length(a) > 0 THEN int(floor(regexp_count(a, '[GC]') * 100 / length(a))) END"),
    "sv_reverse_complement": ("a STRING", "STRING", "reverse(translate(a, 'ATCG', 'TAGC'))"),
    "sv_bnd_score": (
        "st BIGINT, ed BIGINT, bnddist BIGINT",
        "DOUBLE",
        "CASE WHEN bnddist > 0 THEN greatest(0D, (1 - ((abs(st) + abs(ed)) / 2) / (bnddist * 2)) * 100) ELSE 0D END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
