"""The operators over the synthetic tables, under fixed output contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    decontaminate,
    exact_dedup,
    language_id,
    licenses,
    lm_score,
    multi_index,
    packing,
    pii,
    prefix_trie,
    simhash,
    token_counts,
    toxicity,
)
from .common import crc_mod, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from labelled documents outside the held-out quarter."""
    learned = crc_mod("doc_id", 4) != 2
    return toxicity.learn(_documents(spark, sf_dir).where(learned), table(spark, sf_dir, "labels").where(learned))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null texts count as empty, an empty table gives no rows."""
    got = toxicity.scored(_documents(spark, sf_dir), toxicity_model(spark, sf_dir))
    return got.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and notice found in it: doc_id, license, containment, word_start, word_end."""
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans of every document."""
    found = pii.find_pii(_documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length that occurs, with the suffix sums and the quantile that it is.

    Any other limit L is answered by the row of the next longer length:
    total_tokens - tokens_at_least + docs_at_least * L tokens stay.
    """
    got = token_counts.token_counts(_documents(spark, sf_dir))
    return got.withColumn("quantile", F.col("docs_up_to") / F.col("total_docs"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    got = packing.pack(_documents(spark, sf_dir), payload="ids_crc32")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    got = simhash.near_duplicates(_documents(spark, sf_dir))
    return got.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_dedup.dedup_report(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from labelled documents outside the held-out quarter."""
    docs = _documents(spark, sf_dir)
    model = language_id.learn(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    got = language_id.identified(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains, with the places of the stretch."""
    return decontaminate.contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, word counts, base_score and the model's score of every document."""
    return lm_score.lm_scores(_documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    conv = F.col("conv")
    shared = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), shared, conv - conv % 5, 8)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; vectors that can't be compared have no links and are kept."""
    got = multi_index.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.select("vec_id", "n_links", "component_id", "kept")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; null and empty texts have zeros and an empty digest."""
    got = alignment.align(_documents(spark, sf_dir).select("doc_id", "text"))
    # only the digest is kept for the second pass, as groups are several times as long as texts
    got = got.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    got = alignment.with_counts(got)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        z AS (SELECT c, count(*) AS n, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
                lambda crc, b: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END, xor(crc, b)),
                CAST(4294967295 AS BIGINT)) AS crc FROM t GROUP BY c),
        v AS (SELECT z.c, z.n, xor(z.crc, CAST(4294967295 AS BIGINT)) % 9 AS h, z.c - z.c % 5 AS b FROM z),
        m AS (SELECT v.*, least(v.h, coalesce(o.n, 0)) AS k FROM v LEFT JOIN v o ON o.c = v.b),
        w AS (SELECT m.c, t.i AS nth, t.r, t.x FROM m JOIN t ON t.c = m.b AND t.i <= m.k
              UNION ALL SELECT m.c, t.i - m.h + m.k, t.r, t.x FROM m JOIN t ON t.c = m.c AND t.i > m.h),
        p AS (SELECT c, nth, x, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w),
        e AS (SELECT m.c, coalesce(max(nth), 0) AS size FROM m LEFT JOIN w ON w.c = m.c GROUP BY m.c),
        a AS (SELECT c, nth, strlen(x) AS bytes, sha256(CAST(k AS VARCHAR) || len(k)) AS id,
                CASE WHEN nth = 1 THEN 'root' ELSE sha256(CAST(k[1:nth - 1] AS VARCHAR) || (nth - 1)) END AS up FROM p
              UNION ALL SELECT c, 0, 0, 'root', NULL FROM e),
        n AS (SELECT id, min(up) AS up, max(nth) AS depth, max(bytes) AS bytes, min(a.c) AS c, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(a.c AS VARCHAR), ',' ORDER BY a.c) FILTER (WHERE a.nth = e.size), '')) AS ends FROM a JOIN e ON e.c = a.c GROUP BY id),
        g AS (SELECT n.*, (SELECT count(*) FROM n y WHERE y.up = n.id) AS n_children FROM n),
        s AS (SELECT o.id, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves, CAST(sum((g.n_convs - 1) * g.bytes) AS BIGINT) AS saved
              FROM g JOIN a d ON d.id = g.id AND d.c = g.c JOIN a o ON o.c = g.c AND o.nth <= g.depth GROUP BY o.id)
        SELECT g.c AS conv_id, g.depth, o.c AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved AS saved_tokens, g.ends AS ends_sha256
        FROM g JOIN s ON s.id = g.id LEFT JOIN g o ON o.id = g.up
    """,
    "op7_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size,
                     sha256(coalesce(text, '')) AS text_sha256
              FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.body
    """,
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = v.vec_id
    """,
}
