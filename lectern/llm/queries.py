"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import anchors, chat, curves, exact_dedup, katz, merkle, mixture, packing, qda, rtree, simhash, spans, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(own.unionByName(probe)))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("raw_hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.private_spans(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_documents(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_chat_formatting, op3_nearest_neighbours, op4_mixture, op5_katz_lm, op6_exact_dedup, op7_simhash, op8_packing, op9_pii, op10_quality, op11_token_output, op12_merkle_manifest, op13_hard_negatives)
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(levels: int = 8, top_levels: int = 3) -> str:
    """The tree over up to eight to the power of ``levels`` rows a group, level by level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(s) + 1), lambda i: ord(substr(s, i, 1))::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"""
    parts = [f"""
        d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, coalesce('x' || lang, '') AS k, text, {" || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))} AS head FROM documents),
        e AS (SELECT doc_id, k, sha256(head || {field("text")}) AS leaf,
                     CASE WHEN {crc} % 3 = 0 THEN sha256(head || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM d),
        w0 AS (SELECT *, coalesce(changed, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e),
        n0 AS (SELECT k, i, leaf AS h, count(*) OVER (PARTITION BY k) AS c FROM w0)"""]  # fmt: skip

    def level(j: int, n: str, w: str) -> str:
        return f"""
        {n}{j + 1} AS (SELECT k, i // 8 AS i, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(c) + 7) // 8 AS c FROM {n}{j} GROUP BY k, i // 8),
        {n}p{j} AS (SELECT a.k, a.i, any_value(a.c) AS c, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                  FROM {n}{j} a JOIN {n}{j} b ON a.k = b.k AND a.i // 8 = b.i // 8 GROUP BY a.k, a.i),
        {w}{j + 1} AS (SELECT x.* REPLACE (CASE WHEN p.c > 1 THEN sha256(p.l || x.f || p.r) ELSE x.f END AS f, x.proof || p.l || p.r AS proof) FROM {w}{j} x JOIN {n}p{j} p ON x.k = p.k AND x.i // {8**j} = p.i)"""

    parts += [level(j, "n", "w") for j in range(levels)]
    parts.append(f"""
        m0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS c, k AS name FROM n{levels}),
        u0 AS (SELECT 0 AS k, m.i, w.doc_id, w.leaf, m.h AS subroot, w.f, w.proof FROM w{levels} w JOIN m0 m ON w.k = m.name)""")
    parts += [level(j, "m", "u") for j in range(top_levels)]
    return f"""
        WITH {",".join(parts)}
        SELECT doc_id, leaf, subroot, (SELECT h FROM m{top_levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM m{top_levels}) AS verified FROM u{top_levels}"""


ORACLE_SQL: dict[str, str] = {
    "op12_merkle_manifest": merkle_sql(),
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT g.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, p.vec_id AS negative_id, positive_score, p.score AS negative_score
        FROM g JOIN p ON g.anchor_id = p.anchor_id AND NOT p.same AND 80 * positive_score <= 100 * p.score AND 100 * p.score <= 100 * positive_score
        WINDOW w AS (PARTITION BY g.anchor_id, positive_id ORDER BY p.score DESC, p.vec_id) QUALIFY row_number() OVER w <= 5""",
    "op3_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_mixture": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS h FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * sum(size) AS DOUBLE) AS cap
            FROM d GROUP BY source),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM s WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
        t AS (SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), cap) AS target FROM l),
        g AS (
            SELECT *, coalesce(CAST(round(target) AS BIGINT) // nullif(source_size, 0), 0) AS whole FROM t),
        x AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS extra FROM g),
        k AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
        u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM k),
        c AS (
            SELECT u.source, u.h AS cutoff, x.extra - u.upto + u.size AS rest
            FROM u JOIN x ON u.source IS NOT DISTINCT FROM x.source WHERE u.upto > x.extra AND u.upto - u.size <= x.extra)
        SELECT d.doc_id, d.size, x.source_size, x.target,
               CAST(x.whole * d.size + CASE WHEN d.h < c.cutoff THEN d.size WHEN d.h = c.cutoff THEN c.rest ELSE 0 END AS BIGINT) AS taken
        FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, {LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
}
