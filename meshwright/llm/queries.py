"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import common


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import quality

    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.exact_dedup import find_duplicates

    return find_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), 40)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm import language

    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.simple8b import read_ids, write_ids

    path = common.scratch_path(spark, "token-ids")
    write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_ids(spark, path, with_ids=False)


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshwright.llm.words import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), whole=False)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshwright.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_top_k": op6_top_k,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_ids": op10_token_ids,
    "op11_word_bpe": op11_word_bpe,
    "op12_centroids": op12_centroids,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op4_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM rows WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op12_centroids": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        w AS (SELECT vec, count(*) AS weight FROM v GROUP BY vec),
        c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec) - 1 AS c, vec AS center
            FROM v QUALIFY c < 16),
        d1 AS (SELECT vec, weight, c, list_sum(list_transform(list_zip(vec, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap
               FROM w CROSS JOIN c0),
        a1 AS (SELECT vec, weight, c FROM d1 QUALIFY row_number() OVER (PARTITION BY vec ORDER BY gap, c) = 1),
        s1 AS (
            SELECT c, i, sum(weight * vec[i]) AS total, sum(weight) AS n
            FROM (SELECT c, vec, weight, unnest(range(1, 65)) AS i FROM a1) GROUP BY c, i),
        c1 AS (
            SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS center FROM s1 GROUP BY c
            UNION ALL SELECT c, center FROM c0 WHERE c NOT IN (SELECT c FROM s1)),
        d2 AS (SELECT vec, weight, c, list_sum(list_transform(list_zip(vec, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap
               FROM w CROSS JOIN c1),
        a2 AS (SELECT vec, weight, c FROM d2 QUALIFY row_number() OVER (PARTITION BY vec ORDER BY gap, c) = 1),
        s2 AS (
            SELECT c, i, sum(weight * vec[i]) AS total, sum(weight) AS n
            FROM (SELECT c, vec, weight, unnest(range(1, 65)) AS i FROM a2) GROUP BY c, i),
        c2 AS (
            SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS center FROM s2 GROUP BY c
            UNION ALL SELECT c, center FROM c1 WHERE c NOT IN (SELECT c FROM s2)),
        d3 AS (SELECT vec, weight, c, list_sum(list_transform(list_zip(vec, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap
               FROM w CROSS JOIN c2),
        a3 AS (SELECT vec, weight, c FROM d3 QUALIFY row_number() OVER (PARTITION BY vec ORDER BY gap, c) = 1),
        s3 AS (
            SELECT c, i, sum(weight * vec[i]) AS total, sum(weight) AS n
            FROM (SELECT c, vec, weight, unnest(range(1, 65)) AS i FROM a3) GROUP BY c, i),
        c3 AS (
            SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS center FROM s3 GROUP BY c
            UNION ALL SELECT c, center FROM c2 WHERE c NOT IN (SELECT c FROM s3)),
        d4 AS (SELECT vec, weight, c, list_sum(list_transform(list_zip(vec, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap,
                      sha256(array_to_string(center, ',')) AS centroid_sha256
               FROM w CROSS JOIN c3),
        a4 AS (SELECT * FROM d4 QUALIFY row_number() OVER (PARTITION BY vec ORDER BY gap, c) = 1)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(gap AS BIGINT) AS distance,
               CAST(sum(gap) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(gap) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM v JOIN a4 USING (vec)
    """,
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents),
        m AS (
            SELECT doc_id, part, CAST(len(words) < 200 AS INT) AS A, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS B,
                   CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS INT) AS C,
                   CAST(regexp_matches(body, '[#$%&*|]') AS INT) AS D,
                   CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS INT) AS E,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
            FROM d),
        x AS (SELECT part, A, B, C, D, E, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        l AS (
            SELECT x.*, filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS filter,
                   list_transform(string_split(filter_order, ''), lambda k: CASE k WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END) AS fails
            FROM x, o, range(1, 6) t(step)),
        r AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
                   sum(n) FILTER (WHERE list_sum(fails[:step]) = 0) AS kept,
                   sum(n) FILTER (WHERE fails[step] = 1 AND list_sum(fails[:step]) = 1) AS removed,
                   sum(n) FILTER (WHERE fails[step] = 1 AND list_sum(fails[:step]) > 1) AS redundant,
                   sum(n) FILTER (WHERE fails[step] = 1 AND list_sum(fails) = 1) AS unique_fails,
                   sum(good) FILTER (WHERE fails[step] = 1 AND list_sum(fails[:step]) = 1) AS good_lost,
                   sum(toxic) FILTER (WHERE fails[step] = 1 AND list_sum(fails[:step]) = 1) AS toxic_lost
            FROM l GROUP BY part, filter_order, step, filter)
        SELECT part, filter_order, step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
        FROM r
    """,
}
