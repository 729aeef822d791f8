"""The corpus queries and their SQL, in the form that the driver's entry file registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_topk, mixing, near_dedup, nearest, packing, secrets, token_store, toxicity, viterbi, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return viterbi.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_nearest(spark, sf_dir):
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op4_warc(spark, sf_dir):
    return warc.warc_round_trip(spark, table(spark, sf_dir, "pages"))


def op5_secrets(spark, sf_dir):
    return secrets.secret_findings(spark, table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.schedule(spark, table(spark, sf_dir, "documents"))


def op7_token_binary(spark, sf_dir):
    return token_store.token_binary(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_toxicity(spark, sf_dir):
    return toxicity.scored_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_topk(spark, sf_dir):
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op10_packing(spark, sf_dir):
    return packing.best_fit_packing(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_nearest, op4_warc, op5_secrets, op6_mixing, op7_token_binary, op8_toxicity, op9_exact_topk, op10_packing)}

SQL = {
    "op1_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
k AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, k.y FROM r JOIN k ON r.other = k.x),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (doc_id)""",
    "op3_nearest": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
          FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20""",
    "op4_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM f""",
    "op9_exact_topk": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5""",
}
