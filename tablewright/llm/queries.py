"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, group_join, mixing, ns_kmeans, ordinal_quality, piece_bpe, pivot_permutation, rendezvous, stream_dedup, surrogates, token_transducer, toxicity, variants
from ._io import table

#: The vocabulary of the token queries; a parameter of the operators.
MODEL = "piece_bpe_32k.model"
CONTEXT_TOKENS = 4096
#: The setting that names the surrogates' key; where it is unset the query's key is its name, and its surrogates are no secret.
SURROGATE_KEY = "spark.tablewright.surrogates.key"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def rating() -> Column:
    """Graded rating of a labelled document: 0 junk, 1 toxic, 2 neither."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"), rating(), grades=3)
    return ordinal_quality.grade(docs, model, select_grade=1, threshold=0.5)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A pattern, as a table is one file or a folder of files and the source takes folders and patterns.
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    out = stream_dedup.deduplicate(docs, stream)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rendezvous.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), key=spark.conf.get(SURROGATE_KEY, "op5"))


def op6_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_permutation.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, drop_every=97, ratio=2)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ordinal_quality, op3_source_mix, op4_group_join, op5_surrogates, op6_pivot_permutation, op7_token_counts, op8_stream_dedup, op9_rendezvous_shards, op10_sentencepiece, op11_spelling_variants, op12_fingerprints, op13_ns_bounds)}

def _assign_sql(r: int) -> str:
    """Each vector's nearest centroid of round ``r``, and those of the next round."""
    return f"""
        a{r} AS (SELECT rid, vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS cluster, min(d) AS d FROM (
                   SELECT rid, vec_id, k.v, c, CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
                   FROM kept k CROSS JOIN c{r} m) GROUP BY rid, vec_id),
        s{r} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                 FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i),
        c{r + 1} AS (SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (
                   SELECT cluster, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS m FROM s{r} GROUP BY cluster) ON cluster = c)"""


ORACLE = {
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)),
             runs AS (SELECT doc_id, run, count(*) AS n FROM (
                 SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
                 FROM documents) WHERE length(run) >= 5 GROUP BY doc_id, run),
             hexed AS (SELECT row_number() OVER () AS rid, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
             hashed AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x), 2),
                   lambda j: 16 * (strpos('0123456789ABCDEF', x[j + 1]) - 1) + strpos('0123456789ABCDEF', x[j + 2]) - 1),
                   lambda c, b: xor(c >> 8, list_extract(t, xor(c & 255, b) + 1)))) AS h FROM hexed, crc),
             words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                 SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
               WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
             cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (
                 SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
             links AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                       UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
                       UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
             best AS (SELECT a, count(*) AS n_near, arg_min(b, (-nb, encode(b))) AS near, max(nb) AS nb FROM links GROUP BY a),
             forms AS (SELECT word, CASE WHEN nb >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 2 * n THEN nb END AS form_n
                       FROM words LEFT JOIN best ON a = word),
             walk AS (SELECT word AS start, word AS here, 0 AS step FROM words
                      UNION ALL SELECT start, form, step + 1 FROM walk JOIN forms ON here = word WHERE form IS NOT NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT start, arg_max(here, step) AS root FROM walk GROUP BY start) ON start = word""",
    "op13_ns_bounds": """
        WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16),""" + ",".join(map(_assign_sql, range(4))) + """
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
        FROM a3 JOIN c3 ON c = cluster""",
    "op4_group_join": r"""
        WITH RECURSIVE d AS (
               SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
             t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS token FROM s),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
             r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
        SELECT doc_id, len(sh) AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id
        FROM s LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = doc_id""",
    "op6_pivot_permutation": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
             p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                   WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.93),
             r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
             n AS (SELECT x, count(*) AS n FROM p GROUP BY x), m AS (SELECT x, min(y) AS m FROM r GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, m), vec_id) AS component_id, coalesce(least(vec_id, m), vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id""",
    "op8_stream_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)""",
}
