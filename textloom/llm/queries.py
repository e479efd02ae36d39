"""The registered queries of the corpus operators, one ``opN_<name>`` each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, exact_dedup, language, licences, mixing, near_join, packing, resampling, sharding, vector_forest

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_permutation_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.shard_names()).select("doc_id", "slot", "shard")


def op2_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op3_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("ident")


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: the confirmed licence paragraphs, and the family of the most certain one."""
    found = licences.scan(table(spark, folder, "documents"))
    best = F.element_at(F.array_sort("matches", lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(0)), 1)
    top = F.when(F.size("matches") > 0, best)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_licences"), F.coalesce(top["family"], F.lit("unknown")).alias("licence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"]))), ",").alias("families"),
        F.array_join(F.transform("matches", lambda m: m["paragraph"].cast("string")), ",").alias("paragraphs"),
        F.coalesce(top["probability"], F.lit(0.0)).alias("probability"), F.coalesce(top["resemblance"], F.lit(0.0)).alias("resemblance"),
    )


def op6_bayes_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.near_join(table(spark, folder, "documents")).drop("ident")


def op7_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, folder, "embeddings"))


def op8_class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score(table(spark, folder, "documents"))


def op9_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The sample is as large a part of all documents as the labels call good of theirs."""
    labels = table(spark, folder, "labels")
    return resampling.resample(table(spark, folder, "documents"), labels, resampling.good_share(labels)).drop("ident")


def op10_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(text) || ':' || text, '-') || coalesce(strlen(lang) || ':' || lang, '-')
             || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS ident
  FROM documents
), s AS (
  SELECT s, sum(size)::BIGINT AS source_size, 1.0 + (row_number() OVER (ORDER BY s) - 1) % 3 AS weight FROM d GROUP BY s
), r AS (
  SELECT s, source_size, weight::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, s) AS k FROM s
), levels AS (
  SELECT ((SELECT sum(source_size) FROM r)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT s, source_size, least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM r
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM t
), p AS (
  SELECT d.*, source_size, target, budget, passes,
         sum(size) OVER (PARTITION BY d.s ORDER BY md5(ident || '0'), ident ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b USING (s)
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
FROM p
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))])) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE n_both::DOUBLE / (x.n + y.n - n_both) >= 0.8
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links, class_id = d.doc_id AS kept
FROM documents d JOIN class USING (doc_id)
"""


OP1_SQL = """
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range(32) r(i)
), orders AS (
  SELECT i, name, list_transform(range(4099), lambda k:
           ((('0x' || left(md5(name || ':offset'), 15))::BIGINT % 4099)
            + k * (('0x' || left(md5(name || ':skip'), 15))::BIGINT % 4098 + 1)) % 4099) AS slots FROM shards
), turns AS (
  SELECT -1::BIGINT AS turn, NULL::BIGINT AS slot, NULL::VARCHAR AS name, list_transform(range(4099), lambda k: false) AS taken
  UNION ALL
  SELECT turn, slot, name, list_transform(taken, lambda t, k: t OR k = slot + 1) FROM (
    SELECT t.turn + 1 AS turn, o.name, t.taken, list_filter(o.slots, lambda s: NOT t.taken[s + 1])[1] AS slot
    FROM turns t JOIN orders o ON o.i = (t.turn + 1) % 32 WHERE t.turn + 1 < 4099
  )
), owners AS (SELECT slot, name FROM turns WHERE turn >= 0)
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT % 4099 AS slot FROM documents) d JOIN owners USING (slot)
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), class AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN class USING (vec_id)
"""


def queries() -> dict[str, Query]:
    found = (
        op1_permutation_shards, op2_grace_dedup, op3_hyperdimensional_language, op4_source_mix, op5_licence_scan, op6_bayes_jaccard_join,
        op7_projection_forest, op8_class_bigrams, op9_importance_resampling, op10_binary_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Not here, as SQL cannot express them: op3, op5, op8 and op9 (trained models), op10 (a tokenizer)."""
    return {"op1_permutation_shards": OP1_SQL, "op2_grace_dedup": OP2_SQL, "op4_source_mix": OP4_SQL, "op6_bayes_jaccard_join": OP6_SQL, "op7_projection_forest": OP7_SQL}
