"""Registered queries of the corpus operators: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import ann, balance, collocations, decontam, html, langid, minhash, negatives, packing, pii, quality, repeats, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.Tree.even(40))


@query
def op2_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


@query
def op3_linear_program_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op5_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_recurrent_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.annotated(docs, pii.train(docs))


@query
def op9_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query
def op4_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query
def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.pack(table(spark, sf_dir, "documents"))


@query
def op12_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, label, every_row=True)


ORACLES["op12_slot_hard_negatives"] = """
WITH fine AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


@query
def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_trie_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
spans AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM split),
total AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM spans GROUP BY lang),
grams AS (SELECT lang, size, words[p:p + size - 1] AS phrase FROM spans, range(1, 6) t(size) WHERE p + size - 1 <= len(words)),
counts AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE size > 1),
inner_phrases AS (
  SELECT c.lang, c.f, c.phrase[s:s + m - 1] AS phrase
  FROM candidates c, range(2, 5) t(m), range(1, 5) u(s) WHERE m < c.size AND s + m - 1 <= c.size),
covered AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_phrases i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, n, (1000 * c.f * n) // (h.f * t.f) AS score
  FROM candidates c JOIN range(1, 5) x(k) ON k < c.size
  JOIN counts h ON h.lang = c.lang AND h.phrase = c.phrase[:k]
  JOIN counts t ON t.lang = c.lang AND t.phrase = c.phrase[k + 1:]
  JOIN total ON total.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.phrase = c.phrase)),
lowest AS (SELECT *, list_aggregate(phrase, 'string_agg', ' ') AS joined FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, joined AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, joined) QUALIFY row_number() OVER w <= 2000
"""
