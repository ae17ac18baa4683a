"""The operators of this subpackage as queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import bpe, html_text, langid, media, mixing, near_dedup, quality, substring, token_files, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetition=4.0, share=1.0)
    return mixed.select("doc_id", "source", "epoch", F.expr(mixing.TOKENS).cast("long").alias("n_tokens"), "block", "place")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: those that the vectors of `embeddings` describe, all of them."""
    return media.copies(media.render(_table(spark, sf_dir, "embeddings")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256.0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), 0.3)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = substring.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_token_files, op3_mixing, op4_language_id, op5_bpe, op6_media, op7_main_text, op8_topk, op9_quality, op10_substring_dedup)
}

ORACLE_SQL = {
    "op1_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l USING (doc_id)
""",
    "op3_mixing": """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce((length(text) + 3) // 4, 0) AS BIGINT) AS t, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), sizes AS (SELECT source, CAST(sum(t) AS BIGINT) AS n FROM docs GROUP BY source HAVING sum(t) > 0),
one AS (SELECT list(CAST(n AS DOUBLE) ORDER BY n) AS ns, CAST(sum(n) AS DOUBLE) AS total FROM sizes),
halves(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE low END, CASE WHEN up THEN high ELSE mid END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid,
      pow(ns[1] / total, (low + high) / 2 - 1) / list_sum(list_transform(ns, lambda x: pow(x / total, (low + high) / 2))) > 4 AS up
    FROM halves, one WHERE i < 40)
), told AS (
  SELECT source, n, least(CAST(ceil(n / 65536) AS BIGINT), 262144) AS blocks,
    CAST(floor(round(pow(n / total, a) / list_sum(list_transform(ns, lambda x: pow(x / total, a))), 9) * total) AS BIGINT) AS budget
  FROM sizes, one, (SELECT round(high, 6) AS a FROM halves WHERE i = 40)
), plan AS (SELECT *, budget // n AS whole, budget % n AS rest FROM told),
placed AS (SELECT d.*, p.whole, p.rest, CAST(('0x' || substr(k, 1, 6)) AS BIGINT) % p.blocks AS b FROM docs d LEFT JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
sums AS (SELECT source, b, whole, rest, sum(t) AS t FROM placed WHERE whole IS NOT NULL GROUP BY ALL),
epochs AS (SELECT *, CAST(unnest(range(0, CAST(whole AS BIGINT) + 1)) AS BIGINT) AS epoch FROM sums),
runs AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS place, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) - t AS before FROM epochs
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('17:' || CAST(epoch AS VARCHAR) || ':' || CAST(b AS VARCHAR)), b)
), rooms AS (SELECT source, b, CASE WHEN before + t <= rest THEN -1 ELSE greatest(0, rest - before) END AS room FROM runs WHERE epoch = whole),
summed AS (
  SELECT p.*, r.room, sum(p.t) OVER (PARTITION BY p.source, p.b ORDER BY md5(p.k || ':' || CAST(p.whole AS VARCHAR)), p.doc_id, p.t ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p LEFT JOIN rooms r ON p.source IS NOT DISTINCT FROM r.source AND p.b = r.b
), timed AS (
  SELECT doc_id, source, t, b, CASE WHEN room IS NULL THEN 1 WHEN room < 0 THEN whole + 1 WHEN room > 0 AND upto <= room THEN whole + 1 ELSE whole END AS times FROM summed
), each AS (SELECT doc_id, source, t, b, CAST(unnest(range(0, CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM timed)
SELECT x.doc_id, x.source, x.epoch, x.t AS n_tokens, r.b AS block, r.place FROM each x LEFT JOIN runs r ON x.source IS NOT DISTINCT FROM r.source AND x.b = r.b AND x.epoch = r.epoch
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
}
