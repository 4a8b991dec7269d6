"""The registered queries of this subpackage and, where SQL can say it, their DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, quality, toxicity, warc
from .alignment import align_tokenizers
from .fingerprints import fingerprint_edits
from .jaccard_join import ngram_jaccard_join
from .mips import mips_search
from .negatives import hard_negatives
from .sentencepiece import encode_documents
from .store import table
from .substring_dedup import substring_dedup
from .token_counts import length_histogram, length_profile

WORD = r"[^\x20\x09-\x0D]+"


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (
  SELECT doc_id, i AS s, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
),
rep AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY ALL
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_profile(length_histogram(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = mixing.sizes(table(spark, sf_dir, "documents"))
    out = mixing.mix(slim, mixing.by_rule(slim, (1.0, 2.0, 3.0)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_position")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM s),
r AS (SELECT *, 3 * ss AS room, 3 * ss / w AS level, CAST(sum(ss) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w FROM w),
f AS (
  SELECT *, coalesce(sum(room) OVER p, 0) AS room_before, coalesce(sum(w) OVER p, 0) AS w_before
  FROM r WINDOW p AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (SELECT *, level * (all_w - w_before) < total - room_before AS is_full FROM f),
t AS (
  SELECT source, ss, CASE WHEN is_full THEN CAST(room AS DOUBLE)
    ELSE w * (total - coalesce(sum(CASE WHEN is_full THEN room END) OVER (), 0)) / (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)) END AS target
  FROM g
),
c AS (
  SELECT d.doc_id, d.size, t.ss, t.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
k AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM c
)
SELECT doc_id, size, ss AS source_size, target,
  greatest(0, least(size, goal - x)) + greatest(0, least(size, goal - x - ss)) + greatest(0, least(size, goal - x - 2 * ss)) AS taken,
  CASE WHEN size > 0 AND goal > x THEN CAST(x AS DOUBLE) / target END AS first_position
FROM k
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(index, folder).drop("payload", "url")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS h FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""


def op4_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips_search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def _fold(mod: int, left: int):
    """Whether a row is held out: crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == left, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~_fold(4, 2)))
    return language_id.predict(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~_fold(5, 0)))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~_fold(5, 0)))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_mips": op4_mips,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op1_mixing": OP1_SQL, "op3_warc": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op13_hard_negatives": OP13_SQL}
