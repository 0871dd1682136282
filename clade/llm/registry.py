"""Queries over the driver's tables, one an operator, and their SQL where SQL
can express them. Each is a thin layer over its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, jpeg, langid, lattice, mixing, pieces, quality, substring, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from those that are not held out. Nulls, empties and repeats as in quality.scored."""
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_tgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 90 % of their three-word shingles. Nulls, empties and repeats as in jaccard.near_duplicates."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), ngram=3, pct=90)


def op3_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has. Nulls, empties and repeats as in substring.repeated_passages."""
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written and read back. Nulls, ties and repeats as in warc.write_archive."""
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label at cosine 0.93. Nulls, zeros and repeats as in lattice.linked."""
    return lattice.linked(_table(spark, sf_dir, "embeddings"))


def op6_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document. Nulls, empties and repeats as in pieces.encoded."""
    return pieces.encoded(_table(spark, sf_dir, "documents"), ids=False)


def op7_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Nulls, empties and repeats as in mixing.mixed."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out. Nulls, empties and repeats as in langid.identified."""
    return langid.identified(_table(spark, sf_dir, "documents")).withColumn("languages", F.to_json("languages"))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text gives when stored as JPEG and read back. Nulls, empties and repeats as in jpeg.stored_media and jpeg.media_features."""
    return jpeg.media_features(jpeg.stored_media(_table(spark, sf_dir, "documents")))


def op10_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url. Nulls, ties and repeats as in urls.judged."""
    return urls.judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_crf,
            op2_ngram_jaccard_tgm,
            op3_substring_chains,
            op4_warc_content_addressed,
            op5_embedding_lattice,
            op6_sentencepiece_chunks,
            op7_entropy_mixing,
            op8_language_mixture,
            op9_jpeg_media,
            op10_url_logistic,
        )
    }


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (
  SELECT rep, n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep <> b.rep AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (
  SELECT node, min(other) AS component FROM reach GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component.component, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN component ON component.node = classes.rep
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS k, sha1(coalesce(html, '')) AS h FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY k) AS owner FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o
"""

LATTICE_SQL = """
WITH RECURSIVE every AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), v AS (
  SELECT * FROM every WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (
  SELECT node, min(other) AS c FROM reach GROUP BY node
)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN component ON node = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_tgm": JACCARD_SQL, "op4_warc_content_addressed": WARC_SQL, "op5_embedding_lattice": LATTICE_SQL}
