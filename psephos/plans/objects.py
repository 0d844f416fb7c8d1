"""Queries of detections and stored objects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import detections as d
from psephos.plans import tables as t
from psephos.plans.merging import DIGITS


def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as detections of their order."""
    rows = t.digits(spark, sf_dir).select("ballot", F.col("row_num").alias("ord"), (F.col("p") % 50).alias("score"), (F.col("s") % 3 == 0).alias("geometry_ok"))
    return d.best_detection(rows, "ballot", "score", "geometry_ok", "ord")


def head_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.read(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    key = F.col("page_id").cast("string")
    checksums = F.create_map(F.lit("crc32"), F.when(F.col("page_id") % 2 == 0, key), F.lit("sha1"), F.lit(""), F.lit("sha256"), key)
    heads = p.select("page_id", F.lit("b").alias("bucket"), key.alias("key"), F.lit("v").alias("version"), F.concat(F.lit('"'), key, F.lit('"')).alias("etag"), "bytes", checksums.alias("checksums"), F.when(F.col("page_id") % 3 != 0, F.col("bytes") + F.col("page_id") % 2).alias("found"))
    agree = d.sizes_agree(F.col("content_length"), F.col("found"))
    return d.head_summary(heads).join(heads.select("key", "found"), "key").select("key", "etag", "content_length", F.map_keys("checksums")[0].alias("first_checksum"), F.size("checksums").cast("long").alias("n_checksums"), agree.alias("sizes_agree"))


def page_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    n = F.col("n")
    w, h = 10 + n % 90, 20 + n % 79
    score = d.page_contour_score(w * h * (n % 11) / 10, w, h, n % 3, n % 13 / 40, w * h * 0.9, 10_000.0)
    return docs.select("doc_id", F.round(score, 6).alias("score"))


def id_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.page_of_ids(t.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 300)


QUERIES = {f.__name__: f for f in (best_detection, head_summary, page_contours, id_page)}
ORACLES = {
    "best_detection": f"SELECT ballot, ord, score, geometry_ok FROM (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY geometry_ok DESC, score DESC, ord) AS k FROM (SELECT ballot, row_num AS ord, p % 50 AS score, s % 3 = 0 AS geometry_ok FROM ({DIGITS})) WHERE score > 0) WHERE k = 1",
    "head_summary": "SELECT page_id::VARCHAR AS key, page_id::VARCHAR AS etag, octet_length(encode(html)) AS content_length, CASE WHEN page_id % 2 = 0 THEN 'crc32' ELSE 'sha256' END AS first_checksum, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_checksums, CASE WHEN page_id % 3 <> 0 THEN page_id % 2 = 0 END AS sizes_agree FROM pages",
    "page_contours": "WITH c AS (SELECT doc_id, n_chars AS n, 10 + n_chars % 90 AS w, 20 + n_chars % 79 AS h FROM documents), e AS (SELECT *, w * h * (n % 11) / 10 AS area FROM c) SELECT doc_id, round(CASE WHEN area < 1800 OR area / (w * h) < 0.28 OR (area > 9500 AND area / (w * h) > 0.9) THEN -1 ELSE area * (area / (w * h)) * greatest(0.35, 1 - abs(greatest(w, h) / least(w, h) - 1.65) / 2.3) * CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.42 ELSE 0.06 END * greatest(0.2, 1 - (n % 13) / 40 * 1.7) * greatest(0.2, least(1, area / (w * h * 0.9::DOUBLE))) END, 6) AS score FROM e",
    "id_page": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 100 OFFSET 300",
}
