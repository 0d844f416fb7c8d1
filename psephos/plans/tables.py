"""Stand-ins: the provided tables seen as ballots, boxes, manifests and events.

They exercise the operators; nothing here claims that real ballots look like this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.operators.decisions import NONE, REVIEW, VALID

WIDTH, HEIGHT, EXPECTED = 1000, 1000, 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: the status is the stamp's label."""
    label = F.when(F.col("o_orderstatus") == "F", VALID).when(F.col("o_orderstatus") == "P", REVIEW).otherwise(NONE)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ballot"), label.alias("label"))


def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines: row by row of the order, the line number is the digit."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).cast("long").alias("row_num"))
    return lines.select(F.col("l_orderkey").alias("ballot"), "row_num", F.col("l_linenumber").cast("long").alias("digit"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for most lines; some ballots have several in a row, some none.

    Lines of a part number divisible by four stand for rows whose box wasn't found, so they have a band and no box.
    """
    d = digits(spark, sf_dir).filter("p % 4 <> 0")
    long = lambda e: F.expr(e).cast("long")
    return d.select("ballot", F.col("row_num").alias("ord"), long("850 + p % 37").alias("x"), long("60 * (row_num - 1) + s % 29").alias("y"), long("36 + s % 15").alias("w"), long("30 + p % 13").alias("h"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band for each line; every seventh is a sliver."""
    d = digits(spark, sf_dir)
    y2 = F.expr("CASE WHEN (p + s) % 7 = 0 THEN 60 * row_num - 45 ELSE 60 * row_num END").cast("long")
    return d.select("ballot", F.col("row_num").alias("r"), F.expr("60 * (row_num - 1)").cast("long").alias("y1"), y2.alias("y2"))


def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separator lines near the bands' ends."""
    return digits(spark, sf_dir).select("ballot", F.expr("60 * row_num - 4 + p % 9").cast("long").alias("s"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as detections: score of the length, geometry of toxicity, truth of quality.

    Truth and geometry come from the labels, so documents without labels aren't detections.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    known = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(known, "doc_id")
    score, geometry = F.expr("(n_chars % 1000) / 1000.0").cast("double"), F.col("toxic") == 0
    from psephos.operators.decisions import stamp_decision

    out = rows.select("doc_id", "source", score.alias("score"), geometry.alias("geometry_ok"), (F.col("quality") == 1).alias("truth"), (F.col("n_chars") % 11 != 0).alias("has_box"))
    return out.withColumn("decision", stamp_decision(F.col("score"), F.col("geometry_ok")))


def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as object events: a key for each user and type, errors as failures."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    key = F.concat_ws("::", F.lit("bucket"), F.concat(F.lit("user/"), F.col("user_id").cast("string")), F.lit("no-version"), F.col("event_type"))
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("value") > 50, "IN_PROGRESS").otherwise("SUCCEEDED")
    return e.select("event_id", "ts", "user_id", "event_type", key.alias("claim_key"), status.alias("status"))
