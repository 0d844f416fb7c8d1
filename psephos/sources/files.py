"""Scans of manifests, digit folders, labels, rules and images."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.text import folder_ballot, stem

MANIFEST = (
    "image string, decision string, score double, bbox array<int>, geo_ok boolean, "
    "features struct<area_frac:double,circularity:double,ellipse_edge_pct:double,template_ncc:double,blob_count:int,blob_spread:double>, skew_deg double"
)
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
# Image types by who scans; the last two look at one level only.
TYPES_OF = {
    "stamp": ("png", "jpg", "jpeg", "tif", "tiff"),
    "extraction": ("png", "jpg", "jpeg", "bmp", "tif", "tiff"),
    "cropper": IMAGE_TYPES,
    "digits": ("png", "jpg", "jpeg"),
    "labeler": IMAGE_TYPES,
}
FLAT = ("digits", "labeler")
#: Pairs that a rule file may have.
MOST_RULES = 1000


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Records of a JSON file, None where there is none."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if present(spark, path) else None


def current_box(spark: SparkSession, path: str, override: str = "") -> str:
    """The box location: the override, else the file's, else empty."""
    found = None if override.strip() else optional_json(spark, path, "box_location string")
    row = found.first() if found is not None else None
    return override.strip() or (row.box_location or "" if row else "")


def exists(table: DataFrame, column: str, value: object) -> bool:
    """Point lookup: the filter goes down to the scan and one row is enough."""
    return bool(table.filter(F.col(column) == F.lit(value)).limit(1).count())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Stamp manifest: a JSON array, its schema declared."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def digit_folders(spark: SparkSession, path: str) -> DataFrame:
    """Digit rows of ``ballot_<id>/results.json`` files: (ballot, position, row, digit, is_number).

    A digit is a JSON integer or a string; only integers are numbers.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/results.json$", 1)
    rows = files.select(folder.alias("folder"), F.from_json("value", "array<struct<row:int,digit:variant>>").alias("rows")).filter("folder LIKE 'ballot\\\\_%'")
    each = rows.select(folder_ballot(F.col("folder")).alias("ballot"), F.posexplode("rows").alias("position", "r"))
    number = F.schema_of_variant("r.digit").isin("BIGINT", "BOOLEAN")
    return each.select("ballot", "position", F.col("r.row").alias("row"), F.try_variant_get("r.digit", "$", "string").alias("digit"), F.coalesce(number, F.lit(False)).alias("is_number"))


def label_presence(spark: SparkSession, path: str) -> DataFrame:
    """(stem, positive): a label file that isn't blank marks a positive."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    return text.select(stem(F.col("_metadata.file_path")).alias("stem"), (F.trim(F.regexp_replace("value", r"\s", "")) != "").alias("positive"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of label files: (stem, class, cx, cy, w, h)."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(stem(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) >= 5")
    return lines.select("stem", F.col("p")[0].cast("int").alias("class"), *[F.col("p")[i + 1].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def data_sets(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Boxes of several data sets' label files together: (set, stem, class, cx, cy, w, h)."""
    out = None
    for name, path in folders.items():
        one = labels(spark, path).select(F.lit(name).alias("set"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def images(spark: SparkSession, path: str, recursive: bool = True, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """Image files with path, length, time and content, of one shared set of types."""
    pattern = "*.{" + ",".join([*types, *(t.upper() for t in types)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)


def scanned(spark: SparkSession, path: str, use: str) -> DataFrame:
    """Sorted paths of the images that one of the jobs looks at; contents are pruned."""
    found = images(spark, path, recursive=use not in FLAT, types=TYPES_OF[use]).select("path", "length")
    return found if use == "digits" else found.orderBy("path")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url in batch.column(0).to_pylist():
            try:
                with urlopen(url, timeout=15) as answer:
                    content = answer.read()
            except (OSError, ValueError):  # whatever can't be read is null
                content = None
            yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([content], pa.binary())], names=["url", "content"])


def fetched(urls: DataFrame) -> DataFrame:
    """(url, content) of http(s) or file URLs, null content where one can't be read."""
    return urls.select(F.col("url").cast("string")).filter("url IS NOT NULL").mapInArrow(_fetch, "url string, content binary")


def image_stems(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path), the last path of a stem; contents are pruned."""
    found = images(spark, path).select(stem(F.col("path")).alias("stem"), "path")
    return found.groupBy("stem").agg(F.max("path").alias("path"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of images that can be read, blue first: the struct of Spark's image source."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def rules(spark: SparkSession, path: str) -> dict[str, float]:
    """``key: value`` lines of a small rule file; comments and blanks are skipped."""
    text = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("v")).filter("v LIKE '%:%'")
    pair = text.select(F.trim(F.split_part("v", F.lit(":"), F.lit(1))).alias("k"), F.expr("try_cast(trim(split_part(v, ':', 2)) AS double)").alias("x"))
    found = pair.filter("x IS NOT NULL").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} rules")
    return {r.k: r.x for r in found}


def object_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records of object events: event_time, bucket, key, version, etag, sequencer."""
    schema = "Records array<struct<eventTime:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,versionId:string,eTag:string,sequencer:string>>>>"
    raw = (spark.readStream if stream else spark.read).schema(schema).json(path).select(F.explode("Records").alias("r"))
    return raw.select(F.col("r.eventTime").alias("event_time"), F.col("r.s3.bucket.name").alias("bucket"), F.url_decode("r.s3.object.key").alias("key"), F.col("r.s3.object.versionId").alias("version"), F.col("r.s3.object.eTag").alias("etag"), F.col("r.s3.object.sequencer").alias("sequencer"))
