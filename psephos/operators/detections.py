"""Choosing among detections and describing stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(names: list[str], score: str, passes: str, order: str) -> Column:
    """The aggregate behind best_detection: a struct of the names, null where no score is positive."""
    key = F.struct(F.col(passes).cast("int").alias("p"), F.col(score).alias("s"), (-F.col(order)).alias("first"))
    return F.max_by(F.struct(*names), F.when(F.col(score) > 0, key))


def best_detection(boxes: DataFrame, image: str, score: str, passes: str, order: str) -> DataFrame:
    """Of each image the best box that passes geometry, else the best of all; only positive scores count.
    The first one wins if equal.  A partial aggregation, so images with many boxes are no burden."""
    names = [c for c in boxes.columns if c != image]
    return boxes.filter(F.col(score) > 0).groupBy(image).agg(best(names, score, passes, order).alias("_b")).select(image, "_b.*")


def filled(checksums: Column) -> Column:
    """A map without its empty values."""
    return F.map_filter(checksums, lambda _, v: v.isNotNull() & (v != ""))


def head_summary(heads: DataFrame) -> DataFrame:
    """Object heads (bucket, key, version, etag, bytes, checksums) in the form of file diagnostics."""
    return heads.select("bucket", "key", F.col("version").alias("version_id"), F.replace("etag", F.lit('"'), F.lit("")).alias("etag"), F.col("bytes").alias("content_length"), filled(F.col("checksums")).alias("checksums"))


def sizes_agree(stated: Column, found: Column) -> Column:
    """Whether both sizes are known and equal; null if one is unknown."""
    return stated == found


# Fixed values in this score: all its numbers but the least area, which is a parameter.
def page_contour_score(area: Column, w: Column, h: Column, sides: Column, offset: Column, sheet: Column, page_area: float, least: float = 0.18) -> Column:
    """How like a sheet a contour is: its area, weighed by how it fills its box and its tightest rectangle
    (of area ``sheet``), by aspect, by sides that touch the border and by its distance from the middle
    (offset, in page diagonals); -1 for what can't be a sheet."""
    fill = area / F.greatest(F.lit(1), w * h)
    aspect = F.greatest(F.lit(0.35), 1.0 - F.abs(F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h)) - 1.65) / 2.3)
    border = F.when(sides >= 2, 0.06).when(sides == 1, 0.42).otherwise(1.0)
    centre = F.greatest(F.lit(0.2), 1.0 - offset * 1.7)
    tight = F.greatest(F.lit(0.2), F.least(F.lit(1.0), area / F.greatest(F.lit(1), sheet)))
    unfit = (area < page_area * least) | (fill < 0.28) | ((area > 0.95 * page_area) & (fill > 0.90))
    return F.when(unfit, -1.0).otherwise(area * fill * aspect * border * centre * tight)


def page_of_ids(rows: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def versions(*packages: str) -> dict[str, str | None]:
    """Installed versions, for run diagnostics."""
    from importlib import metadata

    out: dict[str, str | None] = {}
    for name in packages:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out
