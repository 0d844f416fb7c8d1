"""Rules that decide about one row: stamps, sequences, ballots, blanks, causes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stamp labels, thresholds and geometry limits as they are shipped, and causes of misses.
VALID, REVIEW, NONE = "VALID STAMP", "REVIEW REQUIRED", "NO STAMP"
CAUSES = ("no detection / no bbox", "failed geometry gate", "review decision instead of valid", "score below threshold", "decision not valid")


@dataclass(frozen=True)
class Thresholds:
    valid: float = 0.38
    review: float = 0.18


@dataclass(frozen=True)
class GeometryLimits:
    area_min: float = 0.0001
    area_max: float = 0.30
    circularity: float = 0.07
    ellipse_edge: float = 0.0
    template: float = 0.10
    blobs: int = 0
    blob_spread: float = 0.0


def stamp_decision(score: Column, geometry_ok: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when((score >= t.valid) & geometry_ok, VALID).when((score < t.review) | ~geometry_ok, NONE).otherwise(REVIEW)


def geometry_gate(features: Column, limits: GeometryLimits = GeometryLimits()) -> Column:
    """False outside the area range whatever the other features say; else all minima must hold."""
    f = lambda name: F.coalesce(features[name], F.lit(0.0))
    area = features["area_frac"].between(limits.area_min, limits.area_max)
    rest = (f("circularity") >= limits.circularity) & (f("ellipse_edge_pct") >= limits.ellipse_edge) & (f("template_ncc") >= limits.template) & (f("blob_count") >= limits.blobs) & (f("blob_spread") >= limits.blob_spread)
    return F.coalesce(area & rest, F.lit(False))


def geometry_or_decision(geometry_ok: Column, decision: Column) -> Column:
    """Manifests without the geometry field: it held if the decision wasn't no stamp."""
    return F.coalesce(geometry_ok, decision.isin(VALID, REVIEW))


def valid_sequence(preferences: Column) -> Column:
    """Whether an array of integers is 1..k in some order, k at least 1."""
    clean = F.array_compact(preferences)
    return (F.size(clean) > 0) & (F.sort_array(clean) == F.when(F.size(clean) > 0, F.sequence(F.lit(1), F.size(clean))))


def sequence_summary(digits: DataFrame, key: str, digit: str) -> DataFrame:
    """numbers_found and sequence_ok for each ballot; aggregates merge map-side."""
    n, distinct = F.count(digit), F.count_distinct(digit)
    ok = (n > 0) & (n == distinct) & (F.min(digit) == 1) & (F.max(digit) == n)
    return digits.groupBy(key).agg(n.alias("numbers_found"), F.coalesce(ok, F.lit(False)).alias("sequence_ok"))


def ballot_state(label: Column, sequence_ok: Column) -> Column:
    return F.when((label == VALID) & F.coalesce(sequence_ok, F.lit(False)), "Valid").otherwise("Doubtful")


def display_name(candidate_id: Column, *names: Column) -> Column:
    from psephos.functions.text import first_filled

    return F.coalesce(first_filled(*names), F.concat(F.lit("Candidate_"), candidate_id.cast("string")))


def false_negative_cause(has_box: Column, geometry_ok: Column, decision: Column, score: Column, t: Thresholds = Thresholds()) -> Column:
    return (
        F.when(~has_box, CAUSES[0]).when(~geometry_ok, CAUSES[1]).when(decision == REVIEW, CAUSES[2]).when(score < t.valid, CAUSES[3]).otherwise(CAUSES[4])
    )


def blank_tile(ink: Column, side: int, x0: Column, x1: Column, y0: Column, y1: Column, least_ink: int = 35, least_fraction: float = 0.0025) -> Column:
    """Too little ink, or ink in too small a box unless it is tall and narrow (a stroke)."""
    width, height = (x1 - x0 + 1) / side, (y1 - y0 + 1) / side
    stroke = (height > 0.55) & (width / height < 0.3)
    return (ink < least_ink) | (ink / (side * side) < least_fraction) | (((width < 0.10) | (height < 0.18)) & ~stroke)


def vote_box_shape(vertices: Column, convex: Column, area: Column, aspect: Column, extent: Column, page_area: Column) -> Column:
    """Contours that may be vote boxes."""
    return (vertices == 4) & convex & (area / page_area).between(0.0020, 0.045) & aspect.between(0.65, 1.55) & (extent >= 0.25)


def component_kept(x: Column, y: Column, w: Column, h: Column, area: Column, width: Column, height: Column) -> Column:
    """Components of a tile that are ink: no border line, no thin piece of the frame, no speck."""
    line = ((w >= 0.9 * width) & (h <= 0.15 * height)) | ((h >= 0.9 * height) & (w <= 0.15 * width))
    sides = (x <= 0).cast("int") + (y <= 0).cast("int") + (x + w >= width).cast("int") + (y + h >= height).cast("int")
    frame = (sides >= 2) & (area < 0.25 * w * h)
    least = F.greatest(F.lit(8.0), 0.0009 * width * height)
    speck = (area < least) | ((F.greatest(w, h) <= 3) & (area < 2 * least))
    return ~line & ~frame & ~speck


def upload_error(length: Column, content_type: Column, filename: Column, most: int = 10 * 1024 * 1024) -> Column:
    """Why an upload is refused, null if it isn't."""
    return (
        F.when(length.isNull() | (length < 0), "length").when(length > most, "too large").when(~F.coalesce(content_type.startswith("multipart/form-data"), F.lit(False)), "content type")
        .when(F.coalesce(F.trim(filename), F.lit("")) == "", "no file").when(~F.lower(filename).rlike(r"\.(jpe?g|png|bmp|tiff?|webp)$"), "not an image")
    )
