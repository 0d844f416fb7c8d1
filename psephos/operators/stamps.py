"""Stamps on ballot pages: candidates with their features from pixels, the decision from rows.

The Arrow function straightens a page, evens its contrast, asks a detector for boxes and measures each;
geometry gate, choice of the best box and decision are column expressions on those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators import ballot_images as b
from psephos.operators import decisions, detections
from psephos.operators import kernels as k

#: (score, x0, y0, x1, y1) of each candidate of an image.
Detector = Callable[[np.ndarray], list[tuple[float, int, int, int, int]]]
FEATURES = ("area_frac", "circularity", "ellipse_edge_pct", "template_ncc", "blob_count", "blob_spread")
# Frame colours (blue, green, red) by decision.
COLOURS = {decisions.VALID: (0, 255, 0), decisions.REVIEW: (0, 255, 255), decisions.NONE: (0, 0, 255)}
_SOURCE = ("origin", "height", "width", "nChannels", "data")


def normalised(image: np.ndarray) -> tuple[np.ndarray, float]:
    """The page made level, its lightness with local contrast and its colours' ratios kept; and the turn.

    A turned page gets a larger image, so that a stamp in its corner isn't cut off.
    """
    gray = k.grey(image)
    level, turn = b.deskewed(image, gray, whole=True)
    gray = np.maximum(k.grey(level) if turn else gray, 1)
    ratio = k.local_contrast(gray, 2.0) / gray
    return np.clip(np.rint(level * ratio[..., None]), 0, 255).astype(np.uint8), turn


def candidates(images: DataFrame, detect: Detector, template: np.ndarray | None = None, opened: b.Opener = b.pixels) -> DataFrame:
    """(image, skew_deg, ord, score, bbox, features) of every candidate; a page without any has one row of nulls."""
    names = ["image", "skew_deg", "ord", "score", "x0", "y0", "x1", "y1", *FEATURES]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.float64(), *[pa.int64()] * 4, *[pa.float64()] * len(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in b.row_slices(batches):
            rows = []
            for row in part:
                name, image, found = row["origin"], opened(row), 0
                page, turn = normalised(image)
                for found, (score, *box) in enumerate(detect(page), 1):
                    features = b.stamp_features(page, tuple(box), template, image.shape[0] * image.shape[1])
                    rows.append((name, turn, found, float(score), *map(int, box), *(float(features.get(f, 0.0)) for f in FEATURES)))
                if not found:
                    rows.append((name, turn, *[None] * (6 + len(FEATURES))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "image string, skew_deg double, ord long, score double, x0 long, y0 long, x1 long, y1 long, " + ", ".join(f"{f} double" for f in FEATURES)
    found = (images.select(*_SOURCE) if opened is b.pixels else images).mapInArrow(run, schema)
    box = F.when(F.col("ord").isNotNull(), F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")]))
    features = F.struct(*[F.col(f).cast("int" if f == "blob_count" else "double").alias(f) for f in FEATURES])
    return found.select("image", "skew_deg", "ord", "score", box.alias("bbox"), features.alias("features"))


def predict(images: DataFrame, detect: Detector, template: np.ndarray | None = None, thresholds: decisions.Thresholds = decisions.Thresholds(), limits: decisions.GeometryLimits = decisions.GeometryLimits(), opened: b.Opener = b.pixels) -> DataFrame:
    """The manifest of a batch of images: decision, score, box, geometry, features and skew of each."""
    rows = candidates(images, detect, template, opened).withColumn("geo_ok", F.coalesce(decisions.geometry_gate(F.col("features"), limits), F.lit(False)))
    best = detections.best(["score", "geo_ok", "bbox", "features"], "score", "geo_ok", "ord")  # with the skew at once: pixels are looked at once
    pages = rows.groupBy("image").agg(F.first("skew_deg").alias("skew_deg"), best.alias("_b")).select("image", "skew_deg", "_b.*")
    score, geometry = F.coalesce("score", F.lit(0.0)), F.coalesce("geo_ok", F.lit(False))
    return pages.select("image", decisions.stamp_decision(score, geometry, thresholds).alias("decision"), score.alias("score"), "bbox", geometry.alias("geo_ok"), F.when(F.col("bbox").isNotNull(), F.col("features")).alias("features"), "skew_deg")


def annotated(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with the frame of their stamp in the decision's colour, and the crop (clipped to the page), as image columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                page, _ = normalised(b.to_array(row.height, row.width, row.nChannels, row.data))
                crop = page[:0, :0]
                if row.bbox is not None:
                    x0, y0, x1, y1 = (int(v) for v in row.bbox)
                    x0, y0, x1, y1 = max(0, x0), max(0, y0), min(page.shape[1], x1), min(page.shape[0], y1)
                    crop = page[y0:y1, x0:x1].copy()
                    framed = page.copy()
                    framed[y0:y1, x0:x1] = COLOURS[row.decision]
                    framed[y0 + 2 : y1 - 2, x0 + 2 : x1 - 2] = page[y0 + 2 : y1 - 2, x0 + 2 : x1 - 2]
                    page = framed
                yield pd.DataFrame([(row.origin, page.shape[0], page.shape[1], 3, page.tobytes(), crop.shape[0], crop.shape[1], crop.tobytes())], columns=["origin", "height", "width", "nChannels", "data", "crop_height", "crop_width", "crop"])

    both = images.select(*_SOURCE).join(manifest.select(F.col("image").alias("origin"), "decision", "bbox"), "origin")
    return both.mapInPandas(run, "origin string, height int, width int, nChannels int, data binary, crop_height int, crop_width int, crop binary")
