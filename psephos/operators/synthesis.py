"""Synthetic pages with stamps: a plan in rows, drawn by hashes of seed and number, and its pixels.

Every number of the plan depends on seed and row alone, so pages can be made anywhere and again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.geometry import to_label
from psephos.operators import ballot_images as b
from psephos.operators import kernels as k
from psephos.operators.dataset import POSITIONS, drawn, weighted_choice

# Shares of pages without a stamp and with pen marks, tries for a place at the border, and its width.
NEGATIVE, DECOYS, TRIES, BORDER, TOP, RIGHT = 0.30, 0.70, 100, 0.24, 0.22, 0.70
#: Columns of the plan that drawing takes.
PLANNED = ("has_stamp", "decoys", "size", "angle", "opacity", "x", "y")


def uniform(key: Column, seed: str, low: Column | float, high: Column | float) -> Column:
    """A real number between the limits."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return low + drawn(key, seed) * (high - low)


def whole(key: Column, seed: str, low: Column, high: Column) -> Column:
    """A whole number from low to high, both included."""
    return low + F.floor(drawn(key, seed) * (high - low + 1)).cast("long")


def position(key: Column, seed: str, mode: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Top left corner (x, y) of a stamp by its placement, inside the page.

    At the border, places are drawn until the stamp's centre is in the outer part, TRIES times at most;
    the last one stays then.
    """
    zero = F.lit(0).cast("long")
    max_x, max_y = F.greatest(zero, (width - w).cast("long")), F.greatest(zero, (height - h).cast("long"))
    at = lambda i: F.struct(whole(key, f"{seed} x{i}", zero, max_x).alias("x"), whole(key, f"{seed} y{i}", zero, max_y).alias("y"))
    edge_x, edge_y = F.floor(BORDER * width), F.floor(BORDER * height)

    def outer(p: Column) -> Column:
        cx, cy = p.x + w / 2, p.y + h / 2
        return (cx <= edge_x) | (cx >= width - edge_x) | (cy <= edge_y) | (cy >= height - edge_y)

    keyed = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda i: F.struct(*[(zero + F.floor(_drawn_at(key, seed, axis, i) * (most + 1)).cast("long")).alias(axis) for axis, most in (("x", max_x), ("y", max_y))]))
    border = F.coalesce(F.get(F.filter(keyed, outer), F.lit(0)), F.get(keyed, F.lit(TRIES - 1)))
    low = F.least(max_x, F.floor(RIGHT * width).cast("long"))
    top = F.struct(at(0).x.alias("x"), whole(key, f"{seed} y0", zero, F.greatest(zero, F.floor(TOP * height).cast("long") - h.cast("long"))).alias("y"))
    right = F.struct(whole(key, f"{seed} x0", low, max_x).alias("x"), at(0).y.alias("y"))
    return F.when(mode == "border", border).when(mode == "top", top).when(mode == "right_column", right).otherwise(at(0))


def _drawn_at(key: Column, seed: str, axis: str, i: Column) -> Column:
    text = F.concat(F.lit(f"{seed} {axis}"), i.cast("string"), F.lit(":"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def plan(rows: DataFrame, key: str, width: Column, height: Column, side: Column, seed: str = "42", scale: tuple[float, float] = (0.05, 0.12), angle: tuple[float, float] = (-25.0, 25.0), opacity: tuple[float, float] = (0.55, 1.0)) -> DataFrame:
    """rows with has_stamp, decoys, size (of a stamp ``side`` pixels high, as part of the page's height), angle, opacity, place, x and y."""
    i = F.col(key)
    out = rows.withColumns({
        "has_stamp": drawn(i, f"{seed} negative") >= NEGATIVE, "decoys": F.when(drawn(i, f"{seed} decoy") < DECOYS, whole(i, f"{seed} decoys", F.lit(0).cast("long"), F.lit(5).cast("long"))).otherwise(F.lit(0).cast("long")),
        "size": F.greatest(F.lit(1), F.floor(side * uniform(i, f"{seed} scale", *scale) * height / side)).cast("long"), "angle": uniform(i, f"{seed} angle", *angle),
        "opacity": uniform(i, f"{seed} opacity", *opacity), "place": weighted_choice(drawn(i, f"{seed} place"), list(POSITIONS)),
    })
    return out.withColumn("at", position(i, seed, F.col("place"), width, height, F.col("size"), F.col("size"))).select("*", "at.x", "at.y").drop("at")


def transformed(stamp: np.ndarray, size: int, angle: float) -> np.ndarray:
    """A stamp (blue, green, red, alpha) at another size, turned; what the turn uncovers is clear."""
    places = ((np.arange(size) + 0.5) * stamp.shape[0] / size).astype(int), ((np.arange(size) + 0.5) * stamp.shape[1] / size).astype(int)
    small = stamp[places[0]][:, places[1]]
    return k.rotate(np.pad(small, ((1, 1), (1, 1), (0, 0))), angle)[1:-1, 1:-1]


def with_decoys(page: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Pen marks in the right half: strokes and dots."""
    out, r = page.copy(), np.random.default_rng(seed)
    height, width = page.shape[:2]
    for _ in range(count):
        x, y = int(r.integers(int(0.55 * width), max(int(0.56 * width) + 1, int(0.95 * width)))), int(r.integers(int(0.05 * height), int(0.95 * height)))
        if r.random() < 0.5:
            for t in np.linspace(0, 1, 40):
                u, v = int(x + t * r.integers(8, 14)), int(y + t * r.integers(-9, 9))
                out[max(0, v) : v + 2, max(0, u) : u + 2] = 40
        else:
            radius = int(r.integers(3, 6))
            top, left = max(0, y - radius), max(0, x - radius)
            near = out[top : y + radius + 1, left : x + radius + 1]
            yy, xx = np.ogrid[top : top + near.shape[0], left : left + near.shape[1]]
            near[(yy - y) ** 2 + (xx - x) ** 2 <= radius**2] = 40
    return out


def drawn_page(row: dict, page: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int, int] | None]:
    """A page as its plan has it, and the box of the stamp's visible part."""
    page = with_decoys(page, int(row["decoys"]), int(row["y"]) + 7919 * int(row["x"]))
    if not row["has_stamp"]:
        return page, None
    return b.place_stamp(page, transformed(stamp, int(row["size"]), float(row["angle"])), int(row["x"]), int(row["y"]), float(row["opacity"]))


def composed(pages: DataFrame, stamp: np.ndarray) -> DataFrame:
    """Planned pages (image source columns and the plan's) as images with their label: (origin, ..., has_stamp, x, y, w, h).

    The label is the box of what is visible (alpha over 10), null where nothing is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                page, box = drawn_page({c: getattr(row, c) for c in PLANNED}, b.to_array(row.height, row.width, row.nChannels, row.data), stamp)
                yield pd.DataFrame([(row.origin, page.shape[0], page.shape[1], 3, np.ascontiguousarray(page).tobytes(), box is not None, *(box or (None,) * 4))], columns=["origin", "height", "width", "nChannels", "data", "has_stamp", "x", "y", "w", "h"]).astype({c: "Int64" for c in "xywh"})

    return pages.select("origin", "height", "width", "nChannels", "data", *PLANNED).mapInPandas(run, "origin string, height int, width int, nChannels int, data binary, has_stamp boolean, x long, y long, w long, h long")


def label_lines(images: DataFrame) -> DataFrame:
    """The label file's line of each image: class, centre and size as fractions; empty for a negative."""
    label = to_label(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    line = F.format_string("0 %.6f %.6f %.6f %.6f", label["cx"], label["cy"], label["w"], label["h"])
    return images.select("origin", F.when(F.col("has_stamp"), line).otherwise("").alias("line"))
