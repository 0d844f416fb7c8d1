"""Small tiles in long form: one row for each pixel (tile, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(vectors: DataFrame, key: str, values: str, side: int) -> DataFrame:
    """The pixels of square tiles that arrays of side * side values hold, row by row."""
    cells = vectors.select(F.col(key).alias("tile"), F.posexplode(values).alias("i", "v"))
    return cells.select("tile", F.floor(F.col("i") / side).cast("long").alias("y"), (F.col("i") % side).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def ink_box(cells: DataFrame, ink: Column) -> DataFrame:
    """Ink count and the box and centroid of ink, for every tile."""
    at = lambda c: F.when(ink, F.col(c))
    return cells.groupBy("tile").agg(
        F.count_if(ink).alias("ink"), F.min(at("x")).alias("x0"), F.max(at("x")).alias("x1"), F.min(at("y")).alias("y0"), F.max(at("y")).alias("y1"),
        F.avg(at("x")).alias("cx"), F.avg(at("y")).alias("cy"),
    )


def profile(cells: DataFrame, ink: Column, side: int, part: float = 0.82) -> DataFrame:
    """Mean ink of each pixel row over the left part."""
    return cells.filter(F.col("x") < int(part * side)).groupBy("tile", "y").agg(F.avg(ink.cast("double")).alias("mean_ink"))


def centring_shift(cx: Column, cy: Column, side: int, most: int = 2) -> Column:
    """Whole-pixel move of the centroid to the middle, limited."""
    move = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.bround(F.lit((side - 1) / 2) - c).cast("long")))
    return F.struct(move(cx).alias("dx"), move(cy).alias("dy"))


def dark_fraction(cells: DataFrame, inner: float = 0.6, share: float = 0.6) -> DataFrame:
    """Part of a tile's inner pixels that are darker than its own percentile."""
    side = F.max("x").over(_tile()) + 1
    edge = (1 - inner) / 2
    inside = cells.withColumn("side", side).filter((F.col("x") >= edge * F.col("side")) & (F.col("x") < (1 - edge) * F.col("side")) & (F.col("y") >= edge * F.col("side")) & (F.col("y") < (1 - edge) * F.col("side")))
    level = inside.withColumn("level", F.percentile("v", F.lit(share)).over(_tile()))
    return level.groupBy("tile").agg(F.avg((F.col("v") < F.col("level")).cast("double")).alias("dark"))


def _tile():
    from pyspark.sql import Window

    return Window.partitionBy("tile")
