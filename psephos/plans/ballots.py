"""Whole ballots from images: pages are drawn from a table's ids, so SQL can say what must be read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import ballot_images, stamps, synthesis
from psephos.plans import tables as t

ROWS, PITCH, BOX = 6, 70, 40


def drawn(page_id: int) -> np.ndarray:
    """A ballot of six boxes: blank, one upright bar, two level ones, three upright ones; on a desk, turned, without a box."""
    page = np.full((90 + ROWS * PITCH, 300, 3), 245, np.uint8)
    page[10:14, 20:200] = 60
    for i in range(ROWS):
        y, x = 60 + PITCH * i, 240
        page[y + 12 : y + 18, 30:180] = 90
        if page_id % 7 == 0 and i == 3:
            continue
        page[y : y + BOX, x : x + BOX] = 20
        page[y + 3 : y + BOX - 3, x + 3 : x + BOX - 3] = 245
        mark = (page_id + i) % 4
        if mark == 1:
            page[y + 8 : y + 32, x + 18 : x + 23] = 30
        elif mark == 2:
            page[y + 10 : y + 14, x + 9 : x + 31] = page[y + 26 : y + 30, x + 9 : x + 31] = 30
        elif mark == 3:
            for k in (8, 18, 28):
                page[y + 8 : y + 32, x + k : x + k + 4] = 30
    if page_id % 2 == 0:
        desk = np.full((page.shape[0] + 140, page.shape[1] + 160, 3), (70, 90, 110), np.uint8)
        desk[60 : 60 + page.shape[0], 70 : 70 + page.shape[1]] = page
        page = desk
    return np.ascontiguousarray(np.rot90(page, page_id // 4 % 4))


#: Pages of a task, at most.
PAGES = 2_500


def _dealt(pages: DataFrame) -> DataFrame:
    """Small rows that much work is done for, dealt out evenly."""
    return pages.repartition(max(4 * pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // PAGES)))


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ballot to draw for each page; the worker that looks at it draws it."""
    ids = t.read(spark, sf_dir, "pages").select(F.concat(F.lit("ballot_"), F.col("page_id").cast("string")).alias("origin"), "page_id")
    return _dealt(ids)


def _draw(row: dict) -> np.ndarray:
    return drawn(int(row["page_id"]))


def bars(tensors: np.ndarray) -> np.ndarray:
    """Class probabilities of drawn marks: three upright bars, two level ones, else one."""
    runs = lambda line: int(((line[1:] > 0.25) & (line[:-1] <= 0.25)).sum())
    out = np.full((len(tensors), 10), 0.01)
    for i, x in enumerate(tensors):
        across, down = runs(x.mean(axis=0) / max(1e-9, x.mean(axis=0).max())), runs(x.mean(axis=1) / max(1e-9, x.mean(axis=1).max()))
        out[i, 3 if across == 3 else 2 if down == 2 else 1] = 0.91
    return out


def _id(column: str) -> Column:
    return F.substring_index(column, "_", -1).cast("long").alias("page_id")


def ballot_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every drawn ballot: cut out, turned upright, laid out, its missing box repaired, its digit read."""
    read = ballot_images.read_ballots(ballots(spark, sf_dir), bars, ROWS, opened=_draw)
    return read.select(_id("image"), "row", "blank", "digit", "repaired")


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vote boxes the tidied pages show, and how the sheet was found and turned."""
    pages = ballot_images.surveyed(ballots(spark, sf_dir), ROWS, _draw)
    return pages.select(_id("origin"), F.size("boxes").cast("long").alias("boxes"), (F.col("strategy") == "full").alias("whole"))


def stamp_image() -> np.ndarray:
    """A round stamp of dots in blue: blue, green, red, alpha."""
    y, x = np.mgrid[:96, :96] - 47.5
    out = np.zeros((96, 96, 4), np.uint8)
    for i in range(12):
        cx, cy = 34 * np.cos(i * np.pi / 6), 34 * np.sin(i * np.pi / 6)
        out[(x - cx) ** 2 + (y - cy) ** 2 <= 49] = (190, 40, 30, 255)
    out[x**2 + y**2 <= 144] = (190, 40, 30, 255)
    return out


def blue(image: np.ndarray) -> list[tuple[float, int, int, int, int]]:
    """A detector for drawn stamps: the box of all that is clearly bluer than red."""
    mask = image[..., 0].astype(np.int16) - image[..., 2] > 25
    if mask.sum() < 25:
        return []
    ys, xs = np.nonzero(mask)
    return [(0.9, int(xs.min()) - 1, int(ys.min()) - 1, int(xs.max()) + 2, int(ys.max()) + 2)]


_WIDTH, _HEIGHT = 300, 420


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t.read(spark, sf_dir, "pages").select("page_id")
    return synthesis.plan(ids, "page_id", F.lit(_WIDTH), F.lit(_HEIGHT), F.lit(96))


def _blank(planned: DataFrame) -> DataFrame:
    data = F.unhex(F.repeat(F.lit("F5F5F5"), _WIDTH * _HEIGHT))
    source = {"origin": F.concat(F.lit("page_"), F.col("page_id").cast("string")), "height": F.lit(_HEIGHT), "width": F.lit(_WIDTH), "nChannels": F.lit(3), "data": data}
    return planned.repartition(planned.sparkSession.sparkContext.defaultParallelism).withColumns(source)


def synthetic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn for each page: stamp or not, pen marks, size, angle, opacity, placement and place."""
    return _planned(spark, sf_dir).select("page_id", "has_stamp", "decoys", "size", F.round("angle", 9).alias("angle"), F.round("opacity", 9).alias("opacity"), "place", "x", "y")


def synthetic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as planned, and whether their labels lie where the plan put the stamp."""
    made = synthesis.composed(_blank(_planned(spark, sf_dir)), stamp_image())
    lines = synthesis.label_lines(made).withColumn("p", F.split("line", " "))
    plan = _planned(spark, sf_dir).select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("origin"), "page_id", "size", F.col("x").alias("px"), F.col("y").alias("py"))
    near = lambda i, at, side: F.abs(F.col("p")[i].cast("double") * side - (F.col(at) + F.col("size") / 2)) <= F.col("size") / 4 + 2
    both = lines.join(plan, "origin")
    return both.select("page_id", (F.col("line") != "").alias("has_stamp"), F.when(F.col("line") != "", near(1, "px", _WIDTH) & near(2, "py", _HEIGHT)).alias("in_place"))


def stamp_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the synthetic pages under a detector for their colour: a decision for each."""
    planned = _dealt(_planned(spark, sf_dir)).withColumn("origin", F.concat(F.lit("page_"), F.col("page_id").cast("string")))
    blank, stamp = np.full((_HEIGHT, _WIDTH, 3), 0xF5, np.uint8), stamp_image()
    found = stamps.predict(planned, blue, opened=lambda row: synthesis.drawn_page(row, blank, stamp)[0])
    return found.select(_id("image"), "decision", "geo_ok", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (ballot_digits, page_boxes, synthetic_plan, synthetic_labels, stamp_manifest)}

_F = lambda seed: f"(('0x' || substr(md5('42 {seed}:' || page_id), 1, 8))::BIGINT / 4294967296)"
_TRY = "[struct_pack(x := CAST(floor(('0x' || substr(md5('42 x' || i || ':' || page_id), 1, 8))::BIGINT / 4294967296 * (300 - size + 1)) AS BIGINT), y := CAST(floor(('0x' || substr(md5('42 y' || i || ':' || page_id), 1, 8))::BIGINT / 4294967296 * (420 - size + 1)) AS BIGINT)) FOR i IN range(100)]"
_PLAN = f"""WITH p AS (SELECT page_id, {_F('negative')} >= 0.3 AS has_stamp, CASE WHEN {_F('decoy')} < 0.7 THEN CAST(floor({_F('decoys')} * 6) AS BIGINT) ELSE 0 END AS decoys,
greatest(1, CAST(floor(96 * (0.05::DOUBLE + {_F('scale')} * (0.12::DOUBLE - 0.05::DOUBLE)) * 420 / 96) AS BIGINT)) AS size, round(-25 + {_F('angle')} * 50, 9) AS angle, round(0.55::DOUBLE + {_F('opacity')} * (1 - 0.55::DOUBLE), 9) AS opacity,
CASE WHEN {_F('place')} < 0.35 THEN 'border' WHEN {_F('place')} < 0.35 + 0.25 THEN 'anywhere' WHEN {_F('place')} < 0.35 + 0.25 + 0.25 THEN 'top' ELSE 'right_column' END AS place FROM pages),
q AS (SELECT *, {_TRY} AS tries FROM p),
b AS (SELECT *, [t FOR t IN tries IF t.x + size / 2 <= 72 OR t.x + size / 2 >= 228 OR t.y + size / 2 <= 100 OR t.y + size / 2 >= 320] AS good FROM q)
SELECT page_id, has_stamp, decoys, size, angle, opacity, place,
CASE place WHEN 'border' THEN coalesce(good[1].x, tries[100].x) WHEN 'right_column' THEN 210 + CAST(floor({_F('x0')} * (300 - size - 210 + 1)) AS BIGINT) ELSE tries[1].x END AS x,
CASE place WHEN 'border' THEN coalesce(good[1].y, tries[100].y) WHEN 'top' THEN CAST(floor({_F('y0')} * (92 - size + 1)) AS BIGINT) ELSE tries[1].y END AS y FROM b"""
ORACLES = {
    "synthetic_plan": _PLAN,
    "synthetic_labels": f"SELECT page_id, has_stamp, CASE WHEN has_stamp THEN true END AS in_place FROM ({_PLAN})",
    "stamp_manifest": f"SELECT page_id, CASE WHEN has_stamp THEN 'VALID STAMP' ELSE 'NO STAMP' END AS decision, has_stamp AS geo_ok, CASE WHEN has_stamp THEN 0.9::DOUBLE ELSE 0 END AS score FROM ({_PLAN})",
    "ballot_digits": "SELECT page_id, i + 1 AS row, (page_id + i) % 4 = 0 OR (page_id % 7 = 0 AND i = 3) AS blank, CASE WHEN (page_id + i) % 4 <> 0 AND NOT (page_id % 7 = 0 AND i = 3) THEN (page_id + i) % 4 END AS digit, page_id % 7 = 0 AND i = 3 AS repaired FROM pages, range(6) t(i)",
    "page_boxes": "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 5 ELSE 6 END AS boxes, page_id % 2 = 1 AS whole FROM pages",
}
