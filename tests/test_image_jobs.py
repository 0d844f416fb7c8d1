"""What image jobs open, store and shuffle: each page once, and no pixels where a worker can open them."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from psephos.operators import ballot_images as b
from psephos.operators import kernels as k
from psephos.operators import stamps
from psephos.plans import ballots

SOURCE = "origin string, height int, width int, nChannels int, data binary"


def _images(spark, pages):
    return spark.createDataFrame([(n, *p.shape[:2], 3, p.tobytes()) for n, p in pages.items()], SOURCE)


def test_stamps_are_detected_once(spark, tmp_path):
    """decision and skew of a page come from one look at it."""
    seen = str(tmp_path / "seen")

    def detect(image):
        with open(seen, "a") as f:
            f.write("x\n")
        return [(0.9, 10, 10, 30, 30), (0.95, 40, 10, 60, 30)]

    got = stamps.predict(_images(spark, {n: np.full((60, 80, 3), 240, np.uint8) for n in "abc"}), detect).collect()
    assert [r.image for r in sorted(got)] == ["a", "b", "c"] and {(r.score, tuple(r.bbox)) for r in got} == {(0.95, (40, 10, 60, 30))}
    assert len(open(seen).read().split()) == 3


def test_stamps_in_corners_and_of_joined_dots(spark, tmp_path):
    """levelling cut stamps off at the page's corner (first six pages), dots that ran into a chain weren't round enough (the others)."""
    ids = (474, 1194, 2122, 4043, 9723, 12060, 4330, 4376, 12370, 12516)
    spark.createDataFrame([(i,) for i in ids], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = ballots.stamp_manifest(spark, str(tmp_path)).select("page_id", "decision", "geo_ok", "score").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(ballots.ORACLES["stamp_manifest"]).fetchall()) and {r.decision for r in got} == {"VALID STAMP"}


def test_a_whole_page_is_turned():
    image = np.full((50, 70, 3), 240, np.uint8)
    image[44:49, 64:69] = (200, 40, 30)
    marks = lambda *how: int((k.rotate(image, *how)[..., 2] == 30).sum())
    assert all(abs(marks(turn, True) - 25) <= 3 for turn in (-9.5, -3.0, 0.0, 3.0, 9.5)) and marks(-9.5) < 15
    assert k.rotate(image, 0.0, True).shape == image.shape
    image[20:30, 60:] = (200, 40, 30)  # cut off by the edge: no streak comes of it
    assert abs(marks(-9.5, True) - 125) <= 10


def test_roundness_is_that_of_the_outline():
    y, x = np.mgrid[:60, :60] - 29.5
    dots = np.zeros((60, 60), bool)
    for i in range(12):
        dots |= (x - 22 * np.cos(i * np.pi / 6)) ** 2 + (y - 22 * np.sin(i * np.pi / 6)) ** 2 <= 36
    dots[:, 28:32] &= y[:, 28:32] < 0  # the ring is open
    line = np.zeros((60, 60), bool)
    line[30, 5:55] = True
    assert len(k.components(dots)[1]) == 1 and k.roundness(dots) > 0.8 and k.roundness(x**2 + y**2 <= 400) > 0.9
    assert k.roundness(line) == k.roundness(line & False) == 0.0
    page = np.full((60, 60, 3), 245, np.uint8)
    page[dots] = 60
    assert b.stamp_features(page, (0, 0, 60, 60))["circularity"] > 0.8
    assert b.stamp_features(page, (0, 0, 60, 60), page_area=7200)["area_frac"] == pytest.approx(0.5)


def test_turned_rows_and_thinning_are_as_drawn():
    r = np.random.default_rng(2)
    for edge in (0, 4):
        mask = np.zeros((50, 70), bool)
        mask[edge : 50 - edge, edge : 40] = r.random((50 - 2 * edge, 40 - edge)) < 0.2
        for turn in (-9.5, 0.5, 4.0):
            assert (k._turned_rows(mask, turn) == k.rotate(mask, turn).sum(axis=1)).all()
    page = k.adaptive_mask(k.grey(ballots.drawn(9)))
    assert [k.skew(k.rotate(page, t)) for t in (-4.0, 0.0, 2.5)] == [4.0, 0.0, -2.5]


def test_surveys_hold_no_pixels(spark, tmp_path):
    """a page is opened once, and what comes back is what the page shows."""
    seen = str(tmp_path / "seen")

    def opened(row):
        with open(seen, "a") as f:
            f.write("x\n")
        return ballots.drawn(row["page_id"])

    rows = b.surveyed(spark.createDataFrame([(f"p{i}", i) for i in (0, 1, 6, 14)], "origin string, page_id long"), ballots.ROWS, opened)
    assert "data" not in rows.columns
    got = {r.origin: (len(r.boxes), r.strategy == "full") for r in rows.collect()}
    assert got == {"p0": (5, False), "p1": (6, True), "p6": (6, False), "p14": (5, False)} and len(open(seen).read().split()) == 4


@pytest.mark.parametrize("by_opener", [True, False])
def test_ballots_are_read_without_storing_pixels(spark, by_opener):
    """pages in the image source's columns and pages that workers open read alike; no plan carries drawn pixels."""
    ids = (0, 1, 7, 30)
    if by_opener:
        rows = spark.createDataFrame([(f"p_{i}", i) for i in ids], "origin string, page_id long")
        read = b.read_ballots(rows, ballots.bars, ballots.ROWS, opened=lambda row: ballots.drawn(row["page_id"]))
        assert "data#" not in read._jdf.queryExecution().toString()
    else:
        read = b.read_ballots(_images(spark, {f"p_{i}": ballots.drawn(i) for i in ids}), ballots.bars, ballots.ROWS)
    got = {(int(r.image[2:]), r.row): (r.blank, r.digit, r.repaired) for r in read.collect()}
    missing = lambda n, i: n % 7 == 0 and i == 3
    want = {(n, i + 1): ((n + i) % 4 == 0 or missing(n, i), None if missing(n, i) else (n + i) % 4 or None, missing(n, i)) for n in ids for i in range(6)}
    assert got == want
