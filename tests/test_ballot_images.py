"""Drawn ballots, from PNG files to digits."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from psephos.operators import ballot_images as b
from psephos.operators import digit_tiles as d
from psephos.operators import kernels as k
from psephos.operators import pages, stamps
from psephos.sources import files


def png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def ballot(marks):
    page = np.full((400, 300, 3), 245, np.uint8)
    for i, mark in enumerate(marks):
        y = 40 + 70 * i
        page[y : y + 40, 240:280] = 20
        page[y + 3 : y + 37, 243:277] = 245
        if mark == 1:
            page[y + 8 : y + 32, 258:263] = 30
        elif mark == 2:
            page[y + 10 : y + 14, 250:270] = page[y + 26 : y + 30, 250:270] = 30
    return page


def test_digits_from_files(spark, tmp_path):
    def wide_or_tall(tensors):
        tall = np.array([t.any(axis=1).sum() > 1.5 * t.any(axis=0).sum() for t in tensors])
        out = np.zeros((len(tensors), 10))
        out[np.arange(len(tensors)), np.where(tall, 1, 2)] = 1
        return out

    (tmp_path / "a.png").write_bytes(png(ballot([1, 2, 0, 1])))
    (tmp_path / "b.png").write_bytes(png(np.full((50, 40, 3), 250, np.uint8)))
    (tmp_path / "c.png").write_bytes(b"no image")
    images = files.decoded(spark, str(tmp_path))
    got = [(r.row, r.blank, r.digit) for r in b.read_digits(images, wide_or_tall).filter("image LIKE '%a.png'").orderBy("row").collect()]
    assert got == [(1, False, 1), (2, False, 2), (3, True, None), (4, False, 1)]
    boxes = b.find_boxes(images).collect()
    assert sum(r.ord is not None for r in boxes) == 4 and sum(r.ord is None for r in boxes) == 1
    assert files.image_stems(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize(("desk", "paper", "size", "how"), [(40, 240, (240, 140), "edge quad"), (200, 245, (240, 140), "edge quad"), (40, 240, (190, 131), "paper quad"), (215, 250, (200, 140), "paper quad")])
def test_crop_finds_the_sheet(desk, paper, size, how):
    image = np.full((300, 400, 3), desk, np.uint8)
    image[30 : 30 + size[0], 120 : 120 + size[1]] = paper
    page, found = b.crop_page(image)
    assert found == how and abs(page.shape[0] - size[0]) <= 8 and abs(page.shape[1] - size[1]) <= 8 and page.mean() > paper - 12


def test_cascade_ends_with_the_whole_image():
    assert b.crop_page(np.zeros((20, 20, 3), np.uint8))[1] == "full" and b.crop_page(np.full((90, 80, 3), 250, np.uint8))[1] == "full"
    noise = np.random.default_rng(1).integers(0, 255, (120, 90, 3)).astype(np.uint8)
    assert b.crop_page(noise)[0].shape[2] == 3


def test_turned_sheet():
    """A sheet that lies askew is cut along its sides; one on its side is put upright."""
    image = np.full((400, 400, 3), 50, np.uint8)
    image[60:340, 120:280] = 240
    page, how = b.crop_page(k.rotate(image, 12.0))
    assert how == "edge quad" and abs(page.shape[0] - 280) <= 12 and abs(page.shape[1] - 160) <= 12 and page.mean() > 225
    assert (np.array(b.crop_page(np.rot90(image).copy())[0].shape[:2]) > [260, 150]).all()


def test_regions_of_weak_sheets():
    """What neither edges nor paper show as a sheet of their shapes, the four detectors may."""
    image = np.full((300, 300, 3), 60, np.uint8)
    image[50:250, 55:245] = 235  # nearly square
    quad, how = pages.by_regions(image.astype(float))
    assert how in ("frame", "edges", "brightness", "white") and abs(k.polygon_area(quad) / (200 * 190) - 1) < 0.1
    assert b.crop_page(image)[1] == how
    assert pages.sheet_score(np.array([[0.0, 0], [299, 0], [299, 299], [0, 299]]), (300, 300)) == -1


def test_trim():
    page = np.full((50, 40, 3), 200, np.uint8)
    page[10:40:2, 8:30] = 20
    assert pages.trim_border(np.pad(page, ((5, 5), (5, 5), (0, 0)), constant_values=255)).shape[0] <= 50


def test_quarter_turns():
    page = ballot([1, 2, 0, 1])
    for n in range(4):
        image, turned = b.upright(np.ascontiguousarray(np.rot90(page, n)), 4)
        assert (n + turned) % 4 == 0 and (image == page).all()
    left = page[:, ::-1].copy()
    assert len(b.vote_boxes(left)) == 4  # no box on the right: the whole page is looked at


@pytest.mark.parametrize("turn", [0.0, 6.0])
def test_digit_tiles(turn):
    page = k.rotate(ballot([1, 2, 0, 1]), turn)
    boxes = b.vote_boxes(page)
    tile = page[boxes[0][1] - 5 : boxes[0][1] + boxes[0][3] + 5, boxes[0][0] - 5 : boxes[0][0] + boxes[0][2] + 5]
    square, found = d.rectified(tile)
    assert found and square.shape[:2] == (d.SIDE, d.SIDE)
    assert not d.rectified(np.full((40, 40, 3), 240, np.uint8))[1] and not d.rectified(tile[:10])[1]
    masks = [d.digit_mask(page, box) for box in boxes]
    assert [d.is_blank(m) for m in masks] == [False, False, True, False]
    assert [len(k.components(m)[1]) for m in masks] == [1, 2, 0, 1]
    assert d.tensors(d.cut(masks[0])).shape == (5, 28, 28) and 0 < d.tensors(masks[0]).max() <= 1


def test_thin_strokes_are_brought_out():
    tile = np.full((60, 60, 3), 235, np.uint8)
    tile[15:45, 30] = 200  # faint, one pixel wide
    assert d.inked(tile)[0].shape == (60, 60)
    tile[15:45, 28:32] = 120
    mask, way = d.inked(tile)
    assert way in "abc" and len(k.components(mask)[1]) == 1 and 80 <= mask.sum() <= 400
    assert d.mask_score(np.zeros((5, 5), bool)) == d.EMPTY and d.mask_score(np.ones((5, 5), bool)) == d.TOO_MUCH


def test_only_careful_variants_choose():
    p = np.full((5, 10), 0.02)
    p[:3, 4], p[3, 7], p[4, 4] = 0.5, 0.9, 0.7
    digit, score = d.chosen(p)
    assert digit == 4 and score > d.chosen(np.vstack([p[:4], p[3:4]]))[1]
    assert d.chosen(p, temperature=3.0)[1] < score


def test_components_by_walking():
    r = np.random.default_rng(1)
    for _ in range(60):
        mask = r.random((r.integers(1, 25), r.integers(1, 25))) < r.random()
        labels, found = np.zeros(mask.shape, int), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if labels[y, x]:
                continue
            queue, labels[y, x] = [(y, x)], len(found) + 1
            for v, u in queue:
                for at in ((v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not labels[at]:
                        labels[at] = len(found) + 1
                        queue.append(at)
            ys, xs = zip(*queue, strict=True)
            found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(queue)))
        got = k.components(mask)
        assert (got[0] == labels).all() and got[1] == [tuple(map(int, f)) for f in found]


def test_thinning_keeps_parts_together():
    mask = np.zeros((40, 40), bool)
    mask[5:35, 10:16] = mask[20:26, 10:35] = True
    thin = k.thinned(mask)
    assert len(k.components(thin)[1]) == 1 and thin.sum() < 0.3 * mask.sum() and not (thin & ~mask).any()


def test_local_contrast_widens_grey():
    gray = np.tile(np.linspace(100, 130, 64), (64, 1))
    out = k.local_contrast(gray, 4.0)
    assert out.shape == gray.shape and np.ptp(out) > 1.2 * np.ptp(gray) and 0 <= out.min() <= out.max() <= 255


def test_stamps():
    page, stamp = np.full((100, 100, 3), 250, np.uint8), np.zeros((20, 20, 4), np.uint8)
    stamp[5:15, 5:15] = (200, 0, 0, 255)
    out, box = b.place_stamp(page, stamp, 10, 10)
    assert box == (15, 15, 10, 10) and (out[20, 20] == (200, 0, 0)).all() and (out[0, 0] == 250).all()
    assert b.place_stamp(page, stamp, 200, 0)[1] is None and b.place_stamp(page, stamp, -10, 0)[1] == (0, 5, 5, 10)
    f = b.stamp_features(out, (10, 10, 30, 30))
    assert 0.039 < f["area_frac"] < 0.041 and f["template_ncc"] == 1.0
    assert f["blob_count"] == 0  # a quarter of the crop is no dot
    dots = np.full((100, 100, 3), 250, np.uint8)
    for y, x in ((20, 20), (20, 50), (60, 24)):
        dots[y : y + 6, x : x + 6] = 20
    dots[70:74, 10:60] = 20  # a line is none either
    f = b.stamp_features(dots, (0, 0, 100, 100))
    assert f["blob_count"] == 3 and abs(f["blob_spread"] - 0.4) < 1e-9


def test_template_match():
    r = np.random.default_rng(3)
    template = r.integers(0, 255, (12, 12)).astype(float)
    crop = np.full((12, 30), 100.0)
    crop[:, 9:21] = template
    assert b.template_match(crop, template) == pytest.approx(1.0) and b.template_match(crop[:4, :4], template) == 0.0


def test_annotated(spark):
    page = np.full((60, 80, 3), 240, np.uint8)
    images = spark.createDataFrame([(n, 60, 80, 3, page.tobytes()) for n in ("a", "b")], "origin string, height int, width int, nChannels int, data binary")
    manifest = spark.createDataFrame([("a", "VALID STAMP", [50, 40, 100, 55]), ("b", "NO STAMP", None)], "image string, decision string, bbox array<int>")
    got = {r.origin: r for r in stamps.annotated(images, manifest).collect()}
    a = np.frombuffer(got["a"].data, np.uint8).reshape(60, 80, 3)
    assert (a[41, 60] == (0, 255, 0)).all() and (got["a"].crop_height, got["a"].crop_width) == (15, 30) and len(got["b"].crop) == 0
    none = stamps.predict(images, lambda image: []).collect()
    assert [(r.decision, r.bbox, r.score) for r in none] == [("NO STAMP", None, 0.0)] * 2
