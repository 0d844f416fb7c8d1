"""Finding the sheet of paper on a photograph: a cascade of detectors, and what is cut out.

First a quadrilateral among strong edges, then the outline of bright, colourless paper, then the best
region of four detectors by one score; else the whole image.  Detection runs on a copy of at most
MOST_SIDE pixels a side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from psephos.operators import kernels as k

MOST_SIDE = 600
# Limits of sheets by detector (parts of the page's area, aspects).
EDGE_AREA, EDGE_ASPECT = (0.08, 0.90), (1.5, 7.0)
PAPER_AREA, PAPER_ASPECT = 0.08, (1.4, 8.5)
REGION_AREA, REGION_FILL, WHOLE_PAGE = 0.18, 0.28, (0.95, 0.90)
# Weights of a quadrilateral among edges (by border sides touched, offset from the middle, lying on its side).
EDGE_MARGIN, EDGE_BORDER, EDGE_OFFSET, EDGE_LYING = 0.04, (1.0, 1.0, 0.45, 0.2, 0.2), (0.7, 0.3), 0.6
# Weights of a region (by border sides touched, aspect, offset, tightness of its rectangle).
REGION_MARGIN, REGION_BORDER, REGION_ASPECT, REGION_OFFSET, REGION_TIGHT = (8, 0.01), (1.0, 0.42, 0.06, 0.06, 0.06), (1.65, 2.3, 0.35), (1.7, 0.2), 0.2
# Levels and sizes of the four region detectors.
FRAME_MOST, FRAME_SIZE, FRAME_STEEP = 200, 10, 55
EDGES_STEEP, EDGES_SIZE = 40, 9
BRIGHT_MOST, BRIGHT_MORE, BRIGHT_SIZE = 245, 4, 13
WHITE_LEAST, WHITE_LESS, WHITE_COLOUR, WHITE_SIZE, GLARE = 122, 8, (100.0, 72, 18), 11, (245, 70)


class Sheet(NamedTuple):
    quad: np.ndarray
    how: str


def reduced(image: np.ndarray, most: int = MOST_SIDE) -> tuple[np.ndarray, int]:
    """Means of squares of pixels, and the squares' side."""
    step = max(1, -(-max(image.shape[:2]) // most))
    h, w = image.shape[0] // step * step, image.shape[1] // step * step
    return image[:h, :w].reshape(h // step, step, w // step, step, 3).mean(axis=(1, 3)), step


def lab(image: np.ndarray) -> np.ndarray:
    """Lightness and the two colour axes of CIE L*a*b*, from sRGB bytes (blue, green, red)."""
    c = image[..., ::-1].astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # fixed values: sRGB primaries and the D65 white point
    xyz = c @ np.array([[0.4124, 0.2126, 0.0193], [0.3576, 0.7152, 0.1192], [0.1805, 0.0722, 0.9505]]) / [0.9505, 1.0, 1.089]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def even_light(gray: np.ndarray, size: int) -> np.ndarray:
    """Grey values over their surroundings, stretched to 0..255."""
    out = gray / np.maximum(k.smooth(gray, size), 1)
    span = out.max() - out.min()
    return (out - out.min()) / span * 255 if span > 0 else np.zeros_like(out)


def _outlines(mask: np.ndarray, least: float, grow: int = 0) -> Iterator[np.ndarray]:
    """Hulls of the mask's regions whose box is large enough, the largest box first; ``grow`` joins parts that are near."""
    labels, found = k.components(k.dilate(mask, grow, grow) if grow else mask)
    large = [(w * h, i) for i, (_, _, w, h, _) in enumerate(found) if w * h >= least * mask.size]
    for _, i in sorted(large, key=lambda x: (-x[0], x[1])):
        x, y, w, h, _ = found[i]
        hull = k.outline((labels[y : y + h, x : x + w] == i + 1) & mask[y : y + h, x : x + w])
        if len(hull) > 2:
            yield hull + [x, y]


def _touches(low: np.ndarray, high: np.ndarray, shape: tuple[int, int], margin: tuple[float, float]) -> int:
    return int(low[0] <= margin[0]) + int(low[1] <= margin[1]) + int(high[0] >= shape[1] - margin[0]) + int(high[1] >= shape[0] - margin[1])


def _aspect(size: np.ndarray) -> float:
    return float(size.max() / max(1.0, size.min()))


def sheet_score(hull: np.ndarray, shape: tuple[int, int], least: float = REGION_AREA) -> float:
    """How like a sheet an outline is (as detections.page_contour_score has it for rows); -1 for what can't be one."""
    height, width = shape
    area, low, high = k.polygon_area(hull), hull.min(axis=0), hull.max(axis=0) + 1
    size = high - low
    fill = area / max(1.0, float(np.prod(size)))
    if area < least * height * width or fill < REGION_FILL or area > WHOLE_PAGE[0] * height * width and fill > WHOLE_PAGE[1]:
        return -1.0
    pixels, part = REGION_MARGIN
    border = REGION_BORDER[_touches(low, high, shape, (max(pixels, part * width), max(pixels, part * height)))]
    usual, falls, lowest = REGION_ASPECT
    aspect = max(lowest, 1.0 - abs(_aspect(size) - usual) / falls)
    offset = np.hypot(*((low + high) / 2 - [width / 2, height / 2])) / max(1.0, np.hypot(width, height))
    tight = max(REGION_TIGHT, min(1.0, area / max(1.0, k.polygon_area(k.tightest_rectangle(hull)))))
    return area * fill * aspect * border * max(REGION_OFFSET[1], 1.0 - offset * REGION_OFFSET[0]) * tight


def by_edges(image: np.ndarray) -> np.ndarray | None:
    """The best quadrilateral that strong edges enclose: large, upright, near the middle, off the border."""
    steep = k.gradient(k.smooth(k.grey(image), 3))
    level = max(40.0, float(k.otsu(np.clip(steep, 0, 255))))
    shape, best = steep.shape, (0.0, None)
    for hull in _outlines(steep > level, EDGE_AREA[0], grow=5):
        quad, area = k.four_corners(hull), k.polygon_area(hull)
        low, size = hull.min(axis=0), np.ptp(hull, axis=0) + 1
        if quad is None or not k.is_rectangular(quad):
            continue
        sides = np.array([np.hypot(*(quad[1] - quad[0])), np.hypot(*(quad[3] - quad[0]))])
        if not EDGE_AREA[0] <= area / steep.size <= EDGE_AREA[1] or not EDGE_ASPECT[0] <= _aspect(sides) <= EDGE_ASPECT[1]:
            continue
        margin = EDGE_MARGIN * max(shape)
        border = EDGE_BORDER[_touches(low, low + size, shape, (margin, margin))]
        offset = np.hypot(*(low + size / 2 - [shape[1] / 2, shape[0] / 2])) / (EDGE_OFFSET[0] * np.hypot(*shape))
        score = area * border * max(EDGE_OFFSET[1], 1 - offset) * (1.0 if size[1] >= size[0] else EDGE_LYING)
        if score > best[0]:
            best = score, quad
    return best[1]


def by_paper(image: np.ndarray) -> np.ndarray | None:
    """The largest bright region of little colour, if it has the shape of a sheet."""
    colour = lab(image)
    light, chroma = colour[..., 0], np.hypot(colour[..., 1], colour[..., 2])
    level = np.rint(light * 2.55)
    mask = (level > k.otsu(level)) & (chroma < max(18.0, float(np.percentile(chroma, 25)) + 8))
    mask = k.opened(k.close(mask, 9, 9), 5, 5)
    for hull in _outlines(mask, PAPER_AREA):
        quad = k.four_corners(hull)
        quad = k.tightest_rectangle(hull) if quad is None else quad
        size = np.array([np.hypot(*(quad[1] - quad[0])), np.hypot(*(quad[3] - quad[0]))])
        if k.polygon_area(hull) < 0.95 * mask.size and size.min() >= 2 and PAPER_ASPECT[0] <= _aspect(size) <= PAPER_ASPECT[1]:
            return quad
        return None
    return None


def _closed_grey(gray: np.ndarray, size: int) -> np.ndarray:
    """Dark marks narrower than the size filled with the light around them."""
    view = np.lib.stride_tricks.sliding_window_view
    pad = lambda a, most: np.pad(a, ((size // 2, size - 1 - size // 2),) * 2, mode="edge")
    wide = view(view(pad(gray, True), size, axis=0).max(axis=-1), size, axis=1).max(axis=-1)
    return view(view(pad(wide, False), size, axis=0).min(axis=-1), size, axis=1).min(axis=-1)


def regions(image: np.ndarray) -> dict[str, list[np.ndarray]]:
    """Outlines by detector: the page's frame, edges, brightness, white of little colour."""
    gray = k.grey(image)
    frame = k.gradient(_closed_grey(np.minimum(even_light(gray, 37), FRAME_MOST), FRAME_SIZE)) > FRAME_STEEP
    edges = k.close(k.gradient(k.smooth(even_light(gray, 51), 3)) > EDGES_STEEP, EDGES_SIZE, EDGES_SIZE)
    light = k.smooth(even_light(gray, 51), 5)
    bright = k.opened(k.close(light > min(BRIGHT_MOST, k.otsu(light) + BRIGHT_MORE), BRIGHT_SIZE, BRIGHT_SIZE), BRIGHT_SIZE, BRIGHT_SIZE)
    value, spread = image.max(axis=2), image.max(axis=2) - image.min(axis=2)
    saturation = np.where(value > 0, spread / np.maximum(value, 1) * 255, 0)
    even = even_light(value, 43)
    most, percentile, more = WHITE_COLOUR
    pale = saturation <= min(most, float(np.percentile(saturation, percentile)) + more)
    white = (even >= max(WHITE_LEAST, k.otsu(even) - WHITE_LESS)) & pale | (value >= GLARE[0]) & (saturation <= GLARE[1])
    white = k.opened(k.close(white, WHITE_SIZE, WHITE_SIZE), WHITE_SIZE, WHITE_SIZE)

    def rectangles(mask: np.ndarray) -> list[np.ndarray]:
        quads = [(hull, k.four_corners(hull)) for hull in list(_outlines(mask, REGION_AREA, grow=3))[:12]]
        return [hull for hull, quad in quads if quad is not None and k.is_rectangular(quad)]

    found = {"frame": rectangles(frame)}
    return found | {name: list(_outlines(mask, REGION_AREA)) for name, mask in (("edges", edges), ("brightness", bright), ("white", white))}


def by_regions(image: np.ndarray) -> tuple[np.ndarray, str] | None:
    """The outline of the best score among all detectors, the first one if equal."""
    scored = [(sheet_score(hull, image.shape[:2]), name, hull) for name, hulls in regions(image).items() for hull in hulls]
    if not scored or (best := max(scored, key=lambda x: x[0]))[0] <= 0:
        return None
    quad = k.four_corners(best[2])
    return (k.tightest_rectangle(best[2]) if quad is None or not k.is_rectangular(quad) else quad), best[1]


def find_sheet(image: np.ndarray) -> Sheet | None:
    """The sheet's corners in the image, and which step of the cascade found it."""
    small, step = reduced(image)
    if min(small.shape[:2]) < 16:
        return None
    for how, detector in (("edge quad", by_edges), ("paper quad", by_paper)):
        quad = detector(small)
        if quad is not None:
            return Sheet(quad * step, how)
    region = by_regions(small)
    return None if region is None else Sheet(region[0] * step, region[1])


def trim_border(image: np.ndarray, tolerance: float = 6.0) -> np.ndarray:
    """Without outer rows and columns of one tone."""
    g = k.grey(image)
    rows, columns = np.flatnonzero(g.std(axis=1) > tolerance), np.flatnonzero(g.std(axis=0) > tolerance)
    if not len(rows) or not len(columns):
        return image
    return image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def cut_out(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The sheet within four corners, upright."""
    w = int(max(np.hypot(*(quad[1] - quad[0])), np.hypot(*(quad[2] - quad[3])))) + 1
    h = int(max(np.hypot(*(quad[3] - quad[0])), np.hypot(*(quad[2] - quad[1])))) + 1
    page = k.warp(image, quad, w, h)
    return np.rot90(page, -1) if w > h else page


def crop_page(image: np.ndarray) -> tuple[np.ndarray, str]:
    """The upright page and how it was found; the whole image if no sheet was."""
    sheet = find_sheet(image)
    return (image, "full") if sheet is None else (cut_out(image, sheet.quad), sheet.how)
