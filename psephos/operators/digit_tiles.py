"""From a vote box to a digit: rectify, bring out the ink three ways, cut, make tensors, choose a class."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from psephos.operators import kernels as k

# Side of a rectified box, least part of the tile that its outline takes, and how far it may be from square.
SIDE, LEAST_OUTLINE, MOST_SKEW = 128, 0.08, 0.35
# Limits of ink in a mask, and the scores beyond them.
INK, TOO_LITTLE, TOO_MUCH, EMPTY = (0.002, 0.25), -5.0, -2.0, -999.0


class Variant(NamedTuple):
    """How a mask becomes a tensor; only careful ones may choose the class."""

    name: str
    margin: int
    grow: int
    nearest: bool
    careful: bool


# The five variants.
VARIANTS = (Variant("plain", 4, 0, True, True), Variant("wide", 4, 1, True, True), Variant("wide grey", 4, 1, False, True), Variant("wider", 3, 2, True, False), Variant("wider grey", 3, 2, False, False))


def rectified(tile: np.ndarray) -> tuple[np.ndarray, bool]:
    """The largest near-square outline of a tile as a square of SIDE pixels; the tile itself if there is none."""
    if min(tile.shape[:2]) < 20:
        return tile, False
    steep = k.gradient(k.smooth(k.grey(tile), 3))
    edges = steep > max(50, k.otsu(np.clip(steep, 0, 255)))
    labels, found = k.components(k.dilate(edges, 3, 3))
    best = (0.0, None)
    for i, (x, y, w, h, _) in enumerate(found):
        if w * h < LEAST_OUTLINE * labels.size or abs(w / h - 1) > MOST_SKEW:
            continue
        hull = k.outline((labels[y : y + h, x : x + w] == i + 1) & edges[y : y + h, x : x + w]) + [x, y]
        quad = k.four_corners(hull)
        if quad is not None and k.is_rectangular(quad) and k.polygon_area(hull) > max(best[0], LEAST_OUTLINE * labels.size):
            best = k.polygon_area(hull), quad
    return (tile, False) if best[1] is None else (k.warp(tile, best[1], SIDE, SIDE), True)


def _clean(mask: np.ndarray, minimal: bool = False) -> np.ndarray:
    """Without specks; unless minimal with small gaps closed, diagonal ones too."""
    mask = k.opened(mask, 2, 2)
    if minimal:
        return mask
    mask = k.close(mask, 3, 3)
    for shift in (1, -1):
        near = lambda m, s=shift: m | np.roll(m, (1, s), (0, 1)) | np.roll(m, (-1, -s), (0, 1))
        grown = near(np.pad(mask, 1))
        mask = mask | (~near(~grown))[1:-1, 1:-1]
    return mask


def mask_score(mask: np.ndarray) -> float:
    """How digit-like a mask is (as scoring.mask_score has it for rows)."""
    ink = float(mask.mean()) if mask.size else 0.0
    if not ink:
        return EMPTY
    if not INK[0] <= ink <= INK[1]:
        return TOO_LITTLE if ink < INK[0] else TOO_MUCH
    lines = k.thinned(mask)
    around = k.box_mean(lines.astype(float), 3) * 9 - 1 if min(lines.shape) > 1 else np.zeros(lines.shape)
    junctions = int((np.rint(around[lines]) >= 3).sum())
    parts = len(k.components(mask)[1])
    return 2.0 * min(1.0, ink / 0.06) + 2.0 * min(1.0, lines.sum() / 80.0) - 0.4 * max(0, parts - 2) - 0.2 * min(10, junctions)


def inked(tile: np.ndarray) -> tuple[np.ndarray, str]:
    """Ink of a tile by three ways, the most digit-like one (the first if equal) and its name.

    a: darker than the surroundings; b: one level for all after evening the light; c: darker by less, for thin strokes.
    """
    gray = k.median_filter(k.grey(tile), 3)
    soft = k.smooth(k.local_contrast(gray, 1.6), 3)
    around = k.smooth(soft, 21 if min(soft.shape) < 90 else 31)
    even = np.clip(gray / np.maximum(k.smooth(gray, 51), 1) * 255, 0, 255)
    level = min(k.otsu(even), 215)
    ways = {"a": _clean(soft < around - 11), "b": _clean(even <= level), "c": _clean(soft < around - 5, minimal=True)}
    name = max(ways, key=lambda way: mask_score(ways[way]))
    return ways[name], name


def without_border(mask: np.ndarray) -> np.ndarray:
    """Without outline pieces and specks, unless much ink goes and hardly any is left."""
    labels, found = k.components(mask)
    height, width = mask.shape
    keep = np.zeros(len(found) + 1, bool)
    for i, (x, y, w, h, n) in enumerate(found):
        line = w >= 0.9 * width and h <= 0.15 * height or h >= 0.9 * height and w <= 0.15 * width
        sides = (x <= 0) + (y <= 0) + (x + w >= width) + (y + h >= height)
        rim = (y <= 0 or y + h >= height) and h <= 0.06 * height or (x <= 0 or x + w >= width) and w <= 0.06 * width
        small = n < max(8, 0.0009 * mask.size) or max(w, h) <= 3
        keep[i + 1] = not line and not rim and not (sides >= 2 and n < 0.25 * w * h) and not small
    cleaned, gone = keep[labels], sum(n for i, (*_, n) in enumerate(found) if not keep[i + 1])
    return cleaned if cleaned.sum() >= 0.2 * mask.sum() or gone < 0.08 * mask.size else mask


def digit_mask(image: np.ndarray, box: tuple[int, int, int, int], margin: float = 0.12, inset: float = 0.14) -> np.ndarray:
    """Ink inside a vote box (x, y, w, h): rectified with some room around it, its outline cut off."""
    x, y, w, h = box
    room = int(margin * max(w, h))
    tile = image[max(0, y - room) : y + h + room, max(0, x - room) : x + w + room]
    square, found = rectified(tile)
    if not found:
        square = image[max(0, y) : y + h, max(0, x) : x + w]
    dy, dx = max(1, int(inset * square.shape[0])), max(1, int(inset * square.shape[1]))
    inside = square[dy:-dy, dx:-dx]
    if min(inside.shape[:2]) < 8:
        return np.zeros((1, 1), bool)
    gray = k.grey(inside)
    if np.percentile(gray, 99) - gray.min() < 24:  # paper alone: contrast would only bring out its grain
        return np.zeros(gray.shape, bool)
    return without_border(inked(inside)[0])


def cut(mask: np.ndarray) -> np.ndarray:
    """The ink with a narrow margin, or with a wide one where that keeps clearly more of its lines."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return mask
    longest = max(int(np.ptp(ys)), int(np.ptp(xs))) + 1

    def part(share: float) -> np.ndarray:
        pad = min(10, max(2, round(share * longest)))
        return mask[max(0, ys.min() - pad) : ys.max() + pad + 1, max(0, xs.min() - pad) : xs.max() + pad + 1]

    narrow, wide = part(0.06), part(0.12)
    return wide if k.thinned(wide).sum() > 1.08 * k.thinned(narrow).sum() else narrow


def tensors(mask: np.ndarray) -> np.ndarray:
    """A tensor for each variant, of the ink alone."""
    ys, xs = np.nonzero(mask)
    ink = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else mask
    return np.stack([k.to_tensor(ink, inner=28 - 2 * v.margin, grow=v.grow, nearest=v.nearest, blur=True) for v in VARIANTS])


def chosen(probabilities: np.ndarray, temperature: float = 1.0) -> tuple[int, float]:
    """Class and score by the variants' probabilities (variants x classes), calibrated by a temperature.

    The best careful variant chooses; another one may only raise the score of the same class.
    """
    p = np.maximum(probabilities, 1e-12) ** (1 / temperature)
    p = p / p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)[:, ::-1]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1)
    scores = 2.2 * (top[:, 0] - top[:, 1]) + top[:, 0] - 0.35 * np.maximum(0, entropy - 1.6)
    classes = p.argmax(axis=1)
    best = max((i for i, v in enumerate(VARIANTS) if v.careful), key=lambda i: scores[i])
    raised = [scores[i] for i, v in enumerate(VARIANTS) if not v.careful and classes[i] == classes[best]]
    return int(classes[best]), float(max([scores[best], *raised]))


def is_blank(mask: np.ndarray, least_ink: int = 35, least: float = 0.0025) -> bool:
    """Hardly any ink, or a box of ink too small for a digit (narrow ones may be tall)."""
    if mask.sum() < least_ink or mask.mean() < least:
        return True
    ys, xs = np.nonzero(mask)
    width, height = (np.ptp(xs) + 1) / mask.shape[1], (np.ptp(ys) + 1) / mask.shape[0]
    return bool((width < 0.10 or height < 0.18) and not (height > 0.55 and (np.ptp(xs) + 1) / (np.ptp(ys) + 1) < 0.3))


def read(image: np.ndarray, boxes: list[tuple[int, int, int, int]], classify: Callable[[np.ndarray], np.ndarray], temperature: float = 1.0) -> list[tuple[bool, int | None, float | None]]:
    """(blank, class, score) of each box; all tensors of an image are classified together."""
    masks = [digit_mask(image, box) for box in boxes]
    blank = [is_blank(m) for m in masks]
    ready = [tensors(cut(m)) for m, b in zip(masks, blank, strict=True) if not b]
    results = iter(classify(np.concatenate(ready)).reshape(len(ready), len(VARIANTS), -1) if ready else ())
    return [(True, None, None) if b else (False, *chosen(next(results), temperature)) for b in blank]
