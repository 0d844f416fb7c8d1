"""What must hold for the pixel kernels."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from psephos.operators import kernels as k

masks = hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12)))
greys = hnp.arrays(np.uint8, st.tuples(st.integers(2, 12), st.integers(2, 12)))


@settings(max_examples=50, deadline=None)
@given(masks)
def test_components_partition_the_ink(mask):
    labels, found = k.components(mask)
    assert ((labels > 0) == mask).all() and sum(c[4] for c in found) == mask.sum()


@settings(max_examples=50, deadline=None)
@given(greys)
def test_otsu_ignores_flips(image):
    assert k.otsu(image) == k.otsu(image[::-1]) == k.otsu(image[:, ::-1])


@settings(max_examples=50, deadline=None)
@given(masks)
def test_morphology(mask):
    assert (k.erode(mask, 3, 3) <= mask).all() and (mask <= k.dilate(mask, 3, 3)).all()
    assert (k.skeleton(mask) <= mask).all() and k.skeleton(mask).any() == mask.any()


@settings(max_examples=50, deadline=None)
@given(masks)
def test_tensor_and_crop(mask):
    out = k.to_tensor(k.crop_ink(mask))
    assert out.shape == (28, 28) and 0 <= out.min() and out.max() <= 1
    assert k.crop_ink(mask).sum() == mask.sum()


def test_warp_ncc_mean():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (k.warp(image, np.array([[0, 0], [7, 0], [7, 5], [0, 5]]), 8, 6) == image).all()
    assert abs(k.ncc(image, image) - 1) < 1e-12 and k.ncc(np.ones((2, 2)), image[:2, :2]) == 0
    assert np.allclose(k.box_mean(np.full((9, 9), 7.0), 3), 7)
    assert k.skew(np.zeros((20, 20), bool)) == 0
