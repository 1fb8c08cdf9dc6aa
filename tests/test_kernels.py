"""Kernels against values worked out by hand or pixel by pixel."""

import math

import numpy as np
import pytest

from nearfield.functions import kernels
from nearfield.functions.kernels import unit


def flat(b, g, r, h=8, w=8):
    return np.tile(np.array([b, g, r], np.uint8), (h, w, 1))


def test_hsv_of_plain_colours():
    want = {(255, 0, 0): (120, 255, 255), (0, 255, 0): (60, 255, 255), (0, 0, 255): (0, 255, 255), (0, 255, 255): (30, 255, 255), (255, 255, 255): (0, 0, 255), (0, 0, 0): (0, 0, 0), (100, 50, 200): (170, 191, 200), (50, 100, 200): (10, 191, 200)}
    for bgr, hsv in want.items():
        assert tuple(kernels.to_hsv(flat(*bgr))[0, 0]) == hsv


def test_histogram_and_moments_by_hand():
    img = np.concatenate([flat(0, 0, 255, 4), flat(255, 0, 0, 4)])  # half red (0, 255, 255), half blue (120, 255, 255)
    found = kernels.hsv_histogram(img)
    assert np.flatnonzero(found).tolist() == [63, 8 * 64 + 63] and found[63] == pytest.approx(math.sqrt(0.5))
    assert kernels.colour_moments(img) == pytest.approx(unit([60, 60, 0, 255, 0, 0, 255, 0, 0]), abs=1e-6)
    three = np.concatenate([flat(0, 0, 0, 6), flat(0, 0, 100, 2)])  # value 0, 0, 0, 100: mean 25, m3 = (3 * -25^3 + 75^3) / 4
    v = [25, math.sqrt(1875), np.cbrt((3 * -15625 + 421875) / 4)]
    s = [63.75, math.sqrt(3 * 63.75**2 / 4 + 191.25**2 / 4), np.cbrt((3 * -(63.75**3) + 191.25**3) / 4)]
    assert kernels.colour_moments(three) == pytest.approx(unit([0, 0, 0, *s, *v]), abs=1e-6)


def test_gray_and_blur_by_hand():
    assert kernels.gray(flat(10, 20, 30))[0, 0] == round(0.114 * 10 + 0.587 * 20 + 0.299 * 30)
    img = flat(0, 0, 0, 5, 5)
    img[2, 2] = 160
    soft = kernels.blur(img)[..., 0]
    assert soft[1:4, 1:4].tolist() == [[10, 20, 10], [20, 40, 20], [10, 20, 10]] and soft.sum() == 160
    img = flat(0, 0, 0, 3, 3)
    img[0, 0] = 160  # at the corner the second row and column stand in for what lies outside
    assert kernels.blur(img)[..., 0].tolist() == [[40, 20, 0], [20, 10, 0], [0, 0, 0]]


def test_resize_by_hand():
    img = np.zeros((256, 256, 3), np.uint8)
    img[::2, ::2] = 200  # means of 2 x 2
    assert (kernels.resize(img) == 50).all()
    ramp = np.repeat(np.repeat(np.array([[0, 100]], np.uint8)[..., None], 3, 2), 2, 0)  # two columns, bilinear
    row = kernels.resize(ramp)[0, :, 0].astype(int)
    want = [round(100 * min(1, max(0, (i + 0.5) * 2 / 128 - 0.5))) for i in range(128)]
    assert np.abs(row - want).max() <= 1


def test_equalised():
    """A tile's clipped histogram gives its mapping; with equal tiles there is nothing to blend."""
    tile = np.arange(256, dtype=np.uint8).reshape(16, 16)
    x = np.tile(tile, (8, 8))
    assert np.abs(kernels.equalised(x).astype(int) - x).max() <= 1  # every value once: the sums are the identity
    two = np.tile(np.where(np.arange(256).reshape(16, 16) < 128, 100, 101).astype(np.uint8), (8, 8))
    # each of two values may count twice; 252 others are spread, one to a bin, from the lowest on
    got = kernels.equalised(two)
    assert got[two == 100].max() < got[two == 101].min() and got[two == 101].max() - got[two == 100].min() <= 4


def test_texture_patterns_pixel_by_pixel():
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (12, 11, 3)).astype(np.uint8)
    x = kernels.gray(img).astype(float)
    h, w = x.shape
    counts = np.zeros(18)
    value = lambda i, j: x[i, j] if 0 <= i < h and 0 <= j < w else 0.0
    for i in range(h):
        for j in range(w):
            bits = []
            for k in range(16):
                a = 2 * math.pi * k / 16
                r, c = i - 2 * round(math.sin(a), 10), j + 2 * round(math.cos(a), 10)
                r0, c0 = math.floor(r), math.floor(c)
                fr, fc = r - r0, c - c0
                v = sum(value(r0 + p, c0 + q) * (fr if p else 1 - fr) * (fc if q else 1 - fc) for p in (0, 1) for q in (0, 1))
                bits.append(round(v, 9) >= x[i, j])
            changes = sum(bits[k] != bits[k - 1] for k in range(16))
            counts[sum(bits) if changes <= 2 else 17] += 1
    assert kernels.uniform_lbp(img) == pytest.approx(unit(counts), abs=1e-6)
    found = []
    levels = (kernels.gray(img) // 8).astype(int)
    for d in (1, 3):
        for k in range(4):
            dy, dx = ((0, d), (round(d * math.sin(math.pi / 4)), round(d * math.sin(math.pi / 4))), (d, 0), (round(d * math.sin(math.pi / 4)), -round(d * math.sin(math.pi / 4))))[k]
            m = np.zeros((32, 32))
            for i in range(h):
                for j in range(w):
                    if 0 <= i + dy < h and 0 <= j + dx < w:
                        m[levels[i, j], levels[i + dy, j + dx]] += 1
                        m[levels[i + dy, j + dx], levels[i, j]] += 1
            m /= m.sum()
            i, j = np.mgrid[:32, :32]
            mean = (i * m).sum()
            found.append([((i - j) ** 2 * m).sum(), (abs(i - j) * m).sum(), (m / (1 + (i - j) ** 2)).sum(), math.sqrt((m**2).sum()), ((i - mean) * (j - mean) * m).sum() / ((i - mean) ** 2 * m).sum()])
    assert kernels.glcm_textures(img) == pytest.approx(unit(np.array(found).T), abs=1e-6)


def test_hu_moments_of_a_bar():
    """A bar of 2 x 4 pixels of one gray: central moments by hand, the third ones zero."""
    img = flat(0, 0, 0, 20, 20)
    img[5:7, 8:12] = 100
    total, mu20, mu02 = 800.0, 100 * 2 * (2.25 + 0.25) * 2, 100 * 4 * 0.25 * 2
    n20, n02 = mu20 / total**2, mu02 / total**2
    h = [n20 + n02, (n20 - n02) ** 2, 0, 0, 0, 0, 0]
    got = kernels.hu_moments(img)
    want = [-math.copysign(1, x) * math.log10(abs(x) + 1e-10) if x else 0 for x in h]
    assert got[1] / got[0] == pytest.approx(want[1] / want[0], rel=1e-5)
    turned = kernels.hu_moments(np.ascontiguousarray(img.transpose(1, 0, 2)))
    assert turned[:2] == pytest.approx(got[:2], rel=1e-5)


def test_hog_pixel_by_pixel():
    rng = np.random.default_rng(11)
    img = np.repeat(np.repeat(rng.integers(0, 256, (32, 32, 3)).astype(np.uint8), 4, 0), 4, 1)
    x = kernels.gray(img).astype(float)
    mirror = lambda i: -i if i < 0 else 254 - i if i > 127 else i
    got = kernels.hog(img)
    weights, blocks = np.zeros((16, 16)), {}
    for i in range(16):
        for j in range(16):
            weights[i, j] = math.exp(-((i - 8) ** 2 + (j - 8) ** 2) / 32)
    for bx, by in ((0, 0), (14, 3), (7, 14)):
        hist = np.zeros((2, 2, 9))
        for i in range(16):
            for j in range(16):
                r, c = by * 8 + i, bx * 8 + j
                gx, gy = x[r, mirror(c + 1)] - x[r, mirror(c - 1)], x[mirror(r + 1), c] - x[mirror(r - 1), c]
                angle = math.atan2(gy, gx) % (2 * math.pi) * 9 / math.pi - 0.5
                low = math.floor(angle)
                for cx in (0, 1):
                    for cy in (0, 1):
                        near = max(0, 1 - abs((j + 0.5) / 8 - 0.5 - cx)) * max(0, 1 - abs((i + 0.5) / 8 - 0.5 - cy))
                        for b, share in ((low, 1 - angle + low), (low + 1, angle - low)):
                            hist[cx, cy, b % 9] += math.hypot(gx, gy) * share * near * weights[i, j]
        v = hist.ravel()
        v = np.minimum(v / (np.linalg.norm(v) + 3.6), 0.2)
        blocks[bx * 15 + by] = v / (np.linalg.norm(v) + 1e-3)
    for k, v in blocks.items():
        part = got[36 * k : 36 * k + 36].astype(float)
        assert part / np.linalg.norm(part) == pytest.approx(v / np.linalg.norm(v), abs=1e-5)
    ratio = {k: np.linalg.norm(got[36 * k : 36 * k + 36]) / np.linalg.norm(v) for k, v in blocks.items()}
    assert max(ratio.values()) == pytest.approx(min(ratio.values()), rel=1e-4)
