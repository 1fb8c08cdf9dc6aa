"""Image kernels in NumPy, from published definitions: preprocessing and six feature extractors.

Images are (height, width, 3) arrays of uint8 in BGR order. Equality to the bit with any imaging library is not claimed.
"""

from __future__ import annotations

import numpy as np

SIDE = 128


def checked(img: np.ndarray) -> np.ndarray:
    if img.ndim != 3 or img.shape[2] != 3 or img.dtype != np.uint8:
        raise ValueError("a 3-channel image of uint8 is needed")
    return img


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64).ravel()
    n = np.sqrt(v @ v)
    return (v / n if n > 1e-12 else v).astype(np.float32)


def _axis_weights(n: int, m: int, area: bool) -> np.ndarray:
    """(m, n) weights that resample n points to m."""
    w = np.zeros((m, n))
    if area:
        edges = np.arange(m + 1) * n / m
        for i in range(m):
            for j in range(int(edges[i]), min(n, int(np.ceil(edges[i + 1])))):
                w[i, j] = max(0.0, min(edges[i + 1], j + 1) - max(edges[i], j))
        return w / w.sum(1, keepdims=True)
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    np.add.at(w, (np.arange(m), low), 1 - (at - low))
    np.add.at(w, (np.arange(m), high), at - low)
    return w


def resize(img: np.ndarray, side: int = SIDE) -> np.ndarray:
    """To a square: area means if the image has more pixels than the target, else bilinear."""
    h, w = img.shape[:2]
    if (h, w) == (side, side):
        return img
    area = h * w > side * side
    a, b = _axis_weights(h, side, area), _axis_weights(w, side, area)
    return np.clip(np.rint(np.einsum("ih,hwc,jw->ijc", a, img.astype(float), b, optimize=True)), 0, 255).astype(np.uint8)


def blur(img: np.ndarray) -> np.ndarray:
    """Gaussian 3 x 3: 1/4, 1/2, 1/4 along both axes, mirrored at the border."""
    x = np.pad(img.astype(float), ((1, 1), (1, 1), (0, 0)), mode="reflect")
    x = (x[:-2] + 2 * x[1:-1] + x[2:]) / 4
    x = (x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4
    return np.rint(x).astype(np.uint8)


# sRGB to XYZ under D65, its white, and the CIE constants.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def _linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


#: Linear light of each of the 256 values of a channel.
_LINEAR = _linear(np.arange(256) / 255.0)


def to_lab(img: np.ndarray) -> np.ndarray:
    t = _LINEAR[img[..., ::-1]] @ _XYZ.T / _WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], -1)
    cube = f * f * f
    t = np.where(cube > 216 / 24389, cube, (116 * f - 16) * 27 / 24389) * _WHITE
    lin = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * lin ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(rgb[..., ::-1] * 255), 0, 255).astype(np.uint8)


def equalised(channel: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """CLAHE of an 8-bit channel: clipped histograms by tile, the excess spread evenly, mappings blended bilinearly."""
    n = channel.shape[0] // tiles
    most = max(1, int(clip * n * n / 256))
    luts = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            h = np.bincount(channel[i * n : (i + 1) * n, j * n : (j + 1) * n].ravel(), minlength=256)
            over = int(np.maximum(h - most, 0).sum())
            h = np.minimum(h, most) + over // 256
            rest = over % 256
            if rest:
                h[:: max(1, 256 // rest)][:rest] += 1
            luts[i, j] = np.clip(np.rint(np.cumsum(h) * 255.0 / (n * n)), 0, 255)
    at = np.arange(channel.shape[0]) / n - 0.5
    low = np.floor(at).astype(int)
    share = at - low
    a, b = np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1)
    v = channel
    pick = lambda r, c: luts[r[:, None], c[None, :], v]
    top = pick(a, a) * (1 - share)[None, :] + pick(a, b) * share[None, :]
    low_ = pick(b, a) * (1 - share)[None, :] + pick(b, b) * share[None, :]
    return np.clip(np.rint(top * (1 - share)[:, None] + low_ * share[:, None]), 0, 255).astype(np.uint8)


def contrast(img: np.ndarray) -> np.ndarray:
    lab = to_lab(img)
    lab[..., 0] = equalised(np.rint(lab[..., 0] * 2.55).astype(np.uint8)) / 2.55
    return from_lab(lab)


def preprocess(img: np.ndarray) -> np.ndarray:
    return contrast(blur(resize(checked(img))))


def stages(img: np.ndarray) -> dict[str, np.ndarray]:
    small = resize(checked(img))
    soft = blur(small)
    return {"original": img, "resized": small, "blurred": soft, "equalised": contrast(soft)}


def to_hsv(img: np.ndarray) -> np.ndarray:
    """8-bit HSV with hue in 0 to 179, in whole numbers: reciprocals of value and chroma scaled by 4096."""
    b, g, r = (img[..., k].astype(np.int64) for k in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    by = np.arange(256)
    by[0] = 1
    per_value, per_chroma = (np.rint(x * 4096 / by).astype(np.int64) * (np.arange(256) > 0) for x in (255, 30))
    s = (d * per_value[v] + 2048) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (h * per_chroma[d] + 2048) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, v], -1).astype(np.uint8)


def gray(img: np.ndarray) -> np.ndarray:
    """0.114 B + 0.587 G + 0.299 R in whole numbers of 1 / 16384, rounded."""
    return ((img.astype(np.int64) @ np.array([1868, 9617, 4899]) + 8192) >> 14).astype(np.uint8)


def hsv_histogram(img: np.ndarray) -> np.ndarray:
    x = to_hsv(checked(img)).reshape(-1, 3).astype(int)
    return unit(np.bincount((x[:, 0] * 12 // 180) * 64 + (x[:, 1] // 32) * 8 + x[:, 2] // 32, minlength=768))


def colour_moments(img: np.ndarray) -> np.ndarray:
    x = to_hsv(checked(img)).reshape(-1, 3).astype(float)
    mean = x.mean(0)
    d = x - mean
    return unit(np.stack([mean, np.sqrt((d**2).mean(0)), np.cbrt((d * d * d).mean(0))], 1))


def uniform_lbp(img: np.ndarray, radius: int = 2, points: int = 16) -> np.ndarray:
    """Counts of rotation-invariant uniform patterns: the set bits if there are at most two changes round the circle, else one bin."""
    x = gray(checked(img)).astype(float)
    h, w = x.shape
    p = np.pad(x, radius + 1)
    bits = []
    for k in range(points):
        a = 2 * np.pi * k / points
        dy, dx = -radius * round(np.sin(a), 10), radius * round(np.cos(a), 10)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda i, j: p[radius + 1 + i : radius + 1 + i + h, radius + 1 + j : radius + 1 + j + w]
        v = at(y0, x0) * (1 - fy) * (1 - fx)
        if fx:
            v = v + at(y0, x0 + 1) * (1 - fy) * fx
        if fy:
            v = v + at(y0 + 1, x0) * fy * (1 - fx)
        if fx and fy:
            v = v + at(y0 + 1, x0 + 1) * fy * fx
        bits.append(np.round(v, 9) >= x)
    b = np.stack(bits)
    changes = (b != np.roll(b, 1, 0)).sum(0)
    return unit(np.bincount(np.where(changes <= 2, b.sum(0), points + 1).ravel(), minlength=points + 2))


def glcm_textures(img: np.ndarray, levels: int = 32) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity, energy and correlation of co-occurring grays at distances 1 and 3 in four directions."""
    x = (gray(checked(img)) // 8).astype(int)
    i, j = np.mgrid[:levels, :levels]
    out = np.zeros((5, 8))
    for k, (d, a) in enumerate((d, a) for d in (1, 3) for a in range(4)):
        dy, dx = ((0, d), (round(d * np.sin(np.pi / 4)), round(d * np.cos(np.pi / 4))), (d, 0), (round(d * np.sin(np.pi / 4)), -round(d * np.cos(np.pi / 4))))[a]
        h, w = x.shape
        left = x[: h - dy, max(0, -dx) : w - max(0, dx)]
        right = x[dy:, max(0, dx) : w + min(0, dx)]
        m = np.bincount(left.ravel() * levels + right.ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
        m = m + m.T
        m /= m.sum()
        mi = (i * m).sum()
        var = ((i - mi) ** 2 * m).sum()
        corr = ((i - mi) * (j - mi) * m).sum() / var if var > 1e-15 else 1.0
        out[:, k] = ((i - j) ** 2 * m).sum(), (abs(i - j) * m).sum(), (m / (1 + (i - j) ** 2)).sum(), np.sqrt((m**2).sum()), corr
    return unit(np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0))


def hog(img: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Histograms of oriented gradients: blocks of 2 x 2 cells that overlap by a cell; 128 x 128 only.

    A pixel's gradient (central differences, borders mirrored, no gamma) votes for the two nearest orientations of nine
    and for the cells of the block round it, by distance to their centres, weighted by a Gaussian round the block's
    centre (sigma: a quarter of the block). Blocks are normalised, clipped at 0.2 and normalised again; blocks
    and the cells in them go column by column.
    """
    x = gray(checked(img)).astype(float)
    if x.shape != (SIDE, SIDE):
        raise ValueError("hog needs 128 x 128")
    p = np.pad(x, 1, mode="reflect")
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    size, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), 2 * np.pi) * bins / np.pi - 0.5
    low = np.floor(angle).astype(int)
    share = angle - low
    votes = np.zeros((SIDE, SIDE, bins))
    rows, cols = np.mgrid[:SIDE, :SIDE]
    votes[rows, cols, low % bins] += size * (1 - share)
    votes[rows, cols, (low + 1) % bins] += size * share
    side = 2 * cell
    away = (np.arange(side) - cell) ** 2 / (2 * (side / 4) ** 2)
    place = (np.arange(side) + 0.5) / cell - 0.5
    near = np.maximum(0.0, 1 - np.abs(place[None, :] - np.arange(2)[:, None])) * np.exp(-away)[None, :]
    n = SIDE // cell - 1
    at = np.arange(n)[:, None] * cell + np.arange(side)[None, :]
    along = np.matmul(near, votes[:, at])  # rows, blocks across, their two cells, bins
    blocks = np.matmul(near, along[at].transpose(0, 2, 3, 1, 4))  # blocks down, blocks across, cells across, cells down, bins
    blocks = blocks.transpose(1, 0, 2, 3, 4).reshape(n * n, 4 * bins)
    blocks = blocks / (np.sqrt((blocks**2).sum(-1, keepdims=True)) + 0.1 * 4 * bins)
    blocks = np.minimum(blocks, 0.2)
    return unit(blocks / (np.sqrt((blocks**2).sum(-1, keepdims=True)) + 1e-3))


def hu_moments(img: np.ndarray) -> np.ndarray:
    x = gray(checked(img)).astype(float)
    yy, xx = np.mgrid[: x.shape[0], : x.shape[1]].astype(float)
    total = x.sum()
    if total == 0:
        return unit(-np.sign(np.zeros(7)) * np.log10(1e-10))
    yy, xx = yy - (yy * x).sum() / total, xx - (xx * x).sum() / total
    n = lambda p, q: (xx**p * yy**q * x).sum() / total ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = n(2, 0), n(0, 2), n(1, 1), n(3, 0), n(0, 3), n(2, 1), n(1, 2)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = np.array([
        n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ])
    return unit(-np.sign(h) * np.log10(np.abs(h) + 1e-10))


EXTRACTORS = {"hsv": hsv_histogram, "cm": colour_moments, "lbp": uniform_lbp, "glcm": glcm_textures, "hog": hog, "hu": hu_moments}


def extract_all(img: np.ndarray) -> dict[str, np.ndarray]:
    return {name: f(img) for name, f in EXTRACTORS.items()}
