"""Image operators: NumPy kernels on arrays of grey (H x W) or colour (H x W x 3) pixels, and their use on tables of images.

A table of images has a column `content` with PNG bytes (decoded here), or pixels as an array with height and width. Other formats
need a decoder, which callers inject; no kernel sees more than one image, or one pair, at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# PNG


def png(image: np.ndarray) -> bytes:
    """8-bit grey or RGB pixels as PNG bytes."""
    h, w = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey, RGB or RGBA PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or not channels or interlaced:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(w * channels, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w * channels):
                left = int(out[y, x - channels]) if x >= channels else 0
                corner = int(up[x - channels]) if x >= channels else 0
                above = int(up[x])
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                out[y, x] = (line[x] + guess) & 255
    return out.reshape(h, w) if channels == 1 else out.reshape(h, w, channels)[:, :, :3]


# basics


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = image.astype(float)
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    if h <= height:  # rows are mixed once each, before they are repeated
        across = a[:, x0] * (1 - fx) + a[:, x1] * fx
        return across[y0] * (1 - fy) + across[y1] * fy
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def to_height(image: np.ndarray, height: int) -> np.ndarray:
    return resized(image, height, max(1, round(image.shape[1] * height / image.shape[0])))


def model_input(image: np.ndarray, size: int = 224, short: int = 256, mean: tuple = (0.485, 0.456, 0.406), std: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Short side to `short`, centre crop of `size`, scaled by mean and deviation, channels first."""
    h, w = image.shape[:2]
    big = resized(image, round(h * short / min(h, w)), round(w * short / min(h, w)))
    y, x = (big.shape[0] - size) // 2, (big.shape[1] - size) // 2
    if big.ndim == 2:  # one plane serves all channels
        plane = big[y : y + size, x : x + size] / 255
        return np.stack([(plane - m) / d for m, d in zip(mean, std, strict=True)])
    return ((big[y : y + size, x : x + size] / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(float)
    for axis in (1, 0):  # all lines at once, one weight after the other
        n = out.shape[axis]
        p = np.pad(out, [(r, r) if i == axis else (0, 0) for i in range(out.ndim)], mode="edge")
        out = sum(w * (p[:, i : i + n] if axis else p[i : i + n]) for i, w in enumerate(k[::-1]))
    return out


# hashes


def _bits(b: np.ndarray) -> str:
    return f"{int(''.join('1' if x else '0' for x in b.ravel()), 2):0{-(-b.size // 4)}x}"


def average_hash(image: np.ndarray, size: int = 8) -> str:
    p = resized(grey(image), size, size)
    return _bits(p > p.mean())


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    p = resized(grey(image), size, size + 1)
    return _bits(p[:, 1:] > p[:, :-1])


def perceptual_hash(image: np.ndarray, size: int = 8, factor: int = 4) -> str:
    n = size * factor
    p = resized(grey(image), n, n)
    k = np.arange(n)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (dct @ p @ dct.T)[:size, :size]
    return _bits(low > np.median(low))


#: The low-pass filter of Daubechies' wavelet with four moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def wavelet_hash(image: np.ndarray, kind: str = "haar", size: int = 8, factor: int = 8) -> str:
    p = resized(grey(image), size * factor, size * factor) / 255
    low = np.array([0.5, 0.5]) * np.sqrt(2) if kind == "haar" else np.array(DB4)
    while p.shape[0] > size:
        for axis in (0, 1):
            n = p.shape[axis]
            at = (2 * np.arange(n // 2)[:, None] + np.arange(len(low))[None, :]) % n
            p = np.tensordot(np.take(p, at, axis=axis), low, axes=([axis + 1], [0]))
            p = p if axis == 0 else p.reshape(p.shape[0], -1)
    return _bits(p > np.median(p))


HASHES: dict[str, Callable[[np.ndarray], str]] = {"average": average_hash, "perceptual": perceptual_hash, "difference": difference_hash, "wavelet_haar": wavelet_hash, "wavelet_db4": lambda x: wavelet_hash(x, "db4")}

# predicates and measures


def is_solid(image: np.ndarray, gamma: int = 5) -> bool:
    """Whether all pixels are nearer than gamma to the first."""
    d = np.abs(image.astype(int) - image[0, 0].astype(int))
    return bool((d < gamma).all())


def has_black_border(image: np.ndarray, gamma: int = 5) -> bool:
    g = grey(image)
    return any(bool((edge < gamma).all()) for edge in (g[0], g[-1], g[:, 0], g[:, -1]))


def colour_kind(image: np.ndarray, limit: float = 22, size: int = 40) -> str:
    """'b&w' for one band, 'color' where pixels differ from their own grey by more than the limit (mean square), else 'grayscale'."""
    if image.ndim == 2:
        return "b&w"
    t = resized(image, size, size)
    d = t - t.mean(axis=2, keepdims=True) - (t.mean(axis=(0, 1)) - t.mean())
    return "color" if (d**2).mean() > limit else "grayscale"


def entropy(image: np.ndarray) -> float:
    p = np.bincount(np.clip(np.rint(grey(image)), 0, 255).astype(int).ravel(), minlength=256) / (image.shape[0] * image.shape[1])
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def stroke_width(mask: np.ndarray) -> float:
    """Mean of the local maxima of the distance to the background (city blocks), 0 without ink."""
    d = np.where(mask, 1 << 20, 0).astype(float)
    h, w = d.shape
    for y in range(h):
        if y:
            d[y] = np.minimum(d[y], d[y - 1] + 1)
        d[y] = np.minimum.accumulate(d[y] - np.arange(w)) + np.arange(w)
    for y in range(h - 1, -1, -1):
        if y < h - 1:
            d[y] = np.minimum(d[y], d[y + 1] + 1)
        d[y] = (np.minimum.accumulate(d[y][::-1] - np.arange(w)) + np.arange(w))[::-1]
    p = np.pad(d, 1)
    top = np.max([p[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    peaks = d[(d == top) & mask]
    return float(peaks.mean()) if len(peaks) else 0.0


def run_filled(image: np.ndarray, reach: int) -> np.ndarray:
    """Run-length smoothing of rows of 0 and 255: white between two blacks not further apart than reach turns black."""
    out = image.copy()
    for row in out:
        at = np.flatnonzero(row == 0)
        for a, b in zip(at, at[1:], strict=False):
            if b - a <= reach:
                row[a:b] = 0
    return out


def smoothed_both(image: np.ndarray, across: int, down: int) -> np.ndarray:
    """Rows first, then columns."""
    return run_filled(run_filled(image, across).T.copy(), down).T


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Connected regions (4 neighbours) of a mask, numbered from 1 as they begin, by union of runs of rows."""
    h, w = mask.shape
    flat = np.zeros((h, w + 1), np.int8)  # the last column parts the rows
    flat[:, :w] = mask
    flat = flat.ravel()
    step = np.diff(flat, prepend=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    low, high = np.searchsorted(last, first - w - 1, side="right"), np.searchsorted(first, last - w - 1, side="left")  # runs above
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for run, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for above in range(a, b):
            i, j = root(run), root(above)
            parent[max(i, j)] = min(i, j)
    names, new = np.unique(np.array([root(k) for k in range(len(parent))], np.int64), return_inverse=True)
    lab = np.zeros(len(flat), np.int64)
    lab[flat == 1] = np.repeat(new + 1, last - first)
    return lab.reshape(h, w + 1)[:, :w], len(names)


def region_boxes(mask: np.ndarray) -> np.ndarray:
    """xmax, ymax, xmin, ymin of each connected region."""
    lab, n = labelled(mask)
    out = np.zeros((n, 4), int)
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        out[k - 1] = x.max() + 1, y.max() + 1, x.min(), y.min()
    return out


# borders, pages, perspective


def without_border(image: np.ndarray, threshold: float = 5, inset: int = 3) -> tuple[np.ndarray | None, str]:
    """(image, what was done): None for one colour, the image itself without a border, else cut to what is brighter than the border."""
    if is_solid(image):
        return None, "solid"
    if not has_black_border(image):
        return image, "none"
    h, w = image.shape[:2]
    mask = blurred(grey(image), 1.0) > threshold
    ys, xs = np.flatnonzero(mask.mean(axis=1) > 0.5), np.flatnonzero(mask.mean(axis=0) > 0.5)
    if not len(ys) or not len(xs):
        return image, "failed"
    y0, y1, x0, x1 = ys[0], ys[-1] + 1, xs[0], xs[-1] + 1
    if not 0.5 * h * w < (y1 - y0) * (x1 - x0):
        return image, "failed"
    return image[y0 + inset : y1 - inset, x0 + inset : x1 - inset], "cut"


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Strong gradients, and weaker ones beside them."""
    g = blurred(grey(image), 1.0)
    p = np.pad(g, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.hypot(gx, gy)
    lab, n = labelled(m > low)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(lab[m > high])] = True
    strong[0] = False
    return strong[lab]


def hough_lines(mask: np.ndarray, most: int = 20, angles: int = 180, votes: int = 50) -> np.ndarray:
    """rho, theta of the lines with most points, each the best of its neighbourhood."""
    y, x = np.nonzero(mask)
    theta = np.arange(angles) * np.pi / angles
    reach = int(np.ceil(np.hypot(*mask.shape)))
    rho = np.rint(x[:, None] * np.cos(theta) + y[:, None] * np.sin(theta)).astype(int) + reach
    count = np.zeros((2 * reach + 1, angles), int)
    for k in range(angles):
        count[:, k] = np.bincount(rho[:, k], minlength=2 * reach + 1)
    out = []
    for _ in range(most):
        r, t = np.unravel_index(count.argmax(), count.shape)
        if count[r, t] < votes:
            break
        out.append((r - reach, theta[t]))
        count[max(0, r - 10) : r + 11, max(0, t - 5) : t + 6] = 0
    return np.array(out).reshape(-1, 2)


def split_lines(lines: np.ndarray, delta: float = np.pi / 18) -> tuple[np.ndarray, np.ndarray]:
    """Nearly horizontal and nearly vertical ones of rho, theta."""
    t = lines[:, 1]
    return lines[np.abs(t - np.pi / 2) < delta], lines[(t < delta) | (t > np.pi - delta)]


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """Where two lines (rho, theta) meet."""
    m = np.array([[np.cos(a[1]), np.sin(a[1])], [np.cos(b[1]), np.sin(b[1])]])
    if abs(np.linalg.det(m)) < 1e-9:
        return None
    x, y = np.linalg.solve(m, [a[0], b[0]])
    return float(x), float(y)


def four_groups(points: np.ndarray, k: int = 4, tries: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of k groups of points: k-means, spread first centres, the best of some tries."""
    rng, best = np.random.default_rng(seed), (np.inf, points[:k])
    for _ in range(tries):
        c = [points[rng.integers(len(points))]]
        while len(c) < k:
            d = np.min([((points - x) ** 2).sum(axis=1) for x in c], axis=0)
            c.append(points[rng.choice(len(points), p=d / d.sum())] if d.sum() else points[rng.integers(len(points))])
        c = np.array(c, float)
        for _ in range(50):
            d = ((points[:, None] - c[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            new = np.array([points[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(axis=1).sum()
        if cost < best[0]:
            best = (cost, c)
    return best[1]


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Top left, bottom left, bottom right, top right."""
    s, d = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]].astype(float)


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The projective map that takes points a to b, by least squares."""
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def mapped(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ h.T
    return p[:, :2] / p[:, 2:]


def straightened(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral (ordered corners) as a rectangle."""
    tl, bl, br, tr = corners
    h = max(1, int(round(max(np.hypot(*(bl - tl)), np.hypot(*(br - tr))))))
    w = max(1, int(round(max(np.hypot(*(tr - tl)), np.hypot(*(br - bl))))))
    back = homography(np.array([[0, 0], [0, h - 1], [w - 1, h - 1], [w - 1, 0]], float), corners)
    y, x = np.mgrid[0:h, 0:w]
    p = np.rint(mapped(back, np.c_[x.ravel(), y.ravel()])).astype(int)
    p[:, 0], p[:, 1] = np.clip(p[:, 0], 0, image.shape[1] - 1), np.clip(p[:, 1], 0, image.shape[0] - 1)
    return image[p[:, 1], p[:, 0]].reshape((h, w) + image.shape[2:])


def page_corners(image: np.ndarray, how: str = "contours") -> np.ndarray | None:
    """The corners of the largest page-like quadrilateral: of a bright region, or of crossing lines; None without one."""
    h, w = image.shape[:2]
    if how == "contours":
        g = blurred(grey(image), 1.0)
        lab, n = labelled(g > (g.min() + g.max()) / 2)
        if not n:
            return None
        sizes = np.bincount(lab.ravel())[1:]
        y, x = np.nonzero(lab == sizes.argmax() + 1)
        quad = ordered_corners(np.c_[x, y])
    elif how == "hough_lines":
        across, up = split_lines(hough_lines(edges(image), votes=max(10, min(h, w) // 4)))
        points = [p for a in across for b in up if (p := meeting(a, b)) and -5 <= p[0] <= w + 5 and -5 <= p[1] <= h + 5]
        if len(points) < 4:
            return None
        quad = ordered_corners(four_groups(np.array(points)))
    else:
        raise ValueError(f"unknown way {how}")
    x, y = quad[:, 0], quad[:, 1]
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    width, height = quad[3, 0] - quad[0, 0], quad[1, 1] - quad[0, 1]
    return quad if 0.1 * h * w < area < 0.98 * h * w and height > 0 and 0.9 < width / height < 3 else None


def cropped(image: np.ndarray, mode: str = "automatic") -> tuple[np.ndarray, bool]:
    """(page, failed): by contours, by lines, or by the first that works; the whole image where none does."""
    for how in ("contours", "hough_lines") if mode == "automatic" else (mode,):
        if (quad := page_corners(image, how)) is not None:
            return straightened(image, quad), False
    return image, True


# pairs of images


def descriptor_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.7) -> np.ndarray:
    """Rows (i, j): the nearest descriptor of b for each of a, where it is clearly nearer than the second."""
    if len(a) == 0 or len(b) < 2:
        return np.zeros((0, 2), int)
    d = np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))
    j = np.argsort(d, axis=1)[:, :2]
    i = np.arange(len(a))
    good = d[i, j[:, 0]] < ratio * d[i, j[:, 1]]
    return np.c_[i[good], j[good, 0]]


def ransac(a: np.ndarray, b: np.ndarray, limit: float = 5.0, tries: int = 200, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(homography, which pairs agree with it)."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    if len(a) < 4:
        return None, best
    for _ in range(tries):
        pick = rng.choice(len(a), 4, replace=False)
        with np.errstate(all="ignore"):
            fit = np.hypot(*(mapped(homography(a[pick], b[pick]), a) - b).T) < limit
        if fit.sum() > best.sum():
            best = fit
    return (homography(a[best], b[best]), best) if best.sum() >= 4 else (None, best)


def camera_move(first: np.ndarray, second: np.ndarray, border: float = 0.1) -> float:
    """Shift between two images' borders in pixels: the peak of their phase correlation."""
    a, b = grey(first), grey(second)
    h, w = a.shape
    inner = (slice(int(h * border), h - int(h * border)), slice(int(w * border), w - int(w * border)))
    a, b = a - a.mean(), b - b.mean()
    a[inner], b[inner] = 0, 0
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-9)).real
    y, x = np.unravel_index(c.argmax(), c.shape)
    return float(np.hypot(min(y, h - y), min(x, w - x)))


def ink_area(image: np.ndarray, limit: float = 0.70) -> int:
    """Pixels in regions that stand out, regions above `limit` of the image left out."""
    lab, n = labelled(edges(image))
    sizes = np.bincount(lab.ravel(), minlength=n + 1)[1:]
    return int(sizes[sizes < limit * lab.size].sum())


def content_added(first: np.ndarray, second: np.ndarray, gamma: float = 0.09) -> tuple[bool, int]:
    """(whether the second has clearly more content, how much more)."""
    a, b = ink_area(first), ink_area(second)
    return a * (1 + gamma) < b, b - a


# boxes


def suppressed(boxes: np.ndarray, scores: np.ndarray, overlap: float = 0.3) -> np.ndarray:
    """Places of the boxes (xmax, ymax, xmin, ymin) that no better-scored kept box covers by more than `overlap`, best first."""
    order, kept = np.argsort(-scores, kind="stable"), []
    area = (boxes[:, 0] - boxes[:, 2]) * (boxes[:, 1] - boxes[:, 3])
    while len(order):
        k, order = order[0], order[1:]
        kept.append(int(k))
        dx = np.minimum(boxes[k, 0], boxes[order, 0]) - np.maximum(boxes[k, 2], boxes[order, 2])
        dy = np.minimum(boxes[k, 1], boxes[order, 1]) - np.maximum(boxes[k, 3], boxes[order, 3])
        order = order[np.maximum(dx, 0) * np.maximum(dy, 0) <= overlap * np.maximum(area[order], 1)]
    return np.array(kept, int)


def figure_boxes(image: np.ndarray, text: np.ndarray | None = None, least_entropy: float = 2.5) -> np.ndarray:
    """Boxes of figures: regions of smoothed edges of a figure's size and shape, little of them text, with some entropy; parts of a larger one dropped."""
    h, w = image.shape[:2]
    ink = np.where(edges(image), 0, 255).astype(np.uint8)
    found = region_boxes(smoothed_both(ink, max(2, w // 40), max(2, h // 40)) == 0)
    out = []
    for xmax, ymax, xmin, ymin in found:
        bw, bh = xmax - xmin, ymax - ymin
        if not ((h // 3) * (w // 6) < bw * bh < 0.60 * h * w and 0.2 < bw / bh < 6):
            continue
        if text is not None and len(text):
            dx = np.minimum(xmax, text[:, 0]) - np.maximum(xmin, text[:, 2])
            dy = np.minimum(ymax, text[:, 1]) - np.maximum(ymin, text[:, 3])
            if (np.maximum(dx, 0) * np.maximum(dy, 0)).sum() >= 0.32 * bw * bh:
                continue
        if entropy(image[ymin:ymax, xmin:xmax]) > least_entropy:
            out.append((xmax, ymax, xmin, ymin))
    out.sort(key=lambda b: -(b[0] - b[2]) * (b[1] - b[3]))
    kept: list[tuple] = []
    for b in out:
        if all(min(b[0], k[0]) <= max(b[2], k[2]) or min(b[1], k[1]) <= max(b[3], k[3]) for k in kept):
            kept.append(b)
    return np.array(kept, int).reshape(-1, 4)


# tables


def decoded(df: DataFrame, key: str, run: Callable[[np.ndarray], dict], schema: str, content: str = "content", decode: Callable[[bytes], np.ndarray] = from_png) -> DataFrame:
    """key and what run gives for each image: one row an image, in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(parts):
        for part in parts:
            rows = [run(decode(bytes(c))) for c in part[content]]
            yield pd.DataFrame({key: part[key], **{n: [r[n] for r in rows] for n in names}})

    return df.select(key, content).mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, {schema}")


def exploded(df: DataFrame, key: str, run: Callable[[np.ndarray], list[dict]], schema: str, content: str = "content", decode: Callable[[bytes], np.ndarray] = from_png) -> DataFrame:
    """The same for functions that give any number of rows: figures of a slide, words of an image."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(parts):
        for part in parts:
            rows = [(k, r) for k, c in zip(part[key], part[content], strict=True) for r in run(decode(bytes(c)))]
            yield pd.DataFrame({key: pd.Series([k for k, _ in rows], dtype=part[key].dtype), **{n: [r[n] for _, r in rows] for n in names}})

    return df.select(key, content).mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, {schema}")


def borders_removed(df: DataFrame, key: str, **options) -> DataFrame:
    """key, status, content: images without their black borders; those of one colour have no content."""

    def run(image: np.ndarray) -> dict:
        out, status = without_border(image)
        return {"status": status, "content": None if out is None else png(np.asarray(out, np.uint8))}

    return decoded(df, key, run, "status string, content binary", **options)


def pages_cropped(df: DataFrame, key: str, mode: str = "automatic", **options) -> DataFrame:
    """key, content, failed."""

    def run(image: np.ndarray) -> dict:
        out, failed = cropped(image, mode)
        return {"content": png(np.asarray(out, np.uint8)), "failed": failed}

    return decoded(df, key, run, "content binary, failed boolean", **options)


def figures(df: DataFrame, key: str, **options) -> DataFrame:
    """key, idx, xmax, ymax, xmin, ymin, kind, content: a row a figure."""

    def run(image: np.ndarray) -> list[dict]:
        return [{"idx": i, "xmax": int(b[0]), "ymax": int(b[1]), "xmin": int(b[2]), "ymin": int(b[3]), "kind": colour_kind(image), "content": png(np.asarray(image[b[3] : b[1], b[2] : b[0]], np.uint8))} for i, b in enumerate(figure_boxes(image))]

    return exploded(df, key, run, "idx int, xmax int, ymax int, xmin int, ymin int, kind string, content binary", **options)


def measured(df: DataFrame, key: str) -> DataFrame:
    """key, all hashes, solid, border, entropy, of grey images given as height, width and pixels."""
    names = list(HASHES)

    def work(parts):
        for part in parts:
            images = [np.array(p, np.uint8).reshape(h, w) for p, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            yield pd.DataFrame({key: part[key], **{n: [HASHES[n](x) for x in images] for n in names}, "solid": [is_solid(x) for x in images], "border": [has_black_border(x) for x in images], "entropy": [round(entropy(x), 6) for x in images]})

    return df.mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{n} string" for n in names) + ", solid boolean, border boolean, entropy double")


def applied(df: DataFrame, key: str, work: Callable[..., tuple], out: str, *pixels: str) -> DataFrame:
    """key and the columns `out` that work gives of each row's grey images: columns of pixels (row by row) of height x width."""
    names = [c.split()[0] for c in out.split(", ")]
    images = pixels or ("pixels",)

    def rows(parts):
        for part in parts:
            shaped = [[np.array(p, np.uint8).reshape(h, w) for p, h, w in zip(part[c], part["height"], part["width"], strict=True)] for c in images]
            yield pd.DataFrame([(k, *work(*x)) for k, *x in zip(part[key], *shaped, strict=True)], columns=[key, *names])

    return df.select(key, "height", "width", *images).mapInPandas(rows, f"`{key}` {dict(df.dtypes)[key]}, {out}")
