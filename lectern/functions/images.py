"""Numbers from gray pictures: small kernels over arrays, and a job that gives each picture's numbers.

A picture is a row (width, pixels): the bytes of its gray values, row by row. Pictures
are measured where Spark has dealt them; what follows from the numbers is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLUR = np.array([1.0, 2.0, 1.0]) / 4


def along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """A short kernel along one axis, edges mirrored without repeating them (constant where a side is too short)."""
    k = len(kernel) // 2
    pad = [(k, k) if a == axis else (0, 0) for a in range(2)]
    wide = np.pad(x, pad, mode="reflect" if x.shape[axis] > k else "edge")
    views = [np.take(wide, np.arange(i, i + x.shape[axis]), axis=axis) for i in range(len(kernel))]
    return sum(c * v for c, v in zip(kernel, views))


def blurred(gray: np.ndarray) -> np.ndarray:
    return along(along(gray.astype(float), BLUR, 0), BLUR, 1)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian."""
    second = np.array([1.0, -2.0, 1.0])
    return float((along(gray.astype(float), second, 0) + along(gray.astype(float), second, 1)).var())


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, smooth, slope = gray.astype(float), np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return along(along(x, slope, 1), smooth, 0), along(along(x, slope, 0), smooth, 1)


def thin(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Strength of the gradient where it is the largest across its edge, else 0: of two equal neighbours the first stays."""
    force = np.abs(gx) + np.abs(gy)
    wide = np.pad(force, 1)
    at = lambda dy, dx: wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx]
    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) < slope * np.abs(gx), np.abs(gx) < slope * np.abs(gy)
    falling = gx * gy > 0
    sides = [(flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & falling, (1, 1)), (~flat & ~steep & ~falling, (1, -1))]
    stays = np.zeros(force.shape, bool)
    for here, (dy, dx) in sides:
        stays |= here & (force > at(-dy, -dx)) & (force >= at(dy, dx))
    return np.where(stays, force, 0.0)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, region) of the unbroken stretches of set pixels, line by line: region is the first stretch, by number, of those that touch by side or corner.

    Stretches of neighbouring lines meet by binary search; union-find goes over all meetings at once.
    """
    h, w = mask.shape
    turns = np.diff(np.pad(mask, ((0, 0), (1, 1))).ravel().astype(np.int8))
    # one column before and one behind each line, so that no stretch goes around a line's end
    begin, end = np.flatnonzero(turns == 1) + 1, np.flatnonzero(turns == -1)
    low, high = np.searchsorted(end, begin + (w + 2) - 1), np.searchsorted(begin, end + (w + 2) + 1, side="right")
    n = high - low
    a = np.repeat(np.arange(len(begin)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(begin))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # the larger root of each pair that is still apart points to the smallest one that it meets
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return begin // (w + 2), begin % (w + 2) - 1, end % (w + 2) - 1, root


def regions(mask: np.ndarray) -> np.ndarray:
    """The number of each set pixel's region (the smallest place in it; -1 outside): pixels that touch by side or corner."""
    y, x0, x1, root = runs(mask)
    out = np.full(mask.shape, -1)
    out[mask] = np.repeat((y * mask.shape[1] + x0)[root], x1 - x0 + 1)
    return out


def edges(gray: np.ndarray, low: float = 60.0, high: float = 160.0) -> np.ndarray:
    """Thin edges: regions of pixels above `low` that have one above `high`."""
    force = thin(*gradients(gray))
    region = regions(force > low)
    strong = np.unique(region[force > high])
    return (region >= 0) & np.isin(region, strong)


def edge_density(gray: np.ndarray, threshold: float = 140.0) -> float:
    """Share of pixels with a strong gradient, whether their edge is thin or not."""
    gx, gy = gradients(gray)
    return float((np.abs(gx) + np.abs(gy) > threshold).mean())


def entropy(gray: np.ndarray) -> float:
    p = np.bincount(np.clip(gray, 0, 255).astype(int).ravel(), minlength=256) / max(gray.size, 1)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def best_threshold(values: np.ndarray) -> int:
    """The gray value that parts a histogram into the two classes furthest apart."""
    n = np.bincount(values.ravel().astype(int), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(below * above > 0, apart, -1.0)))


def running(x: np.ndarray, size: int, axis: int, pick: np.ufunc) -> np.ndarray:
    """The largest (np.maximum) or smallest (np.minimum) value of the window of `size` around each place, in linear time.

    Blocks as long as the window are gone through from both ends; any window is the end of one block and the beginning of the next.
    """
    x = np.moveaxis(x.astype(float), axis, -1)
    n, none = x.shape[-1], -np.inf if pick is np.maximum else np.inf
    before = size // 2
    total = -(-(n + size - 1) // size) * size
    wide = np.full((*x.shape[:-1], total), none)
    wide[..., before : before + n] = x
    blocks = wide.reshape(*x.shape[:-1], -1, size)
    onward = pick.accumulate(blocks, axis=-1).reshape(wide.shape)
    back = pick.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(wide.shape)
    return np.moveaxis(pick(back[..., :n], onward[..., size - 1 : size - 1 + n]), -1, axis)


def dilated(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return running(running(x, width, 1, np.maximum), height, 0, np.maximum)


def eroded(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return running(running(x, width, 1, np.minimum), height, 0, np.minimum)


def closed(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return eroded(dilated(x, height, width), height, width)


def textness(gray: np.ndarray, height: int = 5, width: int = 15) -> float:
    """Share of pixels in text: dark strokes narrower than the window, by their horizontal change, closed up to words, specks left out."""
    gray = gray.astype(float)
    g = np.abs(gradients(closed(gray, height, width) - gray)[0])
    scaled = (255 * (g / (g.max() + 1e-9))).astype(int)
    words = closed(scaled > best_threshold(scaled), height, width)
    return float((dilated(eroded(words, 3, 3), 3, 3) > 0).mean())


def box_means(x: np.ndarray, size: int) -> np.ndarray:
    total = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def likeness(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity over all windows of two pictures of one shape."""
    a, b = a.astype(float), b.astype(float)
    size = min(size, *a.shape)
    n = size**2
    ma, mb = box_means(a, size), box_means(b, size)
    scale = n / max(n - 1, 1)
    va, vb, cov = scale * (box_means(a * a, size) - ma * ma), scale * (box_means(b * b, size) - mb * mb), scale * (box_means(a * b, size) - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        w = np.maximum(high - low, 0)
        return w / w.sum(1, keepdims=True)

    return weights(gray.shape[0], height) @ gray.astype(float) @ weights(gray.shape[1], width).T


def cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual_hash(gray: np.ndarray) -> str:
    """Sixteen hexadecimal digits: which of the 64 lowest frequencies of a 32 x 32 picture are above their median."""
    basis = cosine_basis(32)[:8]
    low = basis @ resized(gray, 32, 32) @ basis.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if v else '0' for v in bits), 2):016x}"


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(dx, dy, response): how far b's content is moved against a's, by the peak of their phase correlation."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.fft.ifft2(f / (np.abs(f) + 1e-12)).real
    y, x = np.unravel_index(int(peak.argmax()), peak.shape)
    h, w = peak.shape
    return int((w - x) % w if (w - x) % w <= w // 2 else (w - x) % w - w), int((h - y) % h if (h - y) % h <= h // 2 else (h - y) % h - h), float(peak.max())


def overlap(a: np.ndarray, b: np.ndarray, dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
    """What both pictures show once b's shift is taken back."""
    h, w = a.shape
    ys, xs = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
    yb, xb = slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx))
    return a[ys, xs], b[yb, xb]


def ink(gray: np.ndarray, threshold: int = 235) -> np.ndarray:
    """Where something is written: dark pixels with a dark neighbour, and what is next to them."""
    dark = gray < threshold
    count = box_means(np.pad(dark.astype(float), 1), 3) * 9
    kept = dark & (count >= 2)
    return box_means(np.pad(kept.astype(float), 1), 3) > 1e-9


def cropped(gray: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """A region; the whole picture where less than six pixels of a side are left."""
    h, w = gray.shape
    x1, y1, x2, y2 = max(0, min(w - 1, x1)), max(0, min(h - 1, y1)), max(1, min(w, x2)), max(1, min(h, y2))
    return gray[y1:y2, x1:x2] if x2 > x1 + 5 and y2 > y1 + 5 else gray


def straightened(gray: np.ndarray, quad: np.ndarray, height: int, width: int) -> np.ndarray:
    """The quad (top left, top right, bottom right, bottom left) as a rectangle, by the projective map of its corners, nearest pixels."""
    goal = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows = []
    for (u, v), (x, y) in zip(goal, np.asarray(quad, float)):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
    m = np.append(np.linalg.solve(np.array(rows), np.asarray(quad, float).ravel()), 1).reshape(3, 3)
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]), 1)
    h, w = gray.shape
    return gray[np.clip(np.round(y / z), 0, h - 1).astype(int), np.clip(np.round(x / z), 0, w - 1).astype(int)]


def pixels(width: int, data: bytes) -> np.ndarray:
    """The picture of these bytes; a last row that isn't full is filled with zeros."""
    x = np.frombuffer(data, np.uint8)
    height = max(1, -(-len(x) // width))
    return np.pad(x, (0, height * width - len(x))).reshape(height, width)


def picture_metrics(pictures: DataFrame, key: str) -> DataFrame:
    """(key, sharp, edge, text, entropy, phash) of pictures (key, width, pixels), blurred a little first."""

    def run(parts):
        for pdf in parts:
            rows = []
            for k, w, data in zip(pdf[key], pdf["width"], pdf["pixels"]):
                g = blurred(pixels(int(w), bytes(data)))
                rows.append((k, sharpness(g), float(edges(g).mean()), textness(g), entropy(g), perceptual_hash(g)))
            yield pd.DataFrame(rows, columns=[key, "sharp", "edge", "text", "entropy", "phash"])

    return pictures.select(key, "width", "pixels").mapInPandas(run, f"{key} long, sharp double, edge double, text double, entropy double, phash string")


def away_from(mask: np.ndarray) -> np.ndarray:
    """Each pixel's distance to the nearest set one (infinite without any): first along its column, then over columns further and further off while they can be nearer."""
    if not mask.any():
        return np.full(mask.shape, np.inf)
    rows = np.arange(mask.shape[0], dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -np.inf), 0)
    below = np.minimum.accumulate(np.where(mask, rows, np.inf)[::-1], 0)[::-1]
    column = np.minimum(rows - above, below - rows) ** 2
    out = column.copy()
    for step in range(1, mask.shape[1]):
        if step * step >= out.max():
            break
        np.minimum(out[:, step:], column[:, :-step] + step * step, out=out[:, step:])
        np.minimum(out[:, :-step], column[:, step:] + step * step, out=out[:, :-step])
    return np.sqrt(out)


def box_variances(gray: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Variance of the gray values in each box, borders included, from running sums: linear in pixels and boxes."""
    total = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g = gray.astype(np.int64)
    within = lambda s: s[y1 + 1, x1 + 1] - s[y0, x1 + 1] - s[y1 + 1, x0] + s[y0, x0]
    n = (x1 - x0 + 1) * (y1 - y0 + 1)
    return (within(total(g * g)) - within(total(g)) ** 2 / n) / n


def support(distances: np.ndarray, quad: np.ndarray, samples: int = 120, share: float = 0.7) -> list[float]:
    """Of each side of a quad: how far its nearest points are from an edge, in the mean over the best `share` of the samples."""
    h, w = distances.shape
    out = []
    for p, q in zip(quad, np.roll(quad, -1, 0)):
        at = p + np.linspace(0.0, 1.0, samples)[:, None] * (q - p)
        x, y = np.clip(np.round(at[:, 0]), 0, w - 1).astype(int), np.clip(np.round(at[:, 1]), 0, h - 1).astype(int)
        out.append(float(np.sort(distances[y, x])[: max(1, int(samples * share))].mean()))
    return out
