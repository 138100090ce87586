"""Image kernels over NumPy arrays; images are two-dimensional uint8 unless said otherwise.

Only public descriptions of the methods were followed. Results agree with common libraries in kind, not bit by bit.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from pairgraph.plans.config import FeatureConfig, MatchConfig, StructuralConfig

# --- files -----------------------------------------------------------------------------------------------------


def orientation_of(content: bytes) -> int:
    """The EXIF orientation (1 to 8) of a JPEG file; 1 where it says none."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                first = struct.unpack_from(order + "I", tiff, 4)[0]
                for i in range(struct.unpack_from(order + "H", tiff, first)[0]):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * i)
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        if kind == 0xDA:
            break
        at += 2 + size
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    if orientation in (2, 4):
        image = image[:, ::-1] if orientation == 2 else image[::-1]
    elif orientation == 3:
        image = image[::-1, ::-1]
    elif orientation in (5, 6, 7, 8):
        turned = image.T
        image = {5: turned, 6: turned[:, ::-1], 7: turned[::-1, ::-1], 8: turned[::-1]}[orientation]
    return np.ascontiguousarray(image)


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray levels of rows of B, G, R (and A) bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0].copy()
    b, g, r = (pixels[:, :, i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def png_bytes(image: np.ndarray) -> bytes:
    """A gray or RGB image as PNG; equal pixels give equal bytes."""
    height, width = image.shape[:2]
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


# --- resampling and filters ------------------------------------------------------------------------------------


def _area_weights(n: int, m: int) -> np.ndarray:
    """m x n weights by which each of m cells averages the stretch of n samples that it covers."""
    edges = np.arange(m + 1) * (n / m)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None, :]
    w = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def _linear_weights(n: int, m: int) -> np.ndarray:
    """m x n weights of linear interpolation between sample centres."""
    x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(x).astype(int)
    high = np.minimum(low + 1, n - 1)
    w = np.zeros((m, n))
    w[np.arange(m), low] += 1 - (x - low)
    w[np.arange(m), high] += x - low
    return w


def resize(image: np.ndarray, height: int, width: int, *, area: bool = True) -> np.ndarray:
    """Resized in floats: cell averages or linear interpolation."""
    weights = _area_weights if area else _linear_weights
    return weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T


def to_levels(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def shrink(image: np.ndarray, longest: int) -> np.ndarray:
    """Down to the longest side, never up; sides round half to even."""
    height, width = image.shape
    scale = longest / max(height, width)
    if scale >= 1:
        return image
    return to_levels(resize(image, max(1, round(height * scale)), max(1, round(width * scale))))


def gaussian(sigma: float) -> np.ndarray:
    x = np.arange(-max(1, int(np.ceil(4 * sigma))), max(1, int(np.ceil(4 * sigma))) + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def convolve(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis, the border mirrored without repeating it."""
    r = len(kernel) // 2
    n = image.shape[axis]
    at = np.arange(-r, n + r)
    if n > 1:
        at = np.abs((at + (n - 1)) % (2 * (n - 1)) - (n - 1))
    else:
        at = np.zeros_like(at)
    padded = np.take(image, at, axis=axis)
    out = np.zeros(image.shape, np.float64)
    for i, k in enumerate(kernel):
        out += k * (padded[i : i + n] if axis == 0 else padded[:, i : i + n])
    return out


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian(sigma)
    return convolve(convolve(image, k, 0), k, 1)


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical derivative with the three-tap smoothing of Sobel."""
    d, s = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    return convolve(convolve(image, d, 1), s, 0), convolve(convolve(image, d, 0), s, 1)


# --- exposure --------------------------------------------------------------------------------------------------


def stretch(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Levels between two percentiles spread over 0..255; a flat image comes back as a copy."""
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must ascend within 0..100")
    a, b = np.percentile(image, [low, high])
    if b - a <= 1e-12:
        return image.copy()
    return np.rint(np.clip((image - a) / (b - a), 0, 1) * 255).astype(np.uint8)


def equalized(image: np.ndarray) -> np.ndarray:
    """Levels mapped through the cumulative histogram."""
    counts = np.bincount(image.ravel(), minlength=256)
    total = np.cumsum(counts)
    first = total[np.flatnonzero(counts)[0]]
    if total[-1] == first:
        return image.copy()
    return to_levels((total - first) / (total[-1] - first) * 255)[image]


def normal_exposure(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Stretched and equalized, in 0..1; zeros where the percentiles meet."""
    a, b = np.percentile(image, [low, high])
    if b - a <= 1e-8:
        return np.zeros(image.shape)
    return equalized(np.rint(np.clip((image - a) / (b - a), 0, 1) * 255).astype(np.uint8)) / 255.0


def clahe(image: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Histogram equalization in grid x grid tiles with clipped counts, interpolated between tile centres."""
    height, width = image.shape
    th, tw = -(-height // grid), -(-width // grid)
    padded = np.pad(image, ((0, th * grid - height), (0, tw * grid - width)), mode="reflect" if min(image.shape) > max(th * grid - height, tw * grid - width) else "edge")
    tables = np.empty((grid, grid, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.clip(counts - limit, 0, None).sum()
            counts = np.minimum(counts, limit) + over // 256
            counts[: over % 256] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(counts) * 255.0 / (th * tw)), 0, 255)
    y = (np.arange(height) + 0.5) / th - 0.5
    x = (np.arange(width) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    clip_ = lambda v: np.clip(v, 0, grid - 1)
    look = lambda a, b: tables[clip_(a)[:, None], clip_(b)[None, :], image]
    top = look(y0, x0) * (1 - fx) + look(y0, x0 + 1) * fx
    low = look(y0 + 1, x0) * (1 - fx) + look(y0 + 1, x0 + 1) * fx
    return to_levels(top * (1 - fy) + low * fy)


def exposure_stats(image: np.ndarray) -> dict[str, float]:
    """Shares of clipped levels, median level, and the variance of the Laplacian at 256 pixels at most."""
    small = shrink(image, 256).astype(np.float64)
    k = np.array([1.0, -2.0, 1.0])
    laplacian = convolve(small, k, 0) + convolve(small, k, 1)
    return {
        "dark": float((image <= 2).mean()),
        "bright": float((image >= 253).mean()),
        "luminance": float(np.median(image)),
        "sharpness": float(laplacian.var()),
    }


def difference_hash(image: np.ndarray) -> str:
    """64 bits of whether a cell of an 8 x 9 reduction is darker than the next, as 16 hex digits."""
    small = to_levels(resize(image, 8, 9)).astype(int)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


# --- global descriptor -----------------------------------------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return np.zeros_like(v) if n <= 1e-8 else v / n


def structural_descriptor(image: np.ndarray, c: StructuralConfig) -> np.ndarray:
    """Pooled luminance and pooled gradient orientations of a small equalized copy, float32 of unit length."""
    side, grid, bins = c.descriptor_image_size, c.descriptor_grid_size, c.gradient_orientation_bins
    small = to_levels(resize(image, side, side, area=max(image.shape) > side))
    flat = normal_exposure(small, c.exposure_low_percentile, c.exposure_high_percentile)
    light = resize(blur(flat, c.spatial_pooling_sigma), grid, grid)
    light = unit((light - light.mean()).ravel())
    gx, gy = gradients(flat)
    strength = np.hypot(gx, gy)
    angle = (np.degrees(np.arctan2(gy, gx)) % 180) / (180 / bins)
    pooled = []
    for b in range(bins):
        away = np.abs(angle - b)
        weight = np.clip(1 - np.minimum(away, bins - away), 0, None)
        pooled.append(resize(blur(strength * weight, c.spatial_pooling_sigma), grid, grid).ravel())
    edges = unit(np.concatenate(pooled))
    both = np.concatenate([np.sqrt(c.luminance_feature_weight) * light, np.sqrt(c.gradient_feature_weight) * edges])
    return unit(both).astype(np.float32)


# --- local features --------------------------------------------------------------------------------------------


@dataclass
class Features:
    width: int
    height: int
    points: np.ndarray  # float32, n x 2
    descriptors: np.ndarray  # float32, n x 128, square roots of L1 shares
    normalized: np.ndarray  # uint8
    quality: float


_LEVELS = 3  # scales in an octave


def _scale_space(image: np.ndarray, sigma: float) -> list[np.ndarray]:
    base = resize(image, image.shape[0] * 2, image.shape[1] * 2, area=False) / 255.0
    base = blur(base, max(0.01, np.sqrt(max(sigma**2 - 1.0, 0.01))))
    octaves = []
    steps = sigma * 2 ** (np.arange(_LEVELS + 3) / _LEVELS)
    while min(base.shape) >= 16:
        levels = [base]
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            levels.append(blur(levels[-1], np.sqrt(b * b - a * a)))
        octaves.append(np.stack(levels))
        base = levels[_LEVELS][::2, ::2]
    return octaves


def _extrema(dog: np.ndarray, contrast: float, edge: float) -> np.ndarray:
    """Refined extrema of a stack of differences as rows level, y, x, response."""
    core = dog[1:-1, 1:-1, 1:-1]
    strong = np.abs(core) > 0.5 * contrast / _LEVELS
    high, low = strong & (core > 0), strong & (core < 0)
    for dl in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dl, dy, dx) != (1, 1, 1):
                    other = dog[dl : dl + core.shape[0], dy : dy + core.shape[1], dx : dx + core.shape[2]]
                    high &= core >= other
                    low &= core <= other
    l, y, x = (v + 1 for v in np.nonzero(high | low))
    if not len(l):
        return np.empty((0, 4))
    at = lambda a, b, c: dog[l + a, y + b, x + c]
    v = at(0, 0, 0)
    grad = np.stack([at(1, 0, 0) - at(-1, 0, 0), at(0, 1, 0) - at(0, -1, 0), at(0, 0, 1) - at(0, 0, -1)], -1) / 2
    hess = np.empty((len(l), 3, 3))
    hess[:, 0, 0] = at(1, 0, 0) + at(-1, 0, 0) - 2 * v
    hess[:, 1, 1] = at(0, 1, 0) + at(0, -1, 0) - 2 * v
    hess[:, 2, 2] = at(0, 0, 1) + at(0, 0, -1) - 2 * v
    for i, j, a, b in ((0, 1, (1, 0, 0), (0, 1, 0)), (0, 2, (1, 0, 0), (0, 0, 1)), (1, 2, (0, 1, 0), (0, 0, 1))):
        plus, minus = np.add(a, b), np.subtract(a, b)
        hess[:, i, j] = hess[:, j, i] = (at(*plus) + at(*-plus) - at(*minus) - at(*-minus)) / 4
    whole = np.abs(np.linalg.det(hess)) > 1e-18
    shift = np.zeros_like(grad)
    shift[whole] = -np.linalg.solve(hess[whole], grad[whole][:, :, None])[:, :, 0]
    response = v + 0.5 * (grad * shift).sum(axis=1)
    trace = hess[:, 1, 1] + hess[:, 2, 2]
    det = hess[:, 1, 1] * hess[:, 2, 2] - hess[:, 1, 2] ** 2
    good = (np.abs(shift).max(axis=1) < 1.0) & (np.abs(response) * _LEVELS >= contrast) & (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det)
    return np.column_stack([l + shift[:, 0], y + shift[:, 1], x + shift[:, 2], np.abs(response)])[good]


def _sampled(level: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient strength and angle at rounded places, and whether they lie inside."""
    yi, xi = np.rint(y).astype(int), np.rint(x).astype(int)
    inside = (yi > 0) & (yi < level.shape[0] - 1) & (xi > 0) & (xi < level.shape[1] - 1)
    yi, xi = np.clip(yi, 1, level.shape[0] - 2), np.clip(xi, 1, level.shape[1] - 2)
    gx, gy = level[yi, xi + 1] - level[yi, xi - 1], level[yi + 1, xi] - level[yi - 1, xi]
    return np.hypot(gx, gy), np.arctan2(gy, gx), inside


def _orientations(level: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """The main gradient angles around a place, from a smoothed histogram of 36 bins."""
    r = int(round(4.5 * sigma))
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    strength, angle, inside = _sampled(level, y + dy, x + dx)
    weight = strength * inside * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount((np.rint(angle / (2 * np.pi) * 36).astype(int) % 36).ravel(), weight.ravel(), minlength=36)
    hist = (6 * hist + 4 * (np.roll(hist, 1) + np.roll(hist, -1)) + np.roll(hist, 2) + np.roll(hist, -2)) / 16
    out = []
    for b in np.flatnonzero((hist > np.roll(hist, 1)) & (hist > np.roll(hist, -1)) & (hist >= 0.8 * hist.max())):
        a, m, c = hist[b - 1], hist[b], hist[(b + 1) % 36]
        out.append((b + 0.5 * (a - c) / (a - 2 * m + c)) / 36 * 2 * np.pi)
    return out


def _describe(level: np.ndarray, y: float, x: float, sigma: float, angle: float) -> np.ndarray:
    """128 values: 4 x 4 cells of 8 gradient directions, turned by the angle, linearly shared between bins."""
    cell = 3 * sigma
    r = int(round(min(cell * np.sqrt(2) * 2.5, np.hypot(*level.shape))))
    dy, dx = (v.ravel() for v in np.mgrid[-r : r + 1, -r : r + 1])
    cos, sin = np.cos(angle), np.sin(angle)
    u, v = (cos * dx + sin * dy) / cell + 1.5, (-sin * dx + cos * dy) / cell + 1.5
    near = (u > -1) & (u < 4) & (v > -1) & (v < 4)
    u, v = u[near], v[near]
    strength, theta, inside = _sampled(level, y + dy[near], x + dx[near])
    weight = strength * inside * np.exp(-((u - 1.5) ** 2 + (v - 1.5) ** 2) / 8)
    o = ((theta - angle) / (2 * np.pi) * 8) % 8
    hist = np.zeros((6, 6, 8))
    u0, v0, o0 = np.floor(u).astype(int), np.floor(v).astype(int), np.floor(o).astype(int)
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                share = np.abs(1 - a - (u - u0)) * np.abs(1 - b - (v - v0)) * np.abs(1 - c - (o - o0))
                np.add.at(hist, (v0 + b + 1, u0 + a + 1, (o0 + c) % 8), weight * share)
    d = hist[1:5, 1:5].ravel()
    d = np.minimum(d, 0.2 * np.linalg.norm(d))
    return d


def scale_invariant_features(image: np.ndarray, c: FeatureConfig) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y) and descriptors of the strongest blobs, at most max_features."""
    found = []
    stacks = _scale_space(image, c.sigma)
    for octave, stack in enumerate(stacks):
        dog = np.diff(stack, axis=0)
        for l, y, x, response in _extrema(dog, c.contrast_threshold, c.edge_threshold):
            found.append((response, octave, l, y, x))
    found.sort(key=lambda f: (-f[0], *f[1:]))
    points, descs = [], []
    for _, octave, l, y, x in found:
        level = stacks[octave][int(np.clip(round(l), 1, _LEVELS))]
        sigma = c.sigma * 2 ** (l / _LEVELS)
        for angle in _orientations(level, y, x, sigma):
            points.append((x * 2.0 ** (octave - 1), y * 2.0 ** (octave - 1)))
            descs.append(_describe(level, y, x, sigma, angle))
            if len(points) == c.max_features:
                return np.array(points, np.float32), np.array(descs, np.float32)
    return np.array(points, np.float32).reshape(-1, 2), np.array(descs, np.float32).reshape(-1, 128)


def extract_features(image: np.ndarray, c: FeatureConfig, percentiles: tuple[float, float] | None = None) -> Features:
    """Shrunk, stretched if asked for, equalized in tiles; then local features and the image's quality."""
    small = shrink(image, c.max_dimension)
    if percentiles:
        small = stretch(small, *percentiles)
    normal = clahe(small, c.clahe_clip_limit, c.clahe_grid_size)
    points, d = scale_invariant_features(normal, c)
    d = np.sqrt(np.clip(d, 0, None) / np.maximum(np.abs(d).sum(axis=1, keepdims=True), 1e-12)).astype(np.float32)
    quality = len(points) + min(1.0, float(normal.std()) / 64)
    return Features(normal.shape[1], normal.shape[0], points, d, normal, quality)


# --- evidence of a pair ----------------------------------------------------------------------------------------


def ratio_matches(query: np.ndarray, train: np.ndarray, ratio: float) -> dict[int, int]:
    """{query row: train row} where the nearest is under ratio times the second nearest."""
    if not len(query) or len(train) < 2:
        return {}
    q, t = query.astype(np.float64), train.astype(np.float64)
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2 * q @ t.T, 0))
    near = np.argpartition(d, 1, axis=1)[:, :2]
    rows = np.arange(len(q))
    a, b = d[rows, near[:, 0]], d[rows, near[:, 1]]
    first = np.where(a <= b, near[:, 0], near[:, 1])
    return {int(i): int(first[i]) for i in np.flatnonzero(np.minimum(a, b) < ratio * np.maximum(a, b))}


def fit_similarity(s: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """The 2 x 3 similarity of least squares that takes s to t."""
    ms, mt = s.mean(axis=0), t.mean(axis=0)
    p, q = s - ms, t - mt
    den = float((p * p).sum())
    if den < 1e-9:
        return None
    a, b = float((p * q).sum()) / den, float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum()) / den
    if a * a + b * b < 1e-12:
        return None
    turn = np.array([[a, -b], [b, a]])
    return np.column_stack([turn, mt - turn @ ms])


def apply(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:, :2].T + m[:, 2]


def inverse(m: np.ndarray) -> np.ndarray:
    back = np.linalg.inv(m[:, :2])
    return np.column_stack([back, -back @ m[:, 2]])


#: Pairs of matches that are tried at once.
RANSAC_DRAWS = 64


def robust_similarity(s: np.ndarray, t: np.ndarray, c: MatchConfig, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The similarity that most matches agree with, refitted on these, and which they are."""
    rng, n = np.random.default_rng(seed), len(s)
    p, q = s[:, 0] + 1j * s[:, 1], t[:, 0] + 1j * t[:, 1]  # a similarity is one product and one sum of complex numbers
    best, most, rounds, at = np.zeros(n, bool), 0, c.ransac_max_iters, 0
    while at < rounds:
        i, j = rng.integers(0, n, RANSAC_DRAWS), rng.integers(0, n - 1, RANSAC_DRAWS)
        j += j >= i
        step = p[j] - p[i]
        fits = np.abs(step) ** 2 >= 2e-9
        turn = (q[j] - q[i]) / np.where(fits, step, 1)
        fits &= np.abs(turn) ** 2 >= 1e-12
        inside = (np.abs(turn[:, None] * p[None, :] + (q[i] - turn * p[i])[:, None] - q[None, :]) <= c.ransac_reproj_threshold) & fits[:, None]
        for k, size in enumerate(inside.sum(axis=1)):
            at += 1
            if size > most:
                best, most = inside[k], size
                miss = 1 - (most / n) ** 2
                rounds = min(rounds, at if miss <= 0 else int(np.ceil(np.log(1 - c.ransac_confidence) / np.log(miss))))
            if at >= rounds:
                break
    if best.sum() < 2:
        return None, best
    m = None
    for _ in range(10):
        m = fit_similarity(s[best], t[best])
        if m is None:
            return None, best
        inside = np.linalg.norm(apply(m, s) - t, axis=1) <= c.ransac_reproj_threshold
        if inside.sum() < 2 or (inside == best).all():
            break
        best = inside
    return m, best


def grid_coverage(p: np.ndarray, width: int, height: int, grid: int) -> float:
    cells = np.minimum((p / [width, height] * grid).astype(int), grid - 1)
    return len(np.unique(cells, axis=0)) / grid**2


def hull_coverage(p: np.ndarray, width: int, height: int) -> float:
    """Area of the convex hull as a share of the image; none under three points."""
    if len(p) < 3:
        return 0.0
    order = np.unique(p.astype(np.float64), axis=0)

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(order) + half(order[::-1]))
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2 / (width * height))


def warp(image: np.ndarray, m: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The image moved by m, linearly sampled, and where it has pixels."""
    y, x = np.mgrid[0:height, 0:width]
    p = apply(inverse(m), np.column_stack([x.ravel(), y.ravel()]).astype(np.float64))
    px, py = p[:, 0].reshape(height, width), p[:, 1].reshape(height, width)
    inside = (px >= 0) & (px <= image.shape[1] - 1) & (py >= 0) & (py <= image.shape[0] - 1)
    px, py = np.clip(px, 0, image.shape[1] - 1), np.clip(py, 0, image.shape[0] - 1)
    x0, y0 = np.minimum(px.astype(int), max(image.shape[1] - 2, 0)), np.minimum(py.astype(int), max(image.shape[0] - 2, 0))
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = px - x0, py - y0
    f = image.astype(np.float64)
    return (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy, inside


def gradient_correlation(left: np.ndarray, right: np.ndarray, m: np.ndarray, longest: int) -> float | None:
    """Correlation of edge strength where the moved left thumbnail covers the right one; null if that tells nothing."""
    a, b = shrink(left, longest), shrink(right, longest)
    sa, sb = np.array([a.shape[1] / left.shape[1], a.shape[0] / left.shape[0]]), np.array([b.shape[1] / right.shape[1], b.shape[0] / right.shape[0]])
    scaled = np.column_stack([np.diag(sb) @ m[:, :2] @ np.diag(1 / sa), sb * m[:, 2]])
    if abs(np.linalg.det(scaled[:, :2])) < 1e-12:
        return None
    moved, inside = warp(a, scaled, *b.shape)
    if inside.sum() < 64:
        return None
    ga, gb = (np.hypot(*gradients(v))[inside] for v in (moved, b.astype(np.float64)))
    ga, gb = ga - ga.mean(), gb - gb.mean()
    den = np.sqrt((ga**2).sum() * (gb**2).sum())
    return None if den <= 1e-12 else float(np.clip((ga * gb).sum() / den, -1, 1))


def pair_evidence(left: Features, right: Features, c: MatchConfig, seed: int) -> dict:
    """The measured fields of a pair; null where no model was found."""
    forward, back = ratio_matches(left.descriptors, right.descriptors, c.ratio_test), ratio_matches(right.descriptors, left.descriptors, c.ratio_test)
    mutual = [(i, j) for i, j in sorted(forward.items()) if back.get(j) == i]
    out = {
        "left_keypoints": len(left.points), "right_keypoints": len(right.points), "forward_ratio_matches": len(forward),
        "reverse_ratio_matches": len(back), "mutual_matches": len(mutual), "model_found": False, "inliers": 0, "inlier_ratio": 0.0,
        "median_transfer_error": None, "grid_coverage_left": 0.0, "grid_coverage_right": 0.0, "hull_coverage_left": 0.0,
        "hull_coverage_right": 0.0, "coverage_min": 0.0, "scale": None, "rotation_degrees": None, "translation_fraction": None,
        "structural_correlation": None, "transform": None,
    }
    if len(mutual) < c.min_matches_for_model:
        return out
    s, t = left.points[[i for i, _ in mutual]].astype(np.float64), right.points[[j for _, j in mutual]].astype(np.float64)
    m, inside = robust_similarity(s, t, c, seed)
    if m is None or not inside.any():
        return out
    p, q = s[inside], t[inside]
    error = (np.linalg.norm(apply(m, p) - q, axis=1) + np.linalg.norm(apply(inverse(m), q) - p, axis=1)) / 2
    g = c.coverage_grid_size
    grids = grid_coverage(p, left.width, left.height, g), grid_coverage(q, right.width, right.height, g)
    hulls = hull_coverage(p, left.width, left.height), hull_coverage(q, right.width, right.height)
    return out | {
        "model_found": True,
        "inliers": int(inside.sum()),
        "inlier_ratio": float(inside.sum() / len(mutual)),
        "median_transfer_error": float(np.median(error)),
        "grid_coverage_left": grids[0],
        "grid_coverage_right": grids[1],
        "hull_coverage_left": hulls[0],
        "hull_coverage_right": hulls[1],
        "coverage_min": min(max(grids[0], hulls[0]), max(grids[1], hulls[1])),
        "scale": float(np.hypot(m[0, 0], m[1, 0])),
        "rotation_degrees": float(np.degrees(np.arctan2(m[1, 0], m[0, 0]))),
        "translation_fraction": float(np.hypot(m[0, 2] / right.width, m[1, 2] / right.height)),
        "structural_correlation": gradient_correlation(left.normalized, right.normalized, m, c.structural_thumbnail_size),
        "transform": m.tolist(),
    }
