"""numpy kernels over batches of patches, (N, s, s, 3) arrays of float64 in [0, 1].

Every kernel works on a whole Arrow batch at once; none loops over patches
except where a row's own control flow demands it (persistence).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

GRAY = np.array([0.299, 0.587, 0.114])
BINS = 8
_RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
ZERNIKE_ORDER = {3: 4, 4: 5, 5: 6, 6: 8}


def windows(image: np.ndarray, size: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All ``size`` x ``size`` windows of (H, W, 3) in row-major order, and their (x, y)."""
    h, w = image.shape[:2]
    if h < size or w < size:
        return np.zeros((0, size, size, 3)), np.zeros((0, 2), np.int32)
    view = np.lib.stride_tricks.sliding_window_view(image, (size, size), axis=(0, 1))[::stride, ::stride]
    ny, nx = view.shape[:2]
    patches = np.moveaxis(view, 2, -1).reshape(ny * nx, size, size, 3)
    y, x = np.divmod(np.arange(ny * nx), nx)
    return patches, np.stack([x * stride, y * stride], axis=1).astype(np.int32)


def gray(patches: np.ndarray) -> np.ndarray:
    """Luminance, added up channel by channel, so that equal pixels are equal in any batch."""
    return patches[..., 0] * GRAY[0] + patches[..., 1] * GRAY[1] + patches[..., 2] * GRAY[2]


def unit(rows: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Rows of norm 1; rows of a norm below ``floor`` become the uniform vector."""
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    flat = norm < floor
    if not flat.any():
        return rows / norm
    return np.where(flat, 1 / math.sqrt(max(rows.shape[1], 1)), rows / np.where(flat, 1.0, norm))


def entropy(patches: np.ndarray) -> np.ndarray:
    """Entropy in bits of the 8-bin histogram of gray values; values outside [0, 1] count nowhere."""
    g = gray(patches).reshape(len(patches), -1)
    cell = np.minimum(np.floor(g * BINS), BINS - 1)
    inside = (g >= 0) & (g <= 1)
    p = np.stack([((cell == k) & inside).sum(axis=1) for k in range(BINS)], axis=1).astype(np.float64)
    p /= p.sum(axis=1, keepdims=True) + 1e-10
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)


def difference(patches: np.ndarray) -> np.ndarray:
    flat = patches.reshape(len(patches), -1, 3)
    return unit((flat - flat.mean(axis=1, keepdims=True)).reshape(len(patches), -1))


def chromaticity(patches: np.ndarray) -> np.ndarray:
    flat = patches.reshape(len(patches), -1, 3)
    ratio = flat / np.maximum(flat[..., :1] + flat[..., 1:2] + flat[..., 2:], 0.03)
    return unit((ratio - ratio.mean(axis=1, keepdims=True)).reshape(len(patches), -1))


def binary_pattern(patches: np.ndarray) -> np.ndarray:
    """For each inner pixel, which of its 8 neighbours (clockwise from top left) are not darker."""
    g = gray(patches)
    n, s = g.shape[0], g.shape[1]
    if s < 3:
        return unit(np.ones((n, 8)))
    inner = g[:, 1:-1, 1:-1]
    ring = [g[:, 1 + dy : s - 1 + dy, 1 + dx : s - 1 + dx] >= inner for dy, dx in _RING]
    return unit(np.stack(ring, axis=-1).reshape(n, -1).astype(np.float64))


def rank_order(patches: np.ndarray, most: int = 16) -> np.ndarray:
    """Whether a pixel is brighter than a later one, for all pairs of at most ``most`` spread pixels."""
    g = gray(patches).reshape(len(patches), -1)
    if g.shape[1] > most:
        g = g[:, np.linspace(0, g.shape[1] - 1, most, dtype=int)]
    i, j = np.triu_indices(g.shape[1], 1)
    return unit((g[:, i] > g[:, j]).astype(np.float64))


def gradient_histogram(patches: np.ndarray) -> np.ndarray:
    """Gradient magnitudes by 8 bins of direction over [-pi, pi).

    Directions of exactly pi or -pi fall into no bin, as single-precision
    angles lie just outside the double-precision ends.
    """
    g = gray(patches).astype(np.float32)
    gy, gx = np.gradient(g, axis=(1, 2))
    size = np.sqrt(gx**2 + gy**2)
    angle = np.arctan2(gy.astype(np.float64), gx.astype(np.float64)).astype(np.float32).astype(np.float64)  # rounded alike everywhere
    edges = np.linspace(-np.pi, np.pi, BINS + 1)
    out = [np.where((angle >= lo) & (angle < hi), size, 0).sum(axis=(1, 2), dtype=np.float64) for lo, hi in zip(edges, edges[1:])]
    return unit(np.stack(out, axis=1))


STRATEGIES = {"difference": difference, "chromaticity": chromaticity, "lbp": binary_pattern, "rank_order": rank_order, "gradient": gradient_histogram}


def composite(patches: np.ndarray, pooling: bool = True, strategies=tuple(STRATEGIES.values())) -> np.ndarray:
    """All strategies side by side, over the patch or over its 3 x 3 sub-patches one after another."""
    n, s = patches.shape[:2]
    if not pooling or s == 3:
        return np.concatenate([f(patches) for f in strategies], axis=1)
    subs = [composite(patches[:, y : y + 3, x : x + 3], False, strategies) for y in range(s - 2) for x in range(s - 2)]
    return np.concatenate(subs, axis=1)


@lru_cache(maxsize=16)
def random_projection(rows: int, dim: int) -> np.ndarray:
    """A fixed Gaussian projection with columns of norm 1."""
    m = np.random.RandomState(42).randn(rows, dim).astype(np.float32)
    return m / np.linalg.norm(m, axis=0, keepdims=True)


def project(raw: np.ndarray, dim: int, basis: np.ndarray | None = None) -> np.ndarray:
    """Rows in ``dim`` dimensions: by ``basis`` if one was fitted, padding either side, else at random."""
    if basis is None:
        return unit(raw @ random_projection(raw.shape[1], dim).astype(np.float64))
    width = basis.shape[0]
    fit = raw[:, :width] if raw.shape[1] >= width else np.pad(raw, ((0, 0), (0, width - raw.shape[1])))
    out = fit @ basis
    return unit(out[:, :dim] if out.shape[1] >= dim else np.pad(out, ((0, 0), (0, dim - out.shape[1]))))


def principal_axes(raw: np.ndarray, dim: int) -> np.ndarray:
    """The leading principal axes of the rows as columns, each with its largest entry above 0."""
    _, _, v = np.linalg.svd(raw - raw.mean(axis=0), full_matrices=False)
    v = v[: min(dim, *raw.shape)]
    return (v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]).T


def photometric(patches: np.ndarray) -> np.ndarray:
    """Patches less their mean and each pixel's achromatic part, of norm 1 (floor 1e-8)."""
    flat = patches.reshape(len(patches), -1)
    flat = flat - flat.mean(axis=1, keepdims=True)
    rgb = flat.reshape(len(patches), -1, 3)
    flat = (rgb - rgb.mean(axis=2, keepdims=True)).reshape(len(patches), -1)
    return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), 1e-8)


#: Kernels that work on each patch by itself, without products of matrices, so that a patch has the same descriptor in any batch.
PATCHWISE = {f.__name__: f for f in (difference, photometric)}


# -- persistence ---------------------------------------------------------------------------


def _neighbours(h: int, w: int) -> list[list[int]]:
    out = []
    for y in range(h):
        for x in range(w):
            out.append([yy * w + xx for yy, xx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= yy < h and 0 <= xx < w])
    return out


def elder_pairs(values: np.ndarray, around: list[list[int]], order: np.ndarray) -> list[tuple[int, int]]:
    """(birth position, death position) of components that die as positions are added in ``order``."""
    root: dict[int, int] = {}
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    dead = []
    for i in order.tolist():
        root[i] = i
        for j in around[i]:
            if j in root:
                a, b = find(i), find(j)
                if a != b:
                    old, young = (a, b) if rank[a] <= rank[b] else (b, a)
                    dead.append((young, i))
                    root[young] = old
    return dead


def sublevel_diagram(image: np.ndarray) -> np.ndarray:
    """0-dimensional persistence pairs (birth, death) of a gray image, 4-connected.

    The oldest component of all dies just above the maximum.
    """
    v = image.ravel()
    order = np.argsort(v, kind="stable")
    pairs = [(v[a], v[b]) for a, b in elder_pairs(v, _neighbours(*image.shape), order)]
    return np.array([*pairs, (v.min(), v.max() + 1e-6)])


def _deaths(order: np.ndarray, h: int, w: int) -> np.ndarray:
    """For each row of ``elder_pairs`` orders, at which position the component born at each position dies; -1 for the oldest."""
    n, size = order.shape
    rows = np.arange(n)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(size), order.shape), 1)
    around = np.array([x + [-1] * (4 - len(x)) for x in _neighbours(h, w)])
    root, dead = np.full((n, size + 1), -1), np.full((n, size), -1)  # the last column stands for no neighbour
    for t in range(size):
        i = order[:, t]
        root[rows, i] = i
        for j in around[i].T:
            a, b = root[rows, i], root[rows, j]
            some = np.flatnonzero((b >= 0) & (a != b))
            if not len(some):
                continue
            a, b = a[some], b[some]
            older = rank[some, a] <= rank[some, b]
            old, young = np.where(older, a, b), np.where(older, b, a)
            dead[some, young] = i[some]
            mine = root[some]
            root[some] = np.where(mine == young[:, None], old[:, None], mine)
    return dead


def persistence_descriptor(patches: np.ndarray, resolution: int = 8, sigma: float = 0.05) -> np.ndarray:
    """Persistence images of rank-normalised diagrams: unchanged by any rising tone curve.

    Ranks are whole numbers, so that each pair's Gaussians are rows of a table.
    """
    g = gray(patches)
    n, (h, w) = len(g), g.shape[1:]
    v, size, grid = g.reshape(n, -1), h * w, np.linspace(0, 1, resolution)
    if not n:
        return np.zeros((0, resolution * resolution))
    dead = _deaths(np.argsort(v, axis=1, kind="stable"), h, w)
    upto = (v[:, None, :] <= v[:, :, None]).sum(axis=2)  # values up to each one
    death = np.where(dead < 0, size, np.take_along_axis(upto, np.maximum(dead, 0), 1)) / size
    life = death - upto / size
    ranks = np.arange(size + 1) / size
    bx = np.exp(-((grid - ranks[:, None]) ** 2) / (2 * sigma * sigma))[upto]
    by = np.exp(-((grid - ranks[:, None]) ** 2) / (2 * sigma * sigma))[np.rint(life * size).astype(int)] * np.where(life > 1e-8, life, 0.0)[:, :, None]
    return unit((np.swapaxes(by, 1, 2) @ bx).reshape(n, -1))


@lru_cache(maxsize=16)
def zernike_basis(size: int, order: int) -> np.ndarray:
    """(moments, size * size) complex basis over pixel centres inside the unit disk."""
    c = (np.arange(size) + 0.5) / size * 2 - 1
    y, x = np.meshgrid(c, c, indexing="ij")
    rho, theta = np.hypot(x, y), np.arctan2(y, x)
    rows = []
    for n in range(order + 1):
        for m in range(n % 2, n + 1, 2):
            radial = sum(
                (-1) ** k * math.comb(n - k, k) * math.comb(n - 2 * k, (n - m) // 2 - k) * rho ** (n - 2 * k)
                for k in range((n - m) // 2 + 1)
            )
            rows.append(((n + 1) / math.pi * radial * np.exp(1j * m * theta) * (rho <= 1)).ravel())
    return np.array(rows)


def zernike(patches: np.ndarray, order: int | None = None) -> np.ndarray:
    """Magnitudes of Zernike moments, unchanged by rotation."""
    size = patches.shape[1]
    basis = zernike_basis(size, order or ZERNIKE_ORDER.get(size, 4))
    g = gray(patches).reshape(len(patches), -1)
    return unit(np.abs(g @ basis.T))


def bayesian(patches: np.ndarray, embed=None) -> np.ndarray:
    """Persistence, Zernike and photometric parts side by side, with an embedding if given."""
    parts = [persistence_descriptor(patches), zernike(patches), photometric(patches)]
    if embed is not None:
        parts.append(embed(parts[2]))
    rows = np.concatenate(parts, axis=1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-8)


# -- colour fits ---------------------------------------------------------------------------


def affine_fit(source: np.ndarray, target: np.ndarray, loss: str = "huber", sigma: float = 0.02, ridge: float = 1e-4, rounds: int = 10, tol: float = 1e-6):
    """Fit target = M source + b for each pair of patches: (M, b, rss, ok).

    ``source`` and ``target`` are (N, pixels, 3). Ridge least squares, then, for
    ``huber``, reweighting until a row's unweighted residual sum settles; rows
    that settled or turned singular keep what they have. A singular first fit
    gives the identity, an infinite rss and not ok.
    """
    n = len(source)
    x = np.concatenate([source, np.ones((*source.shape[:2], 1))], axis=2)
    eye = ridge * np.eye(4)

    def solve(rows: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        xw = x[rows] if w is None else x[rows] * w[..., None]
        a = np.swapaxes(xw, 1, 2) @ x[rows] + eye
        y = np.swapaxes(xw, 1, 2) @ target[rows]
        p = np.zeros((len(rows), 4, 3))
        fine = np.ones(len(rows), bool)
        try:
            p = np.linalg.solve(a, y)
        except np.linalg.LinAlgError:
            for k in range(len(rows)):
                try:
                    p[k] = np.linalg.solve(a[k], y[k])
                except np.linalg.LinAlgError:
                    fine[k] = False
        return p, fine & np.isfinite(p).all(axis=(1, 2))

    def residual(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return target[rows] - x[rows] @ p

    every = np.arange(n)
    p, ok = solve(every, None) if n else (np.zeros((0, 4, 3)), np.zeros(0, bool))
    rss = np.where(ok, (residual(p, every) ** 2).sum(axis=(1, 2)), np.inf)
    p[~ok] = np.vstack([np.eye(3), np.zeros((1, 3))])
    if loss == "huber":
        delta = 1.345 * sigma
        live, before = every, np.full(n, np.inf)
        for _ in range(rounds):
            if not len(live):
                break
            r = np.sqrt((residual(p[live], live) ** 2).sum(axis=2))
            new, fine = solve(live, np.where(r <= delta, 1.0, delta / (r + 1e-10)))
            live, new = live[fine], new[fine]
            p[live] = new
            rss[live] = (residual(new, live) ** 2).sum(axis=(1, 2))
            ok[live] = True
            going = ~(np.abs(before[live] - rss[live]) < tol)
            before[live] = rss[live]
            live = live[going]
    return np.swapaxes(p[:, :3], 1, 2), p[:, 3], rss, ok & np.isfinite(rss)


def chi2_survival(value: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(chi-square with ``dof`` degrees >= value), by finite sums in logarithms."""
    value, dof = np.broadcast_arrays(np.asarray(value, float), np.asarray(dof, int))
    out = np.zeros(value.shape)
    for d in np.unique(dof):
        at = dof == d
        h = np.maximum(value[at], 0) / 2
        if d <= 0:
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            log_h = np.log(h)
            start = 0.0 if d % 2 == 0 else 0.5
            steps = np.arange(start, d / 2, 1.0)
            if d % 2:
                base, steps = np.array([math.erfc(math.sqrt(t)) if math.isfinite(t) else 0.0 for t in h.tolist()]), steps
            else:
                base = np.zeros(len(h))
            for j in steps:
                base = base + np.where(h > 0, np.exp(-h + j * log_h - math.lgamma(j + 1)), 1.0 if j == 0 else 0.0)
        out[at] = np.where(np.isnan(base), 0.0, np.clip(base, 0, 1))
    return np.where((np.asarray(value) < 0) | ~np.isfinite(value), 0.0, out)


# -- search --------------------------------------------------------------------------------


def nearest(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(rows, k) distances and ids of the nearest targets at ``limit`` or nearer; ties go to the smaller id.

    Places without a target hold infinity and -1. Candidates come from
    |q|^2 + |t|^2 - 2 q t in single precision, with room for its error, and are
    measured again exactly; queries without any cost no more than that.
    """
    out_d, out_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    if not len(t) or not len(q):
        return out_d, out_i
    limit = np.broadcast_to(np.asarray(limit, float), (len(q),))
    q32, t32 = q.astype(np.float32), t.astype(np.float32)
    norm, q_norm = (t32 * t32).sum(axis=1), (q32 * q32).sum(axis=1)
    room = 1e-5 * (norm.max() + q_norm.max())
    for lo in range(0, len(q), 512):
        rough = q32[lo : lo + 512] @ t32.T
        rough *= -2
        rough += norm
        rough += q_norm[lo : lo + 512, None]
        near = rough <= (limit[lo : lo + 512] + room).astype(np.float32)[:, None]
        for r in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[r])
            if len(at) > 4 * k:
                v = rough[r, at]
                at = at[v <= np.partition(v, k - 1)[k - 1] + 2 * room]
            d = ((t[at] - q[lo + r]) ** 2).sum(axis=1)
            at, d = at[d <= limit[lo + r]], d[d <= limit[lo + r]]
            order = np.lexsort((ids[at], d))[:k]
            out_d[lo + r, : len(order)], out_i[lo + r, : len(order)] = d[order], ids[at][order]
    return out_d, out_i


# -- images --------------------------------------------------------------------------------


def blur_radius(sigma: float, truncate: float = 4.0) -> int:
    return int(truncate * sigma + 0.5) if sigma > 0 else 0


def mirrored(n: int, lo: int, hi: int) -> tuple[int, np.ndarray]:
    """Where places ``lo`` to ``hi`` of an axis of ``n`` pixels lie, mirrored with the edge pixel: the smallest, and offsets from it."""
    at = np.arange(lo, hi) % (2 * n)
    at = np.where(at >= n, 2 * n - 1 - at, at)
    return int(at.min()), at - at.min()


def blur_pass(part: np.ndarray, axis: int, at: np.ndarray, sigma: float) -> np.ndarray:
    """One pass of a Gaussian over an axis laid out by ``at`` (radius on both sides); weights are added up tap by tap."""
    radius = blur_radius(sigma)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2) if radius else np.ones(1)
    k /= k.sum()
    padded, n = np.take(part, at, axis=axis), len(at) - 2 * radius
    return sum(w * np.take(padded, np.arange(i, i + n), axis=axis) for i, w in enumerate(k))


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur; edges are mirrored including the edge pixel."""
    out, radius = image.astype(float), blur_radius(sigma)
    for axis in (0, 1):
        out = blur_pass(out, axis, mirrored(out.shape[axis], -radius, out.shape[axis] + radius)[1], sigma) if sigma > 0 else out
    return out


def label_cells(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Connected components of a mask, numbered from 1 in row-major order of their first pixel.

    Roots of cells that touch are hooked to the smaller one and paths are
    halved to nothing, for all cells at once, until nothing that touches differs.
    """
    h, w = mask.shape
    on = np.flatnonzero(mask)
    place = np.full((h, w), -1)
    place.ravel()[on] = np.arange(len(on))
    touch = []
    for dy, dx in [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]:
        a, b = place[: h - dy or None, max(0, -dx) : w - max(0, dx)], place[dy:, max(0, dx) : w + min(0, dx)]
        both = (a >= 0) & (b >= 0)
        touch.append((a[both], b[both]))
    a, b = (np.concatenate(x) for x in zip(*touch))
    up = np.arange(len(on))
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
    names, number = np.unique(up, return_inverse=True)
    label = np.zeros((h, w), int)
    label.ravel()[on] = number + 1
    return label, len(names)


def _lanczos(x: np.ndarray, a: int = 3) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


_FILTERS = {"lanczos": (_lanczos, 3.0), "cubic": (_cubic, 2.0)}


def _taps(n: int, size: int, kernel: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For outputs ``lo`` to ``hi`` of an axis of ``n`` pixels resampled to ``size``: the first input and the weights from there on."""
    f, support = _FILTERS[kernel]
    ratio = n / size
    scale = max(ratio, 1.0)
    centre = (np.arange(lo, hi) + 0.5) * ratio
    first = np.ceil(centre - support * scale - 0.5).astype(int)
    at = first[:, None] + np.arange(int(np.ceil(2 * support * scale)) + 1)
    away = at + 0.5 - centre[:, None]
    weights = np.where((np.abs(away) <= support * scale) & (at >= 0) & (at < n), f(away / scale), 0.0)
    return first, weights / weights.sum(axis=1, keepdims=True)


def resample_reach(n: int, size: int, kernel: str, lo: int, hi: int) -> tuple[int, int]:
    """The range of inputs that outputs ``lo`` to ``hi`` need."""
    if n == size:
        return lo, hi
    first, weights = _taps(n, size, kernel, lo, hi)
    return max(0, int(first.min())), min(n, int(first.max()) + weights.shape[1])


def resample(part: np.ndarray, axis: int, n: int, size: int, kernel: str, lo: int, hi: int, start: int) -> np.ndarray:
    """Outputs ``lo`` to ``hi`` of one pass, rounded to 8 bits; ``part`` has the inputs from ``start`` on that they need.

    Weights are added up tap by tap, so that a part gives what the whole does.
    """
    first, weights = _taps(n, size, kernel, lo, hi)
    shape = [1] * part.ndim
    shape[axis] = hi - lo
    out = np.zeros(1)
    for k in range(weights.shape[1]):
        out = out + weights[:, k].reshape(shape) * np.take(part, np.clip(first + k - start, 0, part.shape[axis] - 1), axis=axis)
    return np.clip(np.floor(out + 0.5), 0, 255)


def resize(image: np.ndarray, height: int, width: int, kernel: str = "lanczos") -> np.ndarray:
    """Antialiased separable resampling of an 8-bit image, rounded to 8 bits after each pass."""
    out = image.astype(np.float64)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            out = resample(out, axis, out.shape[axis], size, kernel, 0, size, 0)
    return out.astype(np.uint8)


def native_fraction(image: np.ndarray, kappa: float = 0.08, offset: float = 1.0) -> float:
    """The smallest share of its size to which an 8-bit image can be reduced without losing detail.

    Fifteen shares from 1 to 0.3 are tried, with sides of at least 8 pixels. A
    share passes if its mean squared loss is at most ``offset`` and ``kappa``
    of the range above that of the shares near 1.
    """
    full = image.shape[:2]
    shares = np.linspace(1.0, 0.3, 15)

    def loss(share: float) -> float:
        less = [max(8, round(side * float(share))) for side in full]
        again = resize(resize(image, *less, "lanczos"), *full, "cubic")
        return float(np.square(again.astype(float) - image).mean())

    lost = np.array([loss(f) for f in shares])
    base = lost[shares >= 0.95].mean()
    return float(shares[lost <= base + kappa * (lost.max() - base) + offset].min(initial=1.0))
