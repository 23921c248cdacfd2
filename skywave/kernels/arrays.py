"""Small NumPy kernels that grouped Spark tasks apply to one bounded tile."""

from __future__ import annotations

import numpy as np


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """A periodic window, flat in the middle, with cosine tapers over a share of its length."""
    x = np.arange(n) / n
    edge = share / 2
    w = np.ones(n)
    w[x < edge] = 0.5 * (1 + np.cos(np.pi * (x[x < edge] / edge - 1)))
    w[x > 1 - edge] = 0.5 * (1 + np.cos(np.pi * ((x[x > 1 - edge] - 1) / edge + 1)))
    return w


def power_spectra(segments: np.ndarray, sample_rate: float, magnitude: bool = False) -> np.ndarray:
    """dB spectra (two-sided, centred) of segments, one a row: mean removed, tapered, density scaling."""
    n = segments.shape[1]
    w = tukey(n)
    s = np.fft.fftshift(np.fft.fft((segments - segments.mean(1, keepdims=True)) * w, axis=1), axes=1)
    scale = 1 / (sample_rate * (w**2).sum())
    if magnitude:
        return 20 * np.log10(np.abs(s) * np.sqrt(scale) + 1e-10)
    return 10 * np.log10(np.abs(s) ** 2 * scale + 1e-10)


def convolve(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis, edge values repeated."""
    r = len(kernel) // 2
    padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(x.ndim)], mode="edge")
    out = np.zeros_like(x, float)
    for i, w in enumerate(kernel):
        out += w * np.take(padded, range(i, i + x.shape[axis]), axis=axis)
    return out


def gaussian(sigma: float, order: int = 0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    at = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (at / sigma) ** 2)
    w /= w.sum()
    return w if order == 0 else w * at / sigma**2


def unit_range(x: np.ndarray, low: float, high: float, mask: np.ndarray | None = None) -> np.ndarray:
    pick = x[np.isfinite(x) if mask is None else np.isfinite(x) & mask]
    if not pick.size:
        return np.zeros_like(x)
    lo, hi = np.quantile(pick, [low, high])
    hi = lo + 1e-6 if hi <= lo else hi
    out = np.clip((x - lo) / (hi - lo), 0, 1)
    return out if mask is None else np.where(mask, out, 0.0)


def background_residual(x: np.ndarray) -> np.ndarray:
    """What stands over a wide box mean, scaled between its 5 % and 99 % quantiles."""
    rows, cols = (max(9, 2 * max(1, n // 24) + 1) for n in x.shape)
    return unit_range(np.maximum(x - box(x, rows, cols), 0), 0.05, 0.99)


def structure_gate(x: np.ndarray, scales: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(coherence, gate) of a tile's background residual, each the strongest over the scales.

    Coherence says how strongly the map runs in one direction; the gate weighs it by the root of the gradient energy.
    """
    r = background_residual(x)
    coherence, gate = np.zeros_like(r), np.zeros_like(r)
    for sigma in scales:
        gf = convolve(convolve(r, gaussian(sigma, 1), 0), gaussian(sigma), 1)
        gt = convolve(convolve(r, gaussian(sigma, 1), 1), gaussian(sigma), 0)
        k = gaussian(max(1.0, 1.8 * sigma))
        ff, tt, ft = (convolve(convolve(a, k, 0), k, 1) for a in (gf * gf, gt * gt, gf * gt))
        own = unit_range(np.sqrt((ff - tt) ** 2 + 4 * ft**2) / np.maximum(ff + tt, 1e-6), 0.05, 0.99)
        coherence = np.maximum(coherence, own)
        gate = np.maximum(gate, own * np.sqrt(unit_range(ff + tt, 0.05, 0.99)))
    return coherence, unit_range(gate, 0.05, 0.99)


def resize_bilinear(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear resize, pixel centres aligned; where it shrinks, the triangle widens to the cells that one new cell covers."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        reach = max(scale, 1.0)
        at = (np.arange(m)[:, None] + 0.5) * scale
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None] + 0.5 - at) / reach)
        return w / w.sum(1, keepdims=True)

    return weights(x.shape[0], rows) @ x @ weights(x.shape[1], cols).T


def mixture_threshold(p: np.ndarray, rounds: int = 60) -> tuple[float, float, float, float]:
    """(threshold, gap, spread, separation) of a two-part normal mixture fitted to values from fixed starts; NaN if one-sided."""
    p = p[np.isfinite(p)]
    if p.size < 4:
        return (np.nan,) * 4
    mean, var, share = np.quantile(p, [0.25, 0.75]), np.full(2, p.var() + 1e-6), np.full(2, 0.5)
    for _ in range(rounds):
        d = share * np.exp(-0.5 * (p[:, None] - mean) ** 2 / var) / np.sqrt(var)
        d /= np.maximum(d.sum(1, keepdims=True), 1e-300)
        n = np.maximum(d.sum(0), 1e-9)
        mean = (d * p[:, None]).sum(0) / n
        var = (d * (p[:, None] - mean) ** 2).sum(0) / n + 1e-6
        share = n / n.sum()
    gap, spread = abs(mean[1] - mean[0]), float(np.subtract(*np.quantile(p, [0.95, 0.05])))
    separation = gap / np.sqrt(var.mean())
    ok = gap >= 0.18 and spread >= 0.22 and separation >= 1.15
    return (float(mean.mean()) if ok else np.nan), float(gap), spread, float(separation)


def position_basis(pr: np.ndarray, pc: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Sixteen columns of the grid position, each axis scaled to -1..1; the first is constant."""
    r, c, pi = 2 * pr / max(rows - 1, 1) - 1, 2 * pc / max(cols - 1, 1) - 1, np.pi
    # fixed values: the basis decides what counts as a trend of the position
    plain = [np.ones_like(r), r, c, r**2, c**2, r * c]
    waves = [np.sin(pi * r), np.sin(pi * c), np.cos(pi * r), np.cos(pi * c), np.sin(2 * pi * r), np.sin(2 * pi * c), np.cos(2 * pi * r), np.cos(2 * pi * c)]
    return np.stack([*plain, *waves, np.sin(pi * r) * np.cos(pi * c), np.cos(pi * r) * np.sin(pi * c)], 1)


def ridge_detrend(x: np.ndarray, pr: np.ndarray, pc: np.ndarray, rows: int, cols: int, ridge: float = 1e-3) -> np.ndarray:
    """Features less their ridge fit on the basis of the grid position."""
    b = position_basis(pr, pc, rows, cols)
    return x - b @ np.linalg.solve(b.T @ b + ridge * np.eye(16), b.T @ x)


def principal_scores(x: np.ndarray, most: int = 12) -> np.ndarray:
    """Scores on the leading principal axes, at most `most`, one fewer than rows, and as many as columns; signs are arbitrary."""
    d = min(most, x.shape[1], x.shape[0] - 1)
    if d < 1:
        return x
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return (u * s)[:, :d]


def drop_position_components(x: np.ndarray, basis: np.ndarray, limit: float = 0.30) -> np.ndarray:
    """Features rebuilt from the principal components whose correlation with every column of the basis is under the limit;
    where none is, from the least correlated one. The result is centred."""
    if min(x.shape) <= 1:
        return x
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    b = basis - basis.mean(0)
    norm = np.linalg.norm(b, axis=0)
    b = b[:, norm >= 1e-8] / norm[norm >= 1e-8]
    y = u * s - (u * s).mean(0)
    size = np.linalg.norm(y, axis=0)
    seen = np.where(size < 1e-8, 0.0, np.abs(b.T @ (y / np.maximum(size, 1e-8))).max(0)) if b.shape[1] else np.zeros(len(s))
    keep = seen < limit
    if not keep.any():
        keep[np.argmin(seen)] = True
    return (u * s * keep) @ vt


def box(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over an odd box, edge values repeated."""
    return convolve(convolve(x, np.full(rows, 1 / rows), 0), np.full(cols, 1 / cols), 1)


def label_mask(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of each cell's four-connected part, 0 outside; how many parts), by runs of cells along the rows."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    f, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    root = list(range(len(f)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = 0
    for i in range(len(f)):
        while f[above] < f[i] - 1 or (f[above] == f[i] - 1 and stop[above] <= start[i]):
            above += 1
        j = above
        while f[j] == f[i] - 1 and start[j] < stop[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
            j += 1
    tops, number = np.unique([find(i) for i in range(len(f))], return_inverse=True) if len(f) else (np.empty(0), np.empty(0, int))
    out = np.zeros(mask.shape, int)
    for i in range(len(f)):
        out[f[i], start[i] : stop[i]] = number[i] + 1
    return out, len(tops)


def smooth_mask(mask: np.ndarray, rounds: int, least: int) -> np.ndarray:
    """A mask after rounds of 3 x 3 majority votes; parts of fewer than `least` cells are put to the vote once more."""

    def votes(m: np.ndarray) -> np.ndarray:
        return convolve(convolve(m.astype(float), np.ones(3), 0), np.ones(3), 1) > 4.5

    for _ in range(rounds):
        mask = votes(mask)
    parts, n = label_mask(mask)
    small = (np.bincount(parts.ravel(), minlength=n + 1) < least)[parts] & mask
    return np.where(small, votes(mask), mask) if small.any() else mask


def robust_quantile(x: np.ndarray, q: float, saturation: float = 0.9995) -> float:
    """A high quantile; where it saturates, that of the values below saturation; 1 for none."""
    x = x[np.isfinite(x)]
    if not x.size:
        return 1.0
    q = min(max(q, 0.50), 0.99)
    value = float(np.quantile(x, q))
    if value < saturation:
        return value
    under = x[x < saturation]
    return float(np.quantile(under, min(q, 0.90))) if under.size else saturation


def coherent_power_tile(x: np.ndarray, valid: np.ndarray, scales: tuple[float, ...], weights: tuple[float, float], floor_q: float, size: tuple[int, int], support_q: float, mask_q: float, least: int) -> dict[str, np.ndarray]:
    """Coherence, power, score, support and mask of one tile; nothing outside the valid rows."""
    linear = 10 ** (x / 10)
    floor = max(np.quantile(linear[valid] if valid.any() else linear, floor_q), 1e-20)
    relative = np.clip(10 * np.log10(np.maximum(linear, 1e-20) / floor), -5, 25)
    relative = np.where(valid, np.maximum(relative - box(relative, *size), 0), 0)
    coherence, power = unit_range(structure_gate(x, scales)[0], 0.05, 0.99), unit_range(relative, 0.05, 0.95)
    score = unit_range(weights[0] * coherence + weights[1] * power, 0.05, 0.95)
    support = smooth_mask((score >= robust_quantile(score[valid], support_q)) & valid, 1, max(3, least // 2)) & valid
    mask = smooth_mask((score >= robust_quantile(score[support], mask_q)) & support, 1, least) & valid
    return {"coherence": coherence * valid, "power": power * valid, "score": score * valid, "support": support, "mask": mask}
