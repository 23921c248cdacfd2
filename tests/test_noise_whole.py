"""The noise-probability detectors as wholes against plain versions written from their definitions."""

import numpy as np
from pyspark.sql import functions as F
from test_bands import parts_of
from test_maps import moved, square
from test_patches import G, patch_map, scene
from test_whole_band import bell

from skywave.kernels.arrays import mixture_threshold
from skywave.plans import noise

SHAPE = (14, 16)


def z(x):
    return (x - x.mean()) / (x.std() + 1e-8)


def unit(x):
    return (x - x.min()) / (x.max() - x.min() + 1e-8)


def squash(x):
    return 1 / (1 + np.exp(-x))


def mirrored(x, sigma):
    w, at = bell(sigma)
    r = at.max()
    for axis in (0, 1):
        y = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(v * np.take(y, range(k, k + x.shape[axis]), axis) for k, v in enumerate(w))
    return x


def neighbours(x, k=12):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, 1)


def cues(x, near, far):
    e = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(*SHAPE, -1)
    alike = sum((e * np.roll(e, s, a)).sum(2) for s in (1, -1) for a in (0, 1)) / 4
    return unit(1 / (far.mean(1) + 1e-8)), unit(alike).ravel()


def spread(p0, near, far, rounds):
    s = np.median(far[far > 0])
    w = np.exp(-(far**2) / (2 * s * s + 1e-8))
    w /= w.sum(1, keepdims=True) + 1e-8
    p = p0
    for _ in range(rounds):
        p = np.clip(0.82 * (w * p[near]).sum(1) + 0.18 * p0, 0, 1)
    return p


def cleaned(m, conservative):
    grow, shrink = (lambda x, n: moved(x, square(n, True), any)), (lambda x, n: moved(x, square(n, False), all))
    m = grow(shrink(m, 2), 2)
    n = 2 if conservative else 3
    m = shrink(grow(m, n), n)
    if not conservative:
        for p in parts_of(~m):
            if all(0 < i < SHAPE[0] - 1 and 0 < j < SHAPE[1] - 1 for i, j in p):
                m[tuple(np.array(p).T)] = True
    for p in parts_of(m):
        if len(p) < max(4, int((0.0025 if conservative else 0.003) * m.size)):
            m[tuple(np.array(p).T)] = False
    return m


def columns(spark, seed):
    _, p = scene(spark, seed=seed)
    rows = sorted(p.collect(), key=lambda r: r.node)
    return p, *(np.array([r[c] for r in rows], float) for c in ("x", "x_smooth", "residual", "gradient"))


def test_baseline_detector_equals_a_plain_version(spark):
    for seed in (0, 3):
        p, x, _, residual, gradient = columns(spark, seed)
        near, far = neighbours(x)
        dense, alike = cues(x, near, far)
        prob = spread(squash(0.45 * z(-residual) + 0.25 * z(-alike) + 0.15 * z(-gradient) + 0.15 * z(-dense)), near, far, 20)
        cut = mixture_threshold(prob)[0]
        want = cleaned((prob < cut).reshape(SHAPE), False) if np.isfinite(cut) else np.zeros(SHAPE, bool)
        d = noise.detect_baseline(p, *SHAPE, G)
        assert np.allclose(patch_map(d, "p", SHAPE).astype(float).ravel(), prob, atol=1e-9)
        assert (patch_map(d, "signal", SHAPE).astype(bool) == want).all() and want.any()


def ratio(x, mean, var):
    far = [((x - m) ** 2 / (v + 1e-8)).sum(1) for m, v in zip(mean, var, strict=True)]
    return squash(z(np.log(far[0] + 1e-6) - np.log(far[1] + 1e-6)))


def plain_refined(x, other, residual, gradient, looks, before, spans):
    near, far = neighbours(x)
    _, alike = cues(x, near, far)
    low, high = residual <= np.quantile(residual, 0.20), residual >= np.quantile(residual, 0.92)
    low = low if low.sum() >= 10 else residual <= np.quantile(residual, 0.30)
    high = high if high.sum() >= 10 else residual >= np.quantile(residual, 0.85)
    mean, var = [x[s].mean(0) for s in (low, high)], [x[s].var(0) + 1e-3 for s in (low, high)]
    cos = (x * other).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(other, axis=1))
    pre = squash(z(0.42 * ratio(x, mean, var) + 0.20 * squash(z(far.mean(1))) + 0.18 * squash(z(-cos)) + 0.12 * z(-alike) + 0.08 * z(-gradient)))
    seen = np.mean([ratio(y, mean, var) for y in looks], 0)
    unsure = unit(-(seen * np.log(seen) + (1 - seen) * np.log(1 - seen)))
    p0 = np.clip(0.82 * pre + 0.10 * unsure + 0.08 * (0 if before is None else unit(np.abs(pre - before))), 0, 1)
    quiet, loud = residual <= np.quantile(residual, 0.20), residual >= np.quantile(residual, 0.92)
    pinned = lambda p: np.where(loud, np.minimum(np.where(quiet, np.maximum(p, 0.98), p), 0.02), np.where(quiet, np.maximum(p, 0.98), p))
    p = pinned(spread(pinned(p0), near, far, 25)).reshape(SHAPE)
    off = lambda a, b: np.abs(p - np.roll(np.roll(p, a, 0), b, 1))
    apart = 0.75 * 0.25 * (off(1, 0) + off(-1, 0) + off(0, 1) + off(0, -1)) + 0.125 * (off(1, 1) + off(1, -1))
    apart = 0.78 * unit(mirrored(apart, 0.7))
    if before is not None:
        apart = np.clip(apart + 0.22 * unit(mirrored(np.abs(p - before.reshape(SHAPE)), 0.7)), 0, 1)
    prior = unit(0.50 * unit(residual).reshape(SHAPE) + 0.30 * unit(alike).reshape(SHAPE) + 0.20 * (1 - apart))
    p = pinned(np.clip(mirrored(p + 0.11 * apart - 0.18 * prior, 0.55), 0, 1).ravel()).reshape(SHAPE)
    cut = mixture_threshold(p.ravel())[0]
    tau = cut if np.isfinite(cut) else np.quantile(p, 0.33)
    strong = max(0.01, min(tau - 0.04, np.quantile(p, 0.25)))
    weak = min(0.99, min(tau + 0.015, np.quantile(p, 0.45)))
    weak = min(0.99, strong + 0.03) if weak <= strong else weak
    m = p < strong
    for _ in range(2):
        m = moved(m, square(3, True), any) & (p < weak)
    m = cleaned(m, True)
    for part in parts_of(m) if spans else []:
        at = tuple(np.array(part).T)
        if np.ptp(at[0]) + 1 < spans[0] or np.ptp(at[1]) + 1 < spans[1] or len(part) < max(4, int(0.22 * spans[0] * spans[1])):
            m[at] = False
            p[at] = np.clip(p[at] + 0.20, 0, 1)
    if m.mean() > 0.55 and p.mean() > 0.56:
        m[:] = False
    return p, m, tau, not np.isfinite(cut)


def test_refined_detector_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    p, x, other, residual, gradient = columns(spark, 1)
    looks = [x + rng.normal(0, 0.05, x.shape) for _ in range(2)]
    before = rng.random(len(x))
    extra = spark.createDataFrame([(i, *([float(v) for v in y[i]] for y in looks), float(before[i])) for i in range(len(x))], "i long, a array<double>, b array<double>, before double")
    p = p.join(extra, F.col("node") == F.col("i")).drop("i")
    for previous, spans in ((None, None), ("before", (3, 4))):
        d = noise.detect_refined(p, *SHAPE, G, looks=("a", "b"), previous=previous, spans=spans)
        prob, mask, tau, fallback = plain_refined(x, other, residual, gradient, looks, before if previous else None, spans)
        r = d.first()
        assert np.isclose(r.tau, tau, atol=1e-6) and r.fallback == fallback
        assert np.allclose(patch_map(d, "p", SHAPE).astype(float), prob, atol=1e-6)
        assert (patch_map(d, "signal", SHAPE).astype(bool) == mask).all() and mask.any()
