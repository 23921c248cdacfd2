"""Texture, regions and noise probability against plain NumPy statements of their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywave.kernels import arrays
from skywave.operators import graph as gr
from skywave.operators import patches as pt
from skywave.operators import regions as rg
from skywave.operators import segment as sg
from skywave.operators import texture as tx
from skywave.plans import noise
from test_signal import back, grid, label

G = ["capture_id"]


def unit(x, low=5, high=95):
    a, b = np.percentile(x, [low, high])
    return np.clip((x - a) / (b - a if b > a else 1e-6), 0, 1)


def speckle(mask, least):
    parts, n = label(mask)
    sizes = np.bincount(parts.ravel(), minlength=n + 1)[1:]
    return sizes[sizes >= least].sum() / mask.sum() if mask.any() else 0.0


def maps(spark, **named):
    shape = next(iter(named.values())).shape
    rows = [("c", 0, f, t, *[float(m[f, t]) for m in named.values()]) for f in range(shape[0]) for t in range(shape[1])]
    return spark.createDataFrame(rows, "capture_id string, frame_id int, f int, t int, " + ", ".join(f"{n} double" for n in named))


def smooth_map(seed, shape=(16, 20)):
    return np.clip(unit(arrays.box(np.random.default_rng(seed).random(shape), 3, 3)), 0, 1)


def test_reliability_both_ways(spark):
    x, y = smooth_map(1), smooth_map(2)
    for by_means in (False, True):
        a, b = (unit(x), unit(y)) if by_means else (x, y)
        q = np.quantile(a, [0.2, 0.5, 0.6, 0.85, 0.9, 0.95])
        top, agree = a >= (q[4] if by_means else q[3]), b >= np.quantile(b, 0.85)
        peak = np.clip((a[top].mean() - q[1]) / 0.5 if by_means else (q[5] - q[2]) / (q[5] - q[0]), 0, 1)
        want = (peak, speckle(top, 6), b[top].mean(), (top & agree).sum() / (top | agree).sum())
        r = tx.texture_reliability(maps(spark, x=x, y=y), "x", "y", by_means=by_means).first()
        assert np.allclose((r.peakiness, r.speckle, r.support, r.overlap), want)
        assert np.isclose(r.reliability, np.clip(np.dot((0.35, 0.25, 0.20, 0.20), want), 0, 1))


@pytest.mark.parametrize("seed", [3, 4])
def test_passthrough_and_fusion(spark, seed):
    score, structure, texture, r = smooth_map(seed), smooth_map(seed + 10), smooth_map(seed + 20), 0.4
    top = structure >= np.quantile(structure, 0.7)
    s, peak = speckle(top, max(4, round(4 + 4 * r))), structure[structure >= np.quantile(structure, 0.9)].mean()
    want = 0.25 + 0.75 * np.clip((s - 0.85) / 0.15, 0, 1) if s >= 0.85 else 0.05 + 0.20 * np.clip((s - 0.2) / 0.65, 0, 1) if s >= 0.2 else 0.05
    d = maps(spark, score=score, structure=structure, texture=texture).withColumn("r", F.lit(r))
    got = tx.texture_passthrough(d, "structure", reliability="r").first()
    assert np.allclose((got.speckle, got.peak, got.passthrough, got.clean_score), (s, peak, want, np.clip(0.7 * s + 0.3 * peak, 0, 1)))
    hi, mid, low = 0.44 + 0.12 * r, 0.24 + 0.10 * r, 0.10 + 0.08 * r
    cuts = (score >= hi, (score >= mid) & (score < hi + np.clip(0.15 * (hi - mid), 0.012, 0.035)), (score >= low) & (score < mid + np.clip(0.15 * (mid - low), 0.012, 0.030)))
    strong, middle, lower = (unit(score * c) for c in cuts)
    bands = np.clip(strong + np.clip((s - 0.2) / 0.65, 0, 1) * (middle + lower), 0, 1)
    for damped in (False, True):
        fused = unit(np.clip(bands + max(want, 0.1) * texture * (1 - bands if damped else 1), 0, 1))
        out = tx.banded_fusion(d, "score", "structure", "texture", "r", "fused", damped=damped)
        assert np.allclose(back(out, "fused", score.shape).astype(float), fused)


def test_speckle_of_an_empty_mask_is_zero(spark):
    assert tx.speckle(grid(spark, np.zeros((3, 4), bool), "m"), "m", F.lit(2)).first().speckle == 0.0


def test_rescoring_with_texture(spark):
    names = ("texture", "score", "power", "gate", "support", "strict")
    m = {n: smooth_map(30 + i) for i, n in enumerate(names)}
    u = {n: unit(x) for n, x in m.items()}
    a = unit(np.sqrt(u["score"] * u["power"]))
    x = u["texture"]
    top, agree = x >= np.quantile(x, 0.9), a >= np.quantile(a, 0.85)
    rel = np.clip(0.35 * np.clip((x[top].mean() - np.median(x)) / 0.5, 0, 1) + 0.25 * speckle(top, 3) + 0.2 * a[top].mean() + 0.2 * (top & agree).sum() / (top | agree).sum(), 0, 1)
    s = speckle(u["gate"] >= np.quantile(u["gate"], 0.85), 3)
    through = 0.25 + 0.75 * np.clip((s - 0.96) / 0.04, 0, 1) if s >= 0.96 else 0.05 + 0.2 * (s - 0.5) / 0.46 if s >= 0.5 else 0.02 + 0.03 * s / 0.5
    want = unit(u["strict"] + rel * through * m["texture"] * np.clip(0.35 + 0.65 * u["support"], 0, 1))
    got = tx.rescore_with_texture(maps(spark, **m))
    assert np.allclose(back(got, "rescored", want.shape).astype(float), want)


def test_recurrence_of_a_lone_patch(spark):
    p = spark.createDataFrame([("c", 1, [1.0, 2.0])], "capture_id string, node long, x array<double>")
    assert tx.texture_recurrence(p, G).first().recurrence is None
    assert tx.texture_recurrence(p, G, far=True).first().recurrence == 1.0


def test_zoom_keeps_planes_and_corners(spark):
    x = np.add.outer(2.0 * np.arange(7), 3.0 * np.arange(5))
    got = {(r.pr, r.pc): r.value for r in pt.zoom(grid(spark, x), "power_db", 7, 5, 4, 9).collect()}
    assert all(np.isclose(v, 2 * pr * 6 / 3 + 3 * pc * 4 / 8) for (pr, pc), v in got.items()) and len(got) == 36


def scene(spark, rows=14, cols=16, seed=0):
    """Patches whose features and residual tell a block of signal from noise around it."""
    rng = np.random.default_rng(seed)
    on = np.zeros((rows, cols), bool)
    on[4:9, 5:11] = True
    out = []
    for i in range(rows * cols):
        pr, pc = divmod(i, cols)
        x = rng.normal(0, 0.15, 6) + (np.array([3.0, 1, 0, 0, 0, 0]) if on[pr, pc] else np.array([0.0, 0, 1, 0, 0, 0]) + rng.normal(0, 0.5, 6))
        out.append(("c", i, pr, pc, [float(v) for v in x], [float(v) for v in x + rng.normal(0, 0.05, 6)], float(on[pr, pc]) + float(rng.normal(0, 0.05)), float(rng.random()), float(on[pr, pc])))
    return on, spark.createDataFrame(out, "capture_id string, node long, pr int, pc int, x array<double>, x_smooth array<double>, residual double, gradient double, seed double")


def patch_map(df, name, shape):
    out = np.zeros(shape, object)
    for r in df.select("pr", "pc", name).collect():
        out[r.pr, r.pc] = r[name]
    return out


def test_detectors_find_the_block(spark):
    on, p = scene(spark)
    for d in (noise.detect_baseline(p, *on.shape, G), noise.detect_refined(p, *on.shape, G, spans=(2, 2))):
        got = patch_map(d, "signal", on.shape).astype(bool)
        assert (got & on).sum() / (got | on).sum() > 0.6
    again = noise.detect_refined(p.withColumn("before", F.lit(0.5)), *on.shape, G, looks=("x", "x_smooth"), previous="before")
    got = patch_map(again, "signal", on.shape).astype(bool)
    assert (got & on).sum() / (got | on).sum() > 0.6


def test_detectors_of_an_empty_table(spark):
    _, p = scene(spark)
    assert noise.detect_refined(p.limit(0), 14, 16, G).count() == 0 == noise.detect_baseline(p.limit(0), 14, 16, G).count() == rg.region_mask(p.limit(0), G).count()


def test_propagation_equals_a_plain_one(spark):
    _, p = scene(spark)
    edges = gr.knn(p, G, 5, "euclidean")
    e = edges.toPandas()
    start = np.random.default_rng(5).random(p.count())
    d = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(start)], "capture_id string, node long, p double")
    s = np.median(e.distance[e.distance > 0])
    w = np.zeros((len(start), len(start)))
    w[e.src, e.dst] = np.exp(-(e.distance**2) / (2 * s * s + 1e-8))
    w /= w.sum(1, keepdims=True) + 1e-8
    x = start
    for _ in range(7):
        x = np.clip(0.82 * w @ x + 0.18 * start, 0, 1)
    got = {r.node: r.p for r in gr.propagate_in_frames(d, edges, G, rounds=7).collect()}
    assert np.allclose([got[i] for i in range(len(start))], x)


def test_persistence_and_guard(spark):
    m = np.zeros((10, 12), bool)
    m[1:4, 1:7], m[6, 2:9], m[8:10, 10] = True, True, True
    d = grid(spark, m, "m").withColumn("p", F.lit(0.3))
    out = sg.persistence_filter(d, "m", "p", 2, 3)
    want = np.zeros_like(m)
    want[1:4, 1:7] = True
    assert (back(out, "m", m.shape).astype(bool) == want).all()
    assert np.allclose(back(out, "p", m.shape).astype(float), np.where(m & ~want, 0.5, 0.3))
    for p, kept in ((0.57, False), (0.55, True)):
        full = sg.coverage_guard(grid(spark, np.ones((3, 3), bool), "m").withColumn("p", F.lit(p)), "m", "p").first()
        assert full.m is kept and full.guarded is not kept
    assert sg.least_spans(1e6, 256, 400, 16, 20, 10_000.0, 130.0) == (3, 2)


def test_principal_scores_and_position(spark):
    rng = np.random.default_rng(0)
    pr, pc = (a.ravel().astype(float) for a in np.mgrid[0:9, 0:11])
    x = rng.normal(size=(99, 5)) @ rng.normal(size=(5, 8))
    s = arrays.principal_scores(x, 3)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]
    assert np.allclose(s.var(0), want) and np.allclose(np.cov(s.T, bias=True), np.diag(want))
    b = arrays.position_basis(pr, pc, 9, 11)
    assert b.shape == (99, 16) and np.allclose(b[:, 0], 1)
    trend = np.outer(20 * b[:, 1], np.ones(8))
    left = arrays.drop_position_components(x + trend, b[:, 1:])
    assert abs(np.corrcoef(left.sum(1), b[:, 1])[0, 1]) < 0.3 < abs(np.corrcoef((x + trend).sum(1), b[:, 1])[0, 1])
    assert np.allclose(arrays.drop_position_components(x, b[:, 1:], 2.0), x - x.mean(0))


def test_region_masks_find_the_block(spark):
    on, p = scene(spark)
    d = rg.region_mask(p, G)
    got = patch_map(d, "mask", on.shape).astype(bool)
    score = patch_map(d, "score", on.shape).astype(float)
    assert got.any() and score[on].mean() > score[~on].mean() and score.min() >= 0 and score.max() <= 1
    simple = patch_map(rg.simple_region_mask(p, G), "score", on.shape).astype(float)
    assert simple.min() >= 0 and simple.max() <= 1
