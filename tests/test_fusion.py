"""Patch scores on cells and fused sub-bands, against plain versions."""

import numpy as np

from skywave.config import PatchFusion
from skywave.functions import quantiles as q
from skywave.operators import patches as pt
from skywave.plans import fusion

GROUP = ["capture_id", "frame_id", "chunk_index"]


def resized(m, n, axis, mode):
    """One axis of m at n places, a loop a place."""
    m = np.moveaxis(m, axis, 0)
    p, out = len(m), []
    for i in range(n):
        at = (i + 0.5) * p / n
        if mode == "nearest":
            out.append(m[min(int(at), p - 1)])
            continue
        reach = max(p / n, 1)
        w = [max(0, 1 - abs(k + 0.5 - at) / reach) for k in range(p)]
        out.append(sum(a * b for a, b in zip(w, m, strict=True)) / sum(w))
    return np.moveaxis(np.array(out), 0, axis)


def scaled(x, low=0.05, high=0.95, of=None):
    lo, hi = np.quantile(x if of is None else x[of], [low, high])
    return np.clip((x - lo) / ((hi if hi > lo else lo + 1e-6) - lo), 0, 1)


def mean_box(x, a, b):
    y = np.pad(x, ((a // 2,) * 2, (b // 2,) * 2), mode="edge")
    return np.array([[y[i : i + a, j : j + b].mean() for j in range(x.shape[1])] for i in range(x.shape[0])])


def voted(m, least):
    first = mean_box(m.astype(float), 3, 3) * 9 > 4.5
    large, seen = np.zeros_like(m), np.zeros_like(m)
    for start in np.argwhere(first):
        part, todo = [], [tuple(start)]
        while todo:
            i, j = todo.pop()
            if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and first[i, j] and not seen[i, j]:
                seen[i, j] = True
                part.append((i, j))
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        if len(part) >= least:
            large[tuple(np.array(part).T)] = True
    return large | (first & (mean_box(first.astype(float), 3, 3) * 9 > 4.5))


def evidence(x, sup):
    pick = x[sup] if sup.any() else x.ravel()
    a, b = np.quantile(pick, [0.85, 0.97])
    top = np.sort(pick)[-max(4, int(np.ceil(0.02 * pick.size))) :].mean()
    share = sup.mean() if sup.any() else 1.0
    return max(0.05, min(1, (0.6 * max(b - a, 0) + 0.4 * max(top - a, 0)) / 0.12) * (0.25 + 0.75 * min(1, (share / 0.03) ** 0.5)))


def scene(seed, rows=20, cols=24, ph=5, pw=6):
    rng = np.random.default_rng(seed)
    return {"power_db": rng.normal(0, 3, (rows, cols)) + 20 * (np.add.outer(np.arange(rows), np.zeros(cols)) // 6 == 1), "gate": rng.random((rows, cols)), "residual": rng.random((rows, cols)) ** 4}, rng.random((ph, pw)) ** 3


def tables(spark, scenes, first_row):
    cells, maps = [], []
    for k, (maps_of, scores) in enumerate(scenes):
        for (i, j), v in np.ndenumerate(maps_of["power_db"]):
            cells.append(("a", 0, k, first_row + i, j, float(v), float(maps_of["gate"][i, j]), float(maps_of["residual"][i, j]), i > 1))
        maps += [("a", 0, k, i, j, float(v)) for (i, j), v in np.ndenumerate(scores)]
    return spark.createDataFrame(cells, "capture_id string, frame_id int, chunk_index int, f int, t int, power_db double, gate double, residual double, valid boolean"), spark.createDataFrame(maps, "capture_id string, frame_id int, chunk_index int, pr int, pc int, score double")


def test_patch_maps_on_cells(spark):
    scenes = [scene(1), scene(2, 7, 5, 9, 3)]  # the second one shrinks in frequency
    cells, maps = tables(spark, scenes, 100)
    for rows, cols in (("bilinear", "nearest"), ("bilinear", "bilinear"), ("nearest", "nearest")):
        got = {(r.chunk_index, r.f - 100, r.t): r.v for r in pt.spread_patches(cells, maps, "score", "v", rows, cols, GROUP).collect()}
        for k, (power, scores) in enumerate(scenes):
            n, m = power["power_db"].shape
            want = resized(resized(scores, m, 1, cols), n, 0, rows)
            assert np.allclose([[got[k, i, j] for j in range(m)] for i in range(n)], want)


def plain_fused(m, scores, valid, gated, s):
    """What a sub-band of 20 x 24 cells and 5 x 6 patches gives, step by step."""
    x = m["power_db"]
    p = np.clip(resized(resized(scores, 24, 1, "nearest"), 20, 0, "bilinear"), 0, 1)
    lin = 10 ** (x / 10)
    rel = np.clip(10 * np.log10(lin / np.quantile(lin[valid], 0.3)), -5, 25)
    power = scaled(np.where(valid, np.maximum(rel - mean_box(rel, 9, 33), 0), 0))
    companion = np.zeros(x.shape)
    if gated:
        res = scaled(m["residual"], 0.05, 0.99)
        companion = scaled(0.45 * res + 0.35 * scaled(np.maximum(res - mean_box(res, 1, 5), 0), 0.05, 0.99) + 0.20 * scaled(m["gate"], 0.05, 0.99), 0.05, 0.99)
    raw = scaled(p * (0.75 + 0.25 * power)) * (0.3 + 0.7 * companion)
    strict, support = scaled(raw), scaled(0.7 * p + 0.3 * companion)
    sup, mask = voted(support >= np.quantile(support, s.support_quantile), 3), voted(strict >= np.quantile(strict, s.score_quantile), 6)
    blocks = lambda y: y.reshape(5, 4, 6, 4).mean((1, 3))
    w = evidence(blocks(raw), blocks(sup.astype(float)) >= 0.5)
    calibrated = np.where(valid, scaled(strict, 0.60, 0.99, valid), 0)
    return {"score": strict, "calibrated": calibrated, "contribution": calibrated * w, "companion": companion * w, "mask": mask, "support": support * w >= 0.5, "weight": w}


def test_fused_sub_band_against_a_plain_version(spark):
    scenes, s = [scene(3), scene(4)], PatchFusion()
    cells, maps = tables(spark, scenes, 40)
    valid = np.zeros((20, 24), bool)
    valid[2:] = True
    for gated in (False, True):
        got = {(r.chunk_index, r.f - 40, r.t): r for r in fusion.fuse_patch_scores(cells, maps, 24, s, gated, GROUP).collect()}
        for k, (m, scores) in enumerate(scenes):
            want = plain_fused(m, scores, valid, gated, s)
            for (i, j), v in np.ndenumerate(want["score"]):
                r = got[k, i, j]
                assert np.allclose((r.score, r.weight), (v, want["weight"])) and np.allclose([r[c] for c in ("calibrated", "contribution", "companion")], [want[c][i, j] for c in ("calibrated", "contribution", "companion")])
                assert (r.mask, r.support) == (bool(want["mask"][i, j]), bool(want["support"][i, j]))


def test_evidence_without_support_or_scores(spark):
    rows = [("a", 0, float(i) / 100, False) for i in range(100)] + [("b", 0, None, True), ("b", 0, float("nan"), True)] + [("c", 0, float(i) / 100, i == 99) for i in range(100)]
    got = {r.capture_id: r for r in q.sparse_evidence(spark.createDataFrame(rows, "capture_id string, frame_id int, s double, sup boolean"), "s", q.F.col("sup")).collect()}
    x = np.arange(100) / 100
    assert np.isclose(got["a"].weight, evidence(x, np.zeros(100, bool))) and got["a"].support_fraction == 1
    assert got["b"].weight == 0 and got["b"].support_fraction == 0 and got["b"].top_mean == 0
    assert np.isclose(got["c"].weight, 0.05) and np.isclose(got["c"].support_fraction, 0.01)
