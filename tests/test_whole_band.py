"""The coherent-power detector as a whole: both of its forms against a plain version written from its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signal import grid, label, plain_split, votes

from skywave.config import BAND_GROUPING, Chunking, CoherentPower, FrontEnd, Grouping
from skywave.operators.components import group_frames, group_regions
from skywave.plans.detect import coherent_power_boxes, floor_boxes

FREQ = 1e8 + np.arange(64) * 1e5
PLAN = Chunking(bandwidth_hz=2.4e6, overlap_hz=0.6e6, min_rows=8)
SMALL = Grouping(bridge_f=5, bridge_t=3, min_size=24, min_f=4, min_t=2, min_density=0.06)


def smoother(n, w):
    """The matrix of a sliding weighted sum with edge values repeated."""
    m, r = np.zeros((n, n)), len(w) // 2
    for k, v in enumerate(w):
        m[np.arange(n), np.clip(np.arange(n) + k - r, 0, n - 1)] += v
    return m


def bell(sigma):
    at = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    w = np.exp(-(at**2) / (2 * sigma**2))
    return w / w.sum(), at


def filtered(x, wf, wt):
    return smoother(x.shape[0], wf) @ x @ smoother(x.shape[1], wt).T


def norm(x, low, high, of=None):
    pick = x.ravel() if of is None else x[of]
    if not pick.size:
        return np.zeros_like(x)
    lo, hi = np.quantile(pick, [low / 100, high / 100])
    y = np.clip((x - lo) / (max(hi, lo + 1e-6) - lo), 0, 1)
    return y if of is None else y * of


def robust(x, q):
    if not x.size:
        return 1.0
    cut, under = np.quantile(x, q), x[x < 0.9995]
    return cut if cut < 0.9995 else np.quantile(under, min(q, 0.9)) if under.size else 0.9995


def smoothed(m, least):
    m = votes(m)
    parts, n = label(m)
    for k in range(1, n + 1):
        if (parts == k).sum() < least:
            m = np.where(parts == k, votes((parts > 0)), m)
    return m.astype(bool)


def plain_tile(x, valid, d):
    rows = np.repeat(valid[:, None], x.shape[1], 1)
    lin = 10 ** (x / 10)
    level = np.clip(10 * np.log10(lin / np.quantile(lin[rows], d.power_floor_quantile)), -5, 25)
    power = norm(np.maximum(level - filtered(level, np.ones(d.box_f) / d.box_f, np.ones(d.box_t) / d.box_t), 0) * rows, 5, 95)
    sizes = [max(9, 2 * max(1, n // 24) + 1) for n in x.shape]
    stands = norm(np.maximum(x - filtered(x, *(np.ones(n) / n for n in sizes)), 0), 5, 99)
    runs = np.zeros_like(x)
    for s in d.scales:
        w, at = bell(s)
        gf, gt = filtered(stands, w * -at / s**2, w), filtered(stands, w, w * -at / s**2)
        k = bell(max(1, 1.8 * s))[0]
        a, b, c = filtered(gf * gf, k, k), filtered(gf * gt, k, k), filtered(gt * gt, k, k)
        runs = np.maximum(runs, norm(np.sqrt((a - c) ** 2 + 4 * b**2) / np.maximum(a + c, 1e-6), 5, 99))
    runs = norm(runs, 5, 99)
    score = norm(d.coherence_weight * runs + d.power_weight * power, 5, 95)
    support = smoothed((score >= robust(score[rows], d.support_quantile)) & rows, max(3, d.min_component // 2)) & rows
    mask = smoothed((score >= robust(score[support], d.mask_quantile)) & support, d.min_component) & rows
    return runs * rows, power * rows, score * rows, support, mask


def plain_parts(mask, score, s):
    """[(role, cells, kept, density)] of a bridged mask."""
    h, w = mask.shape
    half = s.bridge_f // 2
    at = lambda m, i, j: 0 <= i < h and bool(m[i, j])
    wide = np.array([[any(at(mask, i + k, j) for k in range(-half, half + 1)) for j in range(w)] for i in range(h)])
    closed = np.array([[all(at(wide, i + k, j) for k in range(-half, half + 1)) for j in range(w)] for i in range(h)])
    bridged = closed.copy()
    for i in range(h):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], closed[i].astype(int), [0])))).reshape(-1, 2)
        for (a, b), (c, e) in zip(edges[:-1], edges[1:], strict=True):
            if c - b <= s.bridge_t and (b - a + e - c) / (e - a) >= s.continuity:
                bridged[i, b:c] = True
    floor = np.quantile(score[mask], 0.5) if mask.any() else 0
    parts, n = label(bridged)
    out = []
    for k in range(1, n + 1):
        for role, m in plain_split(parts == k, s.min_f, s.min_t):
            f, t = np.nonzero(m)
            density = len(f) / sum(np.ptp(f[t == c]) + 1 for c in set(t))
            kept = len(f) >= s.min_size and np.ptp(f) + 1 >= s.min_f and np.ptp(t) + 1 >= s.min_t and density >= s.min_density and score[m].max() >= floor
            out.append((role, m, kept, density))
    return out


def bounds(m):
    f, t = np.nonzero(m)
    return int(f.min()), int(f.max()) + 1, int(t.min()), int(t.max()) + 1


def touch(a, b):
    return a[0] < b[1] and b[0] < a[1] and a[2] < b[3] and b[2] < a[3]


def plain_plan(valid, plan):
    rows, out, start = np.flatnonzero(valid), [], FREQ[valid].min()
    while True:
        stop = min(start + plan.bandwidth_hz, FREQ[valid].max())
        inside = [f for f in rows if np.float32(start) <= np.float32(FREQ[f]) <= np.float32(stop)]
        if len(inside) >= plan.min_rows:
            out.append((inside[0], inside[-1] + 1))
        if stop >= FREQ[valid].max():
            return out
        start += plan.bandwidth_hz - plan.overlap_hz


def plain_boxes(x, sideband_rows, s, d=CoherentPower(), front=FrontEnd()):
    valid = np.ones(len(x), bool)
    valid[:sideband_rows] = valid[len(x) - sideband_rows :] = False
    response = smoother(len(x), bell(front.smooth_sigma)[0]) @ np.quantile(x, front.row_quantile, axis=1)
    x = x + np.clip(np.quantile(response[valid], front.reference_quantile) - response, 0, front.max_boost_db)[:, None]
    sums, weight, support, kept, boxes = np.zeros((2, *x.shape)), np.zeros(x.shape), np.zeros(x.shape, bool), np.zeros(x.shape, bool), []
    for a, b in plain_plan(valid, PLAN):
        runs, power, score, sup, mask = plain_tile(x[a:b], valid[a:b], d)
        hann = np.hanning(b - a)
        w = ((0.2 + 0.8 * hann / hann.max()) * valid[a:b])[:, None]
        sums[0, a:b] += w * runs
        sums[1, a:b] += w * power
        weight[a:b] += w
        support[a:b] |= sup
        for role, m, ok, _ in plain_parts(mask, score, s):
            if ok:
                kept[a:b] |= m
                f0, f1, t0, t1 = bounds(m)
                boxes.append(((f0 + a, f1 + a, t0, t1), int(m.sum()), score[m].mean(), role))
    rows = np.repeat(valid[:, None], x.shape[1], 1)
    mix = (d.coherence_weight * sums[0] + d.power_weight * sums[1]) / np.maximum(weight, 1e-12)
    score = norm(mix, 5, 95, rows & (weight > 0))
    support &= rows
    mask = smoothed((score >= robust(score[support], d.mask_quantile)) & support, d.min_component) & rows
    whole = lambda origin, m, sources: [(origin, *bounds(p), int(p.sum()), round(score[p].mean(), 7), r, sum(touch(bounds(p), q[0]) for q in sources)) for r, p, ok, _ in plain_parts(m, score, s) if ok]
    out = []
    if any(b[3] != "unsplit" for b in boxes):
        groups = [[b] for b in boxes]
        linked = lambda a, b: touch(a[0], b[0]) and {a[3], b[3]} != {"persistent_carrier", "transient_wideband_burst"}
        while True:
            pair = next(((i, j) for i in range(len(groups)) for j in range(i) if any(linked(a, b) for a in groups[i] for b in groups[j])), None)
            if pair is None:
                break
            groups[pair[1]] += groups.pop(pair[0])
        for g in groups:
            area = sum(b[1] for b in g)
            edge = [fold(b[0][i] for b in g) for i, fold in enumerate((min, max, min, max))]
            out.append(("overlap", *edge, area, round(sum(b[1] * b[2] for b in g) / area, 7), g[0][3] if len({b[3] for b in g}) == 1 else "mixed", len(g)))
    elif boxes:
        out = whole("regrouped", kept & rows, boxes)
    if not out:
        out = whole("seeds", rows & (mask | (support & (score >= robust(score[support], d.seed_quantile)))), [])
    return sorted(out)


def scene(kind):
    x = np.random.default_rng(4).normal(0, 1, (64, 60))
    if kind in ("carrier", "both"):
        x[28:36] += 25
    if kind in ("burst", "both"):
        x[8:56, 30:34] += 25
    if kind == "edge":
        x[2:9, 10:50] += 20  # beside the side band
    return x


@pytest.mark.parametrize("kind", ["carrier", "burst", "both", "none", "edge"])
def test_whole_band_boxes_equal_a_plain_version(spark, kind):
    x = scene(kind)
    axis = spark.createDataFrame([("c", f, float(FREQ[f])) for f in range(64)], "capture_id string, f int, freq_hz double")
    origins = set()
    for sideband, s in ((2, SMALL), (0, SMALL), (2, BAND_GROUPING)):
        want = plain_boxes(x, sideband, s)
        origins |= {w[0] for w in want}
        for in_tasks in (True, False) if (sideband, s) == (2, SMALL) and kind in ("both", "edge") else (True,):
            got = coherent_power_boxes(grid(spark, x), axis, sideband_hz=sideband * 1e5, chunking=PLAN, grouping=s, frames_in_tasks=in_tasks).collect()
            found = sorted((r.origin, r.freq_start, r.freq_stop, r.time_start, r.time_stop, r.filled_area, round(r.score_mean, 7), r.split_role, r.n_boxes) for r in got)
            assert found == want, (sideband, in_tasks)
    assert origins


@pytest.mark.parametrize("in_tasks", [True, False])
def test_grouped_frames_equal_a_plain_version(spark, in_tasks):
    rng = np.random.default_rng(12)
    d, want = None, []
    for k in range(4):
        x = rng.random((40, 44))
        m = np.zeros(x.shape, bool)
        m[10 : 10 + (4, 6, 1, 20)[k], 3:40] = True
        m[4:38, 20 : 20 + (2, 3, 2, 8)[k]] = True
        m &= rng.random(m.shape) < 0.93
        x[m] += 1
        s = Grouping(5, 3, 20, 4, 2, 0.2)
        want += [(f"c{k}", r, *bounds(p), int(p.sum()), bool(ok), round(density, 9)) for r, p, ok, density in plain_parts(m, x, s)]
        part = grid(spark, x, "score").withColumn("capture_id", F.lit(f"c{k}")).join(grid(spark, m, "m").select("f", "t", F.col("m").cast("boolean").alias("m")), ["f", "t"])
        d = part if d is None else d.unionByName(part)
    got = (group_frames if in_tasks else group_regions)(d, "m", "score", s).collect()
    assert sorted((r.capture_id, r.split_role, r.freq_start, r.freq_stop, r.time_start, r.time_stop, r.filled_area, r.keep, round(r.density, 9)) for r in got) == sorted(want)
    assert {w[1] for w in want} == {"unsplit", "persistent_carrier", "transient_wideband_burst"}


def test_floor_boxes_by_frames_and_by_windows(spark):
    x = scene("both") - 20
    axis = spark.createDataFrame([("c", f, float(FREQ[f])) for f in range(64)], "capture_id string, f int, freq_hz double")
    a, b = (sorted(map(repr, floor_boxes(grid(spark, x), axis, frames_in_tasks=way).drop("score_mean", "density").collect())) for way in (True, False))
    assert a == b and len(a) > 1
