"""The merge of sub-bands into the whole band, and what leads to it, against plain versions."""

import numpy as np
import pytest
from test_fusion import mean_box, plain_fused, resized, scaled, scene, voted

from skywave.config import Grouping, LayeredFusion, PatchFusion
from skywave.operators import components as cp
from skywave.plans import fusion

BANDS = [(0, 20), (14, 34), (28, 48)]
SHAPE = (50, 24)
CELLS = "capture_id string, frame_id int, chunk_index int, f int, t int"


def weights(n):
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    return (0.2 + 0.8 * h / h.max())[:, None]


def robust(x, q):
    if not x.size:
        return 1.0
    cut = np.quantile(x, q)
    below = x[x < 0.9995]
    return cut if cut < 0.9995 else (np.quantile(below, min(q, 0.90)) if below.size else 0.9995)


def plain_merge(parts, valid, q, least):
    base, total, weight, support = np.zeros(SHAPE), np.zeros(SHAPE), np.zeros(SHAPE), np.zeros(SHAPE, bool)
    for (a, b), p in zip(BANDS, parts, strict=True):
        w = weights(b - a)
        base[a:b] = np.maximum(base[a:b], w * p["contribution"])
        total[a:b] += w * p["companion"]
        weight[a:b] += w
        support[a:b] |= p["support"]
    companion = total / np.maximum(weight, 1e-6)
    score = scaled(base * (0.3 + 0.7 * scaled(companion)))
    rows = np.repeat(valid[:, None], SHAPE[1], 1)
    over = (score >= robust(score[rows & support], q)) & support
    return {"base": base, "companion": companion, "score": np.where(rows, score, 0), "support": support & rows, "over": over, "mask": voted(over, least) & rows}


def plain_boxes(band, valid, g):
    """Seeds, closed by a rectangle, holes filled, a row for each component."""
    rows = np.repeat(valid[:, None], SHAPE[1], 1)
    seed = rows & (band["mask"] | (band["support"] & (band["score"] >= robust(band["score"][rows & band["support"]], 0.72))))
    spread = lambda m, keep: np.array([[keep(m, i, j) for j in range(SHAPE[1])] for i in range(SHAPE[0])])
    around = [(di, dj) for di in range(-(g.bridge_f // 2), g.bridge_f // 2 + 1) for dj in range(-(g.bridge_t // 2), g.bridge_t // 2 + 1)]
    inside = lambda i, j: 0 <= i < SHAPE[0] and 0 <= j < SHAPE[1]
    wide = spread(seed, lambda m, i, j: any(inside(i + a, j + b) and m[i + a, j + b] for a, b in around))
    closed = spread(wide, lambda m, i, j: all(inside(i + a, j + b) and m[i + a, j + b] for a, b in around))
    open_air = [p for p in parts_of(~closed) if any(i in (0, SHAPE[0] - 1) or j in (0, SHAPE[1] - 1) for i, j in p)]
    filled = np.ones(SHAPE, bool)
    for p in open_air:
        filled[tuple(np.array(p).T)] = False
    floor = np.quantile(band["score"][seed], 0.5) if seed.any() else 0
    out = []
    for p in parts_of(filled):
        f, t = np.array(p).T
        box = (f.min(), f.max() + 1, t.min(), t.max() + 1)
        values = band["score"][f, t]
        spans = box[1] - box[0], box[3] - box[2]
        keep = len(p) >= g.min_size and spans[0] >= g.min_f and spans[1] >= g.min_t and (len(p) / (spans[0] * spans[1]) >= g.min_density or values.max() >= floor)
        out.append((*map(int, box), len(p), round(float(values.mean()), 8), bool(keep)))
    return sorted(out)


def parts_of(m):
    seen, out = np.zeros_like(m), []
    for start in np.argwhere(m):
        part, todo = [], [tuple(start)]
        while todo:
            i, j = todo.pop()
            if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and m[i, j] and not seen[i, j]:
                seen[i, j] = True
                part.append((i, j))
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        if part:
            out.append(part)
    return out


def band_tables(spark, valid):
    chunks = spark.createDataFrame([("a", k, a, b) for k, (a, b) in enumerate(BANDS)], "capture_id string, chunk_index int, row_start int, row_stop int")
    return chunks, spark.createDataFrame([("a", 0, i, j, bool(valid[i])) for i in range(SHAPE[0]) for j in range(SHAPE[1])], "capture_id string, frame_id int, f int, t int, valid boolean")


def same(rows, want, names):
    got = {n: np.zeros(SHAPE) for n in names}
    assert len(rows) == SHAPE[0] * SHAPE[1]
    for r in rows:
        for n in names:
            got[n][r.f, r.t] = float(r[n])
    for n in names:
        assert np.allclose(got[n], want[n].astype(float), atol=1e-9), n


def test_merge_of_contributions_takes_the_largest_and_the_mean_companion(spark):
    rng = np.random.default_rng(1)
    valid = np.ones(SHAPE[0], bool)
    valid[[0, 1, 49]] = False
    parts = [{"contribution": rng.random((b - a, 24)) ** 3, "companion": rng.random((b - a, 24)), "support": rng.random((b - a, 24)) > 0.4} for a, b in BANDS]
    rows = [("a", 0, k, a + i, j, float(p["contribution"][i, j]), float(p["companion"][i, j]), bool(p["support"][i, j])) for k, ((a, b), p) in enumerate(zip(BANDS, parts, strict=True)) for i in range(b - a) for j in range(24)]
    chunks, frame = band_tables(spark, valid)
    got = fusion.merge_contributions(spark.createDataFrame(rows, f"{CELLS}, contribution double, companion double, support boolean"), chunks, frame, 0.85, 6)
    same(got.collect(), plain_merge(parts, valid, 0.85, 6), ("base", "companion", "score", "support", "over", "mask"))


def test_fused_band_and_its_boxes_with_gates(spark):
    s = PatchFusion()
    valid = np.ones(SHAPE[0], bool)
    valid[:2] = False
    scenes = [scene(k) for k in (5, 6, 7)]
    for k, (_, scores) in enumerate(scenes):  # few high patches, so that sub-bands have evidence
        scores *= 0.05
        scores[1:4, 1 + k : 4 + k] = [[0.3, 0.35, 0.3], [0.6, 1.0, 0.4], [0.3, 0.9, 0.3]]
    cells = [("a", 0, k, a + i, j, float(m["power_db"][i, j]), float(m["gate"][i, j]), float(m["residual"][i, j]), bool(valid[a + i])) for k, ((a, _), (m, _)) in enumerate(zip(BANDS, scenes, strict=True)) for i in range(20) for j in range(24)]
    maps = [("a", 0, k, i, j, float(v)) for k, (_, scores) in enumerate(scenes) for (i, j), v in np.ndenumerate(scores)]
    chunks, frame = band_tables(spark, valid)
    band = fusion.fused_band(
        spark.createDataFrame(cells, f"{CELLS}, power_db double, gate double, residual double, valid boolean"), spark.createDataFrame(maps, "capture_id string, frame_id int, chunk_index int, pr int, pc int, score double"), chunks, frame, 24, s, True
    )
    want = plain_merge([plain_fused(m, p, np.repeat(valid[a:b, None], 24, 1), True, s) for (a, b), (m, p) in zip(BANDS, scenes, strict=True)], valid, s.score_quantile, s.min_component)
    same(band.collect(), want, ("base", "companion", "score", "support", "mask"))
    for g in (Grouping(5, 3, 12, 4, 2, 0.06), Grouping(3, 1, 4, 2, 2, 0.6)):
        boxes = sorted((r.freq_start, r.freq_stop, r.time_start, r.time_stop, r.filled_area, round(r.score_mean, 8), r.keep) for r in fusion.merged_boxes(band, g, 1).collect())
        assert boxes == plain_boxes(want, valid, g) and {b[-1] for b in boxes} == {True, False}


def bilinear(m, rows, cols):
    return resized(resized(m, cols, 1, "bilinear"), rows, 0, "bilinear")


def unspeckled(mask, least):
    sizes = [len(p) for p in parts_of(mask)]
    return sum(n for n in sizes if n >= least) / max(sum(sizes), 1)


def top_overlap(a, b):
    return (a & b).sum() / max((a | b).sum(), 1)


def plain_layers(m, s):
    gate = lambda x: scaled(scaled(x) * (s.gate_floor + (1 - s.gate_floor) * scaled(m["gate"])))
    own, power, tex, structure, raw = (scaled(x) for x in (gate(m["score"]), gate(m["power"]), m["texture"], m["gate"], m["power"]))
    agree = np.sqrt(np.maximum(own * power, 0))
    q = np.quantile(tex, [0.2, 0.6, 0.85, 0.95])
    top = tex >= q[2]
    peak = np.clip((q[3] - q[1]) / max(q[3] - q[0], 1e-6), 0, 1)
    r = np.clip(0.35 * peak + 0.25 * unspeckled(top, 6) + 0.20 * agree[top].mean() + 0.20 * top_overlap(top, agree >= np.quantile(agree, 0.85)), 0, 1)
    speckle = unspeckled(structure >= np.quantile(structure, 0.70), max(4, round(4 + 4 * r)))
    if speckle >= s.clean_speckle:
        let = 0.25 + 0.75 * np.clip((speckle - s.clean_speckle) / (1 - s.clean_speckle), 0, 1)
    elif speckle >= s.strong_speckle:
        let = 0.05 + 0.20 * (speckle - s.strong_speckle) / (s.clean_speckle - s.strong_speckle)
    else:
        let = 0.05
    let = max(let, s.gap_floor)
    band = np.clip((speckle - s.strong_speckle) / (s.clean_speckle - s.strong_speckle), 0, 1)
    strong, mid, low = 0.44 + 0.12 * r, 0.24 + 0.10 * r, 0.10 + 0.08 * r
    mid_top, low_top = min(1, strong + np.clip(0.15 * (strong - mid), 0.012, 0.035)), min(1, mid + np.clip(0.15 * (mid - low), 0.012, 0.030))
    pick = lambda ok: scaled(np.where(ok, agree, 0.0))
    bands = np.clip(pick(agree >= strong) + band * (pick((agree >= mid) & (agree < mid_top)) + pick((agree >= low) & (agree < low_top))), 0, 1)
    final = scaled(np.clip(bands + let * tex, 0, 1))
    rescue = np.clip((mean_box(raw, 3, 3) - s.rescue_floor) / (1 - s.rescue_floor), 0, 1) * (agree >= low)
    cut, least = (s.threshold, s.min_component) if band < 1 else (s.threshold_clean, s.min_component_clean)
    mask = np.zeros(final.shape, bool)
    for p in parts_of(final >= cut):
        if len(p) >= least:
            mask[tuple(np.array(p).T)] = True
    companion = scaled(let * tex + (1 - let) * m["companion"])
    sup = scaled(0.55 * final + 0.25 * agree + 0.20 * companion)
    support = voted((sup >= np.quantile(sup, s.support_quantile)) | mask, 3)
    structure = np.clip(structure + s.rescue_gain * max(0.45 + 0.12 * r - low, 0.05) * rescue, 0, 1)
    return {"agreement": agree, "final": final, "mask": mask, "support": support, "companion": companion, "rescued_structure": structure}, bool(band < 1), (r, let, band)


def layered_scenes():
    rng = np.random.default_rng(2)
    grid = lambda: rng.random((10, 12))
    smooth = np.add.outer(np.linspace(0, 1, 10), np.linspace(0, 0.3, 12))
    some = smooth * 0.6 + 0.4 * grid()
    base = [{"score": 0.5 * grid() + 0.5 * smooth, "power": grid() ** 2 + smooth, "texture": grid(), "companion": grid(), "gate": g} for g in (smooth, some, grid())]
    return base


def test_layered_sub_bands_by_how_much_they_speckle(spark):
    s, scenes = LayeredFusion(), layered_scenes()
    names = list(scenes[0])
    rows = [("a", 0, k, i, j, *(float(m[n][i, j]) for n in names)) for k, m in enumerate(scenes) for i in range(10) for j in range(12)]
    patches = spark.createDataFrame(rows, f"{CELLS}, " + ", ".join(f"{n} double" for n in names))
    got = {(r.chunk_index, r.f, r.t): r for r in fusion.layer_patches(patches, s).collect()}
    active, parts = [], []
    for k, m in enumerate(scenes):
        want, speckles, policy = plain_layers(m, s)
        active.append(speckles)
        r = got[k, 0, 0]
        assert np.allclose((r.reliability, r.texture_weight, r.band_weight), policy) and r.speckle_active == speckles
        for n, x in want.items():
            assert np.allclose([[float(got[k, i, j][n]) for j in range(12)] for i in range(10)], x.astype(float)), (k, n)
        parts.append({"contribution": bilinear(want["final"], 20, 24), "companion": bilinear(want["companion"], 20, 24), "support": resized(resized(want["support"].astype(float), 24, 1, "nearest"), 20, 0, "nearest") >= 0.5})
    assert active[0] is False and active[2] is True  # both settings are met
    chunks, frame = band_tables(spark, np.ones(SHAPE[0], bool))
    cells = spark.createDataFrame([("a", 0, k, a + i, j) for k, (a, _) in enumerate(BANDS) for i in range(20) for j in range(24)], CELLS)
    same(fusion.layered_band(cells, patches, chunks, frame, s).collect(), plain_merge(parts, np.ones(SHAPE[0], bool), 0.85, 6), ("base", "companion", "score", "support", "mask"))


def test_band_merged_again_after_texture(spark):
    scenes = layered_scenes()
    for m in scenes:
        m["support"], m["strict"] = m["power"], m["score"] * m["companion"]
    names = list(scenes[0])
    rows = [("a", 0, k, i, j, *(float(m[n][i, j]) for n in names)) for k, m in enumerate(scenes) for i in range(10) for j in range(12)]
    patches = spark.createDataFrame(rows, f"{CELLS}, " + ", ".join(f"{n} double" for n in names))
    rng = np.random.default_rng(3)
    marks = [rng.random((20, 24)) > 0.5 for _ in BANDS]
    cells = spark.createDataFrame([("a", 0, k, a + i, j, bool(marks[k][i, j])) for k, (a, _) in enumerate(BANDS) for i in range(20) for j in range(24)], f"{CELLS}, support boolean")
    parts = []
    for m, mark in zip(scenes, marks, strict=True):
        agree = np.sqrt(scaled(m["score"]) * scaled(m["power"]))
        x, y = scaled(m["texture"]), scaled(agree)
        top = x >= np.quantile(x, 0.90)
        peak = np.clip((x[top].mean() - np.median(x)) / 0.5, 0, 1)
        trust = np.clip(0.35 * peak + 0.25 * unspeckled(top, 3) + 0.20 * y[top].mean() + 0.20 * top_overlap(top, y >= np.quantile(y, 0.85)), 0, 1)
        g = scaled(m["gate"])
        speckle = unspeckled(g >= np.quantile(g, 0.85), 3)
        let = 0.25 + 0.75 * np.clip((speckle - 0.96) / 0.04, 0, 1) if speckle >= 0.96 else 0.05 + 0.20 * (speckle - 0.5) / 0.46 if speckle >= 0.5 else 0.02 + 0.03 * np.clip(speckle / 0.5, 0, 1)
        again = scaled(scaled(m["strict"]) + np.clip(trust * let, 0, 1) * m["texture"] * np.clip(0.35 + 0.65 * scaled(m["support"]), 0, 1))
        parts.append({"contribution": scaled(bilinear(again, 20, 24), 0.60, 0.99), "companion": bilinear(scaled(m["companion"]), 20, 24), "support": mark})
    chunks, frame = band_tables(spark, np.zeros(SHAPE[0], bool))  # rows all count
    same(fusion.texture_band(cells, patches, chunks, frame).collect(), plain_merge(parts, np.ones(SHAPE[0], bool), 0.88, 6), ("base", "companion", "score", "support", "mask"))


@pytest.mark.parametrize("eight", [False, True])
def test_components_in_bands_have_the_same_numbers(spark, eight):
    rng = np.random.default_rng(7)
    rows = []
    for k, share in enumerate((0.35, 0.55, 0.62)):
        m = rng.random((23, 31)) < share
        if k == 1:
            m[:, 5] = True  # across all bands
        rows += [(f"c{k}", 0, i, j, bool(v)) for (i, j), v in np.ndenumerate(m)]
    d = spark.createDataFrame(rows, "capture_id string, frame_id int, f int, t int, m boolean")
    want = sorted(map(tuple, cp.connected_components(d, "m", eight).collect()))
    for band in (1, 4):
        assert sorted(map(tuple, cp.connected_components(d, "m", eight, band=band).collect())) == want
    assert cp.connected_components(d.where("1 = 0"), "m", eight, band=4).count() == 0
