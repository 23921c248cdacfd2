import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywave.config import Chunking
from skywave.functions import quantiles as q
from skywave.functions import scalars as sc
from skywave.kernels import arrays
from skywave.operators import components as cp
from skywave.operators import graph as gr
from skywave.operators import spectra as sp
from skywave.operators import windows as wn
from skywave.operators.frontend import plan_chunks, valid_rows
from skywave.plans.detect import floor_boxes
from skywave.sources import files
from skywave.sources.tables import write_run
from skywave.streaming import frames as st


def grid(spark, x, name="power_db"):
    rows = [("c", 0, f, t, x[f, t].item()) for f in range(x.shape[0]) for t in range(x.shape[1])]
    kind = "boolean" if x.dtype == bool else "double"
    return spark.createDataFrame(rows, f"capture_id string, frame_id int, f int, t int, {name} {kind}")


def back(df, name, shape):
    out = np.zeros(shape, object)
    for r in df.select("f", "t", name).collect():
        out[r.f, r.t] = r[name]
    return out


def edge_box(x, a, b):
    p = np.pad(x, ((a, a), (b, b)), mode="edge")
    return np.array([[p[i : i + 2 * a + 1, j : j + 2 * b + 1].mean() for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_box_mean_and_convolution(spark):
    x = np.random.default_rng(0).normal(size=(12, 9))
    d = grid(spark, x)
    assert np.allclose(back(wn.box_mean(d, "power_db", "m", 5, 3), "m", x.shape).astype(float), edge_box(x, 2, 1))
    k = wn.gaussian_kernel(1.0)
    w = np.array([v for _, v in k])
    assert np.allclose(back(wn.convolve_axis(d, "power_db", "s", "f", k), "s", x.shape).astype(float), arrays.convolve(x, w, 0))
    p = np.pad(x, ((4, 4), (0, 0)), mode="symmetric")
    mirrored = sum(w[i] * p[i : i + 12] for i in range(9))
    assert np.allclose(back(wn.convolve_axis(d, "power_db", "s", "f", k, mode="mirror"), "s", x.shape).astype(float), mirrored)


def test_blending_a_constant_and_weights(spark):
    d = spark.range(9).select(sc.chunk_blend_weight(F.col("id"), F.lit(9)).alias("w"))
    w = [r.w for r in d.collect()]
    h = np.hanning(9)
    assert np.allclose(w, 0.2 + 0.8 * h / h.max())
    assert spark.range(2).select(sc.chunk_blend_weight(F.col("id"), F.lit(2)).alias("w")).distinct().collect()[0].w == 1.0


def test_normalisers_are_bounded_and_invariant(spark):
    x = np.random.default_rng(1).normal(size=(6, 7))
    a = back(q.normalize_local(grid(spark, x), "power_db", "u"), "u", x.shape).astype(float)
    b = back(q.normalize_local(grid(spark, 3 * x + 5), "power_db", "u"), "u", x.shape).astype(float)
    assert a.min() >= 0 and a.max() <= 1 and np.allclose(a, b)
    assert back(q.normalize_vector(grid(spark, np.ones((3, 3))), "power_db", "u"), "u", (3, 3)).tolist() == [[1.0] * 3] * 3
    nan = np.full((3, 3), np.nan)
    assert back(q.normalize_local(grid(spark, nan), "power_db", "u"), "u", (3, 3)).tolist() == [[0.0] * 3] * 3
    assert q.robust_threshold(grid(spark, nan), "power_db", 0.9).first().threshold == 1.0


def label(mask):
    seen, parts = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if not seen[at]:
            parts += 1
            todo = [at]
            seen[at] = parts
            while todo:
                f, t = todo.pop()
                for n in ((f + 1, t), (f - 1, t), (f, t + 1), (f, t - 1)):
                    if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and not seen[n]:
                        seen[n] = parts
                        todo.append(n)
    return seen, parts


def test_components_match_flood_fill(spark):
    mask = np.random.default_rng(2).random((14, 17)) < 0.55
    cells = cp.component_cells(cp.connected_components(grid(spark, mask, "m"), "m"))
    want, parts = label(mask)
    pairs = {(want[r.f, r.t], r.component) for r in cells.collect()}
    assert len(pairs) == parts == len({b for _, b in pairs})
    sizes = np.bincount(want.ravel())[1:]
    kept = back(cp.remove_small(grid(spark, mask, "m"), "m", "k", 4), "k", mask.shape).astype(bool)
    assert (kept == (mask & np.isin(want, np.flatnonzero(sizes >= 4) + 1))).all()
    bg, _ = label(~mask)
    border = set(np.unique(np.concatenate((bg[0], bg[-1], bg[:, 0], bg[:, -1])))) - {0}
    filled = back(cp.fill_holes(grid(spark, mask, "m"), "m", "k"), "k", mask.shape).astype(bool)
    assert (filled == (mask | ((bg > 0) & ~np.isin(bg, list(border))))).all()


def test_components_do_not_depend_on_partitions(spark):
    mask = np.random.default_rng(3).random((10, 10)) < 0.6
    d = grid(spark, mask, "m")
    once = sorted(map(tuple, cp.connected_components(d, "m").collect()))
    assert sorted(map(tuple, cp.connected_components(d.repartition(11), "m").collect())) == once


def test_closing_keeps_what_is_away_from_edges(spark):
    mask = np.zeros((20, 6), bool)
    mask[8:10, 2], mask[12:13, 2] = True, True
    out = back(wn.closing(grid(spark, mask, "m"), "m", "k", 5, 1), "k", mask.shape).astype(bool)
    assert out[8:13, 2].all() and out.sum() == 5
    again = back(wn.closing(grid(spark, out, "m"), "m", "k", 5, 1), "k", mask.shape).astype(bool)
    assert (again == out).all()


def test_split_of_a_carrier_with_a_burst(spark):
    mask = np.zeros((64, 40), bool)
    mask[20:28, 2:38] = True
    mask[5:60, 18:21] = True
    d = cp.split_components(cp.component_cells(cp.connected_components(grid(spark, mask, "m"), "m")))
    n = {r.split_role: r["count"] for r in d.groupBy("split_role").count().collect()}
    assert n == {"transient_wideband_burst": 55 * 3, "persistent_carrier": 8 * 36}


def test_an_end_to_end_scene(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (64, 48))
    x[20:36, 5:45] += 20
    axis = spark.createDataFrame([("c", f, 1e8 + f * 1e5) for f in range(64)], "capture_id string, f int, freq_hz double")
    kept = floor_boxes(grid(spark, x), axis).where("keep").collect()
    assert len(kept) == 1
    b = kept[0]
    assert abs(b.freq_start - 20) <= 6 and abs(b.freq_stop - 36) <= 6 and b.time_stop - b.time_start >= 5


def test_spectrogram_finds_a_tone(spark):
    n, fs = 2048, 1000.0
    z = np.exp(2j * np.pi * 125.0 * np.arange(n) / fs)
    d = spark.createDataFrame([("c", i, float(z[i].real), float(z[i].imag)) for i in range(n)], "capture_id string, n long, i double, q double")
    out = sp.spectrogram(d, fs, nfft=64, overlap=32).toPandas()
    assert out.seg.nunique() == (n - 64) // 32 + 1
    assert set(out.loc[out.groupby("seg").power_db.idxmax(), "f"]) == {32 + 8}


def test_structure_gate_against_its_definition():
    """The tensor of the background residual, stated by direct sums over clipped neighbours."""
    x = np.random.default_rng(5).normal(0, 0.3, (26, 31))
    x[11:14] += 6

    def at(z, df, dt):
        f, t = np.clip(np.arange(z.shape[0]) + df, 0, z.shape[0] - 1), np.clip(np.arange(z.shape[1]) + dt, 0, z.shape[1] - 1)
        return z[f][:, t]

    def blur(z, sigma, of=0, ot=0):
        r = int(4 * sigma + 0.5)
        w = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}
        total = sum(w.values())
        first = {d: v / total * d / sigma**2 for d, v in w.items()}
        plain = {d: v / total for d, v in w.items()}
        z = sum(v * at(z, d, 0) for d, v in (first if of else plain).items())
        return sum(v * at(z, 0, d) for d, v in (first if ot else plain).items())

    def scaled(z, lo, hi):
        a, b = np.percentile(z, [lo, hi])
        return np.clip((z - a) / (b - a if b > a else 1e-6), 0, 1)

    mean = sum(at(x, a, b) for a in range(-4, 5) for b in range(-4, 5)) / 81
    r = scaled(np.maximum(x - mean, 0), 5, 99)
    coherences, gates = [], []
    for sigma in (0.8, 1.6):
        gf, gt, k = blur(r, sigma, of=1), blur(r, sigma, ot=1), max(1.0, 1.8 * sigma)
        a, b, c = blur(gf * gf, k), blur(gf * gt, k), blur(gt * gt, k)
        roots = np.linalg.eigvalsh(np.stack([np.stack([a, b], -1), np.stack([b, c], -1)], -2))
        coherences.append(scaled((roots[..., 1] - roots[..., 0]) / np.maximum(roots.sum(-1), 1e-6), 5, 99))
        gates.append(coherences[-1] * np.sqrt(scaled(roots.sum(-1), 5, 99)))
    got = arrays.structure_gate(x, (0.8, 1.6))
    assert np.allclose(got[0], np.max(coherences, 0), atol=1e-6) and np.allclose(got[1], scaled(np.max(gates, 0), 5, 99), atol=1e-6)


def votes(m):
    p = np.pad(m.astype(int), 1, mode="edge")
    return sum(p[a : a + m.shape[0], b : b + m.shape[1]] for a in range(3) for b in range(3)) >= 5


def test_smoothing_votes_again_on_small_parts(spark):
    mask = np.random.default_rng(12).random((20, 22)) < 0.5
    want = votes(mask)
    parts, n = label(want)
    small = np.isin(parts, [i for i in range(1, n + 1) if (parts == i).sum() < 6])
    assert small.any()
    want = np.where(small, votes(want), want)
    assert (arrays.smooth_mask(mask, 1, 6) == want).all()
    assert (back(cp.smooth_labels(grid(spark, mask, "m"), "m", "k", 1, 6), "k", mask.shape).astype(bool) == want).all()
    got, count = arrays.label_mask(mask)
    own, parts = label(mask)
    assert count == parts and len({(a, b) for a, b in zip(got.ravel(), own.ravel(), strict=True)}) == parts + 1


def plain_split(m, min_f, min_t):
    """[(role, cells)] of one component, one column after the other."""
    whole = [("unsplit", m)]
    cols = [t for t in range(m.shape[1]) if m[:, t].any()]
    span = {t: np.ptp(np.flatnonzero(m[:, t])) + 1 for t in cols}
    if len(cols) < max(6, 2 * min_t):
        return whole
    usual = np.quantile(list(span.values()), 0.35)
    wide = max(math.ceil(1.8 * usual), math.ceil(usual + max(4, 0.5 * min_f)), min_f)
    if wide >= np.ptp(np.flatnonzero(m.any(1))) + 1:
        return whole
    runs, quiet = [], [t for t in cols if span[t] < wide]
    for t in cols:
        if span[t] >= wide:
            if runs and runs[-1][1] == t:
                runs[-1][1] = t + 1
            else:
                runs.append([t, t + 1])
    runs = [r for r in runs if min_t <= r[1] - r[0] < max(int(0.7 * len(cols)), min_t + 1)]
    hits = m[:, quiet].sum(1) >= max(2, math.ceil(0.45 * len(quiet)))
    rows = [list(g) for k, g in itertools.groupby(range(len(hits)), lambda f: hits[f]) if k]
    if not runs or len(quiet) < max(4, 2 * min_t) or not rows:
        return whole
    best = max(rows, key=len)
    carrier = np.zeros_like(m)
    carrier[best] = m[best]
    if len(best) < max(2, math.floor(usual)) or len(best) >= wide or carrier.sum() < max(2, 2 * min_t):
        return whole
    out = [("persistent_carrier", carrier)]
    for a, b in runs:
        burst = np.zeros_like(m)
        burst[:, a:b] = m[:, a:b]
        out.append(("transient_wideband_burst", burst))
    return out


def test_splits_match_a_plain_version(spark):
    rng = np.random.default_rng(9)
    seen = set()
    for case in range(6):
        mask = np.zeros((50, 36), bool)
        mask[20 : 20 + (6, 1, 30, 6, 6, 14)[case], 2 : (34, 34, 34, 34, 7, 34)[case]] = True
        for a in ((18, 25), (18,), (18,), (10,), (3,), (12, 20, 28))[case]:
            mask[5:46, a : a + (2, 2, 2, 28, 2, 3)[case]] = True
        mask &= rng.random(mask.shape) < 0.97
        parts, n = label(mask)
        want = sorted((role, int(m.sum()), int((np.argwhere(m) @ [100, 1]).sum())) for i in range(1, n + 1) for role, m in plain_split(parts == i, 12, 1))
        d = cp.split_components(cp.component_cells(cp.connected_components(grid(spark, mask, "m"), "m")))
        got = d.groupBy("component", "part", "split_role").agg(F.count("*").alias("n"), F.sum(F.col("f") * 100 + F.col("t")).alias("s")).collect()
        assert sorted((r.split_role, r.n, r.s) for r in got) == want
        seen |= {w[0] for w in want}
    assert len(seen) == 3


def test_chunk_plan_covers_valid_rows(spark):
    axis = spark.createDataFrame([("c", f, 1e8 + f * 1e6) for f in range(100)], "capture_id string, f int, freq_hz double")
    rows = valid_rows(axis, percent=0.05)
    chunks = plan_chunks(rows, Chunking(min_rows=4)).orderBy("chunk_index").collect()
    valid = {r.f for r in rows.where("valid").collect()}
    assert valid == set(range(5, 95))
    assert set(itertools.chain.from_iterable(range(c.row_start, c.row_stop) for c in chunks)) == valid
    assert all(a.row_stop > b.row_start for a, b in itertools.pairwise(chunks))


def test_mutual_edges_are_symmetric(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(0, i, i // 6, i % 6, [float(v) for v in rng.normal(size=4)]) for i in range(36)], "capture_id int, node long, pr int, pc int, x array<double>")
    e = gr.mutual_edges(gr.affinity(gr.knn(p, ["capture_id"], 5), ["capture_id"]), ["capture_id"]).collect()
    pairs = {(r.src, r.dst) for r in e}
    assert pairs and pairs == {(b, a) for a, b in pairs}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_of_one_group_in_blocks(spark, metric):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(330, 5))
    x[7] = x[9] = x[200]
    rows = [("a", i, [float(v) for v in x[i]]) for i in range(300)] + [("b", i, [float(v) for v in x[i]]) for i in range(300, 330)] + [("c", 400, [1.0] * 5)]
    got = gr.knn(spark.createDataFrame(rows, "capture_id string, node long, x array<double>"), ["capture_id"], 8, metric, block=40).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for name, ids in (("a", range(300)), ("b", range(300, 330))):
        for i in ids:
            d = {j: round(float(1 - u[i] @ u[j] if metric == "cosine" else np.linalg.norm(x[i] - x[j])), 9) for j in ids if j != i}
            want |= {(name, i, j) for j in sorted(d, key=lambda j: (d[j], j))[:8]}
    assert len(got) == len(want) and {(r.capture_id, r.src, r.dst) for r in got} == want


@pytest.mark.parametrize("datatype,scale", [("ci16_le", None), ("cf32_be", None), ("ri8", None)])
def test_sigmf_round_trip(spark, tmp_path, datatype, scale):
    rng = np.random.default_rng(7)
    i, z = rng.integers(-90, 90, 500), rng.integers(-90, 90, 500)
    kind = {"ci16_le": "<i2", "cf32_be": ">f4", "ri8": "<i1"}[datatype]
    flat = i if datatype == "ri8" else np.stack((i, z), 1).ravel()
    (tmp_path / "a.sigmf-data").write_bytes(flat.astype(kind).tobytes())
    meta = {"global": {"core:sample_rate": 100.0, "core:datatype": datatype}, "captures": [{"core:sample_start": 0, "core:frequency": 1e6}], "annotations": [{"core:sample_start": 5, "core:sample_count": 9}]}
    (tmp_path / "a.sigmf-meta").write_text(json.dumps(meta))
    captures, tunes, notes = files.read_sigmf_meta(spark, f"{tmp_path}/*.sigmf-meta")
    assert tunes.count() == notes.count() == 1
    parts = files.sample_parts(spark, f"{tmp_path}/*.sigmf-data", captures, samples_a_part=64)
    assert parts.count() == 8
    got = files.read_sigmf_samples(captures, parts, start_s=1.0, duration_s=2.0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(200)) and [r.i for r in got] == i[100:300].tolist()
    assert [r.q for r in got] == ([0.0] * 200 if datatype == "ri8" else z[100:300].tolist())


def test_snapshots(spark, tmp_path):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "s_ch1_1000_3x4.pgm").write_bytes(b"P5\n# note\n4 3\n255\n" + grey.tobytes())
    z = np.array([[1 + 1j, 0], [10, 1j]], np.complex64)
    np.save(tmp_path / "t.npy", z)
    assert (back(files.read_pgm(spark, f"{tmp_path}/*.pgm"), "power_db", (4, 3)).astype(float) == grey.T).all()
    assert np.allclose(back(files.read_npy(spark, f"{tmp_path}/*.npy"), "power_db", (2, 2)).astype(float), [[3.0103, 20], [-120, 0]], atol=1e-4)
    feed = files.snapshot_stream(spark, f"{tmp_path}/*.pgm").select("channel", "epoch_ms").writeStream.format("memory").queryName("snaps").start()
    feed.processAllAvailable()
    feed.stop()
    assert [tuple(r) for r in spark.sql("select * from snaps").collect()] == [(1, 1000)]


def test_runs_are_replaced_by_capture(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "capture_id string, v int")
    write_run({"boxes": a}, str(tmp_path / "out"))
    write_run({"boxes": spark.createDataFrame([("y", 3)], "capture_id string, v int")}, str(tmp_path / "out"))
    assert sorted((r.capture_id, r.v) for r in spark.read.parquet(str(tmp_path / "out/boxes")).collect()) == [("x", 1), ("y", 3)]


def test_tile_detector_equals_its_window_form(spark):
    from skywave.operators.merge import chunk_scores, chunk_scores_by_windows

    x = np.random.default_rng(8).normal(0, 1, (24, 40))
    x[8:12] += 8
    d = grid(spark, x).withColumn("chunk_index", F.lit(0)).withColumn("valid", F.col("f") >= 2)
    a = chunk_scores(d).toPandas().sort_values(["f", "t"])
    b = chunk_scores_by_windows(d).toPandas().sort_values(["f", "t"])
    for c in ("coherence", "power", "score"):
        assert np.allclose(a[c], b[c])
    assert (a["support"].to_numpy() == b["support"].to_numpy()).all() and (a["mask"].to_numpy() == b["mask"].to_numpy()).all()
