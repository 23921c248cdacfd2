import numpy as np
from pyspark.sql import functions as F

from skywave.config import Grouping
from skywave.kernels import arrays
from skywave.operators import boxes as bx
from skywave.operators import graph as gr
from skywave.operators import spectra as sp
from skywave.operators import truth as tr
from skywave.operators.components import group_regions
from test_signal import grid


def test_bilinear_resize_of_a_plane_is_the_plane():
    r, c = np.mgrid[0:10, 0:12]
    x = 2.0 * r + 3.0 * c
    y = arrays.resize_bilinear(x, 5, 6)
    want = np.array([[2 * (2 * i + 0.5) + 3 * (2 * j + 0.5) for j in range(6)] for i in range(5)])
    assert np.allclose(y[1:-1, 1:-1], want[1:-1, 1:-1])  # at the edges the triangle is cut off
    assert np.isclose(y[0, 0], 2 * 5 / 7 + 3 * 5 / 7)  # cells 0, 1, 2 weigh 3, 3 and 1 there
    assert np.allclose(arrays.resize_bilinear(x, 10, 12), x)


def test_mixture_threshold():
    rng = np.random.default_rng(0)
    two = np.concatenate((rng.normal(0.2, 0.03, 400), rng.normal(0.8, 0.03, 300)))
    assert abs(arrays.mixture_threshold(two)[0] - 0.5) < 0.05
    assert np.isnan(arrays.mixture_threshold(rng.normal(0.5, 0.03, 500))[0])
    assert np.isnan(arrays.mixture_threshold(np.full(3, np.nan))[0])


def test_ridge_detrend_takes_a_plane_away():
    pr, pc = (a.ravel().astype(float) for a in np.mgrid[0:12, 0:14])
    x = np.stack((1 + 3 * pr - 2 * pc, pr * pc), 1)
    assert np.abs(arrays.ridge_detrend(x, pr, pc, 12, 14)).max() < 0.01 * np.abs(x).max()


def test_noise_depends_on_keys_only_and_has_its_power(spark):
    d = spark.createDataFrame([("c", n, 1.0, 0.0) for n in range(4000)], "capture_id string, n long, i double, q double")
    plan = spark.createDataFrame([("c", 0.0, 2.0)], "capture_id string, target_snr_db double, sigma double")
    a = sp.add_noise(d, plan, seed=3).orderBy("n").collect()
    b = sp.add_noise(d.repartition(9), plan, seed=3).orderBy("n").collect()
    assert a == b and a != sp.add_noise(d, plan, seed=4).orderBy("n").collect()
    z = np.array([complex(r.i - 1, r.q) for r in a])
    assert abs((np.abs(z) ** 2).mean() - 8) < 0.6 and abs(z.mean()) < 0.2


def test_reasons_come_in_a_fixed_order(spark):
    x = np.zeros((30, 30))
    x[2, 3] = 1.0
    x[10:26, 5:12] = 2.0
    d = grid(spark, x).withColumn("m", F.col("power_db") > 0)
    got = {r.filled_area: r for r in group_regions(d, "m", "power_db", Grouping(bridge_f=1, bridge_t=0, min_f=12)).collect()}
    assert got[1].failed_reasons == ["size", "freq_span", "peak"] and got[1].failed_reason == "size" and not got[1].keep
    assert got[112].keep and got[112].failed_reason is None and got[112].density == 1.0


BOX = "capture_id long, box_id long, freq_start long, freq_stop long, time_start long, time_stop long, split_role string, filled_area long, score_mean double, score_peak double"


def test_touching_boxes_do_not_overlap_and_roles_merge_through_a_third(spark):
    rows = [
        (1, 1, 0, 10, 0, 10, "persistent_carrier", 50, 0.5, 0.6), (1, 2, 10, 20, 0, 10, "unsplit", 10, 0.1, 0.2), (1, 3, 5, 15, 5, 8, "transient_wideband_burst", 20, 0.3, 0.9),
        (1, 4, 100, 110, 0, 10, "persistent_carrier", 5, 0.5, 0.6), (1, 5, 105, 115, 5, 8, "transient_wideband_burst", 5, 0.5, 0.6), (2, 6, 0, 10, 0, 10, "unsplit", 5, 0.5, 0.6),
    ]
    d = spark.createDataFrame(rows, BOX)
    assert {(r.a, r.b) for r in bx.overlapping_pairs(d, tile_f=4, tile_t=4).collect()} == {(1, 3), (2, 3), (4, 5)}
    assert {(r.a, r.b) for r in bx.overlapping_pairs(d, merging=True).collect()} == {(2, 3)}
    got = {tuple(r.sources): r for r in bx.cluster_boxes(d).collect()}
    assert set(got) == {(1,), (2, 3), (4,), (5,), (6,)}
    both = got[2, 3]
    assert both.split_role == "mixed" and (both.freq_start, both.freq_stop) == (5, 20) and abs(both.score_mean - (0.1 * 10 + 0.3 * 20) / 30) < 1e-12
    met = bx.count_sources(d.select("capture_id", "box_id", *bx.BOX), d.withColumn("chunk_index", F.col("box_id") % 2), ["capture_id"]).collect()
    assert {r.box_id: (r.n_boxes, r.chunks) for r in met} == {1: (2, [1]), 2: (2, [0, 1]), 3: (3, [0, 1]), 4: (2, [0, 1]), 5: (2, [0, 1]), 6: (1, [0])}


def test_edges_move_only_where_scales_differ(spark):
    axis = spark.createDataFrame([(c, float(x)) for c, base in (("a", 1000), ("b", 0)) for x in range(base - 10, base + 11)], "capture_id string, freq_hz double")
    b = spark.createDataFrame([("a", -5.0, 5.0), ("b", -5.0, 5.0)], "capture_id string, f0 double, f1 double")
    assert {r.capture_id: (r.f0, r.f1) for r in tr.recentre_edges(b, axis).collect()} == {"a": (995.0, 1005.0), "b": (-5.0, 5.0)}


def test_growth_and_prototypes_on_two_clear_sides(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, i // 12, i % 12, [float(v) for v in rng.normal(5 if i % 12 >= 9 else 0, 0.3, 3)], float(i % 12 >= 9) + rng.normal(0, 0.01)) for i in range(144)]
    p = spark.createDataFrame(rows, "capture_id int, node long, pr int, pc int, x array<double>, cue double")
    ratio = {r.node: r.ratio for r in gr.prototype_ratio(p, gr.prototypes(p, "cue", ["capture_id"]), ["capture_id"]).collect()}
    assert min(ratio[i] for i in range(144) if i % 12 >= 9) > max(ratio[i] for i in range(144) if i % 12 < 9)
    scores = p.select("capture_id", "node", F.col("cue").alias("score"))
    e = gr.affinity(gr.knn(p.drop("cue"), ["capture_id"], 8, "euclidean"), ["capture_id"])
    grown = {r.node for r in gr.grow_seeds(scores, e, gr.grid_pairs(p, ["capture_id"]), ["capture_id"], seed_q=0.85, eligible_q=0.76).collect()}
    assert grown and all(i % 12 >= 9 for i in grown)
