"""Boxes, masks and tunes at scale: the same results by tiles, corners and buckets of any size."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skywave.operators import boxes as bx
from skywave.operators import truth as tr

ROLES = ("persistent_carrier", "transient_wideband_burst", "unsplit")
BOXES = "capture_id string, box_id long, freq_start int, freq_stop int, time_start int, time_stop int, split_role string"


def random_boxes(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        f, t = rng.randrange(0, 90), rng.randrange(0, 200)
        long = i % 40 == 0  # some reach over many tiles
        out.append((rng.choice("ab"), rng.randrange(10**6) * 1000 + i, f, f + rng.randint(1, 8), t, t + (150 if long else rng.randint(1, 9)), rng.choice(ROLES)))
    return out


def plain_clusters(boxes):
    groups = [{b} for b in boxes]
    apart = {ROLES[0], ROLES[1]}
    linked = lambda x, y: x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[4] < y[5] and y[4] < x[5] and {x[6], y[6]} != apart
    done = []
    while groups:
        g = groups.pop()
        while True:
            near = [h for h in groups if any(linked(x, y) for x in g for y in h)]
            if not near:
                break
            for h in near:
                groups.remove(h)
                g |= h
        done.append(g)
    return {b[1]: min(x[1] for x in g) for g in done for b in g}


@pytest.mark.parametrize("tile", [(128, 256), (10, 16), (3, 5)])
def test_box_labels_do_not_depend_on_tiles(spark, tile):
    boxes = random_boxes(1)
    got = {r.box_id: r.cluster_id for r in bx.box_labels(spark.createDataFrame(boxes, BOXES), tile_f=tile[0], tile_t=tile[1]).collect()}
    want = plain_clusters(boxes)
    assert got == want and 5 < len(set(want.values())) < len(want)
    assert bx.box_labels(spark.createDataFrame([], BOXES)).count() == 0


def test_small_and_large_tiles_are_linked_alike(monkeypatch):
    boxes = [b for b in random_boxes(5, 300) if b[0] == "a"]
    names = ["capture_id", "box_id", *bx.BOX, "split_role"]
    t = pa.table({n: [b[i] for b in boxes] for i, n in enumerate(names)}).append_column("beyond", pa.array([False] * len(boxes)))
    small = bx._tile_clusters((), t).to_pydict()
    monkeypatch.setattr(bx, "SMALL_TILE", 0)
    assert small == bx._tile_clusters((), t).to_pydict()
    assert dict(zip(small["box_id"], small["root"], strict=True)) == plain_clusters(boxes)


def test_large_tiles_are_linked_by_cells_in_time():
    """Held against each other, 100,000 boxes of a tile took minutes."""
    rng = np.random.default_rng(8)
    n = 100_000
    f, t = rng.integers(0, 126, n), rng.integers(0, 250, n)
    table = {"box_id": np.arange(n), "freq_start": f, "freq_stop": f + 2, "time_start": t, "time_stop": t + 5, "split_role": np.array(ROLES)[rng.integers(0, 3, n)], "beyond": np.zeros(n, bool)}
    began = time.process_time()
    got = bx._tile_clusters((), pa.table({k: pa.array(v) for k, v in table.items()}))
    assert time.process_time() - began < 20 and set(got.column("root").to_pylist()) == {0}


@pytest.mark.parametrize("tile", [(128, 256), (10, 16), (3, 5)])
def test_overlap_counts_equal_the_pairs(spark, tile):
    boxes = random_boxes(3)
    want = Counter()
    for i, x in enumerate(boxes):
        for y in boxes[:i]:
            if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[4] < y[5] and y[4] < x[5]:
                want.update([(x[0], x[1]), (y[0], y[1])])
    d = spark.createDataFrame([*boxes, (None, 1, 0, 90, 0, 200, ROLES[2]), ("a", 2, 5, 5, 0, 200, ROLES[2])], BOXES)
    got = bx.overlap_counts(d, tile_f=tile[0], tile_t=tile[1]).groupBy("capture_id", "box_id").agg(F.sum("overlaps").alias("n"))
    assert {(r.capture_id, r.box_id): r.n for r in got.collect()} == want
    assert bx.overlap_counts(spark.createDataFrame([], BOXES)).count() == 0


def test_ranges_cover_cells_by_their_corners(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(c, f, t) for c in "abc" for f in range(5, 25) for t in range(-3, 30)], "capture_id string, f int, t int")
    ranges = [(rng.choice("ab"), *sorted(rng.randrange(0, 32) for _ in range(2)), *sorted(rng.randrange(-8, 38) for _ in range(2))) for _ in range(9)] * 2 + [("b", 7, 7, 0, 9), ("d", 6, 9, 0, 9)]
    got = bx.covered(cells, spark.createDataFrame(ranges, "capture_id string, fa int, fb int, ta int, tb int")).collect()
    assert len(got) == 3 * 20 * 33
    assert all(r["mask"] == any(c == r.capture_id and fa <= r.f < fb and ta <= r.t < tb for c, fa, fb, ta, tb in ranges) for r in got) and {r["mask"] for r in got} == {True, False}


def test_very_many_boxes_of_one_capture_cost_boxes_and_cells(spark):
    n = 200_000
    boxes = spark.range(n).selectExpr("'a' AS capture_id", "CAST(id % 97 AS INT) AS fa", "CAST(id % 97 + 1 + id % 3 AS INT) AS fb", "CAST(id * 7 % 193 AS INT) AS ta", "CAST(id * 7 % 193 + 2 AS INT) AS tb").where("fa < 60")
    cells = spark.range(100 * 200).selectExpr("'a' AS capture_id", "CAST(id div 200 AS INT) AS f", "CAST(id % 200 AS INT) AS t")
    got = bx.covered(cells, boxes)
    assert got.where("mask").agg(F.max("f"), F.min("f")).first() == (61, 0) and got.count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "sequence" not in plan  # corners, no cells of boxes


@pytest.mark.parametrize("bucket", [1, 7, 100_000])
def test_centre_in_force_for_any_bucket(spark, bucket):
    rng = random.Random(3)
    tunes = [("a", s, float(k)) for k, s in enumerate(rng.sample(range(10, 100), 12))] + [("b", 50, 7.0), ("b", 60, None)]
    notes = [(c, rng.randrange(0, 120), i) for i, c in enumerate("ab" * 30)] + [("none", 5, 99)]
    got = tr.centre_in_force(spark.createDataFrame(notes, "capture_id string, sample_start long, ann_id int"), spark.createDataFrame(tunes, "capture_id string, sample_start long, frequency double"), bucket).collect()
    want = {}
    for c, s, i in notes:
        own = sorted((a, f) for x, a, f in tunes if x == c and f is not None)
        before = [f for a, f in own if a <= s]
        want[i] = before[-1] if before else own[0][1] if own else None
    assert {r.ann_id: r.centre_hz for r in got} == want


def test_annotation_mask_against_strict_overlap(spark):
    rng = np.random.default_rng(4)
    edges = lambda n: np.concatenate(([0.0], np.cumsum(rng.random(n) + 0.1)))
    ef, et = edges(12), edges(15)
    rows = spark.createDataFrame([("a", i, float(ef[i]), float(ef[i + 1])) for i in range(12)], "capture_id string, f long, lo double, hi double")
    cols = spark.createDataFrame([("a", i, float(et[i]), float(et[i + 1])) for i in range(15)], "capture_id string, t long, lo double, hi double")
    boxes = [("a", k, *map(float, rng.random(2) * et[-1] / 3), *map(float, rng.random(2) * ef[-1])) for k in range(3)] + [("a", 8, float(et[9]), float(et[10]), float(ef[3]), float(ef[5])), ("a", 9, float(et[14]) + 0.01, float(et[14]) + 0.02, None, None)]
    got = {(r.f, r.t) for r in tr.annotation_mask(spark.createDataFrame(boxes, "capture_id string, box_id int, t0 double, t1 double, f0 double, f1 double"), rows, cols).collect()}
    want = set()
    for _, _, t0, t1, f0, f1 in boxes:
        for i in range(12):
            for j in range(15):
                if (f0 is None or (ef[i + 1] > min(f0, f1) and ef[i] < max(f0, f1))) and et[j + 1] > min(t0, t1) and et[j] < max(t0, t1):
                    want.add((i, j))
    assert got == want
