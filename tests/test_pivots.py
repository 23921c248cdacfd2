"""Neighbours by pivots against plain ones."""

import numpy as np
import pytest

from skywave.operators import pivots as pv

SCHEMA = "capture_id string, node long, x array<double>, p int"


def table(spark, groups):
    rows = [(g, int(n), None if v is None else [float(a) for a in v], 7) for g, (nodes, x) in groups.items() for n, v in zip(nodes, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(groups, k, metric):
    want = {}
    for g, (nodes, x) in groups.items():
        have = [(n, np.asarray(v, float)) for n, v in zip(nodes, x, strict=True) if v is not None]
        for n, v in have:
            d = []
            for m, w in have:
                if m != n:
                    size = np.linalg.norm(v) * np.linalg.norm(w)
                    d.append((round(float(np.linalg.norm(v - w) if metric == "euclidean" else 1 - (v @ w / size if size else 0.0)), 9), m))
            want[g, n] = [m for _, m in sorted(d)[:k]]
    return want


def edges(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.capture_id, r.src), []).append((round(r.distance, 9), r.dst))
    return {key: [n for _, n in sorted(v)] for key, v in got.items()}


def clusters(rng, n, dims=6, centres=12, spread=0.02):
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_equal_comparing_all(spark, metric):
    rng = np.random.default_rng(3)
    x = clusters(rng, 420)
    x[40:90] = x[3]  # copies, more than k
    x[90:95] = x[4]  # and fewer
    x[100:120] = 0.0
    x[200:260] = x[200] + rng.normal(0, 1e-3, (60, 6))
    nodes = rng.permutation(420)
    even = rng.normal(size=(70, 6))
    groups = {"a": (nodes, list(x)), None: (range(70), list(even)), "c": ([5], [[1.0] * 6]), "d": ([1, 2, 3], [[1.0] * 6, None, [1.0] * 6]), "e": (range(30), [[2.0] * 6] * 30)}
    want = {key: v for key, v in plain(groups, 8, metric).items() if v}
    for pivots in (1, 4096):
        assert edges(pv.knn_by_pivots(table(spark, groups), ["capture_id"], 8, metric, block=25, pivots=pivots)) == want


def test_an_empty_table_has_no_edges(spark):
    assert pv.knn_by_pivots(table(spark, {}), ["capture_id"], 8, block=25).count() == 0


def test_cells_are_skipped_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    rows = table(spark, {"a": (range(1500), list(clusters(rng, 1500, dims=8, centres=30, spread=0.01)))})
    classes = pv.vector_classes(pv._keyed(rows, ["capture_id"], "euclidean"), 8)
    placed, cells = pv.pivot_cells(classes, "euclidean", block=30)
    sizes = [r["count"] for r in placed.groupBy("_g", *pv.CELL).count().collect()]
    assert max(sizes) <= 3 * 30 and sum(sizes) == 1500
    assert pv.cell_visits(placed, cells, 8, "euclidean").count() < 0.4 * 1500 * len(sizes)


def test_no_table_holds_a_row_for_each_class_and_cell(spark, monkeypatch):
    """Evenly spread vectors, where every class visits every cell: such tables filled the disk."""
    sizes, real = {}, pv.stored

    def counted(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(pv, "stored", counted)
    x = np.random.default_rng(6).normal(size=(400, 32))
    got = edges(pv.knn_by_pivots(table(spark, {"a": (range(400), list(x))}), ["capture_id"], 8, block=10))
    assert got == plain({"a": (range(400), list(x))}, 8, "cosine") and max(sizes.values()) <= 400
