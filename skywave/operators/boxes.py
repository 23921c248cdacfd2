"""Signal boxes: projection, overlap, clusters, masks. A box has freq_start, freq_stop, time_start, time_stop (half open)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.operators.links import connected_components
from skywave.sources.tables import stored

BOX = ("freq_start", "freq_stop", "time_start", "time_stop")
#: Roles of which one box of each never merge directly.
CARRIER, BURST = "persistent_carrier", "transient_wideband_burst"
#: Boxes of a tile up to which all its pairs make one table.
SMALL_TILE = 1024
#: Cells of a larger tile up to which its boxes are linked by the cells they cover.
GRID_CELLS = 1 << 20


def project_boxes(boxes: DataFrame, chunks: DataFrame, rows: int, cols: int, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Boxes of sub-bands in the rows of the whole band, clipped to it; empty ones go."""
    c = chunks.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("chunk_index").alias("_chunk"), "row_start")
    on = boxes.chunk_index == F.col("_chunk")
    for g in group:
        on = on & (boxes[g] == F.col(f"_{g}"))
    at = boxes.join(c, on).drop("_chunk", *[f"_{g}" for g in group])
    clip = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n))
    at = at.withColumns({"freq_start": clip(F.col("freq_start") + F.col("row_start"), rows), "freq_stop": clip(F.col("freq_stop") + F.col("row_start"), rows), "time_start": clip(F.col("time_start"), cols), "time_stop": clip(F.col("time_stop"), cols)})
    return at.where("freq_stop > freq_start and time_stop > time_start").drop("row_start")


def overlapping_pairs(boxes: DataFrame, group: Sequence[str] = ("capture_id",), merging: bool = False, tile_f: int = 64, tile_t: int = 64) -> DataFrame:
    """(group, a, b) of boxes that overlap strictly, a < b by box_id; merging leaves carrier-burst pairs out.

    Boxes meet in the tiles that they cover, and a pair counts in the first tile they share, so it comes once.
    """
    tiles = boxes.withColumn("_tf", F.explode(F.sequence(F.floor(F.col("freq_start") / tile_f), F.floor((F.col("freq_stop") - 1) / tile_f))))
    tiles = tiles.withColumn("_tt", F.explode(F.sequence(F.floor(F.col("time_start") / tile_t), F.floor((F.col("time_stop") - 1) / tile_t))))
    cols = [*group, "box_id", *BOX, "split_role", "_tf", "_tt"]
    a, b = tiles.select(*[F.col(c).alias(f"a{c}") for c in cols]), tiles.select(*[F.col(c).alias(f"b{c}") for c in cols])
    on = (F.col("a_tf") == F.col("b_tf")) & (F.col("a_tt") == F.col("b_tt"))
    for g in group:
        on = on & (F.col(f"a{g}") == F.col(f"b{g}"))
    near = (F.col("abox_id") < F.col("bbox_id")) & (F.col("afreq_start") < F.col("bfreq_stop")) & (F.col("bfreq_start") < F.col("afreq_stop")) & (F.col("atime_start") < F.col("btime_stop")) & (F.col("btime_start") < F.col("atime_stop"))
    first = (F.floor(F.greatest("afreq_start", "bfreq_start") / tile_f) == F.col("a_tf")) & (F.floor(F.greatest("atime_start", "btime_start") / tile_t) == F.col("a_tt"))
    pairs = a.join(b, on & near & first)
    if merging:
        kinds = F.array("asplit_role", "bsplit_role")
        pairs = pairs.where(~(F.array_contains(kinds, CARRIER) & F.array_contains(kinds, BURST)))
    return pairs.select(*[F.col(f"a{g}").alias(g) for g in group], F.col("abox_id").alias("a"), F.col("bbox_id").alias("b"))


def overlap_counts(boxes: DataFrame, group: Sequence[str] = ("capture_id",), tile_f: int = 128, tile_t: int = 256) -> DataFrame:
    """(group, box_id, overlaps): how many boxes of its group overlap each strictly, without making pairs, so the work grows with
    the boxes however many overlap. A box has a row for each tile in which pairs of it begin; the rows add up.

    In a tile boxes are clipped to it. Counts of their corners, added up along both axes, tell how many overlap each; pairs
    that an earlier tile holds too are taken away again, so a pair counts in the first tile it shares. Boxes have whole
    coordinates; an empty one and one of a null group overlap none.
    """
    d = boxes.select(*group, F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("long").alias(c) for c in BOX]).where("freq_start < freq_stop and time_start < time_stop")
    d = _clipped(d.dropna(subset=list(group)), tile_f, tile_t)

    def count(key: tuple, t: pa.Table) -> pa.Table:
        f0, f1, t0, t1 = (t.column(c).to_numpy() for c in BOX)
        f0, f1, t0, t1 = f0 - f0.min(), f1 - f0.min(), t0 - t0.min(), t1 - t0.min()
        early = t.column("early_f").to_numpy(zero_copy_only=False), t.column("early_t").to_numpy(zero_copy_only=False)
        shape = (int(f1.max()) + 1, int(t1.max()) + 1)

        def overlapping(of: np.ndarray) -> np.ndarray:
            """How many of the chosen boxes overlap each of them."""
            up_to = lambda x, y: np.bincount(x[of] * shape[1] + y[of], minlength=shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)
            found = up_to(f0, t0)[f1[of] - 1, t1[of] - 1] - up_to(f1, t0)[f0[of], t1[of] - 1] - up_to(f0, t1)[f1[of] - 1, t0[of]] + up_to(f1, t1)[f0[of], t0[of]]
            out = np.zeros(len(f0), np.int64)
            out[of] = found
            return out

        n = overlapping(np.ones(len(f0), bool)) - overlapping(early[0]) - overlapping(early[1]) + overlapping(early[0] & early[1])
        n -= ~(early[0] | early[1])  # itself
        return t.select([*group, "box_id"]).append_column("overlaps", pa.array(n)).filter(pa.array(n > 0))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*group).schema)
    return d.groupBy(*group, "_tf", "_tt").applyInArrow(count, f"{kinds}, box_id long, overlaps long")


def _clipped(d: DataFrame, tile_f: int, tile_t: int) -> DataFrame:
    """A row for each tile (_tf, _tt) that a box covers, with its part inside the tile: early_f and early_t where it begins before
    the tile, beyond where it covers others."""
    spans = {"_tf": F.sequence(F.floor(F.col("freq_start") / tile_f), F.floor((F.col("freq_stop") - 1) / tile_f)), "_tt": F.sequence(F.floor(F.col("time_start") / tile_t), F.floor((F.col("time_stop") - 1) / tile_t))}
    d = d.withColumn("beyond", F.size(spans["_tf"]) * F.size(spans["_tt"]) > 1)
    for name, of in spans.items():
        d = d.withColumn(name, F.explode(of))
    for at, axis, size in (("_tf", "freq", tile_f), ("_tt", "time", tile_t)):
        low = F.col(at) * size
        d = d.withColumn(f"early_{at[-1]}", F.col(f"{axis}_start") < low)
        d = d.withColumns({f"{axis}_start": F.greatest(F.col(f"{axis}_start"), low), f"{axis}_stop": F.least(F.col(f"{axis}_stop"), low + size)})
    return d


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that the edges (a, b) link it to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _grid_labels(f0: np.ndarray, f1: np.ndarray, t0: np.ndarray, t1: np.ndarray, role: np.ndarray) -> np.ndarray:
    """A number for each box, equal where chains of overlaps link two.

    Boxes overlap where they share a cell. Cells come in two layers, one that bursts leave out and one that carriers leave out;
    boxes of no role lie in both and link them. Neighbouring cells that some box covers are one run or an edge between runs.
    """
    f0, f1, t0, t1 = f0 - f0.min(), f1 - f0.min(), t0 - t0.min(), t1 - t0.min()
    rows, cols = int(f1.max()), int(t1.max())

    def covered_by(of: np.ndarray, less_f: int, less_t: int) -> np.ndarray:
        """Cells that some chosen box covers, together with the next cell along f or t."""
        d = np.zeros((rows + 1) * (cols + 1), np.int64)
        for f, t, sign in ((f0, t0, 1), (f0, t1 - less_t, -1), (f1 - less_f, t0, -1), (f1 - less_f, t1 - less_t, 1)):
            d += sign * np.bincount(f[of] * (cols + 1) + t[of], minlength=len(d))
        return d.reshape(rows + 1, cols + 1).cumsum(0).cumsum(1)[:rows, :cols] > 0

    layers = [role != 2, role != 1]
    along_t = np.concatenate([covered_by(of, 0, 1).ravel() for of in layers])
    along_f = np.concatenate([covered_by(of, 1, 0).ravel() for of in layers])
    run = np.concatenate(([0], np.cumsum(~along_t[:-1])))
    down, through = np.flatnonzero(along_f), np.flatnonzero(covered_by(role == 0, 0, 0))
    edges = np.unique(np.concatenate((run[down] * len(run) + run[down + cols], run[through] * len(run) + run[through + rows * cols])))
    label = _united(int(run[-1]) + 1, edges // len(run), edges % len(run))
    return label[run[(role == 2) * rows * cols + f0 * cols + t0]]


def _tile_clusters(key: tuple, t: pa.Table) -> pa.Table:
    """(box_id, root, beyond) of a tile's boxes: the least id of what a chain of overlaps inside the tile links them to.

    A small tile is linked by one table of its pairs, a large one by the cells that its boxes cover, so its work grows with
    its boxes and cells. Beyond GRID_CELLS boxes come in order of time; each is held against those before it, and their
    clusters become one.
    """
    t = t.sort_by([("time_start", "ascending"), ("box_id", "ascending")])
    f0, f1, t0, t1, ids = (t.column(c).to_numpy() for c in (*BOX, "box_id"))
    role = np.array([{CARRIER: 1, BURST: 2}.get(r, 0) for r in t.column("split_role").to_pylist()])
    label = np.arange(len(ids))
    if len(ids) <= SMALL_TILE:
        over = lambda a, b: a[:, None] < b[None]
        near = over(f0, f1) & over(f0, f1).T & over(t0, t1) & over(t0, t1).T & (role[:, None] + role[None] != 3)
        last = None
        while last is None or (label != last).any():
            last = label
            label = np.where(near, label[None], len(ids)).min(1)
            label = label[label]
    elif (f1 > f0).all() and (t1 > t0).all() and (f1.max() - f0.min()) * (t1.max() - t0.min()) <= GRID_CELLS:
        label = _grid_labels(f0, f1, t0, t1, role)
    else:  # empty boxes, or a tile of any extent
        for i in range(1, len(ids)):
            near = (f0[:i] < f1[i]) & (f0[i] < f1[:i]) & (t0[i] < t1[:i]) & (t0[:i] < t1[i])
            if role[i]:
                near &= role[:i] + role[i] != 3
            met = np.unique(label[:i][near])
            if len(met):
                label[i] = met[0]
                if len(met) > 1:
                    label[:i][np.isin(label[:i], met[1:])] = met[0]
    _, number = np.unique(label, return_inverse=True)
    root = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(root, number, ids)
    return pa.table({"box_id": pa.array(ids), "root": pa.array(root[number]), "beyond": t.column("beyond")})


def box_labels(boxes: DataFrame, group: Sequence[str] = ("capture_id",), tile_f: int = 128, tile_t: int = 256) -> DataFrame:
    """(box_id, cluster_id) of boxes linked by chains of overlaps, a carrier and a burst only through others.

    Tiles are linked inside in one task each. A box that reaches over tiles links the clusters it belongs to in each of
    them, by their least ids; no pairs of boxes are written.
    """
    tiles = boxes.select(*group, F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("long").alias(c) for c in BOX], "split_role")
    tiles = _clipped(tiles, tile_f, tile_t).drop("early_f", "early_t")
    inside = stored(tiles.groupBy(*group, "_tf", "_tt").applyInArrow(_tile_clusters, "box_id long, root long, beyond boolean"), "tile-clusters")
    met = inside.where("beyond").groupBy("box_id").agg(F.min("root").alias("a"), F.collect_set("root").alias("roots"))  # as many as its tiles
    joined = connected_components(met.select("a", F.explode("roots").alias("b")).distinct(), "boxes").withColumnRenamed("component", "_whole")
    named = inside.join(joined, inside.root == joined.node, "left").select("box_id", F.coalesce("_whole", "root").alias("cluster_id"))
    return named.groupBy("box_id").agg(F.min("cluster_id").alias("cluster_id"))  # a box has a row for each of its tiles


def cluster_boxes(boxes: DataFrame, group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Boxes merged along chains of overlaps (box_id is unique): bounds, area, weighted score, roles and sources."""
    labels = box_labels(boxes, group).withColumnRenamed("box_id", "_id")
    named = boxes.join(labels, boxes.box_id == F.col("_id")).drop("_id")
    weight = F.greatest("filled_area", F.lit(1))
    merged = named.groupBy(*group, "cluster_id").agg(
        F.min("freq_start").alias("freq_start"), F.max("freq_stop").alias("freq_stop"), F.min("time_start").alias("time_start"), F.max("time_stop").alias("time_stop"), F.sum("filled_area").alias("filled_area"),
        (F.sum(F.col("score_mean") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("score_mean"), F.max("score_peak").alias("score_peak"),
        F.when(F.min("split_role") == F.max("split_role"), F.min("split_role")).otherwise("mixed").alias("split_role"), F.count("*").alias("n_boxes"), F.array_sort(F.collect_set("box_id")).alias("sources"),
    )
    return merged.withColumn("density", F.col("filled_area") / ((F.col("freq_stop") - F.col("freq_start")) * (F.col("time_stop") - F.col("time_start"))))


def covered(cells: DataFrame, ranges: DataFrame, out: str = "mask", group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """The cells of dense grids with whether some range (group, fa, fb, ta, tb; half open) holds them.

    A range adds one at two of its corners and takes one away at the others; sums along time and then along frequency count
    the ranges over each cell. So the work is ranges plus cells, however large the ranges are.
    """
    ends = cells.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("f").alias("_f0"), F.max("f").alias("_f1"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    r = ranges.join(ends, _same(ranges, group))
    r = r.withColumns({"fa": F.greatest("fa", "_f0"), "ta": F.greatest("ta", "_t0"), "fb": F.least(F.col("fb"), F.col("_f1") + 1), "tb": F.least(F.col("tb"), F.col("_t1") + 1)}).where("fa < fb and ta < tb")
    corner = lambda f, t, d: F.struct(F.col(f).alias("f"), F.col(t).alias("t"), F.lit(d).alias("d"))
    corners = r.select(*group, F.inline(F.array(corner("fa", "ta", 1), corner("fa", "tb", -1), corner("fb", "ta", -1), corner("fb", "tb", 1))))
    corners = corners.groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("f").alias("_f"), F.col("t").alias("_t")).agg(F.sum("d").alias("_d"))
    d = cells.join(corners, _same(cells, group) & (cells.f == F.col("_f")) & (cells.t == F.col("_t")), "left").drop("_f", "_t", *[f"_{g}" for g in group])
    along_t = Window.partitionBy(*group, "f").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    along_f = Window.partitionBy(*group, "t").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.coalesce("_d", F.lit(0))).over(along_t))
    return d.withColumn(out, F.sum("_s").over(along_f) > 0).drop("_d", "_s")


def _same(d: DataFrame, group: Sequence[str]):
    on = F.lit(True)
    for g in group:
        on = on & (d[g] == F.col(f"_{g}"))
    return on


def boxes_to_mask(cells: DataFrame, boxes: DataFrame, out: str = "mask", group: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Cells of dense grids with whether some box holds them."""
    ranges = boxes.select(*group, *[F.col(c).alias(n) for c, n in zip(BOX, ("fa", "fb", "ta", "tb"), strict=True)])
    return covered(cells, ranges, out, group)


def count_sources(boxes: DataFrame, sources: DataFrame, group: Sequence[str]) -> DataFrame:
    """boxes (box_id is unique) with n_boxes and chunks: how many source boxes overlap each strictly, and their sub-bands."""
    s = sources.select(*[F.col(g).alias(f"_{g}") for g in group], *[F.col(c).alias(f"_{c}") for c in BOX], F.col("chunk_index").alias("_chunk"))
    on = (F.col("freq_start") < F.col("_freq_stop")) & (F.col("_freq_start") < F.col("freq_stop")) & (F.col("time_start") < F.col("_time_stop")) & (F.col("_time_start") < F.col("time_stop"))
    for g in group:
        on = on & (boxes[g] == F.col(f"_{g}"))
    met = boxes.join(s, on).groupBy(F.col("box_id").alias("_id")).agg(F.count("*").alias("n_boxes"), F.array_sort(F.collect_set("_chunk")).alias("chunks"))
    return boxes.join(met, F.col("box_id") == F.col("_id"), "left").drop("_id").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))
