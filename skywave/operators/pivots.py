"""Exact nearest neighbours in groups too large to compare whole, by pivots and the triangle inequality.

Equal vectors of a group are one class (told by 128 bits of hash). A class belongs to its nearest pivot; the classes of a
pivot are cut into cells, rings of their distance to it. The neighbours inside its own cell bound what a class still looks
for, and it visits only cells whose ring can hold something as near.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.operators.graph import BLOCK, dot
from skywave.sources.tables import stored

#: Pivots of a group at most; larger groups have more rings to a pivot.
PIVOTS = 4096
#: Classes that one task holds against the pivots of their group.
SLICE = 32_768
#: Steps of distance that rings are made of.
STEPS = 1024
#: Parts over which the rows of one class, and the classes of one ring, are spread in joins.
PARTS = 32
CELL = ("p", "ring", "part")
ASSIGNED = pa.schema([("_g", pa.string()), ("cls", pa.int64()), ("nodes", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("p", pa.int32()), ("dp", pa.float64())])
VISITS = pa.schema([("_g", pa.string()), ("cls", pa.int64()), ("p", pa.int32()), ("ring", pa.int32()), ("part", pa.int32())])


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    x = t.column(name).combine_chunks()
    return np.asarray(x.flatten(), float).reshape(len(x), -1)


def _between(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    d = x @ y.T
    return 1 - d if metric == "cosine" else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * d, 0))


def _length(d: np.ndarray, metric: str) -> np.ndarray:
    """A distance that keeps the triangle inequality: the chord of a cosine distance."""
    return np.sqrt(2 * np.maximum(d, 0)) if metric == "cosine" else d


def _slack(x: np.ndarray, metric: str) -> np.ndarray:
    """What rounding can change in a distance from each row."""
    return 1e-7 * (1 + (np.zeros(len(x)) if metric == "cosine" else np.linalg.norm(x, axis=1)))


def _assign(metric: str):
    def run(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:  # a slice that no class was dealt to
            return ASSIGNED.empty_table()
        x, y = _matrix(rows, "x"), _matrix(pivots, "px")
        number, p, d = pivots.column("p").to_numpy(), [], []
        for a in range(0, len(x), 1024):
            near = _length(_between(x[a : a + 1024], y, metric), metric)
            j = near.argmin(1)
            p.append(number[j])
            d.append(near[np.arange(len(j)), j])
        return rows.select(["_g", "cls", "nodes", "x"]).append_column("p", pa.array(np.concatenate(p), pa.int32())).append_column("dp", pa.array(np.concatenate(d))).cast(ASSIGNED)

    return run


def _own_bound(k: int, metric: str):
    """The distance within which a class surely finds all it needs, from its own cell; infinite where the cell has too few."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = _matrix(t, "x")
        need = k + 1 - np.asarray(pc.list_value_length(t.column("nodes")))
        bound = np.full(len(x), np.inf)
        for a in range(0, len(x), 512):
            d = _between(x[a : a + 512], x, metric)
            i = np.arange(len(d))
            d[i, a + i] = np.inf
            d.sort(axis=1)
            n = need[a : a + 512]
            enough = n <= len(x) - 1
            bound[a : a + 512] = np.where(n <= 0, 0.0, np.where(enough, d[i, np.clip(n, 1, len(x)) - 1], np.inf))
        if metric == "cosine":
            bound[~x.any(1)] = np.inf  # the copies of a zero vector are not near each other
        return t.select(["_g", "cls", "x"]).append_column("bound", pa.array(bound))

    return run


def _visit(metric: str):
    def run(key: tuple, rows: pa.Table, cells: pa.Table) -> pa.Table:
        if not rows.num_rows:  # a slice that no class was dealt to
            return VISITS.empty_table()
        x, bound = _matrix(rows, "x"), rows.column("bound").to_numpy()
        slack = _slack(x, metric)
        bound = _length(bound + 2e-9, metric) + slack + 1e-7 * np.where(np.isfinite(bound), bound, 0)
        p, low, high = (cells.column(c).to_numpy() for c in ("p", "low", "high"))
        _, first, of = np.unique(p, return_index=True, return_inverse=True)
        y = _matrix(cells.take(pa.array(first)), "px")
        i, j = [], []
        step = max(1, 4_000_000 // len(p))
        for a in range(0, len(x), step):
            d = _length(_between(x[a : a + step], y, metric), metric)[:, of]
            at, cell = np.nonzero(np.maximum(d - high, low - d) <= bound[a : a + step, None] + slack[a : a + step, None])
            i.append(at + a)
            j.append(cell)
        i, j = pa.array(np.concatenate(i)), pa.array(np.concatenate(j))
        out = {c: rows.column(c).take(i) for c in ("_g", "cls")} | {c: cells.column(c).take(j) for c in CELL}
        return pa.table(out)

    return run


def _exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs one by one, so that equal vectors have equal ones wherever they lie."""
    return 1 - np.einsum("ij,ij->i", x, y) if metric == "cosine" else np.sqrt(((x - y) ** 2).sum(1))


class Search:
    """The k + 1 nearest rows of some classes of one group, as cells come by one after the other."""

    def __init__(self, group: str, cls: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, metric: str):
        self.group, self.cls, self.x, self.bound, self.take, self.metric = group, cls, x, bound, k + 1, metric
        self.slack = _slack(x, metric)
        self.place, self.near = np.full((len(x), k + 1), np.inf), np.full((len(x), k + 1), np.inf)
        self.dst = np.full((len(x), k + 1), np.iinfo(np.int64).max)

    def visit(self, pivot: np.ndarray, low: float, high: float, y: np.ndarray, copies: np.ndarray, node: np.ndarray) -> None:
        """Holds the cell's classes y, each with some copies, the nodes one after the other, against those that its ring can matter to."""
        start = np.cumsum(copies) - copies
        for a in range(0, len(self.x), 2048):
            x, slack = self.x[a : a + 2048], self.slack[a : a + 2048]
            limit = np.minimum(self.bound[a : a + 2048], self.place[a : a + 2048, -1]) + 2e-9
            far = np.where(np.isfinite(limit), limit, 0)
            to_pivot = _length(_between(x, pivot[None], self.metric), self.metric)[:, 0]
            at = np.flatnonzero(np.maximum(to_pivot - high, low - to_pivot) <= _length(limit, self.metric) + 2 * slack + 1e-7 * far)
            if not len(at):
                continue
            within = limit + 2 * slack * (1 + (self.metric != "cosine") * far)
            i, c = np.nonzero(_between(x[at], y, self.metric) <= within[at, None])
            if len(i):
                i = at[i] + a
                near = np.concatenate([_exact(self.x[i[s : s + 50_000]], y[c[s : s + 50_000]], self.metric) for s in range(0, len(i), 50_000)])
                n = copies[c]
                entry = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                self.take_in(np.repeat(i, n), np.repeat(near, n), node[entry])

    def take_in(self, i: np.ndarray, near: np.ndarray, dst: np.ndarray) -> None:
        met = np.unique(i)
        i = np.concatenate((np.repeat(met, self.take), i))
        near, dst = np.concatenate((self.near[met].ravel(), near)), np.concatenate((self.dst[met].ravel(), dst))
        place = np.round(near, 9)
        order = np.lexsort((dst, place, i))
        i = i[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, rank, order = i[rank < self.take], rank[rank < self.take], order[rank < self.take]
        self.place[i, rank], self.near[i, rank], self.dst[i, rank] = place[order], near[order], dst[order]

    def found(self) -> pa.RecordBatch:
        there = np.isfinite(self.place)
        ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[there])) for v in (self.place, self.dst, self.near)]
        return pa.RecordBatch.from_arrays([pa.array([self.group] * len(self.cls), pa.string()), pa.array(self.cls), *lists], names=["_g", "cls", "place", "dst", "distance"])


def _search(k: int, metric: str):
    """Rows of a slice in order: its classes (kind 0), then cell by cell its pivot with the ring (1) and its classes (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, cell, asking, held = None, None, None, [], []

        def begin() -> Search | None:
            t = pa.Table.from_batches(asking) if asking else None
            return Search(now[0], t.column("cls").to_numpy(), _matrix(t, "x"), t.column("high").to_numpy(), k, metric) if t else None

        def visit() -> None:
            if search and held:
                t = pa.Table.from_batches(held)
                nodes = t.column("nodes").combine_chunks()
                search.visit(*cell, _matrix(t, "x"), np.asarray(pc.list_value_length(nodes)), nodes.flatten().to_numpy())

        for batch in batches:
            change = np.ones(batch.num_rows, bool)
            parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_slice", "kind", *CELL)]
            change[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows, key, kind = batch.slice(a, b - a), (parts[0][a], parts[1][a]), parts[2][a]
                if key != now or kind == 1:
                    visit()
                    held = []
                if key != now:
                    if search:
                        yield search.found()
                    now, search, asking = key, None, []
                if kind == 0:
                    asking.append(rows)
                elif kind == 1:
                    search, asking = search or begin(), []
                    cell = (np.asarray(rows.column("x")[0].as_py(), float), rows.column("low")[0].as_py(), rows.column("high")[0].as_py())
                else:
                    held.append(rows)
        visit()
        if search:
            yield search.found()

    return run


def nearest_in_cells(placed: DataFrame, cells: DataFrame, k: int, metric: str) -> DataFrame:
    """(_g, cls, place, dst, distance): the k + 1 nearest rows of each class, in order, as arrays.

    A group's classes are dealt to slices of about SLICE, and a group's cells pass by each of its slices in one stream: what is
    moved grows with classes times slices, and no row is written for a class and a cell.
    """
    bound = stored(placed.groupBy("_g", *CELL).applyInArrow(_own_bound(k, metric), "_g string, cls long, x array<double>, bound double"), "bounds")
    asking, rings = _sliced(bound, cells, SLICE)
    _, members = _sliced(bound.select("_g", "cls"), placed.select("_g", *CELL, F.col("cls"), "nodes", "x"), SLICE)
    none = lambda kind: F.lit(None).cast(kind)
    names = ("_g", "_slice", "kind", *CELL, "cls", "x", "nodes", "low", "high")
    parts = [
        asking.select("_g", "_slice", F.lit(0), *[F.lit(-1)] * 3, "cls", "x", none("array<bigint>"), none("double"), "bound"),
        rings.select("_g", "_slice", F.lit(1), *CELL, F.lit(-1).cast("long"), "px", none("array<bigint>"), "low", "high"),
        members.select("_g", "_slice", F.lit(2), *CELL, "cls", "x", "nodes", none("double"), none("double")),
    ]
    stream = parts[0].toDF(*names).union(parts[1].toDF(*names)).union(parts[2].toDF(*names)).repartition("_g", "_slice").sortWithinPartitions("_g", "_slice", *CELL, "kind", "cls")
    return stored(stream.mapInArrow(_search(k, metric), "_g string, cls long, place array<double>, dst array<long>, distance array<double>"), "nearest")


def _keyed(patches: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """Rows with a group key that is never null, vectors of length 1 for cosines, and the hash that tells their class."""
    x = F.transform(F.col("x").cast("array<double>"), lambda v: v + F.lit(0.0))
    d = patches.select(*group, F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g"), F.col("node").cast("long").alias("node"), x.alias("x")).where("x is not null")
    if metric == "cosine":
        d = d.withColumn("_n", F.greatest(F.sqrt(dot(F.col("x"), F.col("x"))), F.lit(1e-12))).withColumn("x", F.transform("x", lambda v: v / F.col("_n"))).drop("_n")
    return d.withColumns({"_ha": F.xxhash64("x"), "_hb": F.xxhash64(F.lit(1), "x"), "_part": F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")})


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(_g, _ha, _hb, cls, nodes, parts, x) of each distinct vector of a group: its least k + 1 nodes, cls being the first."""
    key = ["_g", "_ha", "_hb"]
    least = rows.select(*key, "node").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("node"))).where(F.col("_r") <= k + 1)
    least = least.groupBy(*key).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    one = rows.groupBy(*key).agg(F.first("x").alias("x"), F.bit_or(F.expr("shiftleft(1L, _part)")).alias("parts"))
    return one.join(least, key).withColumn("cls", F.col("nodes")[0])


def _sliced(rows: DataFrame, other: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a group dealt to slices, and the other table's rows of the group repeated for each slice."""
    n = rows.groupBy("_g").agg(F.ceil(F.count("*") / size).cast("int").alias("_slices"))
    dealt = rows.join(n, "_g").withColumn("_slice", F.pmod(F.xxhash64("cls"), F.col("_slices")).cast("int")).drop("_slices")
    return dealt, other.join(n, "_g").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")


def pivot_cells(classes: DataFrame, metric: str, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(classes with p, ring, part, dp; cells with px, low, high): each class in the cell of about `block` classes it belongs to."""
    n = classes.groupBy("_g").agg(F.least(F.ceil(F.count("*") / block), F.lit(pivots)).alias("_m"))
    p = classes.select("_g", "cls", "x").withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("cls", F.lit(5)), "cls"))).where(F.col("_r") <= pivots)
    p = stored(p.join(n, "_g").where("_r <= _m").select("_g", (F.col("_r") - 1).cast("int").alias("p"), F.col("x").alias("px")), "pivots")
    rows, held = _sliced(classes.select("_g", "cls", "nodes", "x"), p, SLICE)
    a = rows.groupBy("_g", "_slice").cogroup(held.groupBy("_g", "_slice")).applyInArrow(_assign(metric), "_g string, cls long, nodes array<long>, x array<double>, p int, dp double")
    a = stored(a, "assigned")
    far = a.groupBy("_g", "p").agg(F.max("dp").alias("_far"))
    # a step holds any number of classes; many in one are dealt to parts by their hash
    step = F.when(F.col("_far") > 0, F.floor(F.col("dp") / F.col("_far") * (STEPS - 1))).otherwise(0).cast("int")
    far = far.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    a = a.withColumn("_spread", F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(PARTS)).cast("int")).join(far, ["_g", "p", "_spread"]).withColumn("_step", step)
    count = a.groupBy("_g", "p", "_step").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g", "p").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    rings = count.select("_g", "p", "_step", F.floor(F.coalesce(before, F.lit(0)) / block).cast("int").alias("ring"), F.ceil(F.col("_n") / block).cast("int").alias("_split"))
    rings = rings.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    a = a.join(rings, ["_g", "p", "_step", "_spread"]).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("_split")).cast("int"))
    a = stored(a.select("_g", "cls", "nodes", "x", *CELL, "dp"), "cells")
    cells = a.groupBy("_g", *CELL).agg(F.min("dp").alias("low"), F.max("dp").alias("high"))
    return a, stored(cells.join(p, ["_g", "p"]), "cell-rings")


def cell_visits(classes: DataFrame, cells: DataFrame, k: int, metric: str) -> DataFrame:
    """(_g, cls, p, ring, part): the cells, its own included, that can hold one of the k nearest of each class."""
    bound = classes.groupBy("_g", *CELL).applyInArrow(_own_bound(k, metric), "_g string, cls long, x array<double>, bound double")
    rows, held = _sliced(stored(bound, "bounds"), cells, SLICE)
    found = rows.groupBy("_g", "_slice").cogroup(held.groupBy("_g", "_slice")).applyInArrow(_visit(metric), "_g string, cls long, p int, ring int, part int")
    return stored(found, "visits")


def knn_by_pivots(patches: DataFrame, group: Sequence[str], k: int = 8, metric: str = "cosine", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(group, src, dst, distance) of each row's k nearest in its group, exactly as `graph.knn`; ties go to the smaller node.

    patches: (group..., node, x), nodes unique in a group, vectors of one length without nulls or numbers that are none.
    Rows without a vector take no part, a null group is a group, a lone row has no edge, an empty table gives none; a zero
    vector is at cosine distance 1 from all. Copies of a vector are compared once, however many they are. Vectors spread
    evenly in many dimensions leave nothing to skip; then every class is held against every cell of its group.
    """
    rows = stored(_keyed(patches, group, metric), "rows")
    classes = stored(vector_classes(rows, k), "classes")
    placed, cells = pivot_cells(classes, metric, block, pivots)
    near = nearest_in_cells(placed, cells, k, metric).select("_g", "cls", F.arrays_zip("place", "dst", "distance").alias("_near"))
    near = classes.select("_g", "_ha", "_hb", "cls", "parts").join(near, ["_g", "cls"]).withColumn("_part", F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), i -> getbit(parts, i) = 1)")))
    out = rows.select(*group, "_g", "_ha", "_hb", "_part", "node").join(near, ["_g", "_ha", "_hb", "_part"])
    out = out.withColumn("_e", F.explode(F.slice(F.filter("_near", lambda e: e["dst"] != F.col("node")), 1, k)))
    return out.select(*group, F.col("node").alias("src"), F.col("_e.dst").alias("dst"), F.col("_e.distance").alias("distance"))
