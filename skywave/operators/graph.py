"""Patch graphs: nearest neighbours inside a group, affinities, scores, growth. Features are an input column.

patches: (group..., pr, pc, node, x ARRAY<DOUBLE>); edges: (group..., src, dst, weight).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skywave.functions.quantiles import normalize_local, with_scalars

#: Patches in a block of a group, about.
BLOCK = 2048
SIDES = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardize(patches: DataFrame, group: Sequence[str], dims: int | None = None, eps: float = 1e-8) -> DataFrame:
    """Each channel less its mean over its spread in the group; the first `dims` channels."""
    x = F.slice("x", 1, dims) if dims else F.col("x")
    long = patches.select(*group, F.posexplode(x).alias("ch", "v")).groupBy(*group, "ch").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = long.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.array_sort(F.collect_list(F.struct("ch", "m", "s"))).alias("st"))
    on = F.lit(True)
    for g in group:
        on = on & (patches[g] == F.col(f"_{g}"))
    return patches.join(stats, on).withColumn("x", F.zip_with(x, F.col("st"), lambda v, s: (v - s["m"]) / (s["s"] + eps))).drop("st", *[f"_{g}" for g in group])


def centre_and_normalize(patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Vectors less the group's mean vector, of length 1."""
    means = patches.select(*group, F.posexplode("x").alias("ch", "v")).groupBy(*group, "ch").agg(F.avg("v").alias("m"))
    mean = means.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.array_sort(F.collect_list(F.struct("ch", "m"))).alias("_mean"))
    on = F.lit(True)
    for g in group:
        on = on & (patches[g] == F.col(f"_{g}"))
    d = patches.join(mean, on).withColumn("x", F.zip_with("x", "_mean", lambda v, m: v - m["m"])).drop("_mean", *[f"_{g}" for g in group])
    return d.withColumn("x", F.transform("x", lambda v: v / F.greatest(F.sqrt(dot(F.col("x"), F.col("x"))), F.lit(1e-6))))


def _nearest(k: int, metric: str, rows: int = 512):
    def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x @ y.T
        return 1 - d if metric == "cosine" else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * d, 0))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, block = t.column("node").to_numpy(), t.column("_block").to_numpy()
        x = np.asarray(t.column("x").combine_chunks().flatten(), float).reshape(len(node), -1)
        order = np.argsort(node, kind="stable")
        node, block, x = node[order], block[order], x[order]
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        *group, low, high = key
        low, high = (np.flatnonzero(block == b.as_py()) for b in (low, high))
        src, dst, dist, place = [], [], [], []
        for of, to in [(low, high)] if key[-2] == key[-1] else [(low, high), (high, low)]:
            take = min(k, len(to))
            for a in range(0, len(of) if take else 0, rows):
                q = of[a : a + rows]
                d = between(x[q], x[to])
                d[node[q][:, None] == node[to][None]] = np.inf  # a node is not its own neighbour
                r = np.round(d, 9)
                i, j = np.nonzero((r <= np.partition(r, take - 1, axis=1)[:, take - 1 : take]) & (r < np.inf))
                near = np.lexsort((j, r[i, j], i))
                i, j = i[near], j[near]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                src.append(node[q[i]])
                dst.append(node[to[j]])
                dist.append(d[i, j])
                place.append(r[i, j])
        cat = lambda c, kind: pa.array(np.concatenate(c) if c else [], kind)
        n = sum(map(len, src))
        cols = {f"_k{i}": pa.array([v.as_py()] * n, v.type) for i, v in enumerate(group)}
        return pa.table(cols | {"src": cat(src, pa.int64()), "dst": cat(dst, pa.int64()), "distance": cat(dist, pa.float64()), "_place": cat(place, pa.float64())})

    return run


def knn(patches: DataFrame, group: Sequence[str], k: int = 8, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(group, src, dst, distance) of each patch's k nearest in its group; ties go to the smaller node.

    A group of any size is cut into blocks by the node's hash, and a task measures one pair of blocks; each patch keeps the
    best k of its pairs. The distances of a group are all made, so work grows with the square of its size;
    `pivots.knn_by_pivots` gives the same edges and skips what cannot hold a neighbour.
    """
    d = patches.select(*group, F.col("node").cast("long").alias("node"), F.col("x").cast("array<double>").alias("x"))
    d = with_scalars(d, group, _blocks=F.ceil(F.count("*") / block).cast("int")).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    schema = ", ".join([f"_k{i} {d.schema[g].dataType.simpleString()}" for i, g in enumerate(group)]) + ", src long, dst long, distance double, _place double"
    found = d.select(*group, "node", "x", "_block", "_low", "_high").groupBy(*group, "_low", "_high").applyInArrow(_nearest(k, metric), schema)
    best = Window.partitionBy(*[f"_k{i}" for i in range(len(group))], "src").orderBy("_place", "dst")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return found.select(*[F.col(f"_k{i}").alias(g) for i, g in enumerate(group)], "src", "dst", "distance")


def affinity(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Symmetric weights exp(-d^2 / 2 s^2), s being the median positive distance (1e-3 at the least); the larger direction holds."""
    d = with_scalars(edges, group, _s=F.greatest(F.coalesce(F.percentile(F.when(F.col("distance") > 0, F.col("distance")), F.lit(0.5)), F.lit(1e-3)), F.lit(1e-3)))
    d = d.withColumn("weight", F.exp(-F.col("distance") * F.col("distance") / (2 * F.col("_s") * F.col("_s"))))
    both = d.select(*group, "src", "dst", "weight").union(d.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy(*group, "src", "dst").agg(F.max("weight").alias("weight"))


def mutual_edges(edges: DataFrame, group: Sequence[str], top_k: int = 8, keep_q: float = 0.40) -> DataFrame:
    """Edges among each end's top k, in both directions, whose weight reaches a quantile of all such; without any, all edges."""
    r = edges.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "src").orderBy(F.col("weight").desc(), F.col("dst").desc()))).where(F.col("_r") <= top_k).drop("_r")
    back = r.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("src").alias("_s"), F.col("dst").alias("_d"))
    on = (r.src == F.col("_d")) & (r.dst == F.col("_s"))
    for g in group:
        on = on & (r[g] == F.col(f"_{g}"))
    m = r.join(back, on, "left_semi")
    m = with_scalars(m, group, _q=F.percentile(F.when(F.col("weight") > 0, F.col("weight")), F.lit(keep_q)))
    kept = m.where((F.col("weight") > 0) & (F.col("weight") >= F.col("_q"))).drop("_q")
    none = edges.join(kept.select(*group).distinct(), list(group), "left_anti")
    return kept.unionByName(none.select(*kept.columns))


def grid_pairs(patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, src, dst) of the patches that touch on the grid, corners included."""
    steps = patches.sparkSession.createDataFrame(SIDES, "dr int, dc int")
    a = patches.crossJoin(F.broadcast(steps)).select(*group, F.col("node").alias("src"), (F.col("pr") + F.col("dr")).alias("_r"), (F.col("pc") + F.col("dc")).alias("_c"))
    b = patches.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("node").alias("dst"), F.col("pr").alias("_pr"), F.col("pc").alias("_pc"))
    on = (F.col("_r") == F.col("_pr")) & (F.col("_c") == F.col("_pc"))
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return a.join(b, on).select(*group, "src", "dst")


def with_shortcuts(edges: DataFrame, full: DataFrame, pairs: DataFrame, group: Sequence[str], weight: float = 0.20) -> DataFrame:
    """Edges raised to a share of the full affinity between patches that touch."""
    on = [*group, "src", "dst"]
    near = full.where("weight > 0").join(pairs, on, "left_semi").select(*on, (F.col("weight") * weight).alias("weight"))
    return edges.select(*on, "weight").union(near).groupBy(*on).agg(F.max("weight").alias("weight"))


def return_probabilities(edges: DataFrame, patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, degree, two_step, three_step): weighted degree and chances to be back after two and three steps.

    Every node has a loop of weight 1. Three steps are a triangle join, which the few edges of a node bound.
    """
    loops = patches.select(*group, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    e = edges.select(*group, "src", "dst", "weight").where("src <> dst").union(loops)
    sums = e.groupBy(*group, "src").agg(F.sum("weight").alias("_sum"))
    t = e.join(sums, [*group, "src"]).select(*group, "src", "dst", "weight", (F.col("weight") / F.col("_sum")).alias("p"))
    degree = e.where("src <> dst").groupBy(*group, "src").agg(F.sum("weight").alias("degree"))
    ab = t.select(*group, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("p").alias("pab"))
    ba = t.select(*group, F.col("src").alias("b"), F.col("dst").alias("a"), F.col("p").alias("pba"))
    two = ab.join(ba, [*group, "a", "b"]).groupBy(*group, "a").agg(F.sum(F.col("pab") * F.col("pba")).alias("two_step"))
    bc = t.select(*group, F.col("src").alias("b"), F.col("dst").alias("c"), F.col("p").alias("pbc"))
    ca = t.select(*group, F.col("src").alias("c"), F.col("dst").alias("a"), F.col("p").alias("pca"))
    three = ab.join(bc, [*group, "b"]).join(ca, [*group, "c", "a"]).groupBy(*group, "a").agg(F.sum(F.col("pab") * F.col("pbc") * F.col("pca")).alias("three_step"))
    nodes = patches.select(*group, F.col("node").alias("src"))
    out = nodes.join(degree, [*group, "src"], "left").join(two.withColumnRenamed("a", "src"), [*group, "src"], "left").join(three.withColumnRenamed("a", "src"), [*group, "src"], "left")
    return out.select(*group, F.col("src").alias("node"), F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("two_step", F.lit(0.0)).alias("two_step"), F.coalesce("three_step", F.lit(0.0)).alias("three_step"))


def affinity_scores(edges: DataFrame, patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, score): degree, return chances and nearness to the touching patches, each min-max scaled, mixed."""
    r = return_probabilities(edges, patches, group)
    pairs = grid_pairs(patches, group).join(edges.select(*group, "src", "dst", "weight"), [*group, "src", "dst"], "left")
    near = pairs.groupBy(*group, "src").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("near")).withColumnRenamed("src", "node")
    d = r.join(near, [*group, "node"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    parts = ("degree", "two_step", "three_step", "near")
    d = with_scalars(d, group, **{f"_{m}_{c}": f(c) for c in parts for m, f in (("low", F.min), ("high", F.max))})
    scaled = lambda c: (F.col(c) - F.col(f"_low_{c}")) / F.greatest(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(1e-8))
    d = d.withColumn("_mix", 0.35 * scaled("degree") + 0.30 * scaled("two_step") + 0.20 * scaled("three_step") + 0.15 * scaled("near"))
    return normalize_local(d, "_mix", "score", group=group).select(*group, "node", "score")


def grow_seeds(scores: DataFrame, edges: DataFrame, pairs: DataFrame, group: Sequence[str], rounds: int = 2, edge_q: float = 0.55, seed_q: float = 0.72, eligible_q: float = 0.58) -> DataFrame:
    """(group, node) reached from high-scoring seeds through strong edges between touching patches that score well enough."""
    cut = with_scalars(edges.where("src <> dst and weight > 0"), group, _e=F.percentile("weight", F.lit(edge_q)))
    strong = cut.where(F.col("weight") >= F.col("_e")).select(*group, "src", "dst").join(pairs, [*group, "src", "dst"], "left_semi")
    s = with_scalars(scores, group, _q=F.percentile("score", F.array(F.lit(seed_q), F.lit(eligible_q))))
    grown = s.where(F.col("score") >= F.col("_q")[0]).select(*group, "node")
    eligible = s.where(F.col("score") >= F.col("_q")[1]).select(*group, "node")
    for _ in range(rounds):
        step = strong.join(grown.withColumnRenamed("node", "src"), [*group, "src"], "left_semi").select(*group, F.col("dst").alias("node"))
        grown = grown.union(step.join(eligible, [*group, "node"], "left_semi")).distinct()
    return grown


def propagate(p: DataFrame, edges: DataFrame, group: Sequence[str], alpha: float = 0.82, rounds: int = 2) -> DataFrame:
    """(group, node, p): values smoothed over neighbours, (1 - alpha) of the first value kept in each round; within 0..1."""
    d = with_scalars(edges, group, _s=F.greatest(F.coalesce(F.percentile(F.when(F.col("distance") > 0, F.col("distance")), F.lit(0.5)), F.lit(1e-6)), F.lit(1e-6)))
    d = d.withColumn("w", F.exp(-F.col("distance") * F.col("distance") / (2 * F.col("_s") * F.col("_s"))))
    d = d.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*group, "src"))).select(*group, "src", "dst", "w")
    start = p.select(*group, "node", F.col("p").alias("p0"))
    now = p.select(*group, "node", "p")
    for _ in range(rounds):
        near = d.join(now.withColumnRenamed("node", "dst"), [*group, "dst"]).groupBy(*group, "src").agg(F.sum(F.col("w") * F.col("p")).alias("s"))
        now = start.join(near.withColumnRenamed("src", "node"), [*group, "node"]).select(*group, "node", F.least(F.greatest(alpha * F.col("s") + (1 - alpha) * F.col("p0"), F.lit(0.0)), F.lit(1.0)).alias("p"))
    return now


def propagate_in_frames(p: DataFrame, edges: DataFrame, group: Sequence[str], alpha: float = 0.82, rounds: int = 20) -> DataFrame:
    """propagate() for many rounds: a frame's patches and edges (k a patch) meet in one task, so the rounds cost one shuffle."""

    def run(now: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if now.empty:
            return now
        start = now["p"].to_numpy(float)
        if near.empty:
            return now
        at = pd.Index(now["node"])
        i, j, d = at.get_indexer(near["src"]), at.get_indexer(near["dst"]), near["distance"].to_numpy(float)
        s = np.median(d[d > 0]) if (d > 0).any() else 1.0
        w = np.exp(-(d**2) / (2 * s * s + 1e-8))
        w = w / (np.bincount(i, w, len(start))[i] + 1e-8)
        x = start
        for _ in range(rounds):
            x = np.clip(alpha * np.bincount(i, w * x[j], len(start)) + (1 - alpha) * start, 0.0, 1.0)
        return now.assign(p=x)

    cols = [*group, "node", "p"]
    types = {f.name: f.dataType.simpleString() for f in p.schema}
    return p.select(*cols).groupBy(*group).cogroup(edges.groupBy(*group)).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols))


def prototypes(patches: DataFrame, cue: str, group: Sequence[str]) -> DataFrame:
    """(group, side, ch, mean, var): channel statistics of the patches of low (noise) and high (signal) cue.

    The lowest 20 % and the highest 8 %; a side of fewer than ten takes the lowest 30 %, or the highest 15 %.
    """
    d = with_scalars(patches, group, _q=F.percentile(cue, F.array(F.lit(0.20), F.lit(0.92), F.lit(0.30), F.lit(0.85))))
    x = F.col(cue)
    d = with_scalars(d, group, _lo=F.count_if(x <= F.col("_q")[0]), _hi=F.count_if(x >= F.col("_q")[1]))
    low, high = F.when(F.col("_lo") < 10, F.col("_q")[2]).otherwise(F.col("_q")[0]), F.when(F.col("_hi") < 10, F.col("_q")[3]).otherwise(F.col("_q")[1])
    sides = d.withColumn("side", F.explode(F.array(F.when(x <= low, F.lit("noise")), F.when(x >= high, F.lit("signal"))))).where("side is not null").select(*group, "side", F.posexplode("x").alias("ch", "v"))
    return sides.groupBy(*group, "side", "ch").agg(F.avg("v").alias("mean"), (F.var_pop("v") + 1e-3).alias("var"))


def prototype_ratio(patches: DataFrame, protos: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, ratio): sigmoid of the standardised log-ratio of the distances to noise and to signal.

    It is higher where a patch is nearer to the signal prototype.
    """
    long = patches.select(*group, "node", F.posexplode("x").alias("ch", "v")).join(protos, [*group, "ch"])
    dist = long.groupBy(*group, "node", "side").agg(F.sum((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")) / (F.col("var") + 1e-8)).alias("d"))
    r = dist.groupBy(*group, "node").agg((F.log(F.max(F.when(F.col("side") == "noise", F.col("d"))) + 1e-6) - F.log(F.max(F.when(F.col("side") == "signal", F.col("d"))) + 1e-6)).alias("r"))
    r = with_scalars(r, group, _mean=F.avg("r"), _spread=F.stddev_pop("r"))
    z = (F.col("r") - F.col("_mean")) / (F.col("_spread") + 1e-8)
    return r.withColumn("ratio", 1 / (1 + F.exp(-z))).select(*group, "node", "ratio")


def unit_vectors(patches: DataFrame) -> DataFrame:
    """Patches with vectors of length 1."""
    return patches.withColumn("_n", F.greatest(F.sqrt(dot(F.col("x"), F.col("x"))), F.lit(1e-12))).withColumn("x", F.transform("x", lambda v: v / F.col("_n"))).drop("_n")
