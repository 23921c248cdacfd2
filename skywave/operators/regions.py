"""Regions of a patch grid that hang together by their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywave.functions.quantiles import normalize_local, normalize_vector, select_components, with_scalars
from skywave.operators import graph as gr
from skywave.operators.components import component_cells, connected_components, mark, smooth_labels
from skywave.operators.fusion import content_features, principal_features
from skywave.operators.windows import box_mean
from skywave.sources.tables import stored


def region_components(grown: DataFrame, patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, component) of grown patches, corners included."""
    at = grown.join(patches.select(*group, "node", F.col("pr").alias("f"), F.col("pc").alias("t")), [*group, "node"])
    cells = component_cells(connected_components(at.withColumn("_on", F.lit(True)), "_on", True, group), group)
    return at.join(cells, [*group, "f", "t"]).select(*group, "node", "component")


def component_summary(components: DataFrame, edges: DataFrame, scores: DataFrame, patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, component, share, support_mean, support_peak, internal, boundary, seed_mean, smoothness, score).

    components: (group, node, component); edges: symmetric (group, src, dst, weight); scores: (group, node, score);
    patches: (group, node, pr, pc, seed), the whole grid, seed within 0..1. An absent edge weighs 0. The score mixes the
    parts, each scaled over the group's components (equal values become ones), less .10 for a component of much over
    30 % of the grid.
    """
    c = components.select(*group, "node", "component")
    ends = [c.select(*group, F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("src", "dst")]
    inside = edges.where("src <> dst").join(ends[0], [*group, "src"]).join(ends[1], [*group, "dst"]).where("c_src = c_dst")
    inside = inside.groupBy(*group, F.col("c_src").alias("component")).agg(F.sum("weight").alias("_sum"))
    near = gr.grid_pairs(patches, group).join(ends[0], [*group, "src"]).join(ends[1], [*group, "dst"], "left").where("c_dst is null or c_src <> c_dst")
    near = near.join(edges.select(*group, "src", "dst", "weight"), [*group, "src", "dst"], "left")
    spot = lambda n: patches.select(*group, F.col("node").alias(n), F.col("pr").alias(f"pr_{n}"), F.col("pc").alias(f"pc_{n}"))
    near = near.join(spot("src"), [*group, "src"]).join(spot("dst"), [*group, "dst"])
    outside = near.groupBy(*group, F.col("c_src").alias("component")).agg(
        F.avg(F.coalesce("weight", F.lit(0.0))).alias("boundary"), F.count_if(F.col("pc_src") == F.col("pc_dst")).alias("_up"), F.count_if(F.col("pr_src") == F.col("pr_dst")).alias("_side")
    )
    grids = patches.groupBy(*group).agg(F.count("*").alias("_all"), (F.max("pr") + 1).alias("_rows"), (F.max("pc") + 1).alias("_cols"))
    d = c.join(scores.select(*group, "node", F.col("score").alias("_s")), [*group, "node"]).join(patches.select(*group, "node", "seed"), [*group, "node"])
    d = d.groupBy(*group, "component").agg(F.count("*").alias("_n"), F.avg("_s").alias("support_mean"), F.percentile("_s", F.lit(0.90)).alias("support_peak"), F.avg("seed").alias("seed_mean"))
    d = d.join(inside, [*group, "component"], "left").join(outside, [*group, "component"], "left").join(grids, list(group))
    pairs = F.col("_n") * (F.col("_n") - 1)
    turn = lambda count, there: F.when(there > 0, F.coalesce(count, F.lit(0)) / there).otherwise(F.lit(0.0))
    d = d.select(
        *group, "component", (F.col("_n") / F.col("_all")).alias("share"), "support_mean", "support_peak", F.when(pairs > 0, F.coalesce("_sum", F.lit(0.0)) / pairs).otherwise(F.lit(0.0)).alias("internal"),
        F.coalesce("boundary", F.lit(0.0)).alias("boundary"), "seed_mean",
        (1 - 0.5 * (turn(F.col("_up"), (F.col("_rows") - 1) * F.col("_cols")) + turn(F.col("_side"), (F.col("_cols") - 1) * F.col("_rows")))).alias("smoothness"),
    )
    d = d.withColumn("_gap", F.col("internal") - F.col("boundary"))
    total = -0.10 * F.least(F.greatest((F.col("share") - 0.30) / 0.20, F.lit(0.0)), F.lit(1.0))
    parts = {"support_mean": 0.35, "support_peak": 0.20, "internal": 0.20, "_gap": 0.15, "seed_mean": 0.05, "smoothness": 0.05}
    for name, w in parts.items():
        d = normalize_vector(d, name, f"_v{name}", group)
        total = total + w * F.col(f"_v{name}")
    return d.withColumn("score", total).drop("_gap", *[f"_v{n}" for n in parts])


def _local(features: DataFrame, patches: DataFrame, group: Sequence[str], k: int, shortcut: float) -> tuple[DataFrame, DataFrame]:
    """(local affinities, grid pairs) of the patches' features."""
    full = stored(gr.affinity(gr.knn(gr.centre_and_normalize(features, group), group, k), group), "affinity")
    pairs = gr.grid_pairs(patches, group)
    return stored(gr.with_shortcuts(gr.mutual_edges(full, group, k, 0.40), full, pairs, group, shortcut), "local-affinity"), pairs


def region_mask(patches: DataFrame, group: Sequence[str], k: int = 8, shortcut: float = 0.35, q: float = 0.60, votes: int = 2, least: int = 6) -> DataFrame:
    """(group, node, pr, pc, score, region, mask): patches of regions that hang together, grown from well-connected seeds.

    patches: (group, node, pr, pc, x, seed), one frame's grid a group. Features are freed of what follows the position; the
    best regions are chosen by component_summary, and a patch's score is .70 of the smoothed support inside them, .20 of
    its region's score and .10 of its seed. A mask under 2 % of the grid gives way to the upper quarter of the support.
    """
    p = stored(normalize_local(patches.where("x is not null"), "seed", "seed", group=group).select(*group, "node", "pr", "pc", "x", "seed"), "patches")
    local, pairs = _local(content_features(p, group), p, group, k, shortcut)
    scores = stored(gr.affinity_scores(local, p, group), "support")
    parts = stored(region_components(gr.grow_seeds(scores, local, pairs, group), p, group), "regions")
    table = stored(component_summary(parts, local, scores, p, group), "region-table")
    chosen = parts.join(select_components(table, group=group).select(*group, "component"), [*group, "component"], "left_semi")
    worth = normalize_vector(table.withColumn("_w", F.greatest(F.col("score"), F.lit(0.0))), "_w", "_w", group).select(*group, "component", "_w")
    worth = parts.join(worth, [*group, "component"]).select(*group, "node", "_w")
    d = p.select(*group, "node", F.col("pr").alias("f"), F.col("pc").alias("t"), "seed").join(scores.withColumnRenamed("score", "support"), [*group, "node"]).join(worth, [*group, "node"], "left")
    at = chosen.join(p.select(*group, "node", F.col("pr").alias("f"), F.col("pc").alias("t")), [*group, "node"])
    d = stored(smooth_labels(mark(d, at, "_in", group), "_in", "region", votes, least, group), "chosen-regions")
    d = box_mean(d.withColumn("_s", F.when(F.col("region"), F.col("support")).otherwise(F.lit(0.0))), "_s", "_blur", 3, 3, group)
    d = normalize_local(d, "_blur", "_blur", group=group).withColumn("_mix", 0.70 * F.col("_blur") + 0.20 * F.coalesce("_w", F.lit(0.0)) + 0.10 * F.col("seed"))
    d = stored(normalize_local(d, "_mix", "score", group=group), "region-score")
    inner = F.when(F.col("region"), F.col("score"))
    d = with_scalars(d, group, _n=F.count(inner), _qi=F.percentile(inner, F.lit(q)), _qa=F.percentile("score", F.lit(q)), _qb=F.percentile("_blur", F.lit(0.75)))
    d = d.withColumn("_m", F.when(F.col("_n") >= 4, F.col("region") & (F.col("score") >= F.col("_qi"))).otherwise(F.col("score") >= F.col("_qa")))
    d = with_scalars(d, group, _share=F.avg(F.col("_m").cast("double")))
    d = d.withColumn("_m", F.when((F.col("_n") >= 4) & (F.col("_share") < 0.02), F.col("_blur") >= F.col("_qb")).otherwise(F.col("_m")))
    d = smooth_labels(d, "_m", "mask", 1, max(2, least // 2), group)
    return d.select(*group, "node", F.col("f").alias("pr"), F.col("t").alias("pc"), "score", "region", "mask")


def simple_region_mask(patches: DataFrame, group: Sequence[str], k: int = 8, shortcut: float = 0.35, q: float = 0.60, least: int = 6) -> DataFrame:
    """(group, node, pr, pc, score, mask): support by local affinity, raised a little by the seeds; positions are not removed."""
    p = stored(normalize_local(patches.where("x is not null"), "seed", "seed", group=group).select(*group, "node", "pr", "pc", "x", "seed"), "patches")
    local, _ = _local(principal_features(p, group), p, group, k, shortcut)
    s = gr.affinity_scores(local, p, group).withColumnRenamed("score", "support")
    d = p.select(*group, "node", F.col("pr").alias("f"), F.col("pc").alias("t"), "seed").join(s, [*group, "node"]).withColumn("_mix", F.col("support") * (0.90 + 0.10 * F.col("seed")))
    d = with_scalars(normalize_local(d, "_mix", "score", group=group), group, _q=F.percentile("score", F.lit(q))).withColumn("_m", F.col("score") >= F.col("_q"))
    d = smooth_labels(stored(d, "simple-score"), "_m", "mask", 1, least, group)
    return d.select(*group, "node", F.col("f").alias("pr"), F.col("t").alias("pc"), "score", "mask")
