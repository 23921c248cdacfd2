"""Patch scores of sub-bands brought to cells, fused with power and merged over the whole band."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywave.config import BAND_GROUPING, Grouping, LayeredFusion, PatchFusion
from skywave.functions.quantiles import above_quantile, normalize_local, normalize_masked, robust_threshold, sparse_evidence
from skywave.functions.scalars import chunk_blend_weight, clip01
from skywave.operators.components import remove_small, smooth_labels
from skywave.operators.fusion import rectangles
from skywave.operators.merge import CHUNK, FRAME, at_threshold, seed_mask, soft_gate
from skywave.operators.patches import spread_patches
from skywave.operators.texture import banded_fusion, joined, rescore_with_texture, texture_recurrence, texture_reliability
from skywave.operators.windows import box_mean, burst_companion, local_relative_power
from skywave.sources.tables import stored


def fuse_patch_scores(cells: DataFrame, patches: DataFrame, cols: int, settings: PatchFusion = PatchFusion(), gated: bool = False, group: Sequence[str] = CHUNK) -> DataFrame:
    """(group, f, t, valid, score, calibrated, contribution, support, mask, companion, weight) of the sub-bands' cells.

    cells: power_db and valid, with `gated` also gate and residual, from which the companion is made (0 without them);
    patches: (group, pr, pc, score). The score is the patch score raised by power and held back where no companion is,
    normalised; what a sub-band contributes is its calibrated score times the weight of its evidence.
    """
    keys = [*group, "f", "t"]
    d = spread_patches(cells, patches, "score", "_p", group=group).withColumn("_p", clip01(F.col("_p")))
    d = normalize_local(local_relative_power(d, out="_stands", valid=F.col("valid"), group=group), "_stands", "_power", group=group)
    d = burst_companion(d, cols, "gate", "residual", "_companion", group) if gated else d.withColumn("_companion", F.lit(0.0))
    d = stored(d.select(*keys, "valid", "_p", "_power", "_companion"), "fusion-parts")
    d = normalize_local(d.withColumn("_mix", F.col("_p") * (1 - settings.power_gain + settings.power_gain * F.col("_power"))), "_mix", "_fused", group=group)
    d = d.withColumn("_raw", F.col("_fused") * (settings.companion_floor + (1 - settings.companion_floor) * F.col("_companion")))
    d = normalize_local(d, "_raw", "score", group=group)
    d = normalize_local(d.withColumn("_mix", 0.70 * F.col("_p") + 0.30 * F.col("_companion")), "_mix", "_support", group=group)
    d = above_quantile(above_quantile(d, "_support", "_high", settings.support_quantile, group), "score", "_over", settings.score_quantile, group)
    d = stored(d.drop("_mix", "_fused", "_p", "_power"), "fused")
    d = smooth_labels(d, "_high", "_sup", 1, max(3, settings.min_component // 2), group)
    d = stored(smooth_labels(d, "_over", "mask", 1, settings.min_component, group), "fused-masks")

    grids = patches.groupBy(*group).agg((F.max("pr") + 1).alias("_ph"), (F.max("pc") + 1).alias("_pw"))
    sizes = d.groupBy(*group).agg(F.min("f").alias("_f0"), F.min("t").alias("_t0"), (F.max("f") - F.min("f") + 1).alias("_fn"), (F.max("t") - F.min("t") + 1).alias("_tn"))
    at = joined(joined(d, sizes, group), grids, group)
    block = lambda i, n, p: F.floor(i / F.greatest(F.floor(n / p), F.lit(1)))  # noqa: E731  blocks of whole cells, the rest cut off
    at = at.withColumn("_pr", block(F.col("f") - F.col("_f0"), F.col("_fn"), F.col("_ph"))).withColumn("_pc", block(F.col("t") - F.col("_t0"), F.col("_tn"), F.col("_pw"))).where("_pr < _ph and _pc < _pw")
    means = at.groupBy(*group, "_pr", "_pc").agg(F.avg("_raw").alias("strict"), F.avg(F.col("_sup").cast("double")).alias("supported"))
    evidence = sparse_evidence(means, "strict", F.col("supported") >= 0.5, group).select(*group, "weight")

    d = normalize_masked(joined(d, evidence, group), "score", F.col("valid"), "calibrated", 0.60, 0.99, group)
    w = F.col("weight")
    return d.select(*keys, "valid", "score", "calibrated", (F.col("calibrated") * w).alias("contribution"), (F.col("_support") * w >= 0.5).alias("support"), "mask", (F.col("_companion") * w).alias("companion"), "weight")


def merge_contributions(cells: DataFrame, chunks: DataFrame, frame: DataFrame, q: float = 0.85, least: int = 6) -> DataFrame:
    """(capture, frame, f, t, valid, base, companion, score, support, over, mask) of the whole band.

    cells: (chunk, f, t, contribution, companion, support) of overlapping sub-bands; frame: (capture, frame, f, t, valid), all
    cells. The base is the largest contribution and the companion the weighted mean, both under weights that fall towards a
    sub-band's ends; cells of no sub-band have neither. The score is the base held back where the companion is low. `over` is
    where it reaches a robust quantile of the valid supported scores, the mask is `over` after a vote.
    """
    c = chunks.select(F.col("capture_id").alias("_c"), F.col("chunk_index").alias("_i"), "row_start", "row_stop")
    d = cells.join(c, (cells.capture_id == c._c) & (cells.chunk_index == c._i)).drop("_c", "_i")
    d = d.withColumn("_w", chunk_blend_weight(F.col("f") - F.col("row_start"), F.col("row_stop") - F.col("row_start")))
    mean = F.sum(F.col("_w") * F.col("companion")) / F.greatest(F.sum("_w"), F.lit(1e-6))
    found = d.groupBy(*FRAME, "f", "t").agg(F.max(F.col("_w") * F.col("contribution")).alias("base"), mean.alias("companion"), F.max("support").alias("support"))
    d = frame.select(*FRAME, "f", "t", "valid").join(found, [*FRAME, "f", "t"], "left").fillna({"base": 0.0, "companion": 0.0, "support": False})
    d = normalize_local(d.withColumn("base", F.greatest("base", F.lit(0.0))), "companion", "_n", group=FRAME)
    d = normalize_local(d.withColumn("_mix", F.col("base") * (0.30 + 0.70 * F.col("_n"))), "_mix", "score", group=FRAME).drop("_n", "_mix")
    d = stored(d, "merged")
    d = at_threshold(d, "score", robust_threshold(d, "score", q, F.col("valid") & F.col("support"), group=FRAME), "over", FRAME, F.col("support"))
    d = smooth_labels(stored(d, "over"), "over", "mask", 1, least, FRAME)
    held = {"mask": F.col("mask") & F.col("valid"), "support": F.col("support") & F.col("valid"), "score": F.when(F.col("valid"), F.col("score")).otherwise(F.lit(0.0))}
    return stored(d.withColumns(held).select(*FRAME, "f", "t", "valid", "base", "companion", "score", "support", "over", "mask"), "band")


def merged_boxes(band: DataFrame, grouping: Grouping = BAND_GROUPING, least: int = 6) -> DataFrame:
    """Boxes of a merged band: its seeds, bridged to rectangles (every component, with `keep`)."""
    grouping = replace(grouping, min_size=max(grouping.min_size, least))
    return rectangles(seed_mask(band), "seed", "score", grouping, FRAME, "valid")[0]


def fused_band(cells: DataFrame, patches: DataFrame, chunks: DataFrame, frame: DataFrame, cols: int, settings: PatchFusion = PatchFusion(), gated: bool = False) -> DataFrame:
    """The whole band's cells (merge_contributions) of sub-bands fused by fuse_patch_scores."""
    d = stored(fuse_patch_scores(cells, patches, cols, settings, gated), "fused-chunks")
    return merge_contributions(d, chunks, frame, settings.score_quantile, settings.min_component)


def _on_cells(cells: DataFrame, maps: DataFrame, names: Sequence[str], mode: str, group: Sequence[str] = CHUNK) -> DataFrame:
    """cells with columns of a patch table (group, f, t as the patch's place) resized to them; masks are nearest, at least .5."""
    for name in names:
        m = maps.select(*group, F.col("f").alias("pr"), F.col("t").alias("pc"), F.col(name).cast("double").alias(name))
        cells = spread_patches(cells, m, name, name, mode, mode, group)
        if mode == "nearest":
            cells = cells.withColumn(name, F.col(name) >= 0.5)
    return cells


def texture_band(cells: DataFrame, patches: DataFrame, chunks: DataFrame, frame: DataFrame, q: float = 0.88, least: int = 6) -> DataFrame:
    """The whole band merged again from sub-bands that texture has rescored.

    cells: (chunk, f, t, support); patches: (chunk, f, t as the patch's place, texture, score, power, gate, support, strict,
    companion). What a sub-band contributes is its rescored patch map on cells, calibrated; every row counts as valid.
    """
    p = normalize_local(rescore_with_texture(patches, q=q, least=least, group=CHUNK), "companion", "companion_n", group=CHUNK)
    p = stored(p.select(*CHUNK, "f", "t", F.col("rescored").alias("contribution"), F.col("companion_n").alias("companion")), "rescored-patches")
    d = _on_cells(cells.select(*CHUNK, "f", "t", "support"), p, ("contribution", "companion"), "bilinear")
    d = normalize_masked(stored(d, "rescored-cells"), "contribution", F.lit(True), "contribution", 0.60, 0.99, CHUNK)
    return merge_contributions(d, chunks, frame.withColumn("valid", F.lit(True)), q, least)


def layer_patches(patches: DataFrame, settings: LayeredFusion = LayeredFusion()) -> DataFrame:
    """Patches of sub-bands with agreement, final, mask, support, companion and the policy that led to them.

    patches: (chunk, f, t as the patch's place, score, power, gate, texture, companion). Patch score and power are gated by
    structure; their agreement is cut into bands, texture is let through as far as it can be trusted and the structure does
    not speckle. Where it speckles (speckle_active) the final cut and the least component are the higher ones.
    `rescued_structure` is the structure raised where raw power is high.
    """
    s, keys = settings, [*CHUNK, "f", "t"]
    d = soft_gate(soft_gate(patches, "score", "gate", "_own", s.gate_floor, CHUNK), "power", "gate", "_pow", s.gate_floor, CHUNK)
    for name, source in (("_own", "_own"), ("_pow", "_pow"), ("_tex", "texture"), ("_str", "gate"), ("_raw", "power")):
        d = normalize_local(d, source, name, group=CHUNK)
    d = d.withColumn("agreement", F.sqrt(F.greatest(F.col("_own") * F.col("_pow"), F.lit(0.0))))
    d = stored(d.select(*keys, "agreement", "_tex", "_str", "_raw", "companion"), "layers")
    d = joined(d, texture_reliability(d, "_tex", "agreement", CHUNK).select(*CHUNK, "reliability"), CHUNK)
    d = stored(banded_fusion(d, "agreement", "_str", "_tex", "reliability", "final", s.gap_floor, s.clean_speckle, s.strong_speckle, False, True, CHUNK), "layered")
    low = 0.10 + 0.08 * F.col("reliability")
    rescue = clip01((F.col("_mean") - s.rescue_floor) / max(1 - s.rescue_floor, 1e-6))
    span = F.greatest(0.45 + 0.12 * F.col("reliability") - low, F.lit(0.05))
    d = box_mean(d, "_raw", "_mean", 3, 3, CHUNK).withColumn("rescued_structure", clip01(F.col("_str") + s.rescue_gain * span * F.when(F.col("agreement") >= low, rescue).otherwise(F.lit(0.0))))
    d = d.withColumn("speckle_active", F.col("band_weight") < 1)
    either = lambda a, b: F.when(F.col("speckle_active"), F.lit(a)).otherwise(F.lit(b))
    d = stored(d.withColumn("_over", F.col("final") >= either(s.threshold, s.threshold_clean)), "layered-cut")
    d = remove_small(d, "_over", "mask", either(s.min_component, s.min_component_clean), CHUNK)
    w = F.col("texture_weight")
    d = normalize_local(d.withColumn("_mix", w * F.col("_tex") + (1 - w) * F.col("companion")).drop("companion"), "_mix", "companion", group=CHUNK)
    d = normalize_local(d.withColumn("_mix", 0.55 * F.col("final") + 0.25 * F.col("agreement") + 0.20 * F.col("companion")), "_mix", "_sup", group=CHUNK)
    d = above_quantile(d, "_sup", "_high", s.support_quantile, CHUNK).withColumn("_either", F.col("_high") | F.col("mask"))
    d = smooth_labels(stored(d, "layered-support"), "_either", "support", 1, max(3, s.vote_component // 2), CHUNK)
    return d.select(*keys, "agreement", "reliability", "texture_weight", "band_weight", "speckle_active", "rescued_structure", "final", "mask", "support", "companion")


def layered_band(cells: DataFrame, patches: DataFrame, chunks: DataFrame, frame: DataFrame, settings: LayeredFusion = LayeredFusion(), q: float = 0.85) -> DataFrame:
    """The whole band's cells (merge_contributions) of sub-bands layered by layer_patches; every row counts as valid."""
    p = stored(layer_patches(patches, settings), "layered-patches")
    d = _on_cells(_on_cells(cells.select(*CHUNK, "f", "t"), p, ("final", "companion"), "bilinear"), p, ("support",), "nearest")
    return merge_contributions(stored(d.withColumnRenamed("final", "contribution"), "layered-cells"), chunks, frame.withColumn("valid", F.lit(True)), q, settings.vote_component)


def compare_with_texture(cells: DataFrame, regions: DataFrame, pixels: DataFrame, q: float = 0.90, k: int = 6, group: Sequence[str] = CHUNK) -> DataFrame:
    """Cells with two views of their sub-band side by side: (group, f, t, region_score, region_mask, texture_score, texture_mask).

    regions: (group, pr, pc, score, mask) from embeddings; pixels: (group, node, pr, pc, x), each patch's cells. Scores are
    brought to cells linearly, masks by the nearest patch.
    """
    t = joined(texture_recurrence(pixels, group, k), pixels.select(*group, "node", "pr", "pc"), [*group, "node"])
    t = above_quantile(t.withColumnRenamed("recurrence", "score"), "score", "mask", q, group)
    d = cells.select(*group, "f", "t")
    for name, maps in (("region", regions), ("texture", t)):
        m = stored(maps.select(*group, "pr", "pc", "score", F.col("mask").cast("double").alias("mask")), f"{name}-map")
        d = spread_patches(d, m, "score", f"{name}_score", "bilinear", "bilinear", group)
        d = spread_patches(d, m, "mask", f"{name}_mask", "nearest", "nearest", group).withColumn(f"{name}_mask", F.col(f"{name}_mask") >= 0.5)
    return d
