"""Texture of patches: recurrence, how far it can be trusted, and fusing it with banded scores.

Maps are columns of a table of (group..., f, t); policies are one row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywave.functions.quantiles import GROUP, above_quantile, normalize_local, with_scalars
from skywave.operators.components import connected_components, smooth_labels
from skywave.operators.graph import knn
from skywave.sources.tables import stored


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def joined(df: DataFrame, scalars: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """df with the columns of a table that has one row for each group."""
    return df.join(scalars, list(group))


def score_bands(df: DataFrame, score: str, reliability: str) -> DataFrame:
    """df with `strong`, `mid` and `low`: whether a score lies in each band. The cuts rise with the reliability (a column),
    and a band reaches a little over the foot of the next one."""
    r, s = F.col(reliability), F.col(score)
    strong, mid, low = 0.44 + 0.12 * r, 0.24 + 0.10 * r, 0.10 + 0.08 * r
    mid_top = F.least(F.lit(1.0), strong + clip(0.15 * F.greatest(strong - mid, F.lit(0.0)), 0.012, 0.035))
    low_top = F.least(F.lit(1.0), mid + clip(0.15 * F.greatest(mid - low, F.lit(0.0)), 0.012, 0.030))
    return df.withColumns({"strong": s >= strong, "mid": (s >= mid) & (s < mid_top), "low": (s >= low) & (s < low_top)})


def texture_recurrence(patches: DataFrame, group: Sequence[str], k: int = 6, far: bool = False) -> DataFrame:
    """(group, node, recurrence): how alike a patch's pixels (column x) are to those of its k nearest, by cosine.

    Pixels are standardised in each patch. The plain form is the negative mean distance; `far` gives the mean distance
    scaled to 0..1 instead. A lone patch has no neighbour: null, or 1.0 with `far`.
    """
    n = F.size("x")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    d = patches.withColumn("_m", total(F.col("x")) / n).withColumn("x", F.transform("x", lambda v: v - F.col("_m")))
    d = d.withColumn("_s", F.greatest(F.sqrt(total(F.transform("x", lambda v: v * v)) / n), F.lit(1e-4 if far else 1e-6))).withColumn("x", F.transform("x", lambda v: v / F.col("_s")))
    near = knn(d, group, k).groupBy(*group, F.col("src").alias("node")).agg(F.avg("distance").alias("_d"))
    d = patches.select(*group, "node").join(near, [*group, "node"], "left")
    if not far:
        return d.select(*group, "node", (-F.col("_d")).alias("recurrence"))
    d = normalize_local(d, "_d", "_n", group=group)
    return d.select(*group, "node", F.when(F.col("_d").isNull(), F.lit(1.0)).otherwise(F.col("_n")).alias("recurrence"))


def speckle(df: DataFrame, mask: str, least: Column, group: Sequence[str] = GROUP) -> DataFrame:
    """(group, speckle): the share of a mask's cells in four-connected parts of at least `least` cells (one value a group);
    0 for an empty mask."""
    groups = df.groupBy(*group).agg(F.max(least).alias("_least"))
    sizes = connected_components(df, mask, False, group).groupBy(*group, "component").agg(F.sum(F.col("stop") - F.col("start")).alias("_size"))
    d = groups.join(sizes, list(group), "left").groupBy(*group).agg(F.sum(F.when(F.col("_size") >= F.col("_least"), F.col("_size"))).alias("_kept"), F.sum("_size").alias("_all"))
    return d.select(*group, F.coalesce(F.coalesce("_kept", F.lit(0)) / F.col("_all"), F.lit(0.0)).alias("speckle"))


def texture_reliability(df: DataFrame, texture: str, agreement: str, group: Sequence[str] = GROUP, by_means: bool = False, least: int = 6) -> DataFrame:
    """(group, reliability, peakiness, speckle, support, overlap) of a texture map against an agreement map.

    .35 peakiness, .25 of parts that are no speckle, .20 agreement under the texture's top, .20 overlap of both tops.
    Peakiness compares quantiles; with `by_means` both maps are normalised first and it compares the top's mean with the median.
    """
    d, x, y = df, texture, agreement
    if by_means:
        d = normalize_local(normalize_local(d, texture, "_x", group=group), agreement, "_y", group=group)
        x, y = "_x", "_y"
    d = with_scalars(d, group, _q=F.percentile(x, F.array(F.lit(0.20), F.lit(0.50), F.lit(0.60), F.lit(0.85), F.lit(0.90), F.lit(0.95))), _a=F.percentile(y, F.lit(0.85)))
    d = d.withColumn("_top", F.col(x) >= F.col("_q")[4 if by_means else 3]).withColumn("_agree", F.col(y) >= F.col("_a"))
    q = F.first("_q")
    peak = (F.avg(F.when(F.col("_top"), F.col(x))) - q[1]) / 0.5 if by_means else (q[5] - q[2]) / F.greatest(q[5] - q[0], F.lit(1e-6))
    parts = d.groupBy(*group).agg(
        clip(F.coalesce(peak, F.lit(0.0))).alias("peakiness"), F.coalesce(F.avg(F.when(F.col("_top"), F.col(y))), F.lit(0.0)).alias("support"),
        F.coalesce(F.count_if(F.col("_top") & F.col("_agree")) / F.nullif(F.count_if(F.col("_top") | F.col("_agree")), F.lit(0)), F.lit(0.0)).alias("overlap"),
    )
    out = joined(parts, speckle(d, "_top", F.lit(least), group), group)
    total = 0.35 * F.col("peakiness") + 0.25 * F.col("speckle") + 0.20 * F.col("support") + 0.20 * F.col("overlap")
    return out.select(*group, clip(total).alias("reliability"), "peakiness", "speckle", "support", "overlap")


def transition(clean: float, strong: float) -> tuple[float, float]:
    """(strong, clean) cuts of the speckle share, strong below clean."""
    clean = min(max(clean, 1e-3), 1.0)
    return min(max(strong, 0.0), clean - 1e-3), clean


def texture_passthrough(df: DataFrame, structure: str, group: Sequence[str] = GROUP, reliability: str | None = None, clean: float = 0.85, strong: float = 0.20, least: int = 6) -> DataFrame:
    """(group, speckle, peak, clean_score, passthrough): how much texture a structure map lets through, by a ramp over the
    share of its top that is no speckle.

    With a reliability column the top is the upper 30 %, its peak the upper 10 %, parts of 4 to 8 cells count and the ramp
    ends at .05. Without it the map is normalised, top and peak are the upper 15 %, the cuts are .96 and .50, parts of
    `least` cells count and the ramp goes down to .02.
    """
    d, x = df, structure
    if reliability is None:
        d, x = normalize_local(df, structure, "_x", group=group), "_x"
        (strong, clean), top, peak, need = (0.50, 0.96), 0.85, 0.85, F.lit(least)
    else:
        (strong, clean), top, peak, need = transition(clean, strong), 0.70, 0.90, F.greatest(F.lit(4), F.bround(4 + 4 * F.col(reliability), 0))
    d = with_scalars(d, group, _q=F.percentile(x, F.array(F.lit(top), F.lit(peak))))
    d = d.withColumn("_top", F.col(x) >= F.col("_q")[0])
    peaks = d.groupBy(*group).agg(F.coalesce(F.avg(F.when(F.col(x) >= F.col("_q")[1], F.col(x))), F.lit(0.0)).alias("peak"))
    s = F.col("speckle")
    low = F.lit(0.05) if reliability is not None else 0.02 + 0.03 * clip(s / strong)
    ramp = F.when(s >= clean, 0.25 + 0.75 * clip((s - clean) / max(1 - clean, 1e-6))).when(s >= strong, 0.05 + 0.20 * clip((s - strong) / max(clean - strong, 1e-6))).otherwise(low)
    return joined(speckle(d, "_top", need, group), peaks, group).select(*group, "speckle", "peak", clip(0.70 * s + 0.30 * F.col("peak")).alias("clean_score"), ramp.alias("passthrough"))


def banded_fusion(df: DataFrame, score: str, structure: str, texture: str, reliability: str, out: str, gap_floor: float = 0.10, clean: float = 0.85, strong: float = 0.20, damped: bool = False, policy_columns: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """A score's bands, each normalised, the lower two weighed by how little speckle the structure has, and texture on top.

    `damped` gives texture only the room that the bands leave. `reliability` is a column with one value a group.
    `policy_columns` keeps the weights of texture and of the lower bands, `texture_weight` and `band_weight`.
    """
    low_cut, high_cut = transition(clean, strong)
    policy = texture_passthrough(df, structure, group, reliability, clean, strong)
    policy = policy.select(*group, F.greatest(F.col("passthrough"), F.lit(gap_floor)).alias("_texture"), clip((F.col("speckle") - low_cut) / max(high_cut - low_cut, 1e-6)).alias("_band"))
    d = stored(joined(score_bands(df, score, reliability), policy, group), "bands")
    for band in ("strong", "mid", "low"):
        d = normalize_local(d.withColumn("_s", F.when(F.col(band), F.col(score)).otherwise(F.lit(0.0))), "_s", f"_{band}", group=group)
    d = d.withColumn("_bands", clip(F.col("_strong") + F.col("_band") * (F.col("_mid") + F.col("_low"))))
    room = 1 - F.col("_bands") if damped else F.lit(1.0)
    d = d.withColumn("_mix", clip(F.col("_bands") + F.col("_texture") * F.col(texture) * room))
    if policy_columns:
        d = d.withColumns({"texture_weight": F.col("_texture"), "band_weight": F.col("_band")})
    return normalize_local(d, "_mix", out, group=group).drop("_texture", "_band", "_s", "_strong", "_mid", "_low", "_bands", "_mix", "strong", "mid", "low")


def rescore_with_texture(df: DataFrame, texture: str = "texture", score: str = "score", power: str = "power", gate: str = "gate", support: str = "support", strict: str = "strict", q: float = 0.88, least: int = 6, group: Sequence[str] = GROUP) -> DataFrame:
    """df with `rescored` and `rescored_mask`: the strict score raised by texture where it can be trusted and the structure
    lets it through, more so under support."""
    d = df
    for name in (score, power, support, strict):
        d = normalize_local(d, name, f"_n_{name}", group=group)
    d = stored(d.withColumn("_agreement", F.sqrt(F.greatest(F.col(f"_n_{score}") * F.col(f"_n_{power}"), F.lit(0.0)))), "agreement")
    part = max(3, least // 2)
    gain = joined(texture_reliability(d, texture, "_agreement", group, True, part), texture_passthrough(d, gate, group, least=part).drop("speckle"), group)
    d = joined(d, gain.select(*group, clip(F.col("reliability") * F.col("passthrough")).alias("_gain")), group)
    d = d.withColumn("_mix", F.col(f"_n_{strict}") + F.col("_gain") * F.col(texture) * clip(0.35 + 0.65 * F.col(f"_n_{support}")))
    d = above_quantile(normalize_local(d, "_mix", "rescored", group=group), "rescored", "_over", q, group)
    return smooth_labels(stored(d, "rescored"), "_over", "rescored_mask", 1, least, group).drop("_over", "_mix", "_gain", "_agreement", *[f"_n_{c}" for c in (score, power, support, strict)])
