"""Segmentation of patch grids by noise probability: where noise is unlikely there is a signal.

patches: (group, node, pr, pc, x, residual, gradient), one frame's grid a group; residual and gradient as cell_cues gives
them. The features of other scales and looks are columns as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywave.functions.quantiles import minmax, with_scalars, zscore
from skywave.operators import graph as gr
from skywave.operators import segment as sg
from skywave.operators.fusion import clean_mask, multiscale_agreement
from skywave.operators.windows import incoherence
from skywave.sources.tables import stored

NEIGHBOURS = 12


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _cued(patches: DataFrame, rows: int, cols: int, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    p = stored(patches, "patches")
    edges = stored(gr.knn(p, group, NEIGHBOURS, "euclidean"), "neighbours")
    return p.join(sg.feature_cues(p, edges, rows, cols, group), [*group, "node"]), edges


def _grid(d: DataFrame) -> DataFrame:
    return d.withColumnsRenamed({"pr": "f", "pc": "t"})


def detect_baseline(patches: DataFrame, rows: int, cols: int, group: Sequence[str]) -> DataFrame:
    """(group, node, pr, pc, p, signal, null): noise probability by four cues, smoothed over nearest features and cut
    between the two parts of a mixture; null where the mixture has no two clear parts, and then nothing is signal."""
    d, edges = _cued(patches, rows, cols, group)
    total = F.lit(0.0)
    for name, w in {"residual": 0.45, "coherence": 0.25, "gradient": 0.15, "density": 0.15}.items():
        d = zscore(d, name, f"_z_{name}", group)
        total = total - w * F.col(f"_z_{name}")
    start = d.select(*group, "node", _sigmoid(total).alias("p"))
    p = stored(gr.propagate_in_frames(start, edges, group, rounds=20), "noise")
    cut = sg.mixture_thresholds(p, group).select(*group, "threshold")
    d = patches.select(*group, "node", "pr", "pc").join(p, [*group, "node"]).join(cut, list(group))
    d = _grid(d).withColumn("null", F.col("threshold").isNull()).withColumn("_m", ~F.col("null") & F.coalesce(F.col("p") < F.col("threshold"), F.lit(False)))
    d = clean_mask(stored(d, "baseline"), "_m", "signal", rows * cols, group=group)
    return d.select(*group, "node", F.col("f").alias("pr"), F.col("t").alias("pc"), "p", "signal", "null")


def _anchored(d: DataFrame, column: str) -> DataFrame:
    """Patches of the lowest residual are surely noise, of the highest surely signal."""
    x = F.when(F.col("residual") <= F.col("_anchor")[0], F.greatest(F.col(column), F.lit(0.98))).otherwise(F.col(column))
    return d.withColumn(column, F.when(F.col("residual") >= F.col("_anchor")[1], F.least(x, F.lit(0.02))).otherwise(x))


def detect_refined(
    patches: DataFrame, rows: int, cols: int, group: Sequence[str], other_scale: str = "x_smooth", looks: Sequence[str] = (), previous: str | None = None, spans: tuple[int, int] | None = None, boost: float = 0.20
) -> DataFrame:
    """(group, node, pr, pc, p, signal, tau, fallback, guarded): noise probability by four heads, pinned at sure patches,
    smoothed over nearest features and refined by its neighbourhood; hysteresis, cleaning and the physical guards follow.

    `other_scale`: features of a smoothed frame. `looks`: columns with features of disturbed frames (none: the patches' own).
    `previous`: the noise probability of the frame before. `spans`: least rows and columns of a signal (None: no filter).
    A mixture without two clear parts falls back to the lower third.
    """
    d, edges = _cued(patches, rows, cols, group)
    d = stored(with_scalars(d, group, _anchor=F.percentile("residual", F.array(F.lit(0.20), F.lit(0.92)))), "cues")
    protos = stored(gr.prototypes(d, "residual", group), "prototypes")
    named = lambda column: d.select(*group, "node", F.col(column).alias("x"))
    ratio = gr.prototype_ratio(named("x"), protos, group).withColumnRenamed("ratio", "_proto")
    local = sg.manifold_head(edges, group).withColumnRenamed("p", "_local")
    seen = None
    for name in looks or ("x",):
        one = gr.prototype_ratio(named(name), protos, group)
        seen = one if seen is None else seen.union(one)
    unsure = sg.uncertainty(seen, "ratio", group, "node").withColumnRenamed("uncertainty", "_unsure")
    d = multiscale_agreement(d, "x", other_scale, "_multi", group).join(ratio, [*group, "node"]).join(local, [*group, "node"], "left").join(unsure, [*group, "node"])
    d = zscore(zscore(d, "coherence", "_zc", group), "gradient", "_zg", group)
    d = d.withColumn("_pre", 0.42 * F.col("_proto") + 0.20 * F.coalesce("_local", F.lit(0.5)) + 0.18 * F.col("_multi") - 0.12 * F.col("_zc") - 0.08 * F.col("_zg"))
    d = zscore(d, "_pre", "_z", group).withColumn("_pre", _sigmoid(F.col("_z")))
    before = F.lit(0.0)
    if previous is not None:
        d = minmax(d.withColumn("_step", F.coalesce(F.abs(F.col("_pre") - F.col(previous)), F.lit(0.0))), "_step", "_moved", group)
        before = F.col("_moved")
    d = d.withColumn("p", F.least(F.greatest(0.82 * F.col("_pre") + 0.10 * F.col("_unsure") + 0.08 * before, F.lit(0.0)), F.lit(1.0)))
    kept = ["residual", "coherence", "_anchor"] + ([previous] if previous is not None else [])
    d = stored(_anchored(d, "p").select(*group, "node", "pr", "pc", "p", *kept), "pinned")
    p = gr.propagate_in_frames(d, edges, group, rounds=25)
    d = _grid(stored(_anchored(d.drop("p").join(p, [*group, "node"]), "p"), "propagated"))
    d = stored(incoherence(d, "p", "_apart", rows, cols, previous, group), "incoherence")
    d = sg.signal_prior(d, "residual", "coherence", "_apart", "_prior", group)
    d = stored(_anchored(sg.refine(d, "p", "_apart", "_prior", "p", group), "p"), "refined")
    cut = sg.mixture_thresholds(d, group).select(*group, "threshold")
    d = with_scalars(d.join(cut, list(group)), group, _third=F.percentile("p", F.lit(0.33)))
    d = d.withColumn("fallback", F.col("threshold").isNull()).withColumn("tau", F.coalesce("threshold", "_third"))
    d = stored(sg.hysteresis(d, "p", "tau", "_m", group=group), "hysteresis")
    d = stored(clean_mask(d, "_m", "signal", rows * cols, True, group), "cleaned")
    if spans is not None:
        d = sg.persistence_filter(d, "signal", "p", *spans, boost, group)
    d = sg.coverage_guard(d, "signal", "p", group)
    return d.select(*group, "node", F.col("f").alias("pr"), F.col("t").alias("pc"), "p", "signal", "tau", "fallback", "guarded")
