"""Fusing patch and cell scores; masks cleaned after it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywave.config import Grouping
from skywave.functions.quantiles import GROUP, above_quantile, normalize_local, with_scalars
from skywave.kernels.arrays import drop_position_components, position_basis, principal_scores, ridge_detrend
from skywave.operators.components import component_cells, component_table, connected_components, fill_holes, mark, remove_small
from skywave.operators.graph import dot
from skywave.operators.windows import closing, opening
from skywave.sources.tables import stored


def hybrid(df: DataFrame, weights: dict[str, float], out: str, q: float = 0.90, group: Sequence[str] = GROUP) -> DataFrame:
    """`out` is the weighted sum of normalised scores, out + "_mask" where it reaches the quantile."""
    d, total = df, F.lit(0.0)
    for i, (name, w) in enumerate(weights.items()):
        d = normalize_local(d, name, f"_h{i}", group=group)
        total = total + w * F.col(f"_h{i}")
    d = d.withColumn(out, total).drop(*[f"_h{i}" for i in range(len(weights))])
    return above_quantile(d, out, f"{out}_mask", q, group)


def multiscale_agreement(df: DataFrame, a: str, b: str, out: str, group: Sequence[str]) -> DataFrame:
    """Sigmoid of the standardised negative cosine of two embeddings of a patch."""
    cos = dot(F.col(a), F.col(b)) / F.greatest(F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))), F.lit(1e-12))
    d = with_scalars(df.withColumn("_c", -cos), group, _mean=F.avg("_c"), _spread=F.stddev_pop("_c"))
    return d.withColumn(out, 1 / (1 + F.exp(-(F.col("_c") - F.col("_mean")) / (F.col("_spread") + 1e-8)))).drop("_c", "_mean", "_spread")


def _frames(patches: DataFrame, group: Sequence[str], change) -> DataFrame:
    """The patches with x changed by change(x, pr, pc, rows, cols), a frame's grid at a time."""
    types = {f.name: f.dataType.simpleString() for f in patches.schema}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("node")
        x = change(np.stack(p["x"].to_numpy()), p["pr"].to_numpy(float), p["pc"].to_numpy(float), int(p["pr"].max()) + 1, int(p["pc"].max()) + 1)
        return p.assign(x=list(x))

    cols = [*group, "node", "pr", "pc", "x"]
    return patches.select(*cols).where("x is not null").groupBy(*group).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols))


def detrend_position(patches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Features less their ridge fit on the grid position; one frame's grid is one group. Patches without features go."""
    return _frames(patches, group, ridge_detrend)


def principal_features(patches: DataFrame, group: Sequence[str], most: int = 12) -> DataFrame:
    """Features as scores on the frame's leading principal axes (signs are arbitrary); one frame's grid is one group."""
    return _frames(patches, group, lambda x, pr, pc, rows, cols: principal_scores(x, most))


def drop_position(patches: DataFrame, group: Sequence[str], limit: float = 0.30) -> DataFrame:
    """Features without the principal components that follow the grid position; one frame's grid is one group."""
    return _frames(patches, group, lambda x, pr, pc, rows, cols: drop_position_components(x, position_basis(pr, pc, rows, cols)[:, 1:], limit))


def content_features(patches: DataFrame, group: Sequence[str], most: int = 12, limit: float = 0.30) -> DataFrame:
    """principal_features, detrend_position and drop_position in one task for each frame."""

    def change(x: np.ndarray, pr: np.ndarray, pc: np.ndarray, rows: int, cols: int) -> np.ndarray:
        flat = ridge_detrend(principal_scores(x, most), pr, pc, rows, cols)
        return drop_position_components(flat, position_basis(pr, pc, rows, cols)[:, 1:], limit)

    return _frames(patches, group, change)


def clean_mask(df: DataFrame, mask: str, out: str, cells: int, conservative: bool = False, group: Sequence[str] = GROUP) -> DataFrame:
    """Opened by 2 x 2, closed by 3 x 3, holes filled and small parts gone; conservative: opened and closed by 2 x 2, small parts gone."""
    if conservative:
        d = closing(opening(df, mask, "_c", 2, 2, group), "_c", "_c", 2, 2, group)
        return remove_small(d, "_c", out, max(4, int(0.0025 * cells)), group).drop("_c")
    d = closing(opening(df, mask, "_c", 2, 2, group), "_c", "_c", 3, 3, group)
    d = fill_holes(stored(d, "clean"), "_c", "_d", group)
    return remove_small(d, "_d", out, max(4, int(0.003 * cells)), group).drop("_c", "_d")


def rectangles(df: DataFrame, mask: str, score: str, settings: Grouping = Grouping(), group: Sequence[str] = GROUP, valid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The components of a mask closed on both axes with its holes filled, with `keep`, and df with that mask as `_d`.

    A component counts when it has the size and the spans, and either the box density or a peak that reaches the median
    score of the mask's cells. Where a column names the valid rows, others hold no mask.
    """
    d = df.withColumn("_seed", F.col(mask) if valid is None else F.col(mask) & F.col(valid))
    floor = F.coalesce(F.percentile(F.when(F.col("_seed"), F.col(score)), F.lit(0.5)), F.lit(0.0))
    floors = d.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(floor.alias("_floor"))
    d = fill_holes(stored(closing(d, "_seed", "_c", settings.bridge_f, settings.bridge_t, group), "rectangles"), "_c", "_d", group)
    d = stored(d, "filled")
    table = component_table(component_cells(connected_components(d, "_d", False, group), group), d, score, group)
    on = F.lit(True)
    for g in group:
        on = on & (table[g] == F.col(f"_{g}"))
    table = table.join(floors, on).drop(*[f"_{g}" for g in group])
    keep = (F.col("filled_area") >= settings.min_size) & (F.col("freq_span") >= settings.min_f) & (F.col("time_span") >= settings.min_t) & ((F.col("bbox_density") >= settings.min_density) | (F.col("score_peak") >= F.col("_floor")))
    return table.withColumn("keep", keep).drop("_floor"), d


def group_rectangles(df: DataFrame, mask: str, score: str, out: str, settings: Grouping = Grouping(), group: Sequence[str] = GROUP) -> DataFrame:
    """Cells in the bounding boxes of the components that `rectangles` keeps."""
    table, d = rectangles(df, mask, score, settings, group)
    cells = table.where("keep").withColumn("f", F.explode(F.sequence(F.col("freq_start"), F.col("freq_stop") - 1))).withColumn("t", F.explode(F.sequence(F.col("time_start"), F.col("time_stop") - 1)))
    return mark(d, cells.select(*group, "f", "t"), out, group).drop("_c", "_d", "_seed")
